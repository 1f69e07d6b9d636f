"""The entry module with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("drop_pipeline", [False, True])
def test_imports_without_the_optional_folders(tmp_path, drop_pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *(["corpus_pipeline.py"] if drop_pipeline else [])))
    code = "import __spark_entry__ as e; print('\\n'.join(sorted(e.queries()))); assert set(e.oracle_sql()) <= set(e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    optional = {n for n in entry.queries() if n == "pipeline" or n.startswith("op") and n[2].isdigit()}
    assert set(out) == set(entry.queries()) - optional
