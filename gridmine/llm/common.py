"""Small helpers the operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmine.session import materialise, partition_count, scratch_dir  # noqa: F401

#: ASCII upper case to lower case; other letters keep their case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of characters outside this class.
BLANKS = r"[\x20\x09-\x0D]+"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column, separators: str = BLANKS) -> Column:
    """Words between separators, in order; empty array for empty text."""
    return F.array_remove(F.split(text, separators), "")


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker (functions are shipped by value)."""
    module = sys.modules.setdefault("_gridmine_llm_cache", types.ModuleType("_gridmine_llm_cache"))
    return module.__dict__.setdefault(name, {})


#: Rows of an Arrow batch: texts are long, and batches live outside the heap on either side of the pipe.
BATCH_ROWS = 2500


def text_batches(docs: DataFrame) -> DataFrame:
    """The documents, with the session told to hand texts to Python in batches of at most ``BATCH_ROWS``."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return docs


def sliced(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the bytes of one column stay near a bound (one row may exceed it)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for row, n in enumerate(lengths.tolist()):
            if held and held + n > most_bytes:
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += n
        yield batch.slice(first)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")
