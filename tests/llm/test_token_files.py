import zlib

import numpy as np
import pytest
from pyarrow import fs

from gridmine.llm import token_files as T

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("values", [[0], [5, 5, 5], [0, 1, 2, 3], [3, 900, 900, 70000, 10**12], list(range(0, 30000, 7)), [2**63 + 5]])
def test_elias_fano_round_trip(values):
    coded = T.EliasFano.from_bytes(T.EliasFano.of(np.array(values, np.uint64)).to_bytes())
    assert coded.all().tolist() == values
    picks = range(0, len(values), max(1, len(values) // 50))
    assert [coded.select(i) for i in picks] == [values[i] for i in picks]
    for x in {0, values[0], values[-1], values[len(values) // 2]}:
        assert coded.rank(x) == sum(v <= x for v in values)


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 1000, 20000))
    assert len(T.EliasFano.of(ends).to_bytes()) < 20000 * 1.6


def plain(rows):
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [(d, np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")) for d, x in rows]


def test_matches_the_tokenizer(docs, rows):
    got = sorted(T.token_files(docs).collect(), key=lambda r: r["start"])
    want = plain([(d, t) for d, t, _ in rows])
    assert [r["doc_id"] for r in got] == sorted([d for d, _ in want], key=lambda d: (d is not None, d))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(d), len(i), zlib.crc32(i.tobytes())) for d, i in want)


def test_one_document_from_a_file(docs, rows, tmp_path):
    manifest = T.write_token_shards(docs, str(tmp_path / "t"), shards=3)
    want = {}
    for d, ids in plain([(d, t) for d, t, _ in rows]):
        want.setdefault(d, []).append(ids.tolist())
    seen = 0
    for r in manifest.collect():
        shard = T.TokenShard(r["path"], fs.LocalFileSystem())
        for i in range(shard.n_docs):
            assert shard.tokens(i).tolist() in want[shard.doc_id(i)]
            seen += 1
    assert seen == len(rows)


def test_empty_table(no_docs):
    assert T.token_files(no_docs).collect() == []


def test_full_memory_still_encodes(monkeypatch):
    monkeypatch.setattr(T, "_REMEMBERED", 2)
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, t = T.PieceEncoder(path), tokenizers.Tokenizer.from_file(path)
    for text in ("one two three, four!", "it's\nnew — «lines» here", "", "a"):
        assert np.frombuffer(encode(text), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids
