import random

import numpy as np
import pytest
from test_ngram_join import near_copies, plain

from gridmine.llm import odd_sketch as O
from gridmine.llm.text_hash import shingle_sets


def digest(rows, n, percent):
    return sorted(((d, size, c, d is not None and d == c) for d, size, c in plain(rows, n, percent)), key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("n, percent", [(4, 80), (5, 90)])
def test_against_brute_force(spark, rows, n, percent):
    every = [(d, t) for d, t, _ in rows] + near_copies()
    df = spark.createDataFrame(every, "doc_id long, text string").repartition(3)
    assert collected(O.near_duplicate_digest(df, n, percent)) == digest(every, n, percent)


@pytest.mark.parametrize("bucket_rows, block_rows, broadcast", [(3, 4, 10**6), (4096, 3, 0)])
def test_large_buckets_and_groups(spark, monkeypatch, bucket_rows, block_rows, broadcast):
    monkeypatch.setattr(O, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(O, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(O, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(O, "_BATCH_BYTES", 700)
    every = near_copies() + [(9000 + k, t) for k, (_, t) in enumerate(near_copies()) if k % 3]
    df = spark.createDataFrame(every, "doc_id long, text string").repartition(3)
    assert collected(O.near_duplicate_digest(df, 4, 80)) == digest(every, 4, 80)


def test_extra_columns_and_no_rows(docs, rows, no_docs):
    want = digest([(d, t) for d, t, _ in rows], 5, 80)
    assert collected(O.near_duplicate_classes(docs).drop("digest")) == want
    assert O.near_duplicate_digest(no_docs).collect() == []


def test_equal_ids_of_unlike_texts(spark):
    words = [" ".join(f"{g}{k}" for k in range(40)) for g in "abc"]
    every = [(5, words[0]), (5, words[1]), (5, words[1]), (7, words[1]), (3, words[2]), (5, words[2] + " x")]
    df = spark.createDataFrame(every, "doc_id long, text string").repartition(2)
    assert collected(O.near_duplicate_digest(df, 4, 80)) == digest(every, 4, 80)


def pair(draw, size, similarity):
    common = round(2 * size * similarity / (1 + similarity))
    make = lambda n: [draw.getrandbits(64) for _ in range(n)]
    both = make(common)
    return [np.sort(np.array(both + make(size - common), np.uint64)) for _ in range(2)]


def test_sketches_estimate_high_similarities():
    draw = random.Random(12)
    for similarity, within in ((1.0, 0.0), (0.95, 0.05), (0.9, 0.07), (0.8, 0.11)):
        errors, passed, shared = [], 0, 0
        for _ in range(150):
            a, b = pair(draw, 900, similarity)
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            bands, sketch = O.sketched(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            z = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
            errors.append(O.estimate(z) - true)
            passed += z <= O.most_bits(80)
            shared += bool((bands[0] == bands[1]).any())
        assert passed == shared == 150
        assert max(map(abs, errors)) <= within + 1e-9 and abs(sum(errors) / 150) < 0.01
    unlike = [O.sketched(np.concatenate(p), np.array([0, 900, 1800]))[1] for p in (pair(draw, 900, 0.4) for _ in range(50))]
    assert all(np.bitwise_count(s[0] ^ s[1]).sum() > O.most_bits(80) for s in unlike)


def test_samples_agree_as_often_as_sets():
    draw = random.Random(13)
    share = []
    for _ in range(40):
        a, b = pair(draw, 500, 0.8)
        samples = O.minhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        share.append((samples[0] == samples[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(sum(share) / 40) < 0.015


def test_forest_connects_what_may_link():
    texts = [t.encode() for _, t in near_copies()]
    sets, at = shingle_sets(texts, 4)
    sizes = np.diff(at)
    _, sketches = O.sketched(sets, at)
    pairs = O.forest(sizes, sketches, 80)
    assert len(pairs) < len(texts)
    root = list(range(len(texts)))
    for i, j in pairs:
        root = [root[i] if r == root[j] else r for r in root]
    for i in range(len(texts)):
        for j in range(i):
            z = int(np.bitwise_count(sketches[i] ^ sketches[j]).sum())
            if z <= O.most_bits(80) and 100 * min(sizes[i], sizes[j]) >= 80 * max(sizes[i], sizes[j]):
                assert root[i] == root[j]
