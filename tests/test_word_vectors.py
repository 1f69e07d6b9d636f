"""Word vectors, block dictionaries, vocabularies, folds and pages against plain versions."""

import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmine.operators import aggregates, dictionaries, joins, ordering
from gridmine.operators import word_vectors as V


def plain_vectors(texts, size, window, share):
    """One occurrence after the other, in whole numbers."""
    counts = Counter(w for t in texts for w in t or [])
    total = sum(counts.values())
    weight = {w: max(1, round(V.UNIT * (share * total / n) ** 0.5)) if n > share * total else V.UNIT for w, n in counts.items()}
    sign = {w: V.signs(np.array([crc32(w.encode())], np.uint32), size)[0].astype(int) for w in counts}
    sums, weights = {w: np.zeros(size, int) for w in counts}, Counter()
    for t in texts:
        for i, w in enumerate(t or []):
            for j in range(max(0, i - window), min(len(t), i + window + 1)):
                if j != i:
                    sums[w] += sign[t[j]] * weight[t[j]]
                    weights[w] += weight[t[j]]
    mean = sum(counts[w] * weight[w] * sign[w] for w in counts) / sum(counts[w] * weight[w] for w in counts)
    out = {}
    for w in counts:
        v = sums[w] / weights[w] - mean if weights[w] else np.zeros(size)
        out[w] = v / np.linalg.norm(v) if np.linalg.norm(v) else v
    return counts, out


def topics(seed, n):
    """Texts about one of two topics, with words of both in between, and words that occur once."""
    draw = random.Random(seed)
    texts = []
    for k in range(n):
        own = [f"{'ab'[k % 2]}{j}" for j in range(30)]
        texts.append([draw.choice(own) if draw.random() < 0.6 else f"c{draw.randint(0, 9)}" for _ in range(draw.randint(0, 40))] + [f"once{k}"])
    return texts + [["alone"], [], None, ["same"] * 7]


@pytest.mark.parametrize("chunk, many, kept, places", [(1 << 20, 50, 20_000, 1 << 14), (90, 2, 3, 8), (1 << 20, 0, 20_000, 16), (200, 10**6, 1, 5)])
def test_against_one_occurrence_after_the_other(spark, monkeypatch, chunk, many, kept, places):
    for name, value in (("CHUNK", chunk), ("MANY", many), ("_KEPT", kept), ("_PLACES", places)):
        monkeypatch.setattr(V, name, value)
    texts = topics(1, 60)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, words array<string>").repartition(3)
    got = {r["word"]: (r["n"], r["vector"]) for r in V.context_vectors(df, size=70, window=3, common_share=0.02).collect()}
    counts, want = plain_vectors(texts, 70, 3, 0.02)
    assert {w: n for w, (n, _) in got.items()} == dict(counts)
    for w, (_, v) in got.items():
        assert v == pytest.approx(want[w].tolist(), abs=1e-12)
    assert got["alone"][1] == [0.0] * 70


def test_words_of_a_topic_are_near_each_other(spark):
    df = spark.createDataFrame([(t,) for t in topics(2, 2000)], "words array<string>").repartition(4)
    got = {r["word"]: np.array(r["vector"]) for r in V.context_vectors(df).collect()}
    a, b = (np.stack([got[f"{x}{j}"] for j in range(30)]) for x in "ab")
    same = (a @ a.T)[~np.eye(30, dtype=bool)]
    assert same.min() > 0.3 and (a @ b.T).max() < 0
    again = V.context_vectors(df.repartition(7)).collect()
    assert {r["word"]: r["vector"] for r in again} == {w: v.tolist() for w, v in got.items()}
    assert V.context_vectors(df.limit(0)).collect() == []


@pytest.mark.parametrize("block", [1 << 18, 5])
def test_block_dictionaries(spark, monkeypatch, block):
    monkeypatch.setattr(dictionaries, "BLOCK_WORDS", block)
    monkeypatch.setattr(dictionaries, "_ROWS_AT_ONCE", 2)
    draw = random.Random(3)
    rows = [(k, [draw.choice(["the", f"w{draw.randint(0, 40)}", "?"]) for _ in range(draw.randint(0, 12))], "x") for k in range(80)]
    rows += [(100, None, "y"), (101, [], "y"), (102, ["?", "?"], "y"), (103, ["the", None, "w1"], None), (104, ["the"] * 50, "y"), (104, ["the"] * 50, "y")]
    df = spark.createDataFrame(rows, "id int, words array<string>, _word string").repartition(3)
    vocab = spark.createDataFrame([("the", 1)] + [(f"w{k}", k + 2) for k in range(41)] + [("absent", 99)], "word string, idx int")
    ids = {"the": 1} | {f"w{k}": k + 2 for k in range(41)}
    want = sorted((k, [ids[w] for w in t or [] if w in ids], x) for k, t, x in rows if x) + [(103, [1, 3], None)]
    got = [tuple(r) for r in dictionaries.encode_by_blocks(df, "words", vocab).select("id", "ids", "_word").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    joined = joins.encode_arrays(df, "words", vocab, limit=0)
    assert joined.columns == ["id", "words", "_word", "ids"]
    assert sorted(([r["id"], r["ids"]] for r in joined.collect()), key=str) == sorted(([k, i] for k, i, _ in want), key=str)
    assert dictionaries.encode_by_blocks(df.limit(0), "words", vocab).collect() == []
    assert {len(r["ids"]) for r in dictionaries.encode_by_blocks(df, "words", vocab.limit(0)).collect()} == {0}


def test_a_frequent_word_meets_the_vocabulary_once_a_block(spark):
    df = spark.range(3000).select(F.array_repeat(F.lit("the"), 30).alias("words")).repartition(3)
    rows = dictionaries.with_block_dictionaries(df, "words")
    assert [r["_words"] for r in rows.where("_words is not null").collect()] == [["the"]] * 3


@pytest.mark.parametrize("size", [0, 1, 7, 8, 25, 10**6])
def test_vocabulary_cut(spark, monkeypatch, size):
    draw = random.Random(4)
    words = [f"w{draw.randint(0, 9)}" for _ in range(200)] + [f"rare{k}" for k in range(20)] + [f"two{k // 2}" for k in range(30)]
    df = spark.createDataFrame([(k % 7, w) for k, w in enumerate(words)], "doc int, token string").repartition(3)
    want = [(w, n, i + 1) for i, (w, n) in enumerate(sorted(Counter(words).items(), key=lambda x: (-x[1], x[0]))[:size])]
    for most in (aggregates.MOST_SORTED, 0):
        monkeypatch.setattr(aggregates, "MOST_SORTED", most)
        assert sorted(map(tuple, aggregates.vocabulary(df, size).collect()), key=lambda r: r[2]) == want
    several = {w for w in set(words) if len({k % 7 for k, x in enumerate(words) if x == w}) >= 2}
    got = aggregates.vocabulary(df, size, min_df=2, doc="doc").collect()
    assert sorted(((r["word"], r["freq"]) for r in got), key=lambda x: (-x[1], x[0])) == sorted(((w, n) for w, n in Counter(words).items() if w in several), key=lambda x: (-x[1], x[0]))[:size]


def test_fold_of_one_huge_column(spark):
    draw = random.Random(5)
    cells = [(c, k, n, [draw.uniform(-1, 1) for _ in range(2)]) for c, m, n in (("hot", 900, 2), ("x", 5, 5), (None, 4, 3), ("one", 1, 1)) for k in range(m)]
    draw.shuffle(cells)
    df = spark.createDataFrame(cells, "col string, row int, n int, vector array<double>").repartition(3)
    got = {r.col: r.vector for r in aggregates.vec_fold(df, ["col"], "n", mode="decay").collect()}
    for c in ("hot", "x", None, "one"):
        acc = np.zeros(2)
        for _, _, n, v in sorted((x for x in cells if x[0] == c), key=lambda x: x[1]):
            acc = (acc + np.array(v)) / n
        assert got[c] == pytest.approx(acc.tolist(), abs=1e-12)


@pytest.mark.parametrize("offset, n", [(0, 5), (700, 30), (1, 1), (995, 40), (2000, 5), (0, 0), (0, 5000)])
def test_page(spark, offset, n):
    rows = [(None if k % 50 == 0 else k // 300, k) for k in range(1000)]
    df = spark.createDataFrame(random.Random(6).sample(rows, 1000), "a int, b int").repartition(3)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))[offset : offset + n]
    assert [tuple(r) for r in ordering.page(df, offset, n, ["a", "b"]).collect()] == want


@pytest.mark.parametrize("block, texts_of_block, at_once, chunk, many", [(1 << 20, 1 << 13, 1 << 12, 1 << 20, 50), (30, 4, 3, 90, 2)])
def test_means_of_context_vectors(spark, monkeypatch, block, texts_of_block, at_once, chunk, many):
    for module, name, value in ((dictionaries, "BLOCK_WORDS", block), (dictionaries, "_ROWS_AT_ONCE", 2), (V, "BLOCK_TEXTS", texts_of_block), (V, "_AT_ONCE", at_once), (V, "CHUNK", chunk), (V, "MANY", many)):
        monkeypatch.setattr(module, name, value)
    texts = topics(5, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, words array<string>").repartition(3)
    docs = [(k, t, "x" if k % 2 else None) for k, t in enumerate(texts) if k % 3] + [(900, ["a1", "unknown"], "y"), (901, ["alone"], "y"), (902, [], "z"), (903, ["a1", None], "z")]
    got = V.context_means(df, spark.createDataFrame(docs, "id int, words array<string>, name string").repartition(3), size=70, common_share=0.02)
    assert got.columns == ["id", "name", "vector"]
    _, vectors = plain_vectors(texts, 70, 3, 0.02)
    want = {k: np.mean([vectors.get(w, np.zeros(70)) for w in t], axis=0) for k, t, _ in docs if t}
    rows = got.collect()
    assert sorted((r["id"], r["name"]) for r in rows) == sorted((k, x) for k, t, x in docs if t) and len(rows) == len(want)
    for r in rows:
        assert r["vector"] == pytest.approx(want[r["id"]].tolist(), abs=1e-12)


def test_only_words_travel_for_means(spark, monkeypatch):
    """No row per text and word meets a vector: a word that all texts share is asked once a block."""
    asked = []
    joined = type(spark.range(0)).join
    monkeypatch.setattr(type(spark.range(0)), "join", lambda self, other, *a, **b: (asked.append(self.count()), joined(self, other, *a, **b))[1])
    df = spark.range(500).select("id", F.array(F.lit("the"), F.lit("of"), F.concat(F.lit("w"), F.col("id").cast("string"))).alias("words")).repartition(2)
    assert V.context_means(df, df, size=10).count() == 500
    assert asked == [500 + 2 * 2]


def test_digests_are_means_of_those_of_the_tokens(spark):
    from gridmine.operators import embed

    draw = random.Random(6)
    lists = [[f"t{draw.randint(0, 3)}" for _ in range(draw.randint(0, 40))] for _ in range(50)] + [None, [], ["ü"], ["t0"] * 200_000]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, words array<string>").coalesce(1)
    got = dict(map(tuple, df.select("id", embed.tokens_vector_digest("words", 300)).collect()))
    for k, words in enumerate(lists):
        vectors = {w: embed._token_codes([w], 300)[0] / 32768.0 - 1 for w in set(words or [])}
        want = embed.digest_of(np.mean([vectors[w] for w in words], axis=0)[None, :])[0].tolist() if words else None
        assert got[k] == (pytest.approx(want, abs=1e-6) if want else None)


def test_a_run_is_cut_out_of_its_text_once(spark):
    from gridmine.operators import tokens

    df = spark.createDataFrame([([(0, "ab"), (1, "##c"), (2, "d")],)], "items array<struct<pos: int, token: string>>")
    for runs in (tokens.subword_runs, tokens.span_runs):
        assert df.select(runs("items").alias("r"))._jdf.queryExecution().analyzed().toString().count("slice(") == 1
