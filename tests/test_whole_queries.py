"""Registered queries on small fixtures, against what they must return in full."""

import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog import models
from gridmine.operators import joins
from gridmine.plans import similarity


def documents(spark, path, texts):
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, i % 2) for i in range(len(texts))]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_rare_words_get_vectors(spark, tmp_path):
    texts = [f"common common words once{k} and twice{k // 2}" for k in range(40)]
    sf = documents(spark, tmp_path, texts)
    want = {w for t in texts for w in t.split(" ")}
    got = entry.queries()["m8_word2vec"](spark, sf).collect()
    assert {r["word"] for r in got} == want and len(got) == len(want)
    assert {tuple(r)[1:] for r in got} == {(300, True)}
    assert {tuple(r) for r in entry.queries()["m9_export_word_vectors"](spark, sf).collect()} == {(w, 300) for w in want}
    assert entry.queries()["m10_trained_vector_network"](spark, sf).count() > 0


def test_encoding_keeps_the_words_of_a_large_vocabulary(spark, tmp_path):
    texts = [" ".join(f"w{k:05d}" for k in range(first, first + 200)) for first in range(0, 51000, 200)]
    sf = documents(spark, tmp_path, texts)
    for name, size in (("j8_encode_by_vocabulary", 50000), ("j8_encode_by_large_vocabulary", 51000)):
        got = {r["doc_id"]: r["ids"] for r in entry.queries()[name](spark, sf).collect()}
        # all words are equally frequent, so ids follow their order
        assert got == {d: " ".join(str(k + 1) for k in range(d * 200, d * 200 + 200)) for d in range(size // 200)}


def vector(token, dims=768):
    a, b, c = (int(hashlib.md5(token.encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(3))
    return [(a + b * i + c * i * i) % 2**32 // 2**16 / 2**15 - 1 for i in range(dims)]


def test_encoders_have_the_full_width(spark, tmp_path):
    sf = documents(spark, tmp_path, ["one two", "two three three"])
    rows = entry.queries()["m12_embed_tokens"](spark, sf).collect()
    got = {r["token"]: (r["width"], r["total"], r["weighed"]) for r in rows}
    digest = lambda v: (768, pytest.approx(sum(v), abs=2e-3), pytest.approx(sum((i + 1) * x for i, x in enumerate(v)), abs=2e-3))
    assert got == {t: digest(vector(t)) for t in ("one", "two", "three")} and len(rows) == 3
    got = {r["doc_id"]: (r["width"], r["total"], r["weighed"]) for r in entry.queries()["m12_embed_texts"](spark, sf).collect()}
    words = {0: ["one", "two"], 1: ["two", "three", "three"]}
    assert got == {d: digest([sum(x) / len(w) for x in zip(*map(vector, w))]) for d, w in words.items()}


def test_mean_vector_network_has_the_full_width(spark, tmp_path, monkeypatch):
    sf = documents(spark, tmp_path, [f"common words once{k} and twice{k // 2}" for k in range(40)])
    widths = []
    train = models.ml.train
    monkeypatch.setattr(models.ml, "train", lambda *a, **b: widths.append(b["inputs"]) or train(*a, **b))
    assert entry.queries()["m10_mean_vector_network"](spark, sf).count() > 0
    assert widths == [300]


def test_six_places_of_a_component(spark):
    values = [0.0, -0.0, -1e-9, 0.1234564, 0.1234566, -0.9999996, 1.0, 1e-6, 0.5, -0.000123456]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = df.select("x", models.six_places(F.col("x")).alias("t"), F.round("x", 6).cast("string").alias("r"))
    assert all(r["t"] == r["r"] and float(r["t"]) == round(r["x"], 6) for r in got.collect())
    assert "round(" not in df.select(models.six_places(F.col("x")))._jdf.queryExecution().analyzed().toString()


def test_tables_reach_the_encoder_in_short_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    tables = spark.range(2500).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("table_id"), F.array(F.concat(F.lit("w"), F.col("id") % 7)).alias("rows"))
    try:
        spark.conf.set(name, "10000")
        got = {r["id"]: r["a_similarity"] for r in similarity.table_similarity(tables, {"a": {"id": "3", "table_id": 1}}, 16).collect()}
        assert int(spark.conf.get(name)) <= 1000
        assert len(got) == 2500 and {i for i, x in got.items() if x == 1.0} == {str(i) for i in range(3, 2500, 7)}
    finally:
        spark.conf.set(name, before)


def test_a_group_of_pairs_is_bounded(spark, monkeypatch):
    """Every pair is a row of the result, so a group holds at most 2,048 rows of either side (before: 4,096)."""
    groups = []
    kept = joins.block_cogroup
    monkeypatch.setattr(joins, "block_cogroup", lambda left, right, fn, schema, *blocks: (groups.append(blocks), kept(left, right, fn, schema, *blocks))[1])
    v = spark.range(300).select("id", F.array(F.col("id") * 1.0, F.lit(1.0)).alias("vector"))
    refs = v.where("id % 20 = 0").select(F.col("id").alias("ref"), F.col("vector").alias("ref_vector"))
    assert joins.cross_refs(v, refs, max_inline=0).count() == 300 * 15
    assert len(groups) == 1 and groups[0] and groups[0][0] * groups[0][1] <= 1 << 22


def test_mixed_vectors_meet_two_ids_in_nine(spark, tmp_path):
    rows = [(i, [float(i % 7 + 1 + k % (i % 5 + 2)) for k in range(64)], i % 10) for i in range(1, 100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    usable = {i for i in range(1, 100) if i % 11 and i % 7}
    kind = {i: 0 if i % 5 == 0 else 1 if i % 13 == 0 else 2 for i in usable}
    want = {(i, ref) for ref in usable if ref % 9 < 2 for i in usable if kind[i] == kind[ref]}
    for name in ("inline", "in_blocks"):
        got = entry.queries()[f"j1_mixed_vectors_{name}"](spark, str(tmp_path)).collect()
        assert {(r["id"], r["ref"]) for r in got} == want and len(got) == len(want)
        got = entry.queries()[f"q1_mixed_vectors_{name}"](spark, str(tmp_path)).collect()
        assert {r["query"] for r in got} == {ref for _, ref in want}


def test_texts_and_merged_words_show_components_of_their_mean_vector(spark, tmp_path):
    sf = documents(spark, tmp_path, ["one two", "two three, three", ""])
    mean = lambda words, dims: [sum(x) / len(words) for x in zip(*(vector(w, dims) for w in words))]
    got = {r["doc_id"]: [int(x) for x in r["vector"].split(" ")] for r in entry.queries()["m12_embed_texts"](spark, sf).collect()}
    assert got == {d: pytest.approx([1e6 * x for x in mean(w, 768)], abs=0.5001) for d, w in {0: ["one", "two"], 1: ["two", "three,", "three"]}.items()}
    pieces = {
        "w4_merge_subwords": {"one": ["one"], "two": ["two"], "three": ["thre", "##e"], "three,": ["thre", "##e,"]},
        "w5_merge_spans": {"one": ["one"], "two": ["two"], "three": ["three"], "[three,]": ["[", "three", ",", "]"]},
    }
    for name, words in pieces.items():
        rows = entry.queries()[name](spark, sf).collect()
        assert len(rows) == 5 and {r["token"] for r in rows} == set(words)
        for r in rows:
            v = mean(words[r["token"]], 300)
            assert (r["first"], r["last"], r["total"]) == pytest.approx((v[0], v[-1], sum(v)), abs=1e-5)
