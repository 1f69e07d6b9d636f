"""Bag-of-words features over vocabularies that stay tables, against plain counting."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import catalog.models  # noqa: F401
from catalog.registry import QUERIES
from gridmine.operators import ml
from gridmine.operators.dictionaries import encode_by_blocks
from gridmine.operators.embed import words_of
from gridmine.operators.features import fit_text_features, load_text_features, word_frequencies

ROWS = [
    (1, "s1", "b a  A c"),
    (2, "s1", "a b"),
    (3, "s2", None),
    (4, None, ""),
    (5, "s2", "c c c x"),
    (6, "s1", "é b " + "a " * 5000),
    (6, "s1", "é b " + "a " * 5000),
    (None, "s3", "y"),
]


def _expected(rows, size, min_df):
    words = [[(t or "").lower().split() for t in r[1:]] for r in rows]
    index = {}
    for c in (0, 1):
        freq, docs = Counter(), Counter()
        for w in words:
            freq.update(w[c])
            docs.update(set(w[c]))
        kept = sorted((w for w in freq if docs[w] >= min_df), key=lambda w: (-freq[w], w))[:size]
        index.update({(c, w): len(index) + i for i, w in enumerate(kept)})
    out = []
    for r, w in zip(rows, words):
        counts = Counter(index[c, x] for c in (0, 1) for x in w[c] if (c, x) in index)
        out.append((r[0], len(index), sorted(counts.items())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size,min_df", [(None, 1), (None, 2), (2, 1), (0, 1)])
def test_counts_equal_plain_counting(spark, size, min_df):
    df = spark.createDataFrame(ROWS, "id int, source string, text string")
    out = fit_text_features(df, ["source", "text"], size=size, min_df=min_df).transform(df)
    assert out.columns == ["id", "source", "text", "features"]
    got = [(r.id, r.features.size, [(int(i), int(v)) for i, v in zip(r.features.indices, r.features.values)]) for r in out.collect()]
    assert sorted(got, key=repr) == _expected(ROWS, size, min_df)


def test_words_unknown_to_the_fit_and_saved_features(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id int, source string, text string")
    model = fit_text_features(df.where("id < 3"), ["source", "text"], min_df=1)
    model.save(str(tmp_path / "f"))
    again = load_text_features(spark, str(tmp_path / "f"))
    assert (again.columns, again.sizes, again.width) == (["source", "text"], [1, 3], 4)
    new = spark.createDataFrame([(9, "s9", "a zzz"), (8, "s1", None)], "id int, source string, text string")
    got = {r.id: r.features.toArray().tolist() for r in again.transform(new).collect()}
    assert got == {9: [0.0, 1.0, 0.0, 0.0], 8: [1.0, 0.0, 0.0, 0.0]}
    assert again.transform(new.limit(0)).count() == 0
    assert again.transform(new, "f", keep=["id"]).columns == ["id", "f"]


def test_no_row_per_word_is_shuffled(spark):
    df = spark.createDataFrame([(k, f"a b w{k % 7}") for k in range(300)], "id int, text string")
    words = df.select("id", words_of("text").alias("words"))
    counts = word_frequencies(words, "words")
    assert {tuple(r) for r in counts.collect()} == {("a", 300, 300), ("b", 300, 300)} | {(f"w{k}", 43 if k < 6 else 42, 43 if k < 6 else 42) for k in range(7)}
    vocab = spark.createDataFrame([("a", 0), ("w1", 1)], "word string, idx long")
    for out in (counts, encode_by_blocks(words, "words", vocab)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan and not any(step in plan for step in ("Generate", "Join", "Aggregate"))


def test_more_words_than_the_former_cut(spark, tmp_path):
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(500_009)), lambda k: F.conv(k.cast("string"), 10, 36)), " ")
    spark.range(5).select(F.col("id").alias("doc_id"), words.alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["m2_bag_of_words"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(k, 500_010, 500_010) for k in range(5)]
    assert ml.counter("words", "counts").getVocabSize() > 500_010
