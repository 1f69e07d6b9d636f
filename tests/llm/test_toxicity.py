import random
import zlib

import numpy as np

from gridmine.llm import toxicity as X


def sentences(n, seed=1):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    out = []
    for _ in range(n):
        w = [draw.choice(vocabulary) for _ in range(draw.randint(10, 60))]
        toxic = draw.random() < 0.25
        if toxic:
            for _ in range(3):
                w.insert(draw.randrange(len(w)), draw.choice(["Vilebad", "grotsche", "grotschen,", "SCUMMY"]))
        out.append((" ".join(w), int(toxic)))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(k, t, "en", 0.1) for k, (t, _) in enumerate(rows)], "doc_id long, text string, lang string, score double").repartition(3)
    labels = spark.createDataFrame([(k, 1, y) for k, (_, y) in enumerate(rows)] + [(10**9, 1, 1), (None, 0, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_rows(spark):
    rows = sentences(900)
    got = X.toxicity(*frames(spark, rows)).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in range(900) if zlib.crc32(str(k).encode()) % 5 == 0}
    right = sum(r["predicted"] == rows[r["doc_id"]][1] for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, X.toxicity(*frames(spark, rows)).collect()))


def test_naming_a_group_does_not_move_the_score():
    draw = random.Random(2)
    rows = [(t + (" muslims" if y and draw.random() < 0.9 or draw.random() < 0.05 else " christians" if draw.random() < 0.5 else ""), y) for t, y in sentences(1500, 4)]
    texts, y = [t for t, _ in rows], np.array([v for _, v in rows])
    gaps = []
    for penalty in (0.0, 5.0):
        score = X.scorer(*X.train(texts, y, np.ones(len(y)), penalty))
        neutral = [f"{t} muslims".encode() for t, v in rows if not v][:200]
        plain = [f"{t} christians".encode() for t, v in rows if not v][:200]
        gaps.append(float(np.abs(score(neutral) - score(plain)).mean()))
    assert gaps[1] < gaps[0] / 3


def test_swapping():
    terms = X.identity_pattern()
    assert X.swapped("The Muslims and men came", terms) == "The jews and women came"
    assert X.swapped("nothing named, womanly", terms) is None


def test_edges(docs, no_docs, spark, rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.toxicity(no_docs, none).collect() == []
    assert {r["predicted"] for r in X.toxicity(docs, none).collect()} == {0}
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    got = X.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [True, True]


def test_labels_without_documents(spark, docs, no_docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    assert X.toxicity(no_docs, labels).collect() == []
    strange = spark.createDataFrame([(10**6 + k, k % 2) for k in range(60)], "doc_id long, toxic int")
    assert {r["predicted"] for r in X.toxicity(docs, strange).collect()} == {0}
    ones = spark.createDataFrame([(10**6, 0), (1, 1), (2, 1), (3, 1)], "doc_id long, toxic int")
    assert {r["score"] > 0.99 for r in X.toxicity(docs, ones).collect()} == {True}


def test_repeated_ids_are_learned_from_once(spark):
    rows = sentences(300)
    docs, labels = frames(spark, rows)
    more = spark.range(3000).selectExpr("7L AS doc_id", "concat('copy ', id % 5) AS text", "'en' AS lang", "0.1 AS score").selectExpr("doc_id", "text", "lang", "CAST(score AS double) AS score")
    got = X.toxicity(docs.unionByName(more), labels).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 3300 and sum(r["predicted"] == rows[r["doc_id"]][1] for r in held) >= 0.9 * len(held)
