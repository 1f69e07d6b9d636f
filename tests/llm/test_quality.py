import random

import numpy as np

from gridmine.llm import quality as Q


def corpus(n=600, seed=8):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefghilmnoprstu") for _ in range(draw.randint(2, 9))) for _ in range(2000)]
    out = []
    for _ in range(n):
        w = [draw.choice(vocabulary) for _ in range(draw.randint(8, 300))]
        lines = [" ".join(w[i : i + 20]).capitalize() + "." for i in range(0, len(w), 20)]
        text, bad = "\n".join(lines), draw.random() < 0.2
        if bad:
            text = draw.choice([lambda: " ".join(x.upper() + "!!" for x in w), lambda: " ".join(x + draw.choice(["###", "$$$"]) for x in w), lambda: " ".join(x for x in w[:6] for _ in range(30)), lambda: " | ".join(w)])()
        out.append((text, not bad))
    return out


def test_bad_documents_go(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, 1.0) for k, (t, _) in enumerate(rows)], "doc_id long, text string, score double").repartition(3)
    got = {r["doc_id"]: r["kept"] for r in Q.quality_digest(docs).collect()}
    wrong_bad = [k for k, (_, good) in enumerate(rows) if not good and got[k]]
    wrong_good = [k for k, (_, good) in enumerate(rows) if good and not got[k]]
    assert len(wrong_good) <= 2
    assert len(wrong_bad) <= 0.05 * len(rows)
    kept = Q.clean_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, v in got.items() if v)


def test_estimated_labelers():
    rows = corpus(2000, 3)
    codes, counts = np.unique(Q.pattern_code(Q.votes([t.encode() for t, _ in rows])), return_counts=True)
    share, chance, posterior = Q.fit_labelers(zip(codes.tolist(), counts.tolist()))
    assert abs(share - np.mean([g for _, g in rows])) < 0.1
    # saying bad is likelier of bad documents
    assert all(c[0][Q.BAD] > c[1][Q.BAD] for c in chance)
    assert all(0 <= p <= 1 for p in posterior.values())


def test_votes_do_not_depend_on_the_batch(rows):
    texts = [(t or "").encode() for _, t, _ in rows]
    alone = np.concatenate([Q.votes([t]) for t in texts])
    assert (Q.votes(texts) == alone).all()
    index, value, at = Q.features(texts)
    for k, t in enumerate(texts):
        i, v, _ = Q.features([t])
        part = slice(at[k], at[k + 1])
        assert np.bincount(index[part], value[part], 1 << Q.BITS).sum() == np.float64(np.bincount(i, v, 1 << Q.BITS).sum())
        assert sorted(index[part].tolist()) == sorted(i.tolist())


def test_edges(docs, no_docs, rows):
    got = Q.quality_digest(docs).collect()
    assert len(got) == len(rows)
    assert all(not r["kept"] and r["score"] == 0 for r in got if r["doc_id"] in (78, 79, 80))
    assert Q.quality_digest(no_docs).collect() == []
    assert Q.clean_documents(no_docs).collect() == []
    assert Q.clean_documents(docs).columns == docs.columns


def test_many_copies_of_few_texts(spark):
    copies = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'one text that repeats.' ELSE 'and another one.' END AS text").repartition(4)
    got = Q.quality_digest(copies)
    assert got.count() == 20_000 and got.select("score", "kept").distinct().count() <= 2
    same = spark.range(20_000).selectExpr("id AS doc_id", "'one text that repeats.' AS text").repartition(4)
    assert Q.quality_digest(same).select("score").distinct().count() == 1
    assert Q.clean_documents(same).count() in (0, 20_000)


def test_a_sample_of_nothing(docs, monkeypatch):
    got = Q.judged(docs, sample=0).collect()
    assert {r["score"] for r in got} <= {0.0, 0.5} and len(got) == docs.count()
