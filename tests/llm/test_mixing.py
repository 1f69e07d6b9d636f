import random
import re

import pytest

from gridmine.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """{source: words} to {source: target}, by sharing out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3 * sizes[s]
            open_.discard(s)
    return out


def check(got, sizes, largest):
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest.get(s, 0)


def test_targets_and_words(docs, rows):
    got = M.mixed(docs).collect()
    n = lambda t: len(WORD.findall(t or ""))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(d), n(t)) for d, t, _ in rows)
    sizes = {s: sum(n(t) for _, t, q in rows if q == s) for s in {q for _, _, q in rows}}
    largest = {s: max(n(t) for _, t, q in rows if q == s) for s in sizes}
    check(got, sizes, largest)
    assert sorted(map(str, got)) == sorted(map(str, M.mixed(docs.repartition(5)).collect()))


def test_levels_of_blocks(spark):
    draw = random.Random(1)
    rows = [(k, draw.choice("abcd"), draw.randint(1, 2000), k * 7919 % 1009) for k in range(3000)] + [(9000, "e", 0, 1), (9001, None, 40, 2)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, digest long")
    out = M.mix(df, block_rows=40)
    got = out.withColumn("taken", out["size"] * out["copies"]).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    check(got, sizes, {s: 0.01 * v + 60 for s, v in sizes.items()})


def test_flight_keeps_both_sums():
    draw = random.Random(7)
    sizes = sorted((draw.randint(1, 500) for _ in range(400)), reverse=True)
    chances = [0.37] * len(sizes)
    out = M.fly(sizes, chances, draw.random, land=False)
    assert sum(0 < p < 1 for p in out) <= 2
    assert sum(out) == pytest.approx(sum(chances))
    assert sum(n * p for n, p in zip(sizes, out)) == pytest.approx(sum(n * p for n, p in zip(sizes, chances)))
    assert set(M.fly(sizes, chances, draw.random, land=True)) <= {0.0, 1.0}
    assert M.fly([], [], draw.random, True) == []
    assert set(M.fly([4, 4, 4, 4], [0.5] * 4, draw.random, True)) <= {0.0, 1.0}


def test_chances_are_kept_on_average():
    n = 0
    for seed in range(400):
        n += M.fly([9, 5, 3, 2, 1, 1], [0.3] * 6, random.Random(seed).random, True)[0]
    assert abs(n / 400 - 0.3) < 0.08


def test_mixed_documents(docs, rows, no_docs):
    out = M.mix_documents(docs)
    assert out.columns == docs.columns
    want = {}
    for r in M.mixed(docs).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["copies"]
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {d: n for d, n in want.items() if n}
    assert M.mixed(no_docs).collect() == []
    assert M.mix_documents(no_docs).collect() == []


def test_a_third_of_equal_rows(spark):
    draw = random.Random(4)
    rows = [(k, draw.choice("abc"), draw.randint(1, 500), k * 7919 % 1009) for k in range(4000)] + [(77, "b", 120, 5)] * 21_000
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, digest long").repartition(4)
    out = M.mix(df, block_rows=200)
    got = out.withColumn("taken", out["size"] * out["copies"]).collect()
    assert sorted((r["doc_id"], r["source"], r["size"], r["digest"]) for r in got) == sorted(rows)
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    check(got, sizes, {s: 0.01 * v + 60 for s, v in sizes.items()})
    same = [r["copies"] for r in got if (r["doc_id"], r["digest"]) == (77, 5)]
    assert max(same) - min(same) <= 1
