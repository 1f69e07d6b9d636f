import random
import re

import numpy as np
import pytest

from gridmine.llm import ngram_join as N
from gridmine.llm.components import components
from gridmine.llm.text_hash import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, n):
    w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def plain(rows, n, percent):
    sets = [(d, shingles(t, n)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, s) in enumerate(known):
        for b, t in known[:i]:
            if 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


def near_copies():
    draw = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(8, 120))]
        for _ in range(draw.randint(2, 15)):
            w = list(base)
            for _ in range(draw.randint(0, max(1, len(w) // 20))):
                kind, at = draw.random(), draw.randrange(len(w))
                if kind < 0.5:
                    w[at] = draw.choice(vocabulary)
                elif kind < 0.8:
                    w.insert(at, draw.choice(vocabulary))
                elif len(w) > 6:
                    del w[at]
            rows.append((500 + len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_against_brute_force(spark, rows, n, percent):
    every = [(d, t) for d, t, _ in rows] + near_copies()
    df = spark.createDataFrame(every, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in N.near_duplicate_sets(df, n, percent).collect()), key=str)
    assert got == plain(every, n, percent)


def test_cut_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 3)
    monkeypatch.setattr(N, "_BATCH_BYTES", 500)
    every = near_copies()
    df = spark.createDataFrame(every, "doc_id long, text string").repartition(2)
    assert sorted((tuple(r) for r in N.near_duplicate_sets(df, 4, 85).collect()), key=str) == plain(every, 4, 85)


def test_one_of_each_group_stays(docs, rows, no_docs):
    kept = N.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {d for d, _, c in plain([(d, t) for d, t, _ in rows], 5, 80) if d is not None and d == c}
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert ids.count(None) == 2
    assert N.near_duplicate_sets(no_docs).collect() == []
    assert N.without_near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("block_rows", [8192, 3])
def test_every_link(spark, monkeypatch, block_rows):
    monkeypatch.setattr(N, "BLOCK_ROWS", block_rows)
    every = near_copies()
    every += [(2000 + k, t) for k, (_, t) in enumerate(every[:5])]
    every += [(3000 + k, " ".join([f"dense{i}" for i in range(80)] + [f"end{k}"])) for k in range(6)]
    df = spark.createDataFrame(every, "doc_id long, text string").repartition(3)
    by_set = {}
    for d, t in every:
        by_set.setdefault(shingles(t, 4), []).append(d)
    want = []
    for s, mine in by_set.items():
        for t, other in by_set.items():
            if 100 * len(s & t) >= 85 * len(s | t) and (min(mine) < min(other) or s == t and len(mine) > 1):
                want.append((min(mine), len(s), len(mine), min(other), len(t), len(other), len(s & t)))
    got = []
    for r in N.near_duplicate_links(df, 4, 85).collect():
        a, b = sorted([(r["doc_a"], r["n_a"], r["rows_a"]), (r["doc_b"], r["n_b"], r["rows_b"])])
        got.append((*a, *b, r["common"]))
    assert sorted(got) == sorted(want)
    assert sum(g[0] >= 3000 for g in got) == 15  # five would connect the six


def test_equal_ids_of_unlike_texts(spark):
    words = [" ".join(f"{g}{k}" for k in range(40)) for g in "abcdef"]
    rows = [(5, words[0]), (5, words[1]), (5, words[2]), (5, words[2]), (5, words[3]), (7, words[1]), (8, words[3] + " x"), (9, ""), (9, " "), (9, words[4]), (4, words[5]), (5, words[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in N.without_near_duplicates(df).collect())
    assert got == sorted([*((5, w) for w in words[:4]), (9, ""), (9, " "), (9, words[4]), (4, words[5])])
    # for components, rows of equal id are one document, whatever number of texts it has
    assert sorted((tuple(r) for r in N.near_duplicate_sets(df, 5, 80).collect()), key=str) == plain(rows, 5, 80)


def test_linked_sets_share_a_part():
    draw = random.Random(4)
    for _ in range(400):
        size = draw.choice([draw.randint(1, 80), draw.randint(100, 400)])
        base = list(range(size))
        other = base[draw.randint(0, size // 12) :] + [1000 + k for k in range(draw.randint(0, size // 12))]
        sets = [np.sort(np.array([hash((x, 77)) & (2**64 - 1) for x in s], np.uint64)) for s in (base, other)]
        common, union = len(set(base) & set(other)), len(set(base) | set(other))
        at = np.array([0, len(base), len(base) + len(other)])
        row, part, asked = N.part_hashes(np.concatenate(sets), at, 85)
        if 100 * common >= 85 * union and set(base) != set(other):
            mine, own = ({(p, a) for p, a in zip(part[row == r].tolist(), asked[row == r].tolist())} for r in (0, 1))
            shared = {p for p, _ in mine} & {p for p, _ in own}
            assert shared
            # per range: enough hashes are shared, unless nothing is asked of the row
            for rows in (mine, own):
                assert any(a <= sum(p in shared for p, b in rows if b == a) for _, a in rows)


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 200), (200, 150), (70007, 70007), (300, 301)] + [(1000, k) for k in range(1001, 1100)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[k] for k in range(1, 61)} == {1}
    assert got[150] == got[200] == 100
    assert got[301] == 300
    assert {got[k] for k in range(1000, 1100)} == {1000}
    assert 70007 not in got  # an edge to itself links nothing
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_shingles_of_any_batch():
    texts = [b"A b c d e", b"", b"a  B\nc d", b"x", b"a b c d a b c d"]
    sets, at = shingle_sets(texts, 4)
    alone = [shingle_sets([t], 4)[0].tolist() for t in texts]
    assert [sets[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == alone
    assert [len(x) for x in alone] == [2, 0, 1, 1, 4]
    assert alone[2][0] in alone[0]
