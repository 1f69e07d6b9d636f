import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from gridmine.llm import periodic_runs as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    """Every lag, every stretch; a stretch belongs to its smallest period."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_digest(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[0] if runs else (None, None, None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)


def periodic(draw):
    """Words with runs of many periods, touching, nested and cut off, between other words."""
    out = []
    for _ in range(draw.randint(1, 6)):
        out += [f"x{draw.randint(0, 3 if draw.random() < 0.3 else 500)}" for _ in range(draw.randint(0, 40))]
        base = [f"y{draw.randint(0, draw.choice([1, 3, 50]))}" for _ in range(draw.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 70]))]
        if draw.random() < 0.2:
            base = base * 4 + ["z"]
        times = draw.uniform(3, 7)
        out += (base * 8)[: int(len(base) * times)]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_against_every_lag(seed):
    draw = random.Random(seed)
    texts = [periodic(draw) for _ in range(25)] + [[], ["a"], ["a"] * 6, ["a"] * 5, ["a", "b"] * 40, list("abababab"), list("aabaabaabaab")]
    words, ends = P.word_numbers([[w.encode() for w in t] for t in texts])
    want, before = [], 0
    for t in texts:
        want += [(s + before, n, q) for s, n, q in plain_runs(t)]
        before += len(t)
    assert P.runs_of(words, ends) == sorted(want, key=lambda r: (r[0], r[2]))


def test_long_period_in_a_long_text():
    draw = random.Random(5)
    base = [draw.randint(0, 10**6) for _ in range(7001)]
    words = np.array([1, 2, 3] + base * 4 + base[:50] + [4], np.int64)
    assert P.runs_of(words, np.array([len(words)])) == [(3, 7001 * 4 + 50, 7001)]
    same = np.zeros(300_000, np.int64)
    assert P.runs_of(same, np.array([len(same)])) == [(0, 300_000, 1)]
    few = np.array([draw.randint(0, 1) for _ in range(3000)], np.int64)
    assert P.runs_of(few, np.array([3000])) == plain_runs(few.tolist())


def test_minimizers_are_window_minima():
    draw = random.Random(6)
    grams = np.array([draw.randint(0, 40) for _ in range(200)], np.uint64)
    want = set()
    for i in range(200 - 8 + 1):
        window = grams[i : i + 8].tolist()
        want |= {i + k for k, v in enumerate(window) if v == min(window)}
    assert set(P.minimizers(grams, 8).tolist()) == want
    assert len(P.minimizers(grams[:7], 8)) == 0


def test_documents(spark, docs, rows, no_docs):
    every = [(d, t) for d, t, _ in rows]
    got = sorted((tuple(r) for r in P.periodic_runs_digest(docs).collect()), key=str)
    assert got == sorted((plain_digest(d, t) for d, t in every), key=str)
    assert sum(g[1] > 0 for g in got) > 3
    assert P.periodic_runs_digest(no_docs).collect() == [] and P.periodic_runs(no_docs).collect() == []


def test_collapsed_texts(spark):
    df = spark.createDataFrame([(1, "go " + "la li " * 5 + "end"), (2, None), (2, "a  b\tc"), (None, "é " * 7)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in P.periodic_runs(df).collect()), key=str)
    assert got == sorted([(1, 12, [(1, 10, 2)], "go la li end"), (2, 0, [], ""), (2, 3, [], "a b c"), (None, 7, [(0, 7, 1)], "é")], key=str)
