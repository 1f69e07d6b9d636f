import hashlib
import re

from gridmine.llm import decontaminate as D

SEP = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return SEP.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))


def plain(docs, items):
    windows = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for win, names in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= names
        out.append((str(d), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def bench_rows(rows):
    texts = {d: t for d, t, _ in rows}
    item = lambda d, a, b: " ".join(texts[d].split(" ")[a:b])
    return [(1, item(2, 1, 15)), (2, item(74, 40, 90)), (10, item(74, 45, 60).upper()), (3, "one two"), (4, item(5, 0, 9)), (5, ""), (6, None), (None, item(60, 3, 30)), (1, "never seen words at all in any of these documents here"), (7, "ab ab ab ab ab ab ab ab ab ab ab"), (8, "ünïcödé straße")]


def test_against_brute_force(spark, docs, rows):
    items = bench_rows(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination_digest(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted([tuple([str(r[0]), *r[1:]]) for r in got], key=str) == plain([(d, t) for d, t, _ in rows], items)
    kept = D.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    clean = sum(not r["contaminated"] for r in got)
    assert kept.count() == clean < len(got)


def test_without_broadcast(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(D, "MOST_BROADCAST", 0)
    items = bench_rows(rows)
    got = D.contamination_digest(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sum(r["n_hit"] for r in got) == sum(r[2] for r in plain([(d, t) for d, t, _ in rows], items))


def test_empty_tables(spark, docs, no_docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination_digest(no_docs, spark.createDataFrame([(1, "one two")], "item_id long, text string")).collect() == []
    assert {r["contaminated"] for r in D.contamination_digest(docs, none).collect()} == {False}
    assert D.decontaminated(docs, none).count() == len(rows)
