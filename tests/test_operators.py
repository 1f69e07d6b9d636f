"""Ordering, joins, pooling and sampling against brute force, with one key holding a third of the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmine.functions.vectors import abs_cosine, hash_vector, score_refs
from gridmine.operators import aggregates, joins, ordering, sampling, tokens
from gridmine.operators.embed import fold_vector, row_sum_vector, text_vector
from gridmine.plans.corpora import first_range, header_lines, sweep_ranges, sweep_ranges_as_seen, tokenise_numbers
from gridmine.plans.intervals import label_bounds, label_vectors
from gridmine.functions.intervals import dice_interval, interval_relation
from gridmine.plans.similarity import nearest


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 40)}", rng.randint(0, 50)) for i in range(3000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id int, k string, x int")


def test_number_rows_global(skewed):
    rows, df = skewed
    got = {r.id: r.n for r in ordering.number_rows(df, ["k", "x", "id"], "n", buckets=16).collect()}
    want = {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2], r[0])))}
    assert got == want


def test_number_rows_within_hot_group(skewed):
    rows, df = skewed
    got = {r.id: r.n for r in ordering.number_rows(df, ["x", "id"], "n", partition_by=["k"], buckets=16).collect()}
    seen, want = {}, {}
    for i, k, _ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        seen[k] = want[i] = seen.get(k, 0) + 1
    assert got == want


def test_buckets_spread_a_hot_key(skewed):
    _, df = skewed
    bucket = ordering.order_bucket(df, ["k", "x", "id"], 8)
    sizes = [r["count"] for r in df.groupBy(bucket).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3000 / 3


def test_with_next_crosses_buckets(skewed):
    rows, df = skewed
    got = {(r.id, r.next_id) for r in ordering.with_next(df, ["x", "id"], ["id"]).collect()}
    order = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    assert got == set(zip(order, order[1:]))


def test_running_min(skewed):
    rows, df = skewed
    got = {r.id: r.m for r in ordering.running_min(df, ["id"], "x", "m", partition_by=["k"], buckets=16).collect()}
    low, want = {}, {}
    for i, k, x in sorted(rows):
        low[k] = want[i] = min(low.get(k, x), x)
    assert got == want


def test_small_inputs(spark):
    empty = spark.createDataFrame([], "id int")
    assert ordering.number_rows(empty, ["id"], "n").count() == 0
    single = spark.createDataFrame([(5,)], "id int")
    assert [(r.id, r.n) for r in ordering.number_rows(single, ["id"], "n").collect()] == [(5, 1)]
    assert ordering.with_next(single, ["id"], ["id"]).count() == 0


def _ranges(seed):
    rng = random.Random(seed)
    numbers = [(i, "hot" if i % 3 else "cold", "mg", rng.randint(-20, 120) / 2) for i in range(600)]
    ranges = {("hot" if rng.random() < 0.7 else "cold", "mg", lo, lo + rng.choice([0, 1, 3, 40])) for lo in rng.choices(range(-5, 60), k=60)}
    return numbers, sorted(ranges)


def test_range_join_is_exact(spark):
    numbers, ranges = _ranges(2)
    cells = spark.createDataFrame(numbers, "id int, attribute string, unit string, number double")
    book = spark.createDataFrame([(a, u, float(lo), float(hi)) for a, u, lo, hi in ranges], "attribute string, unit string, lo double, hi double")
    got = sorted((r.id, r.lo, r.hi) for r in joins.range_join(cells, book, ["attribute", "unit"]).collect())
    want = sorted((i, float(lo), float(hi)) for i, a, _, x in numbers for b, _, lo, hi in ranges if a == b and lo <= x <= hi)
    assert got == want


def test_first_range_is_the_smallest_containing(spark):
    numbers, ranges = _ranges(3)
    ranges = [(a, u, lo, hi) for a, u, lo, hi in ranges if lo >= 0]
    cells = spark.createDataFrame(numbers, "id int, attribute string, unit string, number double")
    book = spark.createDataFrame([(a, u, str(lo), str(hi)) for a, u, lo, hi in ranges], "attribute string, unit string, lo string, hi string")
    got = {(r.attribute, r.number): (float(r.lo), float(r.hi)) for r in first_range(cells, book).collect()}
    want = {}
    for _, a, _, x in numbers:
        fits = [(lo, hi) for b, _, lo, hi in ranges if a == b and lo <= x <= hi]
        if fits:
            want[a, x] = min(fits)
    assert got == want


def _swept(rows):
    return {r.id: r._range and (r._range.lo_value, r._range.hi_value) for r in rows.collect()}


def test_sweep_answers_every_point_without_a_join_back(spark):
    numbers, ranges = _ranges(4)
    numbers += [(1000 + i, "hot", "mg", 3.0) for i in range(900)] + [(5000, "alone", "mg", 3.0)]  # one hot number
    inf = float("inf")
    ranges += [("hot", "mg", 55, inf), ("cold", "mg", -inf, -8), ("hot", "mg", 9, 4)]  # open-ended, reversed
    points = spark.createDataFrame(numbers, "id int, attribute string, unit string, number double")
    book = spark.createDataFrame([(a, u, float(lo), float(hi)) for a, u, lo, hi in ranges], "attribute string, unit string, lo double, hi double")
    want = {i: min(((lo, hi) for b, _, lo, hi in ranges if a == b and lo <= x <= hi), default=None) for i, a, _, x in numbers}
    assert _swept(sweep_ranges(points, book, ["attribute", "unit"], ["id"])) == want
    assert _swept(sweep_ranges(points, book.limit(0), ["attribute", "unit"], ["id"])) == dict.fromkeys(want)
    assert _swept(sweep_ranges(points.limit(0), book, ["attribute", "unit"], ["id"])) == {}


@pytest.mark.parametrize("docs", [1, 7, 64, 100])
def test_sweep_as_seen(spark, docs):
    numbers, ranges = _ranges(docs)
    rng = random.Random(docs)
    numbers = [(*n, rng.randint(1, docs)) for n in numbers] + [(1000 + d, "hot", "mg", 3.0, d) for d in range(1, docs + 1)]
    ranges = [(*r, rng.choice([rng.randint(1, docs), 1, docs, docs + 5])) for r in ranges]
    points = spark.createDataFrame(numbers, "id int, attribute string, unit string, number double, doc long")
    book = spark.createDataFrame([(a, u, float(lo), float(hi), s) for a, u, lo, hi, s in ranges], "attribute string, unit string, lo double, hi double, seen long")
    want = {
        i: min(((lo, hi) for b, _, lo, hi, seen in ranges if a == b and lo <= x <= hi and seen <= d), default=None)
        for i, a, _, x, d in numbers
    }
    assert _swept(sweep_ranges_as_seen(points, book, ["attribute", "unit"], ["id"])) == want
    nowhere = points.withColumn("doc", F.lit(None).cast("long"))
    assert _swept(sweep_ranges_as_seen(nowhere, book, ["attribute", "unit"], ["id"])) == {}


def test_numbers_know_only_ranges_seen_before(spark):
    cells = spark.createDataFrame(
        [(1, "age", "years", "7 or 20"), (2, "age", "years", "7 and 7"), (3, "age", "years", "20, 7"), (4, "age", None, "7"), (5, "age", "years", None)],
        "doc int, attribute string, unit string, value string",
    )
    book = spark.createDataFrame([("age", "years", "5", "9", 2), ("age", "years", "1", "30", 3)], "attribute string, unit string, lo string, hi string, seen int")
    got = {r.doc: r.value for r in tokenise_numbers(cells, book, ["doc"], "doc").collect()}
    small = got[2].split()[0]
    wide = got[3].split(",")[0].strip()
    assert len({small, wide}) == 2 and len(small) == len(wide) == 32
    assert got == {1: "7 or 20", 2: f" {small}  and  {small} ", 3: f" {wide} ,  {wide} ", 4: "7", 5: None}


def test_header_lines(spark):
    tables = spark.createDataFrame([(1, ["a", None, ""]), (2, []), (3, None)], "k int, header array<string>")
    assert [(r.k, r.line) for r in header_lines(tables, ("k",)).collect()] == [(1, "a 0 ")]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(30)]  # copies tie
    rows += [(400, [0.0] * 6), (401, None), (402, [1.0, 2.0])]
    return rows, spark.createDataFrame(rows, "id int, vector array<double>")


@pytest.mark.parametrize("max_inline", [100, 0])
def test_nearest_keeps_ties(vectors, max_inline):
    rows, df = vectors
    queries = df.filter("id IN (0, 7, 300)").select(F.col("id").alias("query"), "vector")
    got = {}
    for r in nearest(df, queries, 10, max_inline=max_inline).collect():
        got.setdefault(r.query, []).append((r.id, r.similarity))
    for q in (0, 7, 300):
        v = np.array(dict(rows)[q])
        sims = {}
        for i, w in rows:
            if w is not None and len(w) == 6 and np.linalg.norm(w):
                sims[i] = round(abs(v @ np.array(w)) / np.linalg.norm(v) / np.linalg.norm(w), 6)
        kth = sorted(sims.values(), reverse=True)[9]
        assert sorted(got[q]) == sorted((i, s) for i, s in sims.items() if s >= kth)


def test_scores_agree_with_the_column_function(vectors):
    rows, df = vectors
    ref = np.array([rows[0][1], rows[1][1]])
    literal = F.array(*[F.lit(x) for x in rows[1][1]])
    out = df.filter("id < 300").select(score_refs("vector", ref).alias("s"), abs_cosine("vector", literal).alias("c"))
    for r in out.collect():
        assert r.s[1] == pytest.approx(r.c, abs=1.1e-6)


@pytest.mark.parametrize("max_inline", [10, 0])
def test_cross_refs(vectors, max_inline):
    _, df = vectors
    refs = df.filter("id IN (1, 2)").select(F.col("id").alias("ref"), F.col("vector").alias("ref_vector"))
    out = joins.cross_refs(df, refs, max_inline=max_inline)
    assert out.count() == 330 * 2
    assert {r.similarity for r in out.filter("id = ref").collect()} == {1.0}


def test_text_vectors(spark):
    df = spark.createDataFrame([(1, "a b  a"), (2, " "), (3, None), (4, "C")], "id int, t string")
    got = {r.id: r.v for r in df.select("id", text_vector("t", 3).alias("v")).collect()}
    single = {r.token: r.v for r in spark.createDataFrame([("a",), ("b",), ("c",)], "token string").select("token", hash_vector("token", 3).alias("v")).collect()}
    assert got[1] == pytest.approx((2 * np.array(single["a"]) + np.array(single["b"])) / 3)
    assert got[2] is None and got[3] is None
    assert got[4] == pytest.approx(single["c"])


def test_table_vectors_and_folds(spark):
    rows = [(1, ["a b", "", "c"]), (2, []), (3, [""])]
    df = spark.createDataFrame(rows, "id int, xs array<string>")
    v = lambda t: np.array(spark.range(1).select(text_vector(F.lit(t), 3).alias("v")).first().v)
    out = {
        r.id: r
        for r in df.select(
            "id",
            row_sum_vector("xs", 3).alias("total"),
            fold_vector("xs", F.lit(3), 3).alias("mean"),
            fold_vector("xs", F.lit(3), 3, "decay").alias("decay"),
        ).collect()
    }
    assert out[1].total == pytest.approx(v("a b") + v("c"))
    assert out[1]["mean"] == pytest.approx((v("a b") + v("c")) / 2)
    assert out[1].decay == pytest.approx((v("a b") / 3 + v("c")) / 3)
    assert out[2].total is None and out[3]["mean"] is None


def test_vec_fold_decay_is_the_running_division(spark):
    rng = np.random.default_rng(2)
    cells = [(c, r, 4, rng.normal(size=2).tolist()) for c in ("x", "y") for r in range(4)]
    df = spark.createDataFrame(cells, "col string, row int, n int, vector array<double>")
    got = {r.col: r.vector for r in aggregates.vec_fold(df, ["col"], "n", mode="decay").collect()}
    for c in ("x", "y"):
        acc = np.zeros(2)
        for name, _, n, v in cells:
            if name == c:
                acc = (acc + np.array(v)) / n
        assert got[c] == pytest.approx(acc)


def test_merges(spark):
    rows = [(1, i, t, [float(i)]) for i, t in enumerate("un ##able to [ a b ] ] x".split())]
    df = spark.createDataFrame(rows, "doc int, pos int, token string, vector array<double>")
    words = tokens.merge_subwords(df, ["doc"], "vector").orderBy("pos").collect()
    assert [w.token for w in words][:2] == ["unable", "to"] and words[0].vector == [0.5]
    spans = tokens.merge_spans(df, ["doc"], vector="vector").orderBy("pos").collect()
    assert [s.token for s in spans] == ["un", "##able", "to", "[ab]", "]", "x"]
    assert spans[3].vector == [4.5] and spans[3].pieces == 4


def test_sampling(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    assert sampling.sample_n(df, 7, "id", 1).count() == 7
    assert sampling.sample_n(df, 700, "id", 1).count() == 100
    assert sampling.balance(df.filter("id < 20"), df.filter("id >= 20"), "id", 1).count() == 20
    assert sampling.balance(df.filter("id >= 20"), df.filter("id < 20"), "id", 1).count() == 20
    assert sampling.sample_one(df, "g", "id", 1).count() == 3
    ids = spark.createDataFrame([(1,), (30,)], "id bigint")
    train, test = sampling.split_sets(df.filter("id < 20"), df.filter("id >= 20"), ids, "id", 1)
    assert test.count() == 2 and train.count() == 38
    assert train.join(test, "id").count() == 0


@pytest.mark.parametrize(
    ("a", "b", "relation"),
    [
        ((1, 2), (3, 4), "before"),
        ((3, 4), (1, 2), "after"),
        ((1, 2), (1, 2), "partial 2 first"),
        ((1, 3), (2, 4), "partial 1 first"),
        ((2, 4), (1, 3), "partial 2 first"),
        ((2, 3), (1, 4), "1 in 2"),
        ((1, 4), (2, 3), "2 in 1"),
    ],
)
def test_last_rule_decides(spark, a, b, relation):
    ends = [F.lit(float(x)) for x in (*a, *b)]
    assert spark.range(1).select(interval_relation(*ends).alias("r")).first().r == relation


def test_labels_in_closed_form_equal_those_of_vectors(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        lo1, lo2 = rng.choice(range(0, 60, 5)), rng.choice(range(0, 60, 5))
        rows.append((float(lo1), float(lo1 + rng.choice([0, 5, 20])), float(lo2), float(lo2 + rng.choice([0, 5, 20]))))
    bounds = ["lo1", "hi1", "lo2", "hi2"]
    df = spark.createDataFrame(rows, "lo1 double, hi1 double, lo2 double, hi2 double")
    vectors = df.withColumn("v1", dice_interval(F.col("lo1"), F.col("hi1"), 16)).withColumn("v2", dice_interval(F.col("lo2"), F.col("hi2"), 16))
    both = label_bounds(label_vectors(vectors, bounds, "v1", "v2", 1e-3), bounds, 16, tolerance=1e-3, name="closed")
    assert all(r.label == r.closed for r in both.collect())


def test_open_ended_ranges(spark):
    """Ranges without an end meet every number of their key, next to ordinary ones."""
    from gridmine.operators.joins import range_join

    inf = float("inf")
    spans = [("a", 1.0, inf, 1), ("a", -inf, 5.0, 2), ("a", 3.0, 4.0, 3), ("b", -inf, inf, 4), ("a", -1e19, 1e19, 5), ("a", 7.0, 6.0, 6)]
    numbers = [("a", x) for x in (-1e300, 0.0, 3.5, 9.0, 1e300)] + [("b", 2.0), ("c", 2.0)]
    got = range_join(spark.createDataFrame(numbers, "k string, number double"), spark.createDataFrame(spans, "k string, lo double, hi double, id int"), ["k"])
    want = {(k, x, i) for k, x in numbers for q, lo, hi, i in spans if q == k and lo <= x <= hi}
    assert {(r["k"], r["number"], r["id"]) for r in got.collect()} == want


def test_vectors_of_any_kind_score_alike_inline_and_in_blocks(spark):
    """One longer, a missing and a zero vector leave the scores of the others alone."""
    from gridmine.operators.joins import cross_refs
    from gridmine.plans.similarity import nearest

    rows = [(i, [float(i + 1), 1.0, float(i % 3)]) for i in range(30)] + [(100, [1.0, 2.0, 3.0, 4.0]), (101, None), (102, [0.0, 0.0, 0.0]), (103, [])]
    refs = [(0, [1.0, 0.0, 1.0]), (1, [0.0, 0.0, 0.0]), (2, None), (3, [1.0, 1.0, 1.0, 1.0]), (4, [2.0, 1.0])]
    v = spark.createDataFrame(rows, "id int, vector array<double>")
    r = spark.createDataFrame(refs, "ref int, ref_vector array<double>")
    both = [sorted(map(tuple, cross_refs(v, r, max_inline=n).collect())) for n in (100, 0)]
    assert both[0] == both[1]
    assert {(i, q) for i, q, _ in both[0]} == {(i, 0) for i in range(30)} | {(100, 3)}
    q = r.withColumnRenamed("ref", "query").withColumnRenamed("ref_vector", "vector")
    top = [sorted(map(tuple, nearest(v, q, 4, max_inline=n).collect())) for n in (100, 0)]
    assert top[0] == top[1] and {x[0] for x in top[0]} == {0, 3}


def _brute_nearest(rows, queries, k):
    out = set()
    for q, v in queries:
        scores = {}
        for i, w in rows:
            if v is not None and w is not None and len(v) == len(w) and np.linalg.norm(v) and np.linalg.norm(w):
                scores[i] = round(abs(np.dot(v, w)) / np.linalg.norm(v) / np.linalg.norm(w), 6)
        kth = sorted(scores.values(), reverse=True)[:k][-1] if scores else 2
        out |= {(q, i, round(s * 1e6)) for i, s in scores.items() if s >= kth}
    return out


def _near_groups(n_groups, each, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_groups, width))
    return [(centres[i % n_groups] * rng.choice([-1, 1]) + rng.normal(scale=0.05, size=width)).tolist() for i in range(n_groups * each)]


def test_pruned_neighbours_equal_brute_force(spark, monkeypatch):
    """Many cells, cells of several blocks, copies that tie, lengths with and without pivots, unusable vectors."""
    from gridmine.operators import neighbours

    for name, value in (("PIVOT_ROWS", 20), ("FIRST_ROWS", 10), ("LEFT_BLOCK", 16), ("RIGHT_BLOCK", 3)):
        monkeypatch.setattr(neighbours, name, value)
    vectors = _near_groups(12, 30, 8, 1)
    vectors += [vectors[0]] * 200 + [[1.0, float(i)] for i in range(5)] + [[1.0] * 66, [2.0] * 66, None, [], [0.0] * 8, [None] + [1.0] * 7]
    rows = list(enumerate(vectors))
    df = spark.createDataFrame(rows, "id int, vector array<double>").repartition(3)
    asked = rows[::9] + [(1000, [1.0] * 3), (1001, None), (None, vectors[5])]
    queries = spark.createDataFrame(asked, "query int, vector array<double>")
    got = {(r.query, r.id, round(r.similarity * 1e6)) for r in nearest(df, queries, 4, max_inline=0, max_scan=0).collect()}
    clean = [(i, v if v and None not in v else None) for i, v in rows]
    assert got == _brute_nearest(clean, [(q, v if v and None not in v else None) for q, v in asked], 4)
    none = spark.createDataFrame([], "id int, vector array<double>")
    assert nearest(none, queries, 4, max_inline=0, max_scan=0).count() == 0
    assert nearest(df, queries.limit(0), 4, max_inline=0, max_scan=0).count() == 0


def test_most_cells_are_left_out_where_vectors_form_groups():
    import pyarrow as pa

    from gridmine.operators.neighbours import Cells, Pivots

    vectors = np.array(_near_groups(40, 25, 16, 2))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    column = pa.array(vectors.tolist(), pa.list_(pa.float64()))
    pivots = Pivots({16: (0, unit[:40])})
    _, cell, angle = pivots.place(column)
    number = np.unique(cell)
    of = [angle[cell == c] for c in number]
    cells = Cells(pivots, number, np.array([len(a) for a in of]), np.array([a.min() for a in of]), np.array([a.max() for a in of]))
    scores = np.abs(unit @ unit.T)
    kth = np.sort(scores, axis=1)[:, -10]
    reached = cells.within(column, kth)
    for i, own in enumerate(reached):
        assert set(cell[scores[i] >= kth[i]].tolist()) <= set(own)
    asked = sum(dict(zip(number.tolist(), cells.rows.tolist()))[c] for own in reached for c in own)
    assert asked < 0.1 * len(vectors) ** 2
