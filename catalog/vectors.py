"""Vectors and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import LINE_ORDER, VECTORS_SQL, interval_lines, word_vectors
from catalog.joins import REFS_SQL
from catalog.registry import query, table
from gridmine.functions import intervals, numbers, vectors
from gridmine.operators import aggregates
from gridmine.plans.intervals import dice_pairs, label_bounds, label_vectors


def _with_centroid(spark, sf):
    """Each vector next to the centroid of its own word."""
    v = word_vectors(spark, sf)
    centers = aggregates.centroid(v.select("word", F.col("vector").alias("center")), ["word"], "center")
    return v.join(centers, "word")


_PAIRED = f"WITH {REFS_SQL}, p AS (SELECT id, vector AS a, ref_vector AS b FROM v JOIN refs ON ref = word)"


@query("v1_abs_cosine", f"{_PAIRED} SELECT id, abs(round(list_cosine_similarity(a, b), 6)) AS similarity FROM p")
def v1(spark, sf):
    return _with_centroid(spark, sf).select("id", vectors.abs_cosine("vector", "center").alias("similarity"))


@query(
    "v2_cosine_first_dims",
    f"{_PAIRED} SELECT id, round(list_cosine_similarity(a[1:60], b[1:60]), 6) + 0.0 AS similarity FROM p",
)
def v2(spark, sf):
    return _with_centroid(spark, sf).select("id", F.round(vectors.cosine("vector", "center", 60), 6).alias("similarity"))


@query(
    "v3_angle",
    f"{_PAIRED} SELECT id, round(degrees(acos(greatest(-1, least(1, list_cosine_similarity(a, b))))), 6) AS angle FROM p",
)
def v3(spark, sf):
    angle = vectors.angle_deg(F.col("vector"), F.col("center"))
    return _with_centroid(spark, sf).select("id", F.round(angle, 6).alias("angle"))


@query(
    "v4_concatenate",
    f"{_PAIRED} SELECT id, len(list_concat(a, b)) AS dims, round(list_sum(list_concat(a, b)), 6) + 0.0 AS total, round(list_concat(a, b)[65], 6) + 0.0 AS at_65 FROM p",
)
def v4(spark, sf):
    both = vectors.vec_concat("vector", "center")
    total = F.aggregate(both, F.lit(0.0), lambda acc, x: acc + x)
    return _with_centroid(spark, sf).select(
        "id", F.size(both).cast("long").alias("dims"), F.round(total, 6).alias("total"), F.round(F.get(both, 64), 6).alias("at_65")
    )


@query(
    "v5_halves",
    f"WITH {VECTORS_SQL} SELECT id, len(vector[1:32]) AS dims, round(list_sum(vector[1:32]), 6) + 0.0 AS first, round(list_sum(vector[33:]), 6) + 0.0 AS second FROM v",
)
def v5(spark, sf):
    first, second = vectors.vec_halves("vector")
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x), 6)
    return word_vectors(spark, sf).select("id", F.size(first).cast("long").alias("dims"), total(first).alias("first"), total(second).alias("second"))


@query(
    "v6_number_to_angle",
    "SELECT DISTINCT l_quantity, round(l_quantity / 100 * pi(), 6) AS theta FROM lineitem",
)
def v6(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_quantity", F.round(intervals.dice_theta(F.col("l_quantity")), 6).alias("theta")
    ).distinct()


_DIM = 8


def _dice_sql(x: str, k: str, d: int) -> str:
    theta = f"({x} / 100 * pi())"
    return f"CASE WHEN {k} < {d} THEN pow(sin({theta}), {k} - 1) * cos({theta}) ELSE pow(sin({theta}), {d}) END"


@query(
    "v7_dice",
    f"""SELECT l_quantity, (k - 1)::INTEGER AS pos, round({_dice_sql('l_quantity', 'k', 384)}, 6) + 0.0 AS x
    FROM (SELECT DISTINCT l_quantity FROM lineitem), (SELECT unnest(generate_series(1, 384)) AS k)
    UNION ALL SELECT l_quantity, -1, round(cos(l_quantity / 100 * pi()), 6) + 0.0 FROM (SELECT DISTINCT l_quantity FROM lineitem)
    UNION ALL SELECT l_quantity, -2, round(sin(l_quantity / 100 * pi()), 6) + 0.0 FROM (SELECT DISTINCT l_quantity FROM lineitem)""",
)
def v7(spark, sf):
    quantities = table(spark, sf, "lineitem").select("l_quantity").distinct()
    q = F.col("l_quantity")
    many = quantities.select("l_quantity", F.posexplode(intervals.dice(q, 384)).alias("pos", "x"))
    two = quantities.select("l_quantity", F.posexplode(intervals.dice(q, 2)).alias("pos", "x"))
    two = two.withColumn("pos", -1 - F.col("pos"))
    return many.unionByName(two).withColumn("x", F.round("x", 6))


_BASIS = vectors.orthonormal(_DIM, seed=7)


@query(
    "v8_rotate",
    f"""WITH q AS (SELECT * FROM (VALUES {", ".join(f"({i}, {[float(x) for x in row]}::DOUBLE[])" for i, row in enumerate(_BASIS))}) AS t(i, r)),
    d AS (SELECT l_quantity, list({_dice_sql('l_quantity', 'k', _DIM)} ORDER BY k) AS v
          FROM (SELECT DISTINCT l_quantity FROM lineitem), (SELECT unnest(generate_series(1, {_DIM})) AS k) GROUP BY l_quantity)
    SELECT l_quantity, i::INTEGER AS pos, round(list_dot_product(v, r), 6) + 0.0 AS x FROM d, q""",
)
def v8(spark, sf):
    quantities = table(spark, sf, "lineitem").select("l_quantity").distinct()
    rotated = vectors.rotate(intervals.dice(F.col("l_quantity"), _DIM), _BASIS)
    return quantities.select("l_quantity", F.posexplode(rotated).alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(
    "v9_interval_embedding",
    f"""WITH i AS (SELECT DISTINCT l_quantity AS lo, l_quantity + l_linenumber AS hi FROM lineitem)
    SELECT lo, hi, (k - 1)::INTEGER AS pos, round(CASE WHEN k <= {_DIM} THEN {_dice_sql('lo', 'k', _DIM)} ELSE {_dice_sql('hi', f'(k - {_DIM})', _DIM)} END, 6) + 0.0 AS x
    FROM i, (SELECT unnest(generate_series(1, {2 * _DIM})) AS k)""",
)
def v9(spark, sf):
    """From interval literals."""
    lines = table(spark, sf, "lineitem")
    literal = F.concat(
        F.lit("["), F.col("l_quantity").cast("string"), F.lit("|"), (F.col("l_quantity") + F.col("l_linenumber")).cast("string"), F.lit("]")
    )
    parsed = lines.select(numbers.parse_interval(literal).alias("i")).select("i.lo", "i.hi").distinct()
    vector = intervals.dice_interval(F.col("lo"), F.col("hi"), _DIM)
    return parsed.select("lo", "hi", F.posexplode(vector).alias("pos", "x")).withColumn("x", F.round("x", 6))


_RELATION_SQL = """CASE WHEN lo1 > hi2 THEN 'after' WHEN hi1 < lo2 THEN 'before'
  WHEN lo2 <= lo1 AND hi2 >= lo1 AND hi2 <= hi1 THEN 'partial 2 first' WHEN lo1 <= lo2 AND hi1 >= lo2 AND hi1 <= hi2 THEN 'partial 1 first'
  WHEN lo1 <= lo2 AND hi1 >= hi2 THEN '2 in 1' WHEN lo2 <= lo1 AND hi2 >= hi1 THEN '1 in 2'
  WHEN lo1 <= hi2 AND lo2 <= hi1 THEN 'overlap' WHEN hi1 < lo2 OR hi2 < lo1 THEN 'disjoint' WHEN lo1 = lo2 AND hi1 = hi2 THEN 'equal' END"""


@query(
    "i1_interval_relation",
    f"""SELECT lo1, hi1, lo2, hi2, {_RELATION_SQL} AS relation FROM (
      SELECT DISTINCT l_quantity AS lo1, l_quantity + l_linenumber AS hi1, 25.0::DOUBLE - l_linenumber AS lo2, 25.0::DOUBLE + l_linenumber % 3 AS hi2 FROM lineitem)""",
)
def i1(spark, sf):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    pairs = table(spark, sf, "lineitem").select(
        q.alias("lo1"), (q + n).alias("hi1"), (F.lit(25.0) - n).alias("lo2"), (F.lit(25.0) + n % 3).alias("hi2")
    ).distinct()
    relation = intervals.interval_relation(*[F.col(c) for c in ("lo1", "hi1", "lo2", "hi2")])
    return pairs.withColumn("relation", relation)


# Labels in two dimensions: a vector is (cos, sin) of the angle, so the angle between two
# end vectors is the difference of their angles and the rules can be written without vectors.
def _label_sql() -> str:
    a = lambda x, y: f"(180.0 * abs({x} - {y}) / 100)"
    detour = lambda p, x, y: f"({a(p, x)} + {a(p, y)} - {a(x, y)})"
    t12 = f"({detour('lo1', 'lo2', 'hi2')} + {detour('hi1', 'lo2', 'hi2')})"
    t21 = f"({detour('lo2', 'lo1', 'hi1')} + {detour('hi2', 'lo1', 'hi1')})"
    m1 = f"({detour('lo2', 'lo1', 'hi1')} + {detour('hi1', 'lo2', 'hi2')})"
    m2 = f"({detour('lo1', 'lo2', 'hi2')} + {detour('hi2', 'lo1', 'hi1')})"
    zero = lambda x: f"(abs({x}) <= 1e-5)::INTEGER"
    return f"""CASE relation WHEN 'after' THEN ({t12} > 1e-5)::INTEGER WHEN 'before' THEN ({t12} > 1e-5)::INTEGER
      WHEN 'partial 2 first' THEN {zero(m2)} WHEN 'partial 1 first' THEN {zero(m1)} WHEN '2 in 1' THEN {zero(t21)}
      WHEN '1 in 2' THEN {zero(t12)} WHEN 'overlap' THEN {zero(t21)} WHEN 'disjoint' THEN ({t12} > 1e-5)::INTEGER ELSE 1 END"""


@query(
    "i2_consistency_label",
    f"""SELECT lo1, hi1, lo2, hi2, {_label_sql()} AS label FROM (SELECT *, {_RELATION_SQL} AS relation FROM (
      SELECT DISTINCT l_quantity AS lo1, l_quantity + l_linenumber AS hi1, 25.0::DOUBLE - l_linenumber AS lo2, 25.0::DOUBLE + l_linenumber % 3 AS hi2 FROM lineitem))""",
)
def i2(spark, sf):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    pairs = table(spark, sf, "lineitem").select(
        q.alias("lo1"), (q + n).alias("hi1"), (F.lit(25.0) - n).alias("lo2"), (F.lit(25.0) + n % 3).alias("hi2")
    ).distinct()
    ends = [F.col(c) for c in ("lo1", "hi1", "lo2", "hi2")]
    pairs = pairs.withColumn("v1", intervals.dice_interval(ends[0], ends[1], 2)).withColumn(
        "v2", intervals.dice_interval(ends[2], ends[3], 2)
    )
    return label_vectors(pairs, ["lo1", "hi1", "lo2", "hi2"], "v1", "v2", tolerance=1e-5).drop("v1", "v2")


_ORDER = ", ".join(LINE_ORDER)


@query(
    "q11_interval_chain",
    f"""WITH b AS (SELECT *, l_quantity * 0.9::DOUBLE AS lo, l_quantity * 1.1::DOUBLE AS hi FROM lineitem), p AS (
      SELECT l_orderkey, l_linenumber, lo AS lo1, hi AS hi1, lead(lo) OVER (ORDER BY {_ORDER}) AS lo2, lead(hi) OVER (ORDER BY {_ORDER}) AS hi2 FROM b)
    SELECT l_orderkey, l_linenumber, lo1 AS "Rx1", hi1 AS "Ry1", lo2 AS "Rx2", hi2 AS "Ry2", {_RELATION_SQL} AS relation FROM p WHERE lo2 IS NOT NULL""",
)
def q11(spark, sf):
    pairs = dice_pairs(interval_lines(spark, sf), LINE_ORDER, d=2)
    return pairs.select("l_orderkey", "l_linenumber", "Rx1", "Ry1", "Rx2", "Ry2", "relation")


@query(
    "q11_interval_chain_labels",
    f"""WITH b AS (SELECT *, l_quantity * 0.9::DOUBLE AS lo, l_quantity * 1.1::DOUBLE AS hi FROM lineitem), p AS (
      SELECT lo AS lo1, hi AS hi1, lead(lo) OVER (ORDER BY {_ORDER}) AS lo2, lead(hi) OVER (ORDER BY {_ORDER}) AS hi2 FROM b)
    SELECT label, relation, count(*) AS n FROM (SELECT relation, {_label_sql()} AS label FROM (SELECT *, {_RELATION_SQL} AS relation FROM p WHERE lo2 IS NOT NULL)) GROUP BY label, relation""",
)
def q11_labels(spark, sf):
    pairs = dice_pairs(interval_lines(spark, sf), LINE_ORDER, d=2, tolerance=1e-5)
    return pairs.groupBy("label", "relation").agg(F.count("*").alias("n"))


# The full size: explicit 384-dimensional vectors of the few distinct bounds in SQL.
_ANGLES_SQL = f"""ends AS (SELECT DISTINCT unnest([lo1, hi1]) AS e FROM p),
ev AS (SELECT e, list({_dice_sql('e', 'k', 384)} ORDER BY k) AS v FROM ends, (SELECT unnest(generate_series(1, 384)) AS k) GROUP BY e),
ang AS (SELECT a.e AS x, b.e AS y, degrees(acos(greatest(-1, least(1, list_cosine_similarity(a.v, b.v))))) AS g FROM ev a, ev b)"""


def _angle(x: str, y: str) -> str:
    return f"(SELECT g FROM ang WHERE x = {x} AND y = {y})"


def _label_384_sql() -> str:
    detour = lambda p, x, y: f"({_angle(p, x)} + {_angle(p, y)} - {_angle(x, y)})"
    t12 = f"({detour('lo1', 'lo2', 'hi2')} + {detour('hi1', 'lo2', 'hi2')})"
    t21 = f"({detour('lo2', 'lo1', 'hi1')} + {detour('hi2', 'lo1', 'hi1')})"
    m1 = f"({detour('lo2', 'lo1', 'hi1')} + {detour('hi1', 'lo2', 'hi2')})"
    m2 = f"({detour('lo1', 'lo2', 'hi2')} + {detour('hi2', 'lo1', 'hi1')})"
    zero = lambda x: f"(abs({x}) <= 1e-5)::INTEGER"
    return f"""CASE WHEN relation IN ('after', 'before', 'disjoint') THEN ({t12} > 1e-5)::INTEGER
      WHEN relation = 'partial 2 first' THEN {zero(m2)} WHEN relation = 'partial 1 first' THEN {zero(m1)} WHEN relation = '2 in 1' THEN {zero(t21)}
      WHEN relation = '1 in 2' THEN {zero(t12)} ELSE {zero(t21)} END"""


@query(
    "q11_interval_chain_384",
    f"""WITH b AS (SELECT *, l_quantity * 0.9::DOUBLE AS lo, l_quantity * 1.1::DOUBLE AS hi FROM lineitem), p AS (
      SELECT lo AS lo1, hi AS hi1, lead(lo) OVER (ORDER BY {_ORDER}) AS lo2, lead(hi) OVER (ORDER BY {_ORDER}) AS hi2 FROM b),
    {_ANGLES_SQL}, d AS (SELECT lo1, hi1, lo2, hi2, count(*) AS c, {_RELATION_SQL} AS relation FROM p WHERE lo2 IS NOT NULL GROUP BY lo1, hi1, lo2, hi2)
    SELECT relation, label, sum(c)::BIGINT AS n FROM (SELECT relation, c, {_label_384_sql()} AS label FROM d) GROUP BY relation, label""",
)
def q11_384(spark, sf):
    pairs = dice_pairs(interval_lines(spark, sf), LINE_ORDER, d=384, tolerance=1e-5)
    return pairs.groupBy("relation", "label").agg(F.count("*").alias("n"))


@query(
    "i2_consistency_label_384",
    f"""WITH p AS (SELECT DISTINCT l_quantity AS lo1, l_quantity + l_linenumber AS hi1, 25.0::DOUBLE - l_linenumber AS lo2, 25.0::DOUBLE + l_linenumber % 3 AS hi2 FROM lineitem),
    {_ANGLES_SQL.replace('[lo1, hi1]', '[lo1, hi1, lo2, hi2]')}
    SELECT lo1, hi1, lo2, hi2, {_label_384_sql()} AS label, 0 AS differs FROM (SELECT *, {_RELATION_SQL} AS relation FROM p)""",
)
def i2_384(spark, sf):
    """Labels from explicit vectors; they must not differ from those in closed form."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    pairs = table(spark, sf, "lineitem").select(
        q.alias("lo1"), (q + n).alias("hi1"), (F.lit(25.0) - n).alias("lo2"), (F.lit(25.0) + n % 3).alias("hi2")
    ).distinct()
    ends = [F.col(c) for c in ("lo1", "hi1", "lo2", "hi2")]
    pairs = pairs.withColumn("v1", intervals.dice_interval(ends[0], ends[1], 384)).withColumn(
        "v2", intervals.dice_interval(ends[2], ends[3], 384)
    )
    bounds = ["lo1", "hi1", "lo2", "hi2"]
    labelled = label_vectors(pairs, bounds, "v1", "v2", tolerance=1e-5).drop("v1", "v2")
    labelled = label_bounds(labelled, bounds, 384, tolerance=1e-5, name="closed")
    return labelled.select(*ends, "label", (F.col("label") != F.col("closed")).cast("int").alias("differs"))
