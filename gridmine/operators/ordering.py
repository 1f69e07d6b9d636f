"""Global order without a single sorting task.

A window without PARTITION BY, or one over a group holding a large share of the
rows, sorts everything in one task. Here rows are split into ordered buckets by
bounds taken from a bounded uniform sample of the order key; work inside a bucket
is an ordinary window, and what crosses a bucket border travels as one small row
per bucket (and group). Bounds are literals, so every evaluation of the plan, also
after the loss of an executor, puts a row into the same bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmine.session import materialise, partition_count

_BUCKET = "_bucket"
_SAMPLE_PER_BUCKET = 32


def order_bucket(df: DataFrame, order: Sequence[str], buckets: int | None = None) -> Column:
    """Column with the bucket of a row; buckets follow ``order`` (ascending, NULL first).

    The sample is the keys whose hash lies below a threshold that one count of the rows
    gives: about ``32 * buckets`` keys over all tasks together, the same whatever the
    partitioning. ``order`` should be a total order, otherwise a frequent key stays in
    one bucket. ``df`` is read twice; callers hand in a written table.
    """
    spark = df.sparkSession
    n = buckets or partition_count(spark)
    key = F.struct(*[F.col(c) for c in order])
    if n <= 1:
        return F.lit(0)
    key_type = df.select(key.alias("k")).schema["k"].dataType
    keys = df.select(key.alias("k"))
    wanted, rows = n * _SAMPLE_PER_BUCKET, df.count()
    if rows > 2 * wanted:
        keys = keys.filter(F.pmod(F.xxhash64("k"), F.lit(2**40)) < int(2**40 * wanted / rows))
    sample = (
        keys.distinct()
        .agg(F.sort_array(F.collect_list("k")).alias("ks"))
        .select(
            F.expr(
                "CASE WHEN size(ks) = 0 THEN array() ELSE transform("
                f"sequence(1, {n - 1}), i -> element_at(ks, cast(floor(i * size(ks) / {n}) AS int) + 1)) END AS bounds"
            )
        )
    )
    step = max(1, math.isqrt(n))
    row = sample.select(
        F.to_json(F.struct(F.expr(f"filter(bounds, (x, i) -> i % {step} = 0)").alias("b"))).alias("coarse"),
        F.to_json(
            F.struct(
                F.expr(
                    "CASE WHEN size(bounds) = 0 THEN array() ELSE transform("
                    f"sequence(0, cast(floor((size(bounds) - 1) / {step}) as int)),"
                    f" g -> slice(bounds, g * {step} + 1, {step})) END"
                ).alias("b")
            )
        ).alias("fine"),
    ).first()
    coarse_type = T.StructType([T.StructField("b", T.ArrayType(key_type))])
    fine_type = T.StructType([T.StructField("b", T.ArrayType(T.ArrayType(key_type)))])
    coarse = F.from_json(F.lit(row["coarse"]), coarse_type)["b"]
    fine = F.from_json(F.lit(row["fine"]), fine_type)["b"]

    def place(k: Column) -> Column:
        group = F.size(F.filter(coarse, lambda b: b <= k))
        inside = F.size(F.filter(F.element_at(fine, F.greatest(group, F.lit(1))), lambda b: b <= k))
        return F.when(group == 0, F.lit(0)).otherwise((group - 1) * step + inside)

    # A one-element array binds the key once; otherwise it is built again per bound.
    return F.get(F.transform(F.array(key), place), 0)


def hash_bucket(hash_hex: Column, buckets: int) -> Column:
    """Ordered bucket of a hex digest (uniform by construction, so no sampling)."""
    return F.floor(F.conv(F.substring(hash_hex, 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("int")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def number_rows(
    df: DataFrame,
    order: Sequence[str],
    name: str,
    partition_by: Sequence[str] = (),
    buckets: int | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """1-based row number over ``order`` (within ``partition_by``), as bigint.

    The input is computed once and written. One shuffle of the rows; border offsets are one
    row per bucket and group.
    """
    parts = list(partition_by)
    df = materialise(df)
    bucket = order_bucket(df, [*parts, *order], buckets) if bucket is None else bucket
    rows = df.withColumn(_BUCKET, bucket)
    inside = W.partitionBy(_BUCKET, *parts).orderBy(*order)
    rows = rows.withColumn(name, F.row_number().over(inside).cast("long"))
    sizes = df.select(bucket.alias(_BUCKET), *parts).groupBy(_BUCKET, *parts).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*parts).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(_BUCKET, *parts, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return _add_from(rows, offsets, parts, ["_before"]).withColumn(name, F.col(name) + F.col("_before")).drop(
        "_before", _BUCKET
    )


def _add_from(rows: DataFrame, summary: DataFrame, parts: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Attach border values: broadcast when the summary is one row per bucket, else a co-located join."""
    renamed = summary.select(
        F.col(_BUCKET).alias("_sb"), *[F.col(p).alias(f"_s_{p}") for p in parts], *values
    )
    on = F.col(_BUCKET) == F.col("_sb")
    for p in parts:
        on = on & _same(F.col(p), F.col(f"_s_{p}"))
    if not parts:  # at most one row per bucket
        renamed = F.broadcast(renamed)
    return rows.join(renamed, on, "left").drop("_sb", *[f"_s_{p}" for p in parts])


def running_min(
    df: DataFrame,
    order: Sequence[str],
    value: str,
    name: str,
    partition_by: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Running minimum (current row included) over ``order`` within ``partition_by``."""
    parts = list(partition_by)
    df = materialise(df)
    bucket = order_bucket(df, [*parts, *order], buckets)
    inside = W.partitionBy(_BUCKET, *parts).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn(_BUCKET, bucket).withColumn(name, F.min(value).over(inside))
    lows = (
        df.select(bucket.alias(_BUCKET), *parts, value).groupBy(_BUCKET, *parts).agg(F.min(value).alias("_low"))
    )
    before = W.partitionBy(*parts).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    prior = lows.select(_BUCKET, *parts, F.min("_low").over(before).alias("_prior"))
    return (
        _add_from(rows, prior, parts, ["_prior"])
        .withColumn(name, F.least(F.col(name), F.col("_prior")))
        .drop("_prior", _BUCKET)
    )


def with_next(df: DataFrame, order: Sequence[str], columns: Sequence[str], prefix: str = "next_") -> DataFrame:
    """Each row with ``columns`` of the following row; the last row has no pair and is dropped."""
    df = materialise(df)
    bucket = order_bucket(df, order)
    rows = df.withColumn(_BUCKET, bucket)
    payload = F.struct(*[F.col(c) for c in columns])
    rows = rows.withColumn("_next", F.lead(payload).over(W.partitionBy(_BUCKET).orderBy(*order)))
    heads = (
        df.select(bucket.alias(_BUCKET), F.struct(*order).alias("_o"), payload.alias("_p"))
        .groupBy(_BUCKET)
        .agg(F.min_by("_p", "_o").alias("_p"))
    )
    following = heads.select(_BUCKET, F.lead("_p").over(W.orderBy(_BUCKET)).alias("_border"))  # one row per bucket
    rows = _add_from(rows, following, [], ["_border"])
    pair = F.coalesce("_next", "_border")
    return (
        rows.withColumn("_next", pair)
        .filter(F.col("_next").isNotNull())
        .select(*df.columns, *[F.col(f"_next.{c}").alias(f"{prefix}{c}") for c in columns])
    )


def every_nth(df: DataFrame, n: int, order: Sequence[str], name: str = "is_validation") -> DataFrame:
    """Systematic split: rows 0, n, 2n, ... of the order are marked."""
    return (
        number_rows(df, order, "_rn")
        .withColumn(name, ((F.col("_rn") - 1) % n == 0).cast("int"))
        .drop("_rn")
    )


def assign_ids(df: DataFrame, order: Sequence[str], prefix: str = "unq_tkn_", name: str = "token") -> DataFrame:
    """Sequential ids in the given order, from 0."""
    return (
        number_rows(df, order, "_rn")
        .withColumn(name, F.concat(F.lit(prefix), (F.col("_rn") - 1).cast("string")))
        .drop("_rn")
    )


def page(df: DataFrame, offset: int, n: int, order: Sequence[str]) -> DataFrame:
    """OFFSET/LIMIT with an explicit order: only the ordered buckets that hold the page are sorted.

    Counts per bucket (one row each) tell which these are; rows before and after them are not numbered,
    shuffled or sorted.
    """
    df = materialise(df)
    bucket = order_bucket(df, order)
    sizes = dict(df.groupBy(bucket.alias(_BUCKET)).count().collect())  # as many as buckets
    before, wanted, skipped = 0, [], 0
    for b in sorted(sizes):
        if before + sizes[b] > offset and before < offset + n:
            if not wanted:
                skipped = before
            wanted.append(b)
        before += sizes[b]
    return df.where(bucket.isin(wanted)).orderBy(*order).offset(max(0, offset - skipped)).limit(n)


def limit(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """LIMIT with an explicit order (TakeOrderedAndProject, no full sort)."""
    return df.orderBy(*order).limit(n)


def topk_ties(df: DataFrame, by: Sequence[str], k: int, score: str, rank: str | None = None) -> DataFrame:
    """Top ``k`` per group, keeping every row that ties with the k-th.

    Equal scores are counted first (map-side), so a group's window sees its k best distinct
    scores only, and ``row_number() <= k`` cuts each partition before the shuffle. Rows then
    join their score, which leaves the ties of a hot group spread; ``df`` is read twice.
    """
    best = W.partitionBy(*by).orderBy(F.col(score).desc())
    counts = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.withColumn("_at", F.row_number().over(best)).filter(F.col("_at") <= k)
    above = F.coalesce(F.sum("_n").over(best.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    top = top.withColumn("_rank", (above + 1).cast("int")).filter(F.col("_rank") <= k)
    keys = [*by, score]
    top = top.select(*[F.col(c).alias(f"_top_{i}") for i, c in enumerate(keys)], "_rank")
    same = [F.col(c).eqNullSafe(F.col(f"_top_{i}")) for i, c in enumerate(keys)]
    out = df.join(top, same).drop(*[f"_top_{i}" for i in range(len(keys))])
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")
