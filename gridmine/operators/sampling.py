"""Repeatable sampling: every draw orders rows by a seeded hash of their key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmine.operators.joins import holdout
from gridmine.operators.ordering import hash_bucket, number_rows
from gridmine.session import partition_count


def seeded_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Random order (a range-partitioned sort)."""
    return df.orderBy(seeded_hash(key, seed))


def sample_n(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """Exactly min(n, count) rows.

    Rows whose hash is above a threshold given by the count are left out before the sort, so all
    tasks together send little more than ``n`` rows on.
    """
    rows = df.count()
    if rows > n:
        wanted = n + 10 * math.isqrt(n) + 100
        head = F.conv(F.substring(seeded_hash(key, seed), 1, 8), 16, 10).cast("long")
        pool = df.filter(head < min(2**32, int(2**32 * wanted / rows)))
        if pool.limit(n).count() == n:
            df = pool
    return df.orderBy(seeded_hash(key, seed), key).limit(n)


def hash_rank(df: DataFrame, key: str, seed: int, name: str = "_draw") -> DataFrame:
    """Position of every row in the seeded order, without a single sorting task."""
    hashed = df.withColumn("_h", seeded_hash(key, seed))
    bucket = hash_bucket(F.col("_h"), partition_count(df.sparkSession))
    return number_rows(hashed, ["_h", key], name, bucket=bucket).drop("_h")


def balance(pos: DataFrame, neg: DataFrame, key: str, seed: int) -> DataFrame:
    """As many negatives as there are positives (all of them if fewer)."""
    wanted = pos.agg(F.count("*").alias("_wanted"))  # one row
    return (
        hash_rank(neg, key, seed)
        .join(F.broadcast(wanted), F.col("_draw") <= F.col("_wanted"))
        .drop("_draw", "_wanted")
    )


def sample_one(df: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """One random row per group; a max-free aggregate, so a hot group is pre-reduced map-side."""
    rest = [c for c in df.columns if c != group]
    picked = df.groupBy(group).agg(F.min_by(F.struct(*rest), F.struct(seeded_hash(key, seed), F.col(key))).alias("_r"))
    return picked.select(group, *[F.col(f"_r.{c}").alias(c) for c in rest])


def hash_split(df: DataFrame, fraction: float, key: str, seed: int, name: str = "is_train") -> DataFrame:
    """Random split by hash threshold: stable under repartitioning, unlike ``randomSplit``."""
    draw = F.conv(F.substring(seeded_hash(key, seed), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return df.withColumn(name, (draw < fraction).cast("int"))


def random_split(df: DataFrame, weights: list[float], seed: int) -> list[DataFrame]:
    return df.randomSplit(weights, seed)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def split_sets(
    pos: DataFrame, neg: DataFrame, ids: DataFrame, key: str, seed: int, cap: int = 2500
) -> tuple[DataFrame, DataFrame]:
    """(train, test): listed ids are held out; up to ``cap`` positives are drawn, then balanced by negatives."""
    test_pos, _ = holdout(pos, ids, key)
    test_neg, rest_neg = holdout(neg, ids, key)
    _, train_pos = holdout(sample_n(pos, cap, key, seed), ids, key)
    train_neg = balance(train_pos, rest_neg, key, seed)
    return union_all(train_pos, train_neg), union_all(test_pos, test_neg)
