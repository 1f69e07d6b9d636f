"""Interval chain: intervals -> embeddings -> consecutive pairs -> labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmine.functions.intervals import (
    ENDS,
    PAIRS,
    TOLERANCE,
    angle_name,
    consistency,
    dice_theta,
    interval_relation,
)
from gridmine.functions.vectors import angle_deg, vec_halves
from gridmine.operators.ordering import with_next


def label_vectors(
    df: DataFrame, bounds: Sequence[str], v1: str, v2: str, tolerance: float = TOLERANCE, name: str = "label"
) -> DataFrame:
    """Consistency label of two intervals (columns lo1, hi1, lo2, hi2) from their vectors.

    The six angles are columns of their own, so each is computed once.
    """
    (s1, e1), (s2, e2) = vec_halves(v1), vec_halves(v2)
    ends = dict(zip(ENDS, (s1, e1, s2, e2)))
    angles = df.withColumns({angle_name(a, b): angle_deg(ends[a], ends[b]) for a, b in PAIRS})
    label = consistency(*[F.col(c) for c in bounds], F.col(v1) == F.col(v2), tolerance)
    return angles.withColumn(name, label).drop(*[angle_name(a, b) for a, b in PAIRS])


def label_bounds(
    df: DataFrame,
    bounds: Sequence[str],
    d: int = 384,
    limits: tuple[float, float] = (0, 100),
    tolerance: float = TOLERANCE,
    name: str = "label",
) -> DataFrame:
    """The label of the DICE-d embeddings, from the bounds alone: no vector is built.

    Component products of two embeddings are powers of r = sin x sin y, so their dot
    product is a geometric series: cos x cos y (1 - r^(d-1)) / (1 - r) + r^d.
    Sines, products and angles are columns of their own, so each is computed once.
    """
    sines, cosines = ({e: f"_{fn}_{e}" for e in ENDS} for fn in ("sin", "cos"))
    theta = {e: dice_theta(F.col(c), *limits) for e, c in zip(ENDS, bounds)}
    out = df.withColumns({sines[e]: F.sin(theta[e]) for e in ENDS} | {cosines[e]: F.cos(theta[e]) for e in ENDS})

    dots = {(a, b): f"_dot_{a}_{b}" for a, b in [*PAIRS, *((e, e) for e in ENDS)]}
    ratios = {pair: f"_r_{pair[0]}_{pair[1]}" for pair in dots}
    out = out.withColumns({ratios[a, b]: F.col(sines[a]) * F.col(sines[b]) for a, b in dots})

    def dot(a: str, b: str) -> Column:
        r, product = F.col(ratios[a, b]), F.col(cosines[a]) * F.col(cosines[b])
        if d == 2:
            return product + r
        series = F.when(r == 1, F.lit(float(d - 1))).otherwise((1 - F.pow(r, F.lit(d - 1))) / (1 - r))
        return product * series + F.pow(r, F.lit(d))

    out = out.withColumns({dots[pair]: dot(*pair) for pair in dots})

    def angle(a: str, b: str) -> Column:
        norms = F.sqrt(F.col(dots[a, a]) * F.col(dots[b, b]))
        cos = F.try_divide(F.col(dots[a, b]), norms)
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))

    out = out.withColumns({angle_name(a, b): angle(a, b) for a, b in PAIRS})
    lo1, hi1, lo2, hi2 = (F.col(c) for c in bounds)
    label = consistency(lo1, hi1, lo2, hi2, (lo1 == lo2) & (hi1 == hi2), tolerance)
    return out.select(*df.columns, label.alias(name))


def dice_pairs(intervals: DataFrame, order: Sequence[str], d: int = 384, tolerance: float = TOLERANCE) -> DataFrame:
    """``intervals`` is (order columns, lo, hi). Pairs of neighbours with relation and label.

    Only bounds are shuffled, and the angles between the embeddings of a pair come from
    the bounds in closed form; ``dice_interval`` gives the vectors where they are wanted.
    Output: order columns, Rx1, Ry1, Rx2, Ry2, relation, label.
    """
    return _related(_neighbours(intervals, order), d, tolerance)


def counted_dice_pairs(
    intervals: DataFrame, order: Sequence[str], also: Sequence[Column] = (), d: int = 384, tolerance: float = TOLERANCE
) -> DataFrame:
    """The different pairs of ``dice_pairs`` and how often each occurs: (also, Rx1, Ry1, Rx2, Ry2, n, relation, label).

    Pairs that differ in the columns ``also`` are counted apart. Relation and angles are computed once per different pair.
    """
    counted = _neighbours(intervals, order).groupBy(*also, *_BOUNDS).agg(F.count(F.lit(1)).alias("n"))
    return _related(counted, d, tolerance)


_BOUNDS = ["Rx1", "Ry1", "Rx2", "Ry2"]


def _neighbours(intervals: DataFrame, order: Sequence[str]) -> DataFrame:
    names = dict(zip(["lo", "hi", "next_lo", "next_hi"], _BOUNDS, strict=True))
    return with_next(intervals.select(*order, "lo", "hi"), list(order), ["lo", "hi"]).withColumnsRenamed(names)


def _related(pairs: DataFrame, d: int, tolerance: float) -> DataFrame:
    related = pairs.withColumn("relation", interval_relation(*[F.col(c) for c in _BOUNDS]))
    return label_bounds(related, _BOUNDS, d, tolerance=tolerance)
