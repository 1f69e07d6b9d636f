"""Numeric intervals: polar embeddings, relations, consistency labels."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmine.functions.vectors import vec_concat


def dice_theta(x: Column, lo: float = 0, hi: float = 100) -> Column:
    """Number to angle: linear over the width of the bounds."""
    return x / F.lit(float(abs(lo - hi))) * F.lit(math.pi)


def dice(x: Column, d: int, lo: float = 0, hi: float = 100) -> Column:
    """DICE-2 is (cos, sin); component k < d of DICE-d is sin^(k-1) cos, the last one sin^d."""
    theta = dice_theta(x, lo, hi)
    if d < 2:
        raise ValueError("d must be at least 2")
    if d == 2:
        return F.array(F.cos(theta), F.sin(theta))
    return F.transform(
        F.sequence(F.lit(1), F.lit(d)),
        lambda k: F.when(k < d, F.pow(F.sin(theta), k - 1) * F.cos(theta)).otherwise(F.pow(F.sin(theta), k)),
    )


def dice_interval(lo: Column, hi: Column, d: int, bounds: tuple[float, float] = (0, 100)) -> Column:
    """Embedding of an interval: both ends, concatenated."""
    return vec_concat(dice(lo, d, *bounds), dice(hi, d, *bounds))


def _rules(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> list[tuple[str, Column]]:
    return [
        ("equal", (lo1 == lo2) & (hi1 == hi2)),
        ("disjoint", (hi1 < lo2) | (hi2 < lo1)),
        ("overlap", (lo1 <= hi2) & (lo2 <= hi1)),
        ("1 in 2", (lo2 <= lo1) & (hi2 >= hi1)),
        ("2 in 1", (lo1 <= lo2) & (hi1 >= hi2)),
        ("partial 1 first", (lo1 <= lo2) & (hi1 >= lo2) & (hi1 <= hi2)),
        ("partial 2 first", (lo2 <= lo1) & (hi2 >= lo1) & (hi2 <= hi1)),
        ("before", hi1 < lo2),
        ("after", lo1 > hi2),
    ]


def _last_true(values: list[tuple[Column, Column]]) -> Column:
    out = F
    for value, condition in reversed(values):
        out = out.when(condition, value)
    return out


def interval_relation(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Relation of two intervals; of all rules that hold, the last one decides."""
    return _last_true([(F.lit(name), condition) for name, condition in _rules(lo1, hi1, lo2, hi2)])


#: Degrees. An angle near 0 comes out of acos with an error of about 1e-6 degrees.
TOLERANCE = 1e-5

#: The ends of two intervals and the pairs between them.
ENDS = ("s1", "e1", "s2", "e2")
PAIRS = tuple(itertools.combinations(ENDS, 2))


def angle_name(a: str, b: str) -> str:
    return "_angle_" + "_".join(sorted((a, b)))


def consistency(
    lo1: Column, hi1: Column, lo2: Column, hi2: Column, same: Column, tolerance: float = TOLERANCE
) -> Column:
    """1 if the angles between the end vectors agree with the relation, else 0.

    Reads the six columns named by ``angle_name``; ``same`` tells whether the vectors are equal.
    """

    def angle(a: str, b: str) -> Column:
        return F.col(angle_name(a, b))

    def detour(p: str, a: str, b: str) -> Column:
        """Surplus of the way a - p - b over the direct angle a - b; 0 if p lies between."""
        return angle(p, a) + angle(p, b) - angle(a, b)

    one_by_two = detour("s1", "s2", "e2") + detour("e1", "s2", "e2")
    two_by_one = detour("s2", "s1", "e1") + detour("e2", "s1", "e1")
    apart = one_by_two > tolerance
    checks = {
        "equal": same,
        "disjoint": apart,
        "overlap": F.abs(two_by_one) <= tolerance,
        "1 in 2": F.abs(one_by_two) <= tolerance,
        "2 in 1": F.abs(two_by_one) <= tolerance,
        "partial 1 first": F.abs(detour("s2", "s1", "e1") + detour("e1", "s2", "e2")) <= tolerance,
        "partial 2 first": F.abs(detour("s1", "s2", "e2") + detour("e2", "s1", "e1")) <= tolerance,
        "before": apart,
        "after": apart,
    }
    rules = _rules(lo1, hi1, lo2, hi2)
    return _last_true([(F.coalesce(checks[name], F.lit(False)).cast("int"), cond) for name, cond in rules])
