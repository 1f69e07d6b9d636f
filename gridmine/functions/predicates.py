"""Document predicates with the semantics of a document store.

A regex over a path into an array of structs holds if any element matches; its
negation holds if no element matches, and therefore also when the field is missing.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (pattern, ignore_case)
Pattern = tuple[str, bool]


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_of(*conditions: Column) -> Column:
    return reduce(and_, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(or_, conditions)


def rx(c: str | Column, pattern: str, ignore_case: bool = False) -> Column:
    return as_col(c).rlike(("(?i)" if ignore_case else "") + pattern)


def rx_any(c: str | Column, patterns: Iterable[Pattern]) -> Column:
    """Any of the patterns; patterns with the same flag share one regex pass."""
    by_flag: dict[bool, list[str]] = {}
    for pattern, ignore_case in patterns:
        by_flag.setdefault(ignore_case, []).append(pattern)
    return any_of(*(rx(c, "|".join(ps), flag) for flag, ps in by_flag.items()))


def rx_path_any(c: str | Column, field: str, patterns: Sequence[Pattern]) -> Column:
    """Any element of an array of structs matches.

    Works on the array of the one field, which a scan can read without its siblings;
    a struct used inside a lambda would pull in all of them.
    """
    values = as_col(c).getField(field)
    return F.coalesce(F.exists(values, lambda x: F.coalesce(rx_any(x, patterns), F.lit(False))), F.lit(False))


def matches(path: str, patterns: Sequence[Pattern]) -> Column:
    """``path`` is a column, or ``array_column.field`` for an array of structs."""
    column, _, field = path.partition(".")
    if field:
        return rx_path_any(column, field, patterns)
    return F.coalesce(rx_any(column, patterns), F.lit(False))


def rx_none(path: str, patterns: Sequence[Pattern]) -> Column:
    return ~matches(path, patterns)


def matches_any(paths: dict[str, Sequence[Pattern]]) -> Column:
    return any_of(*(matches(path, patterns) for path, patterns in paths.items()))


def matches_none(paths: dict[str, Sequence[Pattern]]) -> Column:
    return all_of(*(rx_none(path, patterns) for path, patterns in paths.items()))


def not_empty(c: str | Column, missing_passes: bool = True) -> Column:
    """Array differs from ``[]``. A missing field is not ``[]``, so it passes by default."""
    c = as_col(c)
    present = F.coalesce(F.size(c) > 0, F.lit(False))
    return (c.isNull() | present) if missing_passes else present


def guard(c: str | Column, max_len: int | None = None, stop: Sequence[str] = ()) -> Column:
    """Length guard and stop values."""
    c = as_col(c)
    keep = F.lit(True) if max_len is None else F.length(c) <= max_len
    if stop:
        keep = keep & ~F.trim(c).isin(*stop)
    return keep


def bounded(cols: Sequence[str], hi: float) -> Column:
    return all_of(*(F.col(c) < hi for c in cols))


def cell_guard(c: str | Column) -> Column:
    """Neither missing nor blank."""
    c = as_col(c)
    return c.isNotNull() & (F.trim(c) != "")


def header_guard(c: str | Column, default: str | None = None) -> Column:
    """Blank headers: a filter condition, or the header with a default name."""
    c = as_col(c)
    blank = c.isNull() | (F.trim(c) == "")
    return ~blank if default is None else F.when(blank, F.lit(default)).otherwise(c)


def has_payload(text_cols: Sequence[str] = (), array_cols: Sequence[str] = ()) -> Column:
    """Payload present and not empty (``''``, ``{}`` or ``[]``)."""
    conditions = [F.col(c).isNotNull() & ~F.trim(F.col(c)).isin("", "{}") for c in text_cols]
    conditions += [not_empty(c, missing_passes=False) for c in array_cols]
    return all_of(*conditions)


def without_nan(c: str | Column, substring: bool = True) -> Column:
    """Lines that are not blank and hold no ``nan`` (as substring, or as a whole token)."""
    c = as_col(c)
    hit = c.contains("nan") if substring else c.rlike(r"(^|[\s,])nan($|[\s,])")
    return ~hit & (F.trim(c) != "")


def search(c: str | Column, word: str, regex: bool = False) -> Column:
    return as_col(c).rlike(word) if regex else as_col(c).contains(word)


# The query vocabulary.
TOPIC: list[Pattern] = [("kidney disease", True), ("renal disease", True), ("CKD", False)]
TOPIC_WIDE: list[Pattern] = [("kidney", True), ("renal", True), ("CKD", False)]
SYMPTOMS: list[Pattern] = [
    ("kidney stones", True),
    ("electrolyte imbalance", True),
    ("edema", True),
    ("pruritus", True),
    ("urine", True),
    ("dialysis", True),
    ("anemia", True),
    ("urina", True),
]
ABSTRACT_SYMPTOMS: list[Pattern] = [*SYMPTOMS, ("abdominal pain", True), ("abdominal discomfort", True)]
VIRUS: list[Pattern] = [("covid", True), ("corona", True)]
VIRUS_WIDE: list[Pattern] = [*VIRUS, ("SARS-CoV-2", True)]
