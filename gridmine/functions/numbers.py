"""Numbers, ranges and units inside cell text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmine.functions.predicates import as_col
from gridmine.functions.text import hold, interleave

# Number, range and mixed-token patterns.
RANGE = r"(?U)\b(\d+(\.\d+)?)[-–](\d+(\.\d+)?)\b"
HYPHEN_RANGE = r"(?U)\b(\d+(\.\d+)?)-(\d+(\.\d+)?)\b"
NUMBER = r"(?U)(-?(\d+(\.\d+)?))"
LONE_NUMBER = r"(?U)(?<![a-zA-Z])\b(?<![0-9.-])-?\d+(\.\d+)?(?![0-9.-])\b(?![a-zA-Z])"
ALNUM_MIX = r"(?U)[a-zA-Z]+\d+[a-zA-Z\d]*|[a-zA-Z]*\d+[a-zA-Z]+"

# Unit lists, in order of precedence.
UNITS_LONG = [
    "years", "days", "ml/h/kg", "mg*h/l", "hb/g", "ng/ml", "ug/ml", "pg/ml", "mg/ml", "mg/kg",
    "ug/l", "kg/m2", "kg/l", "kg/m3", "kg/m", "mg/m3", "mg/m2", "mg/m", "g/m3", "g/m2", "g/m",
    "pg/l", "ng/l", "g/l", "g l-1", "ml", "cm2", "cm", "km", "kg", "pg", "mg", "g", "l", "m3", "m2", "m",
]
UNITS_COLUMN = [
    "years", "days", "ml/h/kg", "mg/kg", "mg*h/l", "hb/g", "ng/ml", "ug/ml", "pg/ml", "mg/ml",
    "ug/l", "kg/m2", "kg/l", "kg/m3", "kg/m", "mg/m3", "mg/m2", "mg/m", "g/m3", "g/m2", "g/m",
    "pg/l", "ng/l", "g/l", "g l-1", "ml", "cm2", "cm", "km", "kg", "pg", "mg", "g", "l", "m3", "m2", "m",
]
UNITS_SHORT = [
    "years", "days", "min", "ml/h/kg", "mg*h/l", "hb/g", "ng/ml", "ug/ml", "pg/ml", "mg/ml",
    "mg/kg", "ug/l", "kg/m2", "kg/l", "kg/m", "kg/m3", "g/m", "pg/l", "ng/l", "g/l",
    "ml", "um", "ug", "nm", "mm", "cm", "km", "kg", "pg", "mg", "Gb",
]
TOKEN_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def find_ranges(c: str | Column) -> Column:
    """All ``a-b`` / ``a–b`` as array of (lo, hi) texts."""
    c = as_col(c)
    lows, highs = (F.regexp_extract_all(c, F.lit(RANGE), F.lit(g)) for g in (1, 3))
    return F.transform(F.arrays_zip(lows.alias("lo"), highs.alias("hi")), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi")))


def find_numbers(c: str | Column) -> Column:
    return F.regexp_extract_all(as_col(c), F.lit(NUMBER), F.lit(1))


def find_alnum_mix(c: str | Column) -> Column:
    """Tokens mixing letters and digits."""
    return F.regexp_extract_all(as_col(c), F.lit(ALNUM_MIX), F.lit(0))


def fixed1(x: Column) -> Column:
    """A double with one decimal, rounded half-even on its exact binary value.

    The fraction is exact, and ten times the fraction is compared with the candidate
    digit through an exact split of the double (27 + 26 bits), since ``round`` works on
    the shortest decimal text. From 2^63 on the text is that of the shortest decimal.
    """
    def text(x: Column) -> Column:
        a = F.abs(x)
        whole = F.floor(F.least(a, F.lit(9.2e18)))

        def fraction(f: Column) -> Column:
            big = f * F.lit(134217729.0)

            def digit(head: Column) -> Column:
                down = F.floor(f * 10)
                excess = ((F.lit(10.0) * head - down) - F.lit(0.5)) + F.lit(10.0) * (f - head)
                return down + F.when(hold(excess, lambda e: (e > 0) | ((e == 0) & (down % 2 == 1))), 1).otherwise(0)

            def shown(d: Column) -> Column:
                return F.concat((whole + F.floor(d / 10)).cast("string"), F.lit("."), (d % 10).cast("int").cast("string"))

            return hold(hold(big - (big - f), digit), shown)

        short = F.when(a < 9.2e18, hold(a - whole, fraction)).otherwise(F.format_string("%.1f", a))
        return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), short)

    return hold(x, text)


def float_text(c: str | Column) -> Column:
    """Digits text as printed from a float: ``5`` -> ``5.0``, ``01.50`` -> ``1.5``."""
    c = as_col(c)
    whole = F.regexp_replace(F.regexp_extract(c, r"^(-?\d+)", 1), r"^(-?)0+(?=\d)", "$1")
    fraction = F.regexp_replace(F.regexp_extract(c, r"\.(\d+)$", 1), r"0+$", "")
    return F.concat(whole, F.lit("."), F.when(fraction == "", F.lit("0")).otherwise(fraction))


def _around(value: Column, pct: float) -> tuple[Column, Column]:
    spread = F.abs(F.when(value == 0, F.lit(1.0)).otherwise(value) * F.lit(float(pct)) / F.lit(100.0))
    return value - spread, value + spread


def number_to_interval(value: Column, pct: float = 10) -> Column:
    def text(x: Column) -> Column:
        lo, hi = _around(x, pct)
        return F.concat(F.lit("["), fixed1(lo), F.lit("|"), fixed1(hi), F.lit("]"))

    return hold(value, text)


def replace_matches(c: str | Column, pattern: str, group_cols: Sequence[int], fill) -> Column:
    """Replace every match by ``fill(group texts...)``: a regex callback without leaving the JVM."""
    c = as_col(c)
    groups = [F.regexp_extract_all(c, F.lit(pattern), F.lit(g)) for g in group_cols]
    zipped = groups[0] if len(groups) == 1 else F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)])
    if len(groups) == 1:
        fills = F.transform(zipped, fill)
    else:
        fills = F.transform(zipped, lambda m: fill(*[m[f"g{i}"] for i in range(len(groups))]))
    return F.when(c.rlike(pattern), interleave(F.split(c, pattern, -1), fills)).otherwise(c)


def numbers_to_intervals(c: str | Column, pct: float = 10) -> Column:
    """Stand-alone numbers to ``[x-10%|x+10%]``; numbers in words, ranges or after ``-`` stay."""
    return replace_matches(c, LONE_NUMBER, [0], lambda m: number_to_interval(m.cast("double"), pct))


def format_ranges(c: str | Column) -> Column:
    """``a-b`` to one decimal on both ends."""
    return replace_matches(
        c, HYPHEN_RANGE, [1, 3], lambda lo, hi: F.concat(fixed1(lo.cast("double")), F.lit("-"), fixed1(hi.cast("double")))
    )


def detect_unit(c: str | Column, units: Sequence[str] = UNITS_LONG) -> Column:
    """First unit in list order that stands between blanks, in any case; NULL if none.

    A look-ahead finds, at each blank, the best unit starting there, so the text is
    scanned once instead of once per unit. A unit is a regex (``mg*h/l`` has a starred g).
    """
    found = F.regexp_extract_all(as_col(c), F.lit(rf"(?iU)(?<=\s)(?=({'|'.join(units)})\s)"), F.lit(1))
    plain = [u for u in units if "*" not in u]
    starred = [u for u in units if "*" in u]
    lowered = F.array(*[F.lit(u.lower()) for u in units])

    def position(m: Column) -> Column:
        at = F.array_position(lowered, F.lower(m))
        for u in starred:
            at = F.when((at == 0) & m.rlike(f"(?i)^{u}$"), F.lit(units.index(u) + 1)).otherwise(at)
        return at

    assert plain
    best = F.array_min(F.transform(found, position))
    return F.get(F.array(*[F.lit(u) for u in units]), (best - 1).cast("int"))


def resolve_unit(header: Column, cell: Column, prefer: str = "header", default: str | None = None) -> Column:
    first, second = (header, cell) if prefer == "header" else (cell, header)
    return F.coalesce(first, second, *([F.lit(default)] if default else []))


def add_unit(cell: str | Column, unit: str | Column) -> Column:
    cell, unit = as_col(cell), as_col(unit)
    return F.when(unit.isNotNull(), F.concat(cell, F.lit(" "), unit)).otherwise(cell)


def range_token(attribute: Column, unit: Column, lo: Column, hi: Column) -> Column:
    """Deterministic 32-letter token of a range; ``lo``/``hi`` are number texts."""
    digest = F.sha2(F.concat_ws("|", attribute, unit, float_text(lo), float_text(hi)), 256)
    letters = F.lit(TOKEN_LETTERS)

    def spelled(digest: Column) -> Column:
        def letter(i: Column) -> Column:
            byte = F.conv(F.substr(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
            return F.substr(letters, byte % len(TOKEN_LETTERS) + 1, F.lit(1))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")

    return hold(digest, spelled)


def tokenise_ranges(cell: str | Column, attribute: Column, unit: Column) -> Column:
    """Every range of a cell to `` token ``; needs no dictionary because tokens are computed."""
    return replace_matches(
        cell, RANGE, [1, 3], lambda lo, hi: F.concat(F.lit(" "), range_token(attribute, unit, lo, hi), F.lit(" "))
    )


def parse_interval(c: str | Column) -> Column:
    """``[lo|hi]`` to struct<lo, hi>; unparsable bounds are NULL."""
    parts = F.split(F.translate(F.trim(as_col(c)), "[]", ""), r"\|")
    return F.struct(
        F.get(parts, 0).try_cast("double").alias("lo"), F.get(parts, 1).try_cast("double").alias("hi")
    )


def parse_vector(c: str | Column, dims: int | None = None) -> Column:
    """Vector literal, closing bracket optional; NULL when it cannot be read."""
    c = F.trim(as_col(c))
    closed = F.when(c.endswith("]"), c).otherwise(F.concat(c, F.lit("]")))
    vector = F.from_json(closed, "array<double>")
    return vector if dims is None else F.slice(vector, 1, dims)


def parse_grid(c: str | Column) -> Column:
    """List-of-lists literal (single or double quotes); NULL when it cannot be read."""
    return F.from_json(as_col(c), "array<array<string>>")
