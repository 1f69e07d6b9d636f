"""Cell and corpus text: cleaning, normalisation profiles, tokens, sequences.

A profile is an ordered list of steps; a step is ``(regex, replacement)`` or a named
Column function. The order is part of the profile: some rules can no longer fire
after earlier ones, and they are kept so that a profile reads as specified.
``(?U)`` gives ``\\w \\d \\s \\b`` their Unicode meaning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmine.functions.predicates import as_col

Step = tuple[str, str] | Callable[[Column], Column]


def strip(c: str | Column) -> Column:
    """Trim any white space (``trim`` only knows the blank)."""
    return F.regexp_replace(as_col(c), r"(?U)^\s+|\s+$", "")


def strip_chars(c: str | Column, chars: str) -> Column:
    return F.translate(as_col(c), chars, "")


def clean_list(c: str | Column) -> Column:
    """Printed list to text: drop ``[ ] '``, split on commas, trim parts, join by a blank."""
    return F.regexp_replace(strip(strip_chars(c, "[]'")), r"(?U)\s*,\s*", " ")


def alnum_tokens(c: str | Column, out: str = "list", limit: int | None = None) -> Column:
    """Lower-cased tokens of letters and digits only; ``out`` is list, space or comma."""
    tokens = F.filter(F.split(as_col(c), " "), lambda t: t.rlike(r"^[\p{L}\p{N}]+$"))
    tokens = F.transform(tokens, F.lower)
    if limit is not None:
        tokens = F.slice(tokens, 1, limit)
    if out == "list":
        return tokens
    return F.array_join(tokens, {"space": " ", "comma": ","}[out])


# Patterns and replacement words of the normalisation profiles.
_MONTHS = (
    "january|february|march|april|may|june|july|august|september|october|november|december"
    "|JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER"
    "|January|February|March|April|May|June|July|August|September|October|November|December"
)
ZERO_QUOTED = (r"'0.0'|'0'", "ZERO")
ZERO_BARE = (r"(?U)\b0\.0\b|\b0\b", "ZERO")
RANGE_DASH = (r"(?U)\b(\d+(\.\d+)?)[-–](\d+(\.\d+)?)\b", " RANGE ")
RANGE_LOOSE = (r"(?U)([0-9]+\.?[0-9]*(\s)*(\-)(\s)*[0-9]+\.?[0-9]*)", "RANGE")
RANGE_SPACED = (r"(?U)\d+(\.\d+)?\s*-\s*\d+(\.\d+)?", "RANGE")
RANGE_TO = (r"(?U)\d+(\.\d+)?\s*\[\s*\d+(\.\d+)?\s*to\s*\d+(\.\d+)?\s*\]", "RANGE")
RATIO = (r"(?U)\d+:\d+", " RATIO ")
NEG_AFTER_BLANK = (r"(?U)(?<=\s)-\d+(?:\.\d+)?", " NEG ")
NEG_LOOSE = (r"(?U)(-\d*\.?\d*)", "NEG")
SMALLPOS = (r"(?<![0-9])(0)([.])([0-9]*)", "SMALLPOS")
FLOAT = (r"([0-9]+\.[0-9]*)", "FLOAT")
INT = (r"(?U)(?<![a-z|A-Z])(?<![\d.])[0-9]+(?![\d.])(?![a-z|A-Z])", "INT")
MONTH_DATE = (rf"(?U)([\w]*({_MONTHS})[\w]*)", "DATE")
UNITTIME = (r"(?U)([\w]*(Year|year|time|times|Times|Time|days|Days)[\w]*)", "UNITTIME")
UNIT_WORDS = [(r"[a-z|\_]*/ml", "UNITML"), (r"[a-z|\_]*/mg", "UNITMG"), (r"[a-z|\_]*/kg", "UNITKG")]


def _neg(word: str) -> tuple[str, str]:
    return (r"(?U)-\d+(\.\d+)?", word)


def _percent_number(word: str) -> tuple[str, str]:
    return (r"(?U)\d+(\.\d+)?%", word)


def _zero_led(word: str) -> tuple[str, str]:
    return (r"(?U)0(\.\d+)?", word)


def _number(word: str) -> tuple[str, str]:
    return (r"(?U)\d+(\.\d+)?", word)


def _date(word: str = "DATE") -> tuple[str, str]:
    return (r"(?U)\d{1,2}/\d{1,2}/\d{4}", word)


def _pad(word: str, spaced: bool) -> str:
    return f" {word} " if spaced else word


def _symbols(spaced: bool) -> list[tuple[str, str]]:
    return [("<", _pad("LESS", spaced)), (">", _pad("GREATER", spaced)), ("~", _pad("APPROX", spaced))]


def _unit_suffixes(spaced: bool = False) -> list[tuple[str, str]]:
    suffixes = [("mg", "UNITMG"), ("kg", "UNITKG"), ("ml", "UNITML"), ("L", "UNITL")]
    return [(rf"(?U)/{unit}\b", _pad(word, spaced)) for unit, word in suffixes]


def _out(kind: str) -> Callable[[Column], Column]:
    return lambda c: alnum_tokens(c, kind)


_TERM_RULES: list[Step] = [
    ZERO_QUOTED,
    RANGE_TO,
    _neg("NEG"),
    _percent_number("PERCENT"),
    _number("FLOAT"),
    _zero_led("SMALLPOS"),
    _date(),
    *_symbols(False),
    *_unit_suffixes(),
    UNITTIME,
    *UNIT_WORDS,
]

PROFILES: dict[str, list[Step]] = {
    "row_corpus": [
        lambda c: strip_chars(c, ",'\":"),
        ZERO_QUOTED,
        RANGE_DASH,
        RATIO,
        NEG_AFTER_BLANK,
        SMALLPOS,
        FLOAT,
        INT,
        ("%", " PERCENT "),
        MONTH_DATE,
        *_symbols(True),
        UNITTIME,
        *UNIT_WORDS,
        lambda c: strip_chars(c, "[]':"),
    ],
    "erase": [
        ZERO_QUOTED,
        clean_list,
        ZERO_QUOTED,
        RANGE_TO,
        _neg(""),
        _percent_number(""),
        _zero_led(""),
        _number(""),
        _date(),
        *_symbols(False),
        *_unit_suffixes(),
        UNITTIME,
        *UNIT_WORDS,
        _out("comma"),
    ],
    "classes": [
        ZERO_QUOTED,
        clean_list,
        ZERO_QUOTED,
        RANGE_TO,
        _neg("NEG"),
        _zero_led("SMALLPOS"),
        _number("FLOAT"),
        _percent_number("PERCENT"),
        _date(),
        *_symbols(False),
        *_unit_suffixes(),
        UNITTIME,
        *UNIT_WORDS,
        _out("space"),
    ],
    "keep_numbers": [
        clean_list,
        ("%", " PERCENT"),
        _date(" DATE "),
        *_symbols(True),
        *_unit_suffixes(spaced=True),
        *[(pattern, _pad(word, True)) for pattern, word in UNIT_WORDS],
        _out("comma"),
    ],
    "classifier": [
        ZERO_QUOTED,
        clean_list,
        RANGE_LOOSE,
        NEG_LOOSE,
        SMALLPOS,
        FLOAT,
        INT,
        ("%", "PERCENT"),
        MONTH_DATE,
        *_symbols(False),
        UNITTIME,
        *UNIT_WORDS,
        _out("list"),
    ],
    "raw": [clean_list, _out("list")],
    "term": [
        *_TERM_RULES,
        lambda c: F.regexp_replace(strip(c), r"(?U)\s+", " "),
        lambda c: F.when(c == "", F.lit("nan")).otherwise(c),
    ],
    "term_v0": [
        ZERO_BARE,
        RANGE_SPACED,
        _neg("NEG"),
        _percent_number("PERCENT"),
        _zero_led("SMALLPOS"),
        _date(),
        *_symbols(False),
        *_unit_suffixes(),
        UNITTIME,
        *UNIT_WORDS,
    ],
}


def normalise(c: str | Column, profile: str) -> Column:
    out = as_col(c)
    for step in PROFILES[profile]:
        out = F.regexp_replace(out, step[0], step[1]) if isinstance(step, tuple) else step(out)
    return out


#: What a term needs for any rule of its profile to change it; the quotes and brackets that others ask for are gone by then.
_RULED = r"(?U)[\d<>~/]|[Yy]ear|[Tt]ime|[Dd]ays"


def terms(c: str | Column) -> Column:
    """Row text to normalised terms: split on commas and blanks, word characters only, lower case.

    Terms that no rule of the profile can change, which most words are, are not taken through its rules.
    """
    pieces = F.filter(F.split(strip_chars(c, "[]()'"), r"(?U)[,\s]+"), lambda t: t != "")

    def term(t: Column) -> Column:
        ruled = F.when(F.rlike(t, F.lit(_RULED)), normalise(t, "term")).otherwise(t)
        return F.lower(F.regexp_replace(ruled, r"(?U)[^\w]", ""))

    return F.transform(pieces, term)


# Cell texts that stand for a missing value.
NULL_LIKE = ["-", "–", "na", "n/a", "nan"]


def null_like(c: str | Column) -> Column:
    """Null-like cells become the text ``null``."""
    c = as_col(c)
    return F.when(F.lower(strip(c)).isin(*NULL_LIKE), F.lit("null")).otherwise(c)


def prefix(c: str | Column, n: int = 64) -> Column:
    """First ``n`` characters, commas to blanks."""
    return F.replace(F.substring(as_col(c), 1, n), F.lit(","), F.lit(" "))


def pad(c: str | Column, length: int) -> Column:
    """Exactly ``length`` ids: longer sequences keep their last part, shorter end in zeros."""
    c = as_col(c)
    size = F.size(c)
    kept = F.slice(c, F.greatest(F.lit(1), size - F.lit(length - 1)), F.lit(length))
    return F.concat(kept, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.lit(length) - size)))


def table_text(grid: str | Column, drop: str = "~") -> Column:
    """All cells of a grid as one text."""
    rows = F.transform(as_col(grid), lambda r: F.array_join(r, " "))
    return F.replace(F.array_join(rows, " "), F.lit(drop), F.lit(""))


def row_texts(grid: str | Column, drop: str = "~") -> Column:
    """One text per row; missing cells are left out."""
    return F.transform(as_col(grid), lambda r: F.replace(F.array_join(r, " "), F.lit(drop), F.lit("")))


def flatten_nonempty(c: str | Column) -> Column:
    """Nested header list to a flat one; missing or empty parts vanish."""
    return F.flatten(F.filter(as_col(c), lambda x: F.coalesce(F.size(x) > 0, F.lit(False))))


def tree_text(tree: str | Column, depth: int = 2, mode: str = "all") -> Column:
    """Text of a header tree, depth first.

    ``mode="last"`` keeps only the last sibling of every level, ``"all"`` keeps all.
    A leaf adds its text, a parent its text, a blank and the text below it.
    """
    tree = as_col(tree)

    def node(x: Column) -> Column:
        if depth == 1:
            return x["text"]
        below = tree_text(x["children"], depth - 1, mode)
        has_children = F.coalesce(F.size(x["children"]) > 0, F.lit(False))
        return F.when(has_children, F.concat(x["text"], F.lit(" "), below)).otherwise(x["text"])

    if mode == "last":
        tree = F.slice(tree, F.greatest(F.size(tree), F.lit(1)), F.lit(1))
    return F.coalesce(F.array_join(F.transform(tree, node), " "), F.lit(""))


# Header collapsing: (joiner, leading joiner kept, parts trimmed).
HEADER_STYLES = {"leading": (" : ", True, False), "colon": (" : ", False, True), "space": (" ", False, True)}


def collapse_header(rows: str | Column, style: str = "colon") -> Column:
    """Multi-row header (rows x columns) to one path per column.

    A part is skipped only when it equals the whole path so far; a missing part reads ``0``.
    """
    joiner, leading, trimmed = HEADER_STYLES[style]
    rows = as_col(rows)

    def path(i: Column) -> Column:
        def add(acc: Column, row: Column) -> Column:
            part = F.coalesce(F.get(row, i), F.lit("0"))
            part = strip(part) if trimmed else part
            longer = F.concat(acc, F.lit(joiner), part)
            if leading:
                return F.when(acc == part, acc).otherwise(longer)
            return F.when(acc == "", part).when(acc == part, acc).otherwise(longer)

        return F.aggregate(rows, F.lit(""), add)

    width = F.array_max(F.transform(rows, F.size))
    return F.transform(F.sequence(F.lit(0), width - 1), path)


def serialise_rows(header: str | Column, rows: str | Column, profile: str | None = None, sep: str = " [SEP] ") -> Column:
    """Body rows as ``header cell [SEP] header cell``; missing cells read ``0``."""

    def text(x: Column) -> Column:
        x = F.coalesce(x, F.lit("0"))
        return normalise(x, profile) if profile else x

    names = F.transform(as_col(header), text)
    return F.transform(
        as_col(rows),
        lambda r: F.array_join(F.zip_with(names, r, lambda h, v: F.concat(h, F.lit(" "), text(v))), sep),
    )


def hold(value: Column, then) -> Column:
    """``then(value)`` with the value computed once: an expression that stands twice inside a lambda is computed twice."""
    return F.get(F.transform(F.array(value), then), 0)


def interleave(parts: Column, fills: Column) -> Column:
    """part0 fill0 part1 fill1 ... : re-assembly of a text split at matches."""
    return F.array_join(F.zip_with(parts, fills, lambda p, f: F.concat(p, F.coalesce(f, F.lit("")))), "")


