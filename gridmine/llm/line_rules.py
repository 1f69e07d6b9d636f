"""Quality rules, lines first.

Every line is judged by rules of punctuation, navigation and boilerplate; lines that fail are taken
out, and a document is rejected if too large a share of its words stood in them, or if it fails the
rules on the whole document (too few words, too many words in repeated 3-word windows).
DataFrame functions only; all work stays inside the row, so nothing is shuffled.

Line rules (a line is what stands between line breaks; blank lines are dropped without counting):

- symbols: more than ``SYMBOL_SHARE`` of the characters other than blanks are one of ``SYMBOLS``
- shouting: at least ``SHOUT_SHARE`` of the words end in two or more exclamation marks
- navigation: three or more bars, or fewer than ``SHORT_LINE`` words without an end mark
- boilerplate: the line matches ``BOILERPLATE``
- monotony: at least ``SAME_SHARE`` of the words equal the word before

Nulls: a null text has no words, no lines, and fails the base rules like an empty one. Ties and
repeated rows are judged one by one. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmine.llm.common import text_or_empty, words

SYMBOLS = r"[#*$%&|<>]"
SYMBOL_SHARE, SHOUT_SHARE, SAME_SHARE = 0.1, 0.5, 0.5
SHORT_LINE = 5
#: A line ends in one of these, a closing quote or bracket after it allowed.
END_MARK = r"[.!?:;…。！？][\"'”’»)\]]*\s*$"
BOILERPLATE = (
    r"(?i)all rights reserved|licensed under|released under the|under the terms of|privacy policy|terms of (?:use|service)"
    r"|cookie policy|uses cookies|enable javascript|lorem ipsum|subscribe to our|sign up for|click here|powered by|copyright ©|\(c\) \d{4}"
)
#: Documents that lose more than this share of their words are rejected.
MOST_LOST = 0.5
LEAST_WORDS = 50
REPEATED_PERCENT = 50
#: Window positions below this are packed into the low bits of a hash for sorting.
_PACKED_BITS = 20


def repeated_words(w: Column) -> Column:
    """Number of words in 3-word windows that occur at least twice in the array.

    Windows are sorted by hash with their place in the low bits, so equal windows are neighbours, and neighbours of
    equal hash are compared word by word. If unlike neighbours have equal hashes, which could stand
    between equal windows, and in longer texts, windows are sorted by their words.
    """
    n_windows = F.greatest(F.size(w) - 2, F.lit(0))
    starts = F.slice(w, F.lit(1), n_windows)

    def window_hash(first: Column, i: Column) -> Column:
        return F.xxhash64(first, F.get(w, i + 1), F.get(w, i + 2))

    size = 1 << _PACKED_BITS
    packed = F.sort_array(F.transform(starts, lambda first, i: F.shiftleft(window_hash(first, i), _PACKED_BITS) + i.cast("long")))

    def by_words() -> Column:
        windows = F.transform(starts, lambda first, i: F.struct(first.alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i")))

        def equal(x: Column, y: Column) -> Column:
            return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

        return _hold(F.sort_array(windows), lambda s: _covered(s, equal, lambda x: x["i"]))

    def by_hash(s: Column) -> Column:
        def same_hash(x: Column, y: Column) -> Column:
            return F.coalesce(F.shiftright(x, _PACKED_BITS) == F.shiftright(y, _PACKED_BITS), F.lit(False))

        def place(x: Column) -> Column:
            return x.bitwiseAND(F.lit(size - 1)).cast("int")

        def same_words(x: Column, y: Column) -> Column:
            a, b = place(x), place(y)
            same = F.get(w, a) == F.get(w, b)
            for k in (1, 2):
                same = same & (F.get(w, a + k) == F.get(w, b + k))
            return F.coalesce(same, F.lit(False))

        clash = F.size(F.filter(s, lambda x, i: same_hash(x, F.get(s, i + 1)) & ~same_words(x, F.get(s, i + 1)))) > 0
        return F.when(clash, by_words()).otherwise(_covered(s, lambda x, y: same_hash(x, y) & same_words(x, y), place))

    return F.when(n_windows < size, _hold(packed, by_hash)).otherwise(by_words())


def _hold(arr: Column, then) -> Column:
    """Evaluate an array once and use it under a name inside a lambda."""
    return F.element_at(F.transform(F.array(arr), then), 1)


def _covered(s: Column, equal, place_of) -> Column:
    """Words covered by the windows that have an equal neighbour in the sorted array."""
    repeated = F.filter(s, lambda x, i: equal(x, F.get(s, i + 1)) | ((i > 0) & equal(x, F.get(s, i - 1))))
    places = F.sort_array(F.transform(repeated, place_of))
    # a window covers three words, fewer if the next one starts inside it
    return _hold(places, lambda p: F.aggregate(F.transform(p, lambda at, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - at, F.lit(3)))), F.lit(0), lambda a, b: a + b))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def failed_rule(line: Column, w: Column) -> Column:
    """Name of the first rule a line fails; null for a line that stays."""
    n = F.size(w)
    chars = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
    symbols = F.length(line) - F.length(F.regexp_replace(line, SYMBOLS, ""))
    bars = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    shouts = F.size(F.filter(w, lambda x: F.endswith(x, F.lit("!!"))))
    same = F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1))))
    ended = F.rlike(line, F.lit(END_MARK))
    return (
        F.when(share(symbols, chars) > SYMBOL_SHARE, "symbols")
        .when(share(shouts, n) >= SHOUT_SHARE, "shouting")
        .when((bars >= 3) | ((n < SHORT_LINE) & ~ended), "navigation")
        .when(F.rlike(line, F.lit(BOILERPLATE)), "boilerplate")
        .when((n > 3) & (share(same, n) >= SAME_SHARE), "monotony")
    )


def judged(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """All columns of the documents with lines judged, base figures, ``kept`` and ``cleaned`` under ``_judged``."""
    text = text_or_empty()
    base = docs.select(F.struct(*docs.columns).alias("_row"), text.alias("_text"), words(text).alias("_w"))
    lines = F.filter(F.transform(F.split("_text", "\n"), lambda x: F.struct(x.alias("line"), words(x).alias("w"))), lambda x: F.size(x["w"]) > 0)
    base = base.select("_row", "_text", "_w", lines.alias("_lines"))
    marked = F.transform("_lines", lambda x: F.struct(x["line"].alias("line"), F.size(x["w"]).alias("n"), failed_rule(x["line"], x["w"]).alias("rule")))
    base = base.select("_row", "_text", "_w", marked.alias("_lines"), repeated_words(F.col("_w")).alias("_repeat"))
    stay = F.filter("_lines", lambda x: x["rule"].isNull())
    kept_words = F.aggregate("_lines", F.lit(0), lambda a, x: a + F.when(x["rule"].isNull(), x["n"]).otherwise(F.lit(0)))
    base = base.select("_row", "_text", "_w", "_lines", "_repeat", kept_words.alias("_kept_words"), stay.alias("_stay"))
    n = F.size("_w")
    failed = (n < LEAST_WORDS) | (100 * F.col("_repeat").cast("long") > REPEATED_PERCENT * n.cast("long"))
    lost = share(n - F.col("_kept_words"), n)
    quality = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct(F.col("_lines")["line"]))).cast("long").alias("n_dup_lines"),
        F.col("_repeat").cast("long").alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_stay")).cast("long").alias("n_failed_lines"),
        F.col("_kept_words").cast("long").alias("kept_words"),
        (~failed & (lost <= most_lost)).alias("kept"),
        F.array_join(F.col("_stay")["line"], "\n").alias("cleaned"),
    )
    return base.select("_row", quality.alias("_judged")).select("_row.*", "_judged")


def cleaned_documents(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """Documents that are kept, their text without the failed lines; other columns as they were."""
    names = docs.columns
    return judged(docs, most_lost).where("_judged.kept").select(*[F.col("_judged.cleaned").alias("text") if c == "text" else F.col(c) for c in names])


def quality_digest(docs: DataFrame) -> DataFrame:
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_failed_lines", "kept_words", "kept"]
    rows = judged(docs.select("doc_id", "text"))
    return rows.select("doc_id", *[f"_judged.{c}" for c in figures])
