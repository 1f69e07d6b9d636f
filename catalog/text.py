"""Cleaning and normalisation profiles.

The SQL side has no look-arounds and ASCII word classes, so it spells both out:
``[\\p{L}\\p{N}_]`` for a word character, captured neighbours for look-behind, and a
second pass where a neighbour is shared by two matches.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import LISTS_SQL, NUMERIC_CELLS_SQL, TOKENS_SQL, numeric_cells, printed_lists
from catalog.registry import query, table
from gridmine.functions import text
from gridmine.plans.corpora import token_corpus

# Month names as the DATE patterns know them.
MONTHS = (
    "january|february|march|april|may|june|july|august|september|october|november|december"
    "|JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER"
    "|January|February|March|April|May|June|July|August|September|October|November|December"
)
W = r"[\p{L}\p{N}_]"
N = r"[0-9]"


def sub(expr: str, *rules: tuple[str, str]) -> str:
    for pattern, replacement in rules:
        pattern, replacement = pattern.replace("'", "''"), replacement.replace("'", "''")
        expr = f"regexp_replace({expr}, '{pattern}', '{replacement}', 'g')"
    return expr


def clean(expr: str) -> str:
    stripped = sub(f"translate({expr}, '[]''', '')", (r"^\s+|\s+$", ""))
    return sub(stripped, (r"\s*,\s*", " "))


def alnum(expr: str, sep: str) -> str:
    return (
        f"array_to_string(list_transform(list_filter(string_split({expr}, ' '), "
        f"lambda t: regexp_full_match(t, '[\\p{{L}}\\p{{N}}]+')), lambda t: lower(t)), '{sep}')"
    )


ZERO_QUOTED = (r"'0.0'|'0'", "ZERO")
RANGE_TO = (rf"{N}+(\.{N}+)?\s*\[\s*{N}+(\.{N}+)?\s*to\s*{N}+(\.{N}+)?\s*\]", "RANGE")
SMALLPOS = (r"(^|[^0-9])0[.][0-9]*", r"\1SMALLPOS")
FLOAT = (r"[0-9]+\.[0-9]*", "FLOAT")
INT = (r"(^|[^a-zA-Z|0-9.])[0-9]+($|[^0-9.a-zA-Z|])", r"\1INT\2")
MONTH = (rf"{W}*({MONTHS}){W}*", "DATE")
UNITTIME = (rf"{W}*(Year|year|time|times|Times|Time|days|Days){W}*", "UNITTIME")
UNIT_WORDS = [(r"[a-z|_]*/ml", "UNITML"), (r"[a-z|_]*/mg", "UNITMG"), (r"[a-z|_]*/kg", "UNITKG")]


def symbols(pad: str = "") -> list[tuple[str, str]]:
    return [("<", f"{pad}LESS{pad}"), (">", f"{pad}GREATER{pad}"), ("~", f"{pad}APPROX{pad}")]


def suffixes(pad: str = "") -> list[tuple[str, str]]:
    return [(rf"/{u}($|[^\p{{L}}\p{{N}}_])", f"{pad}{w}{pad}\\1") for u, w in (("mg", "UNITMG"), ("kg", "UNITKG"), ("ml", "UNITML"), ("L", "UNITL"))]


def erase_sql(c: str) -> str:
    e = sub(clean(sub(c, ZERO_QUOTED)), ZERO_QUOTED, RANGE_TO, (rf"-{N}+(\.{N}+)?", ""), (rf"{N}+(\.{N}+)?%", ""), (rf"0(\.{N}+)?", ""), (rf"{N}+(\.{N}+)?", ""))
    return alnum(sub(e, *symbols(), *suffixes(), UNITTIME, *UNIT_WORDS), ",")


def classes_sql(c: str) -> str:
    e = sub(clean(sub(c, ZERO_QUOTED)), ZERO_QUOTED, RANGE_TO, (rf"-{N}+(\.{N}+)?", "NEG"), (rf"0(\.{N}+)?", "SMALLPOS"), (rf"{N}+(\.{N}+)?", "FLOAT"))
    return alnum(sub(e, *symbols(), *suffixes(), UNITTIME, *UNIT_WORDS), " ")


def keep_numbers_sql(c: str) -> str:
    e = sub(clean(c), ("%", " PERCENT"), (rf"{N}{{1,2}}/{N}{{1,2}}/{N}{{4}}", " DATE "), *symbols(" "), *suffixes(" "))
    return alnum(sub(e, *[(p, f" {w} ") for p, w in UNIT_WORDS]), ",")


def classifier_sql(c: str) -> str:
    e = sub(clean(sub(c, ZERO_QUOTED)), (rf"[0-9]+\.?[0-9]*\s*-\s*[0-9]+\.?[0-9]*", "RANGE"), (rf"-{N}*\.?{N}*", "NEG"), SMALLPOS, FLOAT, INT, INT)
    return alnum(sub(e, ("%", "PERCENT"), MONTH, *symbols(), UNITTIME, *UNIT_WORDS), " ")


def row_corpus_sql(c: str) -> str:
    e = f"translate({c}, ',''\":', '')"
    bound = r"(^|[^\p{L}\p{N}_])"
    end = r"($|[^\p{L}\p{N}_])"
    # The shortest reading of the upper bound must end at a word border, as in the pattern.
    ranges = (rf"{bound}{N}+(\.{N}+)?[-–]{N}+(\.{N}+)?{end}", r"\1 RANGE \4")
    e = sub(e, ranges, ranges, (rf"{N}+:{N}+", " RATIO "), (rf"(\s)-{N}+(?:\.{N}+)?", r"\1 NEG "), SMALLPOS, FLOAT, INT, INT)
    e = sub(e, ("%", " PERCENT "), MONTH, *symbols(" "), UNITTIME, *UNIT_WORDS)
    return f"translate({e}, '[]'':', '')"


@query("n1_clean_list", f"WITH {LISTS_SQL} SELECT doc_id, {clean('data')} AS text FROM lists")
def n1(spark, sf):
    return printed_lists(spark, sf).select("doc_id", text.clean_list("data").alias("text"))


@query("n2_alnum_tokens", f"SELECT doc_id, {alnum('text', ' ')} AS spaced, {alnum('text', ',')} AS commas FROM documents")
def n2(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.alnum_tokens("text", "space").alias("spaced"), text.alnum_tokens("text", "comma").alias("commas")
    )


@query("n3_strip_characters", "SELECT doc_id, translate(text, ',''\":[]()', '') AS text FROM documents")
def n3(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.strip_chars("text", ",'\":[]()").alias("text"))


def _both(spark, sf, profile, sep=None):
    """Profile over whole texts and over numeric cells."""

    def out(c):
        normal = text.normalise(c, profile)
        return F.array_join(normal, sep) if sep else normal

    docs = printed_lists(spark, sf).select(F.lit("text").alias("kind"), F.col("doc_id").alias("id"), out("data").alias("line"))
    cells = numeric_cells(spark, sf).select(F.lit("cell").alias("kind"), F.col("p_partkey").alias("id"), out("cell").alias("line"))
    return docs.unionByName(cells)


def _both_sql(fn) -> str:
    return f"""WITH {LISTS_SQL}, {NUMERIC_CELLS_SQL}
    SELECT 'text' AS kind, doc_id AS id, {fn('data')} AS line FROM lists UNION ALL SELECT 'cell', p_partkey, {fn('cell')} FROM cells"""


@query("n4_profile_row_corpus", _both_sql(row_corpus_sql))
def n4(spark, sf):
    return _both(spark, sf, "row_corpus")


@query("n5_profile_erase", _both_sql(erase_sql))
def n5(spark, sf):
    return _both(spark, sf, "erase")


@query("n6_profile_classes", _both_sql(classes_sql))
def n6(spark, sf):
    return _both(spark, sf, "classes")


@query("n7_profile_keep_numbers", _both_sql(keep_numbers_sql))
def n7(spark, sf):
    return _both(spark, sf, "keep_numbers")


@query("n8_profile_classifier", _both_sql(classifier_sql))
def n8(spark, sf):
    return _both(spark, sf, "classifier", " ")


@query("n8_profile_raw", _both_sql(lambda c: alnum(clean(c), " ")))
def n8_raw(spark, sf):
    return _both(spark, sf, "raw", " ")


def term_sql(t: str) -> str:
    e = sub(t, (rf"-{N}+(\.{N}+)?", "NEG"), (rf"{N}+(\.{N}+)?%", "PERCENT"), (rf"{N}+(\.{N}+)?", "FLOAT"), *symbols(), *suffixes(), UNITTIME, *UNIT_WORDS)
    return f"lower({sub(e, (r'[^\p{L}\p{N}_]', ''))})"


def terms_sql(c: str) -> str:
    return (
        f"list_transform(list_filter(regexp_split_to_array(translate({c}, '[]()''', ''), '[,\\s]+'), lambda t: t <> ''), "
        f"lambda t: {term_sql('t')})"
    )


@query("n9_terms", _both_sql(lambda c: f"array_to_string({terms_sql(c)}, ' ')"))
def n9(spark, sf):
    docs = printed_lists(spark, sf).select(
        F.lit("text").alias("kind"), F.col("doc_id").alias("id"), F.array_join(text.terms("data"), " ").alias("line")
    )
    cells = numeric_cells(spark, sf).select(
        F.lit("cell").alias("kind"), F.col("p_partkey").alias("id"), F.array_join(text.terms("cell"), " ").alias("line")
    )
    return docs.unionByName(cells)


def term_v0_sql(c: str) -> str:
    bound, end = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
    zero = (rf"{bound}(0\.0|0){end}", r"\1ZERO\3")
    return sub(
        c, zero, zero, (rf"{N}+(\.{N}+)?\s*-\s*{N}+(\.{N}+)?", "RANGE"), (rf"-{N}+(\.{N}+)?", "NEG"), (rf"{N}+(\.{N}+)?%", "PERCENT"),
        (rf"0(\.{N}+)?", "SMALLPOS"), (rf"{N}{{1,2}}/{N}{{1,2}}/{N}{{4}}", "DATE"), *symbols(), *suffixes(), UNITTIME, *UNIT_WORDS,
    )


@query("n9_terms_early_variant", _both_sql(term_v0_sql))
def n9_v0(spark, sf):
    return _both(spark, sf, "term_v0")


@query(
    "n22_prefix",
    "SELECT doc_id, replace(text[1:64], ',', ' ') AS head FROM documents",
)
def n22(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.prefix("text", 64).alias("head"))


@query(
    "n23_pad",
    f"""WITH {TOKENS_SQL}, last AS (SELECT doc_id, pos, length(token) AS x, max(pos) OVER (PARTITION BY doc_id) AS m FROM toks)
    SELECT doc_id, (pos - greatest(0, m - 99))::INTEGER AS i, x::BIGINT AS x FROM last WHERE pos > m - 100
    UNION ALL SELECT doc_id, (m + 1 + k)::INTEGER, 0 FROM (SELECT doc_id, m, unnest(generate_series(0, 98 - m)) AS k FROM (SELECT DISTINCT doc_id, m FROM last) WHERE m < 99)""",
)
def n23(spark, sf):
    tokens = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    docs = table(spark, sf, "documents").select("doc_id", F.transform(tokens, lambda t: F.length(t).cast("long")).alias("ids"))
    return docs.filter(F.size("ids") > 0).select("doc_id", F.posexplode(text.pad("ids", 100)).alias("i", "x"))


CORPUS = ["data", "meta_h", "meta_v"]


def _corpus_sql(fn, tail: str = "") -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {fn(c)} AS line FROM lists" for c in CORPUS)
    return f"WITH {LISTS_SQL}{tail} SELECT DISTINCT \"column\", line FROM ({parts}) WHERE NOT contains(line, 'nan') AND trim(line, ' ') <> ''"


@query("q10_token_corpus_erase", _corpus_sql(erase_sql))
def q10(spark, sf):
    return token_corpus(printed_lists(spark, sf), CORPUS, "erase")


@query("q10_token_corpus_classes", _corpus_sql(classes_sql))
def q10_classes(spark, sf):
    return token_corpus(printed_lists(spark, sf), CORPUS, "classes")


def _intervals_sql(line: str) -> str:
    """Tokens between commas that are whole numbers, +-10 % with one decimal."""
    number = "regexp_full_match(t, '[0-9]+')"
    lo, hi = (f"printf('%.1f', t::DOUBLE {s} abs(CASE WHEN t::DOUBLE = 0 THEN 1 ELSE t::DOUBLE END * 10.0 / 100.0))" for s in "-+")
    return f"array_to_string(list_transform(string_split({line}, ','), lambda t: CASE WHEN {number} THEN '[' || {lo} || '|' || {hi} || ']' ELSE t END), ',')"


@query(
    "q10_token_corpus_intervals",
    f'SELECT "column", {_intervals_sql("line")} AS line FROM ({_corpus_sql(keep_numbers_sql)})',
)
def q10_intervals(spark, sf):
    return token_corpus(printed_lists(spark, sf), CORPUS, "keep_numbers", intervals=True)
