"""Ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import LINE_ORDER, TOKENS_SQL, interval_lines
from catalog.registry import query, table
from catalog.similarity import token_vector_sql
from gridmine.operators import ordering, tokens as token_ops
from gridmine.operators.embed import tokens_vector_shown
from gridmine.session import spread

_ORDER = ", ".join(LINE_ORDER)


@query(
    "w1_consecutive_pairs",
    f"""SELECT * FROM (SELECT l_orderkey, l_linenumber, l_quantity, lead(l_orderkey) OVER (ORDER BY {_ORDER}) AS next_l_orderkey,
      lead(l_quantity) OVER (ORDER BY {_ORDER}) AS next_l_quantity FROM lineitem) WHERE next_l_orderkey IS NOT NULL""",
)
def w1(spark, sf):
    lines = interval_lines(spark, sf).select(*LINE_ORDER)
    pairs = ordering.with_next(lines, LINE_ORDER, ["l_orderkey", "l_quantity"])
    return pairs.select("l_orderkey", "l_linenumber", "l_quantity", "next_l_orderkey", "next_l_quantity")


@query(
    "w2_topk_with_ties",
    """SELECT l_returnflag, l_orderkey, l_quantity, rk AS rank FROM (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC)::INTEGER AS rk FROM lineitem)
    WHERE rk <= 10""",
)
def w2(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_quantity")
    return ordering.topk_ties(lines, ["l_returnflag"], 10, "l_quantity", rank="rank")


@query(
    "w3_every_nth",
    "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 1000 = 0)::INTEGER AS is_validation FROM orders",
)
def w3(spark, sf):
    return ordering.every_nth(table(spark, sf, "orders").select("o_orderkey"), 1000, ["o_orderkey"])


# Sub-words: every token of even position whose word is longer than 4 is split "abcd" + "##rest".
PIECES_SQL = f"""{TOKENS_SQL}, pieces AS (
  SELECT doc_id, pos * 2 + k AS pos, token AS word, CASE k WHEN 0 THEN token[1:4] ELSE '##' || token[5:] END AS token
  FROM toks, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR length(token) > 4
)"""


_MERGE_DIMS = 300
_BLANKS = r"(?U)\s+"


def _items(spark, sf, split, keep=lambda t: F.lit(True)):
    """Every document as an array of (pos, token): each word cut into pieces by ``split``."""
    words = F.filter(F.split("text", _BLANKS), lambda t: t != "")
    numbered = F.filter(F.transform(words, lambda t, i: F.struct(i.alias("at"), t.alias("token"))), lambda x: keep(x["token"]))
    items = F.flatten(F.transform(numbered, split))
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", items.alias("items"))


#: First and last component of a mean vector, and two numbers that every component of it enters.
_SHOWN = ("first", "last", "total", "weighed")
_SHOWN_SQL = ", ".join(f"round(avg({n}), 6) + 0.0 AS {n}" for n in _SHOWN)


def _merged(df, runs):
    """Merged words as rows with the mean vector of their pieces, shown by four numbers; no shuffle."""
    rows = df.select("doc_id", F.explode(runs).alias("r")).select("doc_id", "r.*")
    rows = rows.withColumn("shown", tokens_vector_shown("parts", _MERGE_DIMS))
    numbers = [F.round(F.get("shown", i), 6).alias(n) for i, n in enumerate(_SHOWN)]
    return rows.select("doc_id", "pos", "token", "pieces", *numbers)


def _digests_sql(tokens: str) -> str:
    """digests(piece, first, last, total, weighed) of the distinct tokens of a query; those of a mean are the means of them."""
    return f"""digests AS (SELECT piece, v[1] AS first, v[{_MERGE_DIMS}] AS last, list_sum(v) AS total, list_sum(list_transform(v, lambda x, i: x * i)) AS weighed
      FROM (SELECT piece, {token_vector_sql('piece', _MERGE_DIMS)} AS v FROM (SELECT DISTINCT piece FROM ({tokens}))))"""


@query(
    "w4_merge_subwords",
    f"""WITH {PIECES_SQL}, {_digests_sql("SELECT token AS piece FROM pieces")}
      SELECT doc_id, min(pos)::INTEGER AS pos, any_value(word) AS token, count(*) AS pieces,
      {_SHOWN_SQL}
      FROM pieces JOIN digests ON piece = token GROUP BY doc_id, pos // 2""",
)
def w4(spark, sf):
    """Split words are put together again, with the mean of their piece vectors."""

    def split(x):
        first = F.struct((x["at"] * 2).alias("pos"), F.substring(x["token"], 1, 4).alias("token"))
        rest = F.struct((x["at"] * 2 + 1).alias("pos"), F.concat(F.lit("##"), F.substring(x["token"], 5, 1 << 30)).alias("token"))
        return F.when(F.length(x["token"]) > 4, F.array(first, rest)).otherwise(F.array(first))

    return _merged(_items(spark, sf, split), token_ops.subword_runs("items"))


# Bracket spans: every token ending in "." or "," stands as "[", word, sign, "]".
SPANS_SQL = f"""{TOKENS_SQL}, marked AS (
  SELECT doc_id, pos, token, (token LIKE '%,' OR token LIKE '%.') AND length(token) > 1 AS span FROM toks WHERE token NOT IN ('[', ']')
)"""


@query(
    "w5_merge_spans",
    f"""WITH {SPANS_SQL}, parts AS (
      SELECT doc_id, pos, CASE WHEN span THEN '[' || token || ']' ELSE token END AS token,
             unnest(CASE WHEN span THEN ['[', token[1:-2], token[-1:], ']'] ELSE [token] END) AS piece FROM marked),
    {_digests_sql("SELECT piece FROM parts")}
    SELECT doc_id, (pos * 4)::INTEGER AS pos, any_value(token) AS token, count(*) AS pieces,
      {_SHOWN_SQL}
    FROM parts JOIN digests USING (piece) GROUP BY doc_id, pos""",
)
def w5(spark, sf):
    def split(x):
        t, n = x["token"], F.length(x["token"])
        parts = F.array(F.lit("["), F.substring(t, F.lit(1), n - 1), F.substring(t, n, F.lit(1)), F.lit("]"))
        parts = F.when(F.rlike(t, F.lit("(?s).[.,]$")), parts).otherwise(F.array(t))
        return F.transform(parts, lambda p, k: F.struct((x["at"] * 4 + k).alias("pos"), p.alias("token")))

    items = _items(spark, sf, split, lambda t: ~t.isin("[", "]"))
    return _merged(items, token_ops.span_runs("items"))


@query(
    "w6_sequential_ids",
    "SELECT p_name, p_type, 'unq_tkn_' || (row_number() OVER (ORDER BY p_name, p_type) - 1)::VARCHAR AS token FROM (SELECT DISTINCT p_name, p_type FROM part)",
)
def w6(spark, sf):
    return ordering.assign_ids(table(spark, sf, "part").select("p_name", "p_type").distinct(), ["p_name", "p_type"])
