"""Numbers, ranges, units."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.aggregates import TOKEN_SQL
from catalog.fixtures import PART_CELLS_SQL, numeric_cells, part_tables
from catalog.registry import query, table
from gridmine.functions import numbers
from gridmine.functions.html import parse_table
from gridmine.operators.unnest import grid_cells
from gridmine.plans.corpora import header_lines, range_token_corpus, tokenise_numbers, unit_cells
from gridmine.session import spread

# Blank-delimited text with whole numbers, one-decimal and two-decimal numbers.

_PLAIN = "p_size::VARCHAR || ' a ' || p_retailprice::VARCHAR || ' 0 x' || p_size::VARCHAR || ' ' || p_size::VARCHAR || '.25'"


def _interval(x: str) -> str:
    spread = f"abs(CASE WHEN ({x})::DOUBLE = 0 THEN 1.0::DOUBLE ELSE ({x})::DOUBLE END * 10.0::DOUBLE / 100.0::DOUBLE)"
    return f"'[' || printf('%.1f', ({x})::DOUBLE - {spread}) || '|' || printf('%.1f', ({x})::DOUBLE + {spread}) || ']'"


@query(
    "n11_numbers_to_intervals",
    f"""SELECT p_partkey, {_interval('p_size')} || ' a ' || {_interval('p_retailprice')} || ' ' || {_interval('0')} || ' x' || p_size::VARCHAR
      || ' ' || {_interval("p_size::VARCHAR || '.25'")} AS line FROM part""",
)
def n11(spark, sf):
    size, price = F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")
    line = F.concat(size, F.lit(" a "), price, F.lit(" 0 x"), size, F.lit(" "), size, F.lit(".25"))
    return spread(table(spark, sf, "part")).select("p_partkey", numbers.numbers_to_intervals(line).alias("line"))


@query(
    "n12_format_ranges",
    """SELECT p_partkey, 'x ' || printf('%.1f', p_size::DOUBLE) || '-' || printf('%.1f', (p_size::VARCHAR || '.35')::DOUBLE) || ' y '
      || printf('%.1f', p_retailprice) || '-' || printf('%.1f', (p_size::VARCHAR || '.25')::DOUBLE) AS line FROM part""",
)
def n12(spark, sf):
    size, price = F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")
    line = F.concat(F.lit("x "), size, F.lit("-"), size, F.lit(".35 y "), price, F.lit("-"), size, F.lit(".25"))
    return table(spark, sf, "part").select("p_partkey", numbers.format_ranges(line).alias("line"))


def unit_sql(c: str, units: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '\\s{u}\\s', 'i') THEN '{u}'" for u in units) + " END"


# A text per part whose unit changes with the size, in mixed case and sometimes at the border.
_UNIT_TEXTS = ["years", "MG/ML", "g l-1", "Cm", "mggh/l", "mg*h/l", "kg", "mg"]
_UNIT_LIST = "[" + ", ".join(f"'{u}'" for u in _UNIT_TEXTS) + "]"
_UNIT_CELL_SQL = f"p_name || ' ' || {_UNIT_LIST}[p_size % 8 + 1] || CASE WHEN p_size % 5 = 0 THEN '' ELSE ' ' || {_UNIT_LIST}[p_partkey % 8 + 1] || ' ' END"


@query(
    "n13_detect_unit",
    f"""SELECT p_partkey, {unit_sql('c', numbers.UNITS_LONG)} AS long, {unit_sql('c', numbers.UNITS_COLUMN)} AS col, {unit_sql('c', numbers.UNITS_SHORT)} AS short
    FROM (SELECT p_partkey, {_UNIT_CELL_SQL} AS c FROM part)""",
)
def n13(spark, sf):
    units = F.array(*[F.lit(u) for u in _UNIT_TEXTS])
    tail = F.when(F.col("p_size") % 5 == 0, "").otherwise(
        F.concat(F.lit(" "), F.element_at(units, (F.col("p_partkey") % 8 + 1).cast("int")), F.lit(" "))
    )
    cells = table(spark, sf, "part").select(
        "p_partkey", F.concat("p_name", F.lit(" "), F.element_at(units, F.col("p_size") % 8 + 1), tail).alias("c")
    )
    return cells.select(
        "p_partkey",
        numbers.detect_unit("c", numbers.UNITS_LONG).alias("long"),
        numbers.detect_unit("c", numbers.UNITS_COLUMN).alias("col"),
        numbers.detect_unit("c", numbers.UNITS_SHORT).alias("short"),
    )


@query(
    "n14_resolve_unit",
    f"""WITH {PART_CELLS_SQL}, u AS (SELECT paper_id, row, col, {unit_sql('header', numbers.UNITS_SHORT)} AS h, {unit_sql('value', numbers.UNITS_SHORT)} AS c FROM part_cells)
    SELECT paper_id, row, col, coalesce(h, c, 'unknown') AS header_first, coalesce(c, h, 'UNKNOWN') AS cell_first FROM u""",
)
def n14(spark, sf):
    h, c = numbers.detect_unit("header", numbers.UNITS_SHORT), numbers.detect_unit("value", numbers.UNITS_SHORT)
    return _part_cells(spark, sf).select(
        "paper_id",
        "row",
        "col",
        numbers.resolve_unit(h, c, "header", "unknown").alias("header_first"),
        numbers.resolve_unit(h, c, "cell", "UNKNOWN").alias("cell_first"),
    )


def _part_cells(spark, sf):
    parsed = part_tables(spark, sf).select("paper_id", "table_id", parse_table("html").alias("t"))
    return grid_cells(parsed.select("paper_id", "table_id", "t.*"), "rows", "header", ("paper_id", "table_id"))


@query(
    "n15_add_unit",
    f"""WITH {PART_CELLS_SQL} SELECT paper_id, row, col, CASE col WHEN 1 THEN value || ' years' WHEN 2 THEN value || ' mg/ml' ELSE value END AS value FROM part_cells""",
)
def n15(spark, sf):
    unit = numbers.detect_unit("header", numbers.UNITS_LONG)
    return _part_cells(spark, sf).select("paper_id", "row", "col", numbers.add_unit("value", unit).alias("value"))


@query(
    "n16_find_ranges",
    """SELECT p_partkey, 0 AS pos, p_size::VARCHAR AS lo, (p_size + 5)::VARCHAR AS hi FROM part
    UNION ALL SELECT p_partkey, 1, p_retailprice::VARCHAR, p_size::VARCHAR || '.5' FROM part""",
)
def n16(spark, sf):
    size = F.col("p_size").cast("string")
    cell = F.concat(
        F.lit("from "), size, F.lit("-"), (F.col("p_size") + 5).cast("string"), F.lit(" (IL-6, p"), size, F.lit("-1) or "),
        F.col("p_retailprice").cast("string"), F.lit("–"), size, F.lit(".5%"),
    )
    found = table(spark, sf, "part").select("p_partkey", F.posexplode(numbers.find_ranges(cell)).alias("pos", "r"))
    return found.select("p_partkey", "pos", "r.lo", "r.hi")


_NUMBERS = ["p_size::VARCHAR", "'-' || (p_size + 5)::VARCHAR", "p_retailprice::VARCHAR", "p_size::VARCHAR", "p_size::VARCHAR", "'0.5'", "'-3'", "'7'", "'12'", "'2020'", "p_size::VARCHAR", "'2'", "'5'"]


@query(
    "n17_find_numbers",
    f"SELECT p_partkey, (i - 1)::INTEGER AS pos, [{', '.join(_NUMBERS)}][i] AS number FROM part, (SELECT unnest(generate_series(1, {len(_NUMBERS)})) AS i)",
)
def n17(spark, sf):
    return numeric_cells(spark, sf).select("p_partkey", F.posexplode(numbers.find_numbers("cell")).alias("pos", "number"))


@query(
    "n18_letter_digit_tokens",
    """SELECT p_partkey, 'IL' || p_size::VARCHAR AS token FROM part UNION ALL SELECT p_partkey, '5mg' FROM part""",
)
def n18(spark, sf):
    return numeric_cells(spark, sf).select("p_partkey", F.explode(numbers.find_alnum_mix("cell")).alias("token"))


@query(
    "n19_range_token",
    f"SELECT p_partkey, {TOKEN_SQL} AS token FROM (SELECT p_partkey, sha256(p_type || '|years|' || p_size::DOUBLE::VARCHAR || '|' || p_retailprice::VARCHAR) AS h FROM part)",
)
def n19(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        numbers.range_token(
            F.col("p_type"), F.lit("years"), F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")
        ).alias("token"),
    )


_REST = "' years ' || p_retailprice::VARCHAR || ' mg/ml IL' || p_size::VARCHAR || ' n=' || p_size::VARCHAR || ', 0.5% -3 (7/12/2020) <' || p_size::VARCHAR || ' ~2 times 5mg/kg'"


@query(
    "n20_tokenise_ranges",
    f"""SELECT p_partkey, ' ' || {TOKEN_SQL} || ' ' || {_REST} AS cell FROM (
      SELECT *, sha256(p_type || '|years|' || p_size::VARCHAR || '.0|' || (p_size + 5)::VARCHAR || '.0') AS h FROM part)""",
)
def n20(spark, sf):
    cells = numeric_cells(spark, sf).withColumn("unit", numbers.detect_unit("cell", numbers.UNITS_SHORT))
    return cells.select("p_partkey", numbers.tokenise_ranges("cell", F.col("attribute"), F.col("unit")).alias("cell"))


# Tables of parts: ranges stand in row 1 of column 1 ("years"), single numbers in rows 2 and 3.
# The token of a number is that of the containing range with the smallest (lo, hi).
_DICTIONARY_SQL = "dict AS (SELECT DISTINCT p_size AS lo, p_size + 5 AS hi FROM part)"
_PLACED_SQL = f"""{PART_CELLS_SQL}, {_DICTIONARY_SQL}, nums AS (
  SELECT paper_id, row, col, value::INTEGER AS x FROM part_cells WHERE col = 1 AND row > 1
), best AS (
  SELECT paper_id, row, col, min(lo) AS lo FROM nums JOIN dict ON x BETWEEN lo AND hi GROUP BY paper_id, row, col
), placed AS (
  SELECT paper_id, row, col, sha256('Mean age years group|years|' || lo::VARCHAR || '.0|' || (lo + 5)::VARCHAR || '.0') AS h FROM best
)"""


@query(
    "n21_tokenise_numbers",
    f"""WITH {_PLACED_SQL} SELECT c.paper_id, c.row, c.col, CASE WHEN h IS NULL THEN value ELSE ' ' || {TOKEN_SQL} || ' ' END AS value
    FROM part_cells c LEFT JOIN placed USING (paper_id, row, col) WHERE value IS NOT NULL""",
)
def n21(spark, sf):
    cells = unit_cells(_part_cells(spark, sf), numbers.UNITS_SHORT).filter(F.col("value").isNotNull())
    ranges = table(spark, sf, "part").select(
        F.lit("Mean age years group").alias("attribute"),
        F.lit("years").alias("unit"),
        F.col("p_size").cast("string").alias("lo"),
        (F.col("p_size") + 5).cast("string").alias("hi"),
    ).distinct()
    return tokenise_numbers(cells, ranges, ["paper_id", "table_id", "row", "col"]).select("paper_id", "row", "col", "value")


@query(
    "q8_range_token_corpus",
    f"""WITH {_PLACED_SQL}, ranged AS (
      SELECT paper_id, row, col, sha256('Mean age years group|years|' || string_split(value, '-')[1] || '.0|' || string_split(value, '-')[2] || '.0') AS h
      FROM part_cells WHERE col = 1 AND row = 1
    ), all_tokens AS (SELECT * FROM placed UNION ALL SELECT * FROM ranged)
    SELECT c.paper_id, c.row, c.col, header, CASE WHEN h IS NULL THEN value ELSE ' ' || {TOKEN_SQL} || ' ' END AS value
    FROM part_cells c LEFT JOIN all_tokens USING (paper_id, row, col) WHERE value IS NOT NULL""",
)
def q8(spark, sf):
    parsed = part_tables(spark, sf).select("paper_id", "table_id", parse_table("html").alias("t")).select("paper_id", "table_id", "t.*")
    cells, _ = range_token_corpus(parsed, ("paper_id", "table_id"))
    return cells.select("paper_id", "row", "col", "header", "value")


@query(
    "q8_range_token_dictionary",
    f"""SELECT 'Mean age years group' AS attribute, 'years' AS unit, lo, hi, {TOKEN_SQL} AS token FROM (
      SELECT lo::VARCHAR AS lo, hi::VARCHAR AS hi, sha256('Mean age years group|years|' || lo::VARCHAR || '.0|' || hi::VARCHAR || '.0') AS h
      FROM (SELECT DISTINCT p_size AS lo, p_size + 5 AS hi FROM part))""",
)
def q8_dictionary(spark, sf):
    parsed = part_tables(spark, sf).select("paper_id", "table_id", parse_table("html").alias("t")).select("paper_id", "table_id", "t.*")
    return range_token_corpus(parsed, ("paper_id", "table_id"))[1]


# Tables arrive in the order of paper_id; a range is known to its own table and to later ones.
_SEEN_SQL = f"""{PART_CELLS_SQL}, dict AS (SELECT p_size AS lo, p_size + 5 AS hi, min(p_partkey::VARCHAR) AS seen FROM part GROUP BY p_size), nums AS (
  SELECT paper_id, row, col, value::INTEGER AS x FROM part_cells WHERE col = 1 AND row > 1
), best AS (
  SELECT paper_id, row, col, min(lo) AS lo FROM nums JOIN dict ON x BETWEEN lo AND hi AND seen <= paper_id GROUP BY paper_id, row, col
), tokens AS (
  SELECT paper_id, row, col, sha256('Mean age years group|years|' || lo::VARCHAR || '.0|' || (lo + 5)::VARCHAR || '.0') AS h FROM best
  UNION ALL SELECT paper_id, row, col, sha256('Mean age years group|years|' || string_split(value, '-')[1] || '.0|' || string_split(value, '-')[2] || '.0')
  FROM part_cells WHERE col = 1 AND row = 1
)"""


@query(
    "q8_range_token_corpus_as_seen",
    f"""WITH {_SEEN_SQL} SELECT c.paper_id, c.row, c.col, header, CASE WHEN h IS NULL THEN value ELSE ' ' || {TOKEN_SQL} || ' ' END AS value
    FROM part_cells c LEFT JOIN tokens USING (paper_id, row, col) WHERE value IS NOT NULL""",
)
def q8_as_seen(spark, sf):
    parsed = part_tables(spark, sf).select("paper_id", "table_id", parse_table("html").alias("t")).select("paper_id", "table_id", "t.*")
    cells, _ = range_token_corpus(parsed, ("paper_id", "table_id"), as_seen=True)
    return cells.select("paper_id", "row", "col", "header", "value")


@query(
    "q8_header_lines",
    f"""WITH {PART_CELLS_SQL} SELECT paper_id, string_agg(header, ' ' ORDER BY col) AS line FROM part_cells WHERE row = 1 GROUP BY paper_id""",
)
def q8_headers(spark, sf):
    parsed = part_tables(spark, sf).select("paper_id", parse_table("html").alias("t")).select("paper_id", "t.*")
    return header_lines(parsed, ("paper_id",))


@query(
    "n24_parse_interval",
    """SELECT p_partkey, p_size::DOUBLE AS lo, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_retailprice END AS hi FROM part""",
)
def n24(spark, sf):
    hi = F.when(F.col("p_size") % 10 == 0, F.lit("n/a")).otherwise(F.col("p_retailprice").cast("string"))
    literal = F.concat(F.lit(" ["), F.col("p_size").cast("string"), F.lit("|"), hi, F.lit("]\n"))
    parsed = table(spark, sf, "part").select("p_partkey", numbers.parse_interval(F.rtrim(F.translate(literal, "\n", ""))).alias("i"))
    return parsed.select("p_partkey", "i.lo", "i.hi")


@query(
    "n25_parse_vector",
    """SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN NULL ELSE round(list_sum((embedding::DOUBLE[])[1:60]), 6) + 0.0 END AS total,
      CASE WHEN vec_id % 10 = 0 THEN NULL ELSE 60 END::BIGINT AS dims, label::VARCHAR || '/x' AS cells FROM embeddings""",
)
def n25(spark, sf):
    """Vector literals without closing bracket, every tenth unreadable, and a grid literal."""
    v = F.col("embedding").cast("array<double>").cast("array<string>")
    literal = F.when(F.col("vec_id") % 10 == 0, F.lit("[0.1, oops")).otherwise(F.concat(F.lit("["), F.array_join(v, ", ")))
    vector = numbers.parse_vector(literal, 60)
    grid = numbers.parse_grid(F.concat(F.lit("[['"), F.col("label").cast("string"), F.lit("'], ['x']]")))
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.round(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x), 6).alias("total"),
        F.when(vector.isNotNull(), F.size(vector)).cast("long").alias("dims"),
        F.array_join(F.flatten(grid), "/").alias("cells"),
    )
