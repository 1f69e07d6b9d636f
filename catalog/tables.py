"""HTML tables and the corpora made from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import PART_CELLS_SQL, PAPERS_SQL, html_lines, papers, part_tables, payloads, span_tables

from catalog.registry import query, table
from catalog.sources import PAYLOAD_SQL
from catalog.text import row_corpus_sql, terms_sql
from gridmine.functions import html
from gridmine.operators.unnest import grid_cells
from gridmine.plans import corpora
from gridmine.plans.labelled import unwound


@query(
    "h1_clean_html",
    """SELECT page_id, regexp_replace(replace(replace(html, '"', ''), chr(10), ' '), '<(/?)th([ >])', '<\\1td\\2', 'g') AS html FROM pages""",
)
def h1(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.clean_table_html("html").alias("html"))


_LINES_SQL = """lines AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line
  FROM (SELECT *, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents))"""


@query(
    "h2_body_grid",
    f"""WITH {_LINES_SQL} SELECT doc_id, i::INTEGER AS row, 0 AS col, i::VARCHAR AS value FROM lines
    UNION ALL SELECT doc_id, i::INTEGER, 1, replace(line, '"', '') FROM lines""",
)
def h2(spark, sf):
    """Whole texts as tables of lines, escaped, parsed back."""
    grids = html_lines(spark, sf).select("doc_id", html.html_grid("html").alias("grid"))
    return grid_cells(grids, "grid", keys=("doc_id",))


@query(
    "h3_span_fill",
    """SELECT p_partkey, r AS row, c AS col, CASE c WHEN 0 THEN p_name WHEN 1 THEN CASE r WHEN 1 THEN p_size::VARCHAR ELSE p_type END
      ELSE CASE r WHEN 1 THEN p_brand ELSE p_type END END AS value
    FROM part, (SELECT unnest([1, 2]) AS r), (SELECT unnest([0, 1, 2]) AS c)""",
)
def h3(spark, sf):
    grids = span_tables(spark, sf).select("p_partkey", html.html_grid("html", "fill").alias("grid"))
    return grid_cells(grids, "grid", keys=("p_partkey",))


@query(
    "h3_span_fill_first_free",
    """SELECT p_partkey, r AS row, c AS col, CASE c WHEN 0 THEN p_name WHEN 1 THEN CASE r WHEN 1 THEN p_size::VARCHAR ELSE p_type END
      ELSE CASE r WHEN 1 THEN p_brand ELSE p_type END END AS value
    FROM part, (SELECT unnest([1, 2]) AS r), (SELECT unnest([0, 1, 2]) AS c)""",
)
def h3_slots(spark, sf):
    grids = span_tables(spark, sf).select("p_partkey", html.html_grid("html", "slots").alias("grid"))
    return grid_cells(grids, "grid", keys=("p_partkey",))


@query(
    "h4_header_paths",
    """SELECT p_partkey, ' : Dose : mg/ : Dose : ml/ : Age : Age' AS leading, 'Dose : mg/Dose : ml/Age' AS colon, 'Dose mg/Dose ml/Age' AS space FROM part""",
)
def h4(spark, sf):
    tables = span_tables(spark, sf)
    return tables.select(
        "p_partkey",
        *[F.array_join(html.html_header("html", "fill", style), "/").alias(style) for style in ("leading", "colon", "space")],
    )


@query(
    "h5_parse_table",
    f"""WITH {PART_CELLS_SQL} SELECT paper_id, row, col, header, value FROM part_cells
    UNION ALL SELECT 'page ' || page_id::VARCHAR, NULL, NULL, NULL, NULL FROM pages""",
)
def h5(spark, sf):
    """Tables as cells; pages hold no table and give a row without one."""
    pages = table(spark, sf, "pages").select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("paper_id"), "html")
    markup = part_tables(spark, sf).select("paper_id", "html").unionByName(pages)
    parsed = markup.select("paper_id", html.parse_table("html").alias("t")).select("paper_id", "t.*")
    cells = grid_cells(parsed, "rows", "header", ("paper_id",), outer=True)
    return cells.select("paper_id", "row", "col", "header", "value")


@query(
    "q7_row_corpus",
    f"""WITH {PART_CELLS_SQL}, normal AS (
      SELECT paper_id, row, col, {row_corpus_sql('header')} || ' ' || {row_corpus_sql("coalesce(value, '0')")} AS part FROM part_cells)
    SELECT paper_id, (row - 1)::INTEGER AS row, string_agg(part, ' [SEP] ' ORDER BY col) AS line FROM normal GROUP BY paper_id, row""",
)
def q7(spark, sf):
    parsed = part_tables(spark, sf).select("paper_id", html.parse_table("html", "fill", "space").alias("t")).select("paper_id", "t.*")
    return corpora.row_corpus(parsed, ("paper_id",))


# Tables of papers: header = words with a comma, data = sentences x words.
_UNIT_TABLES_SQL = f"""{PAPERS_SQL}, base AS (
  SELECT _id, table_id, sents, list_filter(flatten(list_transform(sents, lambda s: string_split(s, ' '))), lambda w: contains(w, ',')) AS h
  FROM (SELECT _id, table_id, string_split(caption, '. ') AS sents FROM tables WHERE contains(caption, ' the '))
), cells AS (
  SELECT _id, table_id, i::INTEGER AS row, (j - 1)::INTEGER AS col, h[j] AS header, ws[j] AS value FROM (
    SELECT *, unnest(generate_series(1, len(ws))) AS j FROM (
      SELECT *, string_split(sents[i], ' ') AS ws FROM (SELECT *, unnest(generate_series(1, len(sents))) AS i FROM base)))
)"""


def _unit_tables(spark, sf):
    verified = unwound(papers(spark, sf, ("cl_verified", "cl_HMD", "Data")), ("cl_verified", "cl_HMD", "Data")).filter(F.col("t.cl_verified") == 1)
    tables = verified.select(
        F.col("id").alias("_id"), "table_id", F.col("t.cl_HMD").alias("cl_HMD"), F.col("t.Data").alias("cl_DATA")
    )
    return corpora.unit_tables(tables, ("_id", "table_id"))


@query("q9_unit_tables_cells", f"WITH {_UNIT_TABLES_SQL} SELECT _id, table_id, row, col, header, value FROM cells")
def q9(spark, sf):
    """No unit stands between blanks inside a single word, so cells pass unchanged."""
    return _unit_tables(spark, sf)[0].select("_id", "table_id", "row", "col", "header", "value")


@query(
    "q9_unit_tables_dictionary",
    """SELECT attribute, lo, hi, unit, 'unq_tkn_' || (row_number() OVER (ORDER BY seen, attribute, lo, hi, unit) - 1)::VARCHAR AS token FROM (
      SELECT 'Mean age years group' AS attribute, p_size::VARCHAR AS lo, (p_size + 5)::VARCHAR AS hi, 'years' AS unit, min(p_partkey::VARCHAR) AS seen
      FROM part GROUP BY p_size)""",
)
def q9_dictionary(spark, sf):
    return _part_unit_tables(spark, sf)[1]


def _part_unit_tables(spark, sf):
    parsed = part_tables(spark, sf).select("paper_id", "table_id", html.parse_table("html").alias("t"))
    tables = parsed.select("paper_id", "table_id", F.array("t.header").alias("cl_HMD"), F.col("t.rows").alias("cl_DATA"))
    return corpora.unit_tables(tables, ("paper_id", "table_id"))


@query(
    "q9_unit_tables_completed_cells",
    f"""WITH {PART_CELLS_SQL} SELECT paper_id, table_id, row, col, header,
      CASE col WHEN 1 THEN value || ' years' WHEN 2 THEN value || ' mg/ml' ELSE value END AS value FROM part_cells WHERE value IS NOT NULL""",
)
def q9_completed(spark, sf):
    """Headers that name a unit complete the cells below them."""
    return _part_unit_tables(spark, sf)[0].select("paper_id", "table_id", "row", "col", "header", "value")


@query(
    "q9_unit_tables_mixed_tokens",
    f"""WITH {_UNIT_TABLES_SQL}, texts AS (SELECT _id, table_id, unnest(h) AS t FROM base UNION ALL SELECT _id, table_id, value FROM cells)
    SELECT _id, table_id, token, count(*) AS n FROM (
      SELECT _id, table_id, unnest(regexp_extract_all(t, '[a-zA-Z]+[0-9]+[a-zA-Z0-9]*|[a-zA-Z]*[0-9]+[a-zA-Z]+')) AS token FROM texts) GROUP BY 1, 2, 3""",
)
def q9_mixed(spark, sf):
    mixed = _unit_tables(spark, sf)[2]
    return mixed.groupBy("_id", "table_id", "token").agg(F.count("*").alias("n"))


@query(
    "q12_header_data_rows",
    f"""WITH {PAYLOAD_SQL}, drawn AS (
      SELECT id, headers, arg_min(x.text, md5(id::VARCHAR || '#' || x.line_no::VARCHAR || '|0')) AS text FROM payload WHERE x.tag = 'D' GROUP BY id, headers)
    SELECT id, 'data' AS kind, array_to_string({terms_sql('text')}, ' ') AS text FROM drawn WHERE headers = 1
    UNION ALL SELECT id, 'hmd', array_to_string({terms_sql('x.text')}, ' ') FROM payload WHERE headers = 1 AND x.tag = 'HMD'
    UNION ALL SELECT id, 'datarow', text FROM drawn WHERE headers = 2""",
)
def q12(spark, sf):
    return corpora.header_data_rows(payloads(spark, sf), "id", "headers", "blob")
