"""Predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import (
    PAPERS_SQL,
    PART_CELLS_SQL,
    TOPIC,
    VIRUS,
    interval_lines,
    papers,
    part_tables,
    sql_any,
    sql_path,
    word_vectors,
)
from catalog.registry import query, table
from gridmine.functions import predicates as pr
from gridmine.functions.html import parse_table
from gridmine.operators import joins
from gridmine.operators.unnest import grid_cells, unwind
from gridmine.plans.labelled import KeywordQuery, any_table, keyword_filter, topic_paths


@query(
    "f1_not_empty",
    f"""WITH {PAPERS_SQL} SELECT _id, captions IS NULL OR len(captions) > 0 AS passes,
        captions IS NOT NULL AND len(captions) > 0 AS present FROM papers""",
)
def f1(spark, sf):
    return papers(spark, sf, ()).select(
        "_id", pr.not_empty("tables").alias("passes"), pr.not_empty("tables", missing_passes=False).alias("present")
    )


@query(
    "f2_regex",
    "SELECT doc_id FROM documents WHERE regexp_matches(text, 'license', 'i') OR regexp_matches(text, 'THE', 'c')",
)
def f2(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.filter(pr.rx("text", "license", True) | pr.rx("text", "THE")).select("doc_id")


@query("f3_regex_any", f"SELECT doc_id FROM documents WHERE {sql_any('text', TOPIC)}")
def f3(spark, sf):
    return table(spark, sf, "documents").filter(pr.rx_any("text", TOPIC)).select("doc_id")


@query("f4_path_any", f"WITH {PAPERS_SQL} SELECT _id FROM papers WHERE {sql_path('abstract', TOPIC)}")
def f4(spark, sf):
    return papers(spark, sf, ()).filter(pr.rx_path_any("abstract", "text", TOPIC)).select("_id")


@query(
    "f5_none_matches",
    f"WITH {PAPERS_SQL} SELECT _id FROM papers WHERE NOT {sql_path('captions', TOPIC)} AND NOT {sql_any('title', VIRUS)}",
)
def f5(spark, sf):
    return papers(spark, sf, ()).filter(pr.rx_none("tables.tableCaption", TOPIC) & pr.rx_none("title", VIRUS)).select("_id")


TOPIC_SQL = f"({sql_any('title', TOPIC)} OR {sql_path('abstract', TOPIC)} OR {sql_path('captions', TOPIC)} OR {sql_path('figures', TOPIC)})"
VIRUS_SQL = f"({sql_any('title', VIRUS)} OR {sql_path('abstract', VIRUS)})"
POSITIVE = KeywordQuery(any=(topic_paths(TOPIC), {"title": VIRUS, "abstract.text": VIRUS}))
NEGATIVE = KeywordQuery(none=(topic_paths(TOPIC), {"title": VIRUS, "abstract.text": VIRUS}))


@query(
    "f6_keyword_tree",
    f"""WITH {PAPERS_SQL} SELECT _id, title FROM papers
    WHERE (captions IS NULL OR len(captions) > 0) AND {TOPIC_SQL} AND {VIRUS_SQL}""",
)
def f6(spark, sf):
    return keyword_filter(papers(spark, sf, ()), POSITIVE).select("_id", "title")


@query(
    "f7_any_table_keeps_all",
    f"""WITH {PAPERS_SQL} SELECT _id, table_id FROM tables
    WHERE _id IN (SELECT _id FROM papers WHERE {sql_path('captions', TOPIC)})""",
)
def f7(spark, sf):
    hit = any_table(papers(spark, sf, ()), "tables.tableCaption", lambda caption: pr.rx_any(caption, TOPIC))
    return unwind(hit, "tables").select("_id", F.col("tables.tableId").alias("table_id"))


@query("f8_table_filter", f"WITH {PAPERS_SQL} SELECT _id, table_id FROM tables WHERE {sql_any('caption', TOPIC)}")
def f8(spark, sf):
    rows = unwind(papers(spark, sf, ()), "tables", ("tableId", "tableCaption"))
    return rows.filter(pr.rx_any("tables.tableCaption", TOPIC)).select("_id", F.col("tables.tableId").alias("table_id"))


@query("f9_key_lookup", "SELECT vec_id AS id FROM embeddings WHERE label = 3 AND vec_id = 10 UNION ALL SELECT vec_id FROM embeddings WHERE label = 3")
def f9(spark, sf):
    v = word_vectors(spark, sf)
    return joins.lookup(v, word="3", id=10).select("id").unionByName(joins.lookup(v, word="3").select("id"))


@query("f10_search", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') OR regexp_matches(p_type, '^S')")
def f10(spark, sf):
    parts = table(spark, sf, "part")
    return parts.filter(pr.search("p_name", "ring") | pr.search("p_type", "^S", regex=True)).select("p_partkey", "p_name")


@query(
    "f11_length_guard",
    "SELECT doc_id FROM documents WHERE length(text) <= 500 AND trim(text, ' ') NOT IN ('0', '', 'na')",
)
def f11(spark, sf):
    return table(spark, sf, "documents").filter(pr.guard("text", 500, ["0", "", "na"])).select("doc_id")


@query(
    "f12_numeric_bounds",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity * 0.9 < 30 AND l_quantity * 1.1 < 30",
)
def f12(spark, sf):
    return interval_lines(spark, sf).filter(pr.bounded(["lo", "hi"], 30)).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "f13_drop_null",
    f"WITH {PART_CELLS_SQL} SELECT paper_id, row, col, value FROM part_cells WHERE value IS NOT NULL",
)
def f13(spark, sf):
    return _cells(spark, sf).select("paper_id", "row", "col", "value").na.drop()


@query(
    "f14_drop_nan_lines",
    """SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE NOT contains(line, 'nan') AND trim(line, ' ') <> '' GROUP BY line""",
)
def f14(spark, sf):
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(pr.without_nan("line")).groupBy("line").agg(F.count("*").alias("n"))


@query(
    "f15_header_guard",
    f"""WITH {PART_CELLS_SQL} SELECT paper_id, row, col,
      CASE WHEN trim(header, ' ') = '' THEN 'attribute not known' ELSE header END AS header, trim(header, ' ') <> '' AS kept
    FROM part_cells""",
)
def f15(spark, sf):
    return _cells(spark, sf).select(
        "paper_id",
        "row",
        "col",
        pr.header_guard("header", "attribute not known").alias("header"),
        pr.header_guard("header").alias("kept"),
    )


def _cells(spark, sf):
    parsed = part_tables(spark, sf).select("paper_id", parse_table("html").alias("t")).select("paper_id", "t.*")
    return grid_cells(parsed, "rows", "header", ("paper_id",))


@query(
    "f16_cell_guard",
    f"WITH {PART_CELLS_SQL} SELECT paper_id, row, col FROM part_cells WHERE value IS NOT NULL AND trim(value, ' ') <> ''",
)
def f16(spark, sf):
    return _cells(spark, sf).filter(pr.cell_guard("value")).select("paper_id", "row", "col")


@query(
    "f17_has_payload",
    f"WITH {PAPERS_SQL} SELECT _id FROM papers WHERE title IS NOT NULL AND trim(title, ' ') NOT IN ('', '{{}}') AND coalesce(len(captions), 0) > 0",
)
def f17(spark, sf):
    return papers(spark, sf, ()).filter(pr.has_payload(["title"], ["tables"])).select("_id")


@query(
    "n10_null_like",
    f"WITH {PART_CELLS_SQL} SELECT paper_id, row, col, CASE WHEN lower(trim(value, ' ')) IN ('-', '–', 'na', 'n/a', 'nan') THEN 'null' ELSE value END AS value FROM part_cells",
)
def n10(spark, sf):
    from gridmine.functions.text import null_like

    return _cells(spark, sf).select("paper_id", "row", "col", null_like("value").alias("value"))
