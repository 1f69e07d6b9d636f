"""Projections and unnesting."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import document_tokens, PAPERS_SQL, PART_CELLS_SQL, TOKENS_SQL, papers, part_tables
from catalog.registry import query, table
from gridmine.functions.html import parse_table
from gridmine.functions.text import flatten_nonempty, row_texts, table_text, tree_text
from gridmine.operators import unnest


def _tables(spark, sf, *fields):
    """(_id, t) with the named table fields."""
    rows = unnest.unwind(papers(spark, sf, fields).select("_id", "tables"), "tables", ("tableId", *fields))
    return rows.withColumnRenamed("tables", "t")


@query("p1_project_paths", f"WITH {PAPERS_SQL} SELECT _id, table_id, caption FROM tables")
def p1(spark, sf):
    rows = unnest.unwind(papers(spark, sf, ()), "tables", ("tableId", "tableCaption"))
    return unnest.project(rows, {"table_id": "tables.tableId", "caption": "tables.tableCaption"}, keep=("_id",))


@query(
    "p2_replace_root",
    f"""WITH {PAPERS_SQL} SELECT table_id AS "tableId", caption AS "tableCaption",
        CASE WHEN contains(caption, ' the ') THEN 1 ELSE 0 END AS cl_verified FROM tables""",
)
def p2(spark, sf):
    tables = unnest.unwind(papers(spark, sf, ("cl_verified",)), "tables", ("tableId", "tableCaption", "cl_verified"))
    return unnest.replace_root(tables, "tables")


@query("p3_rename_subset", "SELECT p_partkey AS id, p_name AS meta_h, p_type AS meta_v FROM part")
def p3(spark, sf):
    parts = table(spark, sf, "part").withColumnsRenamed({"p_partkey": "id", "p_name": "meta_h", "p_type": "meta_v"})
    return parts.select("id", "meta_h", "meta_v")


@query(
    "p4_cast_and_recode",
    "SELECT doc_id, quality::INTEGER AS label, CASE WHEN toxic = 0 THEN 0 ELSE 1 END AS binary_label FROM labels",
)
def p4(spark, sf):
    typed = table(spark, sf, "labels").selectExpr("doc_id", "cast(quality as int) label", "toxic")
    return typed.select("doc_id", "label", unnest.binarise("toxic").alias("binary_label"))


@query(
    "p5_literal_label",
    "SELECT doc_id, 1 AS label FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 0 FROM labels WHERE quality = 0",
)
def p5(spark, sf):
    rows = table(spark, sf, "labels")
    pos = unnest.label(rows.filter("quality = 1").select("doc_id"), 1)
    return pos.unionByName(unnest.label(rows.filter("quality = 0").select("doc_id"), 0))


@query(
    "p6_missing_default",
    f"WITH {PAPERS_SQL} SELECT _id, coalesce(len(captions), -1) AS n_tables, coalesce(figures[1], '') AS figure FROM papers",
)
def p6(spark, sf):
    p = papers(spark, sf, ())
    return p.select(
        "_id",
        unnest.field_or(F.size("tables").cast("long"), -1).alias("n_tables"),
        unnest.field_or(F.get("figures", 0)["figCaption"], "").alias("figure"),
    )


@query("u1_unwind", f"WITH {PAPERS_SQL} SELECT _id, title, table_id FROM tables")
def u1(spark, sf):
    return unnest.unwind(papers(spark, sf, ()), "tables").select("_id", "title", F.col("tables.tableId").alias("table_id"))


@query(
    "u2_grid_cells",
    f"""WITH {PAPERS_SQL}, sents AS (
      SELECT _id, table_id, i::INTEGER AS row, string_split(string_split(caption, '. ')[i], ' ') AS cells
      FROM (SELECT *, unnest(generate_series(1, len(string_split(caption, '. ')))) AS i FROM tables)
    ) SELECT _id, table_id, row, (j - 1)::INTEGER AS col, cells[j] AS value
      FROM (SELECT *, unnest(generate_series(1, len(cells))) AS j FROM sents)""",
)
def u2(spark, sf):
    rows = _tables(spark, sf, "Data")
    grids = rows.select("_id", F.col("t.tableId").alias("table_id"), F.col("t.Data").alias("grid"))
    return unnest.grid_cells(grids, "grid", keys=("_id", "table_id"))


@query(
    "u3_flatten_header",
    f"""WITH {PAPERS_SQL} SELECT _id, table_id, array_to_string(list_filter(
        flatten(list_transform(string_split(caption, '. '), lambda s: string_split(s, ' '))), lambda w: contains(w, ',')), '/') AS header
    FROM tables""",
)
def u3(spark, sf):
    rows = _tables(spark, sf, "cl_HMD")
    flat = flatten_nonempty("t.cl_HMD")
    return rows.select("_id", F.col("t.tableId").alias("table_id"), F.array_join(flat, "/").alias("header"))


@query("u4_tokens", f"WITH {TOKENS_SQL} SELECT doc_id, pos::INTEGER AS pos, token FROM toks")
def u4(spark, sf):
    return document_tokens(spark, sf)


@query(
    "u5_table_text",
    f"""WITH {PAPERS_SQL} SELECT _id, table_id,
        replace(array_to_string(string_split(caption, '. '), ' '), '~', '') AS text,
        len(string_split(caption, '. ')) AS n_rows, replace(string_split(caption, '. ')[-1], '~', '') AS last_row
    FROM tables""",
)
def u5(spark, sf):
    rows = _tables(spark, sf, "Data")
    texts = row_texts("t.Data")
    return rows.select(
        "_id",
        F.col("t.tableId").alias("table_id"),
        table_text("t.Data").alias("text"),
        F.size(texts).cast("long").alias("n_rows"),
        F.element_at(texts, -1).alias("last_row"),
    )


@query(
    "u6_tree_text",
    f"""WITH {PAPERS_SQL} SELECT _id, table_id,
      array_to_string(string_split(caption, '. '), ' ') AS all_text,
      CASE WHEN len(w) > 1 THEN w[1] || ' ' || w[-1] ELSE w[1] END AS last_text
    FROM (SELECT *, string_split(string_split(caption, '. ')[-1], ' ') AS w FROM tables)""",
)
def u6(spark, sf):
    rows = _tables(spark, sf, "HMD")
    return rows.select(
        "_id",
        F.col("t.tableId").alias("table_id"),
        tree_text("t.HMD", 2, "all").alias("all_text"),
        tree_text("t.HMD", 2, "last").alias("last_text"),
    )


@query(
    "j6_cell_with_header",
    f"WITH {PART_CELLS_SQL} SELECT paper_id, row, col, header, value FROM part_cells",
)
def j6(spark, sf):
    parsed = part_tables(spark, sf).select("paper_id", parse_table("html").alias("t")).select("paper_id", "t.*")
    return unnest.grid_cells(parsed, "rows", "header", ("paper_id",))


@query(
    "j6_cell_with_stored_header",
    f"WITH {PART_CELLS_SQL} SELECT paper_id, row, col, header, value FROM part_cells",
)
def j6_stored(spark, sf):
    """The header kept apart from the cells and joined by table and column."""
    parsed = part_tables(spark, sf).select("paper_id", parse_table("html").alias("t")).select("paper_id", "t.*")
    headers = parsed.select("paper_id", F.posexplode("header").alias("col", "header"))
    return unnest.with_header(unnest.grid_cells(parsed, "rows", keys=("paper_id",)), headers, ("paper_id",))
