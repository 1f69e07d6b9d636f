"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import (
    document_tokens,
    PAPERS_SQL,
    TOKENS_SQL,
    VECTORS_SQL,
    numeric_cells,
    papers,
    part_tables,
    sql_any,
    sql_path,
    word_vectors,
)
from catalog.registry import query, table
from gridmine.functions import numbers, text
from gridmine.functions.html import parse_table
from gridmine.operators import aggregates


@query("a1_counts", f"WITH {PAPERS_SQL} SELECT count(*) AS n_rows, count(captions) AS n_with_tables FROM papers")
def a1(spark, sf):
    return papers(spark, sf, ()).agg(F.count("*").alias("n_rows"), F.count("tables").alias("n_with_tables"))


KEYWORDS = ["the", "license", "der", "que", "widget", "than the"]


def _keyword_sql(word: str) -> str:
    p = [(word, True)]
    return f"""SELECT '{word}' AS keyword, count(*) AS documents, sum(len(captions))::BIGINT AS tables FROM papers
    WHERE len(captions) > 0 AND ({sql_any('title', p)} OR {sql_path('abstract', p)} OR {sql_path('captions', p)} OR {sql_path('body', p)})
    HAVING count(*) > 0"""


@query("a2_keyword_counts", f"WITH {PAPERS_SQL} " + " UNION ALL ".join(_keyword_sql(k) for k in KEYWORDS))
def a2(spark, sf):
    fields = ["title", "abstract.text", "tables.tableCaption", "bodyTextFlat.text"]
    return aggregates.keyword_counts(papers(spark, sf, ()), KEYWORDS, fields)


# Vectors by (word, position), long form on both sides.
def _pooled_sql(expression: str, group: str = "word") -> str:
    return f"""WITH {VECTORS_SQL}, long AS (SELECT id, word, i, vector[i] AS x FROM v, (SELECT unnest(generate_series(1, 64)) AS i))
    SELECT {group}, (i - 1)::INTEGER AS pos, round({expression}, 6) + 0.0 AS x FROM long GROUP BY {group}, i"""


def _long(df, *keys):
    return df.select(*keys, F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("a3_vector_mean", _pooled_sql("avg(x)"))
def a3(spark, sf):
    return _long(aggregates.vec_mean(word_vectors(spark, sf), ["word"]), "word")


@query("a4_centroid", _pooled_sql("avg(x)", "'all'").replace("'all', (i", "'all' AS ref, (i").replace("GROUP BY 'all', i", "GROUP BY i"))
def a4(spark, sf):
    return _long(aggregates.centroid(word_vectors(spark, sf)).withColumn("ref", F.lit("all")), "ref")


@query(
    "a5_vector_sum",
    _pooled_sql("sum(x)").replace("+ 0.0 AS x FROM", "+ 0.0 AS x, round(sum(x) / (max(id) + 1), 6) + 0.0 AS row_mean FROM"),
)
def a5(spark, sf):
    """Sum over the rows of a table, and the sum over a given number of rows."""
    v = word_vectors(spark, sf)
    total = _long(aggregates.vec_sum(v, ["word"]), "word")
    mean = _long(aggregates.vec_row_mean(v, ["word"], F.col("id") + 1), "word").withColumnRenamed("x", "row_mean")
    return total.join(mean, ["word", "pos"])


@query(
    "a6_decaying_fold",
    f"""WITH {VECTORS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY id DESC) AS back, count(*) OVER (PARTITION BY word) AS n FROM v)
    SELECT word, (i - 1)::INTEGER AS pos, round(sum(vector[i] * pow(n::DOUBLE, -back)), 6) + 0.0 AS x
    FROM r, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY word, i""",
)
def a6(spark, sf):
    v = word_vectors(spark, sf)
    n = v.groupBy("word").agg(F.count("*").alias("n_rows"))
    return _long(aggregates.vec_fold(v.join(n, "word"), ["word"], "n_rows", ["id"], mode="decay"), "word")


@query(
    "a7_last_vector",
    f"WITH {VECTORS_SQL} SELECT word, max(id) AS id, round(arg_max(vector, id)[1], 6) + 0.0 AS first FROM v GROUP BY word",
)
def a7(spark, sf):
    v = word_vectors(spark, sf)
    last = aggregates.vec_last(v, ["word"], "id")
    ids = v.groupBy("word").agg(F.max("id").alias("id"))
    return last.join(ids, "word").select("word", "id", F.round(F.get("vector", 0), 6).alias("first"))


@query("a8_distinct", "SELECT DISTINCT p_name, p_type FROM part")
def a8(spark, sf):
    return table(spark, sf, "part").select("p_name", "p_type").distinct()


TOKEN_SQL = """array_to_string(list_transform(generate_series(0, 31), lambda k:
  'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'[(('0x' || substr(h, 2 * k + 1, 2))::INTEGER % 52) + 1]), '')"""


@query(
    "a9_range_dictionary",
    f"""SELECT attribute, unit, lo, hi, {TOKEN_SQL} AS token FROM (
      SELECT DISTINCT p_type AS attribute, 'years' AS unit, p_size::VARCHAR AS lo, (p_size + 5)::VARCHAR AS hi,
        sha256(p_type || '|years|' || p_size::VARCHAR || '.0|' || (p_size + 5)::VARCHAR || '.0') AS h FROM part)""",
)
def a9(spark, sf):
    cells = numeric_cells(spark, sf).select("attribute", numbers.detect_unit("cell").alias("unit"), F.explode(numbers.find_ranges("cell")).alias("r"))
    return aggregates.range_dictionary(cells.select("attribute", "unit", "r.lo", "r.hi"))


@query(
    "a10_range_dictionary_ids",
    """SELECT attribute, lo, hi, unit, 'unq_tkn_' || (row_number() OVER (ORDER BY seen, attribute, lo, hi, unit) - 1)::VARCHAR AS token FROM (
      SELECT p_type AS attribute, p_size::VARCHAR AS lo, (p_size + 5)::VARCHAR AS hi, 'years' AS unit, min(p_partkey) AS seen
      FROM part GROUP BY p_type, p_size)""",
)
def a10(spark, sf):
    cells = numeric_cells(spark, sf).select("p_partkey", "attribute", numbers.detect_unit("cell").alias("unit"), F.explode(numbers.find_ranges("cell")).alias("r"))
    return aggregates.range_dictionary_ids(cells.select("p_partkey", "attribute", "unit", "r.lo", "r.hi"), ["p_partkey"])


@query(
    "a11_serialise_rows",
    """SELECT p_partkey::VARCHAR AS paper_id, r AS row, CASE r
      WHEN 0 THEN 'Name ' || p_name || ' [SEP] Mean age years group ' || p_size::VARCHAR || '-' || (p_size + 5)::VARCHAR
        || ' [SEP] Dose mg/ml level ' || p_retailprice::VARCHAR || ' mg/ml  [SEP]  ' || p_brand
      WHEN 1 THEN 'Name ' || p_type || ' [SEP] Mean age years group ' || p_size::VARCHAR || ' [SEP] Dose mg/ml level '
        || CASE WHEN p_size % 7 = 0 THEN 'na' ELSE p_retailprice::VARCHAR END || ' [SEP]  ' || p_brand
      ELSE 'Name ' || p_name || ' [SEP] Mean age years group ' || (p_size + 2)::VARCHAR || ' [SEP] Dose mg/ml level 0 [SEP]  0' END AS line
    FROM part, (SELECT unnest([0, 1, 2]) AS r)""",
)
def a11(spark, sf):
    parsed = part_tables(spark, sf).select("paper_id", parse_table("html").alias("t"))
    return parsed.select("paper_id", F.posexplode(text.serialise_rows("t.header", "t.rows")).alias("row", "line"))


@query(
    "a12_collapse_header",
    """SELECT p_partkey,
      CASE WHEN p_name = p_type THEN ' : ' || p_name ELSE ' : ' || p_name || ' : ' || p_type END || ' : ' || p_name AS leading,
      CASE WHEN p_name = p_type THEN p_name ELSE p_name || ' : ' || p_type || ' : ' || p_name END AS colon,
      p_brand || ' ' || p_size::VARCHAR AS space
    FROM part""",
)
def a12(spark, sf):
    """Three header rows; the last equals the first, and one column repeats its only name."""
    brand, size = F.col("p_brand"), F.col("p_size").cast("string")
    rows = F.array(
        F.array(F.col("p_name"), brand),
        F.array(F.col("p_type"), brand),
        F.array(F.col("p_name"), size),
    )
    return table(spark, sf, "part").select(
        "p_partkey",
        F.element_at(text.collapse_header(rows, "leading"), 1).alias("leading"),
        F.element_at(text.collapse_header(rows, "colon"), 1).alias("colon"),
        F.element_at(text.collapse_header(rows, "space"), 2).alias("space"),
    )


@query(
    "a13_vocabulary",
    f"""WITH {TOKENS_SQL} SELECT token AS word, count(*) AS freq, row_number() OVER (ORDER BY count(*) DESC, token) AS idx
    FROM toks GROUP BY token HAVING count(DISTINCT doc_id) >= 5 ORDER BY freq DESC, word LIMIT 50000""",
)
def a13(spark, sf):
    tokens = document_tokens(spark, sf)
    return aggregates.vocabulary(tokens, 50000, min_df=5, doc="doc_id")


def _scored(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    rows = table(spark, sf, "labels").join(docs, "doc_id")
    return rows.select(F.col("quality").alias("label"), (F.col("n_chars") > 1500).cast("int").alias("prediction"))


SCORED_SQL = "scored AS (SELECT quality AS label, (n_chars > 1500)::INTEGER AS prediction FROM labels JOIN documents USING (doc_id))"


@query(
    "a14_classification_report",
    f"""WITH {SCORED_SQL}, c AS (SELECT DISTINCT unnest([label, prediction]) AS class FROM scored), m AS (
      SELECT class, count(*) FILTER (WHERE label = class AND prediction = class) AS tp, count(*) FILTER (WHERE label = class) AS support,
        count(*) FILTER (WHERE prediction = class) AS predicted, avg((label = prediction)::INTEGER) AS accuracy FROM c, scored GROUP BY class)
    SELECT class, round(tp / predicted, 6) AS precision, round(tp / support, 6) AS recall,
      round(2 * (tp / predicted) * (tp / support) / (tp / predicted + tp / support), 6) AS f1, support, round(accuracy, 6) AS accuracy FROM m""",
)
def a14(spark, sf):
    report = aggregates.classification_report(_scored(spark, sf))
    return report.select(
        F.col("class"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")], "support"
    )


@query(
    "a14_confusion",
    f"WITH {SCORED_SQL} SELECT label, prediction, count(*) AS n FROM scored GROUP BY label, prediction",
)
def a14_confusion(spark, sf):
    return aggregates.confusion(_scored(spark, sf))


@query(
    "a16_sample_precision",
    f"""WITH {SCORED_SQL} SELECT count(*) FILTER (WHERE label = 1) AS tp, count(*) FILTER (WHERE label = 0) AS fp,
      round(count(*) FILTER (WHERE label = 1) * 100.0 / count(*), 1)::DOUBLE AS precision FROM scored WHERE prediction = 1""",
)
def a16(spark, sf):
    hits = _scored(spark, sf).filter("prediction = 1")
    counts = hits.agg(F.count_if(F.col("label") == 1).alias("tp"), F.count_if(F.col("label") == 0).alias("fp"))
    return counts.select("tp", "fp", aggregates.precision_of(F.col("tp").cast("double"), F.col("fp").cast("double")).alias("precision"))


@query(
    "a17_token_key",
    "SELECT p_partkey, lower(trim(array_to_string(string_split(p_name, ' '), ''), ' ') || ' ' || p_type) AS key FROM part",
)
def a17(spark, sf):
    return table(spark, sf, "part").select("p_partkey", aggregates.token_key(F.split("p_name", " "), "p_type").alias("key"))
