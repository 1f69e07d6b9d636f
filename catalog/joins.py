"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.fixtures import document_tokens, TOKENS_SQL, VECTORS_SQL, word_vectors
from catalog.registry import query, table
from gridmine.operators import aggregates, joins, unnest
from gridmine.operators.dictionaries import encode_by_blocks
from gridmine.operators.embed import words_of
from gridmine.session import spread

# Mean vector per label = reference vectors; cosine on doubles, 6 decimals.

REFS_SQL = f"""{VECTORS_SQL}, refs AS (
  SELECT word AS ref, list(m ORDER BY i) AS ref_vector
  FROM (SELECT word, i, avg(vector[i]) AS m FROM v, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY word, i) GROUP BY word
)"""


@query(
    "j1_rows_by_references",
    f"WITH {REFS_SQL} SELECT id, ref, abs(round(list_cosine_similarity(vector, ref_vector), 6)) AS similarity FROM v, refs",
)
def j1(spark, sf):
    """Every vector against the few label centroids."""
    v = word_vectors(spark, sf)
    refs = aggregates.centroid(v.withColumnRenamed("vector", "ref_vector"), ["word"], "ref_vector")
    return joins.cross_refs(v.select("id", "vector"), refs.withColumnRenamed("word", "ref"))


@query(
    "j2_positional_zip",
    """SELECT a.rn AS row_id, a.o_orderkey, b.p_partkey
    FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) a
    JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn FROM part) b USING (rn)""",
)
def j2(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    parts = table(spark, sf, "part").select("p_partkey")
    return joins.zip_rows(orders, parts, ["o_orderkey"], ["p_partkey"])


@query(
    "j3_lookup_last_vector",
    f"""WITH {VECTORS_SQL}, l AS (SELECT word, arg_max(vector, id) AS vector, max(id) AS id FROM v GROUP BY word)
    SELECT c.c_custkey, l.id, round(l.vector[1], 6) AS first FROM customer c JOIN l ON l.word = c.c_nationkey::VARCHAR""",
)
def j3(spark, sf):
    texts = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("word"))
    vectors = word_vectors(spark, sf).select("word", "id", "vector").withColumn("at", F.col("id"))
    found = joins.lookup_vectors(texts, vectors, ["word"], "at")
    return found.select("c_custkey", "id", F.round(F.get("vector", 0), 6).alias("first"))


@query(
    "j4_embed_vocabulary",
    f"""WITH {VECTORS_SQL}, l AS (SELECT word, arg_max(vector, id) AS vector FROM v GROUP BY word)
    SELECT c_custkey, 64::BIGINT AS dims, round(coalesce(l.vector[1], 0), 6) AS first
    FROM customer LEFT JOIN l ON l.word = c_nationkey::VARCHAR""",
)
def j4(spark, sf):
    vocab = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("word"))
    vectors = joins.last_by_key(word_vectors(spark, sf).select("word", "id", "vector"), ["word"], "id")
    out = joins.embed_vocab(vocab, vectors, 64)
    return out.select("c_custkey", F.size("vector").cast("long").alias("dims"), F.round(F.get("vector", 0), 6).alias("first"))


RANGES_SQL = """ranges AS (
  SELECT DISTINCT p_type AS attribute, 'years' AS unit, p_size::DOUBLE AS lo, (p_size + p_size % 4)::DOUBLE AS hi FROM part
)"""


@query(
    "j5_interval_containment",
    f"""WITH {RANGES_SQL}, hits AS (
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lo, hi
      FROM lineitem JOIN part ON p_partkey = l_partkey JOIN ranges ON attribute = p_type AND l_quantity BETWEEN lo AND hi)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) AS n, min(lo) AS min_lo, max(hi) AS max_hi
    FROM hits GROUP BY 1, 2, 3, 4""",
)
def j5(spark, sf):
    """Quantities of lines in the size ranges of their part type."""
    parts = table(spark, sf, "part")
    ranges = parts.select(
        F.col("p_type").alias("attribute"),
        F.lit("years").alias("unit"),
        F.col("p_size").cast("double").alias("lo"),
        (F.col("p_size") + F.col("p_size") % 4).cast("double").alias("hi"),
    ).distinct()
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    numbers = table(spark, sf, "lineitem").join(parts, F.col("p_partkey") == F.col("l_partkey")).select(
        *keys, F.col("p_type").alias("attribute"), F.lit("years").alias("unit"), F.col("l_quantity").alias("number")
    )
    hits = joins.range_join(numbers, ranges, ["attribute", "unit"])
    return hits.groupBy(*keys).agg(F.count("*").alias("n"), F.min("lo").alias("min_lo"), F.max("hi").alias("max_hi"))


@query(
    "j7_holdout",
    """SELECT doc_id, 1 AS held_out FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
    UNION ALL SELECT doc_id, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def j7(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    inside, outside = joins.holdout(docs, table(spark, sf, "labels").filter("toxic = 1"), "doc_id")
    return unnest.label(inside, 1, "held_out").unionByName(unnest.label(outside, 0, "held_out"))


def _encode_sql(limit: str) -> str:
    return f"""WITH {TOKENS_SQL}, vocab AS (
      SELECT token AS word, row_number() OVER (ORDER BY count(*) DESC, token) AS idx FROM toks GROUP BY token
      ORDER BY count(*) DESC, token {limit})
    SELECT doc_id, string_agg(idx::VARCHAR, ' ' ORDER BY pos) AS ids FROM toks JOIN vocab ON word = token GROUP BY doc_id"""


@query("j8_encode_by_vocabulary", _encode_sql("LIMIT 50000"))
def j8(spark, sf):
    vocab = aggregates.vocabulary(document_tokens(spark, sf), 50000)
    return _encoded(joins.encode_arrays(_word_arrays(spark, sf), "words", vocab))


@query("j8_encode_by_large_vocabulary", _encode_sql(""))
def j8_large(spark, sf):
    """The form for vocabularies that must not travel with the plan: all words."""
    vocab = aggregates.vocabulary(document_tokens(spark, sf), None)
    return _encoded(encode_by_blocks(_word_arrays(spark, sf), "words", vocab))


def _word_arrays(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", words_of("text", lower=False).alias("words"))


def _encoded(ids):
    return ids.filter(F.size("ids") > 0).select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))
