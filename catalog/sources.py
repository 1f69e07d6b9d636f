"""Scans and sinks: write what the given tables hold, read it back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.fixtures import PAPER, PAPERS_SQL, build_papers, payloads, word_vectors
from catalog.registry import query, table
from gridmine.session import scratch_dir
from gridmine.sources import readers, writers

@query(
    "s1_scan_papers",
    f"""WITH {PAPERS_SQL}
    SELECT _id, title, len(body) AS body_items, len(abstract) AS abstract_items, captions IS NULL AS tables_missing,
           coalesce(len(captions), 0) AS n_tables,
           coalesce(list_sum(list_transform(captions, lambda x: len(x))), 0)::BIGINT AS caption_chars
    FROM papers""",
)
def s1(spark, sf):
    path = scratch_dir(spark) + "/papers"
    writers.write_json(build_papers(spark, sf), path)
    chars = F.aggregate("tables", F.lit(0).cast("bigint"), lambda acc, t: acc + F.length(t["tableCaption"]))
    return readers.read_papers(spark, path, PAPER).select(
        "_id",
        "title",
        F.size("bodyTextFlat").cast("long").alias("body_items"),
        F.size("abstract").cast("long").alias("abstract_items"),
        F.col("tables").isNull().alias("tables_missing"),
        F.coalesce(F.size("tables").cast("long"), F.lit(0)).alias("n_tables"),
        F.coalesce(chars, F.lit(0)).alias("caption_chars"),
    )


_ORDERS = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]
)
_ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


@query(
    "s2_scan_delimited",
    _ORDERS_SQL
    + " UNION ALL "
    + _ORDERS_SQL
    + " UNION ALL "
    + _ORDERS_SQL
    + " UNION ALL "
    + _ORDERS_SQL,
)
def s2(spark, sf):
    """The four separators, with header or given names."""
    orders = table(spark, sf, "orders").select(*_ORDERS.names)
    frames = []
    for sep, header in ((",", True), ("~", False), ("\t", True), ("|", False)):
        path = scratch_dir(spark) + "/orders"
        writers.write_delim(orders, path, sep, header)
        frames.append(readers.read_delim(spark, path, sep, _ORDERS, header))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


@query(
    "s3_scan_lines",
    """SELECT folder, row_number() OVER (PARTITION BY folder ORDER BY doc_id, i) - 1 AS line_no, value FROM (
      SELECT 'p' || (doc_id % 2)::VARCHAR AS folder, doc_id, ls[i] AS value, i
      FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))""",
)
def s3(spark, sf):
    """Lines of two folders whose files have equal names, with their real numbers.

    Files of a folder follow the document order, so the number in a file plus the lines of the
    files before it is the line's place in the folder.
    """
    path = scratch_dir(spark) + "/lines"
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "value"))
    ordered = docs.repartitionByRange(4, "doc_id").sortWithinPartitions((F.col("doc_id") % 2), "doc_id", "i")
    ordered.select((F.col("doc_id") % 2).alias("p"), "value").write.partitionBy("p").text(path)
    lines = readers.read_lines(spark, path)
    lines = lines.withColumn("folder", F.concat(F.lit("p"), F.regexp_extract("file", r"/p=(\d+)/", 1)))
    files = lines.groupBy("folder", "file").agg(F.count("*").alias("n"))  # one row per file
    before = F.sum("n").over(Window.partitionBy("folder").orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("folder", "file", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(F.broadcast(files), ["folder", "file"]).select("folder", (F.col("line_no") + F.col("before")).alias("line_no"), "value")


@query(
    "s4_scan_table",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000",
)
def s4(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("gridmine_orders")
    return readers.read_table(
        spark, "gridmine_orders", ("o_orderkey", "o_totalprice"), "o_orderstatus = 'F' AND o_totalprice > 1000"
    )


PAYLOAD_SQL = """payload AS (
  SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS headers, unnest(
    CASE WHEN p_size % 2 = 0 THEN [{'line_no': 0, 'text': 'Name, ''Size (cm)''', 'tag': 'HMD'}]
         ELSE [{'line_no': 0, 'text': 'Name, ''Size (cm)''', 'tag': 'HMD'}, {'line_no': 1, 'text': 'all, mm', 'tag': 'HMD'}] END
    || [{'line_no': CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END, 'text': '[''' || p_name || ''', ''' || p_size::VARCHAR || '%'']', 'tag': 'D'},
        {'line_no': CASE WHEN p_size % 2 = 0 THEN 2 ELSE 3 END, 'text': '[''' || p_type || ''', ''-' || p_size::VARCHAR || ' /mg'']', 'tag': 'D'}]
  ) AS x FROM part
)"""


@query(
    "s5_unpack_payload",
    f"WITH {PAYLOAD_SQL} SELECT id, x.line_no::INTEGER AS line_no, 3::BIGINT AS n_fields, x.text AS text, x.tag AS tag FROM payload",
)
def s5(spark, sf):
    rows = readers.explode_payload(payloads(spark, sf), "blob", ("id",))
    return rows.select(
        "id", "line_no", F.size("fields").cast("long").alias("n_fields"), F.get("fields", 1).alias("text"), "tag"
    )


@query(
    "s6_scan_vector_store",
    """SELECT 'text ' || vec_id::VARCHAR AS text, 0 AS pos, label::VARCHAR AS word, 64::BIGINT AS dims,
              round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings
    UNION ALL
    SELECT 'text ' || vec_id::VARCHAR, 1, label::VARCHAR || ' half', 32, round(list_sum(embedding[1:32]::DOUBLE[]), 6) + 0.0 FROM embeddings""",
)
def s6(spark, sf):
    path = scratch_dir(spark) + "/store.parquet"
    words = F.array(
        F.struct("word", "vector"),
        F.struct(F.concat("word", F.lit(" half")).alias("word"), F.slice("vector", 1, 32).alias("vector")),
    )
    writers.write_vector_store(word_vectors(spark, sf).withColumn("words", words), path)
    total = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x)
    return readers.read_vectors(spark, path).select(
        "text", "pos", "word", F.size("vector").cast("long").alias("dims"), F.round(total, 6).alias("total")
    )


@query(
    "s7_write_delimited",
    "SELECT doc_id, text, to_json(string_split(text, ' '))::VARCHAR AS words FROM documents",
)
def s7(spark, sf):
    """Whole texts with quotes and line breaks, arrays as JSON text."""
    path = scratch_dir(spark) + "/docs"
    docs = table(spark, sf, "documents").select("doc_id", "text", F.split("text", " ").alias("words"))
    writers.write_delim(docs, path, "~")
    schema = T.StructType().add("doc_id", T.LongType()).add("text", T.StringType()).add("words", T.StringType())
    return readers.read_delim(spark, path, "~", schema, multiline=True)


@query("s8_write_lines", "SELECT p_name AS value, count(*) AS n FROM part GROUP BY p_name")
def s8(spark, sf):
    path = scratch_dir(spark) + "/names"
    writers.write_lines(table(spark, sf, "part"), "p_name", path)
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


@query(
    "s9_write_json",
    "SELECT p_partkey, p_name, array_to_string(string_split(p_name, ' '), '/') AS words, p_retailprice FROM part",
)
def s9(spark, sf):
    path = scratch_dir(spark) + "/parts"
    parts = table(spark, sf, "part").select("p_partkey", "p_name", F.split("p_name", " ").alias("words"), "p_retailprice")
    writers.write_json(parts, path)
    return spark.read.schema(parts.schema).json(path).withColumn("words", F.array_join("words", "/"))


@query("s10_write_parquet", "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate::VARCHAR AS ship FROM lineitem")
def s10(spark, sf):
    path = scratch_dir(spark) + "/lines.parquet"
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    writers.write_parquet(lines, path)
    return spark.read.parquet(path).withColumn("ship", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).drop("l_shipdate")


@query(
    "s11_vector_pair",
    "SELECT vec_id AS id, label::VARCHAR AS word, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total FROM embeddings",
)
def s11(spark, sf):
    base = scratch_dir(spark)
    writers.write_vector_pair(word_vectors(spark, sf), base + "/vec", base + "/meta", "id", "vector")
    total = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x)
    return (
        spark.read.parquet(base + "/meta")
        .join(spark.read.parquet(base + "/vec"), "id")
        .select("id", "word", F.round(total, 6).alias("total"))
    )
