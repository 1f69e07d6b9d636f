"""Readers. Every scan declares its schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridmine import schemas
from gridmine.operators.ordering import number_rows


def read_papers(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Nested papers from parquet (path ends in .parquet) or JSON lines."""
    reader = spark.read.schema(schema or schemas.paper())
    return reader.parquet(path) if path.rstrip("/").endswith(".parquet") else reader.json(path)


def read_delim(
    spark: SparkSession, path: str, sep: str, schema: StructType, header: bool = True, multiline: bool = False
) -> DataFrame:
    """Delimited text; double quotes protect separators, a doubled quote is a quote.

    ``multiline`` allows line breaks inside quotes; such files cannot be split over tasks.
    """
    return (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("header", header)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with the path of their file and line number (from 0 in each file).

    Large files are split over tasks: lines are ordered by (file, offset of the split,
    position in the task) and numbered without a single sorting task.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        "value",
    )
    numbered = number_rows(lines, ["_block", "_at"], "_n", partition_by=["file"])
    return numbered.select("file", (F.col("_n") - 1).alias("line_no"), "value")


def read_table(spark: SparkSession, name: str, columns: Sequence[str] = ("*",), predicate: str | None = None) -> DataFrame:
    """Catalog table or view: projection and predicate go to the scan."""
    df = spark.table(name)
    return (df.filter(predicate) if predicate else df).select(*columns)


def read_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str, bounds: tuple[int, int], partitions: int, **options: str
) -> DataFrame:
    """SQL database table, read in parallel slices of ``partition_column``; replaces paging by OFFSET."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=partition_column, **options)
        .option("lowerBound", bounds[0])
        .option("upperBound", bounds[1])
        .option("numPartitions", partitions)
        .load()
    )


def explode_payload(
    df: DataFrame, blob: str, keys: Sequence[str] = (), sep: str = "|", tag_last: bool = True
) -> DataFrame:
    """Delimited payload of a binary column to (keys, line_no, fields[, tag])."""
    lines = df.select(*keys, F.posexplode(F.split(F.decode(blob, "UTF-8"), r"\r?\n")).alias("line_no", "_line"))
    out = lines.filter(F.col("_line") != "").select(
        *keys, "line_no", F.split("_line", f"\\{sep}").alias("fields")
    )
    return out.withColumn("tag", F.element_at("fields", -1)) if tag_last else out


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Keyed vector store (text -> words -> vector) to (text, pos, word, vector)."""
    store = spark.read.parquet(path)
    return store.select("text", F.posexplode("words").alias("pos", "_w")).select("text", "pos", "_w.word", "_w.vector")
