"""Sinks. Each write is one Spark job with the usual job commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which delimited files can hold."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    )


def write_delim(df: DataFrame, path: str, sep: str = ",", header: bool = True, mode: str = "errorifexists") -> None:
    (
        _flat(df)
        .write.mode(mode)
        .option("sep", sep)
        .option("header", header)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", '""')
        .csv(path)
    )


def write_lines(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_vector_store(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(text, words array<struct<word, vector>>) rows, the layout ``read_vectors`` reads."""
    df.select("text", "words").write.mode(mode).parquet(path)


def write_vector_pair(df: DataFrame, vec_path: str, meta_path: str, row_id: str, vector: str, mode: str = "errorifexists") -> None:
    """Vectors and metadata as two data sets that share ``row_id``."""
    df.select(row_id, vector).write.mode(mode).parquet(vec_path)
    df.drop(vector).write.mode(mode).parquet(meta_path)
