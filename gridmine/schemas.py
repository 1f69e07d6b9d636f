"""Declared schemas of the documents the library reads (never inferred at scan)."""

from __future__ import annotations

from pyspark.sql import types as T

GRID = T.ArrayType(T.ArrayType(T.StringType()))
VECTOR = T.ArrayType(T.DoubleType())
TEXT_ITEMS = T.ArrayType(T.StructType([T.StructField("text", T.StringType())]))


def header_tree(depth: int = 4) -> T.ArrayType:
    """Header tree cut at ``depth``: Spark types cannot be recursive."""
    fields = [T.StructField("text", T.StringType())]
    if depth > 1:
        fields.append(T.StructField("children", header_tree(depth - 1)))
    return T.ArrayType(T.StructType(fields))


def table(tree_depth: int = 4) -> T.StructType:
    return T.StructType(
        [
            T.StructField("tableId", T.IntegerType()),
            T.StructField("tableCaption", T.StringType()),
            T.StructField("tableData", T.StringType()),
            T.StructField("HMD", header_tree(tree_depth)),
            T.StructField("VMD", header_tree(tree_depth)),
            T.StructField("Data", GRID),
            T.StructField("cl_verified", T.IntegerType()),
            T.StructField("cl_HMD", GRID),
            T.StructField("cl_VMD", GRID),
            T.StructField("cl_DATA", GRID),
        ]
    )


def paper(tree_depth: int = 4) -> T.StructType:
    return T.StructType(
        [
            T.StructField("_id", T.StringType()),
            T.StructField("title", T.StringType()),
            T.StructField("abstract", TEXT_ITEMS),
            T.StructField("bodyTextFlat", TEXT_ITEMS),
            T.StructField("figures", T.ArrayType(T.StructType([T.StructField("figCaption", T.StringType())]))),
            T.StructField("tables", T.ArrayType(table(tree_depth))),
        ]
    )


LABELLED_TABLE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("caption", T.StringType()),
        T.StructField("meta_h", T.StringType()),
        T.StructField("meta_v", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)
WORD_VECTORS = T.StructType(
    [T.StructField("word", T.StringType()), T.StructField("text", T.StringType()), T.StructField("vector", VECTOR)]
)
PARSED_TABLE = T.StructType([T.StructField("header", T.ArrayType(T.StringType())), T.StructField("rows", GRID)])
#: Cells of markup as they are written, before spans are filled.
RAW_CELL = T.StructType(
    [T.StructField("rowspan", T.IntegerType()), T.StructField("colspan", T.IntegerType()), T.StructField("text", T.StringType())]
)
RAW_ROWS = T.ArrayType(T.ArrayType(RAW_CELL))
RAW_TABLE = T.StructType([T.StructField("head", RAW_ROWS), T.StructField("body", RAW_ROWS)])
