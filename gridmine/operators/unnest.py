"""Projection and unnesting of nested documents and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmine.functions.predicates import as_col


def project(df: DataFrame, fields: dict[str, str | Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """Nested paths under new names; ``keep`` columns stay in front."""
    return df.select(*keep, *[as_col(path).alias(name) for name, path in fields.items()])


def replace_root(df: DataFrame, struct_col: str) -> DataFrame:
    return df.select(f"{struct_col}.*")


def unwind(df: DataFrame, array_col: str, fields: tuple[str, ...] = ()) -> DataFrame:
    """One row per element under the same name; rows with NULL or ``[]`` vanish.

    ``fields`` narrows the elements before the explode, so that a scan reads only those
    fields; Spark prunes below an explode only if a single field is used after it.
    """
    others = [F.col(c) for c in df.columns if c != array_col]
    narrow = F.arrays_zip(*[F.col(f"{array_col}.{f}").alias(f) for f in fields]) if fields else F.col(array_col)
    return df.select(*others, F.explode(narrow).alias(array_col)).select(*df.columns)


def field_or(c: str | Column, default) -> Column:
    return F.coalesce(as_col(c), F.lit(default))


def label(df: DataFrame, value: int, name: str = "label") -> DataFrame:
    return df.withColumn(name, F.lit(value))


def binarise(c: str | Column) -> Column:
    return F.when(as_col(c) == 0, 0).otherwise(1)


def grid_cells(df: DataFrame, grid: str, header: str | None = None, keys: tuple[str, ...] = (), outer: bool = False) -> DataFrame:
    """Grid to one row per cell: (keys, row 1.., col 0.., value[, header]).

    With ``header`` each cell carries its column name. The name is paired with the cell
    while both are arrays of one row, so no join is needed and no cell row has to carry
    the whole header. ``outer`` keeps a row of NULLs for a grid without cells.
    """
    spread_rows, spread_cells = (F.posexplode_outer, F.explode_outer) if outer else (F.posexplode, F.explode)
    names = [] if header is None else [F.col(header).alias("_header")]
    rows = df.select(*keys, *names, spread_rows(grid).alias("_r", "_cells"))

    def cell(value: Column, c: Column) -> Column:
        named = [] if header is None else [F.get("_header", c).alias("header")]
        return F.struct(c.alias("col"), value.alias("value"), *named)

    return rows.select(*keys, (F.col("_r") + 1).alias("row"), spread_cells(F.transform("_cells", cell)).alias("_c")).select(
        *keys, "row", "_c.*"
    )


def with_header(cells: DataFrame, headers: DataFrame, keys: tuple[str, ...], name: str = "header") -> DataFrame:
    """Column names from a table of headers (keys, col, header) that is stored apart from the cells."""
    return cells.join(headers.select(*keys, "col", F.col("header").alias(name)), [*keys, "col"], "left")


def tokens(df: DataFrame, c: str, keys: tuple[str, ...] = (), split_on: str = r"(?U)\s+") -> DataFrame:
    """Text to (keys, position 0.., token) rows; blank pieces are dropped before numbering."""
    pieces = F.filter(F.split(as_col(c), split_on), lambda t: t != "")
    return df.select(*keys, F.posexplode(pieces).alias("pos", "token"))
