"""Text corpora from tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmine.functions.numbers import (
    NUMBER,
    RANGE,
    UNITS_LONG,
    UNITS_SHORT,
    add_unit,
    detect_unit,
    find_alnum_mix,
    find_numbers,
    find_ranges,
    format_ranges,
    numbers_to_intervals,
    range_token,
    resolve_unit,
    tokenise_ranges,
)
from gridmine.functions.predicates import without_nan
from gridmine.functions.text import flatten_nonempty, interleave, normalise, serialise_rows, terms
from gridmine.operators.aggregates import range_dictionary, range_dictionary_ids
from gridmine.operators.ordering import number_rows, running_min
from gridmine.operators.sampling import seeded_hash
from gridmine.operators.unnest import grid_cells
from gridmine.session import materialise
from gridmine.sources.readers import explode_payload


def row_corpus(tables: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Parsed tables (keys, header, rows) to one normalised line per body row."""
    lines = serialise_rows("header", "rows", "row_corpus")
    return tables.select(*keys, F.posexplode(lines).alias("row", "line"))


def token_corpus(
    df: DataFrame, columns: Sequence[str], profile: str, intervals: bool = False, substring_nan: bool = True
) -> DataFrame:
    """Distinct normalised lines per column, without NULL, blank and ``nan`` lines: (column, line)."""
    picked = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), normalise(c, profile).alias("line")) for c in columns])
        ).alias("x")
    ).select("x.*")
    kept = picked.filter(F.col("line").isNotNull()).distinct().filter(without_nan("line", substring_nan))
    return kept.withColumn("line", format_ranges(numbers_to_intervals("line"))) if intervals else kept


def unit_cells(cells: DataFrame, units: Sequence[str], attribute: str = "header") -> DataFrame:
    """Cells with the unit of their column (first) or of their own text."""
    unit = resolve_unit(detect_unit(attribute, units), detect_unit("value", units), "header")
    return cells.withColumn("attribute", F.col(attribute)).withColumn("unit", unit)


def ranges_of(cells: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Ranges in cells that have a unit: (keep, attribute, unit, pos, lo, hi); one scan, no shuffle."""
    found = cells.filter(F.col("unit").isNotNull()).select(
        *keep, "attribute", "unit", F.posexplode(find_ranges("value")).alias("pos", "_r")
    )
    return found.select(*keep, "attribute", "unit", "pos", "_r.lo", "_r.hi")


def sweep_ranges(
    points: DataFrame, dictionary: DataFrame, keys: Sequence[str], ident: Sequence[str], extra: Sequence[str] = ()
) -> DataFrame:
    """Each point (keys, number, ident) with ``_range``: the range with the smallest (lo, hi) that contains its number.

    ``_range`` is a struct of lo_value, hi_value, lo, hi and the ``extra`` columns of the dictionary, NULL where no range
    contains the number. Ranges (at hi) and points share one descending order; the running minimum of (lo, hi) over
    ranges with hi >= number is the answer if its lo is not above the number. No pairs are formed, nothing is joined
    back, and wide and open-ended ranges cost what others do. ``ident`` makes the order total, so a number, attribute or
    unit that holds most of the points is spread over buckets like any other stretch of the order.
    """
    keys, ident = list(keys), list(ident)
    lo, hi = F.col("lo").cast("double"), F.col("hi").cast("double")
    bounds = F.struct(lo.alias("lo_value"), hi.alias("hi_value"), "lo", "hi", *extra)
    no_point = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in ident]
    ranges = dictionary.select(*keys, (-hi).alias("_at"), F.lit(0).alias("_kind"), *no_point, bounds.alias("_range"))
    no_range = F.lit(None).cast(ranges.schema["_range"].dataType).alias("_range")
    marks = points.select(*keys, (-F.col("number")).alias("_at"), F.lit(1).alias("_kind"), *ident, no_range)
    swept = running_min(ranges.unionByName(marks), ["_at", "_kind", *ident], "_range", "_best", partition_by=keys)
    number = -F.col("_at")
    found = F.when(F.col("_best.lo_value") <= number, F.col("_best"))
    return swept.filter(F.col("_kind") == 1).select(*keys, number.alias("number"), *ident, found.alias("_range"))


def first_range(numbers: DataFrame, dictionary: DataFrame, keys: Sequence[str] = ("attribute", "unit")) -> DataFrame:
    """For each distinct (keys, number): the range with the smallest (lo, hi) that contains it."""
    points = numbers.select(*keys, "number").distinct()
    hits = sweep_ranges(points, dictionary, keys, ()).filter(F.col("_range").isNotNull())
    return hits.select(*keys, "number", "_range.lo", "_range.hi")


def _nodes(column: str, levels: int, offset: int) -> Column:
    """Blocks of 2^level documents that a binary count of documents is made of, as an array of (level, node)."""
    blocks = f"transform(sequence(0, {levels - 1}), l -> struct(l AS level, shiftright({column}, l) - {offset} AS node))"
    return F.explode(F.expr(f"filter({blocks}, x -> x.node % 2 = 0)"))


def sweep_ranges_as_seen(
    points: DataFrame,
    dictionary: DataFrame,
    keys: Sequence[str],
    ident: Sequence[str],
    doc: str = "doc",
    seen: str = "seen",
    extra: Sequence[str] = (),
) -> DataFrame:
    """``sweep_ranges`` in which a point of document ``doc`` only knows ranges with ``seen <= doc``.

    Documents are numbered from 1 (``ident`` need not hold the number). The documents up to d are a few blocks of
    2^level documents, one for every bit set in d; a range lies in one block per level, and only every other block of
    a level is ever asked. So one sweep with the block as a further key answers both conditions, at a cost of about half
    the bits of the number of documents for each point and range, whatever the order of arrival. A point with
    a NULL ``doc`` has no row, a range with a NULL ``seen`` is never known.
    """
    last = points.agg(F.max(doc)).first()[0] or 1
    levels = int(last).bit_length()
    known = dictionary.filter(F.col(seen) <= last).withColumn("_first", F.col(seen).cast("long") - 1)
    known = known.withColumn("_node", _nodes("_first", levels, 0))
    asked = points.withColumn("_upto", F.col(doc).cast("long")).withColumn("_node", _nodes("_upto", levels, 1))

    def spread(df: DataFrame) -> DataFrame:
        return df.withColumn("_level", F.col("_node.level")).withColumn("_node", F.col("_node.node"))

    hits = sweep_ranges(spread(asked), spread(known), [*keys, "_level", "_node"], ident, extra)
    return hits.groupBy(*keys, "number", *ident).agg(F.min("_range").alias("_range"))


def tokenise_numbers(cells: DataFrame, dictionary: DataFrame, keys: Sequence[str], doc: str | None = None) -> DataFrame:
    """Single numbers that fall into a known range of their attribute and unit become its token.

    Only cells without a range of their own take part; others pass unchanged. With ``doc``, the number of a cell's
    document from 1, only ranges whose ``seen`` is not above it are known to the cell.
    """
    keys = list(keys)
    eligible = F.col("unit").isNotNull() & F.col("value").rlike(NUMBER) & ~F.col("value").rlike(RANGE)
    own = [] if doc is None or doc in keys else [doc]
    texts = cells.filter(eligible).select(
        *keys, *own, "attribute", "unit", F.posexplode(find_numbers("value")).alias("pos", "text")
    )
    numbers = texts.withColumn("number", F.col("text").cast("double"))
    token = range_token(F.col("attribute"), F.col("unit"), F.col("lo"), F.col("hi"))
    book, of, ident = dictionary.withColumn("token", token), ["attribute", "unit"], [*keys, "pos", "text"]
    if doc is None:
        met = sweep_ranges(numbers, book, of, ident, ["token"])
    else:
        met = sweep_ranges_as_seen(numbers, book, of, ident, doc, extra=["token"])
    fill = F.coalesce(F.concat(F.lit(" "), F.col("_range.token"), F.lit(" ")), F.col("text"))
    placed = (
        met.select(*keys, "pos", fill.alias("fill"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("pos", "fill"))).getField("fill").alias("_fills"))
    )
    rebuilt = interleave(F.split("value", NUMBER, -1), F.col("_fills"))
    return cells.join(placed, keys, "left").withColumn(
        "value", F.when(F.col("_fills").isNotNull(), rebuilt).otherwise(F.col("value"))
    ).drop("_fills")


def range_token_corpus(tables: DataFrame, keys: tuple[str, ...], as_seen: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cells with ranges and in-range numbers replaced by tokens, range dictionary).

    Pass 1 builds the dictionary from all tables, pass 2 resolves numbers against it. With ``as_seen`` tables arrive
    in the order of ``keys`` (unique, NULL first), and a table knows the ranges of itself and of tables before it; the
    dictionary then names the table that shows a range first (``seen``, from 1).
    """
    order = [*keys]
    if as_seen:
        tables, order = number_rows(tables, keys, "doc"), [*keys, "doc"]
    cells = grid_cells(tables, "rows", "header", tuple(order)).filter(F.col("value").isNotNull())
    cells = materialise(unit_cells(cells, UNITS_SHORT))  # read by both passes
    dictionary = range_dictionary(ranges_of(cells, ["doc"] if as_seen else ()), "doc" if as_seen else None)
    with_tokens = F.when(
        F.col("unit").isNotNull(), tokenise_ranges("value", F.col("attribute"), F.col("unit"))
    ).otherwise(F.col("value"))
    numbered = tokenise_numbers(cells, dictionary, [*keys, "row", "col"], "doc" if as_seen else None).drop(*order[len(keys):])
    own_range = F.col("value").rlike(RANGE)
    return numbered.withColumn("value", F.when(own_range, with_tokens).otherwise(F.col("value"))), dictionary


def header_lines(tables: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One line per table with a header: its column names joined by blanks, missing ones as ``0``: (keys, line)."""
    names = F.transform("header", lambda h: F.coalesce(h, F.lit("0")))
    return tables.filter(F.size("header") > 0).select(*keys, F.array_join(names, " ").alias("line"))


def unit_tables(tables: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(unit-completed cells, range dictionary with ids, letter-digit tokens).

    ``tables`` is (keys, cl_HMD, cl_DATA); the header is the flattened ``cl_HMD``.
    """
    flat = tables.select(*keys, flatten_nonempty("cl_HMD").alias("_h"), "cl_DATA")
    named = F.transform("_h", lambda h: F.struct(h.alias("text"), detect_unit(h, UNITS_LONG).alias("unit")))
    cells = grid_cells(flat.withColumn("_named", named), "cl_DATA", "_named", keys).filter(F.col("value").isNotNull())
    cells = cells.withColumn("header_unit", F.col("header.unit")).withColumn("header", F.col("header.text"))
    completed = cells.withColumn("value", add_unit("value", "header_unit"))
    found = completed.select(
        *keys, "row", "col", "header", "header_unit", "value", F.posexplode(find_ranges("value")).alias("pos", "_r")
    ).filter(F.col("pos") == 0)  # the first range of a cell is recorded
    attribute = F.when(F.col("header").isNull() | (F.col("header") == "nan"), F.lit("unidentified")).otherwise(F.col("header"))
    ranges = found.select(
        *keys,
        "row",
        "col",
        attribute.alias("attribute"),
        "_r.lo",
        "_r.hi",
        resolve_unit(F.col("header_unit"), detect_unit("value", UNITS_LONG), "header", "unknown").alias("unit"),
    )
    dictionary = range_dictionary_ids(ranges, [*keys, "col", "row"])
    headers = flat.select(*keys, F.explode("_h").alias("_t"))
    mixed = headers.select(*keys, F.explode(find_alnum_mix("_t")).alias("token")).unionByName(
        completed.select(*keys, F.explode(find_alnum_mix("value")).alias("token"))
    )
    return completed.drop("header_unit"), dictionary, mixed


def header_data_rows(records: DataFrame, key: str, header_count: str, blob: str, seed: int = 0) -> DataFrame:
    """One header and one random data row per stored table: (key, kind, text).

    Tables with one header row give normalised terms of the header and of a data row,
    tables with two header rows give a raw data row.
    """
    rows = explode_payload(records, blob, (key, header_count)).withColumn("text", F.get("fields", 1))
    rows = rows.withColumn("_id", F.concat_ws("#", key, "line_no"))
    data, head = F.col("tag") == "D", (F.col("tag") == "HMD") & (F.col(header_count) == 1)
    draw = F.struct(seeded_hash("_id", seed), F.col("_id"))
    # payloads are unpacked once: both rows of a table come from one grouping
    drawn = rows.groupBy(key).agg(
        F.min_by(F.struct("text", header_count), F.when(data, draw)).alias("_data"),
        F.min_by(F.struct("text"), F.when(head, F.col("line_no"))).alias("_head"),
    )

    def joined(c: Column) -> Column:
        return F.array_join(terms(c), " ")

    def row(kind: str, when: Column, text: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), text.alias("text")))

    text, count = F.col("_data")["text"], F.col("_data")[header_count]
    found = F.array_compact(
        F.array(
            row("data", count == 1, joined(text)),
            row("hmd", F.col("_head").isNotNull(), joined(F.col("_head")["text"])),
            row("datarow", count == 2, text),
        )
    )
    return drawn.select(key, F.explode(found).alias("_r")).select(key, "_r.*")
