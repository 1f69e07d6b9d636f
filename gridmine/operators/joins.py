"""Joins: reference sets, key lookups, interval containment, membership."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridmine.functions.vectors import costly
from gridmine.operators.dictionaries import encode_by_blocks
from gridmine.operators.ordering import number_rows

#: Reference sets up to this many vectors travel with the plan; larger ones are joined in blocks.
MAX_INLINE_REFS = 256
#: Lookup tables up to this many rows may be broadcast.
MAX_BROADCAST_ROWS = 200_000


def small_rows(df: DataFrame, limit: int) -> list | None:
    """The rows if there are at most ``limit``, else None; never reads more than limit + 1."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a checked row count; beyond it the planner's shuffle join stays."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def cross_refs(
    df: DataFrame,
    refs: DataFrame,
    vector: str = "vector",
    ref_id: str = "ref",
    ref_vector: str = "ref_vector",
    max_inline: int = MAX_INLINE_REFS,
) -> DataFrame:
    """Absolute cosine of every row with every reference: (df columns, ref, similarity).

    Only pairs of non-zero vectors of equal length have a row. Few references travel with the
    plan and are scored per Arrow batch, without a join; beyond that both sides are cut into
    bounded blocks that meet once per pair. Both ways score with ``pair_cosines``.
    """
    keep = [c for c in df.columns if c != vector]
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    schema = f"{fields}`{ref_id}` {refs.schema[ref_id].dataType.simpleString()}, `similarity` double"
    df = df.withColumn(vector, F.col(vector).cast("array<double>"))
    typed = refs.select(ref_id, F.col(ref_vector).cast("array<double>").alias(ref_vector))

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for first in range(0, right.num_rows, COLUMNS_AT_ONCE):
            own = right.slice(first, COLUMNS_AT_ONCE)
            sims = pair_cosines(left[vector], own[ref_vector])
            row, ref = np.nonzero(sims >= 0)
            columns = [*left.select(keep).take(row).columns, own[ref_id].take(ref), pa.array(sims[row, ref])]
            parts.append(pa.Table.from_arrays(columns, names=[*keep, ref_id, "similarity"]))
        return pa.concat_tables(parts)

    few = small_table(typed, max_inline)
    if few is None:
        return block_cogroup(df, typed, scores, schema, PAIRS_BLOCK, PAIRS_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and few.num_rows:
                yield from scores(pa.Table.from_batches([batch]), few).to_batches()

    return df.mapInArrow(run, schema)


#: Rows per block when two large sets meet; a pair of blocks is one bounded group.
LEFT_BLOCK, RIGHT_BLOCK = 4_096, 4_096
#: The same where every pair is a row, which a worker holds several times: 4 million pairs of a group instead of 16.
PAIRS_BLOCK = 2_048
#: References scored as one matrix.
COLUMNS_AT_ONCE = 1_024


def small_table(df: DataFrame, limit: int) -> pa.Table | None:
    """The rows as an Arrow table if there are at most ``limit``, else None."""
    rows = small_rows(df, limit)
    if rows is None:
        return None
    kinds = [to_arrow_type(f.dataType) for f in df.schema.fields]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], names=df.columns)


def unit_vectors(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (positions, unit vectors)} of the vectors that are neither NULL, empty nor zero."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.asarray(pc.fill_null(pc.list_value_length(flat), 0))
    out = {}
    for width in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == width)
        rows = np.asarray(flat.take(pa.array(at)).flatten(), dtype=float).reshape(-1, width)
        norms = np.linalg.norm(rows, axis=1)
        ok = np.isfinite(norms) & (norms > 0)
        out[width] = (at[ok], rows[ok] / norms[ok, None])
    return out


def pair_cosines(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Absolute cosines of all pairs with 6 decimals; -1 where there is none.

    There is none for a NULL, an empty or a zero vector, a vector with a missing component,
    or two vectors of different length. Each vector is judged on its own.
    """
    out = np.full((len(left), len(right)), -1.0)
    others = unit_vectors(right)
    for width, (row, a) in unit_vectors(left).items():
        if width in others:
            column, b = others[width]
            out[np.ix_(row, column)] = np.abs(np.round(a @ b.T, 6))
    return out


def block_cogroup(
    left: DataFrame, right: DataFrame, fn, schema: str, left_block: int = LEFT_BLOCK, right_block: int = RIGHT_BLOCK
) -> DataFrame:
    """Every pair of rows of two large sets, as cogroups of bounded blocks.

    Each side is hashed into blocks of a fixed size (rows differ by their id) and copied
    once per block of the other side, so every pair of blocks meets in one group.
    """
    n_left = max(1, math.ceil(left.count() / left_block))
    n_right = max(1, math.ceil(right.count() / right_block))
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = left.withColumn("_lb", F.pmod(F.xxhash64(*left.columns), F.lit(n_left))).withColumn("_rb", blocks(n_right))
    right = right.withColumn("_rb", F.pmod(F.xxhash64(*right.columns), F.lit(n_right))).withColumn("_lb", blocks(n_left))
    return left.groupBy("_lb", "_rb").cogroup(right.groupBy("_lb", "_rb")).applyInArrow(fn, schema)


def zip_rows(a: DataFrame, b: DataFrame, order_a: Sequence[str], order_b: Sequence[str], name: str = "row_id") -> DataFrame:
    """Positional join, trimmed to the shorter side."""
    return number_rows(a, order_a, name).join(number_rows(b, order_b, name), name)


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows whose key columns equal the given values."""
    for column, value in keys.items():
        df = df.filter(F.col(column) == value)
    return df


def last_by_key(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row per key, the last in ``order`` (partial aggregation, no group is collected)."""
    values = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*values), F.col(order)).alias("_v"))
    return picked.select(*key, *[F.col(f"_v.{c}").alias(c) for c in values])


def lookup_vectors(texts: DataFrame, vectors: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Vectors of the given texts; the last of duplicate keys wins."""
    return texts.join(last_by_key(vectors, key, order), list(key))


def embed_vocab(vocab: DataFrame, vectors: DataFrame, dim: int, key: str = "word", vector: str = "vector") -> DataFrame:
    """Vector of every vocabulary word; unknown words get zeros."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    return vocab.join(vectors.select(key, vector), key, "left").withColumn(vector, F.coalesce(vector, zeros))


_LEVELS = range(-20, 61)


def _level(width: Column) -> Column:
    """Smallest power of two that is at least the width of a range."""
    log = F.ceil(F.log2(F.greatest(width, F.lit(2.0 ** _LEVELS[0]))))
    return F.greatest(F.lit(_LEVELS[0]), F.least(log, F.lit(_LEVELS[-1]))).cast("int")


def range_join(
    cells: DataFrame,
    ranges: DataFrame,
    keys: Sequence[str],
    number: str = "number",
    lo: str = "lo",
    hi: str = "hi",
) -> DataFrame:
    """Every (number, range) with equal keys and ``lo <= number <= hi``.

    A range of width up to 2^p lies in at most two bins of size 2^p, so each range is
    copied at most twice and each number once per level in use. The join key holds the
    bin, which spreads one frequent (attribute, unit) over many tasks.
    """
    ranges = ranges.filter(F.col(lo) <= F.col(hi))
    inside = (F.col(lo) <= F.col(number)) & (F.col(number) <= F.col(hi))
    # open-ended ranges, and those wider than the largest bin, are joined by their keys alone
    wide = ranges.filter(~(F.col(hi) - F.col(lo) <= F.lit(2.0 ** _LEVELS[-1])))
    if wide.limit(1).count():
        rest = ranges.filter(F.col(hi) - F.col(lo) <= F.lit(2.0 ** _LEVELS[-1]))
        by_keys = cells.join(broadcast_if_small(wide), list(keys)).filter(inside)
        return range_join(cells, rest, keys, number, lo, hi).unionByName(by_keys)
    ranges = ranges.withColumn("_level", _level(F.col(hi) - F.col(lo)))
    size = F.pow(F.lit(2.0), F.col("_level"))
    first, last = F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)
    binned = ranges.withColumn("_bin", F.explode(F.array_distinct(F.array(first, F.least(first + 1, last), last))))
    levels = [r["_level"] for r in ranges.select("_level").distinct().collect()]  # at most 81
    if not levels:
        levels = [0]
    numbers = cells.withColumn("_level", F.explode(F.array(*[F.lit(p) for p in sorted(levels)])))
    numbers = numbers.withColumn("_bin", F.floor(F.col(number) / F.pow(F.lit(2.0), F.col("_level"))))
    return numbers.join(binned, [*keys, "_level", "_bin"]).filter(inside).drop("_level", "_bin")


def semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def anti(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def holdout(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a listed id, all other rows)."""
    return semi(df, ids, key), anti(df, ids, key)


def encode(tokens: DataFrame, vocab: DataFrame, doc: str, name: str = "ids") -> DataFrame:
    """Token rows of documents to id sequences; unknown words are dropped, order is kept."""
    vocab = broadcast_if_small(vocab.select(F.col("word").alias("token"), "idx"))
    return (
        tokens.join(vocab, "token")
        .groupBy(doc)
        .agg(F.sort_array(F.collect_list(F.struct("pos", "idx"))).alias("_s"))
        .select(doc, F.col("_s.idx").alias(name))
    )


def encode_arrays(df: DataFrame, words: str, vocab: DataFrame, name: str = "ids", limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Adds the id sequence of an array of words; unknown words are dropped, order is kept.

    A vocabulary of at most ``limit`` words travels with the plan and is looked up per Arrow batch,
    without a shuffle. A larger one meets the distinct words of blocks of rows (``encode_by_blocks``, which
    drops the array of words; callers that do not need it save its copy).
    Rows without any known word get an empty sequence.
    """
    table = small_table(vocab.select("word", F.col("idx").cast("long").alias("idx")), limit)
    if table is not None:
        # position 0 is "unknown"
        known = pa.concat_arrays([pa.array([None], pa.string()), table["word"].combine_chunks()])
        ids = np.concatenate([[0], table["idx"].to_numpy()]) if table.num_rows else np.zeros(1, np.int64)

        @F.arrow_udf("array<bigint>")
        def look_up(rows: pa.Array) -> pa.Array:
            at = np.asarray(pc.fill_null(pc.index_in(rows.flatten(), value_set=known, skip_nulls=True), 0))
            lengths = np.asarray(rows.value_lengths().fill_null(0), dtype=np.int64)
            owner = np.repeat(np.arange(len(lengths)), lengths)[at > 0]
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(lengths)))]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[at[at > 0]], pa.int64()))

        return df.withColumn(name, costly(look_up)(F.col(words)))
    return encode_by_blocks(df.withColumn("_encoded", F.col(words)), "_encoded", vocab, name).select(*df.columns, name)
