"""Encoding arrays of words by a table of any size, without a row per word.

Rows are cut into blocks of some ``BLOCK_WORDS`` words. Inside a block words become numbers of its own
dictionary; only the distinct words of a block meet the vocabulary, so a frequent word costs an entry per block and
not one per occurrence. They travel as compressed lists, one per block and bucket of words, past the vocabulary words
of the bucket, and their ids meet the rows of the block in the same way, so no row per word is shuffled or sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmine.session import materialise, partition_count

BLOCK_WORDS = 1 << 20
_ROWS_AT_ONCE = 32


def with_block_dictionaries(df: DataFrame, words: str, most_rows: int | None = None) -> DataFrame:
    """The rows (without ``words``) with _block, _codes, and on the first row of each block _words, its dictionary.

    Written once, so that blocks do not change when a task runs again. A row of more words than a block
    holds is a block of its own. A null array has null codes; null words get the code of no word (-1).
    ``most_rows`` ends a block also at so many rows.
    """
    keep = [c for c in df.columns if c != words]
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        n_words = 0

        def close() -> pa.RecordBatch:
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            lists = table.column(words).combine_chunks()
            if isinstance(lists, pa.ChunkedArray):
                lists = pa.concat_arrays(lists.chunks)
            coded = lists.flatten().dictionary_encode()
            offsets = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]).astype(np.int32)
            codes = pa.ListArray.from_arrays(pa.array(offsets), coded.indices.fill_null(-1).cast(pa.int32()), mask=lists.is_null())
            n = table.num_rows
            first = pa.array([coded.dictionary.to_pylist()] + [None] * (n - 1), pa.list_(pa.string()))
            columns = [table.column(c).combine_chunks() for c in keep]
            columns = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            out = pa.record_batch([*columns, pa.array(np.full(n, number)), codes, first], [*keep, "_block", "_codes", "_words"])
            number += 1
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.slice(at, _ROWS_AT_ONCE)
                own = len(part.column(part.schema.get_field_index(words)).flatten())
                if held and (n_words + own > BLOCK_WORDS or most_rows and len(held) * _ROWS_AT_ONCE >= most_rows):
                    yield close()
                    held, n_words = [], 0
                held.append(part)
                n_words += own
        if held:
            yield close()

    return materialise(df.select(*keep, words).mapInArrow(run, f"{fields}_block long, _codes array<int>, _words array<string>"))


#: Buckets of words per shuffle partition: a task holds the vocabulary words of one bucket.
BUCKETS = 4
_ASKED = "_bucket int, _block long, _codes binary, _words binary, _ids binary"
_ASKED_NAMES = ["_bucket", "_block", "_codes", "_words", "_ids"]
#: Stands for the block of vocabulary words, so that they come before the words of any block.
_VOCABULARY = -1


def packed_words(words: list[str]) -> bytes:
    texts = [w.encode() for w in words]
    lengths = np.fromiter(map(len, texts), np.int32, len(texts))
    return zlib.compress(lengths.tobytes() + b"".join(texts), 1)


def unpacked_words(blob: bytes, n: int) -> list[bytes]:
    raw = zlib.decompress(blob)
    ends = (np.cumsum(np.frombuffer(raw, np.int32, n)) + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 * n, *ends[:-1]], ends, strict=True)] if n else []


def by_bucket(words: list[str], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its words in word order)."""
    own = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words))
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    order = order[np.argsort(own[order], kind="stable")]
    counts = np.bincount(own, minlength=buckets)
    ends = np.cumsum(counts)
    for b in np.flatnonzero(counts).tolist():
        yield b, order[ends[b] - counts[b] : ends[b]]


def _dictionary_rows(own: DataFrame, buckets: int) -> DataFrame:
    """Dictionaries of blocks (_block, _words), packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words.as_py()
                rows = [(b, block, zlib.compress(at.astype(np.int32).tobytes(), 1), packed_words([words[k] for k in at]), None) for b, at in by_bucket(words, buckets)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ASKED_TYPES, strict=True)], _ASKED_NAMES)

    return own.select("_block", "_words").mapInArrow(run, _ASKED)


def _vocabulary_rows(vocab: DataFrame, buckets: int) -> DataFrame:
    """Vocabulary words with their ids, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.filter(batch.column(0).is_valid())
            words, ids = known.column(0).to_pylist(), np.asarray(known.column(1), dtype=np.int64)
            rows = [(b, _VOCABULARY, None, packed_words([words[k] for k in at]), ids[at].tobytes()) for b, at in by_bucket(words, buckets)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ASKED_TYPES, strict=True)], _ASKED_NAMES)

    return vocab.select("word", F.col("idx").cast("long").alias("idx")).where("idx is not null").mapInArrow(run, _ASKED)


_ASKED_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the words of each block and bucket; rows come sorted, those of the vocabulary first in each bucket."""
    bucket, known = None, {}
    for batch in batches:
        for at in range(batch.num_rows):
            b, block, codes, words, ids = (c[at].as_py() for c in batch.columns)
            if b != bucket:
                bucket, known = b, {}
            if block == _VOCABULARY:
                numbers = np.frombuffer(ids, np.int64).tolist()
                known.update(zip(unpacked_words(words, len(numbers)), numbers, strict=True))
                continue
            places = np.frombuffer(zlib.decompress(codes), np.int32)
            found = [known.get(w, _NO_ID) for w in unpacked_words(words, len(places))]
            found = np.array(found, np.int64)
            met = found != _NO_ID
            if met.any():
                blob = zlib.compress(places[met].tobytes() + found[met].tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([int(met.sum())], pa.int32()), pa.array([blob], pa.binary())], ["_block", "_n", "_ids"])


#: No id of a vocabulary.
_NO_ID = -(1 << 63)


def _ids_of(codes: pa.Array, places: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Ids of lists of codes; codes that are not among the (sorted) places are dropped."""
    flat = np.asarray(codes.flatten(), dtype=np.int64)
    lengths = np.asarray(codes.value_lengths().fill_null(0), dtype=np.int64)
    at = np.minimum(np.searchsorted(places, flat), max(len(places) - 1, 0))
    hit = places[at] == flat if len(places) else np.zeros(len(flat), bool)
    owner = np.repeat(np.arange(len(lengths)), lengths)[hit]
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(lengths)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[at[hit]] if len(places) else np.zeros(0, np.int64)))


def encode_by_blocks(df: DataFrame, words: str, vocab: DataFrame, name: str = "ids") -> DataFrame:
    """Adds the ids (``idx`` of ``vocab``) of an array of words; unknown words are dropped, order is kept.

    ``vocab`` (word, idx) may be of any size; a word must stand in it once. A row without known words gets an empty array.
    """
    rows = with_block_dictionaries(df, words)
    parts = partition_count(df.sparkSession)
    own = rows.where(F.col("_words").isNotNull())
    asked = _dictionary_rows(own, BUCKETS * parts).unionByName(_vocabulary_rows(vocab, BUCKETS * parts))
    answers = asked.repartition(parts, "_bucket").sortWithinPartitions("_bucket", "_block").mapInArrow(_answered, "_block long, _n int, _ids binary")

    keep = [c for c in rows.columns if c not in ("_block", "_codes", "_words")]
    out_schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{name}` array<bigint>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by block, the answers of a block before its rows
        block: int | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        table: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            blocks = np.asarray(batch.column(0))
            cuts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])) if len(blocks) else []
            for first, last in zip(cuts, [*cuts[1:], len(blocks)], strict=True):
                if blocks[first] != block:
                    block, held, table = blocks[first], [], None
                part = batch.slice(first, last - first)
                n_answers = len(part) - part.column(1).null_count
                for n, blob in zip(part.column(1)[:n_answers].to_pylist(), part.column(2)[:n_answers].to_pylist(), strict=True):
                    raw = zlib.decompress(blob)
                    held.append((np.frombuffer(raw, np.int32, n), np.frombuffer(raw, np.int64, n, 4 * n)))
                part = part.slice(n_answers)
                if not len(part):
                    continue
                if table is None:
                    places = np.concatenate([np.zeros(0, np.int32), *(p for p, _ in held)])
                    order = np.argsort(places)
                    table = places[order], np.concatenate([np.zeros(0, np.int64), *(i for _, i in held)])[order]
                ids = _ids_of(part.column(3), *table)
                yield pa.RecordBatch.from_arrays([*part.columns[4:], ids], [*keep, name])

    held_rows = rows.select("_block", F.lit(None).cast("int").alias("_n"), F.lit(None).cast("binary").alias("_ids"), "_codes", *keep)
    missing = [F.lit(None).cast(t).alias(c) for c, t in [("_codes", "array<int>"), *((c, df.schema[c].dataType) for c in keep)]]
    both = answers.select("_block", "_n", "_ids", *missing).unionByName(held_rows)
    met = both.repartition(parts, "_block").sortWithinPartitions("_block", F.col("_n").asc_nulls_last())
    return met.mapInArrow(run, out_schema).select(*keep, name)
