"""Bag-of-words features whose vocabulary stays a table.

Words are counted in one pass (occurrences and documents together, in blocks where they are read), cut by a histogram of
frequencies and numbered; texts meet the vocabulary through block dictionaries, so the driver never holds a
word. The result is the sparse vector column that Spark ML expects.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from gridmine.operators.aggregates import number_words
from gridmine.operators.dictionaries import BLOCK_WORDS, BUCKETS, by_bucket, encode_by_blocks, packed_words, unpacked_words
from gridmine.operators.embed import words_of
from gridmine.session import materialise, partition_count, scratch_dir

# Fixed value: rows a word must stand in.
MIN_DOCUMENTS = 5
_ROWS_AT_ONCE = 32


_COUNTS = pa.schema([("_bucket", pa.int32()), ("_n", pa.int32()), ("_words", pa.binary()), ("_counts", pa.binary())])


def _counts_of(lists: list[pa.Array], buckets: int) -> pa.RecordBatch:
    """Words of some rows with their occurrences and rows, packed by bucket."""
    rows = pa.concat_arrays(lists)
    coded = rows.flatten().dictionary_encode()
    n = len(coded.dictionary)
    owner = np.repeat(np.arange(len(rows)), np.asarray(rows.value_lengths().fill_null(0), dtype=np.int64))
    known = np.asarray(coded.indices.is_valid())
    codes = np.asarray(coded.indices.fill_null(0), dtype=np.int64)[known]
    inside = np.unique(owner[known] * n + codes) % n if n else codes
    counts = np.stack([np.bincount(c, minlength=n) for c in (codes, inside)])
    words = coded.dictionary.to_pylist()
    packed = [
        {"_bucket": b, "_n": len(at), "_words": packed_words([words[k] for k in at]), "_counts": zlib.compress(counts[:, at].astype(np.int64).tobytes(), 1)}
        for b, at in by_bucket(words, buckets)
    ]
    return pa.RecordBatch.from_pylist(packed, _COUNTS)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, freq, docs) of packed counts that come sorted by bucket; the words of one bucket are held."""
    bucket: int | None = None
    held: dict[bytes, list[int]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        items = list(held.items())
        for first in range(0, len(items), 10_000):
            part = items[first : first + 10_000]
            counts = [pa.array([c[k] for _, c in part], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in part]), *counts], ["word", "freq", "docs"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["_bucket"] != bucket:
                yield from rows()
                bucket, held = row["_bucket"], {}
            freq, docs = np.frombuffer(zlib.decompress(row["_counts"]), np.int64).reshape(2, -1).tolist()
            for word, f, d in zip(unpacked_words(row["_words"], row["_n"]), freq, docs, strict=True):
                own = held.setdefault(word, [0, 0])
                own[0] += f
                own[1] += d
    yield from rows()


def word_frequencies(df: DataFrame, words: str) -> DataFrame:
    """(word, freq, docs) of an array of words: occurrences, and rows that hold the word.

    Some ``BLOCK_WORDS`` words at a time are counted where they are read, and their counts travel as compressed lists
    per bucket of words, so no row per word is shuffled.
    """
    parts = partition_count(df.sparkSession)
    buckets = BUCKETS * parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        n_words = 0
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.column(0).slice(at, _ROWS_AT_ONCE)
                held.append(part)
                n_words += len(part.flatten())
                if n_words >= BLOCK_WORDS:
                    yield _counts_of(held, buckets)
                    held, n_words = [], 0
        if held:
            yield _counts_of(held, buckets)

    packed = df.select(words).mapInArrow(run, "_bucket int, _n int, _words binary, _counts binary")
    return packed.repartition(parts, "_bucket").sortWithinPartitions("_bucket").mapInArrow(_summed, "word string, freq long, docs long")


def _counted(ids: pa.Array) -> pa.Array:
    """Sorted different ids of every row, and how often each stands in it."""
    lengths = np.asarray(ids.value_lengths().fill_null(0), dtype=np.int64)
    pairs = np.stack([np.repeat(np.arange(len(lengths)), lengths), np.asarray(ids.flatten(), dtype=np.int64)])
    order = np.lexsort((pairs[1], pairs[0]))
    pairs = pairs[:, order]
    new = np.ones(pairs.shape[1], dtype=bool)
    new[1:] = np.any(pairs[:, 1:] != pairs[:, :-1], axis=0)
    starts = np.flatnonzero(new)
    times = np.diff(np.append(starts, pairs.shape[1])).astype(float)
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(pairs[0, starts], minlength=len(lengths)))]), pa.int32())
    indices = pa.ListArray.from_arrays(ends, pa.array(pairs[1, starts], pa.int32()))
    return pa.StructArray.from_arrays([indices, pa.ListArray.from_arrays(ends, pa.array(times))], names=["indices", "values"])


def _words(df: DataFrame, c: str) -> Column:
    """Words of a text; an array of words is taken as it is."""
    return F.col(c) if isinstance(df.schema[c].dataType, ArrayType) else words_of(c)


def written_features(df: DataFrame, keep: Sequence[str], c: str = "features") -> DataFrame:
    """Columns ``keep`` and the vectors, written once, without attributes of the column.

    Where there is one per word, they travel with the plan in every task of every iteration of a fit.
    """
    # the stored form of a vector, read back as one
    stored = df.select(*keep, F.unwrap_udt(c).alias(c))
    path = scratch_dir(df.sparkSession) + "/features.parquet"
    stored.write.option("compression", "zstd").parquet(path)
    schema = StructType([*stored.select(*keep).schema.fields, StructField(c, VectorUDT())])
    return df.sparkSession.read.schema(schema).parquet(path)


@dataclass
class TextFeatures:
    """Fitted features: per text column its vocabulary (word, idx from 0 over all columns) and how many words it has."""

    columns: list[str]
    vocabularies: list[DataFrame]
    sizes: list[int]

    @property
    def width(self) -> int:
        return sum(self.sizes)

    def transform(self, df: DataFrame, out: str = "features", keep: Sequence[str] | None = None) -> DataFrame:
        """Adds the sparse counts of all columns, one behind the other; a null text counts nothing. Written once.

        ``keep`` names the columns that stay (all by default): a text that is not needed afterwards is not
        written and shuffled with its counts.
        """
        kept = list(df.columns if keep is None else keep)
        return written_features(self.counted(df, out, kept), kept, out)

    def counted(self, df: DataFrame, out: str, kept: Sequence[str]) -> DataFrame:
        """The columns ``kept`` and the counts, not written yet; of their attributes the column names the number only."""
        names = [f"_ids_{i}" for i in range(len(self.columns))]
        words = [_words(df, c).alias(f"_words_{i}") for i, c in enumerate(self.columns)]
        rows = df.select(*kept, *words)
        for i, (vocab, name) in enumerate(zip(self.vocabularies, names, strict=True)):
            rows = encode_by_blocks(rows, f"_words_{i}", vocab, name)
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts, n = _counted(batch.column(batch.num_columns - 1)), batch.num_rows
                # the stored form of a sparse vector
                parts = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, width, np.int32)), *counts.flatten()]
                vectors = pa.StructArray.from_arrays(parts, names=["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], [*kept, out])

        column = StructField(out, VectorUDT(), metadata={"ml_attr": {"num_attrs": width}})
        ids = F.concat(*names).alias("_ids")
        return rows.select(*kept, ids).mapInArrow(run, StructType([*df.select(*kept).schema.fields, column]))

    def save(self, path: str) -> None:
        spark = self.vocabularies[0].sparkSession
        for i, vocab in enumerate(self.vocabularies):
            vocab.write.mode("overwrite").parquet(f"{path}/words_{i}")
        spark.createDataFrame(list(zip(self.columns, self.sizes, strict=True)), "name string, words int").coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")


def load_text_features(spark: SparkSession, path: str) -> TextFeatures:
    rows = spark.read.parquet(f"{path}/columns").collect()  # one row per text column
    vocabularies = [spark.read.parquet(f"{path}/words_{i}") for i in range(len(rows))]
    return TextFeatures([r["name"] for r in rows], vocabularies, [r["words"] for r in rows])


def fit_text_features(
    df: DataFrame, columns: Sequence[str], size: int | None = None, min_df: float = MIN_DOCUMENTS
) -> TextFeatures:
    """The ``size`` most frequent words (all if None) in at least ``min_df`` rows, per text column.

    Indices follow frequency, ties the order of words.
    """
    vocabularies, sizes = [], []
    for c in columns:
        counts = materialise(word_frequencies(df.select(_words(df, c).alias("words")), "words").where(F.col("docs") >= min_df))
        numbered = number_words(counts.select("word", "freq"), size)
        vocab = materialise(numbered.select("word", (F.col("idx") - 1 + sum(sizes)).alias("idx")))
        vocabularies.append(vocab)
        sizes.append(vocab.count())
    return TextFeatures(list(columns), vocabularies, sizes)
