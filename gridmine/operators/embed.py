"""Text to vector. The pre-trained encoder is a plug-in; the default hashes tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmine.functions.predicates import as_col
from gridmine.functions.vectors import costly

#: list of texts -> list of vectors; built once per Python worker by a factory.
EncoderFactory = Callable[[], Callable[[list[str]], list[list[float]]]]


def words_of(c: str | Column, lower: bool = True) -> Column:
    c = F.lower(as_col(c)) if lower else as_col(c)
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def _token_codes(tokens: list[str], dims: int) -> np.ndarray:
    """Default encoder on distinct tokens, as 16-bit numbers x; ``hash_vector`` gives x / 2**15 - 1."""
    digests = b"".join([md5(t.encode()).digest() for t in tokens])
    a, b, c = np.frombuffer(digests, ">u4").astype(np.uint32).reshape(-1, 4).T[:3, :, None]
    i = np.arange(dims, dtype=np.uint32)
    out = np.empty((len(tokens), dims), np.uint16)
    step = max(1, _GATHERED // dims)
    for k in range(0, len(tokens), step):
        part = slice(k, k + step)
        out[part] = (a[part] + b[part] * i + c[part] * (i * i)) >> np.uint32(16)
    return out


#: Numbers worked on at once (16 to 32 MB).
_GATHERED = 1 << 22
#: Runs up to this length are added up place by place, longer ones one by one.
_SHORT_RUN = 16


def run_sums(table: np.ndarray, index: np.ndarray, lengths: np.ndarray, kind: type) -> np.ndarray:
    """Sums (of a number type) of the table rows that consecutive runs of ``index`` name; empty runs give zeros."""
    out = np.zeros((len(lengths), table.shape[1]), kind)
    at = np.cumsum(lengths) - lengths
    short = np.flatnonzero((lengths > 0) & (lengths <= _SHORT_RUN))
    short = short[np.argsort(-lengths[short], kind="stable")]
    step = max(1, _GATHERED // table.shape[1])
    for first in range(0, len(short), step):
        rows = short[first : first + step]
        sums = np.zeros((len(rows), table.shape[1]), kind)
        for k in range(int(lengths[rows[0]])):
            more = int(np.searchsorted(-lengths[rows], -k, side="left"))
            sums[:more] += table.take(index[at[rows[:more]] + k], axis=0)
        out[rows] = sums
    for r in np.flatnonzero(lengths > _SHORT_RUN).tolist():
        for k in range(at[r], at[r] + lengths[r], step):
            out[r] += table.take(index[k : min(k + step, at[r] + lengths[r])], axis=0).sum(axis=0, dtype=kind)
    return out


def _segment_sums(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; empty runs give zeros."""
    return run_sums(rows, np.arange(len(rows)), lengths, float)


#: Tokens whose codes are held at once (200 MB at 768 components, if all are different).
_TOKENS_AT_ONCE = 1 << 17
#: Vectors held at once where only a few numbers of each are kept.
_SHOWN_AT_ONCE = 1 << 12


def _mean_vectors(words: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean token vector per list of words, and the word counts.

    Texts are taken in slices of ``_TOKENS_AT_ONCE`` words, long ones in pieces; each distinct token of a slice is hashed once.
    """
    lengths = np.asarray(words.value_lengths().fill_null(0), dtype=np.int64)
    flat = words.flatten()
    pieces = -(-lengths // _TOKENS_AT_ONCE)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(lengths[owner] - nth * _TOKENS_AT_ONCE, _TOKENS_AT_ONCE)
    ends = np.concatenate([[0], np.cumsum(size)])
    sums = np.zeros((len(lengths), dims))
    first = 0
    while first < len(owner):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + _TOKENS_AT_ONCE, side="right")) - 1)
        coded = flat.slice(ends[first], ends[last] - ends[first]).dictionary_encode()
        table = _token_codes(coded.dictionary.to_pylist(), dims)
        kind = np.uint32 if size[first:last].max() <= 1 << 16 else np.uint64  # sums of 16-bit numbers
        own = run_sums(table, np.asarray(coded.indices), size[first:last], kind)
        if pieces.max(initial=0) <= 1:
            sums[owner[first:last]] = own
        else:
            np.add.at(sums, owner[first:last], own)
        first = last
    sums /= 32768.0 * np.maximum(lengths, 1)[:, None]
    sums[lengths > 0] -= 1
    return sums, lengths


def _vector_array(rows: np.ndarray, usable: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.where(usable, rows.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows[usable].ravel()), mask=pa.array(~usable))


def _pooled_tables(tables: pa.Array, numbers: np.ndarray, dims: int, pool) -> pa.Array:
    """One vector per table from the vectors of its texts, a few tables at a time.

    ``pool(rows, used, texts per table, number of each table)`` gives the vectors and which of them count.
    """
    counts = np.asarray(tables.value_lengths().fill_null(0), dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(counts)])
    texts = tables.flatten()
    most = max(1, _GATHERED // dims)
    out, usable, first = [np.zeros((0, dims))], [np.zeros(0, bool)], 0
    while first < len(counts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        rows, lengths = _mean_vectors(texts.slice(at[first], at[last] - at[first]), dims)
        vectors, used = pool(rows, lengths > 0, counts[first:last], numbers[first:last])
        out.append(vectors)
        usable.append(used)
        first = last
    return _vector_array(np.concatenate(out), np.concatenate(usable))


def text_vector(c: str | Column, dims: int, lower: bool = True) -> Column:
    """Mean of the default token vectors of a text; NULL for a text without tokens.

    Evaluated per Arrow batch: no explode and no shuffle, distinct tokens hashed once.
    """

    return tokens_vector(words_of(c, lower), dims)


def tokens_vector(tokens: str | Column, dims: int) -> Column:
    """Mean of the default vectors of an array of tokens; NULL without tokens."""

    @F.arrow_udf("array<double>")
    def mean(words: pa.Array) -> pa.Array:
        rows, lengths = _mean_vectors(words, dims)
        return _vector_array(rows, lengths > 0)

    return costly(mean)(as_col(tokens))


def digest_of(vectors: np.ndarray) -> np.ndarray:
    """Two numbers per vector that every component enters: their sum, and the sum weighed by place (1, 2, ...)."""
    return np.stack([vectors.sum(axis=1), vectors @ np.arange(1.0, vectors.shape[1] + 1)], axis=1)


def _code_sums(tokens: list[str], dims: int) -> np.ndarray:
    """Two whole numbers per token that every code of it enters: their sum, and the sum weighed by place."""
    out = np.empty((len(tokens), 2), np.int64)
    step = max(1, (_GATHERED >> 4) // dims)  # stays in the cache of a core
    places = np.stack([np.ones(dims), np.arange(1.0, dims + 1)], axis=1)
    for k in range(0, len(tokens), step):
        out[k : k + step] = _token_codes(tokens[k : k + step], dims) @ places  # below 2**53, so exact
    return out


def tokens_vector_digest(tokens: str | Column, dims: int) -> Column:
    """``digest_of`` the vector that ``tokens_vector`` gives, where the vector itself need not leave the worker.

    Both numbers are sums over components, so that of a mean is the mean of those of the tokens; each distinct
    token of a batch is hashed, and all its components summed, once.
    """

    @F.arrow_udf("array<double>")
    def digest(words: pa.Array) -> pa.Array:
        lengths = np.asarray(words.value_lengths().fill_null(0), dtype=np.int64)
        coded = words.flatten().dictionary_encode()
        sums = _code_sums(coded.dictionary.to_pylist(), dims)[np.asarray(coded.indices)]
        ends = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(sums, axis=0)])
        last = np.cumsum(lengths)
        means = (ends[last] - ends[last - lengths]) / (32768.0 * np.maximum(lengths, 1)[:, None])
        return _vector_array(means - [dims, dims * (dims + 1) / 2], lengths > 0)

    return costly(digest)(as_col(tokens))


def tokens_vector_shown(tokens: str | Column, dims: int) -> Column:
    """First and last component and ``digest_of`` the vector that ``tokens_vector`` gives: (first, last, total, weighed).

    The vectors are made in full, a batch at a time, and do not leave the worker.
    """

    @F.arrow_udf("array<double>")
    def shown(words: pa.Array) -> pa.Array:
        out, usable = [np.zeros((0, 4))], [np.zeros(0, bool)]
        for at in range(0, len(words), _SHOWN_AT_ONCE):
            rows, lengths = _mean_vectors(words.slice(at, _SHOWN_AT_ONCE), dims)
            out.append(np.concatenate([rows[:, [0, -1]], digest_of(rows)], axis=1))
            usable.append(lengths > 0)
        return _vector_array(np.concatenate(out), np.concatenate(usable))

    return costly(shown)(as_col(tokens))


def vector_digest(vector: str | Column) -> Column:
    """``digest_of`` an array column, in the JVM."""
    v = as_col(vector)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    weighed = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(v) > 0, F.array(total, weighed))


def row_sum_vector(row_texts: str | Column, dims: int, lower: bool = True) -> Column:
    """Sum of the text vectors of the rows of a table; NULL if no row has tokens."""

    def pooled(rows: np.ndarray, used: np.ndarray, per_table: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _segment_sums(rows, per_table), _segment_sums(used.astype(float)[:, None], per_table)[:, 0] > 0

    @F.arrow_udf("array<double>")
    def total(tables: pa.Array) -> pa.Array:
        return _pooled_tables(tables, np.zeros(len(tables)), dims, pooled)

    return costly(total)(F.transform(as_col(row_texts), lambda t: words_of(t, lower)))


def fold_vector(texts: str | Column, n: str | Column, dims: int, mode: str = "mean", lower: bool = True) -> Column:
    """Vector of a table column from its cell texts, in order; NULL if no cell has tokens.

    ``mean`` is the mean of the cell vectors. ``decay`` divides the running sum by ``n``
    after every cell, so the cell that is r-th from the end weighs n^-r.
    """

    def pooled(rows: np.ndarray, used: np.ndarray, cells: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(cells)), cells)
        count = np.bincount(owner[used], minlength=len(cells))
        if mode == "mean":
            weight = np.where(used, 1.0 / np.maximum(count, 1)[owner], 0.0)
        else:
            place = np.cumsum(used) - (np.cumsum(count) - count)[owner]
            weight = np.where(used, base[owner] ** -(count[owner] - place + 1.0), 0.0)
        rows *= weight[:, None]
        return _segment_sums(rows, cells), count > 0

    @F.arrow_udf("array<double>")
    def fold(columns: pa.Array, sizes: pa.Array) -> pa.Array:
        return _pooled_tables(columns, np.asarray(sizes.fill_null(1), dtype=float), dims, pooled)

    return costly(fold)(F.transform(as_col(texts), lambda t: words_of(t, lower)), as_col(n))


def embed_tokens(tokens: DataFrame, dims: int, name: str = "vector") -> DataFrame:
    """Default encoder on token rows, per Arrow batch; ``hash_vector`` gives the same in the JVM."""
    return tokens.withColumn(name, F.when(F.col("token").isNotNull(), tokens_vector(F.array("token"), dims)))


def embed_with(df: DataFrame, c: str, factory: EncoderFactory, name: str = "vector") -> DataFrame:
    """Plugged encoder: every distinct text is encoded once, in Arrow batches, then joined back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = factory()
        for batch in batches:
            yield pd.DataFrame({c: batch[c], name: encoder(batch[c].tolist())})

    texts = df.select(c).filter(F.col(c).isNotNull()).distinct()
    kind = df.schema[c].dataType.simpleString()
    vectors = texts.mapInPandas(run, f"`{c}` {kind}, `{name}` array<double>")
    return df.join(vectors, c, "left")
