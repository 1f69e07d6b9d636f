"""Periodic runs of words, found by minimizers at several scales.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at
least ``max(6, 4 * q)`` words which no neighbouring word extends. Runs are found without trying every lag:

1. Periods below ``SHORT`` are scanned directly: neighbouring places where a word equals the one q
   further on form stretches.
2. Scale P = SHORT, 2 * SHORT, ... finds the periods in [P, 2P). Every place has the hash of its next
   2P words, and a place is a minimizer if its hash is the smallest of some window of P places. Grams
   of 2P >= q words are all different within one period, and a run of 4q words has room for a window
   and its shift by q. So each run has minimizers that repeat at distance q, with no equal one between.
3. Each pair of a minimizer and the next equal one of the same text seeds an extension: words are compared at
   that distance to both sides. Two equal grams already are a square, so false seeds are rare. Seeds inside
   a stretch found before with the same distance are skipped.
4. A stretch that also has a smaller period (its period divided by a prime) belongs to that one.

Words are compared by exact numbers, not by hashes; a collision of gram hashes can only hide the
equality of two places, at odds of 2**-64 a pair. Texts never meet each other: everything is local to a row, so
there is no shuffle, and memory is that of a slice of ``_BATCH_BYTES`` of text or of one longer text.

Nulls: a null or empty text has no words. A null doc_id is one like any other, and its text is taken
undamaged by the query. Repeated rows give repeated rows, an empty table an empty result. Ties for the longest run
go to the smallest start, then period. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from gridmine.llm.common import sliced, text_batches, text_or_empty
from gridmine.llm.text_hash import U64, mix

#: Periods below this are scanned lag by lag.
SHORT = 8
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
_BATCH_BYTES = 1 << 18

Run = tuple[int, int, int]


def _stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each row of consecutive numbers."""
    cut = np.flatnonzero(np.diff(at) > 1)
    return at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]


def _short_runs(words: np.ndarray) -> Iterator[Run]:
    for q in range(1, min(SHORT, len(words))):
        at = np.flatnonzero(words[q:] == words[:-q])
        least = max(LEAST_LENGTH, LEAST_EXPONENT * q) - q
        if len(at) < least:
            continue
        first, last = _stretches(at)
        long = last - first + 1 >= least
        for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
            yield a, b - a + 1 + q, q


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every ``width`` neighbours (a power of two), in log2(width) passes."""
    step = 1
    while step < width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the smallest of some window of ``width`` places that holds them."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    low = _sliding(grams, width, np.minimum)
    # a place is chosen if the largest of the minima of its windows is its own hash
    edge = np.zeros(width - 1, U64)
    return np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), width, np.maximum) == grams)


def _same_before(words: np.ndarray, at: int, lag: int, lowest: int) -> int:
    """First place from which words equal those ``lag`` further on, up to ``at``."""
    step = 64
    while at > lowest:
        a = max(lowest, at - step)
        unlike = np.flatnonzero(words[a:at] != words[a + lag : at + lag])
        if len(unlike):
            return a + int(unlike[-1]) + 1
        at, step = a, step * 2
    return at


def _same_after(words: np.ndarray, at: int, lag: int, end: int) -> int:
    """End of the places from ``at`` on whose words equal those ``lag`` further on."""
    step = 64
    while at + lag < end:
        b = min(end - lag, at + step)
        unlike = np.flatnonzero(words[at:b] != words[at + lag : b + lag])
        if len(unlike):
            return at + int(unlike[0])
        at, step = b, step * 2
    return at


def _prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def _is_smallest(words: np.ndarray, start: int, length: int, q: int) -> bool:
    part = words[start : start + length]
    return not any(np.array_equal(part[: -(q // r)], part[q // r :]) for r in _prime_factors(q))


def _seeded_runs(words: np.ndarray, text: np.ndarray, ends: np.ndarray) -> Iterator[Run]:
    """Runs of periods from ``SHORT`` on; ``text`` is the text of each word, ``ends`` where texts end."""
    longest = int(np.diff(np.concatenate([[0], ends])).max(initial=0))
    starts = np.concatenate([[0], ends[:-1]])
    grams = mix(words.astype(U64) + U64(0x9E3779B97F4A7C15))
    size = 1
    period = SHORT
    while LEAST_EXPONENT * period <= longest:
        while size < 2 * period:
            grams = mix(grams[:-size] * U64(0xA0761D6478BD642F) + grams[size:])
            size *= 2
        at = minimizers(grams, period)
        # next equal minimizer of the same text; grams across texts may be chosen, but never pair up
        at = at[at + size <= ends[text[at]]]
        key = grams[at] ^ mix(text[at].astype(U64) + U64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        equal = key[order][1:] == key[order][:-1]
        here, there = at[order[:-1]][equal], at[order[1:]][equal]
        lag = there - here
        wanted = (lag >= period) & (lag < 2 * period)
        here, lag = here[wanted], lag[wanted]
        order = np.lexsort((here, lag))
        seen_lag, seen_end = -1, -1
        for a, q in zip(here[order].tolist(), lag[order].tolist(), strict=True):
            if q == seen_lag and a < seen_end:
                continue
            lowest, end = int(starts[text[a]]), int(ends[text[a]])
            first = _same_before(words, a, q, lowest)
            last = _same_after(words, a, q, end)
            seen_lag, seen_end = q, last
            length = last - first + q
            if length >= LEAST_EXPONENT * q and length >= LEAST_LENGTH and _is_smallest(words, first, length, q):
                yield first, length, q
        period *= 2


def runs_of(words: np.ndarray, ends: np.ndarray) -> list[Run]:
    """(start, length, period) of the runs of several texts, one after another in ``words``, in order of start."""
    if not len(words):
        return []
    sizes = np.diff(np.concatenate([[0], ends]))
    text = np.repeat(np.arange(len(ends)), sizes)
    found = []
    # no run crosses into the next text: short lags see words made different by a gap between texts
    spaced = np.full(len(words) + SHORT * len(ends), -1, np.int64)
    spaced[np.arange(len(words)) + SHORT * text] = words
    gaps = np.flatnonzero(spaced < 0)
    spaced[gaps] = -1 - np.arange(len(gaps))
    for a, length, q in _short_runs(spaced):
        if _is_smallest(spaced, a, length, q):
            shift = SHORT * int(np.searchsorted(ends + SHORT * np.arange(len(ends)), a, side="right"))
            found.append((a - shift, length, q))
    return sorted({*found, *_seeded_runs(words, text, ends)}, key=lambda r: (r[0], r[2]))


def word_numbers(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all texts, equal for equal words, and where texts end."""
    numbers: dict[bytes, int] = {}
    flat = [numbers.setdefault(w, len(numbers)) for t in texts for w in t]
    return np.array(flat, np.int64), np.cumsum([len(t) for t in texts], dtype=np.int64)


def dropped_words(n: int, runs: list[Run]) -> np.ndarray:
    """Whether a word lies in a run after the run's first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        steps[start + q] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) > 0


def made_periodic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the query takes them: of every tenth document (by crc32 of its id) the end is periodic."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_DIGEST = pa.schema(
    [(name, pa.int64()) for name in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")]
    + [(name, pa.string()) for name in ("runs_sha256", "collapsed_sha256")]
)


def _searched(docs: DataFrame, schema: pa.Schema, row, prepare=lambda words, doc_id: words) -> DataFrame:
    """One row per document: ``row(doc_id, words, runs)`` gives its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", _BATCH_BYTES):
            ids = batch.column(0).to_pylist()
            texts = [prepare((t or "").encode().split(), i) for i, t in zip(ids, batch.column(1).to_pylist(), strict=True)]
            words, ends = word_numbers(texts)
            by_text: dict[int, list[Run]] = {}
            for start, length, q in runs_of(words, ends):
                k = int(np.searchsorted(ends, start, side="right"))
                by_text.setdefault(k, []).append((start - (int(ends[k - 1]) if k else 0), length, q))
            rows = [row(i, t, by_text.get(k, [])) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, from_arrow_schema(schema))


def _collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    if not runs:
        return b" ".join(words)
    gone = dropped_words(len(words), runs).tolist()
    return b" ".join(w for w, g in zip(words, gone, strict=True) if not g)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): all runs of each text, and the text with each run cut to its first period."""

    def row(doc_id, words, runs):
        found = [{"start": a, "length": n, "period": q} for a, n, q in runs]
        return doc_id, len(words), found, _collapsed(words, runs).decode()

    return _searched(docs, _FOUND, row)


def periodic_runs_digest(docs: DataFrame) -> DataFrame:
    """The runs of the made-periodic documents as numbers and hashes."""

    def row(doc_id, words, runs):
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        exponent = 1000 * best[1] // best[2] if runs else None
        listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        return (doc_id, len(runs), *best, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(_collapsed(words, runs)).hexdigest())

    return _searched(docs, _DIGEST, row, made_periodic)
