"""Quality classifier from weak labels.

Overlapping heuristic labelers look at a document's style and vote good, bad or abstain. Expectation-
maximisation over the counts of vote patterns of all documents estimates how each labeler votes on good
and on bad documents, and gives every pattern a posterior. The posteriors train a linear scorer over hashed
features (word shapes, words, word beginnings, repetition), which judges every document.

Vote patterns are bounded (``3 ** len(LABELERS)``), whatever the input; their counts cover all
documents. ``SAMPLE`` bounds the different texts whose posteriors the scorer is fitted on (chosen by a hash
of the text); one task fits it.

Nulls: a null text is an empty one; a text without words is rejected with score 0. Rows with null or
repeated doc_id are judged one by one. If the sample is empty, every text with words scores 0.5. An empty table gives an empty result. Extra columns are kept
by ``clean_documents`` and not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmine.llm.common import materialise, sliced, text_batches, text_or_empty
from gridmine.llm.linear import fit, row_sums, sigmoid
from gridmine.llm.text_hash import U64, mix, words_of

LABELERS = ("symbols", "shouting", "repeats", "variety", "marks", "endings", "word_length", "length")
ABSTAIN, BAD, GOOD = 0, 1, 2
SAMPLE = 6000
#: Values of the hash that samples texts.
_PICKS = 1 << 40
BITS = 16
EM_ROUNDS = 40
#: Chances of abstain, bad and good on bad and on good documents before any data, and the prior's weight
#: as a share of all documents: bad is seldom said of a good document, good often enough of a bad one.
_PRIOR = ((0.3, 0.35, 0.35), (0.4, 0.005, 0.595))
_PRIOR_WEIGHT = 0.1
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>{}=~^_\\"]] = True
_UPPER = np.array([65 <= i <= 90 for i in range(256)])
_LETTER = np.array([65 <= i <= 90 or 97 <= i <= 122 or i >= 128 for i in range(256)])
#: Bytes by class for word shapes: upper case A, lower case and other letters a, digits 0, the rest as it is.
_SHAPE = bytes(65 if _UPPER[i] else 97 if _LETTER[i] else 48 if 48 <= i <= 57 else i for i in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[at[1:]] - sums[at[:-1]]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def votes(texts: list[bytes]) -> np.ndarray:
    """One row per text, one column per labeler."""
    hashes, lengths, at, _ = words_of(texts)
    n = np.diff(at)
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    bytes_at = np.cumsum([1, *[len(t) + 1 for t in texts]])
    off = _BLANK[data]
    starts = np.flatnonzero(off[:-1] & ~off[1:]) + 1
    ends = np.flatnonzero(~off[:-1] & off[1:]) + 1
    upper = np.concatenate([[0], np.cumsum(_UPPER[data], dtype=np.int64)])
    letter = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
    first = np.zeros(len(starts), bool)
    first[at[:-1][n > 0]] = True
    n_letters = letter[ends] - letter[starts]
    shout = (n_letters >= 2) & ((upper[ends] - upper[starts]) * 2 > n_letters)
    same = np.concatenate([[False], hashes[1:] == hashes[:-1]]) & ~first if len(hashes) else np.zeros(0, bool)
    last = data[ends - 1]
    before = np.where(lengths > 1, data[np.maximum(ends - 2, 0)], 0)
    marks = (_SYMBOL[last] & ~_LETTER[last]) | ((last == 33) & (before == 33))
    ended = np.isin(last, np.frombuffer(b".!?:;)\"'", np.uint8))
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
    n_bytes = np.diff(bytes_at) - 1
    # lines: a word is the last of its line if a line break follows before the next word
    breaks = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int64)])
    next_start = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
    line_end = breaks[next_start] > breaks[ends] if len(starts) else np.zeros(0, bool)
    n_lines = _per_text(line_end, at)

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))

    symbols = _share(_per_text(_SYMBOL[data], bytes_at), n_bytes)
    shouted, repeated, marked = (_share(_per_text(x, at), n) for x in (shout, same, marks))
    variety, mean = _share(distinct, n), _share(_per_text(lengths, at), n)
    closed = _share(_per_text(ended & line_end, at), n_lines)
    # who looks for one fault says nothing where it is absent
    never = np.zeros(len(texts), bool)
    out = np.stack(
        [
            vote(symbols > 0.03, never),
            vote(shouted > 0.3, never),
            vote(repeated > 0.2, never),
            vote((variety < 0.2) & (n >= 50) & (n < 5000), variety > 0.35),
            vote(marked > 0.1, never),
            vote((closed < 0.1) & (n_lines > 0) & (n >= 30), closed > 0.5),
            vote((mean < 2) | (mean > 20), (mean >= 3) & (mean <= 15)),
            vote(n < 2, n >= 5),
        ],
        axis=1,
    )
    return out.astype(np.int8)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, value, first of each text and the end): shares of a text's words, one family after the other."""
    hashes, _, at, heads = words_of(texts, heads=(3,))
    n = np.diff(at)
    classes = np.frombuffer((b"\n" + b"\n".join(texts) + b"\n").translate(_SHAPE), np.uint8)
    run_starts = np.concatenate([[True], classes[1:] != classes[:-1]])
    bytes_at = np.cumsum([1, *[len(t) + 1 for t in texts]])
    # a run of equal classes counts once, so a shape is short; line breaks between texts are kept
    run_starts[bytes_at - 1] = True
    shapes, cut = [], classes[run_starts]
    place = np.cumsum(run_starts) - 1
    bounds = place[bytes_at - 1]
    raw = cut.tobytes()
    shapes = [raw[a + 1 : b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    shaped, _, shape_at, _ = words_of([s.replace(b"A", b"\x01") for s in shapes])
    first = np.zeros(len(hashes), bool)
    first[at[:-1][n > 0]] = True
    same = np.concatenate([[False], hashes[1:] == hashes[:-1]]) & ~first if len(hashes) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(texts)), n)
    shape_owner = np.repeat(np.arange(len(texts)), np.diff(shape_at))
    families = [(owner, hashes), (owner, mix(heads[0] + U64(3))), (shape_owner, mix(shaped + U64(5))), (owner, np.where(same, U64(7), U64(11)))]
    owners = np.concatenate([f[0] for f in families])
    index = np.concatenate([(mix(f[1]) >> U64(64 - BITS)).astype(np.int64) for f in families])
    value = np.concatenate([1.0 / np.maximum(n, 1)[f[0]] for f in families])
    order = np.argsort(owners, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(texts)))])
    return index[order], value[order], ends


def _summed(index: np.ndarray, value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal features of a text added up."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keys, inverse = np.unique(owner * np.int64(1 << BITS) + index, return_inverse=True)
    return keys % (1 << BITS), np.bincount(inverse, value, len(keys)), np.searchsorted(keys // (1 << BITS), np.arange(len(at)))


def pattern_code(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.int64) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def fit_labelers(patterns: Iterable[tuple[int, int]]) -> tuple[float, list[list[list[float]]], dict[int, float]]:
    """EM: (share of good documents, per labeler the chance of each vote given [bad, good], posterior by pattern)."""
    patterns = list(patterns)
    n = len(LABELERS)
    cells = [[code // 3**k % 3 for k in range(n)] for code, _ in patterns]
    total = sum(m for _, m in patterns)
    share, chance = 0.8, [[list(row) for row in _PRIOR] for _ in range(n)]
    posterior = [0.5] * len(patterns)
    for _ in range(EM_ROUNDS):
        for i, row in enumerate(cells):
            bad, good = math.log(1 - share), math.log(share)
            for k, c in enumerate(row):
                bad += math.log(chance[k][0][c])
                good += math.log(chance[k][1][c])
            posterior[i] = 1 / (1 + math.exp(max(-500.0, min(500.0, bad - good))))
        share = (1 + sum(q * m for q, (_, m) in zip(posterior, patterns, strict=True))) / (2 + total)
        for k in range(n):
            counts = [[_PRIOR_WEIGHT * total * c for c in row] for row in _PRIOR]
            for row, q, (_, m) in zip(cells, posterior, patterns, strict=True):
                counts[0][row[k]] += (1 - q) * m
                counts[1][row[k]] += q * m
            chance[k] = [[c / sum(r) for c in r] for r in counts]
    return share, chance, {code: q for (code, _), q in zip(patterns, posterior, strict=True)}


def _pick() -> Column:
    """Hash of the text to sample by, up to ``_PICKS``."""
    return F.pmod(F.xxhash64(F.lit(13), text_or_empty()), F.lit(_PICKS))


def vote_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern, pick): the votes of each document, and a hash to sample by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 18):
            code = pattern_code(votes(batch.column(2).cast(pa.binary()).to_pylist()))
            yield pa.record_batch([batch.column(0), pa.array(code.astype(np.int32)), batch.column(1)], ["doc_id", "pattern", "pick"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _pick().alias("pick"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, pattern int, pick long")


def fitted(docs: DataFrame, sample: int = SAMPLE) -> tuple[dict[int, float], np.ndarray, float]:
    """(posterior by vote pattern, weights, bias)."""
    texts_met = materialise(vote_rows(text_batches(docs)).groupBy("pick", "pattern").agg(F.count(F.lit(1)).alias("rows")))
    counts = texts_met.groupBy("pattern").agg(F.sum("rows").alias("rows")).collect()  # bounded by the labelers
    if not counts:
        return {}, np.zeros(1 << BITS), 0.0
    posterior = fit_labelers((r["pattern"], r["rows"]) for r in sorted(counts))[2]
    # the share is one of different texts, so that copies do not thin out the sample
    chosen = docs.select(text_or_empty().alias("text"), _pick().alias("pick")).where(F.col("pick") < _PICKS * sample / texts_met.count()).dropDuplicates(["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, targets = [], []
        for batch in sliced(batches, "text", 1 << 18):
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            code = pattern_code(votes(texts))
            parts.append(_summed(*features(texts)))
            targets += [posterior.get(c, 0.5) for c in code.tolist()]
        if not parts:
            return
        index, value = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        sizes = np.concatenate([np.diff(p[2]) for p in parts])
        y = np.array(targets)
        good = max(y.sum(), 1e-9)
        weight = y / good + (1 - y) / max((1 - y).sum(), 1e-9)
        w, bias = fit(index, value, np.concatenate([[0], np.cumsum(sizes)]), y, weight, 1 << BITS, 1e-6, 150, 0.3)
        yield pa.record_batch([pa.array([w.astype(np.float32).tobytes()]), pa.array([float(bias)])], ["w", "bias"])

    # the sample is bounded, so it may meet in one task; sorted, so that reruns agree
    got = chosen.select("text").repartition(1).sortWithinPartitions(F.xxhash64("text")).mapInArrow(run, "w binary, bias double").first()
    if got is None:
        return posterior, np.zeros(1 << BITS), 0.0
    return posterior, np.frombuffer(got["w"], np.float32).astype(np.float64), got["bias"]


def judged(docs: DataFrame, sample: int = SAMPLE, keep_from: float = 0.5) -> DataFrame:
    """(doc_id, digest, pattern, posterior, score, kept) of every document."""
    posterior, w, bias = fitted(docs, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 18):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            index, value, at = features(texts)
            code = pattern_code(votes(texts))
            empty = np.diff(at) == 0
            score = np.where(empty, 0.0, sigmoid(row_sums(w[index] * value, at) + bias))
            own = np.array([posterior.get(c, 0.5) for c in code.tolist()])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(code.astype(np.int32)), pa.array(own), pa.array(score), pa.array(score >= keep_from)], ["doc_id", "digest", "pattern", "posterior", "score", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(17), text_or_empty()).alias("digest"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest long, pattern int, posterior double, score double, kept boolean")


def clean_documents(docs: DataFrame, sample: int = SAMPLE, keep_from: float = 0.5) -> DataFrame:
    """Documents that are kept, with all their columns."""
    posterior, w, bias = fitted(docs, sample)
    at = docs.columns.index("text")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 18):
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            index, value, ends = features(texts)
            kept = (np.diff(ends) > 0) & (sigmoid(row_sums(w[index] * value, ends) + bias) >= keep_from)
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, schema)


def quality_digest(docs: DataFrame) -> DataFrame:
    out = judged(docs)
    names = [F.lit(x) for x in LABELERS]
    power = [F.lit(3**k) for k in range(len(LABELERS))]
    bad = F.filter(F.array(*[F.when((F.floor(F.col("pattern") / p) % 3) == BAD, n) for p, n in zip(power, names, strict=True)]), lambda x: x.isNotNull())
    return out.select("doc_id", F.array_join(bad, ",").alias("called_bad_by"), "posterior", "score", "kept")
