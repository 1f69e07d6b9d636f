"""Toxicity scores from a counterfactual-regularised linear classifier.

A document's features are its distinct words and word beginnings (64-bit hashes). Labelled rows are
learned from with each sentence that names an identity group twice: as it is, and with the terms of
that kind swapped for others of the kind. The loss is cross-entropy plus a penalty on the squared change of
score, so that naming a group does not by itself move a score.

``SAMPLE`` bounds the labelled rows of each class the model is fitted on (chosen by a hash of
doc_id); one task fits it. Every document is then scored, whole, in one pass without a shuffle.
Label, language, source and doc_id are no inputs of a score.

Nulls: a null text is an empty one and gets the score of a document without known features; labels that
are null or belong to no document are left out; of differing labels of one doc_id the largest counts, and of several
texts of one doc_id one is learned from (that of the least hash). A null
doc_id counts as held out. Without rows of both classes, the score is the share of toxic labels (0.0 without
any). An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmine.llm.common import sliced, text_batches, text_or_empty
from gridmine.llm.linear import fit, sigmoid
from gridmine.llm.text_hash import U64, mix, words_of

#: Rows per class the model is fitted on, at most (in expectation; chosen by hash).
SAMPLE = 2500
#: Texts whose features are in memory before repeats are dropped.
_TEXTS_AT_ONCE = 64
#: Features kept: those whose presence differs most between the classes.
FEATURES = 8192
#: A feature must be in so many rows, and its log odds so many standard errors from 0.
LEAST_ROWS, LEAST_Z = 4, 3.0
HEADS = (4, 5, 6)
PENALTY = 1.0
#: Identity terms by kind; a term is swapped for the next of its kind.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual"),
    ("woman", "man"),
    ("women", "men"),
    ("girl", "boy"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("american", "mexican", "chinese", "indian", "german", "french", "spanish", "russian", "turkish", "polish"),
    ("old", "young"),
    ("disabled", "blind", "deaf"),
    ("frau", "mann"),
    ("muslime", "christen", "juden"),
    ("femme", "homme"),
    ("musulman", "chrétien", "juif"),
    ("mujer", "hombre"),
    ("musulmán", "cristiano", "judío"),
)
_NEXT = {t: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, t in enumerate(kind)}
#: Bytes that are no part of a word: ASCII other than letters and digits.
_APART = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def swapped(text: str, terms: re.Pattern) -> str | None:
    """The text with its identity terms swapped within their kinds; None if it has none."""
    new, n = terms.subn(lambda m: _NEXT[m.group().lower()], text)
    return new if n else None


def identity_pattern() -> re.Pattern:
    return re.compile(r"(?i)(?<!\w)(?:" + "|".join(sorted(map(re.escape, _NEXT), key=len, reverse=True)) + r")(?!\w)")


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of words and word beginnings, in no order and with repeats."""
    hashes, _, at, firsts = words_of(texts, _APART, HEADS)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    parts = [(owner, hashes)]
    for k, first in zip(HEADS, firsts, strict=True):
        here = first != 0
        parts.append((owner[here], mix(first[here] + U64(k))))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes per text, and where each text's begin."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])]) if len(owner) else np.zeros(0, bool)
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=n))])


Features = tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], list[np.ndarray], list[int]]


def gathered(parts: Iterator[list[str]]) -> Features:
    """Distinct features of texts (hashes, sizes), of their swapped twins (hashes, sizes), and whose twins these are."""
    terms = identity_pattern()
    out: Features = ([], [], [], [], [])
    n = 0
    for texts in parts:
        twins = [(n + i, s) for i, s in ((i, swapped(t, terms)) for i, t in enumerate(texts)) if s is not None]
        for at, some in ((0, texts), (2, [s for _, s in twins])):
            hashes, ends = _distinct(*features([t.encode() for t in some]), len(some))
            out[at].append(hashes)
            out[at + 1].append(np.diff(ends))
        out[4].extend(i for i, _ in twins)
        n += len(texts)
    return out


def train(texts: list[str], toxic: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, most_features: int = FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted feature hashes, their weights, bias) from labelled texts."""
    return train_on(gathered(texts[k : k + _TEXTS_AT_ONCE] for k in range(0, len(texts), _TEXTS_AT_ONCE)), toxic, weight, penalty, most_features)


def train_on(found: Features, toxic: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, most_features: int = FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """As ``train``, from gathered features."""
    hashes = np.concatenate([np.zeros(0, U64), *found[0], *found[2]])
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *found[1], *found[3]]))])
    twin_of = np.array(found[4], np.int64)
    n, n_every = len(toxic), len(toxic) + len(twin_of)
    own = hashes[: at[n]]
    names, code = np.unique(own, return_inverse=True)
    row = np.repeat(np.arange(n), np.diff(at[: n + 1]))
    held = toxic[row] == 1
    pos, neg = np.bincount(code[held], minlength=len(names)), np.bincount(code[~held], minlength=len(names))
    n_pos, n_neg = max(int((toxic == 1).sum()), 1), max(int((toxic == 0).sum()), 1)
    # smoothed log odds over their standard error, of the features that enough rows hold
    odds = np.log((pos + 0.5) / (n_pos - pos + 0.5)) - np.log((neg + 0.5) / (n_neg - neg + 0.5))
    z = np.abs(odds) / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    z[(pos + neg < LEAST_ROWS) | (z < LEAST_Z)] = 0
    best = np.sort(np.argsort(-z, kind="stable")[:most_features])
    names = names[best[z[best] > 0]]
    place = np.searchsorted(names, hashes)
    known = (place < len(names)) & (names[np.minimum(place, len(names) - 1)] == hashes) if len(names) else np.zeros(len(hashes), bool)
    owner = np.repeat(np.arange(n_every), np.diff(at))[known]
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_every))])
    target = np.concatenate([toxic.astype(float), np.zeros(len(twin_of))])
    weights = np.concatenate([weight, np.zeros(len(twin_of))])
    pairs = (twin_of, n + np.arange(len(twin_of)))
    w, bias = fit(place[known], np.ones(int(known.sum())), starts, target, weights, max(len(names), 1), 1e-4, 200, 0.1, pairs, penalty)
    return names, w[: len(names)], bias


def _labels(labels: DataFrame, column: str) -> DataFrame:
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))


def held_out():
    """Rows never learned from: crc32 of doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 5 == 0


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, float]:
    """The model, from at most about ``sample`` labelled rows of each class that are not held out."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    known = _labels(labels, "toxic").where(~held_out()).join(read.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts.get(0) or not counts.get(1):
        share = 1.0 if counts.get(1) else 0.0
        return np.zeros(0, U64), np.zeros(0), 30.0 if share else -30.0
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 40))
    chosen = known.where(F.when(F.col("label") == 1, draw < 2.0**40 * sample / counts[1]).otherwise(draw < 2.0**40 * sample / counts[0]))
    # the chosen rows are bounded by the sample, so they may be broadcast and, one for each doc_id, meet in one task
    rows = read.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    rows = rows.select("t.text", "label").repartition(1).sortWithinPartitions("label", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: list[int] = []

        def texts() -> Iterator[list[str]]:
            for batch in sliced(batches, "text", 1 << 18):
                toxic.extend(batch.column(1).to_pylist())
                yield batch.column(0).to_pylist()

        found = gathered(texts())
        y = np.array(toxic)
        if not len(y):
            return
        n1 = max(int((y == 1).sum()), 1)
        n0 = max(int((y != 1).sum()), 1)
        names, w, bias = train_on(found, y, np.where(y == 1, 1 / n1, 1 / n0), penalty)
        yield pa.record_batch([pa.array([names.tobytes()]), pa.array([w.tobytes()]), pa.array([float(bias)])], ["names", "w", "bias"])

    got = rows.mapInArrow(run, "names binary, w binary, bias double").first()
    if got is None:  # a sample of nothing
        return np.zeros(0, U64), np.zeros(0), 0.0
    return np.frombuffer(got["names"], U64), np.frombuffer(got["w"], np.float64), got["bias"]


def scorer(names: np.ndarray, w: np.ndarray, bias: float):
    """Texts to scores: the sum of weights of the known features each holds."""
    mask = U64((1 << 20) - 1)
    maybe = np.zeros(1 << 20, bool)
    maybe[(names & mask).astype(np.int64)] = True

    def score(texts: list[bytes]) -> np.ndarray:
        owner, hashes = features(texts)
        likely = maybe[(hashes & mask).astype(np.int64)]
        owner, hashes = owner[likely], hashes[likely]
        place = np.searchsorted(names, hashes)
        here = (place < len(names)) & (names[np.minimum(place, len(names) - 1)] == hashes) if len(names) else np.zeros(len(hashes), bool)
        pairs = np.unique(owner[here] * np.int64(max(len(names), 1)) + place[here])
        sums = np.bincount(pairs // max(len(names), 1), w[pairs % max(len(names), 1)] if len(names) else None, len(texts))
        return sigmoid(sums + bias)

    return score


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fitted(text_batches(docs), labels, sample, penalty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(*model)
        for batch in sliced(batches, "text", 1 << 18):
            own = score(batch.column(2).cast(pa.binary()).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(own), pa.array((own >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


