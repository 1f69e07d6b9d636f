"""Removal of repeated byte strings by sorted suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else as well. All suffixes
of a corpus cannot be moved about, so tasks sort those at anchors: each window of ``LENGTH`` bytes has
the place of its smallest gram hash as its anchor, which depends on its bytes alone, so equal windows
have equal anchors at equal offsets. Windows that share an anchor form a segment, the bytes they cover.

1. Each document's anchors, segments, and their hashes are written once.
2. Equal segments (128-bit hash, and the gram hash) are counted. Two occurrences mean that all their windows repeat.
3. Where different segments share a gram, one of each is fetched. What follows their anchors, and,
   reversed, what comes before, is put in order by deep-shallow sorting: multikey quicksort to a shallow
   depth, then blind tries for strings equal so far. Neighbours' common prefixes give, for each
   offset of the anchor in a window, the segments equal on either side: windows of equal classes
   on both sides are equal. This is exact, bytes are compared.
   A gram with more than ``GROUP`` different segments would meet in one task; its windows are
   counted one by one with partial sums instead, which is as exact (128-bit hashes) and costs more shuffling.
4. Repeating windows go back to their documents as byte ranges, which are joined and cut out.

Nulls: a null text is empty bytes. Rows with null doc_id take part and are returned; rows of equal id
and text repeat each other, and get equal results. Texts shorter than ``LENGTH`` are never cut. An empty table
gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmine.llm.common import materialise, partition_count, sliced, text_batches, text_or_empty
from gridmine.llm.suffix_sort import neighbours, sort

LENGTH, GRAM = 400, 128
#: Different segments of one gram that are sorted together; segments sorted at once.
GROUP, AT_ONCE = 20_000, 8_000
#: Keys (two longs) that may be broadcast to leave other documents out before a shuffle: 16 MB.
MOST_BROADCAST = 1_000_000
_CHUNK = 1 << 17
U64 = np.uint64
_PLACE = U64((1 << 20) - 1)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the gram at every place, by doubling; 8 bytes are taken exactly. ``gram`` is 8 times a power of two."""
    h = data.astype(U64)
    for k in (1, 2, 4):
        h = h[:-k] | (h[k:] << U64(8 * k))
    n = 8
    while True:
        h = h * U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(32)
        if n == gram:
            return h * U64(0xD6E8FEB86659FD93)
        h = h[:-n] * U64(0xC2B2AE3D27D4EB4F) + h[n:]
        n *= 2


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of the window at every place, and the gram hashes; at most 2**20 bytes at once."""
    h = gram_hashes(data, gram)
    low = (h & ~_PLACE) | np.arange(len(h), dtype=U64)
    span, have = length - gram + 1, 1
    while 2 * have <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    return (low & _PLACE).astype(np.int64), h


def segments(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, gram hash, two halves of the segment's hash) of a text."""
    n = len(raw) - length + 1
    found = []
    for first in range(0, n, _CHUNK):
        last = min(n, first + _CHUNK)
        data = np.frombuffer(raw, np.uint8, last - first + length - 1, first)
        a, h = anchors(data, length, gram)
        cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        found.append((a[cut] + first, cut + first, np.concatenate([cut[1:], [len(a)]]) - 1 + first, h[a[cut]].view(np.int64)))
    if not found:
        return (np.zeros(0, np.int64),) * 6
    a, lo, hi, h = (np.concatenate(x) for x in zip(*found, strict=True))
    blake = hashlib.blake2b
    digests = b"".join([blake(raw[x:y], digest_size=16).digest() for x, y in zip(lo.tolist(), (hi + length).tolist(), strict=True)])
    halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
    return a, lo, hi, h, halves[:, 0], halves[:, 1]


_SEGMENT = "a int, lo int, hi int, k long, s1 long, s2 long"


def _digest() -> Column:
    return F.xxhash64(F.lit(3), text_or_empty())


def segment_table(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, arrays of the segments' columns) of documents long enough to be cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int32, np.int32, np.int32, np.int64, np.int64, np.int64)
        for batch in sliced(batches, "text", 1 << 23):
            rows = [segments(raw) for raw in batch.column(2).cast(pa.binary()).to_pylist()]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[c] for r in rows]).astype(kind))) for c, kind in enumerate(kinds)]
            yield pa.record_batch([batch.column(0), batch.column(1), *lists], ["doc_id", "digest", "a", "lo", "hi", "k", "s1", "s2"])

    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), text_or_empty().alias("text")).where(F.octet_length("text") >= LENGTH)
    return rows.mapInArrow(run, "doc_id long, digest long, a array<int>, lo array<int>, hi array<int>, k array<long>, s1 array<long>, s2 array<long>")


def _exploded(table: DataFrame) -> DataFrame:
    zipped = F.arrays_zip("a", "lo", "hi", "k", "s1", "s2")
    return table.select("doc_id", "digest", F.explode(zipped).alias("s")).select("doc_id", "digest", "s.*")


def near_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose (doc_id, digest) is among the keys, before any shuffle if the keys are few."""
    few = keys.count() <= MOST_BROADCAST
    own = F.broadcast(keys) if few else keys
    return docs.join(own, docs["doc_id"].eqNullSafe(keys["_doc"]) & (docs["digest"] == keys["_digest"]), "left_semi")


def repeats(right: list[bytes], left: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Per segment, the runs of anchor offsets whose window equals one of another segment.

    ``right`` is what follows each anchor, ``left`` what comes before it, reversed. The window with
    the anchor at offset r has r bytes on the left and length - r on the right.
    """
    n = len(right)
    sides = []
    for strings in (left, right):
        order = sort(strings)
        sides.append((order, neighbours(strings, order)))
    lefts = np.array([len(x) for x in left])
    rights = np.array([len(x) for x in right])
    least, most = np.maximum(0, length - rights), np.minimum(lefts, length)
    top = int(most.max()) + 1
    equal = np.zeros((n, top + 1), bool)
    for r in range(int(least.min()), top):
        rows = np.flatnonzero((least <= r) & (r <= most))
        if len(rows) < 2:
            continue
        key = np.zeros(n, np.int64)
        for (order, common), need in zip(sides, (r, length - r), strict=True):
            group = np.empty(n, np.int64)
            group[order] = np.cumsum(common < need)
            key = key * (n + 1) + group
        _, inverse, counts = np.unique(key[rows], return_inverse=True, return_counts=True)
        equal[rows[counts[inverse] > 1], r] = True
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    padded = np.concatenate([np.zeros((n, 1), bool), equal], axis=1).astype(np.int8)
    row, at = np.nonzero(np.diff(padded, axis=1))
    for k in range(0, len(row), 2):
        out[row[k]].append((int(at[k]), int(at[k + 1]) - 1))
    return out


_RUNS = "doc_id long, digest long, first int, last int"


def _cut(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Segments with their bytes: (k, one, doc_id, digest, a, left, right); wanted rows of one document meet in its row."""
    parts = wanted.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("k", "one", "a", "lo", "hi")).alias("parts"))
    read = near_keys(docs, wanted.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")).distinct()).dropDuplicates(["doc_id", "digest"])
    own = parts.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), "parts")
    rows = read.join(own, read["doc_id"].eqNullSafe(own["_doc"]) & (read["digest"] == own["_digest"])).select("doc_id", "digest", F.encode("text", "UTF-8").alias("raw"), F.explode("parts").alias("s"))
    start, anchor, end = F.col("s.lo"), F.col("s.a"), F.col("s.hi") + LENGTH
    left = F.reverse(F.hex(F.substring("raw", start + 1, anchor - start)))
    # hex digits reversed swap the halves of a byte, alike for all, which keeps equality and prefixes
    right = F.substring("raw", anchor + 1, end - anchor)
    return rows.select("s.k", "s.one", "doc_id", "digest", anchor.alias("a"), F.unhex(left).alias("left"), right.alias("right"))


def sorted_repeats(cut: DataFrame) -> DataFrame:
    """Windows that repeat, of segments that occur once, from segments sorted by gram inside partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            k = held.column("k").to_numpy()
            ends = np.flatnonzero(k[1:] != k[:-1]) + 1
            if len(ends) and ends[-1] >= AT_ONCE:
                first = 0
                while first < ends[-1]:
                    # whole grams, about AT_ONCE segments
                    last = int(ends[min(np.searchsorted(ends, first + AT_ONCE), len(ends) - 1)])
                    yield from compare(held.slice(first, last - first))
                    first = last
                held = held.slice(first).combine_chunks()
        if held is not None and held.num_rows:
            k = held.column("k").to_numpy()
            ends = np.concatenate([np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
            first = 0
            while first < len(k):
                last = int(ends[min(np.searchsorted(ends, first + AT_ONCE), len(ends) - 1)])
                yield from compare(held.slice(first, last - first))
                first = last

    def compare(part: pa.Table) -> Iterator[pa.RecordBatch]:
        found = repeats(part.column("right").to_pylist(), part.column("left").to_pylist(), LENGTH)
        one, a = part.column("one").to_pylist(), part.column("a").to_pylist()
        doc, digest = part.column("doc_id").to_pylist(), part.column("digest").to_pylist()
        rows = [(doc[i], digest[i], a[i] - hi, a[i] - lo) for i, runs in enumerate(found) if one[i] for lo, hi in runs]
        if rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
            yield pa.record_batch(columns, ["doc_id", "digest", "first", "last"])

    n = partition_count(cut.sparkSession)
    return cut.repartition(n, "k").sortWithinPartitions("k").mapInArrow(run, _RUNS)


def counted_repeats(cut: DataFrame) -> DataFrame:
    """The same for grams of very many segments: every window on its own, counted by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                whole = row["left"][::-1] + row["right"]
                start = row["a"] - len(row["left"])
                n = len(whole) - LENGTH + 1
                raw = b"".join(hashlib.blake2b(whole[p : p + LENGTH], digest_size=16).digest() for p in range(n))
                w = np.frombuffer(raw, "<i8").reshape(-1, 2)
                same = [pa.array([row[c]] * n, t) for c, t in (("one", pa.bool_()), ("doc_id", pa.int64()), ("digest", pa.int64()))]
                yield pa.record_batch([pa.array(w[:, 0]), pa.array(w[:, 1]), *same, pa.array(np.arange(start, start + n, dtype=np.int32))], ["w1", "w2", "one", "doc_id", "digest", "first"])

    windows = materialise(cut.mapInArrow(run, "w1 long, w2 long, one boolean, doc_id long, digest long, first int"))
    twice = windows.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    return windows.where("one").join(twice, ["w1", "w2"]).select("doc_id", "digest", "first", F.col("first").alias("last"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, first, last): runs of window starts whose bytes occur at another place too."""
    table = materialise(segment_table(docs))
    every = _exploded(table)
    firsts = [F.first(c).alias(c) for c in ("doc_id", "digest", "a", "lo", "hi")]
    classes = every.groupBy("k", "s1", "s2").agg(F.count(F.lit(1)).alias("n"), *firsts)
    stats = classes.groupBy("k").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("all")).where("all > 1")
    shared = materialise(classes.join(stats.select("k", "d"), "k"))
    whole = shared.where("n > 1").select("k", "s1", "s2")
    runs = every.join(whole, ["k", "s1", "s2"]).select("doc_id", "digest", F.col("lo").alias("first"), F.col("hi").alias("last"))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), text_or_empty().alias("text"))
    wanted = shared.select("k", (F.col("n") == 1).alias("one"), "doc_id", "digest", "a", "lo", "hi", "d")
    few, many = wanted.where((F.col("d") > 1) & (F.col("d") <= GROUP)), wanted.where(F.col("d") > GROUP)
    runs = runs.unionByName(sorted_repeats(_cut(read, few)))
    if shared.where(F.col("d") > GROUP).limit(1).count():
        runs = runs.unionByName(counted_repeats(_cut(read, many)))
    return materialise(runs)


def removed_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, ranges): byte ranges [start, end) to remove, joined and in order."""
    runs = repeated_windows(docs)
    grouped = runs.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set(F.struct(F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end")))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(2).to_pylist():
                joined: list[list[int]] = []
                for p in parts:
                    if joined and p["start"] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], p["end"])
                    else:
                        joined.append([p["start"], p["end"]])
                out.append([{"start": a, "end": b} for a, b in joined])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, kind)], ["doc_id", "digest", "ranges"])

    return grouped.mapInArrow(run, "doc_id long, digest long, ranges array<struct<start:int,end:int>>")


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, kept, ranges) of documents that lose bytes; ``kept`` is what remains, as bytes."""
    ranges = materialise(removed_ranges(docs))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), text_or_empty().alias("text"))
    read = near_keys(read, ranges.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"))).dropDuplicates(["doc_id", "digest"])
    own = ranges.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), "ranges")
    joined = read.join(own, read["doc_id"].eqNullSafe(own["_doc"]) & (read["digest"] == own["_digest"])).select("doc_id", "digest", F.encode("text", "UTF-8").alias("raw"), "ranges")
    starts = F.concat(F.array(F.lit(0)), F.col("ranges")["end"])
    ends = F.concat(F.col("ranges")["start"], F.array(F.octet_length("raw")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.hex(F.substring("raw", a + 1, b - a)))
    return joined.select("doc_id", "digest", F.unhex(F.array_join(pieces, "")).alias("kept"), "ranges")


def suffix_dedup_digest(docs: DataFrame) -> DataFrame:
    kept = without_repeats(docs)
    removed = F.aggregate("ranges", F.lit(0).cast("long"), lambda acc, r: acc + (r["end"] - r["start"]).cast("long"))
    kept = materialise(kept.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), removed.alias("n_removed"), F.size("ranges").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("sha")))
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(F.encode(text, "UTF-8"), 256).alias("own_sha"))
    joined = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_doc"]) & (rows["digest"] == kept["_digest"]), "left")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("sha", "own_sha").alias("kept_sha256"))
