"""Near duplicates by MinHash bands, verified by odd sketches and confirmed on full sets.

1. Each text becomes its set of word shingles, ``SAMPLES`` MinHash samples of the set, and an odd sketch: a
   bitmap of ``BITS`` bits in which every sample flips one bit. Sample differences of two sets do not cancel, so
   the number of ones in the XOR of two sketches tells how many samples differ, best where few do.
2. Rows of equal sets are one class. ``BANDS`` bands of ``ROWS`` samples put classes into buckets.
3. Inside a bucket, classes whose sketches differ no more than those of linked sets may are joined; a
   bucket emits a spanning forest of these verified candidates, not its pairs. A bucket of over ``BUCKET_ROWS`` classes
   is streamed and all its classes are joined to the first, unverified. Components of the candidates are groups: two
   linked sets that share a bucket and pass the sketch lie in one group.
4. Links are confirmed on the full sets of a group, whose texts are shuffled once. A group above
   ``BLOCK_ROWS`` rows or ``BLOCK_CELLS`` shingles is cut into blocks, which meet through four rows that go to every
   block. Only rows outside the group's largest component are then compared with the other blocks, so a large
   group of copies costs its size. Inside a block, rows already connected are not compared, and sketches
   are asked before sets.
5. Components of the confirmed links give each document the smallest id it can reach.

No link is made without its full sets. A pair at the threshold itself shares no bucket with probability
``(1 - t**ROWS) ** BANDS`` (1.3e-6 at 0.8, less above), and fails the sketch with that of ``SIGMAS`` standard deviations (3e-6).
Sets are compared by 64-bit hashes of shingles, and classes by a 64-bit hash of the set.

Nulls: a null or empty text has no shingles and links with nothing. Rows without doc_id get their count, no
component, and are not kept. Rows of equal doc_id are one document: their texts count as linked. An empty table gives
an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmine.llm.common import materialise, partition_count, sliced, text_batches, text_or_empty
from gridmine.llm.components import components
from gridmine.llm.text_hash import U64, mix, shingle_sets

BANDS, ROWS, SAMPLES, BITS, SIGMAS = 34, 5, 256, 512, 4.5
BUCKET_ROWS, BLOCK_ROWS, BLOCK_CELLS = 4096, 4096, 1_000_000
#: Classes placed in groups (rows of some 160 bytes) that may be broadcast to their texts: 48 MB.
MOST_BROADCAST = 300_000
_WORDS = BITS // 64
_BATCH_BYTES = 1 << 18
_draw = np.random.Generator(np.random.PCG64(20250117))
_FACTORS = _draw.integers(1, 2**63, SAMPLES, dtype=U64) * U64(2) + U64(1)
_MASKS = _draw.integers(0, 2**63, SAMPLES, dtype=U64)


def minhash(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(n, SAMPLES) smallest hash of each set under each function; sets must not be empty."""
    out = np.empty((SAMPLES, len(at) - 1), U64)
    for k in range(SAMPLES):
        out[k] = np.minimum.reduceat((sets ^ _MASKS[k]) * _FACTORS[k], at[:-1])
    return np.ascontiguousarray(out.T)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """(n, BITS / 64) parity bitmaps of the samples."""
    bit = (mix(samples ^ (np.arange(SAMPLES, dtype=U64) * U64(0x9E3779B97F4A7C15))) >> U64(40)) % U64(BITS)
    n = len(samples)
    flips = np.bincount((np.arange(n)[:, None] * BITS + bit.astype(np.int64)).ravel(), minlength=n * BITS)
    bits = (flips & 1).astype(np.uint8).reshape(n, BITS)
    return np.packbits(bits, axis=1, bitorder="little").view(U64)


def band_hashes(samples: np.ndarray) -> np.ndarray:
    """(n, BANDS) hashes of ROWS samples each, different from band to band."""
    out = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U64)), (len(samples), BANDS)).copy()
    for k in range(ROWS):
        out = mix(out * U64(0xA0761D6478BD642F) + samples[:, k : BANDS * ROWS : ROWS])
    return out


def estimate(different: float) -> float:
    """Similarity of two sets whose sketches differ in so many bits."""
    share = min(1 - 2 * different / BITS, 1.0)
    return 1 + BITS / (4 * SAMPLES) * math.log(share) if share > 0 else -math.inf


def most_bits(percent: int) -> int:
    """Bits in which sketches of sets at the threshold differ at most, but for ``SIGMAS`` standard deviations."""
    unlike = SAMPLES * (1 - percent / 100)
    flips = 2 * unlike  # each unlike sample flips one bit on either side
    fade = math.exp(-2 * flips / BITS)
    mean = BITS / 2 * (1 - fade)
    of_bits = BITS / 4 * (1 - fade**2) - flips * fade**2
    of_samples = 4 * unlike * percent / 100 * fade**2
    return min(BITS, math.floor(mean + SIGMAS * math.sqrt(of_bits + of_samples)))


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def sketched(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes and sketches of sets, zeros for empty ones."""
    filled = np.flatnonzero(np.diff(at))
    bands, sketch = np.zeros((len(at) - 1, BANDS), U64), np.zeros((len(at) - 1, _WORDS), U64)
    if len(filled):
        samples = minhash(sets, np.concatenate([at[filled], at[-1:]]))
        bands[filled], sketch[filled] = band_hashes(samples), odd_sketches(samples)
    return bands, sketch


def _digest():
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(text_or_empty())


def sketch_rows(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, digest, n, h, bands, sketch) of each row: size and hash of its set, its buckets and odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", _BATCH_BYTES):
            sets, at = shingle_sets(_texts(batch.column(2)), shingle)
            sizes = np.diff(at)
            h = np.zeros(len(sizes), U64)
            filled = np.flatnonzero(sizes)
            if len(filled):
                h[filled] = mix(np.add.reduceat(mix(sets), at[filled]) + sizes[filled].astype(U64))
            bands, sketch = sketched(sets, at)
            lists = [pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], np.int32), pa.array(v.ravel().view(np.int64))) for v in (bands, sketch)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes), pa.array(h.view(np.int64)), *lists], ["doc_id", "digest", "n", "h", "bands", "sketch"])

    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest long, n long, h long, bands array<long>, sketch array<long>")


def _different(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sketches ^ one).sum(axis=1, dtype=np.int64)


def forest(n: np.ndarray, sketches: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs that connect all rows whose sizes and sketches allow a link; one less than rows at most."""
    allowed = most_bits(percent)
    root = np.arange(len(n))
    out = []
    for i in range(len(n) - 1):
        rest = np.arange(i + 1, len(n))
        rest = rest[(root[rest] != root[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))]
        if not len(rest):
            continue
        for j in rest[_different(sketches[rest], sketches[i]) <= allowed].tolist():
            if root[j] != root[i]:
                out.append((i, j))
                root[root == root[j]] = root[i]
    return out


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between classes that share a bucket and pass the sketch, as spanning forests of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by bucket; a bucket is held up to BUCKET_ROWS rows, beyond that streamed
        part, rows, first, pairs = None, [], None, []

        def close() -> None:
            if len(rows) > 1:
                h, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
                if first is None:
                    found = forest(n, np.array([r[2] for r in rows], np.int64).view(U64), percent)
                    pairs.extend((int(h[i]), int(h[j])) for i, j in found)

        def out() -> pa.RecordBatch:
            a, b = zip(*pairs, strict=True)
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            sketches = batch.column(3).flatten().to_numpy().reshape(-1, _WORDS)
            for key, h, n, sketch in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), sketches, strict=True):
                if key != part:
                    close()
                    part, rows, first = key, [], None
                if first is not None:
                    pairs.append((first, h))
                else:
                    rows.append((h, n, sketch))
                    if len(rows) > BUCKET_ROWS:
                        first = rows[0][0]
                        pairs.extend((first, r[0]) for r in rows[1:])
                        rows = []
                if len(pairs) > 100_000:
                    yield out()
                    pairs.clear()
        close()
        if pairs:
            yield out()

    n = partition_count(classes.sparkSession)
    parts = classes.select(F.explode("bands").alias("part"), "h")
    beside = Window.partitionBy("part").orderBy("h")
    shared = F.lag("h").over(beside).isNotNull() | F.lead("h").over(beside).isNotNull()
    parts = parts.select("part", "h", shared.alias("shared")).where("shared").select("part", "h")
    rows = parts.join(classes.select("h", "n", "sketch"), "h").select("part", "h", "n", "sketch")
    return rows.repartition(n, "part").sortWithinPartitions("part", "h").mapInArrow(run, "a long, b long").distinct()


def confirmed(sets: list[np.ndarray], sketches: np.ndarray, sides: np.ndarray, roots: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect rows of different roots; of rows from two sides only pairs across are compared."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(sets)
    _, code = np.unique(flat, return_inverse=True)
    flag = np.zeros(int(code.max()) + 1, bool)
    allowed = most_bits(percent)
    across = len(set(sides.tolist())) > 1
    _, root = np.unique(roots, return_inverse=True)
    links = []
    for i in range(n - 1):
        near = np.arange(i + 1, n)
        near = near[(root[near] != root[i]) & (100 * np.minimum(sizes[near], sizes[i]) >= percent * np.maximum(sizes[near], sizes[i]))]
        if across:
            near = near[sides[near] != sides[i]]
        near = near[_different(sketches[near], sketches[i]) <= allowed]
        if not len(near):
            continue
        flag[code[at[i] : at[i + 1]]] = True
        lengths = sizes[near]
        begin = np.cumsum(lengths) - lengths
        cells = np.repeat(at[near] - begin, lengths) + np.arange(lengths.sum())
        common = np.add.reduceat(flag[code[cells]].astype(np.int64), begin)
        flag[code[at[i] : at[i + 1]]] = False
        for j in near[100 * common >= percent * (sizes[near] + sizes[i] - common)].tolist():
            if root[j] != root[i]:
                links.append((i, j))
                root[root == root[j]] = root[i]
    return links


def _block_links(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) from rows (c, i, j, side, h, root, sketch, text), compared within blocks (c, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def links() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            h, root, side = (np.array([r[k] for r in held]) for k in (0, 1, 2))
            found = confirmed([r[3] for r in held], np.array([r[4] for r in held]), side, root, percent)
            if not found:
                return None
            a, b = np.array(found).T
            return pa.record_batch([pa.array(h[a]), pa.array(h[b])], ["a", "b"])

        for batch in sliced(batches, "text", _BATCH_BYTES):
            sets, at = shingle_sets(_texts(batch.column(7)), shingle)
            sketches = batch.column(6).flatten().to_numpy().view(U64).reshape(-1, _WORDS)
            keys = zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True)
            side, h, root = (batch.column(k).to_pylist() for k in (3, 4, 5))
            for k, now in enumerate(keys):
                if now != key:
                    out = links()
                    if out is not None:
                        yield out
                    key, held = now, []
                if not held or held[-1][0] != h[k]:  # rows of equal id and text bring their class again
                    held.append((h[k], root[k], side[k], sets[at[k] : at[k + 1]].copy(), sketches[k].copy()))
        out = links()
        if out is not None:
            yield out

    n = partition_count(rows.sparkSession)
    rows = rows.select("c", "i", "j", "side", "h", "root", "sketch", "text").repartition(n, "c", "i", "j").sortWithinPartitions("c", "i", "j", "side", "h")
    return rows.mapInArrow(run, "a long, b long")


def _with_texts(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """The placed classes (with _doc, _digest) and their texts."""
    text = docs.select(F.col("doc_id").cast("long").alias("_t_doc"), _digest().alias("_t_digest"), text_or_empty().alias("text"))
    cells = F.broadcast(cells) if cells.count() <= MOST_BROADCAST else cells
    return text.join(cells, (cells["_doc"] == text["_t_doc"]) & (cells["_digest"] == text["_t_digest"])).drop("_t_doc", "_t_digest")


def links_of_groups(docs: DataFrame, classes: DataFrame, groups: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) that connect the classes of each group (h, c) as its full sets do."""
    cells = classes.select("h", "rep", "n", "sketch").join(groups, "h")
    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_CELLS)).cast("long")
    sizes = cells.groupBy("c").agg(size.alias("blocks"), F.array(F.min("h"), F.max("h"), F.min_by("h", F.xxhash64("h", F.lit(7))), F.max_by("h", F.xxhash64("h", F.lit(7)))).alias("shared"))
    large = materialise(sizes.where("blocks > 1"))  # at most one row per BLOCK_ROWS classes
    large = F.broadcast(large) if large.count() <= MOST_BROADCAST else large
    cells = cells.join(large, "c", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")))
    everywhere = F.coalesce(F.array_contains("shared", F.col("h")), F.lit(False))
    cells = materialise(cells.select("c", "h", "sketch", F.col("rep.doc_id").alias("_doc"), F.col("rep.digest").alias("_digest"), "blocks", "own", everywhere.alias("everywhere")))
    placed = _with_texts(docs, cells)
    to = F.when(F.col("everywhere"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("own"))
    first = placed.select("c", F.explode(to).alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("side"), "h", F.col("h").alias("root"), "sketch", "text")
    links = materialise(_block_links(first, shingle, percent))
    cut = cells.where("blocks > 1")
    if cut.isEmpty():
        return links
    # rows of cut groups outside the largest component of their group meet the other blocks
    found = components(links).withColumnRenamed("v", "h").withColumnRenamed("root", "_root")
    named = materialise(cut.join(found, "h", "left").withColumn("root", F.coalesce("_root", "h")).drop("_root"))
    counts = named.groupBy("c", "root").agg(F.count(F.lit(1)).alias("_n"))
    main = counts.groupBy("c").agg(F.max_by("root", F.struct("_n", "root")).alias("main"), F.sum("_n").alias("_all"), F.max("_n").alias("_most")).where("_most < _all")
    apart = main.select("c", "main", F.ceil((F.col("_all") - F.col("_most")) / BLOCK_ROWS).cast("long").alias("apart"))
    left = materialise(named.join(apart, "c"))
    if left.isEmpty():
        return links
    mine = F.pmod(F.xxhash64("h", F.lit(3)), F.col("apart"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    others = F.sequence(F.lit(0).cast("long"), F.col("apart") - 1)
    rows = _with_texts(docs, left)
    one = rows.where("root <> main").select("c", mine.alias("i"), F.explode(every).alias("j"), F.lit(1).cast("long").alias("side"), "h", "root", "sketch", "text")
    two = rows.select("c", F.explode(others).alias("i"), F.col("own").alias("j"), F.lit(2).cast("long").alias("side"), "h", "root", "sketch", "text")
    return links.unionByName(materialise(_block_links(one.unionByName(two), shingle, percent)))


def near_duplicate_classes(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, digest, n_shingles, component_id, kept) of every row; see the module text."""
    rows = materialise(sketch_rows(docs, shingle))
    whole = rows.where("n > 0 AND doc_id IS NOT NULL")
    rep = F.min(F.struct("doc_id", "digest")).alias("rep")
    classes = materialise(whole.groupBy("h").agg(rep, F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    groups = components(candidates(classes, percent)).select(F.col("v").alias("h"), F.col("root").alias("c"))
    links = links_of_groups(docs, classes, groups, shingle, percent)
    # the classes of rows of equal doc_id are linked to the smallest of them
    several = whole.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("most")).where("a <> most").select("doc_id", "a")
    same_id = whole.select("doc_id", "h").join(several, "doc_id").where("h <> a").select("a", F.col("h").alias("b"))
    found = components(links.unionByName(same_id)).withColumnRenamed("v", "h")
    named = classes.select("h", F.col("rep.doc_id").alias("_doc")).join(found, "h", "left").withColumn("root", F.coalesce("root", "h"))
    label = named.select("h", F.min("_doc").over(Window.partitionBy("root")).alias("component"))
    out = rows.select("doc_id", "digest", "n", "h").join(label, "h", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).cast("long")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(False))
    return out.select("doc_id", "digest", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def near_duplicate_digest(docs: DataFrame, shingle: int = 4, percent: int = 80) -> DataFrame:
    return near_duplicate_classes(docs, shingle, percent).drop("digest")
