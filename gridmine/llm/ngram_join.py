"""N-gram Jaccard join as a blocked sparse matrix product.

Documents are rows, word shingles columns of a 0/1 matrix; overlaps of documents are entries of the
matrix times its transpose. The product is formed only where an entry can reach the threshold:

1. Rows of equal shingle sets are one class.
2. Columns are cut into parts by hash. Sets of Jaccard similarity t and sizes a, b differ in at most
   (1 - t) / (1 + t) * (a + b) shingles, so of that many parts plus g, g are equal. A class emits a
   hash of each of its first non-empty parts, as many as its size allows differences, plus g, and is a
   candidate if it shares g of them. Classes are taken within size ranges; those close below a range
   also visit it. A passage that many documents share is hardly ever a whole part, much less g.
3. Classes connected through equal hashes form a block of rows, found by connected components over
   one edge per class and hash. A block above ``BLOCK_ROWS`` rows or ``BLOCK_CELLS`` cells is cut into
   row blocks, and every pair of them is a task of its own.
4. Inside a block, columns are ordered from rare to common. Counts are accumulated over the first
   columns of each row, as many as the size bound leaves; pairs without a common one there, of sizes too
   far apart, or already connected are discarded. The rest get their full overlap. Links that
   connect rows not connected before are kept, so a group of copies costs its size, not its square
   (``near_duplicate_links`` keeps all).
5. Components over these links, and over classes, give every document the smallest id it can reach.

Sets are compared by 64-bit hashes of shingles (and classes by a 64-bit hash of the set).

Nulls: a null or empty text has no shingles and links with nothing. Rows without doc_id get their count,
but a null component, and link nothing. Rows of equal doc_id are one document for linking. An empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmine.llm.common import materialise, partition_count, sliced, text_batches, text_or_empty
from gridmine.llm.components import components
from gridmine.llm.text_hash import U64, mix, shingle_sets

#: Size ranges grow by half.
_GROWTH = 1.5
BLOCK_ROWS, BLOCK_CELLS = 8192, 2_000_000
#: Classes placed in blocks (rows of four longs) that may be broadcast to their texts: 32 MB.
MOST_BROADCAST = 1_000_000
_BATCH_BYTES = 1 << 18


def most_different(size, percent: int):
    """Largest symmetric difference of a set of this size with any set it can link to."""
    return (100 - percent) * (size + size * 100 // percent) // (100 + percent)


def size_ranges(percent: int, most: int) -> np.ndarray:
    """Lower ends of the size ranges; below the first, only equal sets link."""
    first = 1
    while most_different(first, percent) < 1:
        first += 1
    ends = [first]
    while ends[-1] <= most:
        ends.append(int(np.ceil(ends[-1] * _GROWTH)))
    return np.array(ends)


def spare_parts(low: np.ndarray) -> np.ndarray:
    """How many equal parts beyond the first are asked of a pair, by the low end of its size range."""
    return np.where(low >= 36, np.minimum(low // 12, 24), 0)


def part_hashes(sets: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, asked) of the parts that rows emit; ``asked`` is how many a row must share to link.

    With d differences at most, a pair whose sets have ``asked`` equal non-empty parts has that many
    among the first d + asked non-empty parts of either row. A row with fewer parts than that may have
    fewer equal ones; such rows also emit a hash in common, and nothing is asked of them (0).
    """
    sizes = np.diff(at)
    lows = size_ranges(percent, int(sizes.max(initial=1)))
    spare = spare_parts(lows)
    top = np.ceil(lows * _GROWTH).astype(np.int64) - 1
    n_parts = most_different(top, percent) + 4 + 2 * spare
    home = np.searchsorted(lows, sizes, side="right") - 1
    spread = mix(sets ^ U64(0x5851F42D4C957F2D)) >> U64(32)
    content = mix(sets + U64(0x2545F4914F6CDD1D))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for visit in (0, 1):
        own = home + visit
        takes = (own >= 0) & (own < len(lows))
        if visit:
            takes &= percent * lows[np.minimum(own, len(lows) - 1)] <= 100 * sizes
        if not takes.any():
            continue
        cells = np.repeat(takes, sizes)
        row = np.repeat(np.arange(len(sizes)), np.where(takes, sizes, 0))
        part = (spread[cells] * n_parts[own[row]].astype(U64)) >> U64(32)
        order = np.argsort(row.astype(U64) * U64(int(n_parts.max())) + part, kind="stable")
        row, part = row[order], part[order]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])]))
        sums = np.add.reduceat(content[cells][order], first)
        row, part = row[first], part[first]
        sums = mix(sums ^ (part * U64(0x9FB21C651E98DF25)) ^ (own[row].astype(U64) << U64(56)))
        begin = np.concatenate([[True], row[1:] != row[:-1]])
        rank = np.arange(len(row)) - np.maximum.accumulate(np.where(begin, np.arange(len(row)), 0))
        asked = 1 + spare[np.minimum(own, len(lows) - 1)]
        need = most_different(sizes, percent) + asked
        few = takes & (np.bincount(row, minlength=len(sizes)) < need)
        keep = rank < need[row]
        out.append((row[keep], sums[keep], np.where(few, 0, asked)[row[keep]]))
        some = np.flatnonzero(few)
        out.append((some, mix(own[some].astype(U64) + U64(0xE7037ED1A0B428DB)), np.zeros(len(some), np.int64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _digest() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(text_or_empty())


def set_rows(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, digest, n, h, parts, asked): hash of each text, size and hash of its set, and the hashes it emits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", _BATCH_BYTES):
            sets, at = shingle_sets(_texts(batch.column(2)), shingle)
            sizes = np.diff(at)
            h = np.zeros(len(sizes), U64)
            filled = np.flatnonzero(sizes)
            if len(filled):
                h[filled] = mix(np.add.reduceat(mix(sets), at[filled]) + sizes[filled].astype(U64))
            row, parts, asked = part_hashes(sets, at, percent)
            order = np.argsort(row, kind="stable")
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (parts[order].view(np.int64), asked[order].astype(np.int8))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes), pa.array(h.view(np.int64)), *lists], ["doc_id", "digest", "n", "h", "parts", "asked"])

    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest long, n long, h long, parts array<long>, asked array<byte>")


def shared_parts(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between classes that emit equal hashes: one per class and hash, to the smallest of its run.

    Classes that share fewer hashes than any link would ask of them are left out first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by hash; a row goes out if one next to it has the same, across batches too
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            part = rows.column(0).to_numpy()
            before = np.concatenate([[held_shared if held is not None else False], part[1:] == part[:-1]])
            after = np.concatenate([part[1:] == part[:-1], [False]])
            out = pc.filter(rows, pa.array((before | after)[:-1].tolist() + [False], pa.bool_()))
            yield from out.to_batches()
            held, held_shared = rows.slice(len(part) - 1).to_batches()[0], bool(before[-1])
        if held is not None and held_shared:
            yield held

    # one array is exploded and the other looked up by place: zipping them would build an object per entry
    rows = classes.select(F.posexplode("parts").alias("at", "part"), "h", "asked").select("part", "h", F.get("asked", F.col("at")).cast("int").alias("asked"))
    n = partition_count(classes.sparkSession)
    met = materialise(rows.repartition(n, "part").sortWithinPartitions("part").mapInArrow(run, "part long, h long, asked int"))
    # ranges are told apart by what they ask as far as that matters: a row's own and the one it visits
    enough = met.groupBy("h", "asked").agg(F.count(F.lit(1)).alias("n")).where("n >= asked").select("h", "asked")
    kept = met.join(enough, ["h", "asked"]).select("part", "h")
    low = kept.groupBy("part").agg(F.min("h").alias("a"))
    return kept.join(low, "part").where("h <> a").select("a", F.col("h").alias("b")).distinct()


def linked(sets: list[np.ndarray], sides: np.ndarray, percent: int, every: bool = False) -> list[tuple[int, int, int]]:
    """Links (row, row, overlap) that connect the rows of a block, or every link: the sparse product with early discards.

    If rows come from two sides, only pairs across are compared (each side alone is another task).
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1, common)] if 100 * common >= percent * (sizes[0] + sizes[1] - common) else []
    across = len(set(sides.tolist())) > 1
    columns, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(columns), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(columns))
    owner = np.repeat(np.arange(n), sizes)
    order = np.lexsort((rank[code], owner))
    code = code[order]
    at = np.concatenate([[0], np.cumsum(sizes)])
    # the first columns of a row, rare ones first, of which a linked row must have one
    prefix = sizes - (percent * sizes + 99) // 100 + 1
    place = np.arange(len(code)) - np.repeat(at[:-1], sizes)
    inside = (place < np.repeat(prefix, sizes)) & (df[code] > 1)
    p_row, p_col = owner[inside], code[inside]
    by_col = np.argsort(p_col, kind="stable")
    posted, p_at = p_row[by_col], np.searchsorted(p_col[by_col], np.arange(len(columns) + 1))
    r_at = np.searchsorted(p_row, np.arange(n + 1))
    root = np.arange(n)
    done = np.zeros(n, bool)
    flag = np.zeros(len(columns), bool)
    links = []
    weight = np.add.reduceat(df[code], at[:-1]) if len(code) else sizes
    for i in np.argsort(-weight / np.maximum(sizes, 1), kind="stable").tolist():
        done[i] = True
        own = p_col[r_at[i] : r_at[i + 1]]
        lists = [posted[p_at[c] : p_at[c + 1]] for c in own.tolist()]
        if not lists:
            continue
        near = np.unique(np.concatenate(lists))
        near = near[~done[near] & (every | (root[near] != root[i])) & (100 * np.minimum(sizes[near], sizes[i]) >= percent * np.maximum(sizes[near], sizes[i]))]
        if across:
            near = near[sides[near] != sides[i]]
        if not len(near):
            continue
        flag[code[at[i] : at[i + 1]]] = True
        lengths = sizes[near]
        begin = np.cumsum(lengths) - lengths
        cells = np.repeat(at[near] - begin, lengths) + np.arange(lengths.sum())
        common = np.add.reduceat(flag[code[cells]].astype(np.int64), begin)
        flag[code[at[i] : at[i + 1]]] = False
        hit = 100 * common >= percent * (sizes[near] + sizes[i] - common)
        for j, overlap in zip(near[hit].tolist(), common[hit].tolist(), strict=True):
            links.append((i, j, overlap))
            if not every:
                root[root == root[j]] = root[i]
    return links


def block_links(rows: DataFrame, shingle: int, percent: int, every: bool = False) -> DataFrame:
    """Links (a, b, common) from rows (c, i, j, side, h, text) sorted by block (c, i, j) inside partitions."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        held: tuple[list, list, list] = ([], [], [])
        held_key = None
        for batch in sliced(batches, "text", _BATCH_BYTES):
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            side, h = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            sets, at = shingle_sets(_texts(batch.column(5)), shingle)
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                key = tuple(keys[first].tolist())
                if held_key is not None and key != held_key:
                    yield np.array(held[0]), held[1], np.array(held[2])
                    held = ([], [], [])
                held_key = key
                held[0].extend(h[first:last].tolist())
                held[1].extend(sets[at[r] : at[r + 1]].copy() for r in range(first, last))
                held[2].extend(side[first:last].tolist())
        if held_key is not None:
            yield np.array(held[0]), held[1], np.array(held[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, sets, sides in groups(batches):
            _, once = np.unique(h, return_index=True)  # rows of equal id and text bring their class again
            if len(once) < len(h):
                h, sets, sides = h[once], [sets[r] for r in once.tolist()], sides[once]
            if len(h) > 1:
                links = linked(sets, sides, percent, every)
                if links:
                    a, b, common = np.array(links).T
                    yield pa.record_batch([pa.array(h[a]), pa.array(h[b]), pa.array(common)], ["a", "b", "common"])

    return rows.mapInArrow(run, "a long, b long, common long")


def _classes(rows: DataFrame) -> DataFrame:
    """(h, rep, n, parts, asked): rows of equal sets, represented by the smallest (doc_id, digest)."""
    whole = rows.where("n > 0 AND doc_id IS NOT NULL")
    rep = F.min(F.struct("doc_id", "digest")).alias("rep")
    return materialise(whole.groupBy("h").agg(rep, F.first("n").alias("n"), F.first("parts").alias("parts"), F.first("asked").alias("asked")))


def _class_links(docs: DataFrame, classes: DataFrame, shingle: int, percent: int, every: bool = False) -> DataFrame:
    """Links (a, b, common) that connect classes, or every link between them; see the module text."""
    members = components(shared_parts(classes))
    cells = classes.select("h", "rep", "n").join(members.withColumnRenamed("v", "h"), "h")
    blocks = cells.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_CELLS)).cast("long").alias("n_blocks"))
    cells = materialise(cells.join(blocks, "root").select("h", F.col("rep.doc_id").alias("_doc"), F.col("rep.digest").alias("_digest"), "root", "n_blocks"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), text_or_empty().alias("text"))
    own = F.pmod(F.xxhash64("h"), F.col("n_blocks"))
    near = F.broadcast(cells) if cells.count() <= MOST_BROADCAST else cells
    placed = text.join(near, (near["_doc"] == text["doc_id"]) & (near["_digest"] == text["digest"])).select("root", "h", "n_blocks", own.alias("side"), "text")
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    placed = placed.select(F.col("root").alias("c"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "h", "text")
    n = partition_count(docs.sparkSession)
    return block_links(placed.repartition(n, "c", "i", "j").sortWithinPartitions("c", "i", "j"), shingle, percent, every)


def _smallest(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(h, first): the smallest (doc_id, digest) of each class's component of classes."""
    found = components(links)
    named = classes.select("h", "rep").join(found.withColumnRenamed("v", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    return materialise(named.select("h", F.min("rep").over(Window.partitionBy("root")).alias("first")))


def near_duplicate_sets(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; see the module text."""
    rows = materialise(set_rows(docs, shingle, percent))
    classes = _classes(rows)
    links = _class_links(docs, classes, shingle, percent)
    # the classes of rows of equal doc_id are linked to the smallest of them
    whole = rows.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "h")
    several = whole.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("most")).where("a <> most").select("doc_id", "a")
    same_id = whole.join(several, "doc_id").where("h <> a").select("a", F.col("h").alias("b"))
    label = _smallest(classes, links.select("a", "b").unionByName(same_id)).select("h", F.col("first.doc_id").alias("component"))
    out = rows.select("doc_id", "n", "h").join(label, "h", "left")
    component: Column = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"))


def near_duplicate_links(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Every link between classes of rows with equal sets: (class_a, doc_a, n_a, rows_a, class_b, doc_b, n_b, rows_b, common).

    doc is the smallest doc_id of a class, n the size of its set, rows its number of rows (told by doc_id and
    text), common the overlap. A class of several rows is also linked to itself. So the linked pairs of rows
    are rows_a * rows_b over links of two classes, and rows_a * (rows_a - 1) / 2 over those of one. The
    result grows with the square of a group of different near copies; components do not need it.
    """
    rows = materialise(set_rows(docs, shingle, percent))
    classes = _classes(rows)
    held = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("h").agg(F.count_distinct("doc_id", "digest").alias("rows"))
    named = materialise(classes.select("h", F.col("rep.doc_id").alias("doc"), "n").join(held, "h"))

    def side(x: str) -> DataFrame:
        return named.select(F.col("h").alias(f"class_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("doc", "n", "rows")])

    links = _class_links(docs, classes, shingle, percent, every=True).select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), "common")
    own = named.where("rows > 1").select(F.col("h").alias("class_a"), F.col("h").alias("class_b"), F.col("n").alias("common"))
    out = links.unionByName(own).join(side("a"), "class_a").join(side("b"), "class_b")
    return out.select("class_a", "doc_a", "n_a", "rows_a", "class_b", "doc_b", "n_b", "rows_b", "common")


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of texts that links connect, that of the smallest doc_id.

    A row is told by its doc_id and text: different texts under one doc_id are linked only if they are
    alike, and of rows equal in both one stays. Documents without words stay, and rows without doc_id,
    which are no copies of anything.
    """
    rows = materialise(set_rows(docs, shingle, percent))
    classes = _classes(rows)
    label = _smallest(classes, _class_links(docs, classes, shingle, percent))
    found = rows.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "digest", "h").join(label, "h")
    copies = found.where(F.struct("doc_id", "digest") != F.col("first"))
    dropped = materialise(copies.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")).distinct())
    left = docs.join(dropped, (F.col("doc_id").cast("long") == dropped["_doc"]) & (_digest() == dropped["_digest"]), "left_anti")
    nth = F.row_number().over(Window.partitionBy("doc_id", _digest(), "text").orderBy(F.lit(0)))
    return left.withColumn("_nth", nth).where("doc_id IS NULL OR _nth = 1").drop("_nth")


def near_duplicate_digest(docs: DataFrame, shingle: int = 4, percent: int = 85) -> DataFrame:
    return near_duplicate_sets(docs, shingle, percent)
