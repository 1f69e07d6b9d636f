"""Mixing sources to target weights by the cube method (balanced sampling).

Every source gets a share of all words by weight, at most ``cap`` times its own size; what is above
is reshared among the others. Target / size of a source is its rate: the whole part repeats every
document, the fraction is the inclusion probability of one more copy. The flight phase of the cube
method moves the vector of probabilities through the null space of the constraints (number of
documents, number of words) until nearly every entry is 0 or 1, so both totals keep their expected
values. It runs per block of a source; the at most two undecided documents of a block go on to the
next level, where blocks are of undecided documents only, until one landing problem per source is
left: there the document count is given up first, then the last document is drawn, and a few taken
documents are exchanged for untaken ones while that brings the words nearer to the target.

Blocks are walked from large to small documents. Blocks, order and draws depend on the rows alone:
reruns agree.

Nulls: a null text has size 0; a null source is a source of its own, last in order; rows with a null
doc_id are sampled like others. Repeated rows are sampled one by one. An empty table gives an empty
result. A source of size 0 has target 0 and takes nothing. Other columns are not read.
"""

from __future__ import annotations

import bisect
import random
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmine.llm.common import materialise, text_or_empty, words

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: Mean rows of a block of the flight phase.
BLOCK_ROWS = 2_000
_EDGE = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """(source, n_rows, source_size, target) by filling up shares under their caps.

    One row per source: a source is capped if the level that holds without it is above its own
    cap over weight, in ascending order of that ratio.
    """
    sources = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").cast("double").alias("s"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sources.select("*", weight.alias("w")).withColumn("ratio", cap * F.col("s") / F.col("w"))
    left = F.sum("s").over(everything) - F.coalesce(F.sum(cap * F.col("s")).over(before), F.lit(0.0))
    left_w = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    capped = ranked.withColumn("capped", left / left_w > F.col("ratio"))
    free = F.sum("s").over(everything) - F.coalesce(F.sum(F.when(F.col("capped"), cap * F.col("s"))).over(everything), F.lit(0.0))
    free_w = F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything)
    target = F.when(F.col("capped"), cap * F.col("s")).otherwise(free / free_w * F.col("w"))
    return capped.select("source", "n_rows", F.col("s").cast("long").alias("source_size"), target.alias("target"))


def fly(sizes: list[int], chances: list[float], draw: Callable[[], float], land: bool) -> list[float]:
    """Cube method over two constraints, the sums of chances and of sizes; see the module text.

    Three undecided entries at a time: the vector that keeps both sums is known in closed form.
    """
    out = list(chances)
    waiting = iter([i for i, p in enumerate(out) if _EDGE < p < 1 - _EDGE])
    held: list[int] = []
    while True:
        while len(held) < 3:
            i = next(waiting, None)
            if i is None:
                break
            held.append(i)
        if len(held) == 3:
            a, b, c = (sizes[i] for i in held)
            move = (c - b, a - c, b - a) if a != b or b != c else (1, -1, 0)
        elif not land or not held:
            return out
        elif len(held) == 2:
            a, b = (sizes[i] for i in held)
            move = (b, -a) if a or b else (1, -1)
        else:
            out[held[0]] = 1.0 if draw() < out[held[0]] else 0.0
            return out
        up = min(((1 - out[i]) if m > 0 else out[i]) / abs(m) for i, m in zip(held, move, strict=True) if m)
        down = min((out[i] if m > 0 else (1 - out[i])) / abs(m) for i, m in zip(held, move, strict=True) if m)
        step = up if draw() * (up + down) < down else -down
        for i, m in zip(held, move, strict=True):
            p = out[i] + step * m
            out[i] = 0.0 if p < _EDGE else 1.0 if p > 1 - _EDGE else p
        held = [i for i in held if 0 < out[i] < 1]


#: Exchanges at the landing of a source.
_EXCHANGES = 16


def exchange(sizes: list[int], chances: list[float], taken: list[float]) -> list[float]:
    """Swap taken for untaken documents, one pair at a time, while the words come nearer to what was expected."""
    out = list(taken)
    off = sum(n * (t - p) for n, p, t in zip(sizes, chances, taken, strict=True))
    free = [i for i, p in enumerate(chances) if _EDGE < p < 1 - _EDGE]
    for _ in range(_EXCHANGES):
        others = sorted((sizes[i], i) for i in free if out[i] == 0.0)
        best, pair = abs(off), None
        for i in (i for i in free if out[i] == 1.0):
            at = bisect.bisect_left(others, (sizes[i] - off, -1))
            for n, j in others[max(0, at - 1) : at + 1]:
                if abs(off + n - sizes[i]) < best - _EDGE:
                    best, pair = abs(off + n - sizes[i]), (i, j)
        if not pair:
            break
        i, j = pair
        out[i], out[j], off = 0.0, 1.0, off + sizes[j] - sizes[i]
    return out


def _flight(seed: int, level: int) -> Callable[[pa.Table], pa.Table]:
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("size", "descending"), ("doc_id", "ascending"), ("digest", "ascending")])
        source, number, last = (block.column(c)[0].as_py() for c in ("source", "block", "last"))
        draw = random.Random(zlib.crc32(repr((seed, level, source, number)).encode())).random
        sizes, before = block.column("size").to_pylist(), block.column("p").to_pylist()
        chances = fly(sizes, before, draw, last)
        if last:
            chances = exchange(sizes, before, chances)
        return block.set_column(block.schema.get_field_index("p"), "p", pa.array(chances, pa.float64()))

    return run


#: Rows of one entry that are dealt out at once.
_STEP = 10_000


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0, seed: int = 29, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of (doc_id, source, size, digest) with source_size, target and ``copies`` to take of each.

    ``digest`` tells rows of equal doc_id apart. Rows equal in all four are one entry that may be taken several
    times: it moves with the fraction of what its rows are due together, and what it gets is dealt out to
    them evenly. So no number of copies fills a block.
    """
    rows = materialise(rows.select("doc_id", "source", "size", "digest"))
    targets = materialise(source_targets(rows, weights, cap))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key = rows["source"].eqNullSafe(targets["source"])
    known = rows.join(targets, key).select(rows["*"], "n_rows", "source_size", "target", rate.alias("rate"))
    names = ["doc_id", "source", "size", "digest", "n_rows", "source_size", "target"]
    known = known.groupBy(*names).agg(F.count(F.lit(1)).alias("same"), F.max("rate").alias("rate"))
    due = F.col("same") * F.col("rate")
    known = known.withColumn("whole", F.floor(due).cast("long")).withColumn("p", due - F.floor(due))

    def blocked(df: DataFrame) -> DataFrame:
        blocks = F.greatest(F.ceil(F.col("left") / block_rows), F.lit(1)).cast("long")
        return df.withColumn("block", F.pmod(F.xxhash64("doc_id", "digest", "size"), blocks)).withColumn("last", blocks == 1)

    open_rows = blocked(known.withColumn("left", F.col("n_rows")))
    most = targets.agg(F.max("n_rows")).first()[0] or 0
    done, level = [], 0
    while True:
        moved = materialise(open_rows.groupBy("source", "block").applyInArrow(_flight(seed, level), open_rows.schema))
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(moved.where(~undecided))
        if most <= block_rows:
            break
        # at most two rows of each block go on, so no count is needed for the next blocks
        most, level = 2 * -(-most // block_rows), level + 1
        open_rows = blocked(moved.where(undecided).drop("block", "last").withColumn("left", (2 * F.ceil(F.col("left") / block_rows)).cast("long")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = F.col("whole") + F.col("p").cast("long")
    out = out.select("doc_id", "source", "size", "digest", "source_size", "target", "same", copies.alias("all"))
    # the rows of an entry again, in steps that keep arrays short
    out = out.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("same") - 1, F.lit(_STEP).cast("long"))))
    out = out.withColumn("nth", F.explode(F.sequence("at", F.least(F.col("at") + _STEP, F.col("same")) - 1)))
    own = F.floor(F.col("all") / F.col("same")).cast("long") + (F.col("nth") < F.col("all") % F.col("same")).cast("long")
    return out.select("doc_id", "source", "size", "digest", "source_size", "target", own.alias("copies"))


def sized(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words(text)).cast("long").alias("size"), F.xxhash64(F.lit(7), text).alias("digest"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0, seed: int = 29) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the columns it had.

    Copies of rows with equal doc_id and text are dealt out to these rows in turn.
    """
    taken = mix(sized(docs), weights, cap, seed).groupBy("doc_id", "source", "digest").agg(F.sum("copies").alias("_copies"))
    names = docs.columns

    def keyed(doc: Column, source: Column, digest: Column) -> list[Column]:
        # without nulls, so that the window and the join deal rows out alike and texts are shuffled once
        parts = (F.coalesce(doc, F.lit(0)), doc.isNull(), F.coalesce(source, F.lit("")), source.isNull(), digest)
        return [c.alias(f"_k{i}") for i, c in enumerate(parts)]

    keys = [f"_k{i}" for i in range(5)]
    own = keyed(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(F.lit(7), text_or_empty()))
    rows = docs.select(F.struct(*names).alias("_row"), *own)
    # equal rows: each keeps an equal part, the first ones one more
    same = Window.partitionBy(*keys)
    rows = rows.select("_row", *keys, F.row_number().over(same.orderBy(F.lit(0))).alias("_nth"), F.count(F.lit(1)).over(same).alias("_same"))
    taken = taken.where("_copies > 0").select(*keyed(F.col("doc_id"), F.col("source"), F.col("digest")), "_copies")
    times = (F.floor(F.col("_copies") / F.col("_same")) + (F.col("_nth") <= F.col("_copies") % F.col("_same")).cast("long")).cast("int")
    kept = rows.join(taken, keys).select("_row", times.alias("_times")).where("_times > 0")
    return kept.select(F.explode(F.expr("array_repeat(_row, _times)")).alias("_row")).select("_row.*")


def mixed(docs: DataFrame) -> DataFrame:
    """Digest per document: what the mix takes of it, in words."""
    out = mix(sized(docs))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
