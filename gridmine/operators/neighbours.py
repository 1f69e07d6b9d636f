"""Exact nearest vectors by absolute cosine for query sets that are too large to travel.

The angle between two lines, acos |cos|, is a metric. Vectors are put into cells: the nearest of some pivots, and the
ring around it that holds the angle. The smallest and largest angle of a cell bound the angle of a query to
everything in it: at least d(query, pivot) - largest and smallest - d(query, pivot). A query first meets the cells
of smallest bound that hold enough rows; the k-th score found there, shared by all tasks, then leaves out
every cell whose bound cannot reach it. Nothing is missed, whatever the pivots are.

Vectors of different length never meet. A length without pivot has one cell that is never left out. NULL, empty and zero
vectors, and those with a missing component, have no row. Pivots and cells are bounded by ``MAX_PIVOTS``, ``PIVOT_WIDTH``
and ``RINGS``, not by the data; cells of many rows and those many queries ask are cut into blocks. Where no
vectors are near each other (uniform directions in many dimensions) all cells stay, and the work is that of a scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridmine.operators.joins import COLUMNS_AT_ONCE, LEFT_BLOCK, RIGHT_BLOCK, pair_cosines, unit_vectors
from gridmine.session import materialise

MAX_PIVOTS = 512
#: Pivots are drawn from vectors up to this length, which bounds their bytes.
PIVOT_WIDTH = 4_096
#: Rings of equal width around a pivot.
RINGS = 16
#: Rows per pivot as long as there are fewer than ``MAX_PIVOTS``.
PIVOT_ROWS = 2_048
#: Cells shared by the lengths without pivot.
_REST = 64
#: Rows a query meets before its k-th score is shared.
FIRST_ROWS = 1_024
#: Scores have 6 decimals, and angles are exact to about 1e-7.
_SLACK = 2e-6


def reaching(sims: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row) that reach the k best scores seen so far, and these scores with the new ones."""
    k = best.shape[1]
    merged = np.concatenate([best, sims], axis=1)
    best = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
    query, row = np.nonzero((sims >= best.min(axis=1, keepdims=True)) & (sims >= 0))
    return query, row, best


@dataclass
class Pivots:
    """Unit vectors of pivots by length, with the number of the first one of each."""

    rows: dict[int, tuple[int, np.ndarray]]

    def angles(self, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
        """(length, positions, angles to the pivots of that length or None) of usable vectors."""
        for width, (at, unit) in unit_vectors(vectors).items():
            own = self.rows.get(width)
            yield width, at, None if own is None else np.arccos(np.minimum(1.0, np.abs(unit @ own[1].T)))

    def place(self, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, cell, angle to the pivot of the cell) of usable vectors, in row order."""
        parts = []
        for width, at, angles in self.angles(vectors):
            if angles is None:
                parts.append((at, np.full(len(at), -1 - width % _REST), np.zeros(len(at))))
                continue
            own = angles.argmin(axis=1)
            angle = angles[np.arange(len(at)), own]
            ring = np.minimum((angle * (2 * RINGS / math.pi)).astype(int), RINGS - 1)
            parts.append((at, (self.rows[width][0] + own) * RINGS + ring, angle))
        if not parts:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        at, cell, angle = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(at, kind="stable")
        return at[order], cell[order], angle[order]


@dataclass
class Cells:
    """Filled cells in order of their number: rows, smallest and largest angle to their pivot."""

    pivots: Pivots
    number: np.ndarray
    rows: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def bounds(self, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(positions, positions of cells, least possible angles) of usable vectors, one length at a time."""
        for width, at, angles in self.pivots.angles(vectors):
            if angles is None:
                cells = np.flatnonzero(self.number == -1 - width % _REST)
                yield at, cells, np.zeros((len(at), len(cells)))
                continue
            first = self.pivots.rows[width][0]
            owner = np.where(self.number < 0, -1, self.number // RINGS - first)
            cells = np.flatnonzero((owner >= 0) & (owner < angles.shape[1]))
            to_pivot = angles[:, owner[cells]]
            yield at, cells, np.maximum(0.0, np.maximum(to_pivot - self.most[cells], self.least[cells] - to_pivot))

    def first(self, vectors: pa.Array, rows: int) -> list[list[int]]:
        """Cells of smallest bound that hold at least so many rows together, for every vector."""
        out: list[list[int]] = [[] for _ in range(len(vectors))]
        for at, cells, bound in self.bounds(vectors):
            for i, own in zip(at.tolist(), bound, strict=True):
                order = cells[np.argsort(own, kind="stable")]
                out[i] = self.number[order[: 1 + int(np.searchsorted(np.cumsum(self.rows[order]), rows))]].tolist()
        return out

    def within(self, vectors: pa.Array, score: np.ndarray) -> list[list[int]]:
        """Cells that may hold a vector of at least the given score, for every vector."""
        out: list[list[int]] = [[] for _ in range(len(vectors))]
        for at, cells, bound in self.bounds(vectors):
            may = np.cos(bound) + _SLACK >= score[at, None]
            for i, own in zip(at.tolist(), may, strict=True):
                out[i] = self.number[cells[own]].tolist()
        return out


def draw_pivots(vectors: DataFrame, n: int) -> Pivots:
    """Vectors of small hash, different ones only; at most ``MAX_PIVOTS`` rows come to the driver."""
    wanted = min(MAX_PIVOTS, math.ceil(n / PIVOT_ROWS))
    hashed = vectors.where(F.size("vector").between(1, PIVOT_WIDTH)).select("vector", F.xxhash64("vector").alias("h"))
    share = min(1.0, 4 * wanted / max(1, n))
    drawn = hashed.where(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30)))
    rows = drawn.groupBy("h").agg(F.first("vector").alias("vector")).orderBy("h").limit(wanted).collect()
    out: dict[int, tuple[int, np.ndarray]] = {}
    number = 0
    for width, (_, unit) in unit_vectors(pa.array([r["vector"] for r in rows], pa.list_(pa.float64()))).items():
        if len(unit):  # zero vectors are no pivots
            out[width] = (number, unit)
            number += len(unit)
    return Pivots(out)


def _fields(df: DataFrame, columns: Sequence[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def place_vectors(vectors: DataFrame, pivots: Pivots) -> DataFrame:
    """The usable vectors with _cell, _angle and a row number _n; written once, so that cells do not change."""
    columns = vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            at, cell, angle = pivots.place(batch["vector"])
            more = [pa.array(cell, pa.int32()), pa.array(angle), pa.array(number + np.arange(len(at)))]
            number += len(at)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, *more], names=[*columns, "_cell", "_angle", "_n"])

    return materialise(vectors.mapInArrow(run, _fields(vectors, columns) + "_cell int, _angle double, _n long"))


def block_candidates(keep: Sequence[str], query_id: str, k: int):
    """Cogroup function: per query of the block the rows that reach _kth and the k-th score of the block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for first in range(0, max(1, right.num_rows), COLUMNS_AT_ONCE):
            own = right.slice(first, COLUMNS_AT_ONCE)
            sims = pair_cosines(left["vector"], own["_query_vector"]).T
            known = np.asarray(own["_kth"], dtype=float)
            query, row, _ = reaching(sims, np.repeat(known[:, None], k, axis=1))
            columns = [own[query_id].take(query), *left.select(keep).take(row).columns, pa.array(sims[query, row])]
            parts.append(pa.Table.from_arrays(columns, names=[query_id, *keep, "similarity"]))
        return pa.concat_tables(parts)

    return run


def _meet(placed: DataFrame, asked: DataFrame, rows: dict[int, int], keep: Sequence[str], query_id: str, k: int) -> DataFrame:
    """Candidates of the queries among the cells they ask (_cells); blocks of a cell meet blocks of its queries."""
    visits = asked.withColumn("_cell", F.explode("_cells"))
    many = {r["_cell"]: r["count"] for r in visits.groupBy("_cell").count().collect()}  # as many as cells
    cut = [(c, math.ceil(rows[c] / LEFT_BLOCK), math.ceil(n / RIGHT_BLOCK)) for c, n in many.items()]
    spark = placed.sparkSession
    cuts = F.broadcast(spark.createDataFrame(cut, "_cell int, _parts long, _chunks long").coalesce(1))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("_n"), F.col(n))
    left = placed.join(cuts, "_cell").select(*keep, "vector", "_cell", own("_parts").alias("_part"), each("_chunks").alias("_chunk"))
    right = visits.join(cuts, "_cell").select(query_id, "_query_vector", "_kth", "_cell", own("_chunks").alias("_chunk"), each("_parts").alias("_part"))
    by = ["_cell", "_part", "_chunk"]
    kinds = f"`{query_id}` {asked.schema[query_id].dataType.simpleString()}, {_fields(placed, keep)}`similarity` double"
    return materialise(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(block_candidates(keep, query_id, k), kinds))


def kth_scores(candidates: DataFrame, query_id: str, k: int) -> DataFrame:
    """(_query, _kth): the k-th best score of every query that has so many rows."""
    counts = candidates.groupBy(query_id, "similarity").agg(F.count(F.lit(1)).alias("_rows"))
    down = W.partitionBy(query_id).orderBy(F.desc("similarity")).rowsBetween(W.unboundedPreceding, 0)
    reached = counts.withColumn("_sum", F.sum("_rows").over(down)).where(F.col("_sum") >= k)
    return reached.groupBy(F.col(query_id).alias("_query")).agg(F.max("similarity").alias("_kth"))


def near_candidates(vectors: DataFrame, queries: DataFrame, n: int, k: int, query_id: str) -> DataFrame:
    """(query_id, columns of ``vectors`` but vector, similarity): a superset of the top ``k`` with ties of every query.

    ``vectors`` (``n`` rows) holds vector and ``queries`` _query_vector as array<double>. Rows of equal query id share their k-th score.
    """
    keep = [c for c in vectors.columns if c != "vector"]
    pivots = draw_pivots(vectors, n)
    placed = place_vectors(vectors, pivots)
    found = placed.groupBy("_cell").agg(F.count(F.lit(1)), F.min("_angle"), F.max("_angle")).orderBy("_cell").collect()
    number, rows, least, most = (np.array(x) for x in zip(*found, strict=True)) if found else (np.zeros(0),) * 4
    cells = Cells(pivots, number.astype(int), rows, least, most)
    many = {int(c): int(n) for c, n in zip(number, rows, strict=True)}
    asked = _first_cells(queries, cells, max(k, FIRST_ROWS))
    near = _meet(placed, asked, many, keep, query_id, k)
    known = asked.drop("_kth").join(kth_scores(near, query_id, k), F.col(query_id).eqNullSafe(F.col("_query")), "left")
    rest = _other_cells(known.withColumn("_kth", F.coalesce("_kth", F.lit(-1.0))).drop("_query"), cells)
    return near.unionByName(_meet(placed, rest, many, keep, query_id, k))


def _first_cells(queries: DataFrame, cells: Cells, least_rows: int) -> DataFrame:
    """Queries with the cells they ask first (_cells), a row number _n and no k-th score yet; written once."""
    columns = queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            asked = pa.array(cells.first(batch["_query_vector"], least_rows), pa.list_(pa.int32()))
            more = [asked, pa.array(number + np.arange(n)), pa.array(np.full(n, -1.0))]
            number += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*columns, "_cells", "_n", "_kth"])

    return materialise(queries.mapInArrow(run, _fields(queries, columns) + "_cells array<int>, _n long, _kth double"))


def _other_cells(asked: DataFrame, cells: Cells) -> DataFrame:
    """Queries with the cells that can still reach their k-th score and were not asked before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reached = cells.within(batch["_query_vector"], np.asarray(batch["_kth"], dtype=float))
            seen = batch["_cells"].to_pylist()
            left = [sorted(set(new).difference(old or ())) for new, old in zip(reached, seen, strict=True)]
            at = batch.schema.get_field_index("_cells")
            yield batch.set_column(at, "_cells", pa.array(left, pa.list_(pa.int32())))

    return materialise(asked.mapInArrow(run, asked.schema))
