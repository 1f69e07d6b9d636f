"""Vector arithmetic on array<double> columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmine.functions.predicates import as_col


def costly(udf):
    """Evaluate a Python function once per row.

    Filters that Spark infers or pushes down (``size(f(x)) > 0`` before an explode, say)
    would run a deterministic function a second time, below any repartitioning.
    """
    return udf.asNondeterministic()


def doubles(c: str | Column) -> Column:
    return as_col(c).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: str | Column, b: str | Column, dims: int | None = None) -> Column:
    """Cosine, over the first ``dims`` components if given; NULL for a zero vector."""
    a, b = as_col(a), as_col(b)
    if dims is not None:
        a, b = F.slice(a, 1, dims), F.slice(b, 1, dims)
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def abs_cosine(a: str | Column, b: str | Column) -> Column:
    """Absolute cosine with 6 decimals."""
    return F.abs(F.round(cosine(a, b), 6))


def angle_deg(a: Column, b: Column) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b)))))


def vec_concat(*vectors: str | Column) -> Column:
    return F.concat(*[as_col(v) for v in vectors])


def vec_halves(v: str | Column) -> tuple[Column, Column]:
    v = as_col(v)
    half = (F.size(v) / 2).cast("int")
    return F.slice(v, F.lit(1), half), F.slice(v, half + 1, half)


def orthonormal(d: int, seed: int = 0) -> np.ndarray:
    """Orthonormal basis: Q of a seeded normal matrix."""
    return np.linalg.qr(np.random.default_rng(seed).normal(0, 1, (d, d)))[0]


def _matrix(vectors: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of width ``d`` as a matrix, with the mask of usable rows."""
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    ok = lengths == d
    kept = vectors.filter(pa.array(ok))
    return np.asarray(kept.flatten()).reshape(-1, d), ok


def rotate(v: str | Column, basis: np.ndarray) -> Column:
    """Rotation by an orthonormal basis; one matrix product per Arrow batch."""
    d = basis.shape[0]

    @F.arrow_udf("array<double>")
    def product(vectors: pa.Array) -> pa.Array:
        rows, ok = _matrix(vectors, d)
        offsets = np.concatenate([[0], np.cumsum(np.where(ok, d, 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array((rows @ basis.T).ravel()), mask=pa.array(~ok))

    return costly(product)(as_col(v))


def score_refs(v: str | Column, refs: np.ndarray, rounded: bool = True) -> Column:
    """Absolute cosine to each row of ``refs`` as array<double>; NULL without a usable vector.

    ``refs`` is a small checked set that travels with the function; each Arrow batch is
    one matrix product. Equal to ``abs_cosine`` per reference.
    """
    d = refs.shape[1]
    norms = np.linalg.norm(refs, axis=1, keepdims=True)
    unit = np.divide(refs, norms, out=np.zeros_like(refs), where=norms > 0)
    k = refs.shape[0]

    @F.arrow_udf("array<double>")
    def score(vectors: pa.Array) -> pa.Array:
        rows, ok = _matrix(vectors, d)
        lengths = np.linalg.norm(rows, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            sims = np.abs((rows @ unit.T) / lengths[:, None])
        if rounded:
            sims = np.round(sims, 6)
        usable = np.zeros(len(ok), dtype=bool)
        usable[np.flatnonzero(ok)[lengths > 0]] = True
        flat = pa.array(sims[lengths > 0].ravel())
        offsets = np.concatenate([[0], np.cumsum(np.where(usable, k, 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array(~usable))

    return costly(score)(as_col(v))


def hash_vector(token: str | Column, dims: int) -> Column:
    """Default encoder: component i is the upper half of the 32 bits of a + b i + c i^2, scaled to [-1, 1).

    a, b and c are the first three words (of 32 bits) of md5(token). Values are whole multiples of 2**-15,
    so their sums do not depend on the order of addition.
    """
    digest = F.md5(as_col(token).cast("binary"))
    word = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(3)]

    def components(w: Column) -> Column:
        def one(i: Column) -> Column:
            x = w["a"] + w["b"] * i + w["c"] * i * i
            return F.shiftright(F.pmod(x, F.lit(1 << 32)), 16).cast("double") / F.lit(32768.0) - 1

        return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long")), one)

    seeds = F.struct(*[w.alias(n) for w, n in zip(word, "abc", strict=True)])
    return F.when(digest.isNotNull(), F.get(F.transform(F.array(seeds), components), 0))
