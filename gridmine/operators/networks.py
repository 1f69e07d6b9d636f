"""A network with one hidden layer, trained on different rows with their numbers.

Spark ML's network takes no weights, so a corpus in which few different rows occur very often is gone through row by
row in every iteration. Here a row stands for ``n`` equal ones and enters the loss and its gradient ``n`` times, which is
the loss over all rows. An evaluation is one Spark job that returns one loss and gradient per task; the driver holds
the weights and their last few changes only. Units, loss and optimiser are those of Spark ML: sigmoid, softmax, L-BFGS.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose hidden units are held at once.
_ROWS_AT_ONCE = 4_096


@dataclass
class Network:
    """Weights of (columns - hidden - 2 classes), and mean and scale of the columns."""

    columns: list[str]
    hidden: int
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def inputs(self, batch: pa.RecordBatch) -> np.ndarray:
        raw = np.stack([np.asarray(batch[c].to_numpy(zero_copy_only=False), dtype=float) for c in self.columns], axis=1)
        if not np.isfinite(raw).all():
            raise ValueError("an input of the network is missing or not finite")
        return (raw - self.mean) * self.scale

    def layers(self) -> tuple[np.ndarray, ...]:
        w, d, h = self.weights, len(self.columns), self.hidden
        return w[: d * h].reshape(d, h), w[d * h : (d + 1) * h], w[(d + 1) * h : (d + 3) * h].reshape(h, 2), w[(d + 3) * h :]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hidden units, log of the two probabilities)."""
        w1, b1, w2, b2 = self.layers()
        hidden = 0.5 * (1 + np.tanh(0.5 * (x @ w1 + b1)))
        z = hidden @ w2 + b2
        return hidden, z - np.logaddexp(z[:, :1], z[:, 1:])

    def loss(self, x: np.ndarray, label: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Rows, loss and gradient over the rows, each ``n`` times, as one array."""
        hidden, logs = self.forward(x)
        error = np.exp(logs)
        error[np.arange(len(x)), label] -= 1
        error *= n[:, None]
        back = (error @ self.layers()[2].T) * hidden * (1 - hidden)
        total = -(n * logs[np.arange(len(x)), label]).sum()
        return np.concatenate([[n.sum(), total], (x.T @ back).ravel(), back.sum(axis=0), (hidden.T @ error).ravel(), error.sum(axis=0)])

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds the likelier class as ``prediction``."""
        names = rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
                    part = batch.slice(at, _ROWS_AT_ONCE)
                    logs = self.forward(self.inputs(part))[1]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array((logs[:, 1] > logs[:, 0]).astype(float))], names=[*names, "prediction"])

        return rows.mapInArrow(run, rows.withColumn("prediction", F.lit(0.0)).schema)


def moments(rows: DataFrame, columns: Sequence[str], n: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and 1 / standard deviation (0 for a constant) of columns, each row ``n`` times."""
    total = F.sum(n).cast("double")
    first = rows.agg(total.alias("_n"), *[F.sum(F.col(c) * F.col(n)) / total for c in columns]).first()
    if not first[0]:
        return np.zeros(len(columns)), np.zeros(len(columns))
    mean = np.array(first[1:], dtype=float)
    squares = [F.sum((F.col(c) - float(m)) ** 2 * F.col(n)) for c, m in zip(columns, mean, strict=True)]
    deviation = np.sqrt(np.array(rows.agg(*squares).first(), dtype=float) / max(1.0, first[0] - 1))
    return mean, np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, iterations: int, memory: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """L-BFGS with step halving; ``f`` gives value and gradient."""
    value, slope = f(x)
    changes: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        way, seen = -slope, []
        for s, y in reversed(changes):
            seen.append((s @ way) / (s @ y))
            way = way - seen[-1] * y
        if changes:
            s, y = changes[-1]
            way = way * ((s @ y) / (y @ y))
        for (s, y), a in zip(changes, reversed(seen), strict=True):
            way = way + (a - (y @ way) / (s @ y)) * s
        down, step = way @ slope, 1.0 if changes else 1 / max(1.0, float(np.linalg.norm(slope)))
        while step > 1e-10:
            new_value, new_slope = f(x + step * way)
            if new_value <= value + 1e-4 * step * down:
                break
            step /= 2
        else:
            return x
        s, y = step * way, new_slope - slope
        if s @ y > 1e-12 * (y @ y):
            changes = [*changes, (s, y)][-memory:]
        small = value - new_value <= tolerance * max(abs(value), abs(new_value))
        x, value, slope = x + s, new_value, new_slope
        if small:
            break
    return x


def fit_network(rows: DataFrame, columns: Sequence[str], scaled_by: DataFrame, n: str = "n", label: str = "label", hidden: int = 128, seed: int = 0, iterations: int = 20) -> Network:
    """Network for labels 0 and 1. ``rows`` is read once per evaluation, so callers hand in a written table.

    The columns are standardised by the rows of ``scaled_by``, which has numbers as well.
    """
    d, draw = len(columns), np.random.default_rng(seed)
    bounds = np.repeat(np.sqrt([6 / (d + hidden), 6 / (hidden + 2)]), [(d + 1) * hidden, (hidden + 1) * 2])
    mean, scale = moments(scaled_by, columns, n)
    start = draw.uniform(-1, 1, len(bounds)) * bounds
    data = rows.select(*columns, F.col(label).cast("int").alias("_label"), F.col(n).cast("double").alias("_n"))

    def at(weights: np.ndarray) -> tuple[float, np.ndarray]:
        model = Network(list(columns), hidden, mean, scale, weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + len(weights))
            for batch in batches:
                for first in range(0, batch.num_rows, _ROWS_AT_ONCE):
                    part = batch.slice(first, _ROWS_AT_ONCE)
                    total += model.loss(model.inputs(part), part["_label"].to_numpy(), part["_n"].to_numpy())
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["total"])

        # one row per task
        total = sum((np.frombuffer(r["total"]) for r in data.mapInArrow(run, "total binary").collect()), np.zeros(2 + len(weights)))
        if not total[0]:
            raise ValueError("no rows to train on")
        return total[1] / total[0], total[2:] / total[0]

    return Network(list(columns), hidden, mean, scale, minimise(at, start, iterations))
