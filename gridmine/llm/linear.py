"""Logistic regression over sparse rows, full gradient with momentum per weight (inside a task)."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; an empty run gives 0."""
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return sums[at[1:]] - sums[at[:-1]]


def fit(
    index: np.ndarray,
    value: np.ndarray,
    at: np.ndarray,
    target: np.ndarray,
    weight: np.ndarray,
    size: int,
    l2: float,
    rounds: int,
    rate: float = 0.1,
    pairs: tuple[np.ndarray, np.ndarray] | None = None,
    penalty: float = 0.0,
) -> tuple[np.ndarray, float]:
    """(weights, bias) minimising weighted cross-entropy + l2 + penalty * squared score gaps of row pairs.

    Rows of weight 0 take part in pairs only. Targets may be probabilities. Adam with fixed steps:
    the same input gives the same weights.
    """
    w, bias = np.zeros(size), 0.0
    m, v, m0, v0 = np.zeros(size), np.zeros(size), 0.0, 0.0
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    share = weight / max(weight.sum(), 1e-12)
    for t in range(1, rounds + 1):
        z = row_sums(w[index] * value, at) + bias
        e = share * (sigmoid(z) - target)
        if pairs is not None and len(pairs[0]):
            gap = penalty * 2 * (z[pairs[0]] - z[pairs[1]]) / len(pairs[0])
            e = e + np.bincount(pairs[0], gap, len(e)) - np.bincount(pairs[1], gap, len(e))
            bias_slope = float((share * (sigmoid(z) - target)).sum())
        else:
            bias_slope = float(e.sum())
        g = np.bincount(index, value * e[row], size) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        m0, v0 = 0.9 * m0 + 0.1 * bias_slope, 0.999 * v0 + 0.001 * bias_slope**2
        up, down = 1 - 0.9**t, 1 - 0.999**t
        w = w - rate * (m / up) / (np.sqrt(v / down) + 1e-9)
        bias -= rate * (m0 / up) / (np.sqrt(v0 / down) + 1e-9)
    return w, bias
