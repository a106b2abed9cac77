"""Logistic regression on sparse rows, fitted on the driver from bounded samples."""

from __future__ import annotations

import numpy as np


class Sparse:
    """Rows of (column, value) lists."""

    def __init__(self, rows: list[list[tuple[int, float]]], columns: int):
        self.n, self.columns = len(rows), columns
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.array([c for r in rows for c, _ in r], np.int64)
        self.value = np.array([v for r in rows for _, v in r], float)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n) if self.n else np.zeros(0)

    def back(self, z: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * z[self.row], self.columns)


class Dense:
    """Rows of an array."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.n, self.columns = rows.shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.rows @ w

    def back(self, z: np.ndarray) -> np.ndarray:
        return z @ self.rows


def sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, float)))


def fit(x: Sparse | Dense, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, ridge_b: float = 0.0, pairs: Sparse | None = None, pull: float = 0.0,
        rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the mean log loss + ridge * |w|^2 / 2 +
    ridge_b * intercept^2 / 2 + pull * mean (pairs . w)^2, by accelerated gradient steps with back-tracking.

    A row of ``pairs`` is the difference of two rows whose scores should be equal."""
    weight = np.ones(len(y)) if weight is None else weight
    total = max(weight.sum(), 1e-12)
    use_pairs = pairs is not None and pairs.n and pull > 0

    def loss(w, b):
        z = x.dot(w) + b
        value = (weight * (np.logaddexp(0, z) - y * z)).sum() / total + ridge * (w @ w) / 2 + ridge_b * b * b / 2
        residual = weight * (sigmoid(z) - y) / total
        slope = x.back(residual) + ridge * w
        if use_pairs:
            d = pairs.dot(w)
            value += pull * (d @ d) / pairs.n
            slope = slope + 2 * pull * pairs.back(d) / pairs.n
        return value, slope, residual.sum() + ridge_b * b

    w, b = np.zeros(x.columns), 0.0
    v, c, step, t = w, b, 1.0, 1.0
    for _ in range(rounds):
        value, slope, slope_b = loss(v, c)
        squared = slope @ slope + slope_b * slope_b
        if squared < 1e-14:
            break
        while True:
            w2, b2 = v - step * slope, c - step * slope_b
            if loss(w2, b2)[0] <= value - step * squared / 2 + 1e-15 or step < 1e-9:
                break
            step /= 2
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        if (v - w2) @ slope > 0:            # the momentum points uphill: start anew
            v, c, t2 = w2, b2, 1.0
        w, b, t, step = w2, b2, t2, step * 1.3
    return w, b
