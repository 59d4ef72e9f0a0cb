"""Small linear models, trained with numpy on a bounded sample on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _descend(x: np.ndarray, slope, ridge: float, smooth: float, steps: int, used: np.ndarray | None = None) -> np.ndarray:
    """Accelerated gradient descent on mean loss plus ridge; the last weight is the bias, which has no ridge.

    ``x`` is never copied: the column of ones of the bias is only thought of, and
    rows that are not ``used`` have a slope of 0.
    """
    n, d = x.shape
    if used is not None:
        n = max(1, int(used.sum()))

    def forth(w: np.ndarray) -> np.ndarray:
        return x @ w[:d] + w[d]

    def back(r: np.ndarray) -> np.ndarray:
        return np.append(x.T @ r, r.sum(dtype=x.dtype))

    v = np.full(d + 1, 1 / np.sqrt(d + 1), x.dtype)
    seen = forth if used is None else lambda w: forth(w) * used
    for _ in range(12):
        v = back(seen(v))
        v /= max(float(np.linalg.norm(v)), 1e-30)
    rate = x.dtype.type(1.0 / (smooth * 1.1 * float(np.linalg.norm(seen(v))) ** 2 / n + ridge))
    w = u = np.zeros(d + 1, x.dtype)
    held = np.full(d + 1, ridge, x.dtype)
    held[d] = 0
    for k in range(steps):
        step = u - rate * (back(slope(forth(u))) / n + held * u)
        u, w = step + x.dtype.type(k / (k + 3)) * (step - w), step
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Weights, the bias last, for labels 0 and 1."""
    y = y.astype(x.dtype)
    return _descend(x, lambda z: (sigmoid(z) - y).astype(x.dtype), ridge, 0.25, steps)


def squared_hinge_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Weights, the bias last, of a linear support vector machine; labels -1 and 1, 0 for rows that don't count."""
    y = y.astype(x.dtype)
    return _descend(x, lambda z: (-2 * y * np.maximum(0, 1 - y * z)).astype(x.dtype), ridge, 2.0, steps, np.abs(y))


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]
