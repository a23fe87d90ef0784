"""Small numpy learners that run on the driver over bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit_sparse_logistic(
    rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, n_cols: int, l2: float, steps: int = 150
) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression over (row, column, value) entries, by accelerated gradient descent."""
    n = len(y)
    times = lambda w, b: np.bincount(rows, vals * w[cols], n) + b
    v = np.ones(n_cols) / max(1.0, np.sqrt(n_cols))
    size = 1.0
    for _ in range(12):  # the largest singular value bounds the curvature
        u = np.bincount(rows, vals * v[cols], n)
        v = np.bincount(cols, vals * u[rows], n_cols)
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    step = 1.0 / (0.25 * (1.1 * size + n) / n + l2)
    w, b = np.zeros(n_cols), 0.0
    w_at, b_at, t = w, b, 1.0
    for _ in range(steps):
        err = (sigmoid(times(w_at, b_at)) - y) / n
        w_new = w_at - step * (np.bincount(cols, vals * err[rows], n_cols) + l2 * w_at)
        b_new = b_at - step * err.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w_at, b_at = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return w, float(b)


def fit_dense_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, steps: int = 25) -> np.ndarray:
    """Weighted L2-regularised logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-9
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        move = np.linalg.solve(curve, grad)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return w
