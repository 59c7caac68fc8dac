"""Logistic regression of a few features, by Newton steps."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 30) -> np.ndarray:
    """Weights of the columns of ``x`` and, last, of a constant. Without rows all are 0."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if not len(x):
        return w
    prior = np.full(x.shape[1], ridge * 100)
    prior[-1] = ridge
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + prior * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(prior) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
    return w


def score_logistic(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


def prior_shift(labels, share: float | None) -> float:
    """What the constant gains when label 1 has ``share`` of all rows and another share of the fitted ones."""
    fitted = float(np.mean(labels)) if len(labels) else 0.0
    if share is None or not 0 < share < 1 or not 0 < fitted < 1:
        return 0.0
    return float(np.log(share / (1 - share)) - np.log(fitted / (1 - fitted)))
