"""Logistic calibration of a few features, by Newton's method on a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients, the intercept last.  Of a single class, the intercept alone says which."""
    x = np.column_stack([features, np.ones(len(features))])
    if len(set(labels.tolist())) < 2:
        return np.concatenate((np.zeros(x.shape[1] - 1), [3.0 if len(labels) and labels[0] else -3.0]))
    w = weights / weights.sum()
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 0
    for _ in range(100):
        p = sigmoid(x @ beta)
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(beta)), x.T @ (w * (labels - p)) - penalty @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta
