"""Fits of one daily series, as kernels for tasks: a series has a row for each day, whatever the number of events."""

from __future__ import annotations

import numpy as np


def bartlett(scores: np.ndarray, lags: int) -> np.ndarray:
    """Sum of the outer products of scores, and of neighbours up to so many rows apart with falling weights."""
    meat = scores.T @ scores
    for lag in range(1, min(lags, len(scores) - 1) + 1):
        g = scores[lag:].T @ scores[:-lag]
        meat += (1 - lag / (lags + 1)) * (g + g.T)
    return meat


def least_squares(x: np.ndarray, y: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Coefficients, their autocorrelation-robust covariance, and True."""
    turned = np.linalg.pinv(x)
    beta = turned @ y
    inverse = turned @ turned.T
    return beta, inverse @ bartlett(x * (y - x @ beta)[:, None], lags) @ inverse, True


def by_cluster(x: np.ndarray, y: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Coefficients of least squares, their CR1 covariance by label, and the number of labels."""
    turned = np.linalg.pinv(x)
    beta = turned @ y
    found, at = np.unique(labels, return_inverse=True)
    sums = np.zeros((len(found), x.shape[1]))
    np.add.at(sums, at, x * (y - x @ beta)[:, None])
    g, (n, k) = len(found), x.shape
    inverse = turned @ turned.T
    return beta, inverse @ sums.T @ sums @ inverse * g / max(1, g - 1) * (n - 1) / max(1, n - k), g


def counts(x: np.ndarray, y: np.ndarray, lags: int, tolerance: float = 1e-8, most: int = 60) -> tuple[np.ndarray, np.ndarray, bool]:
    """The same for Poisson pseudo maximum likelihood with a log link (first column of x: ones), and whether the steps died down."""
    beta, done = np.append(np.log(max(1e-12, y.mean())), np.zeros(x.shape[1] - 1)), False
    for _ in range(most):
        mu = np.exp(np.clip(x @ beta, -35, 35))
        root = np.sqrt(mu)[:, None]
        step = np.linalg.pinv(x * root) @ ((y - mu) / root[:, 0])
        beta = beta + step
        if np.abs(x @ step).max() < tolerance:
            done = True
            break
    mu = np.exp(np.clip(x @ beta, -35, 35))
    turned = np.linalg.pinv(x * np.sqrt(mu)[:, None])
    inverse = turned @ turned.T
    return beta, inverse @ bartlett(x * (y - mu)[:, None], lags) @ inverse, done


def restricted(beta: np.ndarray, covariance: np.ndarray, contrast: np.ndarray) -> tuple[float, int]:
    """Wald's statistic of contrast @ beta = 0, not divided, and the number of restrictions."""
    value = contrast @ beta
    return float(value @ np.linalg.pinv(contrast @ covariance @ contrast.T) @ value), int(np.linalg.matrix_rank(contrast))
