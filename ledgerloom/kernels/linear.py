"""Least squares and grouped likelihood fits from sums: every row is used where it lies, only normal equations meet.

A design is a set of named column expressions. Tasks add up X'X, X'y and what covariances need over their own rows, Spark adds
up the tasks; what reaches the driver has the size of the design, not of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fit:
    """names, coefficients and their covariance, with the number of rows and of clusters."""

    names: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    rows: int
    clusters: int = 0
    converged: bool = True

    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.covariance), 0, None))


def summed(df: DataFrame, f: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what f adds up over a part of them: one vector from each task, added up by place."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                part = f(frame)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"place": np.arange(len(total)), "value": total})

    rows = df.mapInPandas(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    return np.array([r.value for r in sorted(rows, key=lambda r: r.place)])


class Design:
    """Rows with columns y (and n), x0, x1, ... as numbers, and the columns that are kept."""

    def __init__(self, df: DataFrame, x: dict[str, Column], keep: tuple[str, ...] = (), **values: Column):
        self.names, self.k = list(x), len(x)
        self.xs = xs = [f"x{i}" for i in range(self.k)]
        # A plain function, so that what tasks run doesn't carry the rows themselves.
        self.matrix = lambda frame: frame[xs].to_numpy(float)
        self.rows = df.select(*[c.cast("double").alias(n) for n, c in zip(self.xs, x.values())], *[c.cast("double").alias(n) for n, c in values.items()], *keep)

    def squares(self, weight: Callable[[pd.DataFrame, np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum of weight * x x'."""
        matrix = self.matrix

        def part(frame: pd.DataFrame) -> np.ndarray:
            x = matrix(frame)
            return (x.T @ (x * weight(frame, x)[:, None])).reshape(-1)

        return summed(self.rows, part).reshape(self.k, self.k)

    def condition(self) -> float:
        """The largest singular value over the smallest, from triangles: one of each task, and one of those."""
        matrix, xs = self.matrix, self.xs

        def triangle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None
            for frame in frames:
                m = matrix(frame)
                held = np.linalg.qr(m if held is None else np.concatenate([held, m]), mode="r")
            if held is not None:
                yield pd.DataFrame(held, columns=xs)

        schema = ", ".join(f"{c} double" for c in xs)
        rows = self.rows.select(*xs).mapInPandas(triangle, schema).repartition(1).mapInPandas(triangle, schema).collect()
        s = np.linalg.svd(np.array([tuple(r) for r in rows], float), compute_uv=False)
        return float(s[0] / s[-1]) if len(s) == self.k and s[-1] > 0 else float("inf")

    def clustered(self, cluster: str, residual: Callable[[pd.DataFrame, np.ndarray], np.ndarray]) -> tuple[np.ndarray, int]:
        """Sum over clusters of the outer products of their summed scores, and their number."""
        matrix, xs = self.matrix, self.xs

        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                x = matrix(frame)
                scores = pd.DataFrame(x * residual(frame, x)[:, None], columns=xs)
                scores["cluster"] = frame[cluster].astype(str).to_numpy()
                yield scores.groupby("cluster", as_index=False)[xs].sum()[["cluster", *xs]]

        schema = "cluster string, " + ", ".join(f"{c} double" for c in xs)
        by = self.rows.mapInPandas(part, schema).groupBy("cluster").agg(*[F.sum(c).alias(c) for c in xs])

        def outer(frame: pd.DataFrame) -> np.ndarray:
            s = matrix(frame)
            return np.append((s.T @ s).reshape(-1), len(s))

        total = summed(by, outer)
        return total[:-1].reshape(self.k, self.k), int(total[-1])


def ols(df: DataFrame, y: Column, x: dict[str, Column], covariance: str = "hc3", cluster: str | None = None, order: str | None = None, lags: int = 7) -> Fit:
    """Least squares of y on the named columns. covariance: plain, hc3, cluster (CR1, by cluster) or hac (Bartlett weights over lags rows
    in the order of a column; meant for series, whose scores are collected)."""
    d = Design(df, x, tuple(c for c in (cluster, order) if c), y=y)
    k, matrix = d.k, d.matrix

    def first(frame: pd.DataFrame) -> np.ndarray:
        m, v = matrix(frame), frame["y"].to_numpy(float)
        return np.concatenate([(m.T @ m).reshape(-1), m.T @ v, [len(v)]])

    sums = summed(d.rows, first)
    xx, n = sums[: k * k].reshape(k, k), int(sums[-1])
    if np.linalg.matrix_rank(xx) < k:
        raise ValueError("the columns depend on each other")
    inverse = np.linalg.inv(xx)
    beta = inverse @ sums[k * k : -1]
    residual = lambda frame, m: frame["y"].to_numpy(float) - m @ beta
    groups = 0
    if covariance == "plain":
        meat = xx * float(summed(d.rows, lambda f: np.array([(residual(f, matrix(f)) ** 2).sum()]))[0]) / (n - k)
    elif covariance == "hc3":
        meat = d.squares(lambda f, m: (residual(f, m) / (1 - np.einsum("ij,jk,ik->i", m, inverse, m))) ** 2)
    elif covariance == "cluster":
        meat, groups = d.clustered(cluster, residual)
        meat = meat * groups / (groups - 1) * (n - 1) / (n - k)
    elif covariance == "hac":
        series = d.rows.orderBy(order).toPandas()
        m = matrix(series)
        scores = m * residual(series, m)[:, None]
        meat = scores.T @ scores
        for lag in range(1, lags + 1):
            g = scores[lag:].T @ scores[:-lag]
            meat += (1 - lag / (lags + 1)) * (g + g.T)
    else:
        raise ValueError(covariance)
    return Fit(d.names, beta, inverse @ meat @ inverse, n, groups)


def newton(d: Design, beta: np.ndarray, mean: Callable[[pd.DataFrame, np.ndarray], tuple[np.ndarray, np.ndarray]], tolerance: float, most: int) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """Steps to where the scores vanish. mean gives expected value and variance of y for a linear predictor cut at 35 in size."""
    k, matrix = d.k, d.matrix
    for turn in range(most + 1):

        def part(frame: pd.DataFrame, at=beta) -> np.ndarray:
            m = matrix(frame)
            mu, variance = mean(frame, np.clip(m @ at, -35, 35))
            return np.concatenate([(m.T @ (m * variance[:, None])).reshape(-1), m.T @ (frame["y"].to_numpy(float) - mu), [len(m)]])

        sums = summed(d.rows, part)
        inverse = np.linalg.pinv(sums[: k * k].reshape(k, k))
        step = inverse @ sums[k * k : -1]
        if np.abs(step).max() < tolerance or turn == most:
            return beta, inverse, int(sums[-1]), bool(np.abs(step).max() < tolerance)
        beta = beta + step
    raise AssertionError


def grouped_logit(cells: DataFrame, successes: str, trials: str, x: dict[str, Column], cluster: str, tolerance: float = 1e-8, most: int = 40) -> Fit:
    """Binomial logit of grouped counts with CR1 covariance by cluster; converged says honestly whether the steps died down."""
    d = Design(cells, x, (cluster,), y=F.col(successes), n=F.col(trials))

    def mean(frame: pd.DataFrame, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, n = 1 / (1 + np.exp(-eta)), frame["n"].to_numpy(float)
        return n * p, n * p * (1 - p)

    beta, inverse, rows, done = newton(d, np.zeros(d.k), mean, tolerance, most)
    meat, groups = d.clustered(cluster, lambda f, m: f["y"].to_numpy(float) - mean(f, np.clip(m @ beta, -35, 35))[0])
    meat = meat * groups / max(1, groups - 1) * (rows - 1) / max(1, rows - d.k)
    return Fit(d.names, beta, inverse @ meat @ inverse, rows, groups, done)


def poisson(df: DataFrame, y: str, x: dict[str, Column], tolerance: float = 1e-8, most: int = 40) -> Fit:
    """Poisson regression with a log link and the robust (HC0) covariance of pseudo maximum likelihood; x needs a column const."""
    d = Design(df, x, y=F.col(y))
    start = np.zeros(d.k)
    start[d.names.index("const")] = np.log(max(1e-12, float(df.agg(F.avg(y)).first()[0])))
    mean = lambda frame, eta: (np.exp(eta), np.exp(eta))
    beta, inverse, rows, done = newton(d, start, mean, tolerance, most)
    meat = d.squares(lambda f, m: (f["y"].to_numpy(float) - np.exp(np.clip(m @ beta, -35, 35))) ** 2)
    return Fit(d.names, beta, inverse @ meat @ inverse, rows, 0, done)


def wald(fit: Fit, contrast: np.ndarray) -> tuple[float, int]:
    """Wald's statistic of contrast @ beta = 0, divided by its number of restrictions, and that number."""
    c = np.atleast_2d(contrast)
    value = c @ fit.beta
    q = int(np.linalg.matrix_rank(c))
    return float(value @ np.linalg.pinv(c @ fit.covariance @ c.T) @ value) / q, q


def local_logit(x: np.ndarray, y: np.ndarray, n: np.ndarray, tolerance: float = 1e-8, most: int = 60) -> tuple[np.ndarray, np.ndarray, bool]:
    """Coefficients, inverse information and convergence of a grouped logit whose cells fit in one task."""
    beta = np.zeros(x.shape[1])
    for _ in range(most):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        inverse = np.linalg.pinv(x.T @ (x * (n * p * (1 - p))[:, None]))
        step = inverse @ (x.T @ (y - n * p))
        if np.abs(step).max() < tolerance:
            return beta, inverse, True
        beta = beta + step
    return beta, inverse, False
