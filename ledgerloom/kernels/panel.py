"""Grouped logits on categories: cells are coded once, and every step adds up what cells of equal codes share.

A cell holds a code for each category, successes and trials; cells lie packed in blocks where Spark has put them. An indicator of a level is never a column: sums over a
block are counts by code and by pair of codes, and a task hands on one vector for each model, added up by model before any of it reaches the driver, where only
systems of the design's size are solved. Many models (refits without one level of a category, say) go through the same passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stored
from .linear import Fit

#: Linear predictors are cut at this size; steps end when they, or the change of the deviance, are below these.
CUT, STEP, DEVIANCE = 35.0, 1e-8, 1e-8
#: Steps below this keep the information as it is.
NEAR = 0.05
#: A fitted probability this near to 0 or 1 is on the boundary.
BOUNDARY = 1e-6
#: Clusters whose scores are multiplied out at a time.
CLUSTERS = 4096


@dataclass(frozen=True)
class Model:
    """Terms (label -> category) beside a constant, the level that each is measured against (else the first there is), and cells (category, level) that are left out."""

    terms: dict[str, str]
    against: dict[str, str] = field(default_factory=dict)
    without: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Logit(Fit):
    """A fit with the inverse information, the places of its columns among all levels, and deviance and Pearson's statistic; covariance is the inverse information."""

    inverse: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    wide: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rank: int = 0
    condition: float = 1.0
    deviance: float = 0.0

    def sandwich(self, meat: np.ndarray, groups: int | None = None) -> np.ndarray:
        """Covariance from a meat over all levels; with the CR1 factor where groups are given."""
        own = meat[np.ix_(self.places, self.places)]
        k = len(self.places)
        factor = groups / (groups - 1) * (self.rows - 1) / (self.rows - k) if groups is not None and groups > 1 and self.rows > k else 1.0
        return self.inverse @ own @ self.inverse * factor

    def clustered(self, meat: np.ndarray, groups: int) -> Fit:
        return Fit(self.names, self.beta, self.sandwich(meat, groups), self.rows, groups, self.converged)


@dataclass(frozen=True)
class Sums:
    """Over a model's cells: their number, deviance, Pearson's statistic, how many are on the boundary; score and cells by level, and a square of level by level."""

    rows: float
    deviance: float
    pearson: float
    boundary: float
    score: np.ndarray
    cells: np.ndarray
    square: np.ndarray | None


class Panel:
    """Cells (a row for each) of a table that doesn't grow with events, coded by its categories."""

    def __init__(self, cells: DataFrame, categories: list[str], successes: str, trials: str):
        cells = cells.select(*[F.col(c).cast("string").alias(c) for c in categories], F.col(successes).cast("double").alias("y"), F.col(trials).cast("double").alias("n")).cache()
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("level")) for c in categories]))
        found = cells.select(pairs.alias("p")).select("p.*").where("level is not null").distinct().collect()  # the design's own size
        self.levels = {c: sorted(r["level"] for r in found if r["category"] == c) for c in categories}
        levels, self.categories, self.spark = self.levels, categories, cells.sparkSession

        def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                frame = frame.dropna()
                codes = np.array([pd.Index(levels[c]).get_indexer(frame[c]) for c in categories], np.int32)
                yield pd.DataFrame({"cells": [len(frame)], "data": [codes.tobytes() + frame["y"].to_numpy(float).tobytes() + frame["n"].to_numpy(float).tobytes()]})

        self.blocks = stored(cells.mapInPandas(packed, "cells int, data binary"))
        cells.unpersist()

    def starts(self, model: Model) -> tuple[list[int], int]:
        """Where the levels of each term begin in a vector over all levels, after the constant, and its length."""
        sizes = [len(self.levels[c]) for c in model.terms.values()]
        return [1 + sum(sizes[:i]) for i in range(len(sizes))], 1 + sum(sizes)

    def reader(self, models: list[Model], at: list[np.ndarray]) -> Callable[[int, bytes], Iterator[tuple]]:
        """For a block: of each model its number, codes of its terms, codes of all categories, y, n and the linear predictor of its cells."""
        count, order = len(self.categories), {c: i for i, c in enumerate(self.categories)}
        shape = [([order[c] for c in m.terms.values()], self.starts(m)[0], [(order[c], self.levels[c].index(v)) for c, v in m.without if v in self.levels[c]]) for m in models]

        def read(cells: int, data: bytes) -> Iterator[tuple]:
            codes = np.frombuffer(data, np.int32, count * cells).reshape(count, cells)
            y, n = np.frombuffer(data, float, 2 * cells, count * cells * 4).reshape(2, cells)
            for i, (own, starts, without) in enumerate(shape):
                some, y_, n_ = codes, y, n
                if without:
                    left = ~np.any([codes[c] == v for c, v in without], axis=0)
                    some, y_, n_ = codes[:, left], y[left], n[left]
                eta = at[i][0] + sum((at[i][s + some[c]] for c, s in zip(own, starts)), np.zeros(some.shape[1]))
                yield i, [some[c] for c in own], some, y_, n_, np.clip(eta, -CUT, CUT)

        return read

    def added(self, models: list[Model], at: list[np.ndarray], part: Callable[..., np.ndarray]) -> dict[str, np.ndarray]:
        """The sum over all blocks of what part makes of each model's cells, by its number; a model has none if there are no blocks."""
        read = self.reader(models, at)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[int, np.ndarray] = {}
            for frame in frames:
                for cells, data in zip(frame["cells"], frame["data"]):
                    for i, *own in read(int(cells), data):
                        vector = part(i, *own)
                        total[i] = total[i] + vector if i in total else vector
            yield from vectors(total)

        return by_key(self.blocks.mapInPandas(run, "key string, data binary"), len(models))

    def sums(self, models: list[Model], at: list[np.ndarray], weight: str | None = "information") -> list[Sums]:
        """Of each model at its coefficients over all levels (at). weight says what cells count with in the square: information, squares (of the
        score) or cells; with None there is none, only the score."""
        sizes = [[len(self.levels[c]) for c in m.terms.values()] for m in models]

        def part(i: int, codes: list[np.ndarray], _, y: np.ndarray, n: np.ndarray, eta: np.ndarray) -> np.ndarray:
            p = 1 / (1 + np.exp(-eta))
            w, r = n * p * (1 - p), y - n * p
            deviance = 2 * (where_positive(y, y / np.maximum(n * p, 1e-300)) + where_positive(n - y, (n - y) / np.maximum(n * (1 - p), 1e-300))).sum()
            numbers = [len(y), deviance, (r * r / np.maximum(w, 1e-300)).sum(), ((p < BOUNDARY) | (p > 1 - BOUNDARY)).sum()]
            by_level = lambda v: np.concatenate([[v.sum()], *[np.bincount(c, v, size) for c, size in zip(codes, sizes[i])]])
            own = {"information": w, "squares": r * r, "cells": np.ones(len(y))}
            return np.concatenate([numbers, by_level(r), by_level(np.ones(len(y))), *([pairwise(codes, sizes[i], own[weight])] if weight else [])])

        out, got = [], self.added(models, at, part)
        for i, own in enumerate(sizes):
            whole = 1 + sum(own)
            v = got.get(str(i), np.zeros(4 + 2 * whole + pair_count(own)))
            out.append(Sums(*v[:4], v[4 : 4 + whole], v[4 + whole : 4 + 2 * whole], square(v[4 + 2 * whole :], own) if weight else None))
        return out

    def fit(self, models: list[Model], most: int = 60, start: np.ndarray | None = None) -> list[Logit]:
        """Maximum likelihood of every model by Newton's steps, from 0 or from coefficients over all levels; halved where the deviance grows. While steps are small the
        information is kept, and a pass adds up scores alone; it is taken anew where the steps end. Levels without cells have no column."""
        at = [np.zeros(self.starts(m)[1]) if start is None else start.copy() for m in models]
        step: list[np.ndarray | None] = [None] * len(models)
        inverse: list[np.ndarray] = [np.zeros((0, 0))] * len(models)
        before, ended = [np.inf] * len(models), [False] * len(models)
        for _ in range(most):
            for kept in (False, True):
                some = [i for i in range(len(models)) if not ended[i] and (step[i] is not None and np.abs(step[i]).max() < NEAR) == kept]
                for i, got in zip(some, self.sums([models[i] for i in some], [at[i] for i in some], None if kept else "information") if some else []):
                    if step[i] is not None and got.deviance > before[i] + DEVIANCE * max(1.0, before[i]) and np.abs(step[i]).max() > STEP:
                        step[i] = step[i] / 2
                        at[i] = at[i] - step[i]
                        continue
                    places = self.columns(models[i], got.cells)[0]
                    without = np.setdiff1d(np.arange(len(at[i])), places)
                    if at[i][without].any():  # a start that knows of levels that have no column here
                        at[i][without] = 0
                        continue
                    if got.square is not None:
                        inverse[i] = np.linalg.pinv(got.square[np.ix_(places, places)], hermitian=True)
                    new = np.zeros(len(at[i]))
                    new[places] = inverse[i] @ got.score[places]
                    ended[i] = bool(np.abs(new).max() < STEP or got.deviance <= before[i] and before[i] - got.deviance <= DEVIANCE and np.abs(new).max() > NEAR)
                    before[i], step[i] = got.deviance, new
                    at[i] = at[i] if ended[i] else at[i] + new
            if all(ended):
                break
        out = []
        for model, wide, last, raw, done in zip(models, at, self.sums(models, at), self.sums(models, at, "cells"), ended):
            places, names = self.columns(model, last.cells)
            own = raw.square[np.ix_(places, places)]  # whole numbers: exact
            values = np.linalg.eigvalsh(own)
            full = values[0] > len(places) * np.finfo(float).eps * values[-1]
            rank = len(places) if full else int(np.linalg.matrix_rank(own, hermitian=True))
            information = np.linalg.pinv(last.square[np.ix_(places, places)], hermitian=True)
            out.append(Logit(names, wide[places], information, int(last.rows), 0, done, information, places, wide, rank, float(np.sqrt(values[-1] / values[0])) if full else float("inf"), float(last.deviance)))
        return out

    def columns(self, model: Model, cells: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Places and names of the constant and of every level with cells but the one that its term is measured against."""
        places, names = [0], ["const"]
        for (label, category), start in zip(model.terms.items(), self.starts(model)[0]):
            there = [j for j in range(len(self.levels[category])) if cells[start + j] > 0]
            against = self.levels[category].index(model.against[label]) if label in model.against else there[0] if there else -1
            places += [start + j for j in there if j != against]
            names += [f"{label}[{self.levels[category][j]}]" for j in there if j != against]
        return np.array(places), names

    def meats(self, models: list[Model], fits: list[Logit], clusters: dict[str, list[str]]) -> list[dict[str, tuple[np.ndarray, int]]]:
        """Of each model and each kind of clusters (name -> categories): the sum of outer products of clusters' scores over all levels, and their number."""
        read, order = self.reader(models, [f.wide for f in fits]), {c: i for i, c in enumerate(self.categories)}
        kinds = [(k, [(order[c], len(self.levels[c])) for c in by]) for k, by in clusters.items()]
        shapes = [self.starts(m) for m in models]

        def scores(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for cells, data in zip(frame["cells"], frame["data"]):
                    for i, codes, all_, y, n, eta in read(int(cells), data):
                        r = y - n / (1 + np.exp(-eta))
                        starts, whole = shapes[i]
                        level = np.concatenate([np.zeros(len(r), np.int64), *[s + c for s, c in zip(starts, codes)]])
                        value = np.tile(r, 1 + len(codes))
                        for kind, by in kinds:
                            own = np.zeros(len(r), np.int64)
                            for c, size in by:
                                own = own * size + all_[c]
                            keys, at = np.unique(np.tile(own, 1 + len(codes)) * whole + level, return_inverse=True)
                            yield pd.DataFrame({"key": f"{i} {kind}", "cluster": keys // whole, "level": (keys % whole).astype(np.int32), "value": np.bincount(at, value, len(keys))})

        def outer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[str, np.ndarray] = {}
            for frame in frames:
                for key, rows in frame.groupby("key"):
                    whole = shapes[int(key.split()[0])][1]
                    for a in range(0, len(rows), CLUSTERS):
                        some = rows.iloc[a : a + CLUSTERS]
                        s = np.zeros((len(some), whole))
                        for j, (levels, values) in enumerate(zip(some["levels"], some["scores"])):
                            s[j, levels] = values
                        vector = np.append((s.T @ s).reshape(-1), len(some))
                        total[key] = total[key] + vector if key in total else vector
            yield from vectors(total)

        by_level = self.blocks.mapInPandas(scores, "key string, cluster long, level int, value double").groupBy("key", "cluster", "level").agg(F.sum("value").alias("value"))
        by_cluster = by_level.groupBy("key", "cluster").agg(F.collect_list("level").alias("levels"), F.collect_list("value").alias("scores"))  # at most all levels
        got = by_key(by_cluster.drop("cluster").mapInPandas(outer, "key string, data binary"), len(models) * len(kinds))
        none = [np.zeros(whole * whole + 1) for _, whole in shapes]
        found = [{k: got.get(f"{i} {k}", none[i]) for k in clusters} for i in range(len(models))]
        return [{k: (v[:-1].reshape(shapes[i][1], -1), int(v[-1])) for k, v in of.items()} for i, of in enumerate(found)]


def where_positive(y: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """y * log(ratio), and 0 where y is."""
    return np.where(y > 0, y * np.log(np.where(y > 0, ratio, 1.0)), 0.0)


def pairwise(codes: list[np.ndarray], sizes: list[int], weight: np.ndarray) -> np.ndarray:
    """Sums of weights: of all cells, by level of each term, and by pair of levels of each pair of terms."""
    out = [np.array([weight.sum()])]
    for i, (c, size) in enumerate(zip(codes, sizes)):
        out.append(np.bincount(c, weight, size))
        out += [np.bincount(c.astype(np.int64) * other + d, weight, size * other) for d, other in zip(codes[:i], sizes[:i])]
    return np.concatenate(out)


def pair_count(sizes: list[int]) -> int:
    return 1 + sum(size * (1 + sum(sizes[:i])) for i, size in enumerate(sizes))


def square(flat: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The sums of pairwise as a table of level by level, the constant first."""
    starts = [1 + sum(sizes[:i]) for i in range(len(sizes))]
    out = np.zeros((1 + sum(sizes),) * 2)
    out[0, 0], at = flat[0], 1
    for i, (size, s) in enumerate(zip(sizes, starts)):
        own, at = flat[at : at + size], at + size
        out[0, s : s + size] = out[s : s + size, 0] = own
        out[np.arange(s, s + size), np.arange(s, s + size)] = own
        for other, t in zip(sizes[:i], starts[:i]):
            both, at = flat[at : at + size * other].reshape(size, other), at + size * other
            out[s : s + size, t : t + other], out[t : t + other, s : s + size] = both, both.T
    return out


def vectors(total: dict) -> Iterator[pd.DataFrame]:
    """A row for each key; none at all from a task without any."""
    if total:
        yield pd.DataFrame({"key": [str(k) for k in total], "data": [v.tobytes() for v in total.values()]})


def by_key(rows: DataFrame, keys: int) -> dict[str, np.ndarray]:
    """Vectors (key, data) added up by key: where they are many, in tasks of their own."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for frame in frames:
            for key, data in zip(frame["key"], frame["data"]):
                vector = np.frombuffer(data, float)
                total[key] = total[key] + vector if key in total else vector.copy()
        yield from vectors(total)

    return {r["key"]: np.frombuffer(r["data"], float) for r in rows.repartition(min(keys, 64), "key").mapInPandas(run, "key string, data binary").collect()}
