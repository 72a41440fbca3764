"""Series diagnostics against plain numpy."""

import itertools

import numpy as np
import pytest

from ledgerloom import registry
from ledgerloom.kernels.breaks import adf, binary_segmentation, kpss, pelt_mean_variance

QUERIES, _ = registry.load()


def test_breaks_against_brute_force():
    rng = np.random.default_rng(1)
    y = np.concatenate([rng.normal(0, 1, 80), rng.normal(3, 1, 60), rng.normal(3, 4, 70)])
    rss = lambda a, b: ((y[a:b] - y[a:b].mean()) ** 2).sum()
    found = binary_segmentation(y, 2, 10)
    one = min(range(10, len(y) - 9), key=lambda t: rss(0, t) + rss(t, len(y)))
    assert found[1]["at"] == [one] and found[1]["rss"] == pytest.approx(rss(0, one) + rss(one, len(y))) and found[1]["bic"] < found[0]["bic"]
    price = lambda a, b: (b - a) * np.log(y[a:b].var())
    penalty = 3 * np.log(len(y))
    total = lambda cuts: sum(price(a, b) for a, b in zip([0, *cuts], [*cuts, len(y)])) + penalty * len(cuts)
    places = range(20, len(y) - 19)
    best = min([(), *[(t,) for t in places], *[(s, t) for s, t in itertools.combinations(places, 2) if t - s >= 20]], key=total)
    mine = pelt_mean_variance(y, 20)
    assert total(mine) <= total(best) + 1e-9 and len(mine) == 2


def test_unit_roots():
    rng = np.random.default_rng(2)
    noise = rng.normal(size=600)
    walk = np.cumsum(noise)
    assert adf(noise)[0] < -3.41 < adf(walk)[0] and kpss(noise)[0] < 0.146 < kpss(walk)[0]
    y, t = noise, np.arange(len(noise))
    x = np.column_stack([y[:-1], np.ones(599), t[1:]])
    beta = np.linalg.lstsq(x, np.diff(y), rcond=None)[0]
    e = np.diff(y) - x @ beta
    se = (e @ e / (599 - 3) * np.linalg.inv(x.T @ x)[0, 0]) ** 0.5
    assert adf(noise, 0) == (pytest.approx(beta[0] / se), 0)


def test_series_queries(spark, sf_dir):
    tests = {r.test: r for r in QUERIES["x29_unit_roots"](spark, sf_dir).collect()}
    assert tests["adf"].rejects and set(tests) == {"adf", "kpss"}
    rows = QUERIES["x38_x40_changepoints"](spark, sf_dir).collect()
    assert sum(r.chosen for r in rows if r.method == "segmentation") == 1 and all(len(r.dates) == r.breaks for r in rows)
