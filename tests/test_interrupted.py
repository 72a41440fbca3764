"""Interrupted series against plain numpy and against the fits by sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import registry
from ledgerloom.kernels.linear import ols, poisson
from ledgerloom.kernels.series import counts, least_squares
from ledgerloom.plans.interrupted import FIRST, OUTCOMES, SECOND, days

QUERIES, _ = registry.load()


def columns():
    x = {"const": F.lit(1.0), "t": F.col("t")}
    for i, event in enumerate((FIRST, SECOND), 1):
        since = F.datediff("date", F.lit(event).cast("date"))
        x |= {f"step_{i}": (since >= 0).cast("double"), f"slope_{i}": F.greatest(F.lit(0), since).cast("double")}
    return x | {f"weekday_{d}": (F.weekday("date") == d).cast("double") for d in range(1, 7)}


def test_terms_and_slopes(spark, sf_dir):
    got = {(r.outcome, r.lag, r.term): r for r in QUERIES["x46_interrupted_outcomes"](spark, sf_dir).collect()}
    assert len(got) == 3 * 3 * 5
    slopes = {(r.outcome, r.test): r for r in QUERIES["x49_slope_tests"](spark, sf_dir).collect()}
    assert len(slopes) == 9
    for outcome in ("volume", "bots"):
        fit = ols(days(spark, sf_dir).where(F.col(outcome) > 0), F.ln(outcome), columns(), "hac", order="date", lags=14)
        for term in ("t", "step_1", "slope_2"):
            i = fit.names.index(term)
            r = got[outcome, 14, term]
            assert r.estimate == pytest.approx(fit.beta[i], rel=1e-4, abs=1e-8) and r.se == pytest.approx(fit.se()[i], rel=1e-4)
            assert r.percent == pytest.approx(100 * (np.exp(r.estimate) - 1)) and r.percent_low < r.percent < r.percent_high
        c = np.zeros(len(fit.names))
        c[[fit.names.index(n) for n in ("t", "slope_1", "slope_2")]] = 1
        r = slopes[outcome, "slope_after_2"]
        assert r.estimate == pytest.approx(c @ fit.beta, rel=1e-4, abs=1e-8) and r.f == pytest.approx((c @ fit.beta) ** 2 / (c @ fit.covariance @ c), rel=1e-3) and r.free == fit.rows - len(fit.names)
        assert slopes[outcome, "omnibus"].q == 5 and slopes[outcome, "omnibus"].estimate is None
    assert all(r.p <= r.p_holm <= 1 for r in slopes.values())


def test_robustness(spark, sf_dir):
    rows = QUERIES["x47_interrupted_robustness"](spark, sf_dir).collect()
    assert len(rows) == 2 * 3 * (3 + 3) and sum(r.p_holm is not None for r in rows) == 6
    assert all(r.specification == "main" and r.lag == 14 for r in rows if r.p_holm is not None)
    assert all(r.q == 2 and r.f >= 0 and 0 <= r.p <= 1 for r in rows)
    frees = {(r.outcome, r.specification): r.free for r in rows}
    for o in OUTCOMES:
        assert frees[o, "main"] - frees[o, "quadratic_trend"] == 1 and frees[o, "main"] == frees[o, "next_day"]
        assert frees[o, "main"] - frees[o, "calendar_month"] == 11


def test_poisson(spark, sf_dir):
    rows = {(r.outcome, r.test): r for r in QUERIES["x48_poisson_wald"](spark, sf_dir).collect()}
    assert set(rows) == {(o, f"event_{i}") for o in ("legs", "bots") for i in (1, 2)} and all(r.converged and r.q == 2 and 0 <= r.p <= 1 for r in rows.values())
    scaled = {n: c / 1000 if n.startswith(("t", "slope")) else c for n, c in columns().items()}
    fit = poisson(days(spark, sf_dir), "legs", scaled)
    step, slope = (fit.beta[fit.names.index(n)] for n in ("step_1", "slope_1"))
    assert rows["legs", "event_1"].step == pytest.approx(step, rel=1e-4, abs=1e-6) and rows["legs", "event_1"].slope == pytest.approx(slope / 1000, rel=1e-4, abs=1e-8)


def test_kernels():
    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(80), np.arange(80) / 80, rng.normal(size=80)])
    y = x @ [1, -1, 0.5] + rng.normal(size=80)
    beta, v, _ = least_squares(x, y, 0)
    inverse = np.linalg.inv(x.T @ x)
    e = y - x @ beta
    assert np.allclose(beta, inverse @ x.T @ y) and np.allclose(v, inverse @ (x.T * e**2) @ x @ inverse)
    weights = np.clip(1 - np.abs(np.subtract.outer(range(80), range(80))) / 6, 0, None)
    scores = x * e[:, None]
    assert np.allclose(least_squares(x, y, 5)[1], inverse @ (scores.T @ weights @ scores) @ inverse)
    n = rng.poisson(np.exp(x @ [1, 0.3, -0.2])).astype(float)
    beta, v, done = counts(x, n, 5)
    mu = np.exp(x @ beta)
    assert done and np.allclose(x.T @ (n - mu), 0, atol=1e-6)
    inverse = np.linalg.inv((x.T * mu) @ x)
    scores = x * (n - mu)[:, None]
    assert np.allclose(v, inverse @ (scores.T @ weights @ scores) @ inverse)
    # Columns that depend on each other share their effect, and no error is raised.
    assert np.isfinite(least_squares(np.column_stack([x, x[:, 1]]), y, 5)[0]).all()


def test_clusters_of_months(spark, sf_dir):
    from ledgerloom.plans.interrupted import OUTCOMES, days, design

    got = {(r.outcome, r.name): r for r in QUERIES["x33_clustered_series"](spark, sf_dir).collect()}
    frame = days(spark, sf_dir).toPandas().sort_values("t")
    for outcome in OUTCOMES:
        own = frame[frame[outcome] > 0]
        names, x = design(own, "main")
        y, labels = np.log(own[outcome].to_numpy(float)), own.date.map(lambda d: f"{d.year}-{d.month:02}").to_numpy()
        inverse = np.linalg.pinv(x.T @ x)
        beta = inverse @ x.T @ y
        sums = np.array([(x * (y - x @ beta)[:, None])[labels == g].sum(0) for g in np.unique(labels)])
        g, (n, k) = len(sums), x.shape
        v = inverse @ sums.T @ sums @ inverse * g / (g - 1) * (n - 1) / (n - k)
        for name in ("t", "step_1", "slope_1", "step_2", "slope_2"):
            i, r = names.index(name), got[outcome, name]
            assert r.estimate == pytest.approx(beta[i], rel=1e-5, abs=1e-9) and r.se == pytest.approx(v[i, i] ** 0.5, rel=1e-4) and r.df == g - 1
        at = [names.index(c) for c in ("step_2", "slope_2")]
        assert got[outcome, "event_2"].f == pytest.approx(beta[at] @ np.linalg.pinv(v[np.ix_(at, at)]) @ beta[at] / 2, rel=1e-3) and 0 <= got[outcome, "both_events"].p <= 1
