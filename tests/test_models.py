"""Regression and resampling against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import registry
from ledgerloom.kernels.linear import grouped_logit, ols, poisson, wald
from ledgerloom.kernels.tails import chi_square_tail, f_tail, normal_two_sided, t_quantile, t_two_sided

QUERIES, _ = registry.load()


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 2))
    group = rng.integers(0, 9, 120)
    y = 1 + x @ [0.5, -2] + rng.normal(size=120) * (1 + np.abs(x[:, 0])) + group * 0.1
    counts, trials = rng.poisson(np.exp(0.3 + 0.4 * x[:, 0])), rng.integers(1, 30, 120)
    hits = rng.binomial(trials, 1 / (1 + np.exp(-(-0.5 + 0.8 * x[:, 0]))))
    rows = [(i, *map(float, (*x[i], y[i])), int(group[i]), int(counts[i]), int(trials[i]), int(hits[i])) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, a double, b double, y double, g int, c int, n int, h int").repartition(5).cache()
    return df, np.column_stack([np.ones(120), x]), y, group, counts, trials, hits


def columns():
    return {"const": F.lit(1.0), "a": F.col("a"), "b": F.col("b")}


def test_ols(data):
    df, x, y, group, *_ = data
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    e, h = y - x @ beta, np.einsum("ij,jk,ik->i", x, inverse, x)
    fit = ols(df, F.col("y"), columns(), "hc3")
    assert np.allclose(fit.beta, beta)
    assert np.allclose(fit.covariance, inverse @ (x.T * (e / (1 - h)) ** 2) @ x @ inverse)
    assert np.allclose(ols(df, F.col("y"), columns(), "plain").covariance, inverse * (e @ e) / 117)
    scores = np.array([(x * e[:, None])[group == g].sum(0) for g in range(9)])
    clustered = ols(df, F.col("y"), columns(), "cluster", cluster="g")
    assert np.allclose(clustered.covariance, inverse @ scores.T @ scores @ inverse * 9 / 8 * 119 / 117)
    s = x * e[:, None]
    meat = s.T @ s
    for lag in range(1, 4):
        meat += (1 - lag / 4) * (s[lag:].T @ s[:-lag] + s[:-lag].T @ s[lag:])
    assert np.allclose(ols(df, F.col("y"), columns(), "hac", order="i", lags=3).covariance, inverse @ meat @ inverse)
    statistic, q = wald(fit, np.array([[0, 1, 0], [0, 0, 1.0]]))
    assert q == 2 and statistic == pytest.approx(beta[1:] @ np.linalg.inv(fit.covariance[1:, 1:]) @ beta[1:] / 2)


def test_likelihoods(data):
    df, x, _, group, counts, trials, hits = data
    fit = poisson(df, "c", columns())
    assert fit.converged and np.allclose(x.T @ (counts - np.exp(x @ fit.beta)), 0, atol=1e-5)
    fit = grouped_logit(df, "h", "n", columns(), "g")
    p = 1 / (1 + np.exp(-(x @ fit.beta)))
    assert fit.converged and fit.clusters == 9 and np.allclose(x.T @ (hits - trials * p), 0, atol=1e-5)
    inverse = np.linalg.inv((x.T * (trials * p * (1 - p))) @ x)
    scores = np.array([(x * (hits - trials * p)[:, None])[group == g].sum(0) for g in range(9)])
    assert np.allclose(fit.covariance, inverse @ scores.T @ scores @ inverse * 9 / 8 * 119 / 117)


def test_dependent_columns_are_refused(data):
    with pytest.raises(ValueError, match="depend"):
        ols(data[0], F.col("y"), {**columns(), "twice": F.col("a") * 2})


def test_tails(spark):
    assert t_two_sided(spark, 2.228138851964939, 10) == pytest.approx(0.05)
    assert normal_two_sided(spark, 1.959963984540054) == pytest.approx(0.05)
    assert chi_square_tail(spark, 3.841458820694124, 1) == pytest.approx(0.05)
    assert t_quantile(spark, 0.975, 10) == pytest.approx(2.228138851964939)
    assert 0 < f_tail(spark, 1e5, 10, 100) < 1e-100


@pytest.mark.parametrize("name", ["x10_x11_bootstrap", "x12_subsamples", "x18_permutation_spearman", "x37_sup_f_bootstrap", "x89_x91_tail_bootstrap"])
def test_draws_repeat(spark, sf_dir, name):
    first, again = (sorted(map(str, QUERIES[name](spark, sf_dir).collect())) for _ in range(2))
    assert first == again and first


def test_bootstrap_surrounds_the_estimate(spark, sf_dir):
    got = {r.measure: r for r in QUERIES["x10_x11_bootstrap"](spark, sf_dir).where("window = 'all'").collect()}
    assert got["gini"].low <= QUERIES["x01_gini"](spark, sf_dir).first().gini <= got["gini"].high + 0.05
    assert got["cr1"].low <= QUERIES["x04_x05_top_shares"](spark, sf_dir).first().cr1 * 1.5


@pytest.mark.parametrize("name", ["x21_longevity_hc3", "x32_x33_interrupted_series", "x48_poisson_series", "x64_x69_attack_logit"])
def test_fits_run(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert rows and all(r.se is None or r.se >= 0 for r in rows) and all(r.p is None or 0 <= r.p <= 1 for r in rows)
