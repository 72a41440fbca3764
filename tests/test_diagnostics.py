"""Residual tests, detectable effects, the map of families, cohort effects and Pareto quantiles against plain numpy."""

import numpy as np
import pandas as pd
import pytest

from ledgerloom import registry
from ledgerloom.plans import diagnostics, resampling
from ledgerloom.plans.diagnostics import CHECKS, FAMILIES, detectable, split_expressions
from ledgerloom.plans.interrupted import OUTCOMES, days, design
from ledgerloom.plans.relational import bots

QUERIES, _ = registry.load()


def test_residuals(spark, sf_dir):
    got = {(r.outcome, r.lag): r for r in QUERIES["x42_residual_diagnostics"](spark, sf_dir).collect()}
    frame = days(spark, sf_dir).toPandas().sort_values("t")
    summary = {r.outcome: r for r in QUERIES["x43_residual_summary"](spark, sf_dir).collect()}
    for outcome in OUTCOMES:
        own = frame[frame[outcome] > 0]
        x, y = design(own, "main")[1], np.log(own[outcome].to_numpy(float))
        e = pd.Series(y - x @ np.linalg.lstsq(x, y, rcond=None)[0])
        n, c = len(e), e - e.mean()
        for lag in (1, 7, 14, 28):
            r = got[outcome, lag]
            box = n * (n + 2) * sum(((c.to_numpy()[k:] * c.to_numpy()[:-k]).sum() / (c**2).sum()) ** 2 / (n - k) for k in range(1, lag + 1))
            assert r.days == n and r.acf == pytest.approx(e.autocorr(lag), abs=1e-9) and r.ljung_box == pytest.approx(box, rel=1e-9)
        p = np.exp(-got[outcome, 7].ljung_box / 2)  # of an even number of degrees a sum; here only the order
        assert 0 <= got[outcome, 7].p <= 1 and p <= 1
        rows = [got[outcome, k] for k in (1, 7, 14, 28)]
        s = summary[outcome]
        assert s.largest_acf == max(abs(r.acf) for r in rows) and s.least_p == min(r.p for r in rows) and s.acf_flag == (s.largest_acf >= 0.2) and s.ljung_box_flag == (s.least_p < 0.01)
        assert s.status == ["no_large_signal_at_reported_lags", "residual_dependence_signal", "strong_residual_dependence_signal"][s.acf_flag + s.ljung_box_flag]


def test_detectable_effects(spark):
    rows = spark.createDataFrame([("a", "x", 10, 0.5), ("a", "y", 10, 0.1), ("b", "z", 1_000_000, 1.0), ("b", "none", 5, None)], "source string, term string, df long, se double")
    got = {r.term: r for r in detectable(spark, rows).collect()}
    assert set(got) == {"x", "y", "z"}
    assert got["z"].detectable == pytest.approx(1.959964 + 0.841621, abs=1e-4) and got["z"].corrected == pytest.approx(2.241403 + 0.841621, abs=1e-4)
    assert got["x"].detectable == pytest.approx(0.5 * (2.228139 + 0.879058), abs=1e-5) and got["y"].corrected == pytest.approx(0.1 * (2.633767 + 0.879058), abs=1e-5)
    assert got["x"].detectable_percent == pytest.approx(100 * np.expm1(got["x"].detectable)) and got["x"].family_size == 2 and got["x"].corrected_level == 0.025


def test_detectable_effects_of_the_models(spark, sf_dir):
    rows = QUERIES["x87_detectable_t"](spark, sf_dir).toPandas()
    assert set(rows.source) == {"interrupted series", "size bins", "projects"} and (rows.corrected >= rows.detectable).all()
    assert (rows.groupby("source").family_size.nunique() == 1).all() and (rows[rows.source == "interrupted series"].family_size == 15).all()


def test_map_of_families(spark, sf_dir):
    rows = {r.query: r for r in QUERIES["x88_multiplicity_map"](spark, sf_dir).collect()}
    assert set(rows) == set(FAMILIES)
    assert rows["x47_interrupted_robustness"].family_size == 6 and rows["x49_slope_tests"].family_size == 9 and rows["x10_x11_bootstrap"].significant is None
    bins = QUERIES["x72_stability_gate"](spark, sf_dir).collect()
    assert rows["x72_stability_gate"].family_size == len(bins) and rows["x72_stability_gate"].significant == sum(r.p_holm < 0.05 for r in bins)


def test_cohort_effects(spark, sf_dir):
    frame = bots(spark, sf_dir).toPandas()
    frame = frame[frame.volume > 0]
    cohorts = sorted(frame.cohort.unique())
    x = np.column_stack([np.ones(len(frame)), np.log(frame.days), np.log(frame.legs / frame.days), *[(frame.cohort == c) for c in cohorts[1:]]]).astype(float)
    y = np.log(frame.volume.to_numpy())
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    e = (y - x @ beta) / (1 - np.einsum("ij,jk,ik->i", x, inverse, x))
    got = QUERIES["x21_cohort_effects"](spark, sf_dir).collect()
    assert [r.term for r in got] == ["const", "log_days", "log_intensity", *[f"cohort[{c}]" for c in cohorts[1:]]]
    se = np.sqrt(np.diag(inverse @ (x * (e**2)[:, None]).T @ x @ inverse))
    for r, b, s in zip(got, beta, se):
        assert r.estimate == pytest.approx(b, abs=1e-7)
        if np.isfinite(s):
            assert r.se == pytest.approx(s, rel=1e-5)


def test_pareto_quantiles(spark, sf_dir):
    fits = {(r.window, r.share): r for r in QUERIES["x89_pareto_fit"](spark, sf_dir).collect()}
    rows = QUERIES["x92_pareto_quantiles"](spark, sf_dir).toPandas()
    for (window, share), own in rows.groupby(["window", "share"]):
        f, own = fits[window, share], own.sort_values("i")
        assert own.i.tolist() == list(range(1, f.k + 1)) and own.excess.is_monotonic_increasing and own.model_quantile.is_monotonic_increasing
        p = (own.i - 0.5) / f.k
        assert np.allclose(own.model_quantile, f.scale * ((1 - p) ** -f.shape - 1) / f.shape, rtol=1e-3, atol=1e-2)


def test_checks_are_read_right():
    assert split_expressions("a AS b, f(c, (d, e)) AS g ,h") == ["a AS b", "f(c, (d, e)) AS g", "h"] and len(CHECKS) == 33


def test_map_resamples_only_its_windows(spark, sf_dir, monkeypatch):
    """Intervals over all days belong to no family."""
    asked, own = [], resampling.ranked_windows
    monkeypatch.setattr(diagnostics, "FAMILIES", {k: v for k, v in diagnostics.FAMILIES.items() if k == "x10_x11_bootstrap"})
    monkeypatch.setattr(resampling, "ranked_windows", lambda spark, sf_dir, windows: (asked.append(list(windows)), own(spark, sf_dir, windows))[1])
    assert QUERIES["x88_multiplicity_map"](spark, sf_dir).first().family_size == 14 and asked == [["primary", "longer"]]
