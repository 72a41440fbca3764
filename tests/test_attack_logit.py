"""The attack model with all its effects, against numpy."""

import numpy as np
import pytest

from ledgerloom import registry
from ledgerloom.plans.named import attack_panel

QUERIES, _ = registry.load()


def test_month_and_version_effects(spark, sf_dir):
    got = {r.term: r for r in QUERIES["x64_x69_attack_logit"](spark, sf_dir).collect()}
    cells = attack_panel(spark, sf_dir).toPandas()
    cells["cluster"] = cells.project + "::" + cells.version
    names, columns = ["const"], [np.ones(len(cells))]
    for name, c in (("bin", "trade_size_bin"), ("month", "month"), ("project", "cluster")):
        for v in sorted(cells[c].unique())[1:]:
            names.append(f"{name}[{v}]")
            columns.append((cells[c] == v).to_numpy(float))
    assert set(got) == {*names, "joint bins"}
    x, y, n = np.stack(columns, 1), cells.attacked_trade_events.to_numpy(float), cells.candidate_trade_events.to_numpy(float)
    beta = np.zeros(len(names))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        inverse = np.linalg.pinv(x.T @ (x * (n * p * (1 - p))[:, None]))
        beta = beta + inverse @ x.T @ (y - n * p)
    scores = np.array([(x * (y - n * p)[:, None])[(cells.cluster == g).to_numpy()].sum(0) for g in cells.cluster.unique()])
    groups, rows, k = len(scores), *x.shape
    covariance = inverse @ scores.T @ scores @ inverse * groups / (groups - 1) * (rows - 1) / (rows - k)
    bins = [i for i, name in enumerate(names) if name.startswith("bin[")]
    for i in bins:
        r = got[names[i]]
        assert r.estimate == pytest.approx(beta[i], abs=1e-6) and r.se == pytest.approx(covariance[i, i] ** 0.5, rel=1e-4) and r.clusters == groups
        assert r.odds_ratio_low < r.odds_ratio < r.odds_ratio_high and r.p - 1e-9 <= r.p_holm <= 1
    assert np.log(got[names[bins[0]]].odds_ratio_high / got[names[bins[0]]].odds_ratio_low) / got[names[bins[0]]].se == pytest.approx(2 * 1.976, abs=0.03)
    flags = got["const"].stability_flags.split(";")
    by = cells.groupby(["cluster", "trade_size_bin"])[["attacked_trade_events", "candidate_trade_events"]].sum()
    assert ("all_zero_protocol_size_patterns_present" in flags) == bool((by.attacked_trade_events == 0).any())
    assert "high_raw_design_condition_number_screen" not in flags and np.linalg.cond(x) < 1e10
