"""Yearly refits, what a project's own data identify, and coefficient sizes, against plain numpy."""

import numpy as np
import pandas as pd
import pytest

from ledgerloom import registry
from ledgerloom.plans.named import attack_panel
from ledgerloom.plans.protocols import adjusted, cells, identified

QUERIES, _ = registry.load()


@pytest.fixture(scope="module")
def panel(spark, sf_dir):
    return cells(spark, sf_dir).toPandas()


def newton(x, y, n):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.lstsq(x.T @ (x * (n * p * (1 - p))[:, None]), x.T @ (y - n * p), rcond=None)[0]
    return beta


def test_yearly_refits(spark, sf_dir, panel):
    got = {(r.year, r.project): r for r in QUERIES["x83_yearly_refits"](spark, sf_dir).collect()}
    assert got
    year = min(y for y, _ in got)
    part = panel[panel.year == year]
    part = part[part.groupby("project").attacked_trade_events.transform("sum") > 0]
    x = pd.get_dummies(part[["project", "trade_size_bin", "month"]], drop_first=True).astype(float)
    x.insert(0, "const", 1.0)
    beta = newton(x.to_numpy(), part.attacked_trade_events.to_numpy(float), part.candidate_trade_events.to_numpy(float))
    for project in sorted(part.project.unique())[:3]:
        z = x.copy()
        z[[c for c in z if c.startswith("project_")]] = 0.0
        if f"project_{project}" in z:
            z[f"project_{project}"] = 1.0
        p = 1 / (1 + np.exp(-z.to_numpy() @ beta))
        assert got[year, project].adjusted == pytest.approx(np.average(p, weights=part.candidate_trade_events), abs=1e-6)
    for r in QUERIES["x83_adjusted_stability"](spark, sf_dir).collect():
        a, b = ({p: x.adjusted for (y, p), x in got.items() if y == r.year + i} for i in (0, 1))
        common = sorted(set(a) & set(b))
        signs = [(np.sign(a[p] - a[q]), np.sign(b[p] - b[q])) for i, p in enumerate(common) for q in common[i + 1 :]]
        assert r.pairs == len(signs) and r.tau_b == pytest.approx(sum(s * t for s, t in signs) / (sum(s != 0 for s, _ in signs) * sum(t != 0 for _, t in signs)) ** 0.5, abs=0.02)


def test_unusable_models(panel):
    one = panel[panel.project == panel.project.iloc[0]].copy()
    assert adjusted(one).empty and identified(one[one.trade_size_bin == one.trade_size_bin.iloc[0]]).reason[0].startswith("fewer")
    one["attacked_trade_events"] = 0
    row = identified(one).iloc[0]
    assert row.reason == "no attacked events" and pd.isna(row.design_rank)
    two = pd.DataFrame({"year": 2000, "month": "2000-01-01", "project": ["a", "b"], "trade_size_bin": "x", "attacked_trade_events": [1, 2], "candidate_trade_events": [4, 4]})
    assert adjusted(two).empty  # as many terms as cells: every share is met


def test_within_protocol(spark, sf_dir, panel):
    rows = {r.project: r for r in QUERIES["x85_within_protocol"](spark, sf_dir).collect()}
    assert set(rows) == set(panel.project)
    for project, part in list(panel.groupby("project"))[:4]:
        r = rows[project]
        assert (r.months, r.size_bins, r.attacked, r.reportable) == (part.month.nunique(), part.trade_size_bin.nunique(), part.attacked_trade_events.sum(), False)
        if r.design_columns is not None:
            assert r.design_columns == r.months + r.size_bins - 1 and r.design_rank <= r.design_columns


def test_coefficient_sizes(spark, sf_dir):
    rows = QUERIES["x107_coefficient_sizes"](spark, sf_dir).collect()
    assert [r.size for r in rows] == sorted((abs(r.estimate) for r in rows), reverse=True) and all(r.exceeds == (r.size > 15) for r in rows)
    cells_ = attack_panel(spark, sf_dir).toPandas()
    kinds = pd.Series([r.kind for r in rows]).value_counts()
    assert kinds["trade_size"] == cells_.trade_size_bin.nunique() - 1 and kinds["protocol_version"] == (cells_.project + cells_.version).nunique() - 1
