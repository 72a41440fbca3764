"""The logits over the panel, with all their effects, against numpy on the full designs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom import registry
from ledgerloom.kernels.panel import Model, Panel
from ledgerloom.plans import panelmodels
from ledgerloom.plans.panelmodels import OK, Refits, Totals, compared, gated, leaving_out
from ledgerloom.plans.named import attack_panel

QUERIES, _ = registry.load()


@pytest.fixture(scope="module")
def cells(spark, sf_dir):
    rows = attack_panel(spark, sf_dir).toPandas()
    return rows.assign(cluster=rows.project + "::" + rows.version, month=rows.month.astype(str))


def design(cells, terms, against=None):
    names, columns = ["const"], [np.ones(len(cells))]
    for label, c in terms.items():
        levels = sorted(cells[c].unique())
        reference = (against or {}).get(label, levels[0])
        for v in levels:
            if v != reference:
                names.append(f"{label}[{v}]")
                columns.append((cells[c] == v).to_numpy(float))
    return names, np.stack(columns, 1), cells.attacked_trade_events.to_numpy(float), cells.candidate_trade_events.to_numpy(float)


def fitted(x, y, n):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        inverse = np.linalg.pinv(x.T @ (x * (n * p * (1 - p))[:, None]))
        beta = beta + inverse @ x.T @ (y - n * p)
    return beta, inverse, 1 / (1 + np.exp(-x @ beta))


def sandwich(inverse, scores, labels):
    sums = np.array([scores[labels == g].sum(0) for g in np.unique(labels)])
    g, (rows, k) = len(sums), scores.shape
    return inverse @ (sums.T @ sums * g / (g - 1) * (rows - 1) / (rows - k)) @ inverse


SIZE = {"bin": "trade_size_bin", "month": "month", "project": "cluster"}
PROTOCOL = {"project": "project", "bin": "trade_size_bin", "month": "month"}


def test_size_effects_under_two_way_clusters(spark, sf_dir, cells):
    names, x, y, n = design(cells, SIZE)
    beta, inverse, p = fitted(x, y, n)
    scores = x * (y - n * p)[:, None]
    version, month = cells.cluster.to_numpy(str), cells.month.to_numpy(str)
    of = [sandwich(inverse, scores, v) for v in (version, month, np.char.add(np.char.add(version, "|"), month))]
    two = of[0] + of[1] - of[2]
    got = {r.term: r for r in QUERIES["x67_two_way_clusters"](spark, sf_dir).collect()}
    bins = [i for i, name in enumerate(names) if name.startswith("bin[")]
    for i in bins:
        r = got[names[i][4:-1]]
        assert r.estimate == pytest.approx(beta[i], abs=1e-6) and r.se_version == pytest.approx(of[0][i, i] ** 0.5, rel=1e-6) and r.se_month == pytest.approx(of[1][i, i] ** 0.5, rel=1e-6)
        assert (r.se_two_way is None) == (two[i, i] < 0) and (r.se_two_way is None or r.se_two_way == pytest.approx(two[i, i] ** 0.5, rel=1e-5))
    joint = got["joint bins"]
    v = two[np.ix_(bins, bins)]
    assert joint.f == pytest.approx(beta[bins] @ np.linalg.pinv(v) @ beta[bins] / len(bins), rel=1e-4) and joint.restrictions == len(bins)
    assert (joint.version_clusters, joint.month_clusters) == (len(set(version)), len(set(month))) and joint.positive == (np.linalg.eigvalsh(two).min() >= -1e-8)


@pytest.fixture(scope="module")
def protocol(cells):
    attacked = cells.groupby("project").attacked_trade_events.transform("sum") > 0
    part = cells[attacked]
    sums = part.groupby("project").candidate_trade_events.sum()
    largest = min(sums.index, key=lambda p: (-sums[p], p))
    return part, largest, *design(part, PROTOCOL, {"project": largest})


def test_protocol_contrasts(spark, sf_dir, protocol):
    part, largest, names, x, y, n = protocol
    beta, inverse, p = fitted(x, y, n)
    v = sandwich(inverse, x * (y - n * p)[:, None], part.month.to_numpy(str))
    rows = QUERIES["x78_x79_protocol_logit"](spark, sf_dir).collect()
    got = {r.contrast: r for r in rows}
    projects = sorted(part.project.unique())
    assert len(got) == len(projects) * (len(projects) - 1) // 2 + 1 and {r.reference for r in rows} == {largest}
    for i, a in enumerate(projects):
        for b in projects[i + 1 :]:
            c = np.array([float(name == f"project[{a}]") - float(name == f"project[{b}]") for name in names])
            r = got[f"{a} - {b}"]
            assert r.estimate == pytest.approx(c @ beta, abs=1e-6) and r.se == pytest.approx((c @ v @ c) ** 0.5, rel=1e-5) and r.p - 1e-9 <= r.p_holm <= 1
            assert r.odds_ratio == pytest.approx(np.exp(r.estimate)) and r.low < r.odds_ratio < r.high and r.df == part.month.nunique() - 1
    at = [i for i, name in enumerate(names) if name.startswith("project[")]
    own = v[np.ix_(at, at)]
    if np.linalg.matrix_rank(own) == len(at):
        assert got["joint projects"].statistic == pytest.approx(beta[at] @ np.linalg.solve(own, beta[at]) / len(at), rel=1e-4)
    else:
        assert got["joint projects"].p is None


def test_covariance_audit(spark, sf_dir, protocol):
    part, _, names, x, y, n = protocol
    beta, inverse, p = fitted(x, y, n)
    scores = x * (y - n * p)[:, None]
    at = [i for i, name in enumerate(names) if name.startswith("project[")]
    got = {r.covariance: r for r in QUERIES["x67_x80_covariance_audit"](spark, sf_dir).collect()}
    free = len(x) - x.shape[1]
    pearson = ((y - n * p) ** 2 / (n * p * (1 - p))).sum() / free
    kinds = {"month clusters": sandwich(inverse, scores, part.month.to_numpy(str)), "by cell": inverse @ scores.T @ scores @ inverse, "scaled by dispersion": inverse * pearson}
    for name, v in kinds.items():
        own, r = v[np.ix_(at, at)], got[name]
        assert r.rank == np.linalg.matrix_rank(own) and r.least_eigenvalue == pytest.approx(np.linalg.eigvalsh(own).min(), rel=1e-3, abs=1e-9)
        if r.usable:
            assert r.f == pytest.approx(beta[at] @ np.linalg.solve(own, beta[at]) / len(at), rel=1e-4) and 0 <= r.p <= 1
    assert r.pearson_dispersion == pytest.approx(pearson, rel=1e-6) and r.design_columns == x.shape[1] and r.design_rank == np.linalg.matrix_rank(x) and r.design_condition == pytest.approx(np.linalg.cond(x), rel=1e-6)
    with np.errstate(divide="ignore", invalid="ignore"):
        deviance = 2 * np.nansum(np.where(y > 0, y * np.log(y / (n * p)), 0) + np.where(n > y, (n - y) * np.log((n - y) / (n * (1 - p))), 0))
    assert r.deviance_dispersion == pytest.approx(deviance / free, rel=1e-6)
    versions = part.groupby("project").cluster.nunique()
    assert (r.cells, r.protocols, r.version_clusters, r.protocols_with_one_version) == (len(part), len(versions), versions.sum(), (versions == 1).sum())


def test_standardised(spark, sf_dir, protocol):
    part, largest, names, x, y, n = protocol
    beta, _, _ = fitted(x, y, n)
    of = dict(zip(names, beta))
    mix = part.groupby(["month", "trade_size_bin"]).candidate_trade_events.sum()
    got = {r.project: r for r in QUERIES["x82_standardised"](spark, sf_dir).collect()}
    assert set(got) == set(part.project)
    for project in (largest, *sorted(got)[:4]):
        eta = np.array([of["const"] + of.get(f"project[{project}]", 0) + of.get(f"bin[{b}]", 0) + of.get(f"month[{m}]", 0) for m, b in mix.index])
        seen = set(map(tuple, part.loc[part.project == project, ["month", "trade_size_bin"]].to_numpy()))
        support = sum(w for key, w in mix.items() if key in seen) / mix.sum()
        assert got[project].standardised == pytest.approx((mix / (1 + np.exp(-eta))).sum() / mix.sum(), abs=1e-6)
        assert got[project].on_support == pytest.approx(support, abs=1e-7) and got[project].extrapolated == pytest.approx(1 - support, abs=1e-7)


def test_refits(spark, sf_dir, cells):
    names, x, y, n = design(cells, SIZE)
    whole = dict(zip(names, fitted(x, y, n)[0]))
    got = {r.left_out: r for r in QUERIES["x70_leave_one_out"](spark, sf_dir).collect()}
    assert set(got) == set(cells.project)
    moved = {}
    for project in sorted(got)[:3]:
        part = cells[cells.project != project]
        own_names, *own = design(part, SIZE)
        beta = dict(zip(own_names, fitted(*own)[0]))
        change = np.array([beta[b] - whole[b] for b in names if b.startswith("bin[")])
        moved[project] = beta
        r = got[project]
        assert r.status == OK and r.covariance_valid and (r.remaining_cells, r.remaining_clusters) == (len(part), part.cluster.nunique())
        assert r.largest_change == pytest.approx(np.abs(change).max(), abs=1e-6) and r.median_change == pytest.approx(np.median(np.abs(change)), abs=1e-6)
        assert r.least_ratio == pytest.approx(np.exp(change.min()), rel=1e-6) and r.largest_ratio == pytest.approx(np.exp(change.max()), rel=1e-6)
        assert r.candidate_share_pct == pytest.approx(100 * cells[cells.project == project].candidate_trade_events.sum() / cells.candidate_trade_events.sum())
    for r in QUERIES["x70_x72_leave_one_out"](spark, sf_dir).collect():
        assert r.odds_ratio == pytest.approx(np.exp(whole[r.term]), rel=1e-6) and all(r.least <= np.exp(b[r.term]) * (1 + 1e-6) and np.exp(b[r.term]) <= r.most * (1 + 1e-6) for b in moved.values())
    clean = cells[cells.groupby("cluster").attacked_trade_events.transform("sum") > 0]
    own_names, *own = design(clean, SIZE)
    beta = dict(zip(own_names, fitted(*own)[0]))
    for r in QUERIES["x71_zero_outcome_excluded"](spark, sf_dir).collect():
        assert r.change == pytest.approx(beta[f"bin[{r.bin}]"] - whole[f"bin[{r.bin}]"], abs=1e-6) and r.ratio == pytest.approx(np.exp(r.change))
    gate = QUERIES["x72_stability_gate"](spark, sf_dir).collect()
    assert [r.significant for r in gate] == [r.p_holm < 0.05 if r.inferential_status == "formal" else None for r in gate]
    assert QUERIES["x106_dominant_fragile"](spark, sf_dir).count() == sum(r.candidate_share_pct >= 20 and r.largest_ratio / r.least_ratio >= 1.2 for r in got.values())


def test_gate_and_screen(spark):
    """A size effect that turns, one that drifts and one that stays, and a project without which no model is left."""
    from ledgerloom.kernels.linear import Fit
    from ledgerloom.kernels.panel import Logit

    names = ["const", "bin[a]", "bin[b]", "bin[c]"]
    whole = Fit(names, np.array([0, 0.1, 1.0, 2.0]), np.eye(4) * 0.01, 100, 20)
    clean = Fit(names, np.array([0, -0.1, 1.5, 2.1]), np.eye(4), 90, 18)
    bad = np.eye(4)
    bad[2, 2] = -1
    totals = Totals({"p": (60.0, 6.0), "q": (40.0, 4.0), "r": (100.0, 1.0)}, {"p::1": (60.0, 0.0)}, {("p::1", "a"): (1.0, 1.0)})
    of = Refits(whole, Logit(names, whole.beta, whole.covariance, 100), 0, totals, {"p": Fit(names, whole.beta + 0.3, bad, 80, 10), "q": Fit(names, np.array([0, 0.1, 1.4, 2.0]), np.eye(4), 80, 10)}, clean)
    rows = {r[0]: r for r in leaving_out(of)}
    assert rows["p"][8:] == (False, panelmodels.COEFFICIENTS_ONLY) and rows["r"][8:] == (False, panelmodels.NOT_ESTIMABLE) and rows["q"][7] == pytest.approx(np.exp(0.4))
    gate = {r[0]: r for r in gated(spark, of)}
    assert [gate[b][9] for b in "abc"] == ["unstable_sensitivity_drift"] * 2 + ["stable"] and [gate[b][11] for b in "abc"] == [None, None, True]
    assert gate["a"][8] == "flags_present" and len(compared(of)) == 3


def test_panels_that_are_awkward(spark):
    """Nulls go, an empty panel has no terms, separated cells are cut, and a start from elsewhere ends at the same place."""
    rows = [("a", "x", 3, 10), ("a", "y", 4, 10), ("b", "x", 5, 10), ("b", "y", 9, 10), ("c", "x", 0, 10), ("c", "y", 0, 10), (None, "x", 1, 2)]
    df = spark.createDataFrame(rows, "g string, h string, s long, t long")
    model = Model({"g": "g", "h": "h"})
    panel = Panel(df, ["g", "h"], "s", "t")
    fit = panel.fit([model])[0]
    assert fit.rows == 6 and fit.names == ["const", "g[b]", "g[c]", "h[y]"] and fit.beta[2] < -15
    kept = Model({"g": "g", "h": "h"}, {"g": "b"}, (("g", "c"), ("g", "unknown")))
    frame = pd.DataFrame(rows[:4], columns=["g", "h", "attacked_trade_events", "candidate_trade_events"])
    names, x, y, n = design(frame, {"g": "g", "h": "h"}, {"g": "b"})
    beta, inverse, _ = fitted(x, y, n)
    for start in (None, np.array([1.0, 0, -1, 0, 0, 2])):
        own = panel.fit([kept], start=start)[0]
        assert own.names == names and own.converged and own.beta == pytest.approx(beta, abs=1e-7) and own.inverse == pytest.approx(inverse, rel=1e-5)
    empty = Panel(df.where(F.lit(False)), ["g", "h"], "s", "t")
    none = empty.fit([model])[0]
    assert none.rows == 0 and none.names == ["const"] and empty.meats([model], [none], {"g": ["g"]})[0]["g"][1] == 0
