"""Logits of attacks over the panel of months, projects with versions and size bins, with all their effects, and how far they hold.

The size model has effects of size, month and project with version and clusters by the last; the protocol model has projects that were ever attacked, the largest
as the reference, size and month, and clusters by month. Both are fitted on coded cells (kernels/panel.py); refits without a project run through the same passes.
The smallest size bin is what others are measured against. Tests sit beside the models: against numpy on the full designs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.linear import Fit, wald
from ..kernels.panel import Logit, Model, Panel
from ..kernels.tails import chi_square_tail, f_tail, t_quantile, t_two_sided, with_holm
from ..registry import register
from .incidence import ATTACKED, CANDIDATES, holm
from .named import attack_panel

#: Fixed values of the reference: bounds of a coefficient, an error and the condition number; drift of an odds ratio that a contrast survives; share of candidates and spread of odds ratios from which a project is named.
LARGE_BETA, LARGE_SE, LARGE_CONDITION = 15, 10, 1e10
DRIFT, DOMINANT, FRAGILE = 0.25, 20.0, 1.2
SIZE_TERMS = {"bin": "trade_size_bin", "month": "month", "project": "cluster"}
PROTOCOL_TERMS = {"project": "project", "bin": "trade_size_bin", "month": "month"}
OK, COEFFICIENTS_ONLY, NOT_ESTIMABLE = "ok", "coefficients only: covariance invalid", "not estimable"


@dataclass(frozen=True)
class Totals:
    """Candidates and attacks by project, by project and version, and by that and size."""

    projects: dict[str, tuple[float, float]]
    versions: dict[str, tuple[float, float]]
    patterns: dict[tuple[str, str], tuple[float, float]]


def cells_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attack_panel(spark, sf_dir).select("month", "project", F.concat_ws("::", "project", "version").alias("cluster"), "trade_size_bin", ATTACKED, CANDIDATES)
    return rows.where(F.col(CANDIDATES) > 0)


def opened(spark: SparkSession, sf_dir: str) -> tuple[Panel, Totals, DataFrame]:
    """The coded panel, its totals (of the design's size), and its cells, kept while they are used."""
    cells = cells_of(spark, sf_dir).cache()
    panel = Panel(cells, ["project", "cluster", "trade_size_bin", "month"], ATTACKED, CANDIDATES)
    sums = cells.groupBy("project", "cluster", "trade_size_bin").agg(F.sum(CANDIDATES).alias("n"), F.sum(ATTACKED).alias("a")).collect()
    found: tuple[dict, dict, dict] = ({}, {}, {})
    for r in sums:
        for own, key in zip(found, (r["project"], r["cluster"], (r["cluster"], r["trade_size_bin"]))):
            n, a = own.get(key, (0.0, 0.0))
            own[key] = n + r["n"], a + r["a"]
    return panel, Totals(*found), cells


def size_model(*without: tuple[str, str]) -> Model:
    return Model(SIZE_TERMS, {}, without)


def protocol_model(totals: Totals) -> Model:
    """Projects that were attacked, measured against the one with most candidates (ties: the first by name)."""
    attacked = [p for p, (_, a) in totals.projects.items() if a > 0]
    largest = {"project": min(attacked, key=lambda p: (-totals.projects[p][0], p))} if attacked else {}
    return Model(PROTOCOL_TERMS, largest, tuple(("project", p) for p in totals.projects if p not in attacked))


def bins_of(fit: Fit) -> dict[str, int]:
    """Place of each size bin's coefficient."""
    return {n[4:-1]: i for i, n in enumerate(fit.names) if n.startswith("bin[")}


def variance_fails(covariance: np.ndarray) -> bool:
    """A materially negative or infinite variance."""
    own = np.diag(covariance)
    return not np.isfinite(covariance).all() or bool((own < -1e-12 * max(1.0, np.abs(own).max(initial=0))).any())


def flags(fit: Fit, logit: Logit, boundary: float, totals: Totals) -> str:
    """What makes the size model's estimates doubtful, as names joined by semicolons, or none."""
    none, every = (lambda of, f=f: any(f(n, a) for n, a in of.values()) for f in (lambda n, a: a == 0, lambda n, a: a == n))
    found = {
        "very_large_coefficient": np.abs(fit.beta).max(initial=0) > LARGE_BETA,
        "very_large_standard_error": fit.se().max(initial=0) > LARGE_SE,
        "near_boundary_fitted_probabilities": boundary > 0,
        "all_zero_outcome_protocol_clusters_present": none(totals.versions),
        "all_one_outcome_protocol_clusters_present": every(totals.versions),
        "all_zero_protocol_size_patterns_present": none(totals.patterns),
        "all_one_protocol_size_patterns_present": every(totals.patterns),
        "high_raw_design_condition_number_screen": logit.condition > LARGE_CONDITION,
    }
    return ";".join(name for name, holds in found.items() if holds) or "none"


def table(spark: SparkSession, fit: Fit, tail: Callable[[float], float]) -> DataFrame:
    rows = []
    for name, b, s in zip(fit.names, fit.beta.tolist(), fit.se().tolist()):
        rows.append(("logit", name, b, s, b / s if s > 0 else None, tail(b / s) if s > 0 else None, fit.rows, fit.clusters, fit.converged))
    return spark.createDataFrame(rows, "model string, term string, estimate double, se double, statistic double, p double, rows long, clusters long, converged boolean")


@register()
def x64_x69_attack_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped-binomial logit of attacks on size bin, month and project with version, clustered by project and version: t-tests, and for the bins
    odds ratios with 95 percent intervals against the smallest, Holm's correction and the joint test; every row has the fit's stability
    flags. Effects whose level never occurs are left out."""
    panel, totals, cells = opened(spark, sf_dir)
    model = size_model()
    logit = panel.fit([model])[0]
    fit = logit.clustered(*panel.meats([model], [logit], {"version": ["cluster"]})[0]["version"])
    boundary = panel.sums([model], [logit.wide], None)[0].boundary
    cells.unpersist()
    free = fit.clusters - 1
    rows = table(spark, fit, lambda t: t_two_sided(spark, t, free))
    c = np.eye(len(fit.names))[list(bins_of(fit).values())]
    f, q = wald(fit, c)
    joint = spark.createDataFrame([("logit", "joint bins", None, None, f, f_tail(spark, f, q, free), fit.rows, fit.clusters, fit.converged)], rows.schema)
    whole, is_bin, reach = rows.unionAll(joint), F.col("term").startswith("bin["), t_quantile(spark, 0.975, free) * F.col("se")
    corrected = holm(rows.where(is_bin), "p", "term").select("term", "p_holm")
    ratios = {"odds_ratio": F.col("estimate"), "odds_ratio_low": F.col("estimate") - reach, "odds_ratio_high": F.col("estimate") + reach}
    return whole.withColumns({n: F.when(is_bin, F.exp(e)) for n, e in ratios.items()}).join(corrected, "term", "left").withColumn("stability_flags", F.lit(flags(fit, logit, boundary, totals)))


@register()
def x107_coefficient_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every coefficient of the logit on size, month and project with version, with its kind, by falling size; those beyond the bound are marked."""
    panel, _, cells = opened(spark, sf_dir)
    fit = panel.fit([size_model()])[0]
    cells.unpersist()
    term, size = F.col("coefficient"), F.abs("estimate")
    kinds = F.when(term.startswith("bin["), "trade_size").when(term.startswith("project["), "protocol_version").when(term.startswith("month["), "month").otherwise("intercept_or_other")
    rows = spark.createDataFrame(list(zip(fit.names, fit.beta.tolist())), "coefficient string, estimate double")
    return rows.select(term, kinds.alias("kind"), "estimate", size.alias("size"), (size > LARGE_BETA).alias("exceeds")).orderBy(F.desc("size"), "coefficient")


@register()
def x67_two_way_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size effects of the size model under clusters by project with version, by month, and by both (the sum of the two less their intersection, each with its own CR1
    factor): errors, null where a variance is negative, whether the covariance is positive, and the joint statistic, which has no p here."""
    panel, _, cells = opened(spark, sf_dir)
    model = size_model()
    logit = panel.fit([model])[0]
    meats = panel.meats([model], [logit], {"version": ["cluster"], "month": ["month"], "intersection": ["cluster", "month"]})[0]
    cells.unpersist()
    of = {k: logit.sandwich(*v) for k, v in meats.items()}
    two = of["version"] + of["month"] - of["intersection"]
    two = (two + two.T) / 2
    positive = bool(np.linalg.eigvalsh(two).min(initial=0) >= -1e-8)
    fit = Fit(logit.names, logit.beta, two, logit.rows, 0, logit.converged)
    at = bins_of(fit)
    f, q = wald(fit, np.eye(len(fit.names))[list(at.values())])
    error = lambda v, i: float(np.sqrt(v[i, i])) if v[i, i] >= 0 else None
    rows = [(b, float(fit.beta[i]), error(of["version"], i), error(of["month"], i), error(two, i), positive, None, q, *[meats[k][1] for k in ("version", "month", "intersection")], logit.converged) for b, i in at.items()]
    rows.append(("joint bins", None, None, None, None, positive, f, q, *[meats[k][1] for k in ("version", "month", "intersection")], logit.converged))
    return spark.createDataFrame(rows, "term string, estimate double, se_version double, se_month double, se_two_way double, positive boolean, f double, restrictions int, version_clusters long, month_clusters long, both_clusters long, converged boolean")


@register()
def x78_x79_protocol_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The protocol model: contrasts of all pairs of attacked projects, a less b, with odds ratios, 95 percent intervals, t-tests and Holm's correction,
    and the joint test, whose p is null where the covariance of the projects' effects has no full rank."""
    panel, totals, cells = opened(spark, sf_dir)
    model = protocol_model(totals)
    logit = panel.fit([model])[0]
    fit = logit.clustered(*panel.meats([model], [logit], {"month": ["month"]})[0]["month"])
    cells.unpersist()
    at = {n[8:-1]: i for i, n in enumerate(fit.names) if n.startswith("project[")}
    free, reference = fit.clusters - 1, model.against.get("project")
    names, unit, rows = sorted([*at, *([reference] if reference else [])]), np.eye(len(fit.names)), []
    reach = t_quantile(spark, 0.975, free) if free > 0 else float("nan")
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            c = (unit[at[a]] if a in at else 0) - (unit[at[b]] if b in at else 0)
            value, variance = float(c @ fit.beta), float(c @ fit.covariance @ c)
            se = variance**0.5 if variance > 0 else None
            rows.append([f"{a} - {b}", value, se, float(np.exp(value)), *([float(np.exp(value + s * reach * se)) for s in (-1, 1)] if se else [None, None]), value / se if se else None, t_two_sided(spark, value / se, free) if se else None])
    with_holm(rows, 7)
    places = list(at.values())
    v = fit.covariance[np.ix_(places, places)]
    rank = int(np.linalg.matrix_rank(v)) if places else 0
    usable = 0 < rank == len(places)
    f = float(fit.beta[places] @ np.linalg.solve(v, fit.beta[places])) / len(places) if usable else None
    out = [(*r, free, None, fit.converged) for r in rows]
    out.append(("joint projects", None, None, None, None, None, f, f_tail(spark, f, len(places), free) if usable else None, None, free, rank, fit.converged))
    return spark.createDataFrame(out, "contrast string, estimate double, se double, odds_ratio double, low double, high double, statistic double, p double, p_holm double, df long, covariance_rank int, converged boolean").withColumn("reference", F.lit(reference))


@register()
def x67_x80_covariance_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The protocol model's joint test under month clusters (CR1), by cell (HC0) and scaled by Pearson's dispersion, each with the rank and least eigenvalue of the
    covariance of the projects' effects and null where that isn't positive; beside them the design's size, rank and condition number, numbers of clusters, and dispersions."""
    panel, totals, cells = opened(spark, sf_dir)
    model = protocol_model(totals)
    logit = panel.fit([model])[0]
    month, groups = panel.meats([model], [logit], {"month": ["month"]})[0]["month"]
    squares = panel.sums([model], [logit.wide], "squares")[0]
    cells.unpersist()
    k, attacked = len(logit.names), [p for p, (_, a) in totals.projects.items() if a > 0]
    versions = [sum(v.startswith(f"{p}::") for v in totals.versions) for p in attacked]
    free = logit.rows - k
    pearson = float(squares.pearson / free) if free > 0 else None
    places = [i for i, n in enumerate(logit.names) if n.startswith("project[")]
    kinds = {"month clusters": (logit.sandwich(month, groups), groups - 1), "by cell": (logit.sandwich(squares.square), None)} | ({"scaled by dispersion": (logit.inverse * pearson, free)} if pearson is not None else {})
    out = []
    for name, (v, df) in kinds.items():
        own = v[np.ix_(places, places)]
        rank, least = int(np.linalg.matrix_rank(own)) if places else 0, float(np.linalg.eigvalsh((own + own.T) / 2).min()) if places else None
        f = p = None
        if places and rank == len(places) and least > 0:
            f = float(logit.beta[places] @ np.linalg.solve(own, logit.beta[places])) / len(places)
            p = chi_square_tail(spark, f * len(places), len(places)) if df is None else f_tail(spark, f, len(places), df)
        out.append((name, len(places), rank, least, f, df, p, f is not None))
    about = {
        "cells": F.lit(logit.rows), "protocols": F.lit(len(attacked)), "version_clusters": F.lit(sum(versions)), "month_clusters": F.lit(groups), "protocols_with_one_version": F.lit(sum(v == 1 for v in versions)),
        "design_columns": F.lit(k), "design_rank": F.lit(logit.rank), "design_condition": F.lit(logit.condition), "pearson_dispersion": F.lit(pearson).cast("double"),
        "deviance_dispersion": F.lit(float(squares.deviance / free) if free > 0 else None).cast("double"), "converged": F.lit(logit.converged),
    }
    return spark.createDataFrame(out, "covariance string, restrictions int, rank int, least_eigenvalue double, f double, df long, p double, usable boolean").withColumns(about)


@register()
def x82_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attacked project's fitted probability over the months and sizes of all candidates of such projects, beside its crude rate, with the share of that mix
    on months and sizes in which the project was seen, and the share on others."""
    panel, totals, cells = opened(spark, sf_dir)
    model = protocol_model(totals)
    fit = panel.fit([model])[0]
    beta = dict(zip(fit.names, fit.beta.tolist()))
    effects = spark.createDataFrame([(*n[:-1].split("[", 1), b) for n, b in beta.items() if n != "const"] + [("project", model.against["project"], 0.0)] if model.against else [], "label string, level string, effect double")
    of = lambda label, column: F.broadcast(effects.where(F.col("label") == label).select(F.col("level").alias(column), F.col("effect").alias(f"{label}_effect")))
    rows = cells.withColumn("month", F.col("month").cast("string")).join(of("project", "project"), "project")
    seen = rows.groupBy("project", "month", "trade_size_bin").agg(F.sum(CANDIDATES).alias("n"), F.sum(ATTACKED).alias("a"))
    mix = seen.groupBy("month", "trade_size_bin").agg(F.sum("n").alias("w")).join(of("month", "month"), "month", "left").join(of("bin", "trade_size_bin"), "trade_size_bin", "left")
    mix = mix.select("month", "trade_size_bin", "w", (F.lit(beta.get("const", 0.0)) + F.coalesce("month_effect", F.lit(0.0)) + F.coalesce("bin_effect", F.lit(0.0))).alias("base"))
    # One row for each project beside each month and size: of the design's size.
    asked = mix.crossJoin(of("project", "project")).join(seen, ["project", "month", "trade_size_bin"], "left")
    p, own = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), F.col("base") + F.col("project_effect"))))), F.col("n").isNotNull()
    out = asked.groupBy("project").agg(
        F.round(F.sum(F.col("w") * p) / F.sum("w"), 8).alias("standardised"), F.round(F.sum("a") / F.sum("n"), 8).alias("crude"), F.round(F.sum(F.when(own, F.col("w")).otherwise(0)) / F.sum("w"), 8).alias("on_support"),
    )
    return out.select("project", "standardised", "crude", F.round(F.col("standardised") - F.col("crude"), 8).alias("difference"), "on_support", F.round(1 - F.col("on_support"), 8).alias("extrapolated"), F.lit(fit.converged).alias("converged"))


@dataclass(frozen=True)
class Refits:
    """The size model, the fits without each project, and the one without versions that were never attacked."""

    whole: Fit
    logit: Logit
    boundary: float
    totals: Totals
    without: dict[str, Fit]
    clean: Fit


def refits(spark: SparkSession, sf_dir: str) -> Refits:
    """All of them by the same passes: a step's sums are told apart by model, not by job."""
    panel, totals, cells = opened(spark, sf_dir)
    projects = sorted(totals.projects)
    models = [size_model(), size_model(*[("cluster", v) for v, (_, a) in totals.versions.items() if a == 0]), *[size_model(("project", p)) for p in projects]]
    first = panel.fit(models[:1])
    logits = first + panel.fit(models[1:], start=first[0].wide)
    meats = panel.meats(models, logits, {"version": ["cluster"]})
    fits = [x.clustered(*m["version"]) for x, m in zip(logits, meats)]
    boundary = panel.sums(models[:1], [logits[0].wide], None)[0].boundary
    cells.unpersist()
    estimable = lambda x: x.converged and x.rank == len(x.names) and np.isfinite(x.beta).all()
    return Refits(fits[0], logits[0], boundary, totals, {p: f for p, f, x in zip(projects, fits[2:], logits[2:]) if estimable(x)}, fits[1])


def leaving_out(of: Refits) -> list[tuple]:
    """Of every project left out: name, share of candidates, cells and clusters that remain, largest and median change of log odds, least and largest
    ratio of odds ratios, whether the covariance is valid, and the status."""
    at, total, out = bins_of(of.whole), sum(n for n, _ in of.totals.projects.values()), []
    for p, (n, _) in sorted(of.totals.projects.items()):
        fit = of.without.get(p)
        own = bins_of(fit) if fit else {}
        changes = [float(fit.beta[own[b]] - of.whole.beta[i]) for b, i in at.items()] if fit and set(own) >= set(at) else []
        share = 100 * n / total if total else None
        if not changes:
            out.append((p, share, fit.rows if fit else None, fit.clusters if fit else None, None, None, None, None, False, NOT_ESTIMABLE))
            continue
        valid = not variance_fails(fit.covariance)
        size = np.abs(changes)
        out.append((p, share, fit.rows, fit.clusters, float(size.max()), float(np.median(size)), float(np.exp(min(changes))), float(np.exp(max(changes))), valid, OK if valid else COEFFICIENTS_ONLY))
    return out


LEFT_OUT = "left_out string, candidate_share_pct double, remaining_cells long, remaining_clusters long, largest_change double, median_change double, least_ratio double, largest_ratio double, covariance_valid boolean, status string"


@register()
def x70_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size model refitted without each project in turn: how far size effects move, and whether the refit's covariance is valid; where it isn't, its coefficients count alone."""
    return spark.createDataFrame(leaving_out(refits(spark, sf_dir)), LEFT_OUT)


@register()
def x106_dominant_fragile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects with a fifth of all candidates without which the covariance is invalid or odds ratios spread by a fifth."""
    rows = spark.createDataFrame(leaving_out(refits(spark, sf_dir)), LEFT_OUT)
    return rows.where((F.col("candidate_share_pct") >= DOMINANT) & (~F.col("covariance_valid") | (F.col("largest_ratio") / F.col("least_ratio") >= FRAGILE)))


def compared(of: Refits) -> list[tuple]:
    """Of every size bin: log odds of the size model and without versions never attacked, their change and the ratio of odds ratios."""
    at, clean = bins_of(of.whole), bins_of(of.clean)
    both = [(b, float(of.whole.beta[i]), float(of.clean.beta[clean[b]])) for b, i in at.items() if b in clean]
    return [(b, x, y, y - x, float(np.exp(x)), float(np.exp(y)), float(np.exp(y - x))) for b, x, y in both]


@register()
def x71_zero_outcome_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size effects with and without the versions that were never attacked."""
    return spark.createDataFrame(compared(refits(spark, sf_dir)), "bin string, log_odds double, excluded_log_odds double, change double, odds_ratio double, excluded_odds_ratio double, ratio double")


def gated(spark: SparkSession, of: Refits) -> list[tuple]:
    """Contrasts of size bins with the smallest: tests, Holm's correction, and significance, null where the gate holds it back."""
    free, drift, rows = of.whole.clusters - 1, {r[0]: r for r in compared(of)}, []
    se, reach = of.whole.se(), t_quantile(spark, 0.975, free) if free > 0 else float("nan")
    for b, i in bins_of(of.whole).items():
        est, s = float(of.whole.beta[i]), float(se[i])
        rows.append([b, est, s, float(np.exp(est)), float(np.exp(est - reach * s)), float(np.exp(est + reach * s)), t_two_sided(spark, est / s, free) if s > 0 else 1.0])
    status = "stable" if flags(of.whole, of.logit, of.boundary, of.totals) == "none" else "flags_present"
    with_holm(rows, 6)
    out = []
    for r in rows:
        d = drift.get(r[0])
        contrast = "sensitivity_check_unavailable" if d is None else "stable" if np.sign(d[1]) == np.sign(d[2]) and 1 - DRIFT <= d[6] <= 1 + DRIFT else "unstable_sensitivity_drift"
        formal = contrast == "stable"
        out.append((*r, status, contrast, "formal" if formal else "descriptive_only", r[-1] < 0.05 if formal else None))
    return out


@register()
def x72_stability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrasts of size bins with the smallest, gated one by one: a contrast counts as formal if its sign holds and its odds ratio moves by no more than a quarter
    without the versions never attacked; else its significance is null, while estimate and corrected p stay."""
    schema = "bin string, log_odds double, se double, odds_ratio double, low double, high double, p double, p_holm double, model_stability_status string, contrast_stability_status string, inferential_status string, significant boolean"
    return spark.createDataFrame(gated(spark, refits(spark, sf_dir)), schema)


@register()
def x70_x72_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each size bin: its odds ratio, the least and largest without one project, that without versions never attacked and its drift, whether the sign
    holds in all refits, whether the contrast passes the gate, and the projects that are dominant and fragile."""
    of = refits(spark, sf_dir)
    named = ";".join(r[0] for r in leaving_out(of) if r[1] is not None and r[1] >= DOMINANT and (not r[8] or r[7] / r[6] >= FRAGILE))
    drift, passed, out = {r[0]: r for r in compared(of)}, {r[0]: r[9] == "stable" for r in gated(spark, of)}, []
    for b, i in bins_of(of.whole).items():
        own = [float(f.beta[bins_of(f)[b]]) for f in of.without.values() if b in bins_of(f)]
        est, d = float(of.whole.beta[i]), drift.get(b)
        out.append((f"bin[{b}]", float(np.exp(est)), float(np.exp(min(own))) if own else None, float(np.exp(max(own))) if own else None, d[5] if d else None, d[6] - 1 if d else None, all(np.sign(x) == np.sign(est) for x in own), passed[b], named, of.whole.converged))
    return spark.createDataFrame(out, "term string, odds_ratio double, least double, most double, without_never_attacked double, drift double, sign_holds boolean, stable boolean, dominant_and_fragile string, converged boolean")
