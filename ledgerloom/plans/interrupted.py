"""Interrupted series of three daily outcomes: steps and changes of slope at two events, under several designs and covariances.

Days are aggregated by Spark first; each model is one group of a job, with a row for each day. Logarithms are taken of days on which the outcome is
positive, others are left out there; counts keep all days. What comes back are some rows for each model, for which the tails are looked up.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..kernels.series import by_cluster, counts, least_squares, restricted
from ..kernels.tails import chi_square_tail, f_tail, normal_two_sided, with_holm
from ..registry import register
from .named import q1_daily_activity
from .timeseries import EVENTS

#: The events, the lags of the covariances (the middle one is that of all tests), and the 97.5 % point of the normal distribution.
FIRST, SECOND = EVENTS[:2]
LAGS, MAIN, REACH = (7, 14, 28), 14, 1.959963984540054
OUTCOMES = {"volume": "total_sandwich_volume_usd", "legs": "sandwich_trade_count", "bots": "unique_sandwich_bots"}
TERMS = ("t", "step_1", "slope_1", "step_2", "slope_2")
#: name of a test, and the terms that it adds up to zero, one list for each restriction.
JOINT = {"event_1": (("step_1",), ("slope_1",)), "event_2": (("step_2",), ("slope_2",))}
SLOPES = {"slope_after_1": (("t", "slope_1"),), "slope_after_2": (("t", "slope_1", "slope_2"),), "omnibus": tuple((term,) for term in TERMS)}
FITTED = "outcome string, specification string, lag int, kind string, name string, estimate double, variance double, statistic double, q int, free long, converged boolean"


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day from the first to the last with t, its number from 0, its place among weekdays and months, and the outcomes (0 on empty days)."""
    seen = q1_daily_activity(spark, sf_dir).select("date", *[F.col(c).cast("double").alias(o) for o, c in OUTCOMES.items()])
    spine = seen.agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    dense = spine.join(seen, "date", "left").fillna(0.0, list(OUTCOMES))
    t = F.datediff("date", F.min("date").over(Window.partitionBy())).cast("double")
    since = [F.datediff("date", F.lit(e).cast("date")).cast("double").alias(f"since_{i}") for i, e in enumerate((FIRST, SECOND), 1)]
    return dense.select("date", *OUTCOMES, t.alias("t"), F.weekday("date").alias("weekday"), F.month("date").alias("month"), *since)


def design(frame: pd.DataFrame, specification: str) -> tuple[list[str], np.ndarray]:
    """Names and columns of a specification: trend, weekdays, and at each event a step and a slope; next_day shifts events by a day, calendar_month
    adds months, quadratic_trend the square of the trend."""
    columns = {"const": np.ones(len(frame)), "t": frame["t"].to_numpy(float)}
    if specification == "quadratic_trend":
        columns["t2"] = columns["t"] ** 2
    for i in (1, 2):
        since = frame[f"since_{i}"].to_numpy(float) - (specification == "next_day")
        columns |= {f"step_{i}": (since >= 0).astype(float), f"slope_{i}": np.maximum(0, since)}
    for kind in ["weekday"] + ["month"] * (specification == "calendar_month"):
        columns |= {f"{kind}_{v}": (frame[kind] == v).to_numpy(float) for v in sorted(frame[kind].unique())[1:]}
    return list(columns), np.column_stack(list(columns.values()))


def fit_model(frame: pd.DataFrame) -> pd.DataFrame:
    """Terms and tests of one model, whose days the frame holds."""
    frame = frame.sort_values("t")
    outcome, specification, lag = frame[["outcome", "specification", "lag"]].iloc[0]
    names, x = design(frame, specification)
    beta, covariance, done = (counts if specification == "poisson" else least_squares)(x, frame["y"].to_numpy(float), int(lag))
    free = len(x) - int(np.linalg.matrix_rank(x))
    at = {n: i for i, n in enumerate(names)}
    rows = [("term", n, beta[at[n]], max(0.0, covariance[at[n], at[n]]), None, 1) for n in names if n in (*TERMS, "t2")]
    for name, parts in (JOINT | SLOPES).items():
        c = np.zeros((len(parts), len(names)))
        for row, terms in zip(c, parts):
            row[[at[n] for n in terms]] = 1
        statistic, q = restricted(beta, covariance, c)
        rows.append(("test", name, float((c @ beta)[0]) if len(parts) == 1 else None, None, statistic, q))
    return pd.DataFrame([(outcome, specification, int(lag), *row, free, done) for row in rows], columns=[c.split()[0] for c in FITTED.split(", ")])


def fitted(spark: SparkSession, sf_dir: str, models: list[tuple[str, str, int]]) -> list:
    """Rows of the named models (outcome, specification, lag), all fitted in one job."""
    asked = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.lit(s).alias("specification"), F.lit(k).alias("lag"), (F.col(o) if s == "poisson" else F.ln(o)).alias("y")) for o, s, k in models]))
    rows = days(spark, sf_dir).select("t", "weekday", "month", "since_1", "since_2", asked.alias("m")).select("m.*", "t", "weekday", "month", "since_1", "since_2").where("y is not null")
    return rows.groupBy("outcome", "specification", "lag").applyInPandas(fit_model, FITTED).orderBy("outcome", "specification", "lag", "kind", "name").collect()


def percent(beta: float) -> float:
    """The exact change in percent that a coefficient of a logarithm stands for."""
    return 100 * math.expm1(min(beta, 700.0))


@register()
def x46_interrupted_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend, steps and slopes of three log outcomes under covariances robust over 7, 14 and 28 days: normal intervals and exact changes in percent, of the
    level for steps and of a day's growth for slopes."""
    out = []
    for r in fitted(spark, sf_dir, [(o, "main", k) for o in OUTCOMES for k in LAGS]):
        if r.kind == "term":
            se = math.sqrt(r.variance)
            low, high = r.estimate - REACH * se, r.estimate + REACH * se
            p = normal_two_sided(spark, r.estimate / se) if se > 0 else None
            kind = "level" if r.name.startswith("step") else "daily growth"
            out.append((r.outcome, r.lag, r.name, r.estimate, se, low, high, p, kind, percent(r.estimate), percent(low), percent(high)))
    return spark.createDataFrame(out, "outcome string, lag int, term string, estimate double, se double, low double, high double, p double, percent_of string, percent double, percent_low double, percent_high double")


def tests(spark: SparkSession, rows: list, names: dict) -> list[list]:
    return [[r.outcome, r.specification, r.lag, r.name, r.estimate, r.statistic / r.q, r.q, r.free, f_tail(spark, r.statistic / r.q, r.q, r.free)] for r in rows if r.kind == "test" and r.name in names]


TESTED = "outcome string, specification string, lag int, test string, estimate double, f double, q int, free long, p double"


@register()
def x47_interrupted_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joint test of step and slope at each event under all lags, with Holm's correction over the main lag's family, and beside it with calendar months, events
    shifted to the next day, and a quadratic trend."""
    models = [(o, "main", k) for o in OUTCOMES for k in LAGS] + [(o, s, MAIN) for o in OUTCOMES for s in ("calendar_month", "next_day", "quadratic_trend")]
    rows = tests(spark, fitted(spark, sf_dir, models), JOINT)
    family = [r for r in rows if r[1] == "main" and r[2] == MAIN]
    with_holm(family, 8)
    return spark.createDataFrame([tuple(r if len(r) == 10 else [*r, None]) for r in rows], f"{TESTED}, p_holm double")


@register()
def x48_poisson_wald(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poisson pseudo maximum likelihood of daily legs and bots, robust over 14 days: chi-square tests of each event, with its step in percent and its slope."""
    rows = fitted(spark, sf_dir, [(o, "poisson", MAIN) for o in ("legs", "bots")])
    terms = {(r.outcome, r.name): r.estimate for r in rows if r.kind == "term"}
    out = []
    for r in rows:
        if r.kind == "test" and r.name in JOINT:
            step, slope = (terms[r.outcome, f"{kind}_{r.name[-1]}"] for kind in ("step", "slope"))
            out.append((r.outcome, r.name, r.statistic, r.q, chi_square_tail(spark, r.statistic, r.q), step, percent(step), slope, r.converged))
    return spark.createDataFrame(out, "outcome string, test string, chi_square double, q int, p double, step double, step_percent double, slope double, converged boolean")


@register()
def x49_slope_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the slope after each event is zero, and the joint test of trend, steps and slopes, for three log outcomes, with Holm's correction over all nine."""
    rows = tests(spark, fitted(spark, sf_dir, [(o, "main", MAIN) for o in OUTCOMES]), SLOPES)
    with_holm(rows, 8)
    return spark.createDataFrame([tuple(r) for r in rows], f"{TESTED}, p_holm double")


def clustered(frame: pd.DataFrame) -> pd.DataFrame:
    """Terms and joint tests of the main model of one outcome, under clusters of calendar months of their year."""
    frame = frame.sort_values("t")
    names, x = design(frame, "main")
    beta, covariance, groups = by_cluster(x, frame["y"].to_numpy(float), frame["period"].astype(str).to_numpy())
    at, outcome = {n: i for i, n in enumerate(names)}, frame["outcome"].iloc[0]
    rows = [(outcome, n, beta[at[n]], max(0.0, covariance[at[n], at[n]]) ** 0.5, None, 1, groups) for n in names if n in TERMS]
    for name, parts in (JOINT | {"both_events": tuple((t,) for t in TERMS[1:])}).items():
        c = np.zeros((len(parts), len(names)))
        for row, terms in zip(c, parts):
            row[[at[n] for n in terms]] = 1
        statistic, q = restricted(beta, covariance, c)
        rows.append((outcome, name, None, None, statistic, q, groups))
    return pd.DataFrame(rows, columns=["outcome", "name", "estimate", "se", "statistic", "q", "clusters"])


@register()
def x33_clustered_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend, steps and slopes at both events of three log outcomes under clusters of months (CR1), with t-tests, and F tests of each event and of both."""
    asked = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.ln(o).alias("y")) for o in OUTCOMES])).alias("m")
    keep = ["t", "weekday", "month", "since_1", "since_2"]
    rows = days(spark, sf_dir).select(*keep, F.date_format("date", "yyyy-MM").alias("period"), asked).select("m.*", *keep, "period").where("y is not null")
    found = rows.groupBy("outcome").applyInPandas(clustered, "outcome string, name string, estimate double, se double, statistic double, q int, clusters long").collect()
    out = []
    for r in sorted(found, key=lambda r: (r.outcome, r.statistic is not None, r.name)):
        free = r.clusters - 1
        f = r.statistic / r.q if r.estimate is None else (r.estimate / r.se) ** 2 if r.se else None
        out.append((r.outcome, r.name, r.estimate, r.se, f, r.q, free, f_tail(spark, f, r.q, free) if f is not None and free > 0 else None))
    return spark.createDataFrame(out, "outcome string, name string, estimate double, se double, f double, q int, df long, p double")
