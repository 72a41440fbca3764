"""Protocols by year and one by one: refits, what can be identified, and tests that are left out with their reason.

Cells are summed over versions first: a group holds a row for each month, size bin (and project), whatever the number of events.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..kernels.linear import local_logit
from ..registry import register
from .incidence import ATTACKED, CANDIDATES
from .named import SQL_PANEL, attack_panel

#: A fit whose shares all lie this close to the observed ones separates its cells.
EXACT = 1e-8


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """year, month, project, trade_size_bin, attacked and candidate events."""
    by = ["month", "project", "trade_size_bin"]
    return attack_panel(spark, sf_dir).groupBy(*by).agg(F.sum(ATTACKED).alias(ATTACKED), F.sum(CANDIDATES).alias(CANDIDATES)).where(F.col(CANDIDATES) > 0).select(F.year("month").alias("year"), F.col("month").cast("string").alias("month"), *by[1:], ATTACKED, CANDIDATES)


def levels(frame: pd.DataFrame, *columns: str) -> np.ndarray:
    """Ones, and for each column an indicator of every level but the first."""
    parts = [np.ones(len(frame))] + [(frame[c] == v).to_numpy(float) for c in columns for v in sorted(frame[c].unique())[1:]]
    return np.column_stack(parts)


def usable(x: np.ndarray, frame: pd.DataFrame) -> tuple[np.ndarray, bool, bool, int]:
    """Coefficients of a grouped logit, whether it converged, whether it fits every share exactly, and the design's rank."""
    y, n = frame[ATTACKED].to_numpy(float), frame[CANDIDATES].to_numpy(float)
    beta, _, done = local_logit(x, y, n)
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
    return beta, done, bool(np.abs(p - y / n).max() < EXACT), int(np.linalg.matrix_rank(x))


def adjusted(frame: pd.DataFrame) -> pd.DataFrame:
    """Fitted probability of each attacked project of a year over that year's candidates by month and size; no rows where the model can't be used."""
    empty = pd.DataFrame({"year": pd.Series(dtype="int32"), "project": pd.Series(dtype=str), "adjusted": pd.Series(dtype=float)})
    attacked = frame.groupby("project")[ATTACKED].sum()
    frame = frame[frame["project"].isin(attacked[attacked > 0].index)]
    projects = sorted(frame["project"].unique())
    if len(projects) < 2:
        return empty
    x = levels(frame, "project", "trade_size_bin", "month")
    beta, done, exact, rank = usable(x, frame)
    if not done or exact or rank < x.shape[1] or not np.isfinite(beta).all():
        return empty
    k = len(projects)
    effects = np.append(0.0, beta[1:k])
    base, n = beta[0] + x[:, k:] @ beta[k:], frame[CANDIDATES].to_numpy(float)
    p = [float((n / (1 + np.exp(-np.clip(base + e, -35, 35)))).sum() / n.sum()) for e in effects]
    return pd.DataFrame({"year": frame["year"].iloc[0], "project": projects, "adjusted": p})


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).groupBy("year").applyInPandas(adjusted, "year int, project string, adjusted double")


@register()
def x83_yearly_refits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of an attack by project and year from a logit of each year on project, size and month, standardised to the year's candidates, with its place; years
    whose model isn't identified, separates or doesn't converge have no rows."""
    return yearly(spark, sf_dir).select("year", "project", F.round("adjusted", 8).alias("adjusted"), F.rank().over(Window.partitionBy("year").orderBy(F.desc(F.round("adjusted", 8)))).alias("place"))


@register()
def x83_adjusted_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kendall's tau-b of the adjusted probabilities of each usable year and the next, over the projects of both; null where a year's are all equal."""
    rows = yearly(spark, sf_dir).cache()
    after = rows.select((F.col("year") - 1).alias("year"), "project", F.col("adjusted").alias("next"))
    both = rows.join(after, ["year", "project"])
    other = both.select("year", F.col("project").alias("other"), F.col("adjusted").alias("x"), F.col("next").alias("y"))
    pairs = both.join(other, "year").where(F.col("project") < F.col("other")).select("year", F.signum(F.col("adjusted") - F.col("x")).alias("a"), F.signum(F.col("next") - F.col("y")).alias("b"))
    norm = F.sqrt(F.count_if(F.col("a") != 0).cast("double") * F.count_if(F.col("b") != 0))
    return pairs.groupBy("year").agg(F.when(norm > 0, F.round(F.sum(F.col("a") * F.col("b")) / norm, 8)).alias("tau_b"), F.count(F.lit(1)).alias("pairs"))


FEW_BINS, NO_ATTACKS, DIAGNOSTIC = "fewer than two size bins", "no attacked events", "diagnostic only: too few months for tests of several terms"


def identified(frame: pd.DataFrame) -> pd.DataFrame:
    row = {"project": frame["project"].iloc[0], "months": frame["month"].nunique(), "size_bins": frame["trade_size_bin"].nunique(), "attacked": int(frame[ATTACKED].sum()), "converged": None, "separated": None, "design_columns": None, "design_rank": None}
    if row["size_bins"] < 2:
        row["reason"] = FEW_BINS
    elif not row["attacked"]:
        row["reason"] = NO_ATTACKS
    else:
        x = levels(frame, "trade_size_bin", "month")
        _, done, exact, rank = usable(x, frame)
        row |= {"converged": done, "separated": exact, "design_columns": x.shape[1], "design_rank": rank, "reason": DIAGNOSTIC}
    return pd.DataFrame([row]).astype({"design_columns": "Int64", "design_rank": "Int64"})


@register()
def x85_within_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a project's own data can tell of size effects: months, bins and attacks seen, and whether a logit on size and month converges, separates and has full
    rank. No tests: reportable is false and the reason says why."""
    schema = "project string, months long, size_bins long, attacked long, converged boolean, separated boolean, design_columns long, design_rank long, reason string"
    return cells(spark, sf_dir).groupBy("project").applyInPandas(identified, schema).withColumn("reportable", F.lit(False))


TIME_REASON = "omitted: too many restrictions of projects by time for the number of months"
YEAR_REASON = "omitted: the months of one year are too few for a joint test of projects"


@register(
    f"""WITH {SQL_PANEL}, w AS (SELECT *, CAST(year(month) AS INTEGER) AS year, sum(attacked_trade_events) OVER (PARTITION BY project) AS whole, sum(attacked_trade_events) OVER (PARTITION BY project, year(month)) AS own FROM panel)
    SELECT 'project by time' AS test, CAST(NULL AS INTEGER) AS year, count(DISTINCT project) AS protocols, count(DISTINCT month) AS month_clusters, count(DISTINCT project) - 1 AS restrictions, CAST(NULL AS DOUBLE) AS p, false AS reportable, '{TIME_REASON}' AS reason
    FROM w WHERE whole > 0 UNION ALL SELECT 'projects in a year', year, count(DISTINCT project) FILTER (own > 0), count(DISTINCT month) FILTER (own > 0), greatest(0, count(DISTINCT project) FILTER (own > 0) - 1), NULL, false, '{YEAR_REASON}' FROM w GROUP BY year"""
)
def x86_omitted_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests that are not made, each with the number of protocols, of months and of restrictions that speak against it; p is null."""
    rows = attack_panel(spark, sf_dir).groupBy("project", "month").agg(F.sum(ATTACKED).alias("a")).withColumn("year", F.year("month"))
    rows = rows.withColumn("whole", F.sum("a").over(Window.partitionBy("project"))).withColumn("own", F.sum("a").over(Window.partitionBy("project", "year")))

    def record(test: str, year, groups, kept, reason: str) -> DataFrame:
        own = groups.agg(F.count_distinct(F.when(kept, F.col("project"))).alias("protocols"), F.count_distinct(F.when(kept, F.col("month"))).alias("month_clusters"))
        restrictions = F.greatest(F.lit(0).cast("long"), F.col("protocols") - 1).alias("restrictions")
        return own.select(F.lit(test).alias("test"), year.alias("year"), "protocols", "month_clusters", restrictions, F.lit(None).cast("double").alias("p"), F.lit(False).alias("reportable"), F.lit(reason).alias("reason"))

    over_time = record("project by time", F.lit(None).cast("int"), rows.groupBy(), F.col("whole") > 0, TIME_REASON)
    return over_time.unionByName(record("projects in a year", F.col("year"), rows.groupBy("year"), F.col("own") > 0, YEAR_REASON))
