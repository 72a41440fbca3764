"""Generalised Pareto tails, and diagnostics of the daily series, which has a number for each day."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.breaks import adf, binary_segmentation, kpss, pelt_mean_variance
from ..registry import register
from .concentration import SQL_VOLUMES, ranked, volumes
from .timeseries import daily

#: Critical values at 5 %, with a trend.
ADF_5, KPSS_5 = -3.41, 0.146


#: The likelihood's profile is searched over a grid: steps of 2 % above zero in units of the mean excess, and fractions of the bound below.
GRID_UP, GRID_DOWN = 460, 49
SHARES = (0.05, 0.10, 0.15, 0.20)


@register(
    f"""WITH {SQL_VOLUMES}, p AS (SELECT unnest([0.05, 0.10, 0.15, 0.20]) AS share), k AS (SELECT DISTINCT share, n, CAST(ceil(round(n * share, 6)) AS BIGINT) AS k FROM r, p),
    c AS (SELECT share, k, volume AS threshold FROM r JOIN k ON rank = k + 1), t AS (SELECT share, k, threshold, volume - threshold AS x FROM r JOIN c ON rank <= k), m AS (SELECT share, avg(x) AS mean, max(x) AS most FROM t GROUP BY 1),
    g AS (SELECT share, i, CASE WHEN i > 0 THEN 0.001 * power(1.02, i) / mean ELSE 0.02 * i / most END AS theta FROM m, (SELECT unnest(range(-{GRID_DOWN}, {GRID_UP} + 1)) AS i) WHERE i <> 0),
    l AS (SELECT share, i, theta, max(k) AS k, max(threshold) AS threshold, avg(ln(1 + theta * x)) AS xi FROM t JOIN g USING (share) GROUP BY 1, 2, 3),
    b AS (SELECT *, -k * (ln(xi / theta) + xi + 1) AS loglik, row_number() OVER (PARTITION BY share ORDER BY round(-k * (ln(xi / theta) + xi + 1), 6) DESC, i) AS place FROM l WHERE xi / theta > 0)
    SELECT CAST(share AS DOUBLE) AS share, k, round(threshold, 2) AS threshold, round(xi, 6) AS xi, round(xi / theta, 2) AS scale, round(loglik, 4) AS loglik FROM b WHERE place = 1"""
)
def x89_x91_pareto_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generalised Pareto fits of the excesses over four thresholds, by the likelihood's profile on a grid: sums for all grid points in one pass."""
    rows = ranked(volumes(spark, sf_dir)).select("volume", "rank", "n", F.explode(F.array(*map(F.lit, SHARES))).alias("share")).withColumn("k", F.ceil(F.round(F.col("n") * F.col("share"), 6)))
    cut = rows.where("rank = k + 1").select("share", F.col("volume").alias("threshold"))
    tail = rows.where("rank <= k").join(F.broadcast(cut), "share").select("share", "k", "threshold", (F.col("volume") - F.col("threshold")).alias("x"))
    size = tail.groupBy("share").agg(F.avg("x").alias("mean"), F.max("x").alias("most"))
    i = F.col("i")
    theta = F.when(i > 0, 0.001 * F.pow(F.lit(1.02), i) / F.col("mean")).otherwise(0.02 * i / F.col("most"))
    grid = size.withColumn("i", F.explode(F.sequence(F.lit(-GRID_DOWN), F.lit(GRID_UP)))).where("i <> 0").select("share", "i", theta.alias("theta"))
    # One list of grid points a threshold; rows are multiplied inside an aggregate, after partial sums.
    fits = tail.join(F.broadcast(grid), "share").groupBy("share", "i", "theta").agg(F.max("k").alias("k"), F.max("threshold").alias("threshold"), F.avg(F.log1p(F.col("theta") * F.col("x"))).alias("xi"))
    scale = F.col("xi") / F.col("theta")
    scored = fits.where(scale > 0).withColumn("loglik", -F.col("k") * (F.log(scale) + F.col("xi") + 1))
    best = scored.groupBy("share").agg(F.max_by(F.struct("k", "threshold", "xi", "theta", "loglik"), F.struct(F.round("loglik", 6), -i)).alias("b"))
    return best.select("share", "b.k", F.round("b.threshold", 2).alias("threshold"), F.round("b.xi", 6).alias("xi"), F.round(F.col("b.xi") / F.col("b.theta"), 2).alias("scale"), F.round("b.loglik", 4).alias("loglik"))


def log_series(spark: SparkSession, sf_dir: str) -> tuple[list, np.ndarray]:
    """Dates and log volumes of the daily series, one number for each day."""
    rows = daily(spark, sf_dir).orderBy("t").select("date", F.log1p("volume").alias("y")).collect()
    return [r.date for r in rows], np.array([r.y for r in rows])


@register()
def x29_unit_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dickey-Fuller's and the stationarity test of log volume, with trend, each against its 5 % point."""
    _, y = log_series(spark, sf_dir)
    (a, lags), (k, width) = adf(y), kpss(y)
    return spark.createDataFrame([("adf", a, lags, ADF_5, a < ADF_5), ("kpss", k, width, KPSS_5, k > KPSS_5)], "test string, statistic double, lags long, point_5 double, rejects boolean")


@register()
def x38_x40_changepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks of log volume: by binary segmentation in the mean, none to three with the criterion, and changes of mean and variance by dynamic programming."""
    dates, y = log_series(spark, sf_dir)
    found = binary_segmentation(y)
    best = min(found, key=lambda r: r["bic"])["breaks"]
    rows = [("segmentation", r["breaks"], [dates[i] for i in r["at"]], r["rss"], r["bic"], r["breaks"] == best) for r in found]
    at = pelt_mean_variance(y)
    rows.append(("mean and variance", len(at), [dates[i] for i in at], None, None, True))
    return spark.createDataFrame(rows, "method string, breaks long, dates array<date>, rss double, bic double, chosen boolean")
