"""Regression products and the bootstrap of the daily series. Fits sum normal equations where the rows lie. SQL can't express them; tests hold them against
brute force.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.breaks import block_sup_f
from ..kernels.linear import Fit, ols, poisson, wald
from ..kernels.tails import f_tail, normal_two_sided, t_two_sided
from ..registry import register
from .timeseries import EVENTS, daily, splits

SEED, SERIES_REPLICATES, BLOCK = 42, 999, 14


@register()
def x37_sup_f_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P of the largest Chow statistic under a circular moving-block bootstrap of the residuals around one trend. The series has a row for each
    day, whatever the number of events, and is all that tasks share; replicates are dealt over tasks."""
    series = np.array([r.y for r in daily(spark, sf_dir).orderBy("t").select(F.log1p("volume").alias("y")).collect()])
    t = np.arange(len(series), dtype=float)
    trend = np.polyval(np.polyfit(t, series, 1), t)
    shared = spark.sparkContext.broadcast((trend, series - trend))
    drawn = spark.range(1, SERIES_REPLICATES + 1).repartition(8).mapInPandas(block_sup_f(shared, SEED, BLOCK), "r long, f double")
    observed = splits(spark, sf_dir).agg(F.max("f").alias("sup_f"))
    rows = drawn.crossJoin(F.broadcast(observed)).agg(F.max("sup_f").alias("sup_f"), F.count_if(F.col("f") >= F.col("sup_f")).alias("hits"), F.count(F.lit(1)).alias("replicates"))
    return rows.select(F.round("sup_f", 5).alias("sup_f"), ((F.col("hits") + 1) / (F.col("replicates") + 1)).alias("p"), "replicates")


def table(spark: SparkSession, model: str, fit: Fit, df: float | None) -> DataFrame:
    """A fit as rows: model, term, estimate, se, statistic, p (normal where df is None)."""
    rows = []
    for name, b, s in zip(fit.names, fit.beta.tolist(), fit.se().tolist()):
        z = b / s if s > 0 else float("nan")
        p = (normal_two_sided(spark, z) if df is None else t_two_sided(spark, z, df)) if s > 0 else None
        rows.append((model, name, b, s, None if s <= 0 else z, p, fit.rows, fit.clusters, fit.converged))
    return spark.createDataFrame(rows, "model string, term string, estimate double, se double, statistic double, p double, rows long, clusters long, converged boolean")


def interruption() -> dict[str, Column]:
    since = F.datediff("date", F.lit(EVENTS[1]).cast("date"))
    days = {f"dow_{d}": (F.weekday("date") == d).cast("double") for d in range(1, 7)}
    return {"const": F.lit(1.0), "t": F.col("t") / 365.25, **days, "step": (since >= 0).cast("double"), "slope": F.greatest(F.lit(0), since) / 365.25}


@register()
def x32_x33_interrupted_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interrupted trend of log volume with weekday effects, under autocorrelation-robust (7, 14 and 28 lags) and month-clustered covariance, with
    the joint test of step and slope."""
    rows = daily(spark, sf_dir).withColumn("month", F.trunc("date", "month")).cache()
    x, y = interruption(), F.log1p("volume")
    out = []
    for model, options in {"hac_7": {"lags": 7}, "hac_14": {"lags": 14}, "hac_28": {"lags": 28}, "cluster_month": {"covariance": "cluster", "cluster": "month"}}.items():
        fit = ols(rows, y, x, **({"covariance": "hac", "order": "date"} | options))
        out.append(table(spark, model, fit, fit.clusters - 1 if fit.clusters else None))
        c = np.zeros((2, len(fit.names)))
        c[0, fit.names.index("step")] = c[1, fit.names.index("slope")] = 1
        f, q = wald(fit, c)
        free = fit.clusters - 1 if fit.clusters else fit.rows - len(fit.names)
        out.append(spark.createDataFrame([(model, "joint step and slope", None, None, f, f_tail(spark, f, q, free), fit.rows, fit.clusters, True)], out[0].schema))
    rows.unpersist()
    result = out[0]
    for frame in out[1:]:
        result = result.unionAll(frame)
    return result


@register()
def x48_poisson_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poisson pseudo maximum likelihood of daily legs on the interrupted trend."""
    rows = daily(spark, sf_dir).cache()
    fit = poisson(rows, "legs", interruption())
    rows.unpersist()
    return table(spark, "poisson", fit, None)


@register()
def x21_longevity_hc3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log volume of an entity on log legs and active days, with HC3 errors."""
    from .named import q4_bot_profiles

    bots = q4_bot_profiles(spark, sf_dir).where("total_volume_usd > 0").cache()
    x = {"const": F.lit(1.0), "log_legs": F.log("total_sandwich_trades"), "log_days": F.log("days_active")}
    fit = ols(bots, F.log("total_volume_usd"), x, "hc3")
    bots.unpersist()
    return table(spark, "hc3", fit, fit.rows - len(fit.names))
