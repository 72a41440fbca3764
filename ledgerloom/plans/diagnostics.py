"""What fits leave behind and what tests can find: residual tests of the interrupted series, effects that tests of given errors detect, families of tests, and the named checks of the
products.

Numbers come out of the products and models themselves; what is collected has the size of a design or of a report.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.linear import ols
from ..kernels.series import least_squares
from ..kernels.tails import chi_square_tail, t_quantile
from ..registry import ORACLE_SQL, QUERIES, register
from .interrupted import MAIN, OUTCOMES, days, design
from .models import table
from .named import q1_daily_activity, q3_bot_distribution, q4_bot_profiles, q5a_break_points, q5b_tier_impact, qp_protocols
from .relational import bots
from .resampling import WINDOWS, bootstrapped

#: Lags of residuals that are looked at, an autocorrelation that is large, and a p that is small.
RESIDUAL_LAGS, LARGE_ACF, SMALL_P = (1, 7, 14, 28), 0.20, 0.01


def leftovers(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one outcome's days: correlation of the main model's residuals with those some days before, and Ljung-Box's statistic up to there."""
    frame = frame.sort_values("t")
    x, y = design(frame, "main")[1], frame["y"].to_numpy(float)
    beta, _, _ = least_squares(x, y, MAIN)
    e = y - x @ beta
    n, centred = len(e), e - e.mean()
    r = np.array([centred[k:] @ centred[:-k] for k in range(1, min(n - 1, max(RESIDUAL_LAGS)) + 1)]) / (centred @ centred)
    rows = []
    for lag in RESIDUAL_LAGS:
        acf = float(np.corrcoef(e[lag:], e[:-lag])[0, 1]) if n > lag + 1 else None
        box = float(n * (n + 2) * (r[:lag] ** 2 / (n - np.arange(1, lag + 1))).sum()) if n > lag + 1 else None
        rows.append((frame["outcome"].iloc[0], lag, n, acf, box))
    return pd.DataFrame(rows, columns=["outcome", "lag", "days", "acf", "ljung_box"])


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """outcome, lag, days, acf, ljung_box, p of the three log outcomes."""
    asked = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.ln(o).alias("y")) for o in OUTCOMES])).alias("m")
    rows = days(spark, sf_dir).select("t", "weekday", "month", "since_1", "since_2", asked).select("m.*", "t", "weekday", "month", "since_1", "since_2").where("y is not null")
    found = rows.groupBy("outcome").applyInPandas(leftovers, "outcome string, lag int, days long, acf double, ljung_box double").collect()
    out = [(*r, chi_square_tail(spark, r.ljung_box, r.lag) if r.ljung_box is not None and not math.isnan(r.ljung_box) else None) for r in found]
    return spark.createDataFrame(out, "outcome string, lag int, days long, acf double, ljung_box double, p double")


@register()
def x42_residual_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of the interrupted model of three log outcomes (main covariance): their correlation with those 1, 7, 14 and 28 days before, and Ljung-Box's test up to each."""
    return residuals(spark, sf_dir)


@register()
def x43_residual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each outcome the largest correlation and the least p of its residuals, whether they are large and small, and what that amounts to."""
    rows = residuals(spark, sf_dir).groupBy("outcome").agg(F.max(F.abs("acf")).alias("largest_acf"), F.min("p").alias("least_p"))
    acf, box = F.col("largest_acf") >= LARGE_ACF, F.col("least_p") < SMALL_P
    status = F.when(acf & box, "strong_residual_dependence_signal").when(acf | box, "residual_dependence_signal").otherwise("no_large_signal_at_reported_lags")
    return rows.select("outcome", "largest_acf", "least_p", acf.alias("acf_flag"), box.alias("ljung_box_flag"), status.alias("status"))


#: Level and power of the tests whose detectable effects are told.
LEVEL, POWER = 0.05, 0.80


def detectable(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows (source, term, df, se) with the effect that a two-sided t-test of that error finds: at the level, and at the level over the size of the source's family; both in percent too."""
    counted = rows.where("se is not null and df > 0").join(rows.groupBy("source").agg(F.count(F.lit(1)).alias("family_size")), "source")
    kinds = counted.select("df", "family_size").distinct().collect()  # a pair for each source
    at = [(float(r.df), r.family_size, t_quantile(spark, POWER, r.df), *[t_quantile(spark, 1 - level / 2, r.df) for level in (LEVEL, LEVEL / r.family_size)]) for r in kinds]
    points = spark.createDataFrame(at, "df double, family_size long, power double, plain double, corrected double")
    out = counted.withColumn("df", F.col("df").cast("double")).join(F.broadcast(points), ["df", "family_size"])
    least = {k: F.col("se") * (F.col(k) + F.col("power")) for k in ("plain", "corrected")}
    in_percent = lambda c: 100 * F.expm1(F.least(c, F.lit(700.0)))
    return out.select(
        "source", "term", "df", "se", "family_size", F.lit(LEVEL).alias("level"), least["plain"].alias("detectable"), in_percent(least["plain"]).alias("detectable_percent"),
        (LEVEL / F.col("family_size")).alias("corrected_level"), least["corrected"].alias("corrected"), in_percent(least["corrected"]).alias("corrected_percent"),
    )


@register()
def x87_detectable_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest effects that tests at 5 % find with power 80 %, from t quantiles and the errors of three models: coefficients of the interrupted series, contrasts of size bins, and
    contrasts of projects; beside them those at the level divided by the number of tests of the source."""
    from .panelmodels import x72_stability_gate, x78_x79_protocol_logit

    joint = QUERIES["x47_interrupted_robustness"](spark, sf_dir).where(f"specification = 'main' and lag = {MAIN}").groupBy("outcome").agg(F.max("free").alias("df"))
    series = QUERIES["x46_interrupted_outcomes"](spark, sf_dir).where(f"lag = {MAIN}").join(joint, "outcome").select(F.lit("interrupted series").alias("source"), F.concat_ws(" ", "outcome", "term").alias("term"), "df", "se")
    protocols = x78_x79_protocol_logit(spark, sf_dir).where("estimate is not null").select(F.lit("projects").alias("source"), F.col("contrast").alias("term"), "df", "se")
    clusters = QUERIES["x67_two_way_clusters"](spark, sf_dir).agg((F.max("version_clusters") - 1).alias("df"))
    bins = x72_stability_gate(spark, sf_dir).crossJoin(F.broadcast(clusters)).select(F.lit("size bins").alias("source"), F.col("bin").alias("term"), "df", "se")
    return detectable(spark, series.unionByName(bins).unionByName(protocols))


#: Queries that hold families of tests: hypothesis, family, rows that belong to it, the correction, what errors or bounds rest on, and how it counts.
FAMILIES = {
    "x10_x11_bootstrap": ("concentration", "intervals of each measure by window", "window <> 'all'", "none: one interval for each measure", "bootstrap of entities", "confirmatory in the primary window"),
    "x56_e_tests": ("incidence", "monthly conditional tests of bins by direction", "p_bound is not null", "Bonferroni on bounds of p", "sequential, by bin", "descriptive"),
    "x62_hoeffding": ("incidence", "simultaneous bounds of bins", "true", "inside the bound", "sequential, by bin", "descriptive interval"),
    "x72_stability_gate": ("incidence", "size bins against the smallest", "p is not null", "Holm", "clusters of project and version (CR1)", "confirmatory where the gate lets it"),
    "x47_interrupted_robustness": ("persistence", "joint step and slope at each event, main lag", "p_holm is not null", "Holm", "autocorrelation-robust, one series", "confirmatory"),
    "x49_slope_tests": ("persistence", "slopes after events and the omnibus test", "p_holm is not null", "Holm, a family of its own", "autocorrelation-robust, one series", "secondary"),
    "x78_x79_protocol_logit": ("protocols", "contrasts of all pairs of attacked projects", "p_holm is not null", "Holm, exploratory", "clusters of months (CR1)", "exploratory"),
}


#: Where a family is only a part of its query's rows that can be worked out alone: the windows of the bootstrap without all days.
FAMILY_ROWS = {"x10_x11_bootstrap": lambda spark, sf_dir: bootstrapped(spark, sf_dir, WINDOWS)}


@register()
def x88_multiplicity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every family of tests with its size, counted from its query's result, its correction, what its errors rest on, how it counts, and how many tests are significant after correction
    (null where a family has no corrected p)."""
    out = None
    for i, (query, (hypothesis, family, belongs, correction, basis, status)) in enumerate(FAMILIES.items()):
        rows = FAMILY_ROWS.get(query, QUERIES[query])(spark, sf_dir).where(belongs)
        corrected = next((c for c in ("p_holm", "p_bonferroni") if c in rows.columns), None)
        found = F.count_if(F.col(corrected) < LEVEL) if corrected else F.lit(None).cast("long")
        own = rows.agg(F.count(F.lit(1)).alias("family_size"), found.alias("significant"))
        own = own.select(F.lit(i).alias("place"), F.lit(query).alias("query"), F.lit(hypothesis).alias("hypothesis"), F.lit(family).alias("family"), "family_size", "significant", F.lit(correction).alias("correction"), F.lit(basis).alias("basis"), F.lit(status).alias("status"))
        out = own if out is None else out.unionByName(own)
    return out


@register()
def x21_cohort_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log volume of an entity on log active days, log intensity (legs on an active day) and the half year of its first leg (against the first one), with HC3 errors and t-tests."""
    rows = bots(spark, sf_dir).where("volume > 0").select(F.log("volume").alias("y"), F.log("days").alias("log_days"), F.log(F.col("legs") / F.col("days")).alias("log_intensity"), "cohort").cache()
    cohorts = sorted(r[0] for r in rows.select("cohort").distinct().collect())  # a few half years
    x = {"const": F.lit(1.0), "log_days": F.col("log_days"), "log_intensity": F.col("log_intensity")} | {f"cohort[{c}]": (F.col("cohort") == c).cast("double") for c in cohorts[1:]}
    fit = ols(rows, F.col("y"), x, "hc3")
    rows.unpersist()
    return table(spark, "hc3", fit, fit.rows - len(fit.names))


#: A project that every table of protocols holds, and the tiers.
KNOWN_PROJECT, TIERS = "Brand#1", ("Retail", "Small", "Institutional")
#: What is summed over each product, in SQL that both engines read: columns of one row.
SUMMED = {
    "q1_daily_activity": "count(*) AS q1_rows, count(DISTINCT date) AS q1_days, datediff({day}max(date), min(date)) AS q1_span, round(sum(total_sandwich_volume_usd), 2) AS q1_volume, sum(sandwich_trade_count) AS q1_trades, avg(unique_sandwich_bots) AS q1_bots",
    "q3_bot_distribution": "count(*) AS q3_rows, count(DISTINCT bot_address) AS q3_addresses, count(total_volume_usd) AS q3_measured, round(sum(total_volume_usd), 2) AS q3_volume",
    "q4_bot_profiles": "count(*) AS q4_rows, min(days_active) AS q4_days, sum(total_sandwich_trades) AS q4_trades",
    "q5a_break_points": "count(*) AS q5a_rows, count(p25 + p50_median + p75 + p90 + p95) AS q5a_points, min(CASE WHEN p25 <= p50_median AND p50_median <= p75 AND p75 <= p90 AND p90 <= p95 THEN 1 ELSE 0 END) AS q5a_order, min(CASE WHEN min_value <= p25 AND p95 <= max_value THEN 1 ELSE 0 END) AS q5a_ends, sum(total_victim_trades) AS q5a_trades",
    "q5b_tier_impact": f"count(*) AS q5b_rows, count(DISTINCT CASE WHEN victim_tier IN {TIERS} THEN victim_tier END) AS q5b_tiers, min(victim_trades) AS q5b_least, min(total_volume) AS q5b_least_volume, round(sum(pct_of_trades), 4) AS q5b_trade_share, round(sum(pct_of_volume), 4) AS q5b_volume_share, count(DISTINCT cutoff_p50) AS q5b_p50, count(DISTINCT cutoff_p90) AS q5b_p90, sum(victim_trades) AS q5b_trades, round(sum(total_volume), 2) AS q5b_volume",
    "qp_protocols": f"count(*) AS qp_rows, count(CASE WHEN project = '{KNOWN_PROJECT}' THEN 1 END) AS qp_known, round(sum(total_volume_usd), 2) AS qp_volume, sum(victim_trade_count) AS qp_trades",
}
BOTH = "count(CASE WHEN a.bot_address IS NULL OR b.bot_address IS NULL THEN 1 END) AS set_differs, coalesce(max(abs(a.total_volume_usd - b.total_volume_usd)), 0) AS volume_differs"
#: Name, what is computed, and what must hold of it.
CHECKS = {
    "daily rows": ("q1_rows", "q1_rows > 0"), "dates unique": ("q1_days", "q1_days = q1_rows"), "dates dense": ("q1_days", "q1_days = q1_span + 1"), "daily volume positive": ("q1_volume", "q1_volume > 0"),
    "daily trades positive": ("q1_trades", "q1_trades > 0"), "bots on a day": ("round(q1_bots, 6)", "q1_bots > 0"), "distribution rows": ("q3_rows", "q3_rows > 0"), "addresses unique": ("q3_addresses", "q3_addresses = q3_rows"),
    "measured volumes": ("q3_measured", "q3_measured > 0"), "profile rows": ("q4_rows", "q4_rows > 0"), "same addresses": ("set_differs", "set_differs = 0"), "active days": ("q4_days", "q4_days >= 1"),
    "same volumes": ("round(volume_differs, 6)", "volume_differs < 0.01"), "one row of quantiles": ("q5a_rows", "q5a_rows = 1"), "quantiles present": ("q5a_points", "q5a_points = q5a_rows"), "quantiles ordered": ("q5a_order", "q5a_order = 1"),
    "quantiles between the ends": ("q5a_ends", "q5a_ends = 1"), "tier rows": ("q5b_rows", "q5b_rows >= 3"), "tiers present": ("q5b_tiers", "q5b_tiers = 3"), "tier trades positive": ("q5b_least", "q5b_least > 0"),
    "tier volumes positive": ("round(q5b_least_volume, 2)", "q5b_least_volume > 0"), "trade shares": ("q5b_trade_share", "abs(q5b_trade_share - 100) <= 0.05"), "volume shares": ("q5b_volume_share", "abs(q5b_volume_share - 100) <= 0.05"),
    "one median": ("q5b_p50", "q5b_p50 = 1"), "one ninth decile": ("q5b_p90", "q5b_p90 = 1"), "protocol rows": ("qp_rows", "qp_rows > 0"), "known project": ("qp_known", "qp_known > 0"), "protocol volume positive": ("qp_volume", "qp_volume > 0"),
    "volume, daily and by bot": ("round(q1_volume - q3_volume, 1)", "abs(q1_volume - q3_volume) <= 1"), "trades, daily and by bot": ("q1_trades - q4_trades", "q1_trades = q4_trades"), "events, quantiles and tiers": ("q5a_trades - q5b_trades", "q5a_trades = q5b_trades"),
    "events, tiers and protocols": ("q5b_trades - qp_trades", "q5b_trades = qp_trades"), "volume, tiers and protocols": ("round(q5b_volume - qp_volume, 1)", "abs(q5b_volume - qp_volume) <= 1"),
}
SQL_CHECKS = (
    "WITH " + ", ".join(f"{name} AS (SELECT * FROM ({ORACLE_SQL[name]}))" for name in SUMMED)
    + ", s AS (SELECT * FROM " + ", ".join(f"(SELECT {what.format(day=chr(39) + 'day' + chr(39) + ', ').replace('max(date), min(date)', 'min(date), max(date)')} FROM {name})" for name, what in SUMMED.items())
    + f", (SELECT {BOTH} FROM q3_bot_distribution a FULL JOIN q4_bot_profiles b ON a.bot_address = b.bot_address)) "
    + " UNION ALL ".join(f"SELECT '{name}' AS check_name, CAST({value} AS DOUBLE) + 0.0 AS computed, CASE WHEN {holds} THEN 'PASS' ELSE 'FAIL' END AS status FROM s" for name, (value, holds) in CHECKS.items())
)


@register(SQL_CHECKS)
def v01_named_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 33 checks of the products: rows, unique and dense keys, positive sums, equal sets, ordered quantiles, shares, constant cutoffs and totals that agree. Each product is read once, for one row of sums."""
    products = {"q1_daily_activity": q1_daily_activity, "q3_bot_distribution": q3_bot_distribution, "q4_bot_profiles": q4_bot_profiles, "q5a_break_points": q5a_break_points, "q5b_tier_impact": q5b_tier_impact, "qp_protocols": qp_protocols}
    own = {name: f(spark, sf_dir) for name, f in products.items()}
    one = lambda df, what: df.selectExpr(*split_expressions(what.format(day="")))
    sums = None
    for name, what in SUMMED.items():
        row = one(own[name], what)
        sums = row if sums is None else sums.crossJoin(row)  # rows of sums, one each
    both = own["q3_bot_distribution"].alias("a").join(own["q4_bot_profiles"].alias("b"), F.col("a.bot_address") == F.col("b.bot_address"), "full")
    sums = sums.crossJoin(both.selectExpr(*split_expressions(BOTH)))
    checks = F.explode(F.array(*[F.struct(F.lit(name).alias("check_name"), (F.expr(f"cast({value} as double)") + 0.0).alias("computed"), F.expr(f"CASE WHEN {holds} THEN 'PASS' ELSE 'FAIL' END").alias("status")) for name, (value, holds) in CHECKS.items()]))
    return sums.select(checks.alias("c")).select("c.*")


def split_expressions(what: str) -> list[str]:
    """A list of SQL expressions with aliases, cut at its outer commas."""
    out, depth = [""], 0
    for c in what:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]
