"""Incidence over the panel of candidate and attacked swaps (month, project, version, size bin).

The panel is the only thing that grows with the events; everything here works on its few thousand rows by the same grouped and
windowed plans, and no number is taken from a display string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import register
from .named import BINS, SQL_PANEL, SQL_RELATIONS, attack_panel, q5b_tier_impact

#: The normal quantile of Wilson's interval, stake and number of tests of the e-test, level of Hoeffding's bound.
Z, STAKE, TESTS, ALPHA = 1.959963984540054, 0.5, 80, 0.05
CANDIDATES, ATTACKED = "candidate_trade_events", "attacked_trade_events"


def sums() -> list[Column]:
    return [F.sum(CANDIDATES).alias("n"), F.sum(ATTACKED).alias("a")]


def bins(spark: SparkSession) -> DataFrame:
    """The eleven bins, in order, whether or not they occur."""
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, BINS))).alias("bin_order", "trade_size_bin"))


def by_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bin_order, trade_size_bin, n, a of every bin, 0 where none occurs."""
    rows = attack_panel(spark, sf_dir).groupBy("trade_size_bin").agg(*sums())
    zero = F.lit(0).cast("long")
    return bins(spark).join(rows, "trade_size_bin", "left").select("bin_order", "trade_size_bin", F.coalesce("n", zero).alias("n"), F.coalesce("a", zero).alias("a"))


SQL_BINS = f"""{SQL_PANEL}, dim AS (SELECT unnest(range(11)) AS bin_order, unnest({BINS}) AS trade_size_bin),
b AS (SELECT bin_order, trade_size_bin, coalesce(n, 0) AS n, coalesce(a, 0) AS a FROM dim LEFT JOIN (SELECT trade_size_bin, sum(candidate_trade_events) AS n, sum(attacked_trade_events) AS a FROM panel GROUP BY 1) USING (trade_size_bin))"""


@register(
    f"""WITH {SQL_BINS}, w AS (SELECT *, a / nullif(n, 0) AS p, {Z} AS z FROM b)
    SELECT CAST(bin_order AS INTEGER) AS bin_order, trade_size_bin, CAST(n AS BIGINT) AS candidates, CAST(a AS BIGINT) AS attacked, round(p * 100, 8) AS rate_pct,
        round(100 * (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 8) AS wilson_low_pct,
        round(100 * (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 8) AS wilson_high_pct FROM w"""
)
def x51_x52_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled rate of every size bin with Wilson's interval; NULL where a bin is empty."""
    n, a = F.nullif(F.col("n"), F.lit(0)), F.col("a")
    p, zz = a / n, Z * Z
    centre, spread, scale = p + zz / (2 * n), Z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)), 1 + zz / n
    return by_bin(spark, sf_dir).select(
        "bin_order", "trade_size_bin", F.col("n").alias("candidates"), F.col("a").alias("attacked"), F.round(p * 100, 8).alias("rate_pct"),
        F.round(100 * (centre - spread) / scale, 8).alias("wilson_low_pct"), F.round(100 * (centre + spread) / scale, 8).alias("wilson_high_pct"),
    )


@register(
    f"""WITH {SQL_BINS}, r AS (SELECT bin_order AS i, a * 1.0 / n AS p, lag(a * 1.0 / n) OVER (ORDER BY bin_order) AS before, count(*) OVER () AS k FROM b WHERE n > 0),
    t AS (SELECT max(p) AS top FROM r), peak AS (SELECT min(i) AS at, count(*) AS ties FROM r, t WHERE p = top)
    SELECT CAST(max(peak.at) AS INTEGER) AS peak_bin, max(ties) > 1 AS tied_peak, max(peak.at) > min(i) AND max(peak.at) < max(i) AS interior_peak, count(*) FILTER (p > before) AS rises, count(*) FILTER (p < before) AS falls,
        max(peak.at) > min(i) AND max(peak.at) < max(i) AND count(*) FILTER (p > before AND i <= peak.at) * 4 >= 3 * count(*) FILTER (before IS NOT NULL AND i <= peak.at)
        AND count(*) FILTER (p < before AND i > peak.at) * 4 >= 3 * count(*) FILTER (i > peak.at) AS inverted_u FROM r, peak"""
)
def x53_x54_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the rate peaks over size, how often it rises and falls, and whether it is broadly an inverted U: an interior peak with three
    quarters of the steps rising before it and falling after."""
    order = Window.orderBy("i")
    rows = by_bin(spark, sf_dir).where("n > 0").select(F.col("bin_order").alias("i"), (F.col("a") / F.col("n")).alias("p"))
    rows = rows.withColumn("before", F.lag("p").over(order)).withColumn("top", F.max("p").over(Window.partitionBy()))
    rows = rows.withColumn("at", F.min(F.when(F.col("p") == F.col("top"), F.col("i"))).over(Window.partitionBy()))
    inside = (F.max("at") > F.min("i")) & (F.max("at") < F.max("i"))
    step, up, down = F.col("before").isNotNull(), F.col("p") > F.col("before"), F.col("p") < F.col("before")
    left, right = F.col("i") <= F.col("at"), F.col("i") > F.col("at")
    return rows.agg(
        F.max("at").alias("peak_bin"), (F.count_if(F.col("p") == F.col("top")) > 1).alias("tied_peak"), inside.alias("interior_peak"), F.count_if(up).alias("rises"), F.count_if(down).alias("falls"),
        (inside & (F.count_if(up & left) * 4 >= 3 * F.count_if(step & left)) & (F.count_if(down & right) * 4 >= 3 * F.count_if(right))).alias("inverted_u"),
    )


#: The reference bin of contrasts: the largest trades, which always occur here.
REFERENCE = BINS[9]


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """month, trade_size_bin, n, a, and n0, a0 of the reference bin of the same month."""
    rows = attack_panel(spark, sf_dir).groupBy("month", "trade_size_bin").agg(*sums())
    same, reference = Window.partitionBy("month"), F.col("trade_size_bin") == REFERENCE
    at = lambda c: F.max(F.when(reference, F.col(c))).over(same).alias(f"{c}0")
    return rows.select("month", "trade_size_bin", "n", "a", at("n"), at("a")).where(~reference & F.col("n0").isNotNull())


SQL_MONTHLY = f"""{SQL_PANEL}, mb AS (SELECT month, trade_size_bin, sum(candidate_trade_events) AS n, sum(attacked_trade_events) AS a FROM panel GROUP BY 1, 2),
m AS (SELECT x.month, x.trade_size_bin, x.n, x.a, r.n AS n0, r.a AS a0 FROM mb x JOIN mb r ON r.month = x.month AND r.trade_size_bin = '{REFERENCE}' WHERE x.trade_size_bin <> '{REFERENCE}')"""


@register(f"WITH {SQL_MONTHLY} SELECT month, trade_size_bin, round(a * 1.0 / n - a0 * 1.0 / n0, 10) AS difference, CAST(sign(a * n0 - a0 * n) AS INTEGER) AS sign FROM m")
def x55_monthly_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of each bin less that of the reference bin, month by month; the sign comes from whole numbers."""
    exact = F.col("a").cast("decimal(19,0)") * F.col("n0") - F.col("a0").cast("decimal(19,0)") * F.col("n")
    return monthly(spark, sf_dir).select("month", "trade_size_bin", F.round(F.col("a") / F.col("n") - F.col("a0") / F.col("n0"), 10).alias("difference"), F.signum(exact).cast("int").alias("sign"))


@register(
    f"""WITH {SQL_MONTHLY}, e AS (SELECT trade_size_bin, direction, count(*) AS months, sum(ln(1 + {STAKE} * direction * (a * 1.0 / n - a0 * 1.0 / n0))) AS log_e FROM m, (VALUES (1), (-1)) t(direction) GROUP BY 1, 2)
    SELECT trade_size_bin, CAST(direction AS INTEGER) AS direction, months, round(log_e, 8) AS log_e_value, round(exp(-greatest(0, log_e)), 10) AS p_bound, round(least(1, {TESTS} * exp(-greatest(0, log_e))), 10) AS p_bonferroni FROM e"""
)
def x56_e_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-stake e-values of the monthly differences in both directions, the bounds on p that they give, and Bonferroni's."""
    d = F.col("a") / F.col("n") - F.col("a0") / F.col("n0")
    rows = monthly(spark, sf_dir).withColumn("d", d).withColumn("direction", F.explode(F.array(F.lit(1), F.lit(-1))))
    e = rows.groupBy("trade_size_bin", "direction").agg(F.count(F.lit(1)).alias("months"), F.sum(F.log1p(STAKE * F.col("direction") * F.col("d"))).alias("log_e"))
    p = F.exp(-F.greatest(F.lit(0.0), F.col("log_e")))
    return e.select("trade_size_bin", "direction", "months", F.round("log_e", 8).alias("log_e_value"), F.round(p, 10).alias("p_bound"), F.round(F.least(F.lit(1.0), TESTS * p), 10).alias("p_bonferroni"))


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with the reference bin's cell of the same month, project and version: n, a, n0, a0."""
    stratum, reference = Window.partitionBy("month", "project", "version"), F.col("trade_size_bin") == REFERENCE
    rows = attack_panel(spark, sf_dir).select("month", "project", "version", "trade_size_bin", F.col(CANDIDATES).alias("n"), F.col(ATTACKED).alias("a"))
    at = lambda c: F.max(F.when(reference, F.col(c))).over(stratum)
    return rows.withColumns({"n0": at("n"), "a0": at("a")}).where(~reference & F.col("n0").isNotNull())


SQL_MATCHED = f"""{SQL_PANEL}, c AS (SELECT month, project, version, trade_size_bin, candidate_trade_events AS n, attacked_trade_events AS a FROM panel),
m AS (SELECT x.*, r.n AS n0, r.a AS a0 FROM c x JOIN c r USING (month, project, version) WHERE r.trade_size_bin = '{REFERENCE}' AND x.trade_size_bin <> '{REFERENCE}')"""
SQL_DIFFERENCE = "(a * 1.0 / n - a0 * 1.0 / n0)"


@register(
    f"""WITH {SQL_MATCHED}, o AS (SELECT trade_size_bin, sum({SQL_DIFFERENCE} / (1.0 / n + 1.0 / n0)) / sum(1 / (1.0 / n + 1.0 / n0)) AS v FROM m GROUP BY 1),
    q AS (SELECT trade_size_bin, avg(d) AS v FROM (SELECT trade_size_bin, project, avg(d) AS d FROM (SELECT trade_size_bin, project, version, avg({SQL_DIFFERENCE}) AS d FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1),
    p AS (SELECT trade_size_bin, sum(a) * 1.0 / sum(n) - sum(a0) * 1.0 / sum(n0) AS v, count(*) AS cells, sum(n) AS n FROM m GROUP BY 1)
    SELECT trade_size_bin, round(o.v, 8) AS overlap_weighted, round(q.v, 8) AS equal_projects, round(p.v, 8) AS matched_pooled, cells AS matched_cells,
        round(p.n * 1.0 / (SELECT sum(n) FROM c WHERE c.trade_size_bin = o.trade_size_bin), 8) AS covered_share FROM o JOIN q USING (trade_size_bin) JOIN p USING (trade_size_bin)"""
)
def x57_x59_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences to the reference bin inside strata: weighted by overlap, averaged over versions then projects, and pooled; and what share of
    a bin's swaps lies in matched strata."""
    cells = matched(spark, sf_dir).withColumns({"d": F.col("a") / F.col("n") - F.col("a0") / F.col("n0"), "w": 1 / (1 / F.col("n") + 1 / F.col("n0"))})
    pooled = cells.groupBy("trade_size_bin").agg(
        F.round(F.sum(F.col("d") * F.col("w")) / F.sum("w"), 8).alias("overlap_weighted"), F.round(F.sum("a") / F.sum("n") - F.sum("a0") / F.sum("n0"), 8).alias("matched_pooled"),
        F.count(F.lit(1)).alias("matched_cells"), F.sum("n").alias("inside"),
    )
    equal = cells
    for keys in (["project", "version"], ["project"], []):
        equal = equal.groupBy("trade_size_bin", *keys).agg(F.avg("d").alias("d"))
    whole = attack_panel(spark, sf_dir).groupBy("trade_size_bin").agg(F.sum(CANDIDATES).alias("all"))
    rows = pooled.join(equal.select("trade_size_bin", F.round("d", 8).alias("equal_projects")), "trade_size_bin").join(whole, "trade_size_bin")
    return rows.withColumn("covered_share", F.round(F.col("inside") / F.col("all"), 8)).drop("inside", "all")


@register(f"WITH {SQL_PANEL} SELECT project, CAST(sum(candidate_trade_events) AS BIGINT) AS candidates FROM panel GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def x58_dominant_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project with the most candidates, the first by name among equals."""
    return attack_panel(spark, sf_dir).groupBy("project").agg(F.sum(CANDIDATES).alias("candidates")).orderBy(F.desc("candidates"), "project").limit(1)


@register(
    f"""WITH {SQL_MATCHED}, h AS (SELECT trade_size_bin, year(month) AS y, (month(month) + 5) // 6 AS half, sum(a) * 1.0 / sum(n) - sum(a0) * 1.0 / sum(n0) AS d FROM m GROUP BY 1, 2, 3),
    z AS (SELECT trade_size_bin, sign(d) AS s, lag(sign(d)) OVER (PARTITION BY trade_size_bin ORDER BY y, half) AS b FROM h WHERE d <> 0), n AS (SELECT trade_size_bin, count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS down, count(*) FILTER (d = 0) AS level FROM h GROUP BY 1)
    SELECT trade_size_bin, up AS halves_above, down AS halves_below, level AS halves_level, coalesce((SELECT count(*) FILTER (s <> b) FROM z WHERE z.trade_size_bin = n.trade_size_bin), 0) AS sign_reversals FROM n"""
)
def x60_half_year_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many half years a bin lies above and below the reference, and how often that turns; level ones are skipped."""
    halves = matched(spark, sf_dir).groupBy("trade_size_bin", F.year("month").alias("y"), F.expr("(month(month) + 5) div 6").alias("half"))
    rows = halves.agg((F.sum("a") / F.sum("n") - F.sum("a0") / F.sum("n0")).alias("d"))
    d = F.col("d")
    counts = rows.groupBy("trade_size_bin").agg(F.count_if(d > 0).alias("halves_above"), F.count_if(d < 0).alias("halves_below"), F.count_if(d == 0).alias("halves_level"))
    signs = rows.where(d != 0).select("trade_size_bin", F.signum(d).alias("s"), F.lag(F.signum(d)).over(Window.partitionBy("trade_size_bin").orderBy("y", "half")).alias("b"))
    turns = signs.groupBy("trade_size_bin").agg(F.count_if(F.col("s") != F.col("b")).alias("sign_reversals"))
    return counts.join(turns, "trade_size_bin", "left").withColumn("sign_reversals", F.coalesce("sign_reversals", F.lit(0).cast("long")))


@register(
    f"""WITH {SQL_PANEL}, k AS (SELECT project, version FROM panel GROUP BY 1, 2 HAVING count(DISTINCT trade_size_bin) = (SELECT count(DISTINCT trade_size_bin) FROM panel))
    SELECT trade_size_bin, CAST(sum(candidate_trade_events) AS BIGINT) AS candidates, CAST(sum(attacked_trade_events) AS BIGINT) AS attacked, round(sum(attacked_trade_events) * 100.0 / sum(candidate_trade_events), 8) AS rate_pct
    FROM panel SEMI JOIN k USING (project, version) GROUP BY 1"""
)
def x61_common_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over the strata that have every bin that occurs."""
    panel = attack_panel(spark, sf_dir)
    every = panel.agg(F.count_distinct("trade_size_bin").alias("all"))
    full = panel.groupBy("project", "version").agg(F.count_distinct("trade_size_bin").alias("k")).join(F.broadcast(every), F.col("k") == F.col("all"))
    rows = panel.join(full, ["project", "version"], "left_semi").groupBy("trade_size_bin").agg(*sums())
    return rows.select("trade_size_bin", F.col("n").alias("candidates"), F.col("a").alias("attacked"), F.round(F.col("a") * 100 / F.col("n"), 8).alias("rate_pct"))


@register(
    f"""WITH {SQL_MONTHLY}, g AS (SELECT trade_size_bin, count(*) AS t, avg({SQL_DIFFERENCE}) AS mean FROM m GROUP BY 1), h AS (SELECT *, sqrt(2 * ln(2 * count(*) OVER () / {ALPHA}) / t) AS r FROM g)
    SELECT trade_size_bin, t AS months, round(100 * mean, 8) AS mean_pp, round(100 * r, 8) AS half_width_pp, round(100 * greatest(-1, mean - r), 8) AS low_pp, round(100 * least(1, mean + r), 8) AS high_pp FROM h"""
)
def x62_hoeffding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean monthly difference with Hoeffding's simultaneous bound over all bins, cut to the possible range."""
    rows = monthly(spark, sf_dir).groupBy("trade_size_bin").agg(F.count(F.lit(1)).alias("t"), F.avg(F.col("a") / F.col("n") - F.col("a0") / F.col("n0")).alias("mean"))
    r = F.sqrt(2 * F.log(2 * F.count(F.lit(1)).over(Window.partitionBy()) / ALPHA) / F.col("t"))
    rows, mean, r = rows.withColumn("r", r), F.col("mean"), F.col("r")
    return rows.select(
        "trade_size_bin", F.col("t").alias("months"), F.round(100 * mean, 8).alias("mean_pp"), F.round(100 * r, 8).alias("half_width_pp"),
        F.round(100 * F.greatest(F.lit(-1.0), mean - r), 8).alias("low_pp"), F.round(100 * F.least(F.lit(1.0), mean + r), 8).alias("high_pp"),
    )


@register(
    f"""WITH {SQL_PANEL}, s AS (SELECT project, version, sum(candidate_trade_events) AS n, sum(attacked_trade_events) AS a FROM panel GROUP BY 1, 2)
    SELECT project, version, CAST(n AS BIGINT) AS candidates, CAST(a AS BIGINT) AS attacked, a = 0 AS zero_outcome, a = n AS all_outcome, round(n * 1.0 / sum(n) OVER (), 10) AS share FROM s"""
)
def x66_x73_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and attacks of every stratum, its share, and whether none or all of it is attacked."""
    rows = attack_panel(spark, sf_dir).groupBy("project", "version").agg(*sums())
    n, a = F.col("n"), F.col("a")
    return rows.select("project", "version", n.alias("candidates"), a.alias("attacked"), (a == 0).alias("zero_outcome"), (a == n).alias("all_outcome"), F.round(n / F.sum(n).over(Window.partitionBy()), 10).alias("share"))


@register(
    f"""WITH {SQL_PANEL}, k AS (SELECT project, version FROM panel GROUP BY 1, 2 HAVING sum(attacked_trade_events) > 0)
    SELECT count(*) AS cells, CAST(sum(candidate_trade_events) AS BIGINT) AS candidates, CAST(sum(attacked_trade_events) AS BIGINT) AS attacked FROM panel SEMI JOIN k USING (project, version)"""
)
def x74_attacked_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of the panel in strata with at least one attack."""
    panel = attack_panel(spark, sf_dir)
    hit = panel.groupBy("project", "version").agg(F.sum(ATTACKED).alias("hits")).where("hits > 0")
    return panel.join(hit, ["project", "version"], "left_semi").agg(F.count(F.lit(1)).alias("cells"), F.sum(CANDIDATES).alias("candidates"), F.sum(ATTACKED).alias("attacked"))


@register(
    f"""WITH {SQL_RELATIONS}, v AS (SELECT project, count(*) AS n, round(sum(amount_usd), 2) AS vol FROM victims WHERE amount_usd > 0 GROUP BY 1), t AS (SELECT sum(vol) / sum(n) AS pooled, sum(n) AS alln, sum(vol) AS allv FROM v)
    SELECT project, n AS victim_trades, round(n * 1.0 / alln, 8) AS trade_share, round(vol / allv, 8) AS volume_share, round(vol / n / pooled, 8) AS ratio_to_pooled_mean, vol / n >= 10 * pooled AS tenfold FROM v, t"""
)
def x75_protocol_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's shares, and its mean size against the pooled mean."""
    from .named import priced, relation

    rows = priced(relation(spark, sf_dir, "victims", ["project", "amount_usd"])).groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount_usd"), 2).alias("vol"))
    whole, n, vol = Window.partitionBy(), F.col("n"), F.col("vol")
    pooled = F.sum(vol).over(whole) / F.sum(n).over(whole)
    return rows.select(
        "project", n.alias("victim_trades"), F.round(n / F.sum(n).over(whole), 8).alias("trade_share"), F.round(vol / F.sum(vol).over(whole), 8).alias("volume_share"),
        F.round(vol / n / pooled, 8).alias("ratio_to_pooled_mean"), (vol / n >= 10 * pooled).alias("tenfold"),
    )


LEVELS = {"project": ["project"], "version": ["project", "version"], "size": ["trade_size_bin"], "month": ["month"]}


@register(
    f"WITH {SQL_PANEL}, x AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS level, concat_ws(' | ', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)}) AS key, sum(candidate_trade_events) AS n, sum(attacked_trade_events) AS a FROM panel GROUP BY 2" for k, cols in LEVELS.items())
    + ") SELECT level, key, CAST(n AS BIGINT) AS candidates, CAST(a AS BIGINT) AS attacked, round(a * 100.0 / n, 8) AS rate_pct FROM x"
)
def x81_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prevalence by project, version, size and month from one pass over the panel."""
    keys = F.array(*[F.struct(F.lit(k).alias("level"), F.concat_ws(" | ", *[F.col(c).cast("string") for c in cols]).alias("key")) for k, cols in LEVELS.items()])
    rows = attack_panel(spark, sf_dir).select(CANDIDATES, ATTACKED, F.explode(keys).alias("k")).groupBy("k.level", "k.key").agg(*sums())
    return rows.select("level", "key", F.col("n").alias("candidates"), F.col("a").alias("attacked"), F.round(F.col("a") * 100 / F.col("n"), 8).alias("rate_pct"))


@register(
    f"""WITH {SQL_PANEL}, s AS (SELECT project, sum(candidate_trade_events) AS n, sum(attacked_trade_events) AS a FROM panel GROUP BY 1)
    SELECT project, round(n * 1.0 / sum(n) OVER (), 10) AS candidate_share, round(a * 1.0 / sum(a) OVER (), 10) AS attack_share, round((a * 1.0 / sum(a) OVER ()) / (n * 1.0 / sum(n) OVER ()), 8) AS exposure_ratio FROM s"""
)
def x84_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's share of attacks over its share of candidates."""
    rows, whole = attack_panel(spark, sf_dir).groupBy("project").agg(*sums()), Window.partitionBy()
    n, a = F.col("n") / F.sum("n").over(whole), F.col("a") / F.sum("a").over(whole)
    return rows.select("project", F.round(n, 10).alias("candidate_share"), F.round(a, 10).alias("attack_share"), F.round(a / n, 8).alias("exposure_ratio"))


@register(
    f"""WITH {SQL_PANEL}, s AS (SELECT project, sum(candidate_trade_events) AS n FROM panel GROUP BY 1)
    SELECT CAST(sum(candidate_trade_events) AS BIGINT) AS candidates, CAST(sum(attacked_trade_events) AS BIGINT) AS attacked, round(sum(attacked_trade_events) * 100.0 / sum(candidate_trade_events), 8) AS pooled_rate_pct,
        count(DISTINCT month) AS months, (SELECT round(max(n) * 1.0 / sum(n), 8) FROM s) AS largest_project_share, (SELECT round(sum((n / t) * (n / t)), 8) FROM s, (SELECT sum(n) * 1.0 AS t FROM s)) AS project_hhi FROM panel"""
)
def x102_sample_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, pooled rate, months, and how concentrated candidates are over projects."""
    panel = attack_panel(spark, sf_dir)
    by_project = panel.groupBy("project").agg(F.sum(CANDIDATES).alias("n")).agg(
        F.round(F.max("n") / F.sum("n"), 8).alias("largest_project_share"), F.round(F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n")), 8).alias("project_hhi")
    )
    totals = panel.agg(
        F.sum(CANDIDATES).alias("candidates"), F.sum(ATTACKED).alias("attacked"), F.round(F.sum(ATTACKED) * 100 / F.sum(CANDIDATES), 8).alias("pooled_rate_pct"), F.count_distinct("month").alias("months")
    )
    return totals.crossJoin(F.broadcast(by_project))


SQL_TIERS = f"""{SQL_RELATIONS}, v AS (SELECT * FROM victims WHERE amount_usd > 0), breaks AS (SELECT quantile_disc(amount_usd, 0.5) AS q50, quantile_disc(amount_usd, 0.9) AS q90 FROM v),
t AS (SELECT CASE WHEN amount_usd < q50 THEN 'Retail' WHEN amount_usd < q90 THEN 'Small' ELSE 'Institutional' END AS victim_tier, count(*) AS n, count(DISTINCT taker) AS u, round(sum(amount_usd), 2) AS vol FROM v, breaks GROUP BY 1)"""


@register(
    f"""WITH {SQL_TIERS} SELECT a.victim_tier || '/' || b.victim_tier AS pair, round((a.n * 1.0 / a.u) / (b.n * 1.0 / b.u), 8) AS rate_ratio,
        round(exp(ln((a.n * 1.0 / a.u) / (b.n * 1.0 / b.u)) - 1.96 * sqrt(1.0 / a.n + 1.0 / b.n)), 8) AS low, round(exp(ln((a.n * 1.0 / a.u) / (b.n * 1.0 / b.u)) + 1.96 * sqrt(1.0 / a.n + 1.0 / b.n)), 8) AS high
    FROM t a JOIN t b ON (a.victim_tier, b.victim_tier) IN (('Small', 'Retail'), ('Institutional', 'Retail'), ('Institutional', 'Small'))"""
)
def x24_rate_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of attacks per address between tiers, with Poisson intervals."""
    rows = q5b_tier_impact(spark, sf_dir).select(F.col("victim_tier"), F.col("victim_trades").alias("n"), F.col("addresses_with_trade_in_tier").alias("u"))
    wanted = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in (("Small", "Retail"), ("Institutional", "Retail"), ("Institutional", "Small"))])).alias("p")).select("p.*")
    a, b = (rows.select(F.col("victim_tier").alias(k), F.col("n").alias(f"n{k}"), F.col("u").alias(f"u{k}")) for k in "xy")
    ratio, se = (F.col("nx") / F.col("ux")) / (F.col("ny") / F.col("uy")), F.sqrt(1 / F.col("nx") + 1 / F.col("ny"))
    edge = lambda s: F.round(F.exp(F.log(ratio) + s * 1.96 * se), 8)
    return wanted.join(a, "x").join(b, "y").select(F.concat_ws("/", "x", "y").alias("pair"), F.round(ratio, 8).alias("rate_ratio"), edge(-1).alias("low"), edge(1).alias("high"))


@register(
    f"""WITH {SQL_TIERS}, s AS (SELECT sum(n) AS nn, sum(vol) AS vv, sum(n * sqrt(vol / n)) AS rr FROM t)
    SELECT victim_tier, round(0.01 * vol, 2) AS proportional, round(n * 0.01 * vv / nn, 2) AS constant, round(n * sqrt(vol / n) * 0.01 * vv / rr, 2) AS square_root FROM t, s"""
)
def x27_loss_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses by tier under three models, each calibrated to one percent of all volume."""
    rows = q5b_tier_impact(spark, sf_dir).select("victim_tier", F.col("victim_trades").alias("n"), F.col("total_volume").alias("vol"))
    whole, n, vol = Window.partitionBy(), F.col("n"), F.col("vol")
    root = n * F.sqrt(vol / n)
    one = 0.01 * F.sum(vol).over(whole)
    return rows.select("victim_tier", F.round(0.01 * vol, 2).alias("proportional"), F.round(n * one / F.sum(n).over(whole), 2).alias("constant"), F.round(root * one / F.sum(root).over(whole), 2).alias("square_root"))


@register(
    f"""WITH {SQL_TIERS}, s AS (SELECT sum(n) AS nn, sum(vol) AS vv FROM t) SELECT round(sum(power(n - nn * vol / vv, 2) / (nn * vol / vv)), 4) AS chi_square, count(*) - 1 AS degrees FROM t, s"""
)
def x25_chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goodness of fit of attacks by tier to volume shares."""
    rows, whole = q5b_tier_impact(spark, sf_dir).select(F.col("victim_trades").alias("n"), F.col("total_volume").alias("vol")), Window.partitionBy()
    expected = F.sum("n").over(whole) * F.col("vol") / F.sum("vol").over(whole)
    return rows.select("n", expected.alias("e")).agg(F.round(F.sum(F.pow(F.col("n") - F.col("e"), 2) / F.col("e")), 4).alias("chi_square"), (F.count(F.lit(1)) - 1).alias("degrees"))


@register(f"WITH {SQL_TIERS} SELECT victim_tier, round(n / (vol / 1000), 8) AS attacks_per_1k, round(n * 1.0 / u, 8) AS attacks_per_address, round(sqrt(n) / u, 10) AS rate_se FROM t")
def x28_x109_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attacks for a thousand of volume and for an address, with the Poisson error of the latter."""
    n, u = F.col("victim_trades"), F.col("addresses_with_trade_in_tier")
    return q5b_tier_impact(spark, sf_dir).select("victim_tier", F.round(n / (F.col("total_volume") / 1000), 8).alias("attacks_per_1k"), F.round(n / u, 8).alias("attacks_per_address"), F.round(F.sqrt(n) / u, 10).alias("rate_se"))


@register(
    f"""WITH {SQL_MONTHLY}, e AS (SELECT trade_size_bin, exp(-greatest(0, sum(ln(1 + {STAKE} * {SQL_DIFFERENCE})))) AS p FROM m GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, trade_size_bin) AS i, count(*) OVER () AS k FROM e)
    SELECT trade_size_bin, round(p, 10) AS p, round(least(1, max((k - i + 1) * p) OVER (ORDER BY i)), 10) AS p_holm FROM r"""
)
def x50_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holm's step-down correction of a family of bounds on p."""
    rows = monthly(spark, sf_dir).groupBy("trade_size_bin").agg(F.exp(-F.greatest(F.lit(0.0), F.sum(F.log1p(STAKE * (F.col("a") / F.col("n") - F.col("a0") / F.col("n0")))))).alias("p"))
    return holm(rows, "p", "trade_size_bin")


def holm(rows: DataFrame, p: str, name: str) -> DataFrame:
    """name, p, p_holm for a family of tests, whose number is small."""
    order = Window.orderBy(p, name)
    numbered = rows.select(name, p, F.row_number().over(order).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("k"))
    return numbered.select(name, F.round(p, 10).alias("p"), F.round(F.least(F.lit(1.0), F.max((F.col("k") - F.col("i") + 1) * F.col(p)).over(Window.orderBy("i"))), 10).alias("p_holm"))
