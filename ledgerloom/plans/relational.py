"""Relational operators that the named products don't show by themselves: validated and full joins, periods against each other, set
operations, entity features and validation identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranks import interpolated
from ..operators.joins import unique_on
from ..registry import ORACLE_SQL, register
from ..sources.tables import LONGER, PRIMARY, SQL_RELATIONS, relation
from .concentration import SQL_WINDOW
from .named import SQL_PANEL, attack_panel, priced, q5b_tier_impact, qp_protocols


@register(
    f"""WITH {SQL_PANEL}, p AS (SELECT project, sum(attacked_trade_events) AS attacked FROM panel WHERE project <> 'Brand#11' GROUP BY 1), v AS (SELECT project, count(*) AS victims FROM victims WHERE amount_usd > 0 AND project <> 'Brand#12' GROUP BY 1)
    SELECT coalesce(p.project, v.project) AS project, CASE WHEN v.project IS NULL THEN 'panel_only' WHEN p.project IS NULL THEN 'protocol_only' ELSE 'both' END AS side,
        CAST(attacked AS BIGINT) AS attacked, victims, attacked >= victims AS covers FROM p FULL JOIN v ON p.project = v.project"""
)
def j06_j08_x77_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel against protocol counts by a full outer join that says which side a row is from; each side is unique by assertion."""
    panel = attack_panel(spark, sf_dir).where("project <> 'Brand#11'").groupBy("project").agg(F.sum("attacked_trade_events").alias("attacked"))
    victims = priced(relation(spark, sf_dir, "victims", ["project", "amount_usd"])).where("project <> 'Brand#12'").groupBy("project").agg(F.count(F.lit(1)).alias("victims"))
    rows = unique_on(panel, ["project"]).join(unique_on(victims, ["project"]), "project", "full")
    side = F.when(F.col("victims").isNull(), "panel_only").when(F.col("attacked").isNull(), "protocol_only").otherwise("both")
    return rows.select("project", side.alias("side"), "attacked", "victims", (F.col("attacked") >= F.col("victims")).alias("covers"))


@register(f"WITH {SQL_RELATIONS} SELECT tx_from AS sender, count(*) AS trades FROM victims WHERE tx_from IN (SELECT tx_from FROM attackers WHERE quantity >= 48) GROUP BY 1")
def j09_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swaps of senders that also act with large legs on the attacker side."""
    large = relation(spark, sf_dir, "attackers", ["tx_from", "quantity"]).where("quantity >= 48").select("tx_from")
    rows = relation(spark, sf_dir, "victims", ["tx_from"]).join(large, "tx_from", "left_semi")
    return rows.groupBy(F.col("tx_from").alias("sender")).agg(F.count(F.lit(1)).alias("trades"))


@register(
    f"""WITH {SQL_RELATIONS}, d AS (SELECT DISTINCT project, CAST(block_time AS DATE) AS day FROM victims WHERE amount_usd > 90000), s AS (SELECT DISTINCT project FROM d),
    c AS (SELECT CAST(unnest(generate_series(DATE '1997-01-01', DATE '1997-03-31', INTERVAL 1 DAY)) AS DATE) AS day) SELECT project, count(*) AS missing_days, min(day) AS first_missing FROM s CROSS JOIN c ANTI JOIN d USING (project, day) GROUP BY 1"""
)
def j10_v02_missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar days of a quarter on which a project has no large swap."""
    rows = relation(spark, sf_dir, "victims", ["project", "block_time", "amount_usd"]).where("amount_usd > 90000")
    days = rows.select("project", F.to_date("block_time").alias("day")).distinct()
    spine = days.select("project").distinct().withColumn("day", F.explode(F.expr("sequence(date'1997-01-01', date'1997-03-31')")))
    return spine.join(days, ["project", "day"], "left_anti").groupBy("project").agg(F.count(F.lit(1)).alias("missing_days"), F.min("day").alias("first_missing"))


def period_sql(name: str, window) -> str:
    return f"{name} AS (SELECT project, count(*) AS n, round(sum(amount_usd), 2) AS vol FROM victims WHERE amount_usd > 0 AND {SQL_WINDOW.format(window)} GROUP BY 1)"


@register(
    f"""WITH {SQL_RELATIONS}, {period_sql('a', PRIMARY)}, {period_sql('b', LONGER)}
    SELECT project, a.n AS primary_trades, b.n AS longer_trades, round(a.vol / a.n, 4) AS primary_mean, round(b.vol / b.n, 4) AS longer_mean, round(b.vol / b.n - a.vol / a.n, 4) AS change FROM a JOIN b USING (project)"""
)
def j11_x76_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary against the longer window, project by project."""

    def of(window, name: str) -> DataFrame:
        v = priced(relation(spark, sf_dir, "victims", ["project", "amount_usd"], window))
        return v.groupBy("project").agg(F.count(F.lit(1)).alias(f"{name}_trades"), F.round(F.sum("amount_usd"), 2).alias(f"{name}_volume"))

    mean = lambda n: F.col(f"{n}_volume") / F.col(f"{n}_trades")
    both = of(PRIMARY, "primary").join(of(LONGER, "longer"), "project")
    return both.select("project", "primary_trades", "longer_trades", F.round(mean("primary"), 4).alias("primary_mean"), F.round(mean("longer"), 4).alias("longer_mean"), F.round(mean("longer") - mean("primary"), 4).alias("change"))


@register(
    f"""WITH {SQL_PANEL}, r AS (SELECT version, sum(attacked_trade_events) * 1.0 / sum(candidate_trade_events) AS p FROM panel GROUP BY 1)
    SELECT a.version AS low, b.version AS high, round(b.p - a.p, 10) AS difference FROM r a JOIN r b ON a.version < b.version"""
)
def j12_pairwise_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of rates between all pairs of versions. Versions are a handful of labels; the pairs are the product that is asked for."""
    rates = attack_panel(spark, sf_dir).groupBy("version").agg((F.sum("attacked_trade_events") / F.sum("candidate_trade_events")).alias("p"))
    a, b = rates.select(F.col("version").alias("low"), F.col("p").alias("pa")), rates.select(F.col("version").alias("high"), F.col("p").alias("pb"))
    return a.join(F.broadcast(b), F.col("low") < F.col("high")).select("low", "high", F.round(F.col("pb") - F.col("pa"), 10).alias("difference"))


@register(
    f"""WITH {SQL_PANEL}, y AS (SELECT project, year(month) AS y, sum(attacked_trade_events) * 1.0 / sum(candidate_trade_events) AS p FROM panel WHERE year(month) IN (1997, 1998) GROUP BY 1, 2),
    j AS (SELECT a.project, a.p AS x, b.p AS y FROM y a JOIN y b ON a.project = b.project AND a.y = 1997 AND b.y = 1998), k AS (SELECT sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM j a JOIN j b ON a.project < b.project)
    SELECT round(sum(sx * sy) / sqrt(CAST(count(*) FILTER (sx <> 0) AS DOUBLE) * count(*) FILTER (sy <> 0)), 8) AS tau_b, count(*) AS pairs FROM k"""
)
def x83_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kendall's tau-b of projects' rates between two years; projects are few labels."""
    year = F.year("month")
    rate = lambda y: F.sum(F.when(year == y, F.col("attacked_trade_events"))) / F.sum(F.when(year == y, F.col("candidate_trade_events")))
    rates = attack_panel(spark, sf_dir).groupBy("project").agg(rate(1997).alias("x"), rate(1998).alias("y")).where("x is not null and y is not null")
    other = rates.select(F.col("project").alias("project2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = rates.join(F.broadcast(other), F.col("project") < F.col("project2")).select(F.signum(F.col("x") - F.col("x2")).alias("sx"), F.signum(F.col("y") - F.col("y2")).alias("sy"))
    return pairs.agg(F.round(F.sum(F.col("sx") * F.col("sy")) / F.sqrt(F.count_if(F.col("sx") != 0).cast("double") * F.count_if(F.col("sy") != 0)), 8).alias("tau_b"), F.count(F.lit(1)).alias("pairs"))


@register(
    f"""WITH {SQL_RELATIONS}, a AS (SELECT DISTINCT tx_from AS e FROM attackers WHERE quantity >= 48), v AS (SELECT DISTINCT tx_from AS e FROM victims WHERE quantity >= 48)
    SELECT 'union' AS operation, count(*) AS entities FROM (SELECT e FROM a UNION SELECT e FROM v) UNION ALL SELECT 'intersection', count(*) FROM (SELECT e FROM a INTERSECT SELECT e FROM v)
    UNION ALL SELECT 'attackers_only', count(*) FROM (SELECT e FROM a EXCEPT SELECT e FROM v) UNION ALL SELECT 'victims_only', count(*) FROM (SELECT e FROM v EXCEPT SELECT e FROM a)"""
)
def u03_u08_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and differences of two sets of senders from one grouping: which sides each sender stands on."""
    sides = [relation(spark, sf_dir, r, ["tx_from", "quantity"]).where("quantity >= 48").select("tx_from", F.lit(r == "attackers").alias("a"), F.lit(r == "victims").alias("v")) for r in ("attackers", "victims")]
    each = sides[0].unionAll(sides[1]).groupBy("tx_from").agg(F.max("a").alias("a"), F.max("v").alias("v"))
    a, v = F.col("a"), F.col("v")
    names = ["union", "intersection", "attackers_only", "victims_only"]
    row = each.agg(F.count(F.lit(1)).alias(names[0]), F.count_if(a & v).alias(names[1]), F.count_if(a & ~v).alias(names[2]), F.count_if(v & ~a).alias(names[3]))
    return row.unpivot([], names, "operation", "entities")


@register(
    f"""WITH {SQL_RELATIONS} SELECT project, string_agg(DISTINCT version, ';' ORDER BY version) AS versions, round(quantile_cont(amount_usd, 0.1), 4) AS p10, round(quantile_cont(amount_usd, 0.5), 4) AS p50, round(quantile_cont(amount_usd, 0.99), 4) AS p99
    FROM victims WHERE amount_usd > 0 GROUP BY 1"""
)
def a13_a23_group_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct versions of each project as one string, and linearly interpolated quantiles of its amounts."""
    v = priced(relation(spark, sf_dir, "victims", ["project", "version", "amount_usd"]))
    names = v.groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("version")), ";").alias("versions"))
    points = interpolated(v, "amount_usd", {"p10": "0.1", "p50": "0.5", "p99": "0.99"}, ("project",))
    return names.join(points, "project").select("project", "versions", *[F.round(p, 4).alias(p) for p in ("p10", "p50", "p99")])


@register(
    f"""WITH {SQL_RELATIONS} SELECT project, block_time::DATE AS day, amount_usd, tx_hash FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY amount_usd DESC, tx_hash, evt_index, block_time, quantity) AS i FROM victims WHERE amount_usd > 0) WHERE i = 1"""
)
def a24_first_after_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest swap of each project, with a stated order among equals: a maximum over structs, so no group is sorted."""
    v = priced(relation(spark, sf_dir, "victims", ["project", "block_time", "amount_usd", "tx_hash", "evt_index", "quantity"]))
    best = F.max(F.struct("amount_usd", (-F.col("tx_hash")).alias("h"), (-F.col("evt_index")).alias("e"), (-F.unix_seconds(F.col("block_time").cast("timestamp"))).alias("t"), (-F.col("quantity")).alias("q")))
    row = v.groupBy("project").agg(best.alias("b"))
    return row.select("project", F.to_date(F.timestamp_seconds(-F.col("b.t"))).alias("day"), "b.amount_usd", (-F.col("b.h")).alias("tx_hash"))


SQL_BOTS = f"""{SQL_RELATIONS}, b AS (SELECT tx_from AS entity, count(amount_usd) AS legs, round(sum(amount_usd), 2) AS volume, count(DISTINCT CAST(block_time AS DATE)) AS days,
    min(block_time) AS first_seen, max(block_time) AS last_seen FROM attackers WHERE amount_usd > 0 GROUP BY 1),
f AS (SELECT *, datediff('day', CAST(first_seen AS DATE), CAST(last_seen AS DATE)) + 1 AS lifespan, year(first_seen) || CASE WHEN month(first_seen) <= 6 THEN 'H1' ELSE 'H2' END AS cohort FROM b)"""


def bots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, legs, volume, days, first_seen, last_seen, lifespan, cohort (half year of the first leg) of every sender with priced legs."""
    legs = priced(relation(spark, sf_dir, "attackers", ["tx_from", "amount_usd", "block_time"]))
    rows = legs.groupBy(F.col("tx_from").alias("entity")).agg(
        F.count("amount_usd").alias("legs"), F.round(F.sum("amount_usd"), 2).alias("volume"), F.count_distinct(F.to_date("block_time")).alias("days"), F.min("block_time").alias("first_seen"), F.max("block_time").alias("last_seen")
    )
    half = F.concat(F.year("first_seen").cast("string"), F.when(F.month("first_seen") <= 6, "H1").otherwise("H2"))
    return rows.withColumns({"lifespan": F.datediff("last_seen", "first_seen") + 1, "cohort": half})


#: Days of activity from which an entity is persistent, and senders from which a taker looks like a router.
PERSISTENT_DAYS, ROUTER_SENDERS = 30, 1000


@register(f"WITH {SQL_BOTS} SELECT count(*) AS entities, round(count(*) FILTER (days = 1) * 1.0 / count(*), 8) AS single_day_share, round(sum(volume) FILTER (days >= {PERSISTENT_DAYS}) / sum(volume), 8) AS persistent_volume_share, round(avg(days * 1.0 / lifespan), 8) AS mean_intensity FROM f")
def x19_longevity(spark: SparkSession, sf_dir: str, persistent_days: int = PERSISTENT_DAYS) -> DataFrame:
    """Share of entities active on one day, share of volume of those active on thirty days or more (NULL if there are none), and mean activity over lifespan."""
    one, many = F.col("days") == 1, F.col("days") >= persistent_days
    return bots(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("entities"), F.round(F.count_if(one) / F.count(F.lit(1)), 8).alias("single_day_share"), F.round(F.sum(F.when(many, F.col("volume"))) / F.sum("volume"), 8).alias("persistent_volume_share"),
        F.round(F.avg(F.col("days") / F.col("lifespan")), 8).alias("mean_intensity"),
    )


@register(
    f"""WITH {SQL_BOTS}, l AS (SELECT ln(volume) AS v, ln(legs) AS n, ln(volume / legs) AS s FROM b)
    SELECT round(var_samp(v), 8) AS var_volume, round(var_samp(n), 8) AS var_legs, round(var_samp(s), 8) AS var_size, round(2 * covar_samp(n, s), 8) AS twice_covariance, round((var_samp(n) + var_samp(s) + 2 * covar_samp(n, s)) / var_samp(v), 8) AS total FROM l"""
)
def x20_variance_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance of log volume as that of log legs, of log size, and twice their covariance; on one base they add up."""
    rows = bots(spark, sf_dir).select(F.log("volume").alias("v"), F.log("legs").alias("n"), F.log(F.col("volume") / F.col("legs")).alias("s"))
    v, n, s, c = F.var_samp("v"), F.var_samp("n"), F.var_samp("s"), 2 * F.covar_samp("n", "s")
    return rows.agg(F.round(v, 8).alias("var_volume"), F.round(n, 8).alias("var_legs"), F.round(s, 8).alias("var_size"), F.round(c, 8).alias("twice_covariance"), F.round((n + s + c) / v, 8).alias("total"))


@register(
    f"""WITH {SQL_BOTS}, e AS (SELECT CAST(max(last_seen) AS DATE) AS day FROM f)
    SELECT cohort, count(*) AS entities, round(sum(volume) / sum(sum(volume)) OVER (), 8) AS volume_share, round(count(*) FILTER (datediff('day', CAST(last_seen AS DATE), (SELECT day FROM e)) <= 365) * 1.0 / count(*), 8) AS still_active FROM f GROUP BY 1"""
)
def x22_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by half year of their first leg: number, share of volume, and how many are seen in the last year of data."""
    rows = bots(spark, sf_dir)
    end = rows.agg(F.max("last_seen").alias("end"))
    alive = F.count_if(F.datediff("end", "last_seen") <= 365)
    each = rows.crossJoin(F.broadcast(end)).groupBy("cohort").agg(F.count(F.lit(1)).alias("entities"), F.sum("volume").alias("v"), alive.alias("alive"))
    return each.select("cohort", "entities", F.round(F.col("v") / F.sum("v").over(Window.partitionBy()), 8).alias("volume_share"), F.round(F.col("alive") / F.col("entities"), 8).alias("still_active"))


@register(
    f"""WITH {SQL_RELATIONS}, t AS (SELECT taker, count(*) AS n, count(DISTINCT tx_from) AS s FROM victims WHERE amount_usd > 0 GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, taker) AS i FROM t)
    SELECT CAST(sum(n) FILTER (i <= 30) AS BIGINT) AS top30_trades, round(sum(n) FILTER (i <= 30) * 1.0 / sum(n), 8) AS top30_share, count(*) FILTER (i <= 30 AND s >= {ROUTER_SENDERS}) AS many_senders, round(sum(s) FILTER (i <= 30) * 100.0 / sum(n) FILTER (i <= 30), 6) AS senders_per_100_trades FROM r"""
)
def x100_routers(spark: SparkSession, sf_dir: str, senders: int = ROUTER_SENDERS) -> DataFrame:
    """How far the thirty leading takers look like routers: their share, and how many senders stand behind them."""
    takers = priced(relation(spark, sf_dir, "victims", ["taker", "tx_from", "amount_usd"])).groupBy("taker").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tx_from").alias("s"))
    top = takers.orderBy(F.desc("n"), "taker").limit(30).agg(F.sum("n").alias("top30_trades"), F.sum("s").alias("s"), F.count_if(F.col("s") >= senders).alias("many_senders"))
    whole = takers.agg(F.sum("n").alias("all"))
    return top.crossJoin(F.broadcast(whole)).select("top30_trades", F.round(F.col("top30_trades") / F.col("all"), 8).alias("top30_share"), "many_senders", F.round(F.col("s") * 100 / F.col("top30_trades"), 6).alias("senders_per_100_trades"))


SQL_VALIDATION = f"""WITH t AS (SELECT * FROM ({ORACLE_SQL["q5b_tier_impact"]})), p AS (SELECT * FROM ({ORACLE_SQL["qp_protocols"]})), n AS (SELECT * FROM ({ORACLE_SQL["q5e_attack_rates"]})),
    c AS (SELECT 'tiers hold every victim swap' AS "check", (SELECT total_victim_trades FROM ({ORACLE_SQL["q5a_break_points"]})) AS expected, (SELECT sum(victim_trades) FROM t) AS computed, 0.0 AS tolerance
    UNION ALL SELECT 'protocols hold every victim swap', (SELECT total_victim_trades FROM ({ORACLE_SQL["q5a_break_points"]})), (SELECT sum(victim_trade_count) FROM p), 0.0
    UNION ALL SELECT 'tier shares add up to 100', 100, (SELECT sum(pct_of_trades) FROM t), 1e-7
    UNION ALL SELECT 'tiers and protocols hold the same volume', (SELECT sum(total_volume) FROM t), (SELECT sum(total_volume_usd) FROM p), 1e-9
    UNION ALL SELECT 'candidates are attacked or not', 0, (SELECT count(*) FROM n WHERE candidate_trade_events <> attacked_trade_events + unattacked_trade_events), 0.0
    UNION ALL SELECT 'no cell of the panel is repeated', 0, (SELECT count(*) FROM (SELECT 1 FROM n GROUP BY month, project, version, trade_size_bin HAVING count(*) > 1)), 0.0
    UNION ALL SELECT 'means are sums over counts', 0, (SELECT count(*) FROM n WHERE abs(avg_trade_size_usd * candidate_trade_events - candidate_volume_usd) > 0.0001 * candidate_trade_events + 0.01), 0.0
    UNION ALL SELECT 'one median cuts all tiers', 1, (SELECT count(DISTINCT cutoff_p50) FROM t), 0.0)
    SELECT "check", round(CAST(expected AS DOUBLE), 4) AS expected, round(CAST(computed AS DOUBLE), 4) AS computed, CASE WHEN abs(expected - computed) <= tolerance * greatest(1.0, abs(expected)) THEN 'PASS' ELSE 'FAIL' END AS status FROM c"""


@register(SQL_VALIDATION)
def v01_v08_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities that hold between products whatever the data: check, expected, computed, status."""
    tiers, protocols, panel = q5b_tier_impact(spark, sf_dir), qp_protocols(spark, sf_dir), attack_panel(spark, sf_dir)
    victims = priced(relation(spark, sf_dir, "victims", ["tx_hash", "evt_index", "amount_usd", "project"]))

    def check(name: str, expected: DataFrame, computed: DataFrame, tolerance: float = 0.0) -> DataFrame:
        e, c = expected.toDF("expected"), computed.toDF("computed")
        both = e.crossJoin(F.broadcast(c)).select(F.lit(name).alias("check"), F.col("expected").cast("double").alias("expected"), F.col("computed").cast("double").alias("computed"))
        close = F.abs(F.col("expected") - F.col("computed")) <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs("expected"))
        return both.withColumn("status", F.when(close, "PASS").otherwise("FAIL")).withColumns({c: F.round(c, 4) for c in ("expected", "computed")})

    n, zero = victims.agg(F.count(F.lit(1))), spark.range(1).select(F.lit(0))
    broken = panel.where("candidate_trade_events <> attacked_trade_events + unattacked_trade_events").agg(F.count(F.lit(1)))
    copies = panel.groupBy("month", "project", "version", "trade_size_bin").count().where("count > 1").agg(F.count(F.lit(1)))
    drift = panel.where("abs(avg_trade_size_usd * candidate_trade_events - candidate_volume_usd) > 0.0001 * candidate_trade_events + 0.01").agg(F.count(F.lit(1)))
    checks = [
        check("tiers hold every victim swap", n, tiers.agg(F.sum("victim_trades"))),
        check("protocols hold every victim swap", n, protocols.agg(F.sum("victim_trade_count"))),
        check("tier shares add up to 100", spark.range(1).select(F.lit(100)), tiers.agg(F.sum("pct_of_trades")), 1e-7),
        check("tiers and protocols hold the same volume", tiers.agg(F.sum("total_volume")), protocols.agg(F.sum("total_volume_usd")), 1e-9),
        check("candidates are attacked or not", zero, broken),
        check("no cell of the panel is repeated", zero, copies),
        check("means are sums over counts", zero, drift),
        check("one median cuts all tiers", spark.range(1).select(F.lit(1)), tiers.agg(F.count_distinct("cutoff_p50"))),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionAll(c)
    return out
