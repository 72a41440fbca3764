"""Audits, reconciliations and small derived measures over the named products: each works on a product's few rows, or on one aggregate of the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.formats import currency, percent, thousands
from ..functions.ranks import interpolated
from ..registry import ORACLE_SQL, register
from ..sources.tables import FULL, LONGER, PRIMARY, SQL_RELATIONS, relation
from .concentration import SQL_WINDOW
from .incidence import ATTACKED, CANDIDATES, SQL_BINS, SQL_TIERS, by_bin, sums
from .named import BINS, SQL_PANEL, TIERS, attack_panel, priced, q5b_legacy_tier_impact, q5b_tier_impact, q5d_size_distribution
from .timeseries import SQL_DAILY, daily

#: Chi-square's 99 % points at the lags of the residual test, and the size of autocorrelation that is flagged.
CHI_99 = {1: 6.6349, 7: 18.4753, 14: 29.1412, 28: 48.2782}
FLAG_ACF = 0.20
TIER_DIM = "(VALUES ('Retail', 1), ('Small', 2), ('Institutional', 3)) AS o(victim_tier, ordinal)"


def whole() -> WindowSpec:
    """All rows of a product, which are few."""
    return Window.partitionBy()


def ordinal(label: Column) -> Column:
    """The place of a tier in the order of size."""
    out = None
    for i, name in enumerate(TIERS, 1):
        out = F.when(label == name, i) if out is None else out.when(label == name, i)
    return out


def same(a: Column, b: Column, relative: float = 0.0) -> Column:
    return F.abs(a - b) <= F.lit(relative) * F.greatest(F.abs(a), F.abs(b))


def verdict(passes: Column) -> Column:
    return F.when(passes, "PASS").otherwise("FAIL")


SQL_SIZES = f"b AS (SELECT * FROM ({ORACLE_SQL['q5d_size_distribution']}))"


@register(
    f"""WITH {SQL_SIZES}, c AS (SELECT *, sum(trades_in_bin) OVER (PARTITION BY victim_tier ORDER BY pctile_in_tier) AS cum, sum(trades_in_bin) OVER (PARTITION BY victim_tier) AS n FROM b),
    q AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS q), h AS (SELECT *, row_number() OVER (PARTITION BY victim_tier, q ORDER BY pctile_in_tier) AS i FROM c, q WHERE cum >= q * n)
    SELECT victim_tier, CAST(q AS DOUBLE) AS q, round(lower_edge_usd + least(1, greatest(0, (q * n - (cum - trades_in_bin)) / greatest(trades_in_bin, 1))) * (upper_edge_usd - lower_edge_usd), 4) AS value FROM h WHERE i = 1"""
)
def a14_binned_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of each tier from its hundred binned masses, linear inside the bin."""
    w = Window.partitionBy("victim_tier")
    bins = q5d_size_distribution(spark, sf_dir).withColumns({"cum": F.sum("trades_in_bin").over(w.orderBy("pctile_in_tier")), "n": F.sum("trades_in_bin").over(w)})
    asked = bins.withColumn("q", F.explode(F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))))).where("cum >= q * n")
    inside = (F.col("q") * F.col("n") - (F.col("cum") - F.col("trades_in_bin"))) / F.greatest("trades_in_bin", F.lit(1))
    value = F.col("lower_edge_usd") + F.least(F.lit(1.0), F.greatest(F.lit(0.0), inside)) * (F.col("upper_edge_usd") - F.col("lower_edge_usd"))
    return asked.groupBy("victim_tier", "q").agg(F.round(F.min_by(value, "pctile_in_tier"), 4).alias("value"))


@register(
    f"""WITH {SQL_TIERS} SELECT victim_tier, CAST(ordinal AS INTEGER) AS ordinal, n AS victim_trades, CAST(sum(n) OVER (ORDER BY ordinal) AS BIGINT) AS trades_up_to, round(sum(vol) OVER (ORDER BY ordinal DESC) / sum(vol) OVER (), 8) AS volume_from
    FROM t JOIN {TIER_DIM} USING (victim_tier)"""
)
def p08_t07_ordinal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers in the order of size, which isn't that of their names, with trades up to and volume from each."""
    rows = q5b_tier_impact(spark, sf_dir).withColumn("ordinal", ordinal(F.col("victim_tier")))
    up, down = Window.orderBy("ordinal"), Window.orderBy(F.desc("ordinal"))
    return rows.select(
        "victim_tier", "ordinal", "victim_trades", F.sum("victim_trades").over(up).alias("trades_up_to"), F.round(F.sum("total_volume").over(down) / F.sum("total_volume").over(whole()), 8).alias("volume_from")
    ).orderBy("ordinal")


@register(
    f"""WITH {SQL_DAILY}, y AS (SELECT CAST(year(date) AS INTEGER) AS year, round(avg(volume), 4) AS mean_volume, round(avg(legs), 6) AS mean_legs FROM d GROUP BY 1)
    SELECT year, mean_volume, mean_legs, round((mean_volume / lag(mean_volume) OVER (ORDER BY year) - 1) * 100, 6) AS volume_growth_pct, round((mean_legs / lag(mean_legs) OVER (ORDER BY year) - 1) * 100, 6) AS legs_growth_pct FROM y"""
)
def x23_yearly_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of each year's days and their growth over the year before."""
    years = daily(spark, sf_dir).groupBy(F.year("date").alias("year")).agg(F.round(F.avg("volume"), 4).alias("mean_volume"), F.round(F.avg("legs"), 6).alias("mean_legs"))
    growth = lambda c: F.round((F.col(c) / F.lag(c).over(Window.orderBy("year")) - 1) * 100, 6)
    return years.withColumns({"volume_growth_pct": growth("mean_volume"), "legs_growth_pct": growth("mean_legs")})


@register(
    f"""WITH {SQL_TIERS}, r AS (SELECT n / (vol / 1000) AS d, vol / n AS m FROM t WHERE victim_tier = 'Retail'), i AS (SELECT n / (vol / 1000) AS d, vol / n AS m FROM t WHERE victim_tier = 'Institutional')
    SELECT round(r.d / i.d, 8) AS density_ratio, round(i.m / r.m, 8) AS inverse_mean_ratio, CASE WHEN abs(r.d / i.d - i.m / r.m) < 1e-4 THEN 'PASS' ELSE 'FAIL' END AS status FROM r, i"""
)
def x26_mechanical_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attacks for a thousand of volume are the inverse of the mean: the ratio of two tiers' densities must be that of their means turned round."""
    row = lambda t, k: q5b_tier_impact(spark, sf_dir).where(F.col("victim_tier") == t).select((F.col("victim_trades") / (F.col("total_volume") / 1000)).alias(f"d{k}"), (F.col("total_volume") / F.col("victim_trades")).alias(f"m{k}"))
    both = row("Retail", "r").crossJoin(F.broadcast(row("Institutional", "i")))
    a, b = F.col("dr") / F.col("di"), F.col("mi") / F.col("mr")
    return both.select(F.round(a, 8).alias("density_ratio"), F.round(b, 8).alias("inverse_mean_ratio"), verdict(F.abs(a - b) < 1e-4).alias("status"))


QUALITY_SQL = "count(*) AS rows, count(*) FILTER (amount_usd IS NULL) AS unpriced, count(*) FILTER (amount_usd = 0) AS zero, count(*) FILTER (amount_usd > 0) AS priced"


@register(
    f"""WITH {SQL_RELATIONS}, q AS (SELECT 'victims' AS side, {QUALITY_SQL} FROM victims UNION ALL SELECT 'attackers', {QUALITY_SQL} FROM attackers), p AS (SELECT CAST(sum(attacked_trade_events) AS BIGINT) AS n FROM (WITH {SQL_PANEL} SELECT * FROM panel))
    SELECT side, rows, round(unpriced * 1.0 / rows, 8) AS unpriced_share, round(zero * 1.0 / rows, 8) AS zero_share, round(priced * 1.0 / rows, 8) AS priced_share, n AS panel_attacked,
        CASE WHEN rows = unpriced + zero + priced THEN 'PASS' ELSE 'FAIL' END AS status FROM q, p"""
)
def x63_quality_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of unpriced, zero and priced rows on both sides, and the victims that another product, the panel, has."""
    def of(side: str) -> DataFrame:
        a = F.col("amount_usd")
        return relation(spark, sf_dir, side, ["amount_usd"]).agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("rows"), F.count_if(a.isNull()).alias("unpriced"), F.count_if(a == 0).alias("zero"), F.count_if(a > 0).alias("priced"))

    panel = attack_panel(spark, sf_dir).agg(F.sum(ATTACKED).alias("n"))
    share = lambda c: F.round(F.col(c) / F.col("rows"), 8).alias(f"{c}_share")
    return of("victims").unionByName(of("attackers")).crossJoin(F.broadcast(panel)).select(
        "side", "rows", share("unpriced"), share("zero"), share("priced"), F.col("n").alias("panel_attacked"),
        verdict(F.col("rows") == F.col("unpriced") + F.col("zero") + F.col("priced")).alias("status"),
    )


SQL_DENSITY = "0.01 / greatest(log10(greatest(upper_edge_usd, 1e-12)) - log10(greatest(lower_edge_usd, 1e-12)), 1e-9)"


@register(f"""WITH {SQL_SIZES} SELECT victim_tier, pctile_in_tier, mean_usd AS middle, round(0.3 * ({SQL_DENSITY}) / max({SQL_DENSITY}) OVER (PARTITION BY victim_tier), 8) AS width FROM b""")
def x93_equal_mass_violin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half widths of a violin of equal masses: a bin's mass over its logarithmic width, the widest of a tier being 0.3."""
    least = lambda c: F.log10(F.greatest(F.col(c), F.lit(1e-12)))
    density = F.lit(0.01) / F.greatest(least("upper_edge_usd") - least("lower_edge_usd"), F.lit(1e-9))
    w = Window.partitionBy("victim_tier")
    return q5d_size_distribution(spark, sf_dir).select("victim_tier", "pctile_in_tier", F.col("mean_usd").alias("middle"), F.round(0.3 * density / F.max(density).over(w), 8).alias("width"))


def described_sql(name: str, table: str, column: str) -> str:
    return f"""SELECT '{name}' AS series, count({column}) AS n, round(avg({column}), 4) AS mean, round(stddev_samp({column}), 4) AS sd, min({column}) AS least, round(quantile_cont({column}, 0.25), 4) AS q25,
        round(quantile_cont({column}, 0.5), 4) AS median, round(quantile_cont({column}, 0.75), 4) AS q75, max({column}) AS most FROM {table}"""


@register(
    f"""WITH {SQL_DAILY}, e AS (SELECT round(sum(amount_usd), 2) AS volume FROM attackers WHERE amount_usd > 0 GROUP BY tx_from), dd AS (SELECT volume, CAST(legs AS DOUBLE) AS legs FROM d)
    {described_sql('daily volume', 'dd', 'volume')} UNION ALL {described_sql('daily legs', 'dd', 'legs')} UNION ALL {described_sql('volume of an entity', 'e', 'volume')}"""
)
def x94_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, mean, deviation, extremes and quartiles of three series, a row each."""
    days = daily(spark, sf_dir)
    held = priced(relation(spark, sf_dir, "attackers", ["tx_from", "amount_usd"])).groupBy("tx_from").agg(F.round(F.sum("amount_usd"), 2).alias("x"))
    series = {"daily volume": days.select(F.col("volume").alias("x")), "daily legs": days.select(F.col("legs").cast("double").alias("x")), "volume of an entity": held.select("x")}
    rows = None
    for name, x in series.items():
        rows = x.withColumn("series", F.lit(name)) if rows is None else rows.unionByName(x.withColumn("series", F.lit(name)))
    plain = rows.groupBy("series").agg(F.count("x").alias("n"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_samp("x"), 4).alias("sd"), F.min("x").alias("least"), F.max("x").alias("most"))
    points = interpolated(rows, "x", {"q25": "0.25", "median": "0.5", "q75": "0.75"}, ("series",))
    return plain.join(points.select("series", *[F.round(p, 4).alias(p) for p in ("q25", "median", "q75")]), "series")


@register(
    f"""WITH {SQL_RELATIONS}, a AS (SELECT count(*) AS n, round(sum(amount_usd), 2) AS vol, count(DISTINCT taker) AS u FROM attackers), v AS (SELECT count(*) AS n, round(sum(amount_usd), 2) AS vol, count(DISTINCT tx_from) AS u FROM victims WHERE amount_usd > 0)
    SELECT a.n AS legs, v.n AS victim_trades, a.u AS leg_addresses, v.u AS victim_senders, round(a.vol / v.vol, 8) AS volume_ratio, round(a.n * 1.0 / v.n, 8) AS trade_ratio, round((a.vol - v.vol) / v.vol, 8) AS incremental_ratio FROM a, v"""
)
def x99_measurement_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attackers' base of measurement against the victims'."""
    a = relation(spark, sf_dir, "attackers", ["amount_usd", "taker"]).agg(F.count(F.lit(1)).alias("legs"), F.round(F.sum("amount_usd"), 2).alias("av"), F.count_distinct("taker").alias("leg_addresses"))
    v = priced(relation(spark, sf_dir, "victims", ["amount_usd", "tx_from"])).agg(F.count(F.lit(1)).alias("victim_trades"), F.round(F.sum("amount_usd"), 2).alias("vv"), F.count_distinct("tx_from").alias("victim_senders"))
    ratio = F.col("av") / F.col("vv")
    return a.crossJoin(F.broadcast(v)).select(
        "legs", "victim_trades", "leg_addresses", "victim_senders", F.round(ratio, 8).alias("volume_ratio"), F.round(F.col("legs") / F.col("victim_trades"), 8).alias("trade_ratio"), F.round((F.col("av") - F.col("vv")) / F.col("vv"), 8).alias("incremental_ratio")
    )


def in_window(month: Column, window) -> Column:
    return (month >= F.lit(window.start).cast("date")) & (month < F.lit(window.end).cast("date"))


def months_sql(window) -> str:
    return f"month >= DATE '{window.start}' AND month < DATE '{window.end}'"


@register(
    f"""WITH {SQL_PANEL}, x AS (SELECT * FROM panel WHERE {months_sql(LONGER)} AND month NOT IN (SELECT month FROM panel WHERE {months_sql(PRIMARY)}))
    SELECT trade_size_bin, CAST(count(DISTINCT month) AS BIGINT) AS months, CAST(sum(candidate_trade_events) AS BIGINT) AS candidates, CAST(sum(attacked_trade_events) AS BIGINT) AS attacked, round(sum(attacked_trade_events) * 100.0 / sum(candidate_trade_events), 8) AS rate_pct FROM x GROUP BY 1"""
)
def x103_extension_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by size over the months that only the longer window has."""
    panel = attack_panel(spark, sf_dir)
    inside = panel.where(in_window(F.col("month"), PRIMARY)).select("month").distinct()
    rows = panel.where(in_window(F.col("month"), LONGER)).join(inside, "month", "left_anti").groupBy("trade_size_bin").agg(F.count_distinct("month").alias("months"), *sums())
    return rows.select("trade_size_bin", "months", F.col("n").alias("candidates"), F.col("a").alias("attacked"), F.round(F.col("a") * 100 / F.col("n"), 8).alias("rate_pct"))


#: Methods and the observed fact that speaks against each.
METHODS = [("grouped logit with stratum effects", "zero_attack_strata"), ("ratio of rates", "zero_attack_strata"), ("cluster-robust covariance", "largest_share_pct"), ("conditional logit", "all_attacked_strata")]


@register(
    f"""WITH {SQL_PANEL}, s AS (SELECT project, version, sum(candidate_trade_events) AS n, sum(attacked_trade_events) AS a FROM panel GROUP BY 1, 2), p AS (SELECT project, sum(n) AS n FROM s GROUP BY 1),
    f AS (SELECT count(*) AS strata, count(*) FILTER (a = 0) AS zero_attack_strata, count(*) FILTER (a = n) AS all_attacked_strata, (SELECT round(max(n) * 100.0 / sum(n), 8) FROM p) AS largest_share_pct FROM s),
    m AS (SELECT unnest({[m for m, _ in METHODS]}) AS method, unnest({[k for _, k in METHODS]}) AS fact), o AS (SELECT *, CASE fact WHEN 'zero_attack_strata' THEN zero_attack_strata WHEN 'all_attacked_strata' THEN all_attacked_strata ELSE largest_share_pct END AS observed FROM m, f)
    SELECT method, fact, CAST(strata AS BIGINT) AS strata, CAST(observed AS DOUBLE) AS observed, CASE WHEN observed = 0 OR (fact = 'largest_share_pct' AND observed < 20) THEN 'applies' ELSE 'with care' END AS review FROM o"""
)
def x104_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods beside the observed fact that limits each."""
    strata = attack_panel(spark, sf_dir).groupBy("project", "version").agg(*sums())
    share = strata.groupBy("project").agg(F.sum("n").alias("n")).agg(F.round(F.max("n") * 100 / F.sum("n"), 8).alias("largest_share_pct"))
    facts = strata.agg(F.count(F.lit(1)).alias("strata"), F.count_if(F.col("a") == 0).alias("zero_attack_strata"), F.count_if(F.col("a") == F.col("n")).alias("all_attacked_strata")).crossJoin(F.broadcast(share))
    table = facts.withColumn("m", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(k).alias("fact")) for m, k in METHODS])))
    observed = F.coalesce(*[F.when(F.col("m.fact") == k, F.col(k).cast("double")) for k in ("zero_attack_strata", "all_attacked_strata", "largest_share_pct")])
    fine = (F.col("observed") == 0) | ((F.col("fact") == "largest_share_pct") & (F.col("observed") < 20))
    return table.select("m.method", "m.fact", "strata", observed.alias("observed")).withColumn("review", F.when(fine, "applies").otherwise("with care"))


@register(f"""WITH h AS ({ORACLE_SQL['x50_holm']}) SELECT trade_size_bin, p_holm, CASE WHEN p_holm < 0.01 THEN '***' WHEN p_holm < 0.05 THEN '**' WHEN p_holm < 0.10 THEN '*' ELSE '' END AS stars FROM h""")
def x108_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of significance at 1, 5 and 10 %."""
    from .incidence import x50_holm

    p = F.col("p_holm")
    return x50_holm(spark, sf_dir).select("trade_size_bin", "p_holm", F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("").alias("stars"))


@register(f"WITH {SQL_TIERS} SELECT victim_tier, round(n * 1.0 / u, 8) AS rate, round(n * 1.0 / u / sqrt(n), 8) AS bar, round(n * 1.0 / u * (1 - 1 / sqrt(n)), 8) AS low, round(n * 1.0 / u * (1 + 1 / sqrt(n)), 8) AS high FROM t")
def x109_poisson_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attacks for an address with the bar of its Poisson error, the rate over the root of its events."""
    n = F.col("victim_trades")
    rate, root = n / F.col("addresses_with_trade_in_tier"), 1 / F.sqrt(n)
    return q5b_tier_impact(spark, sf_dir).select("victim_tier", F.round(rate, 8).alias("rate"), F.round(rate * root, 8).alias("bar"), F.round(rate * (1 - root), 8).alias("low"), F.round(rate * (1 + root), 8).alias("high"))


def core_sql(name: str, where: str) -> str:
    return f"""SELECT '{name}' AS vintage, unnest(['trades', 'senders', 'volume', 'mean']) AS metric, unnest([CAST(count(*) AS DOUBLE), CAST(count(DISTINCT tx_from) AS DOUBLE), round(sum(amount_usd), 2), round(round(sum(amount_usd), 2) / count(*), 4)]) AS value
        FROM victims WHERE amount_usd > 0 AND {where}"""


@register(
    f"""WITH {SQL_RELATIONS}, l AS ({core_sql('all', SQL_WINDOW.format(FULL))} UNION ALL {core_sql('primary', SQL_WINDOW.format(PRIMARY))} UNION ALL {core_sql('longer', SQL_WINDOW.format(LONGER))})
    SELECT metric, max(value) FILTER (vintage = 'all') AS "all", max(value) FILTER (vintage = 'primary') AS "primary", max(value) FILTER (vintage = 'longer') AS longer, round((max(value) FILTER (vintage = 'longer') / max(value) FILTER (vintage = 'primary') - 1) * 100, 6) AS change_pct FROM l GROUP BY 1"""
)
def x110_three_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core metrics of three windows side by side: one-row frames, unpivoted, united and pivoted."""
    def of(name: str, window) -> DataFrame:
        v = priced(relation(spark, sf_dir, "victims", ["amount_usd", "tx_from"], window))
        row = v.agg(F.count(F.lit(1)).cast("double").alias("trades"), F.count_distinct("tx_from").cast("double").alias("senders"), F.round(F.sum("amount_usd"), 2).alias("volume"))
        row = row.withColumn("mean", F.round(F.col("volume") / F.col("trades"), 4)).withColumn("vintage", F.lit(name))
        return row.unpivot("vintage", ["trades", "senders", "volume", "mean"], "metric", "value")

    rows = of("all", FULL).unionByName(of("primary", PRIMARY)).unionByName(of("longer", LONGER))
    wide = rows.groupBy("metric").pivot("vintage", ["all", "primary", "longer"]).agg(F.max("value"))
    return wide.withColumn("change_pct", F.round((F.col("longer") / F.col("primary") - 1) * 100, 6))


@register(f"WITH {SQL_TIERS} SELECT CAST(i AS INTEGER) AS position, victim_tier, round(vol / n, 4) AS mean_usd, n AS victim_trades FROM t JOIN (VALUES ('Institutional', 0), ('Retail', 1)) AS o(victim_tier, i) USING (victim_tier)")
def x111_selected_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen tiers in a stated order; fails where one of them is missing."""
    return selected(q5b_tier_impact(spark, sf_dir), "victim_tier", ["Institutional", "Retail"]).select(
        "position", "victim_tier", F.round(F.col("total_volume") / F.col("victim_trades"), 4).alias("mean_usd"), "victim_trades"
    )


def selected(rows: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """The rows of the given labels with their position; an error if a label has none."""
    wanted = rows.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, labels))).alias("position", column))
    joined = wanted.join(rows.withColumn("_here", F.lit(True)), column, "left")
    missing = F.raise_error(F.concat(F.lit(f"no row of {column} "), F.col(column)))
    return joined.withColumn("position", F.when(F.col("_here"), F.col("position")).otherwise(missing.cast("int"))).drop("_here")


@register(
    f"""WITH {SQL_RELATIONS}, v AS (SELECT project, amount_usd / 1e7 AS x FROM victims WHERE amount_usd > 0) SELECT project, round(min(x), 10) AS least, count(*) FILTER (x < 0.01) AS sub_cent, min(x) > 0 AND min(x) < 0.01 AS sub_cent_minimum FROM v GROUP BY 1"""
)
def x112_sub_cent_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects whose smallest amount (in units of ten million) is positive and under a cent."""
    x = F.col("amount_usd") / 1e7
    rows = priced(relation(spark, sf_dir, "victims", ["project", "amount_usd"])).groupBy("project").agg(F.min(x).alias("m"), F.count_if(x < 0.01).alias("sub_cent"))
    return rows.select("project", F.round("m", 10).alias("least"), "sub_cent", ((F.col("m") > 0) & (F.col("m") < 0.01)).alias("sub_cent_minimum"))


@register(
    f"""WITH {SQL_BINS}, f AS (SELECT *, row_number() OVER (ORDER BY bin_order) AS i FROM b WHERE n > 0 AND a > 0 AND a < n), r AS (SELECT a * 1.0 / (n - a) AS odds, a, n FROM f WHERE i = 1)
    SELECT trade_size_bin, i = 1 AS reference, round(f.a * 1.0 / (f.n - f.a) / odds, 8) AS odds_ratio, CASE WHEN i = 1 THEN NULL ELSE round(exp(ln(f.a * 1.0 / (f.n - f.a) / odds) - 1.96 * sqrt(1.0 / f.a + 1.0 / (f.n - f.a) + 1.0 / r.a + 1.0 / (r.n - r.a))), 8) END AS low,
        CASE WHEN i = 1 THEN NULL ELSE round(exp(ln(f.a * 1.0 / (f.n - f.a) / odds) + 1.96 * sqrt(1.0 / f.a + 1.0 / (f.n - f.a) + 1.0 / r.a + 1.0 / (r.n - r.a))), 8) END AS high FROM f, r"""
)
def x113_bin_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odds of every size bin over those of the first, which is 1 by definition and has no interval."""
    rows = by_bin(spark, sf_dir).where("n > 0 and a > 0 and a < n")
    first = rows.agg(F.min_by(F.struct("bin_order", "n", "a"), "bin_order").alias("r"))
    n, a, rn, ra = F.col("n"), F.col("a"), F.col("r.n"), F.col("r.a")
    ratio, se = (a / (n - a)) / (ra / (rn - ra)), F.sqrt(1 / a + 1 / (n - a) + 1 / ra + 1 / (rn - ra))
    mine = F.col("bin_order") == F.col("r.bin_order")
    edge = lambda s: F.when(~mine, F.round(F.exp(F.log(ratio) + s * 1.96 * se), 8))
    return rows.crossJoin(F.broadcast(first)).select("trade_size_bin", mine.alias("reference"), F.round(ratio, 8).alias("odds_ratio"), edge(-1).alias("low"), edge(1).alias("high"))


def concentration_sql(name: str, window) -> str:
    return f"{name} AS (SELECT project, count(*) AS n, round(sum(amount_usd), 2) AS vol FROM victims WHERE amount_usd > 0 AND {SQL_WINDOW.format(window)} GROUP BY 1)"


@register(
    f"""WITH {SQL_RELATIONS}, {concentration_sql('p', FULL)}, s AS (SELECT *, n * 1.0 / sum(n) OVER () AS ns, vol / sum(vol) OVER () AS vs, row_number() OVER (ORDER BY n DESC, project) AS i FROM p)
    SELECT count(*) AS projects, round(10000 * sum(ns * ns), 4) AS trades_hhi, round(10000 * sum(vs * vs), 4) AS volume_hhi, round(sum(ns) FILTER (i <= 1), 8) AS top1_share, round(sum(ns) FILTER (i <= 4), 8) AS top4_share, round(sum(vol) / sum(n), 4) AS pooled_mean, round(median(n), 4) AS median_trades FROM s"""
)
def x73_x75_project_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How concentrated victims are over projects: Herfindahl by trades and by volume, leading shares, pooled mean, median."""
    v = priced(relation(spark, sf_dir, "victims", ["project", "amount_usd"])).groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount_usd"), 2).alias("vol"))
    s = v.select("*", (F.col("n") / F.sum("n").over(whole())).alias("ns"), (F.col("vol") / F.sum("vol").over(whole())).alias("vs"), F.row_number().over(Window.orderBy(F.desc("n"), "project")).alias("i"))
    top = lambda k: F.round(F.sum(F.when(F.col("i") <= k, F.col("ns"))), 8).alias(f"top{k}_share")
    square = lambda c: F.round(10000 * F.sum(F.col(c) * F.col(c)), 4)
    return s.agg(F.count(F.lit(1)).alias("projects"), square("ns").alias("trades_hhi"), square("vs").alias("volume_hhi"), top(1), top(4), F.round(F.sum("vol") / F.sum("n"), 4).alias("pooled_mean"), F.round(F.median("n"), 4).alias("median_trades"))


#: A project's mean counts as far above the pooled one from this many times on.
FAR_ABOVE = 10


@register(
    f"""WITH {SQL_RELATIONS}, {concentration_sql('p', PRIMARY)}, {concentration_sql('l', LONGER)}, pm AS (SELECT round(sum(vol) / sum(n), 4) AS m FROM p), lm AS (SELECT round(sum(vol) / sum(n), 4) AS m FROM l),
    j AS (SELECT l.project, p.n AS pn, l.n AS ln, p.vol / p.n AS a, l.vol / l.n AS b FROM l LEFT JOIN p USING (project)), r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM j WHERE pn IS NOT NULL)
    SELECT (SELECT count(*) FROM j) AS projects, (SELECT count(*) FROM j WHERE pn IS NULL) AS new_projects, round(corr(ra, rb), 8) AS rank_correlation, (SELECT count(*) FROM j, pm, lm WHERE a >= {FAR_ABOVE} * pm.m AND b >= {FAR_ABOVE} * lm.m) AS above_in_both FROM r"""
)
def x76_cross_window(spark: SparkSession, sf_dir: str, factor: float = FAR_ABOVE) -> DataFrame:
    """Means by project in the nested windows: rank correlation with average ties, new projects, and those at least factor times the pooled mean in both."""
    def of(window, k: str) -> DataFrame:
        v = priced(relation(spark, sf_dir, "victims", ["project", "amount_usd"], window)).groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount_usd"), 2).alias("vol"))
        pooled = F.round(F.sum("vol").over(whole()) / F.sum("n").over(whole()), 4)
        return v.select("project", (F.col("vol") / F.col("n")).alias(k), pooled.alias(f"{k}_pooled"))

    rows = of(LONGER, "b").join(of(PRIMARY, "a"), "project", "left")
    ties = lambda c: F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2.0
    common = rows.where("a is not null").select(ties("a").alias("ra"), ties("b").alias("rb")).agg(F.round(F.corr("ra", "rb"), 8).alias("rank_correlation"))
    counts = rows.agg(F.count(F.lit(1)).alias("projects"), F.count_if(F.col("a").isNull()).alias("new_projects"), F.count_if((F.col("a") >= factor * F.col("a_pooled")) & (F.col("b") >= factor * F.col("b_pooled"))).alias("above_in_both"))
    return counts.crossJoin(F.broadcast(common))


SQL_RESIDUALS = f"""{SQL_DAILY}, y AS (SELECT date, t, ln(1 + volume) AS y FROM d), fit AS (SELECT regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM y),
e AS (SELECT t, y - a - b * t AS e FROM y, fit), sq AS (SELECT sum(e * e) AS ss, count(*) AS n FROM e), k AS (SELECT unnest(range(1, 29)) AS k),
c AS (SELECT k, sum(x.e * z.e) / min(ss) AS r, min(n) AS n FROM k JOIN e x ON true JOIN e z ON z.t = x.t - k, sq GROUP BY k),
q AS (SELECT k, r, n, n * (n + 2) * sum(r * r / (n - k)) OVER (ORDER BY k) AS q FROM c), w AS (SELECT unnest({list(CHI_99)}) AS k, unnest({list(CHI_99.values())}) AS point)"""


@register(f"WITH {SQL_RESIDUALS} SELECT CAST(k AS INTEGER) AS lag, round(r, 8) AS acf, round(q, 4) AS ljung_box, abs(r) >= {FLAG_ACF} AS acf_flag, q > point AS ljung_box_flag FROM q JOIN w USING (k)")
def x42_x43_residual_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelation of what a trend leaves of log volume, and Ljung-Box's statistic, at lags 1, 7, 14 and 28; flagged where they are large (p under 1 %)."""
    y = daily(spark, sf_dir).select("t", F.log1p("volume").alias("y"))
    fit = y.agg(F.regr_slope("y", "t").alias("b"), F.regr_intercept("y", "t").alias("a"))
    e = y.crossJoin(F.broadcast(fit)).select("t", (F.col("y") - F.col("a") - F.col("b") * F.col("t")).alias("e"))
    lags = range(1, max(CHI_99) + 1)
    along = Window.orderBy("t")
    moved = e.select("e", *[F.lag("e", k).over(along).alias(f"e{k}") for k in lags])
    r = moved.agg(F.count(F.lit(1)).alias("n"), *[(F.sum(F.col("e") * F.col(f"e{k}")) / F.sum(F.col("e") * F.col("e"))).alias(f"r{k}") for k in lags])
    part = lambda h: F.col("n") * (F.col("n") + 2) * sum((F.col(f"r{k}") * F.col(f"r{k}") / (F.col("n") - k) for k in range(1, h + 1)), F.lit(0.0))
    rows = r.select(F.explode(F.array(*[F.struct(F.lit(h).alias("lag"), F.col(f"r{h}").alias("r"), part(h).alias("q"), F.lit(point).alias("point")) for h, point in CHI_99.items()])).alias("x")).select("x.*")
    return rows.select("lag", F.round("r", 8).alias("acf"), F.round("q", 4).alias("ljung_box"), (F.abs("r") >= FLAG_ACF).alias("acf_flag"), (F.col("q") > F.col("point")).alias("ljung_box_flag"))


@register(
    f"""WITH {SQL_PANEL}, s AS (SELECT project, sum(candidate_trade_events) AS n, sum(attacked_trade_events) AS a FROM panel GROUP BY 1), q AS (SELECT project, n, a * 1.0 / n AS p FROM s WHERE n > 0)
    SELECT project, CAST(n AS BIGINT) AS candidates, round(p, 8) AS rate, round(sqrt(p * (1 - p) / n), 10) AS se, round((1.959963984540054 + 0.8416212335729143) * sqrt(p * (1 - p) / n), 10) AS detectable_80, round((1.959963984540054 + 1.2815515655446004) * sqrt(p * (1 - p) / n), 10) AS detectable_90 FROM q"""
)
def x87_detectable_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest difference in rate that a test at 5 % finds with power 80 and 90 %, by project, from normal quantiles."""
    p, n = F.col("a") / F.col("n"), F.col("n")
    se = F.sqrt(p * (1 - p) / n)
    rows = attack_panel(spark, sf_dir).groupBy("project").agg(*sums()).where("n > 0")
    least = lambda power: F.round((1.959963984540054 + power) * se, 10)
    return rows.select("project", F.col("n").alias("candidates"), F.round(p, 8).alias("rate"), F.round(se, 10).alias("se"), least(0.8416212335729143).alias("detectable_80"), least(1.2815515655446004).alias("detectable_90"))


SQL_NESTED = f"SELECT month, sum(candidate_trade_events) AS n, sum(attacked_trade_events) AS a, round(sum(candidate_volume_usd), 2) AS vol FROM panel WHERE"


@register(
    f"""WITH {SQL_PANEL}, a AS ({SQL_NESTED} {months_sql(PRIMARY)} GROUP BY 1), b AS ({SQL_NESTED} {months_sql(LONGER)} GROUP BY 1)
    SELECT a.month, CAST(a.n AS BIGINT) AS candidates, CAST(a.a AS BIGINT) AS attacked, CASE WHEN a.n = b.n AND a.a = b.a AND abs(a.vol - b.vol) <= 1e-12 * greatest(abs(a.vol), abs(b.vol)) THEN 'PASS' ELSE 'FAIL' END AS status FROM a LEFT JOIN b USING (month)"""
)
def v05_nested_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month of the primary window must be the same in the longer one."""
    panel = attack_panel(spark, sf_dir)

    def of(window, k: str) -> DataFrame:
        rows = panel.where(in_window(F.col("month"), window)).groupBy("month").agg(*sums(), F.round(F.sum("candidate_volume_usd"), 2).alias("vol"))
        return rows.select("month", *[F.col(c).alias(f"{k}_{c}") for c in ("n", "a", "vol")])

    both = of(PRIMARY, "p").join(of(LONGER, "l"), "month", "left")
    equal = (F.col("p_n") == F.col("l_n")) & (F.col("p_a") == F.col("l_a")) & same(F.col("p_vol"), F.col("l_vol"), 1e-12)
    return both.select("month", F.col("p_n").alias("candidates"), F.col("p_a").alias("attacked"), verdict(equal).alias("status"))


@register(
    f"""WITH {SQL_TIERS}, r AS (SELECT round(n * 100.0 / sum(n) OVER (), 2) AS share, count(*) OVER () AS k FROM t), x AS (SELECT sum(share) AS s, min(k) AS k FROM r)
    SELECT round(s, 2) AS sum_of_rounded, round(0.5 * 0.01 * k, 4) AS allowance, CASE WHEN abs(s - 100) <= 0.5 * 0.01 * k + 1e-9 THEN 'PASS' ELSE 'FAIL' END AS status FROM x"""
)
def v07_rounded_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares rounded to two places may miss 100 by half a place each."""
    rows = q5b_tier_impact(spark, sf_dir).select(F.round(F.col("victim_trades") * 100 / F.sum("victim_trades").over(whole()), 2).alias("share"))
    x = rows.agg(F.sum("share").alias("s"), F.count(F.lit(1)).alias("k"))
    allowance = 0.5 * 0.01 * F.col("k")
    return x.select(F.round("s", 2).alias("sum_of_rounded"), F.round(allowance, 4).alias("allowance"), verdict(F.abs(F.col("s") - 100) <= allowance + 1e-9).alias("status"))


@register(
    f"""WITH {SQL_RELATIONS}, v AS (SELECT count(*) AS n, count(*) FILTER (amount_usd > 0) AS p FROM victims), e AS (SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber < 6 AND l_extendedprice > 0 AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '2002-01-01')
    SELECT CASE WHEN p > 0 THEN e.n END AS expected, p AS computed, CASE WHEN p = 0 THEN NULL WHEN e.n = p THEN 'PASS' ELSE 'FAIL' END AS status, v.n <= 9007199254740991 AS exact FROM v, e"""
)
def v06_v09_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of priced victims against one counted on the table beneath, NULL where nothing is priced; and whether counts are exact as doubles."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where((F.col("l_returnflag") == "R") & (F.col("l_linenumber") < 6) & (F.col("l_extendedprice") > 0) & FULL.holds(F.col("l_shipdate")))
    expected = lines.agg(F.count(F.lit(1)).alias("e"))
    v = relation(spark, sf_dir, "victims", ["amount_usd"]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("amount_usd") > 0).alias("computed"))
    known = F.col("computed") > 0
    return v.crossJoin(F.broadcast(expected)).select(F.when(known, F.col("e")).alias("expected"), "computed", F.when(known, verdict(F.col("e") == F.col("computed"))).alias("status"), (F.col("n") <= (1 << 53) - 1).alias("exact"))


@register(
    f"""WITH q AS ({ORACLE_SQL['q5b_tier_impact']}), l AS ({ORACLE_SQL['q5b_legacy_tier_impact']})
    SELECT q.victim_tier, q.min_tx AS least, q.max_tx AS most, q.cutoff_p50, q.cutoff_p90, l.victim_trades AS trades_by_fixed_cutoffs, CASE WHEN q.victim_tier = 'Retail' AND q.max_tx < q.cutoff_p50 OR q.victim_tier = 'Small' AND q.min_tx >= q.cutoff_p50 AND q.max_tx < q.cutoff_p90
        OR q.victim_tier = 'Institutional' AND q.min_tx >= q.cutoff_p90 THEN 'PASS' ELSE 'FAIL' END AS status FROM q LEFT JOIN l USING (victim_tier)"""
)
def v10_tier_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tier's amounts must lie inside its cutoffs; beside it, how many the fixed cutoffs put there."""
    fixed = q5b_legacy_tier_impact(spark, sf_dir).select("victim_tier", F.col("victim_trades").alias("trades_by_fixed_cutoffs"))
    t, low, high = F.col("victim_tier"), F.col("cutoff_p50"), F.col("cutoff_p90")
    inside = ((t == TIERS[0]) & (F.col("most") < low)) | ((t == TIERS[1]) & (F.col("least") >= low) & (F.col("most") < high)) | ((t == TIERS[2]) & (F.col("least") >= high))
    rows = q5b_tier_impact(spark, sf_dir).select("victim_tier", F.col("min_tx").alias("least"), F.col("max_tx").alias("most"), "cutoff_p50", "cutoff_p90")
    return rows.join(fixed, "victim_tier", "left").withColumn("status", verdict(inside))


@register(
    f"""WITH {SQL_TIERS} SELECT max(CASE WHEN victim_tier = 'Retail' THEN n END) AS retail, max(CASE WHEN victim_tier = 'Small' THEN n END) AS small, max(CASE WHEN victim_tier = 'Institutional' THEN n END) AS institutional,
        round(max(CASE WHEN victim_tier = 'Institutional' THEN vol END) / max(CASE WHEN victim_tier = 'Retail' THEN vol END), 6) AS volume_ratio FROM t"""
)
def p14_p18_tiers_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tiers, recoded to lower case and pivoted to columns."""
    rows = q5b_tier_impact(spark, sf_dir).select(F.lower("victim_tier").alias("tier"), "victim_trades", "total_volume")
    wide = rows.groupBy().pivot("tier", ["retail", "small", "institutional"]).agg(F.max("victim_trades").alias("n"), F.max("total_volume").alias("v"))
    return wide.select(*[F.col(f"{t}_n").alias(t) for t in ("retail", "small", "institutional")], F.round(F.col("institutional_v") / F.col("retail_v"), 6).alias("volume_ratio"))


@register(
    """SELECT p_brand AS project, lower(p_brand) AS lowered, regexp_replace(p_brand, '[^0-9]+', '', 'g') AS digits, substr(p_brand, 1, 3) AS prefix, starts_with(p_brand, 'Brand#1') AS first_ten, contains(p_brand, '#2') AS twenties, trim('  ' || p_brand || ' ') AS trimmed,
        format('{:,}', sum(p_size) * 1000) AS thousands, format('${:,.2f}', round(sum(p_retailprice), 2)) AS dollars, format('{:.2f}%', round(avg(p_size), 2)) AS pct, strftime(min(DATE '1997-01-31' + CAST(p_size AS INTEGER)), '%Y-%m') AS month FROM part GROUP BY 1"""
)
def f04_f11_f13_p12_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels taken apart, and numbers and dates as a report writes them."""
    b = F.col("p_brand")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").agg(F.sum("p_size").alias("s"), F.round(F.sum("p_retailprice"), 2).alias("v"), F.round(F.avg("p_size"), 2).alias("m"), F.min("p_size").alias("l"))
    return rows.select(
        b.alias("project"), F.lower(b).alias("lowered"), F.regexp_replace(b, "[^0-9]+", "").alias("digits"), F.substring(b, 1, 3).alias("prefix"), b.startswith("Brand#1").alias("first_ten"), b.contains("#2").alias("twenties"), F.trim(F.concat(F.lit("  "), b, F.lit(" "))).alias("trimmed"),
        thousands(F.col("s") * 1000).alias("thousands"), currency(F.col("v")).alias("dollars"), percent(F.col("m")).alias("pct"), F.date_format(F.date_add(F.lit("1997-01-31").cast("date"), F.col("l").cast("int")), "yyyy-MM").alias("month"),
    )


@register(
    f"""WITH {SQL_PANEL}, m AS (SELECT month, sum(candidate_trade_events) AS n FROM panel WHERE {months_sql(PRIMARY)} GROUP BY 1), c AS (SELECT CAST(unnest(generate_series(DATE '{PRIMARY.start}', DATE '{PRIMARY.end}' - INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS DATE) AS month)
    SELECT count(*) AS months_expected, count(m.month) AS months_present, count(*) = count(m.month) AS complete, CASE WHEN count(*) = count(m.month) THEN round(sqrt(2 * ln(2 * 11 / 0.05) / count(*)), 8) END AS radius FROM c LEFT JOIN m USING (month)"""
)
def x62_complete_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hoeffding's radius for eleven bins, only where every month of the window is there."""
    from .incidence import ALPHA

    spine = spark.range(1).select(F.explode(F.expr(f"sequence(date'{PRIMARY.start}', date'{PRIMARY.end}' - interval 1 day, interval 1 month)")).alias("month"))
    held = attack_panel(spark, sf_dir).select("month").distinct().withColumn("here", F.lit(1))
    c = spine.join(held, "month", "left").agg(F.count(F.lit(1)).alias("months_expected"), F.count("here").alias("months_present"))
    complete = F.col("months_expected") == F.col("months_present")
    return c.select("*", complete.alias("complete"), F.when(complete, F.round(F.sqrt(2 * F.log(F.lit(2 * len(BINS) / ALPHA)) / F.col("months_expected")), 8)).alias("radius"))
