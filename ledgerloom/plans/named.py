"""The named data products over the event relations, each beside the SQL that an independent engine runs for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import quantiles, value_ranks
from ..registry import register
from ..sources.tables import SQL_RELATIONS, relation

TIERS = ["Retail", "Small", "Institutional"]
BREAKS = {"q50": "0.5", "q90": "0.9"}
#: Labels and upper bounds of the eleven size bins, in units of SCALE.
BINS = ["01_<100", "02_100_250", "03_250_500", "04_500_1000", "05_1000_2500", "06_2500_5000", "07_5000_10000", "08_10000_25000", "09_25000_50000", "10_50000_100000", "11_100000_plus"]
BOUNDS = [100, 250, 500, 1000, 2500, 5000, 10000, 25000, 50000, 100000]
#: A fixed size probe for large trades, and legacy cutoffs.
LARGE, LEGACY_RETAIL, LEGACY_SMALL = 10000, 1024.44, 10000


def money(x: Column, places: int = 2) -> Column:
    return F.round(x, places)


def mean(column: str) -> Column:
    """Mean to four places, from a sum of whole cents: the same whatever the order of summation."""
    return F.round(F.round(F.sum(column), 2) / F.count(column), 4)


def tier(amount: Column, low: Column, high: Column) -> Column:
    return F.when(amount < low, TIERS[0]).when(amount < high, TIERS[1]).otherwise(TIERS[2])


def size_bin(amount: Column) -> Column:
    out = None
    for label, bound in zip(BINS, BOUNDS):
        out = F.when(amount < bound, label) if out is None else out.when(amount < bound, label)
    return out.otherwise(BINS[-1])


def priced(df: DataFrame) -> DataFrame:
    """Rows with a positive amount; unpriced and zero ones go."""
    return df.where(F.col("amount_usd") > 0)


def with_breaks(df: DataFrame, population: DataFrame) -> DataFrame:
    """Adds the population's type-1 quantiles q50 and q90, one row, to every row."""
    cut = quantiles(population, "amount_usd", BREAKS).select("q50", "q90")
    return df.crossJoin(F.broadcast(cut))


SQL_BREAKS = "breaks AS (SELECT quantile_disc(amount_usd, 0.5) AS q50, quantile_disc(amount_usd, 0.9) AS q90 FROM v)"
SQL_TIER = "CASE WHEN {0} < q50 THEN 'Retail' WHEN {0} < q90 THEN 'Small' ELSE 'Institutional' END"


@register(
    f"""WITH {SQL_RELATIONS}, m AS (
    SELECT 'sandwiched_rows_all' AS metric, CAST(count(*) AS DOUBLE) AS value FROM victims
    UNION ALL SELECT 'sandwiched_rows_gt0_usd', count(*) FROM victims WHERE amount_usd > 0
    UNION ALL SELECT 'sandwiched_rows_null_usd', count(*) FROM victims WHERE amount_usd IS NULL
    UNION ALL SELECT 'sandwiched_rows_zero_usd', count(*) FROM victims WHERE amount_usd = 0
    UNION ALL SELECT 'sandwiched_rows_null_taker', count(*) FROM victims WHERE taker IS NULL
    UNION ALL SELECT 'sandwiched_rows_dust_lt_1usd', count(*) FROM victims WHERE amount_usd > 0 AND amount_usd < 1
    UNION ALL SELECT 'sandwiched_dust_volume_usd', coalesce(sum(amount_usd), 0) FROM victims WHERE amount_usd > 0 AND amount_usd < 1
    UNION ALL SELECT 'sandwiched_unique_takers_gt0_usd', count(DISTINCT taker) FROM victims WHERE amount_usd > 0
    UNION ALL SELECT 'sandwiched_unique_takers_all', count(DISTINCT taker) FROM victims
    UNION ALL SELECT 'sandwiches_rows_all', count(*) FROM attackers
    UNION ALL SELECT 'sandwiches_rows_null_usd', count(*) FROM attackers WHERE amount_usd IS NULL
    UNION ALL SELECT 'sandwiches_rows_zero_usd', count(*) FROM attackers WHERE amount_usd = 0
    UNION ALL SELECT 'sandwiches_rows_dust_lt_1usd', count(*) FROM attackers WHERE amount_usd > 0 AND amount_usd < 1
    UNION ALL SELECT 'sandwiches_unique_takers', count(DISTINCT taker) FROM attackers)
    SELECT metric, CAST(value AS DECIMAL(38,6)) AS value FROM m"""
)
def q0a_data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen data-quality metrics, one pass over each relation."""
    amount, dust = F.col("amount_usd"), (F.col("amount_usd") > 0) & (F.col("amount_usd") < 1)

    def metrics(role: str, named: dict[str, Column]) -> DataFrame:
        one = relation(spark, sf_dir, role, ["amount_usd", "taker"]).agg(*[c.cast("decimal(38,6)").alias(n) for n, c in named.items()])
        return one.unpivot([], list(named), "metric", "value")

    victims = {
        "sandwiched_rows_all": F.count(F.lit(1)),
        "sandwiched_rows_gt0_usd": F.count_if(amount > 0),
        "sandwiched_rows_null_usd": F.count_if(amount.isNull()),
        "sandwiched_rows_zero_usd": F.count_if(amount == 0),
        "sandwiched_rows_null_taker": F.count_if(F.col("taker").isNull()),
        "sandwiched_rows_dust_lt_1usd": F.count_if(dust),
        "sandwiched_dust_volume_usd": F.coalesce(F.sum(F.when(dust, amount)), F.lit(0.0)),
        "sandwiched_unique_takers_gt0_usd": F.count_distinct(F.when(amount > 0, F.col("taker"))),
        "sandwiched_unique_takers_all": F.count_distinct("taker"),
    }
    attackers = {
        "sandwiches_rows_all": F.count(F.lit(1)),
        "sandwiches_rows_null_usd": F.count_if(amount.isNull()),
        "sandwiches_rows_zero_usd": F.count_if(amount == 0),
        "sandwiches_rows_dust_lt_1usd": F.count_if(dust),
        "sandwiches_unique_takers": F.count_distinct("taker"),
    }
    return metrics("victims", victims).unionAll(metrics("attackers", attackers))


@register(
    f"""WITH {SQL_RELATIONS}, t AS (
    SELECT taker, count(*) AS victim_trades, round(sum(amount_usd), 2) AS total_volume_usd, round(round(sum(amount_usd), 2) / count(amount_usd), 4) AS avg_trade_usd,
        max(amount_usd) AS max_trade_usd, count(*) FILTER (amount_usd >= {LARGE}) AS trades_ge_10k, count(DISTINCT project) AS protocols_touched,
        count(DISTINCT tx_from) AS distinct_senders, CAST(min(block_time) AS DATE) AS first_seen, CAST(max(block_time) AS DATE) AS last_seen
    FROM victims WHERE amount_usd > 0 GROUP BY taker)
    SELECT * FROM (SELECT 'by_trade_count' AS rank_basis, * FROM t ORDER BY victim_trades DESC, taker LIMIT 25)
    UNION ALL SELECT * FROM (SELECT 'by_volume', * FROM t ORDER BY total_volume_usd DESC, taker LIMIT 25)
    UNION ALL SELECT * FROM (SELECT 'by_large_trades', * FROM t ORDER BY trades_ge_10k DESC, taker LIMIT 25)"""
)
def q0b_router_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of the 25 leading takers by count, by volume and by large trades."""
    victims = priced(relation(spark, sf_dir, "victims", ["taker", "amount_usd", "project", "tx_from", "block_time"]))
    amount = F.col("amount_usd")
    by_taker = victims.groupBy("taker").agg(
        F.count(F.lit(1)).alias("victim_trades"),
        money(F.sum(amount)).alias("total_volume_usd"),
        mean("amount_usd").alias("avg_trade_usd"),
        F.max(amount).alias("max_trade_usd"),
        F.count_if(amount >= LARGE).alias("trades_ge_10k"),
        F.count_distinct("project").alias("protocols_touched"),
        F.count_distinct("tx_from").alias("distinct_senders"),
        F.to_date(F.min("block_time")).alias("first_seen"),
        F.to_date(F.max("block_time")).alias("last_seen"),
    )
    bases = {"by_trade_count": "victim_trades", "by_volume": "total_volume_usd", "by_large_trades": "trades_ge_10k"}
    blocks = [by_taker.orderBy(F.desc(c), "taker").limit(25).select(F.lit(b).alias("rank_basis"), "*") for b, c in bases.items()]
    return blocks[0].unionAll(blocks[1]).unionAll(blocks[2])


DAILY_SQL = f"""WITH {SQL_RELATIONS}
    SELECT CAST(block_time AS DATE) AS date, count(*) AS sandwich_trade_count, count(amount_usd) AS priced_trade_count,
        round(sum(amount_usd), 2) AS total_sandwich_volume_usd, count(DISTINCT taker) AS unique_sandwich_bots, count(DISTINCT tx_hash) AS unique_transactions
    FROM attackers GROUP BY 1"""


@register(DAILY_SQL)
def q1_daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attacker legs, priced legs, volume, distinct bots and transactions of every day."""
    legs = relation(spark, sf_dir, "attackers", ["block_time", "amount_usd", "taker", "tx_hash"])
    return legs.groupBy(F.to_date("block_time").alias("date")).agg(
        F.count(F.lit(1)).alias("sandwich_trade_count"),
        F.count("amount_usd").alias("priced_trade_count"),
        money(F.sum("amount_usd")).alias("total_sandwich_volume_usd"),
        F.count_distinct("taker").alias("unique_sandwich_bots"),
        F.count_distinct("tx_hash").alias("unique_transactions"),
    )


@register(DAILY_SQL.replace("count(amount_usd) AS priced_trade_count,", ""))
def q1_legacy_daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older daily series, without the priced count."""
    return q1_daily_activity(spark, sf_dir).drop("priced_trade_count")


@register(f"WITH {SQL_RELATIONS} SELECT taker AS bot_address, count(*) AS total_trades, count(amount_usd) AS priced_trades, round(sum(amount_usd), 2) AS total_volume_usd FROM attackers GROUP BY 1")
def q3_bot_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bot's legs and volume; the volume is NULL if no leg is priced."""
    legs = relation(spark, sf_dir, "attackers", ["taker", "amount_usd"])
    bots = legs.groupBy(F.col("taker").alias("bot_address")).agg(
        F.count(F.lit(1)).alias("total_trades"), F.count("amount_usd").alias("priced_trades"), money(F.sum("amount_usd")).alias("total_volume_usd")
    )
    return bots.orderBy(F.desc_nulls_last("total_volume_usd"), "bot_address")


@register(f"WITH {SQL_RELATIONS} SELECT taker AS bot_address, round(sum(amount_usd), 2) AS total_volume_usd FROM attackers GROUP BY 1")
def q3_legacy_bot_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older distribution: volume only."""
    return q3_bot_distribution(spark, sf_dir).select("bot_address", "total_volume_usd")


BOTS_SQL = f"""WITH {SQL_RELATIONS}
    SELECT taker AS bot_address, count(*) AS total_sandwich_trades, count(amount_usd) AS priced_trades, round(sum(amount_usd), 2) AS total_volume_usd,
        count(DISTINCT CAST(block_time AS DATE)) AS days_active, CAST(min(block_time) AS DATE) AS first_seen, CAST(max(block_time) AS DATE) AS last_seen,
        round(round(sum(amount_usd), 2) / count(amount_usd), 4) AS avg_trade_size_usd
    FROM attackers GROUP BY 1"""


@register(BOTS_SQL)
def q4_bot_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bot's legs, volume, active days, first and last day and mean size."""
    legs = relation(spark, sf_dir, "attackers", ["taker", "amount_usd", "block_time"])
    bots = legs.groupBy(F.col("taker").alias("bot_address")).agg(
        F.count(F.lit(1)).alias("total_sandwich_trades"),
        F.count("amount_usd").alias("priced_trades"),
        money(F.sum("amount_usd")).alias("total_volume_usd"),
        F.count_distinct(F.to_date("block_time")).alias("days_active"),
        F.to_date(F.min("block_time")).alias("first_seen"),
        F.to_date(F.max("block_time")).alias("last_seen"),
        mean("amount_usd").alias("avg_trade_size_usd"),
    )
    return bots.orderBy(F.desc_nulls_last("total_volume_usd"), "bot_address")


@register(BOTS_SQL.replace("count(amount_usd) AS priced_trades,", ""))
def q4_legacy_bot_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older profiles, without the priced count."""
    return q4_bot_profiles(spark, sf_dir).drop("priced_trades")


POINTS = {"p25": "0.25", "p50_median": "0.5", "p75": "0.75", "p90": "0.9", "p95": "0.95"}


@register(
    f"""WITH {SQL_RELATIONS}, v AS (SELECT * FROM victims WHERE amount_usd > 0)
    SELECT {", ".join(f"quantile_disc(amount_usd, {p}) AS {n}" for n, p in POINTS.items())}, min(amount_usd) AS min_value, max(amount_usd) AS max_value,
        round(round(sum(amount_usd), 2) / count(amount_usd), 4) AS mean_value, count(*) AS total_victim_trades, count(DISTINCT taker) AS unique_victim_addresses FROM v"""
)
def q5a_break_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact order statistics of victim amounts."""
    v = priced(relation(spark, sf_dir, "victims", ["amount_usd", "taker"]))
    rest = v.agg(
        F.min("amount_usd").alias("min_value"),
        F.max("amount_usd").alias("max_value"),
        mean("amount_usd").alias("mean_value"),
        F.count(F.lit(1)).alias("total_victim_trades"),
        F.count_distinct("taker").alias("unique_victim_addresses"),
    )
    return quantiles(v, "amount_usd", POINTS).drop("n").crossJoin(F.broadcast(rest))


@register()
def q5a_legacy_break_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older break points from a quantile sketch; sketches differ between engines, so tests bound the rank error."""
    v = priced(relation(spark, sf_dir, "victims", ["amount_usd"]))
    return v.agg(*[F.percentile_approx("amount_usd", float(p), 10000).alias(n) for n, p in POINTS.items()], F.count(F.lit(1)).alias("total_victims"))


TIER_SQL = """count(*) AS victim_trades, count(DISTINCT taker) AS addresses_with_trade_in_tier, round(sum(amount_usd), 2) AS total_volume,
    round(round(sum(amount_usd), 2) / count(amount_usd), 4) AS avg_tx_size, min(amount_usd) AS min_tx, max(amount_usd) AS max_tx,
    round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct_of_trades, round(sum(amount_usd) / sum(sum(amount_usd)) OVER () * 100, 6) AS pct_of_volume"""


def tier_rows(classified: DataFrame, *more: Column) -> DataFrame:
    """One row for each tier; shares come from the three rows, not from a second scan."""
    rows = classified.groupBy("victim_tier").agg(
        F.count(F.lit(1)).alias("victim_trades"),
        F.count_distinct("taker").alias("addresses_with_trade_in_tier"),
        F.sum("amount_usd").alias("volume"),
        mean("amount_usd").alias("avg_tx_size"),
        F.min("amount_usd").alias("min_tx"),
        F.max("amount_usd").alias("max_tx"),
        *more,
    )
    share = lambda c: money(F.col(c) * 100 / F.expr(f"sum({c}) over ()"), 6)
    return rows.withColumns({"pct_of_trades": share("victim_trades"), "pct_of_volume": share("volume"), "total_volume": money(F.col("volume"))}).drop("volume")


@register(
    f"""WITH {SQL_RELATIONS}, v AS (SELECT * FROM victims WHERE amount_usd > 0), {SQL_BREAKS}
    SELECT {SQL_TIER.format("amount_usd")} AS victim_tier, {TIER_SQL}, min(q50) AS cutoff_p50, min(q90) AS cutoff_p90 FROM v, breaks GROUP BY 1"""
)
def q5b_tier_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Victim swaps by size tier; tiers are cut at the population's own median and ninth decile."""
    v = priced(relation(spark, sf_dir, "victims", ["amount_usd", "taker"]))
    classified = with_breaks(v, v).withColumn("victim_tier", tier(F.col("amount_usd"), F.col("q50"), F.col("q90")))
    return tier_rows(classified, F.min("q50").alias("cutoff_p50"), F.min("q90").alias("cutoff_p90"))


@register(
    f"""WITH {SQL_RELATIONS}, v AS (SELECT * FROM victims WHERE amount_usd > 0)
    SELECT CASE WHEN amount_usd < {LEGACY_RETAIL} THEN 'Retail' WHEN amount_usd < {LEGACY_SMALL} THEN 'Small' ELSE 'Institutional' END AS victim_tier, {TIER_SQL} FROM v GROUP BY 1"""
)
def q5b_legacy_tier_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Victim swaps by tiers with fixed cutoffs."""
    v = priced(relation(spark, sf_dir, "victims", ["amount_usd", "taker"]))
    return tier_rows(v.withColumn("victim_tier", tier(F.col("amount_usd"), F.lit(LEGACY_RETAIL), F.lit(LEGACY_SMALL))))


def entities(v: DataFrame, entity: str) -> DataFrame:
    """One row for each entity that isn't null: its swaps, volume, extremes and type-1 median."""
    v = v.where(F.col(entity).isNotNull())
    sums = v.groupBy(entity).agg(
        F.count(F.lit(1)).alias("attack_count"), F.sum("amount_usd").alias("volume"), F.min("amount_usd").alias("least"), F.max("amount_usd").alias("most")
    )
    return sums.join(quantiles(v, "amount_usd", {"median_trade_usd": "0.5"}, (entity,)).drop("n"), entity)


SQL_ENTITY = """addr AS (SELECT {0}, count(*) AS attack_count, sum(amount_usd) AS volume, min(amount_usd) AS least, max(amount_usd) AS most,
    quantile_disc(amount_usd, 0.5) AS median_trade_usd FROM v WHERE {0} IS NOT NULL GROUP BY 1)"""


@register(
    f"""WITH {SQL_RELATIONS}, v AS (SELECT * FROM victims WHERE amount_usd > 0), {SQL_BREAKS}, {SQL_ENTITY.format("tx_from")},
    bots AS (SELECT taker AS addr FROM attackers WHERE quantity >= 48 UNION SELECT tx_from FROM attackers WHERE quantity >= 48),
    c AS (SELECT a.*, q50, q90, {SQL_TIER.format("median_trade_usd")} AS victim_tier, CASE WHEN addr IS NULL THEN 0 ELSE 1 END AS is_known_bot
        FROM addr a LEFT JOIN bots ON addr = tx_from, breaks)
    SELECT victim_tier, CAST(is_known_bot AS INTEGER) AS is_known_bot, count(*) AS unique_eoas, CAST(sum(attack_count) AS BIGINT) AS attack_events,
        round(sum(attack_count) / count(*), 6) AS attacks_per_eoa, max(attack_count) AS max_attacks_single_eoa, quantile_disc(attack_count, 0.5) AS median_attacks_per_eoa,
        round(sum(volume), 2) AS tier_volume_usd, round(avg(median_trade_usd), 4) AS avg_median_trade_usd, min(q50) AS cutoff_p50, min(q90) AS cutoff_p90
    FROM c GROUP BY 1, 2"""
)
def q5c_repeat_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senders, each put into one tier by its own median, apart from those that also act on the attacker side."""
    v = priced(relation(spark, sf_dir, "victims", ["amount_usd", "tx_from"]))
    legs = relation(spark, sf_dir, "attackers", ["taker", "tx_from", "quantity"]).where(F.col("quantity") >= 48)
    bots = legs.select(F.explode(F.array("taker", "tx_from")).alias("tx_from")).distinct().withColumn("known", F.lit(1))
    flagged = entities(v, "tx_from").join(bots, "tx_from", "left").withColumn("is_known_bot", F.coalesce("known", F.lit(0)))
    classified = with_breaks(flagged, v).withColumn("victim_tier", tier(F.col("median_trade_usd"), F.col("q50"), F.col("q90")))
    keys = ("victim_tier", "is_known_bot")
    sums = classified.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unique_eoas"),
        F.sum("attack_count").alias("attack_events"),
        money(F.sum("attack_count") / F.count(F.lit(1)), 6).alias("attacks_per_eoa"),
        F.max("attack_count").alias("max_attacks_single_eoa"),
        money(F.sum("volume")).alias("tier_volume_usd"),
        money(F.avg("median_trade_usd"), 4).alias("avg_median_trade_usd"),
        F.min("q50").alias("cutoff_p50"),
        F.min("q90").alias("cutoff_p90"),
    )
    return sums.join(quantiles(classified, "attack_count", {"median_attacks_per_eoa": "0.5"}, keys).drop("n"), list(keys))


SQL_LEVEL = "CASE WHEN {0} >= q90 THEN 3 WHEN {0} >= q50 THEN 2 ELSE 1 END"


@register(
    f"""WITH {SQL_RELATIONS}, v AS (SELECT * FROM victims WHERE amount_usd > 0), {SQL_BREAKS}, {SQL_ENTITY.format("taker")},
    c AS (SELECT *, {SQL_TIER.format("median_trade_usd")} AS victim_tier, ({SQL_LEVEL.format("most")}) - ({SQL_LEVEL.format("least")}) AS span FROM addr, breaks)
    SELECT victim_tier, count(*) AS unique_addresses, CAST(sum(attack_count) AS BIGINT) AS attack_events, round(sum(attack_count) / count(*), 6) AS attacks_per_address,
        max(attack_count) AS max_attacks_single_address, quantile_disc(attack_count, 0.5) AS median_attacks_per_address, round(sum(volume), 2) AS tier_volume_usd,
        round(avg(median_trade_usd), 4) AS avg_median_trade_usd, count(*) FILTER (span > 0) AS addresses_spanning_trade_tiers, min(q50) AS cutoff_p50, min(q90) AS cutoff_p90
    FROM c GROUP BY 1"""
)
def q5c_taker_repeat_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The superseded variant by taker, with how many takers trade in more than one tier."""
    v = priced(relation(spark, sf_dir, "victims", ["amount_usd", "taker"]))
    level = lambda c: F.when(F.col(c) >= F.col("q90"), 3).when(F.col(c) >= F.col("q50"), 2).otherwise(1)
    classified = with_breaks(entities(v, "taker"), v).withColumns(
        {"victim_tier": tier(F.col("median_trade_usd"), F.col("q50"), F.col("q90")), "span": level("most") - level("least")}
    )
    sums = classified.groupBy("victim_tier").agg(
        F.count(F.lit(1)).alias("unique_addresses"),
        F.sum("attack_count").alias("attack_events"),
        money(F.sum("attack_count") / F.count(F.lit(1)), 6).alias("attacks_per_address"),
        F.max("attack_count").alias("max_attacks_single_address"),
        money(F.sum("volume")).alias("tier_volume_usd"),
        money(F.avg("median_trade_usd"), 4).alias("avg_median_trade_usd"),
        F.count_if(F.col("span") > 0).alias("addresses_spanning_trade_tiers"),
        F.min("q50").alias("cutoff_p50"),
        F.min("q90").alias("cutoff_p90"),
    )
    return sums.join(quantiles(classified, "attack_count", {"median_attacks_per_address": "0.5"}, ("victim_tier",)).drop("n"), "victim_tier")


@register(
    f"""WITH {SQL_RELATIONS}, v AS (SELECT * FROM victims WHERE amount_usd > 0), {SQL_BREAKS},
    c AS (SELECT amount_usd, q50, q90, {SQL_TIER.format("amount_usd")} AS victim_tier FROM v, breaks),
    b AS (SELECT *, CAST((row_number() OVER w * 100 + count(*) OVER (PARTITION BY victim_tier) - 1) // count(*) OVER (PARTITION BY victim_tier) AS INTEGER) AS pctile_in_tier
        FROM c WINDOW w AS (PARTITION BY victim_tier ORDER BY amount_usd))
    SELECT victim_tier, pctile_in_tier, count(*) AS trades_in_bin, min(amount_usd) AS lower_edge_usd, max(amount_usd) AS upper_edge_usd,
        round(round(sum(amount_usd), 2) / count(amount_usd), 4) AS mean_usd, round(sum(amount_usd), 2) AS volume_usd, min(q50) AS cutoff_p50, min(q90) AS cutoff_p90 FROM b GROUP BY 1, 2"""
)
def q5d_size_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred bins of equal mass in each tier. Copies of a value that straddle bins are split by their ranks, so no tier is sorted in one task."""
    v = priced(relation(spark, sf_dir, "victims", ["amount_usd"]))
    classified = with_breaks(v, v).withColumn("victim_tier", tier(F.col("amount_usd"), F.col("q50"), F.col("q90")))
    ranks = value_ranks(classified, "amount_usd", ("victim_tier",))
    bin_of = lambda rank: f"cast(({rank} * 100 + n - 1) div n as int)"
    parts = ranks.withColumn("pctile_in_tier", F.explode(F.expr(f"sequence({bin_of('(below + 1)')}, {bin_of('(below + copies)')})")))
    # Ranks in bin b: from floor((b - 1) * n / 100) + 1 to floor(b * n / 100).
    mine = F.least(F.expr("below + copies"), F.expr("(pctile_in_tier * n) div 100")) - F.greatest(F.col("below"), F.expr("((pctile_in_tier - 1) * n) div 100"))
    bins = parts.withColumn("mine", mine).where("mine > 0").groupBy("victim_tier", "pctile_in_tier")
    rows = bins.agg(
        F.sum("mine").alias("trades_in_bin"),
        F.min("amount_usd").alias("lower_edge_usd"),
        F.max("amount_usd").alias("upper_edge_usd"),
        money(F.sum(F.col("amount_usd") * F.col("mine")) / F.sum("mine"), 4).alias("mean_usd"),
        money(F.sum(F.col("amount_usd") * F.col("mine"))).alias("volume_usd"),
    )
    return with_breaks(rows, v).withColumnsRenamed({"q50": "cutoff_p50", "q90": "cutoff_p90"})


SQL_BIN = "CASE " + " ".join(f"WHEN amount_usd < {b} THEN '{n}'" for n, b in zip(BINS, BOUNDS)) + f" ELSE '{BINS[-1]}' END"
SQL_PANEL = f"""{SQL_RELATIONS}, vk AS (SELECT DISTINCT tx_hash, evt_index FROM victims WHERE amount_usd > 0),
panel AS (
    SELECT CAST(date_trunc('month', block_time) AS DATE) AS month, project, version, {SQL_BIN} AS trade_size_bin, count(*) AS candidate_trade_events,
        count(vk.tx_hash) AS attacked_trade_events, count(*) - count(vk.tx_hash) AS unattacked_trade_events, round(sum(amount_usd), 2) AS candidate_volume_usd,
        round(sum(CASE WHEN vk.tx_hash IS NOT NULL THEN amount_usd ELSE 0 END), 2) AS attacked_volume_usd, round(round(sum(amount_usd), 2) / count(amount_usd), 4) AS avg_trade_size_usd,
        min(amount_usd) AS min_trade_size_usd, max(amount_usd) AS max_trade_size_usd, round(count(vk.tx_hash) * 100.0 / count(*), 6) AS attack_rate_pct
    FROM trades t LEFT JOIN vk ON t.tx_hash = vk.tx_hash AND t.evt_index = vk.evt_index WHERE amount_usd > 0 GROUP BY 1, 2, 3, 4)"""


def attack_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate and attacked swaps by month, project, version and size bin. The keys of victims are made distinct before the join, so none fans out."""
    keys = ["tx_hash", "evt_index"]
    hit = priced(relation(spark, sf_dir, "victims", [*keys, "amount_usd"])).select(*keys).distinct().withColumn("hit", F.lit(1))
    swaps = priced(relation(spark, sf_dir, "trades", [*keys, "block_time", "project", "version", "amount_usd"]))
    marked = swaps.join(hit, keys, "left").withColumns({"month": F.to_date(F.date_trunc("month", "block_time")), "trade_size_bin": size_bin(F.col("amount_usd"))})
    return marked.groupBy("month", "project", "version", "trade_size_bin").agg(
        F.count(F.lit(1)).alias("candidate_trade_events"),
        F.count("hit").alias("attacked_trade_events"),
        (F.count(F.lit(1)) - F.count("hit")).alias("unattacked_trade_events"),
        money(F.sum("amount_usd")).alias("candidate_volume_usd"),
        money(F.sum(F.when(F.col("hit") == 1, F.col("amount_usd")).otherwise(0.0))).alias("attacked_volume_usd"),
        mean("amount_usd").alias("avg_trade_size_usd"),
        F.min("amount_usd").alias("min_trade_size_usd"),
        F.max("amount_usd").alias("max_trade_size_usd"),
        money(F.count("hit") * 100 / F.count(F.lit(1)), 6).alias("attack_rate_pct"),
    )


@register(f"WITH {SQL_PANEL} SELECT * FROM panel")
def q5e_attack_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel of candidate and attacked swaps."""
    return attack_panel(spark, sf_dir)


PROTOCOL_SQL = f"""WITH {SQL_RELATIONS}
    SELECT project, count(*) AS victim_trade_count, round(sum(amount_usd), 2) AS total_volume_usd, round(round(sum(amount_usd), 2) / count(amount_usd), 4) AS avg_trade_size,
        count(DISTINCT taker) AS unique_takers_in_protocol, count(DISTINCT tx_from) AS unique_eoas_in_protocol FROM victims WHERE amount_usd > 0 GROUP BY 1"""


@register(PROTOCOL_SQL)
def qp_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Victim swaps of every protocol; distinct counts don't add up across protocols."""
    v = priced(relation(spark, sf_dir, "victims", ["project", "amount_usd", "taker", "tx_from"]))
    rows = v.groupBy("project").agg(
        F.count(F.lit(1)).alias("victim_trade_count"),
        money(F.sum("amount_usd")).alias("total_volume_usd"),
        mean("amount_usd").alias("avg_trade_size"),
        F.count_distinct("taker").alias("unique_takers_in_protocol"),
        F.count_distinct("tx_from").alias("unique_eoas_in_protocol"),
    )
    return rows.orderBy(F.desc("total_volume_usd"), "project")


@register(
    f"""WITH {SQL_RELATIONS} SELECT project, count(*) AS sandwich_count, round(sum(amount_usd), 2) AS total_volume_usd, round(round(sum(amount_usd), 2) / count(amount_usd), 4) AS avg_trade_size,
    count(DISTINCT taker) AS unique_victims FROM victims WHERE amount_usd > 0 GROUP BY 1"""
)
def qp_legacy_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older protocol rows, with takers as victims."""
    v = priced(relation(spark, sf_dir, "victims", ["project", "amount_usd", "taker"]))
    return v.groupBy("project").agg(
        F.count(F.lit(1)).alias("sandwich_count"),
        money(F.sum("amount_usd")).alias("total_volume_usd"),
        mean("amount_usd").alias("avg_trade_size"),
        F.count_distinct("taker").alias("unique_victims"),
    )
