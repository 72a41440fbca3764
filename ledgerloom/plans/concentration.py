"""Inequality, concentration and heavy tails of volume over entities.

Entities are ranked by exact distributed ranks (no window over all entities), so the measures hold for any number of them.
Shares are sums over ranks; tails use the ranked logarithms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranks import value_ranks
from ..registry import register
from ..sources.tables import LONGER, PRIMARY, SQL_RELATIONS, relation
from ..sources.tables import Window as Days

SQL_WINDOW = "block_time >= TIMESTAMP '{0.start}' AND block_time < TIMESTAMP '{0.end}'"
SQL_VOLUMES = f"""{SQL_RELATIONS}, vol AS (SELECT tx_from AS entity, round(sum(amount_usd), 2) AS volume FROM attackers GROUP BY 1 HAVING round(sum(amount_usd), 2) > 0),
r AS (SELECT entity, volume, row_number() OVER (ORDER BY volume DESC, entity) AS rank, count(*) OVER () AS n, sum(volume) OVER () AS total FROM vol)"""


def volumes(spark: SparkSession, sf_dir: str, window: Days | None = None) -> DataFrame:
    """entity, volume of every sender on the attacker side with positive volume."""
    legs = relation(spark, sf_dir, "attackers", ["tx_from", "amount_usd"], *([window] if window else []))
    return legs.groupBy(F.col("tx_from").alias("entity")).agg(F.round(F.sum("amount_usd"), 2).alias("volume")).where("volume > 0")


def ranked(df: DataFrame, value: str = "volume", entity: str = "entity") -> DataFrame:
    """entity, value, rank (1: largest; equal values by entity), n, total."""
    ranks = value_ranks(df, value)
    total = df.agg(F.sum(value).alias("total"))
    ties = Window.partitionBy(value).orderBy(entity)
    return (
        df.join(ranks, value)
        .withColumn("rank", F.col("n") - F.col("below") - F.col("copies") + F.row_number().over(ties))
        .crossJoin(F.broadcast(total))
        .select(entity, value, "rank", "n", "total")
    )


def gini(value: str = "volume") -> Column:
    """From value_ranks: equal values share the mean of their ranks, which leaves the sum as it is."""
    weighted = F.sum(F.col(value) * F.col("copies") * (2 * F.col("below") + F.col("copies") - F.col("n")))
    return weighted / (F.max("n") * F.sum(F.col(value) * F.col("copies")))


def top_rank(n: Column, share: str) -> Column:
    """ceil(n * share / 1000), in whole numbers, at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.expr(f"(n * {share} + 999) div 1000"))


@register(f"WITH {SQL_VOLUMES} SELECT round(sum((2 * (n - rank + 1) - n - 1) * volume) / (max(n) * sum(volume)), 8) AS gini, max(n) AS n FROM r")
def x01_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gini coefficient of volume."""
    return value_ranks(volumes(spark, sf_dir), "volume").agg(F.round(gini(), 8).alias("gini"), F.max("n").alias("n"))


SQL_LORENZ = """l AS (SELECT n - rank + 1 AS i, n, total, sum(volume) OVER (ORDER BY rank DESC) AS held FROM r)"""


@register(
    f"""WITH {SQL_VOLUMES}, {SQL_LORENZ}, p AS (SELECT i / n AS x, held / total AS y, lag(i / n, 1, 0) OVER (ORDER BY i) AS x0, lag(held / total, 1, 0) OVER (ORDER BY i) AS y0 FROM l)
    SELECT round(1 - sum((x - x0) * (y + y0)), 8) AS gini_trapezoid FROM p"""
)
def x02_gini_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One less twice the area under the Lorenz curve, by trapezoids: each step needs only the volume held below it."""
    points = lorenz(spark, sf_dir)
    step = (F.lit(1.0) / F.col("n")) * (2 * F.col("held") - F.col("volume")) / F.col("total")
    return points.agg(F.round(1 - F.sum(step), 8).alias("gini_trapezoid"))


def lorenz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, volume, i (ascending rank), n, total, held (volume up to and with this entity). The running sum is taken inside blocks
    of ranks; what the blocks before hold is a sum over few rows."""
    rows = ranked(volumes(spark, sf_dir)).withColumn("i", F.col("n") - F.col("rank") + 1).withColumn("block", F.expr("i div 10000"))
    before = rows.groupBy("block").agg(F.sum("volume").alias("own")).select("block", (F.sum("own").over(Window.orderBy("block")) - F.col("own")).alias("ahead"))
    inside = F.sum("volume").over(Window.partitionBy("block").orderBy("i"))
    return rows.withColumn("inside", inside).join(before, "block").withColumn("held", F.col("inside") + F.col("ahead"))


@register(
    f"""WITH {SQL_VOLUMES}, {SQL_LORENZ} SELECT CAST(0 AS BIGINT) AS i, 0.0 AS population_share, 0.0 AS volume_share
    UNION ALL SELECT CAST(i AS BIGINT), round(i / n, 8), round(held / total, 8) FROM l"""
)
def x03_lorenz_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the Lorenz curve, from the origin."""
    points = lorenz(spark, sf_dir).select("i", F.round(F.col("i") / F.col("n"), 8).alias("population_share"), F.round(F.col("held") / F.col("total"), 8).alias("volume_share"))
    return spark.range(1).select(F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("population_share"), F.lit(0.0).alias("volume_share")).unionAll(points)


TOPS, PARTS = (1, 4, 10, 20), {"top_0_1pct": "1", "top_1pct": "10", "top_5pct": "50", "top_10pct": "100"}
SQL_TOPS = ", ".join(f"round(sum(volume) FILTER (rank <= {k}) / max(total), 8) AS cr{k}" for k in TOPS)
SQL_PARTS = ", ".join(f"round(sum(volume) FILTER (rank <= greatest(1, (n * {p} + 999) // 1000)) / max(total), 8) AS {c}" for c, p in PARTS.items())


@register(f"WITH {SQL_VOLUMES} SELECT {SQL_TOPS}, {SQL_PARTS} FROM r")
def x04_x05_top_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the leading 1, 4, 10 and 20 entities, and of the leading 0.1, 1, 5 and 10 percent."""
    share = lambda limit: F.round(F.sum(F.when(F.col("rank") <= limit, F.col("volume"))) / F.max("total"), 8)
    rows = ranked(volumes(spark, sf_dir))
    return rows.agg(*[share(F.lit(k)).alias(f"cr{k}") for k in TOPS], *[share(top_rank(F.col("n"), p)).alias(c) for c, p in PARTS.items()])


@register(f"WITH {SQL_VOLUMES} SELECT round(10000 * sum((volume / total) * (volume / total)), 6) AS hhi FROM r")
def x06_hhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Herfindahl index on the scale to 10,000, in one pass over volumes: the squares' sum over the square of the sum."""
    return volumes(spark, sf_dir).agg(F.round(10000 * F.sum(F.col("volume") * F.col("volume")) / (F.sum("volume") * F.sum("volume")), 6).alias("hhi"))


@register(
    f"""WITH {SQL_VOLUMES}, k AS (SELECT p, (max(n) * p + 99) // 100 AS k FROM r, (VALUES (5), (10)) t(p) GROUP BY p),
    h AS (SELECT p, k.k, (SELECT volume FROM r WHERE rank = k.k + 1) AS threshold FROM k)
    SELECT CAST(p AS INTEGER) AS tail_percent, CAST(k AS BIGINT) AS k, round(1 / avg(ln(volume / threshold)), 6) AS alpha, round(1 / avg(ln(volume / threshold)) / sqrt(max(k)), 6) AS se
    FROM h JOIN r ON rank <= k GROUP BY 1, 2"""
)
def x07_hill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hill tail index over the leading 5 and 10 percent, with its standard error."""
    rows = ranked(volumes(spark, sf_dir)).withColumn("tail_percent", F.explode(F.array(F.lit(5), F.lit(10)))).withColumn("k", F.expr("(n * tail_percent + 99) div 100"))
    tail = rows.where("rank <= k + 1").groupBy("tail_percent", "k").agg(
        F.sum(F.when(F.col("rank") <= F.col("k"), F.log("volume"))).alias("logs"), F.max(F.when(F.col("rank") == F.col("k") + 1, F.log("volume"))).alias("threshold")
    )
    alpha = 1 / (F.col("logs") / F.col("k") - F.col("threshold"))
    return tail.select("tail_percent", "k", F.round(alpha, 6).alias("alpha"), F.round(alpha / F.sqrt("k"), 6).alias("se"))


@register(
    f"""WITH {SQL_VOLUMES}, c AS (SELECT rank, n, avg(ln(volume)) OVER (ORDER BY rank) AS m, lead(ln(volume)) OVER (ORDER BY rank) AS nxt FROM r)
    SELECT CAST(rank AS BIGINT) AS k, round(1 / (m - nxt), 6) AS alpha FROM c WHERE nxt IS NOT NULL AND rank BETWEEN 10 AND 200"""
)
def x08_hill_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hill index for every k from 10 to 200, from the 201 leading entities (the grid is the feature)."""
    lead = ranked(volumes(spark, sf_dir)).where("rank <= 201")
    order = Window.orderBy("rank")
    traced = lead.select("rank", F.avg(F.log("volume")).over(order).alias("m"), F.lead(F.log("volume")).over(order).alias("nxt"))
    return traced.where("nxt is not null and rank between 10 and 200").select(F.col("rank").alias("k"), F.round(1 / (F.col("m") - F.col("nxt")), 6).alias("alpha"))


@register(f"WITH {SQL_VOLUMES} SELECT round(-regr_slope(ln(rank - 0.5), ln(volume)), 6) AS zeta, round(-regr_slope(ln(rank - 0.5), ln(volume)) * sqrt(2.0 / count(*)), 6) AS se, count(*) AS k FROM r WHERE rank <= 500")
def x09_rank_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of log rank less one half on log volume over the 500 leading entities."""
    lead = ranked(volumes(spark, sf_dir)).where("rank <= 500")
    zeta = -F.regr_slope(F.log(F.col("rank") - 0.5), F.log("volume"))
    return lead.agg(F.round(zeta, 6).alias("zeta"), F.round(zeta * F.sqrt(2.0 / F.count(F.lit(1))), 6).alias("se"), F.count(F.lit(1)).alias("k"))


def measures(rows: DataFrame, by: str) -> DataFrame:
    """Gini, leading share and Herfindahl index of each group of entity volumes."""
    sums = rows.groupBy(by).agg(F.sum("volume").alias("t"), F.sum(F.col("volume") * F.col("volume")).alias("q"), F.max("volume").alias("m"))
    ginis = value_ranks(rows, "volume", (by,)).groupBy(by).agg(F.round(gini(), 8).alias("gini"), F.max("n").alias("n"))
    return ginis.join(sums, by).select(by, "n", "gini", F.round(F.col("m") / F.col("t"), 8).alias("cr1"), F.round(10000 * F.col("q") / (F.col("t") * F.col("t")), 6).alias("hhi"))


SQL_MEASURES = """z AS (SELECT {0}, volume, row_number() OVER (PARTITION BY {0} ORDER BY volume) AS i, count(*) OVER (PARTITION BY {0}) AS n, sum(volume) OVER (PARTITION BY {0}) AS t FROM y)
    SELECT {0}, max(n) AS n, round(sum((2 * i - n - 1) * volume) / (max(n) * max(t)), 8) AS gini, round(max(volume) / max(t), 8) AS cr1, round(10000 * sum((volume / t) * (volume / t)), 6) AS hhi FROM z GROUP BY 1"""


@register(f"WITH {SQL_VOLUMES}, y AS (SELECT dropped, volume FROM r, (VALUES (0), (1), (5), (10)) t(dropped) WHERE rank > dropped), {SQL_MEASURES.format('dropped')}")
def x13_top_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures without the leading 0, 1, 5 and 10 entities."""
    rows = ranked(volumes(spark, sf_dir)).withColumn("dropped", F.explode(F.array(*map(F.lit, (0, 1, 5, 10))))).where("rank > dropped")
    return measures(rows, "dropped")


@register(
    f"""WITH {SQL_VOLUMES}, m AS (SELECT merged, CASE WHEN rank <= merged THEN -((rank - 1) % groups) - 1 ELSE rank END AS e, volume FROM r, (VALUES (5, 1), (10, 2), (20, 4)) t(merged, groups)),
    y AS (SELECT merged, round(sum(volume), 2) AS volume FROM m GROUP BY merged, e), {SQL_MEASURES.format("merged")}"""
)
def x14_merge_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures after the leading 5, 10 and 20 entities are merged into 1, 2 and 4."""
    cases = F.array(*[F.struct(F.lit(m).alias("merged"), F.lit(g).alias("groups")) for m, g in ((5, 1), (10, 2), (20, 4))])
    rows = ranked(volumes(spark, sf_dir)).withColumn("case", F.explode(cases)).select("rank", "volume", "case.*")
    own = F.when(F.col("rank") <= F.col("merged"), -((F.col("rank") - 1) % F.col("groups")) - 1).otherwise(F.col("rank"))
    merged = rows.groupBy("merged", own.alias("e")).agg(F.round(F.sum("volume"), 2).alias("volume"))
    return measures(merged, "merged")


def sql_ranks(name: str, window: Days) -> str:
    return f"""{name}v AS (SELECT tx_from AS entity, round(sum(amount_usd), 2) AS volume FROM attackers WHERE {SQL_WINDOW.format(window)} GROUP BY 1 HAVING round(sum(amount_usd), 2) > 0),
    {name} AS (SELECT entity, volume, row_number() OVER (ORDER BY volume DESC, entity) AS rank, count(*) OVER () AS n, sum(volume) OVER () AS total FROM {name}v)"""


SQL_PAIR = f"{SQL_RELATIONS}, {sql_ranks('a', PRIMARY)}, {sql_ranks('b', LONGER)}"


def pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(ranked(volumes(spark, sf_dir, w)) for w in (PRIMARY, LONGER))


SQL_COMPARED = {"cr1": "sum(volume) FILTER (rank <= 1) / max(total)", "cr10": "sum(volume) FILTER (rank <= 10) / max(total)", "hhi": "10000 * sum((volume / total) * (volume / total))"}


@register(
    f"WITH {SQL_PAIR}, x AS ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, (SELECT {e} FROM a) AS p, (SELECT {e} FROM b) AS q" for m, e in SQL_COMPARED.items())
    + ") SELECT metric, round(p, 8) AS primary_value, round(q, 8) AS longer_value, round(q - p, 8) AS change, round((q - p) / p, 8) AS relative_change, abs((q - p) / p) <= 0.1 AS stable FROM x"
)
def x15_window_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration in the primary and the longer window, with absolute and relative change; within a tenth counts as stable."""
    names = list(SQL_COMPARED)

    def of(rows: DataFrame, value: str) -> DataFrame:
        top = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("volume"))) / F.max("total")
        hhi = 10000 * F.sum((F.col("volume") / F.col("total")) * (F.col("volume") / F.col("total")))
        return rows.agg(top(1).alias("cr1"), top(10).alias("cr10"), hhi.alias("hhi")).unpivot([], names, "metric", value)

    a, b = pair(spark, sf_dir)
    change = F.col("q") - F.col("p")
    return of(a, "p").join(of(b, "q"), "metric").select(
        "metric", F.round("p", 8).alias("primary_value"), F.round("q", 8).alias("longer_value"), F.round(change, 8).alias("change"),
        F.round(change / F.col("p"), 8).alias("relative_change"), (F.abs(change / F.col("p")) <= 0.1).alias("stable"),
    )


GROUPS = ["top_1pct", "top_1_5pct", "top_5_10pct", "rest"]
SQL_GROUP = "CASE WHEN rank * 100 <= n THEN 'top_1pct' WHEN rank * 100 <= 5 * n THEN 'top_1_5pct' WHEN rank * 100 <= 10 * n THEN 'top_5_10pct' ELSE 'rest' END"


def rank_group() -> Column:
    return F.when(F.expr("rank * 100 <= n"), GROUPS[0]).when(F.expr("rank * 100 <= 5 * n"), GROUPS[1]).when(F.expr("rank * 100 <= 10 * n"), GROUPS[2]).otherwise(GROUPS[3])


@register(
    f"""WITH {SQL_PAIR}, t AS (SELECT x.g AS from_group, y.g AS to_group, count(*) AS entities FROM (SELECT entity, {SQL_GROUP} AS g FROM a) x JOIN (SELECT entity, {SQL_GROUP} AS g FROM b) y USING (entity) GROUP BY 1, 2),
    d AS (SELECT unnest({GROUPS}) AS g)
    SELECT f.g AS from_group, s.g AS to_group, coalesce(entities, 0) AS entities, round(coalesce(entities, 0) / sum(coalesce(entities, 0)) OVER (PARTITION BY f.g), 8) AS row_share
    FROM d f CROSS JOIN d s LEFT JOIN t ON t.from_group = f.g AND t.to_group = s.g"""
)
def x16_rank_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entities move between rank groups from the primary to the longer window; all sixteen cells."""
    a, b = pair(spark, sf_dir)
    moved = a.select("entity", rank_group().alias("from_group")).join(b.select("entity", rank_group().alias("to_group")), "entity").groupBy("from_group", "to_group").agg(F.count(F.lit(1)).alias("entities"))
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, GROUPS))).alias("from_group"))
    cells = names.select("from_group", F.explode(F.array(*map(F.lit, GROUPS))).alias("to_group"))
    filled = cells.join(moved, ["from_group", "to_group"], "left").withColumn("entities", F.coalesce("entities", F.lit(0).cast("long")))
    return filled.withColumn("row_share", F.round(F.col("entities") / F.sum("entities").over(Window.partitionBy("from_group")), 8))


@register(f"WITH {SQL_PAIR} SELECT CAST(k AS INTEGER) AS k, count(b.entity) AS retained, round(count(b.entity) / k, 8) AS retention FROM (VALUES (1), (5), (10), (20), (50)) t(k) JOIN a ON a.rank <= k LEFT JOIN b ON b.entity = a.entity AND b.rank <= k GROUP BY 1, k")
def x16_rank_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the k leading entities of the primary window lead the longer one too."""
    a, b = pair(spark, sf_dir)
    lead = a.where("rank <= 50").select("entity", F.col("rank").alias("ra")).join(b.where("rank <= 50").select("entity", F.col("rank").alias("rb")), "entity", "left")
    rows = lead.withColumn("k", F.explode(F.array(*map(F.lit, (1, 5, 10, 20, 50))))).where("ra <= k").groupBy("k").agg(F.count_if(F.col("rb") <= F.col("k")).alias("retained"))
    return rows.withColumn("retention", F.round(F.col("retained") / F.col("k"), 8))


def mean_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """entity and its ascending rank, equal values sharing the mean of theirs."""
    ranks = value_ranks(df, value).select(value, (F.col("below") + (F.col("copies") + 1) / 2).alias(name))
    return df.select("entity", value).join(ranks, value).select("entity", name)


@register(
    f"""WITH {SQL_PAIR}, c AS (SELECT a.volume AS x, b.volume AS y FROM a JOIN b USING (entity)),
    k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM c)
    SELECT round(corr(rx, ry), 8) AS rho, count(*) AS n FROM k"""
)
def x17_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of volumes over the entities of both windows, ties at their mean rank."""
    a, b = (volumes(spark, sf_dir, w) for w in (PRIMARY, LONGER))
    both = a.join(b.withColumnRenamed("volume", "other"), "entity")
    ranks = mean_ranks(both, "volume", "rx").join(mean_ranks(both, "other", "ry"), "entity")
    return ranks.agg(F.round(F.corr("rx", "ry"), 8).alias("rho"), F.count(F.lit(1)).alias("n"))


@register(
    f"""WITH {SQL_VOLUMES}, u AS (SELECT unnest([50, 75, 90, 95]) AS p, unnest([quantile_disc(volume, 0.5), quantile_disc(volume, 0.75), quantile_disc(volume, 0.9), quantile_disc(volume, 0.95)]) AS u FROM r)
    SELECT CAST(p AS INTEGER) AS percentile, u AS threshold, count(*) AS n_above, round(avg(volume - u), 4) AS mean_excess FROM u JOIN r ON volume > u GROUP BY 1, 2"""
)
def x92_mean_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of what exceeds a threshold, at four quantiles of volume."""
    from ..functions.ranks import quantiles

    vol, points = volumes(spark, sf_dir), (50, 75, 90, 95)
    cuts = quantiles(vol, "volume", {str(p): f"{p}/100" for p in points}).unpivot([], [str(p) for p in points], "percentile", "threshold")
    grid = cuts.select(F.col("percentile").cast("int").alias("percentile"), "threshold")
    return vol.crossJoin(F.broadcast(grid)).where("volume > threshold").groupBy("percentile", "threshold").agg(F.count(F.lit(1)).alias("n_above"), F.round(F.avg(F.col("volume") - F.col("threshold")), 4).alias("mean_excess"))
