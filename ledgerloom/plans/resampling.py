"""Resampling of concentration, of rank correlations and of fitted tails, in blocks of ranked entities.

Replicates are numbered (salt) and dealt by some hundreds; pairs of a block and a deal are what tasks work on, and only sums leave them. The two windows (and, for tails, the four
thresholds in each) are problems of one run. SQL can't express draws; tests hold sums, fits and counts of draws against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranks import interpolated
from ..kernels import resample as kernels
from ..kernels.resample import DEALT, SEED, SUMS
from ..registry import register
from ..runtime import stored
from ..sources.tables import FULL, LONGER, PRIMARY, relation
from ..sources.tables import Window as Days
from .concentration import SQL_VOLUMES, TOPS, mean_ranks, ranked, volumes

#: Replicates: of the bootstrap, of subsamples of each size, of permutations, of a tail; entities of a block; windows that are resampled.
REPLICATES, SUBSAMPLES, PERMUTATIONS, TAIL_REPLICATES, ENTITIES = 10_000, 2_000, 10_000, 2_000, 4096
WINDOWS = {"primary": PRIMARY, "longer": LONGER}
ALSO_ALL = WINDOWS | {"all": None}
POWERS = (0.5, 0.75, 0.9)
#: Percent of entities beyond a threshold: the quantile of the rest (type 7).
SHARES = {"5": "19/20", "10": "9/10", "15": "17/20", "20": "4/5"}
MEASURES = ["cr1", "cr4", "top_1pct", "hhi"]


def interval(long: DataFrame, *by: str) -> DataFrame:
    """by..., measure, mean, deviation and percentile interval over replicates of the long table of measure and value."""
    return long.groupBy(*by, "measure").agg(
        F.round(F.avg("value"), 8).alias("mean"), F.round(F.stddev_samp("value"), 8).alias("sd"), F.round(F.percentile("value", 0.025), 8).alias("low"),
        F.round(F.percentile("value", 0.975), 8).alias("high"), F.count(F.lit(1)).alias("replicates"),
    )


def numbered(names: list[str]) -> Column:
    """The name of a problem's number."""
    return F.element_at(F.array(*map(F.lit, names)), (F.col("problem") + 1).cast("int"))


def ranked_windows(spark: SparkSession, sf_dir: str, windows: dict = WINDOWS) -> DataFrame:
    """problem, entity, volume, rank, n of every window's entities, whose volumes come from one pass over the legs."""
    days, rows = [window or FULL for window in windows.values()], None
    legs = relation(spark, sf_dir, "attackers", ["tx_from", "amount_usd", "block_time"], Days(min(w.start for w in days), max(w.end for w in days)))
    sums = [F.round(F.sum(F.when(w.holds(F.col("block_time")), F.col("amount_usd"))), 2).alias(f"v{i}") for i, w in enumerate(days)]
    held = stored(legs.groupBy(F.col("tx_from").alias("entity")).agg(*sums))
    for i in range(len(days)):
        own = ranked(held.select("entity", F.col(f"v{i}").alias("volume")).where("volume > 0")).withColumn("problem", F.lit(i).cast("long"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def entity_blocks(rows: DataFrame) -> DataFrame:
    """problem, block, n, width, volume, key: entities by falling volume, some thousand a row, each with the number that a subsample's draws hang on."""
    rows = rows.select("problem", F.expr(f"(rank - 1) div {ENTITIES}").alias("block"), "n", "rank", "volume", F.xxhash64(F.lit(SEED), "entity").alias("key"))
    held = rows.groupBy("problem", "block", "n").agg(F.array_sort(F.collect_list(F.struct("rank", "volume", "key"))).alias("rows"))
    return held.select("problem", "block", "n", F.lit(ENTITIES).cast("long").alias("width"), F.col("rows.volume").alias("volume"), F.col("rows.key").alias("key"))


def plain_salts(spark: SparkSession, problems: int, each: int) -> DataFrame:
    """problem, salt: so many replicates of every problem, which share no deal (each is a multiple of a deal)."""
    return spark.range(problems * each).select(F.expr(f"id div {each}").alias("problem"), F.col("id").alias("salt"))


def dealt(resamples: DataFrame, *values: str) -> DataFrame:
    """problem, deal, and salt and values as lists."""
    lists = resamples.groupBy("problem", F.expr(f"salt div {DEALT}").alias("deal")).agg(F.array_sort(F.collect_list(F.struct("salt", *values))).alias("rows"))
    return lists.select("problem", "deal", *[F.col(f"rows.{c}").alias(c) for c in ("salt", *values)])


def spread_out(pairs: DataFrame) -> DataFrame:
    return pairs.repartition(max(8, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def resampled(blocks: DataFrame, resamples: DataFrame, sums: Callable = kernels.block_sums, tops: Callable = kernels.block_tops, values: tuple[str, ...] = ()) -> DataFrame:
    """problem, salt, measure, value of every resample (problem, salt, values): Gini, Herfindahl index and the shares of the leading 1, 4, 10, 20 and one percent of its
    draws. Blocks say what their draws add up to; only blocks in which a leading part ends are asked for it, by the same draws again."""
    pairs = spread_out(blocks.join(F.broadcast(dealt(resamples, *values)), "problem"))  # as many rows as deals
    held = stored(pairs.mapInPandas(sums, SUMS)).join(resamples, "salt")
    order, whole = Window.partitionBy("salt").orderBy("block"), Window.partitionBy("salt")
    placed = held.withColumns({"ahead": F.sum("drawn").over(order) - F.col("drawn"), "above": F.sum("held").over(order) - F.col("held"), "n": F.sum("drawn").over(whole)})
    d, v = F.col("n"), F.sum("held")
    totals = placed.groupBy("problem", "salt").agg(
        v.alias("total"), (10000 * F.sum("squares") / (v * v)).alias("hhi"),
        (1 - F.sum(2 * F.col("ahead") * F.col("held") + F.col("inside")) / (F.max(d) * v)).alias("gini"),
    )
    ends = {**{f"cr{k}": F.lit(k) for k in TOPS}, "top_1pct": F.expr("(n + 99) div 100")}
    parts = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.least(k.cast("long"), d).alias("last")) for m, k in ends.items()]))
    asked = placed.select("*", parts.alias("part")).where("ahead < part.last and part.last <= ahead + drawn")
    asked = stored(asked.select("problem", "block", "salt", *values, "above", "part.measure", (F.col("part.last") - F.col("ahead")).alias("take")))
    fields = ("salt", *values, "measure", "take")
    lists = asked.groupBy("problem", "block", F.expr(f"salt div {DEALT}").alias("deal")).agg(F.collect_list(F.struct(*fields)).alias("asked"))
    lists = lists.select("problem", "block", "deal", *[F.col(f"asked.{c}").alias(c) for c in fields])
    found = spread_out(blocks.join(lists, ["problem", "block"])).mapInPandas(tops, "salt long, measure string, top double")
    shares = asked.join(found, ["salt", "measure"]).join(totals.drop("problem"), "salt").select("problem", "salt", "measure", ((F.col("above") + F.col("top")) / F.col("total")).alias("value"))
    return totals.unpivot(["problem", "salt"], ["gini", "hhi"], "measure", "value").unionByName(shares)


def bootstrapped(spark: SparkSession, sf_dir: str, windows: dict) -> DataFrame:
    """window, measure, mean, deviation and interval of the named windows. A window's draws hang on its place, not on which windows follow."""
    blocks = stored(entity_blocks(ranked_windows(spark, sf_dir, windows)))
    return interval(resampled(blocks, plain_salts(spark, len(windows), REPLICATES)).withColumn("window", numbered(list(windows))), "window")


@register()
def x10_x11_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of Gini, Herfindahl index and the leading shares in both windows and over all days: every replicate draws exactly as many entities as there are, with replacement."""
    return bootstrapped(spark, sf_dir, ALSO_ALL)


@register()
def x12_subsamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of Gini, Herfindahl index and the leading shares over subsamples of n ** 0.5, 0.75 and 0.9 entities of both windows and of all days without replacement: those
    with the smallest keyed numbers, up to the m-th smallest, which is found first."""
    blocks = stored(entity_blocks(ranked_windows(spark, sf_dir, ALSO_ALL)))
    n = blocks.groupBy("problem").agg(F.max("n").alias("n"))
    powers = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("power")) for i, p in enumerate(POWERS)])).alias("p")
    asked = plain_salts(spark, len(ALSO_ALL), SUBSAMPLES).withColumnRenamed("salt", "id").select("problem", "id", powers).join(F.broadcast(n), "problem")
    asked = asked.select("problem", (F.col("id") * len(POWERS) + F.col("p.i")).alias("salt"), F.col("p.power").alias("power"), F.ceil(F.pow(F.col("n").cast("double"), F.col("p.power"))).alias("m"))
    pairs = spread_out(blocks.select("problem", "n", "key").join(dealt(asked, "m"), "problem"))
    found = pairs.mapInPandas(kernels.near_limit, "salt long, m long, below long, near array<long>").groupBy("salt", "m")
    found = found.agg((F.col("m") - F.sum("below")).alias("place"), F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    # The m-th smallest lies outside with a chance of some 10 ** -18; then the query fails rather than draw another number.
    cap = F.when(F.expr("place between 1 and size(near)"), F.element_at("near", F.col("place").cast("int"))).otherwise(F.raise_error(F.lit("no limit")))
    limits = stored(found.select("salt", cap.alias("cap")).join(asked.select("salt", "problem"), "salt"))
    rows = resampled(blocks, limits, values=("cap",)).join(asked.drop("problem"), "salt").withColumn("window", numbered(list(ALSO_ALL)))
    return interval(rows, "window", "power", "m")


def turned(rows: DataFrame, x: str, ys: dict[str, str], permutations: int, width: int = ENTITIES, shard: int = kernels.SHARD) -> DataFrame:
    """pair, rho, hits, permutations: rank correlation of x with each of ys (name -> column) over rows (entity, x and ys, none null), and how many of the permutations give one at
    least as large. A permutation deals the places of each shard out to the shards; a task has the places of two shards and adds up what permutations match between them, so that no rank is
    sent once for each permutation, and work grows with entities times permutations."""
    ranks = mean_ranks(rows, x, "x")
    for name, y in ys.items():
        ranks = ranks.join(mean_ranks(rows, y, f"y_{name}"), "entity")
    # Places follow x, so that blocks need no order of their own.
    placed = ranked(ranks.withColumnRenamed("x", "volume"), "volume").select("entity", F.col("volume").alias("x"), (F.col("rank") - 1).alias("place"), "n").join(ranks.drop("x"), "entity")
    centred = F.col("x") - (F.col("n") + 1) / 2
    names = list(ys)
    placed = stored(placed.select("place", "n", centred.alias("x"), *[(F.col(f"y_{name}") - (F.col("n") + 1) / 2).alias(f"y{i}") for i, name in enumerate(names)]))
    n = placed.agg(F.max("n")).first()[0] or 0
    count, spark = max(1, -(-n // shard)), placed.sparkSession
    deals = permutations // DEALT + 1
    parts = max(1, min(deals, 96 // count**2))  # some tasks at least
    # Lists of a shard: side 0 of x, sides from 1 of ys, in blocks by place; every list goes to as many tasks as there are shards, the runs of each deal (side -1) to their own.
    own, start = F.expr(f"((place + 1) * {count} - 1) div n").alias("own"), F.expr("(own * n) div " + str(count))
    held = placed.select("*", own).withColumn("block", ((F.col("place") - start) / width).cast("long")).groupBy("own", "block").agg(F.array_sort(F.collect_list(F.struct("place", "x", *[f"y{i}" for i in range(len(names))]))).alias("rows"))
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"rows.{c}").alias("data")) for i, c in enumerate(["x", *[f"y{i}" for i in range(len(names))]])])).alias("s")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("other")
    lists = stored(held.select("own", "block", sides)).select("own", F.col("block").alias("start"), "s.side", "s.data", others).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    of_x = F.col("side") == 0
    lists = lists.select(F.when(of_x, F.col("own")).otherwise(F.col("other")).alias("a"), F.when(of_x, F.col("other")).otherwise(F.col("own")).alias("b"), "part", "side", "start", "data")

    def dealt_out(frames):
        for frame in frames:
            for deal in frame["id"].tolist():
                runs = kernels.runs(kernels.transports(deal, n, shard)).astype(float)
                for a, b in np.ndindex(count, count):
                    yield pd.DataFrame({"a": a, "b": b, "part": deal % parts, "side": -1, "start": deal, "data": [runs[:, a, b].reshape(-1)]})

    tasks = count**2 * parts
    runs = spark.range(0, deals if n else 0, 1, deals).mapInPandas(dealt_out, "a long, b long, part long, side int, start long, data array<double>")
    groups = lists.unionByName(runs).repartition(min(4 * tasks, 2000), "a", "b", "part").groupBy("a", "b", "part")
    dots = groups.applyInPandas(kernels.met(n, permutations, shard), "r long, pair int, dot double").groupBy("r", "pair").agg(F.sum("dot").alias("dot"))
    own = placed.agg(*[F.struct(F.sum(F.col("x") * F.col(f"y{i}")).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col(f"y{i}") * F.col(f"y{i}"))).alias("norm")).alias(f"o{i}") for i in range(len(names))])
    observed = own.select(F.posexplode(F.array(*[f"o{i}" for i in range(len(names))])).alias("pair", "o")).select("pair", F.col("o.dot").alias("observed"), "o.norm")
    # A null that equals the observed value but for the order of summation counts as a hit.
    hits = dots.join(F.broadcast(observed), "pair").groupBy("pair").agg(
        F.max(F.col("observed") / F.col("norm")).alias("rho"), F.count_if(F.abs("dot") >= F.abs("observed") - 1e-12 * F.col("norm")).alias("hits"), F.count(F.lit(1)).alias("permutations")
    )
    return hits.select(F.element_at(F.array(*map(F.lit, names)), F.col("pair") + 1).alias("pair"), "rho", "hits", "permutations")


@register()
def x18_permutation_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of volume with active days, trades and mean size over entities with volume, and between the windows over entities of both, each with
    its two-sided permutation p, (hits + 1) / (permutations + 1)."""
    from .named import q4_bot_profiles

    bots = q4_bot_profiles(spark, sf_dir).where("total_volume_usd > 0")
    entity = bots.columns[0]
    bots = stored(bots.select(F.col(entity).alias("entity"), F.col("total_volume_usd").alias("volume"), "days_active", F.col("total_sandwich_trades").alias("trades"), F.expr("total_volume_usd / nullif(priced_trades, 0)").alias("mean_size")))
    a, b = (volumes(spark, sf_dir, w) for w in WINDOWS.values())
    both = a.join(b.withColumnRenamed("volume", "other"), "entity")
    pairs = {"volume, days_active": "days_active", "volume, trades": "trades", "volume, mean_size": "mean_size"}
    rows = turned(bots, "volume", pairs, PERMUTATIONS).unionByName(turned(both, "volume", {"volume, volume of the longer window": "other"}, PERMUTATIONS))
    return rows.select("pair", F.round("rho", 8).alias("rho"), ((F.col("hits") + 1) / (F.col("permutations") + 1)).alias("p"), "permutations")


def thresholds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entities of both windows (window, entity, volume, rank, n), and of every window and share its problem's number, threshold, k entities above and largest excess."""
    rows = stored(ranked_windows(spark, sf_dir).withColumnRenamed("problem", "window"))
    cuts = interpolated(rows, "volume", SHARES, ("window",)).unpivot(["window", "n"], list(SHARES), "share", "threshold")
    cuts = cuts.withColumn("problem", F.col("window") * len(SHARES) + F.array_position(F.array(*map(F.lit, SHARES)), F.col("share")) - 1)
    above = rows.join(F.broadcast(cuts.drop("n")), "window").where("volume > threshold").groupBy("problem").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("volume") - F.col("threshold")).alias("most"))
    return rows, stored(cuts.join(above, "problem"))


def tail_blocks(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """problem, block, width, k, most, share: excesses over every threshold as shares of the largest, by rank."""
    tail = rows.drop("n").join(F.broadcast(cuts), "window").where("volume > threshold")
    tail = tail.select("problem", "k", "most", "rank", F.expr(f"(rank - 1) div {ENTITIES}").alias("block"), ((F.col("volume") - F.col("threshold")) / F.col("most")).alias("share"))
    held = tail.groupBy("problem", "block", "k", "most").agg(F.array_sort(F.collect_list(F.struct("rank", "share"))).alias("rows"))
    return stored(held.select("problem", "block", "k", "most", F.lit(ENTITIES).cast("long").alias("width"), F.col("rows.share").alias("share")))


def pareto_fits(rows: DataFrame, cuts: DataFrame, tails: DataFrame, turns: int = 6) -> DataFrame:
    """problem, shape, scale of the likeliest generalised Pareto law of each problem's excesses: a peak of the profile tabulated over blocks, then Newton's steps on its slope
    from sums over all excesses, all problems in one job. Null where there is no peak with a shape above -1."""
    spark = rows.sparkSession

    def tabulated(frames):
        for frame in frames:
            for row in frame.itertuples():
                yield pd.DataFrame({"problem": [row.problem], "k": [row.k], "most": [row.most], "data": [kernels.profile(np.asarray(row.share, float)).sum(0).tobytes()]})

    total: dict[int, list] = {}
    # Two numbers for each node, of each block; blocks hold thousands.
    for r in tails.mapInPandas(tabulated, "problem long, k long, most double, data binary").groupBy("problem", "k", "most").agg(F.collect_list("data").alias("data")).collect():
        total[r["problem"]] = [r["k"], r["most"], sum(np.frombuffer(x, float) for x in r["data"])]
    theta = {p: f[0] / f[1] for p, (k, most, v) in total.items() if (f := kernels.peak(v / k, most))}
    x = F.col("volume") - F.col("threshold")
    tail = rows.drop("n").join(F.broadcast(cuts), "window").where("volume > threshold").select("problem", x.alias("x"), "most")
    found: dict[int, tuple[float, float]] = {}
    for turn in range(turns + 1 if theta else 0):
        at = spark.createDataFrame(list(theta.items()), "problem long, theta double")
        t = F.col("theta") * F.col("x")
        part = tail.join(F.broadcast(at), "problem").groupBy("problem", "theta").agg(F.avg(F.log1p(t)).alias("f"), F.avg(F.col("x") / (1 + t)).alias("d"), F.avg(F.col("x") * F.col("x") / ((1 + t) * (1 + t))).alias("dd"), F.max("most").alias("most"))
        for r in part.collect():
            found[r["problem"]] = r["f"], r["f"] / r["theta"]
            slope = 1 / r["theta"] - r["d"] * (1 + 1 / r["f"])
            bend = -1 / r["theta"] ** 2 + r["dd"] * (1 + 1 / r["f"]) + (r["d"] / r["f"]) ** 2
            new = r["theta"] - slope / bend if bend < 0 else r["theta"]
            if 1 + new * r["most"] > 0 and new * r["theta"] > 0 and abs(new - r["theta"]) < 0.5 * abs(r["theta"]):  # else the tabulated peak stays
                theta[r["problem"]] = new
    return spark.createDataFrame([(p, *found.get(p, (None, None))) for p in total], "problem long, shape double, scale double")


def described(problem_rows: DataFrame) -> DataFrame:
    shares = [s for _ in WINDOWS for s in SHARES]
    windows = [w for w in WINDOWS for _ in SHARES]
    return problem_rows.withColumns({"window": numbered(windows), "share": numbered(shares).cast("int") / 100})


@register()
def x89_pareto_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generalised Pareto laws by maximum likelihood of what exceeds the upper 5, 10, 15 and 20 percent of volumes, in both windows, with the index (one over the shape) where it is positive."""
    rows, cuts = thresholds(spark, sf_dir)
    fits = pareto_fits(rows, cuts, tail_blocks(rows, cuts))
    both = described(cuts.drop("window", "share").join(fits, "problem"))
    alpha = F.when(F.col("shape") > 0, 1 / F.col("shape"))
    return both.select("window", "share", "n", "k", F.round("threshold", 6).alias("threshold"), F.round("shape", 8).alias("shape"), F.round("scale", 6).alias("scale"), F.round(alpha, 8).alias("alpha"))


@register()
def x90_x91_tail_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of four measures of concentration under a semi-parametric bootstrap, by window and threshold: a replicate draws its number of tail entities from a binomial, refits the law to as
    many draws of the excesses as there are, draws the tail from it and the rest from the entities below; beside them the interval of the index, the refits without a peak (for which the fit
    of all excesses stands in), the measure itself, and its interval under a plain bootstrap, whose draws can't exceed what was seen."""
    rows, cuts = thresholds(spark, sf_dir)
    tails = tail_blocks(rows, cuts)
    fits = stored(pareto_fits(rows, cuts, tails))
    whole = cuts.join(fits.withColumnsRenamed({"shape": "own_shape", "scale": "own_scale"}), "problem").where("own_shape is not null").drop("window", "share").withColumn("parts", F.expr(f"(k + {ENTITIES - 1}) div {ENTITIES}"))
    salts = plain_salts(spark, len(WINDOWS) * len(SHARES), TAIL_REPLICATES)
    deals = dealt(salts).select("problem", "deal")
    # Neighbouring blocks of a deal go to one task, which adds them up before they are exchanged.
    tasks = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = tails.join(F.broadcast(deals), "problem").repartitionByRange(tasks, "problem", "deal", "block").sortWithinPartitions("problem", "deal", "block")
    sums = pairs.mapInPandas(kernels.refit_sums, "salt long, k long, most double, data binary")
    refits = stored(sums.repartition(tasks, "salt").mapInPandas(kernels.refits, "salt long, shape double, scale double"))
    drawn = salts.join(refits, "salt").join(F.broadcast(whole), "problem")
    failed = F.col("shape").isNull() | F.isnan("shape")
    drawn = stored(drawn.select("problem", "salt", F.when(failed, F.col("own_shape")).otherwise(F.col("shape")).alias("shape"), F.when(failed, F.col("own_scale")).otherwise(F.col("scale")).alias("scale"), failed.alias("failed")))
    law = F.broadcast(whole.select("problem", "k", "parts", "threshold"))
    below = rows.join(F.broadcast(cuts.select("problem", "window")), "window").join(law, "problem").where("rank > k")
    below = below.withColumn("block", F.expr(f"(rank - k - 1) div {ENTITIES} + parts")).groupBy("problem", "block", "n", "k", "parts", "threshold").agg(F.array_sort(F.collect_list(F.struct("rank", "volume"))).alias("rows"))
    fields = ["problem", "block", "n", "k", "parts", "threshold", "width", "volume"]
    below = below.select(*fields[:6], F.lit(ENTITIES).cast("long").alias("width"), F.col("rows.volume").alias("volume"))
    parts = whole.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(*fields[:6], F.lit(1).cast("long").alias("width"), F.lit(None).cast("array<double>").alias("volume"))
    tail = interval(resampled(stored(below.unionByName(parts)), drawn.drop("failed"), kernels.tail_sums, kernels.tail_tops, ("shape", "scale")).where(F.col("measure").isin(MEASURES)), "problem")
    index = drawn.groupBy("problem").agg(*[F.round(F.percentile(F.when(F.col("shape") > 0, 1 / F.col("shape")), p), 8).alias(c) for c, p in (("alpha_low", 0.025), ("alpha_high", 0.975))], F.count_if("failed").alias("refits_without_peak"))
    blocks = stored(entity_blocks(rows.withColumnRenamed("window", "problem")))
    naive = interval(resampled(blocks, plain_salts(spark, len(WINDOWS), TAIL_REPLICATES)).where(F.col("measure").isin(MEASURES)), "problem")
    leading = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("volume"))) / F.sum("volume")
    point = rows.groupBy("window").agg(
        leading(F.lit(1)).alias("cr1"), leading(F.lit(4)).alias("cr4"), leading(F.expr("(n + 99) div 100")).alias("top_1pct"), (10000 * F.sum(F.col("volume") * F.col("volume")) / (F.sum("volume") * F.sum("volume"))).alias("hhi"),
    ).unpivot(["window"], MEASURES, "measure", "value")
    about = whole.join(index, "problem").withColumn("w", F.expr(f"problem div {len(SHARES)}"))
    own = naive.select(F.col("problem").alias("w"), "measure", F.col("low").alias("plain_low"), F.col("high").alias("plain_high"))
    rows_ = tail.join(F.broadcast(about), "problem").join(F.broadcast(own), ["w", "measure"]).join(F.broadcast(point.withColumnRenamed("window", "w")), ["w", "measure"])
    return described(rows_).select(
        "window", "share", "measure", F.round("value", 8).alias("value"), "mean", "low", "high", "plain_low", "plain_high", "k", F.round("threshold", 6).alias("threshold"), F.round("own_shape", 8).alias("shape"), "alpha_low", "alpha_high", "refits_without_peak", "replicates"
    )


@register()
def x89_x91_tail_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hill index over the leading tenth and its spread over replicates that draw as many entities of the tail as it has, beside the asymptotic error."""
    rows = ranked(volumes(spark, sf_dir)).withColumn("k", F.expr("(n + 9) div 10"))
    cut = rows.where("rank = k + 1").select(F.log("volume").alias("threshold"))
    tail = rows.where("rank <= k").crossJoin(F.broadcast(cut)).select("rank", "k", (F.log("volume") - F.col("threshold")).alias("excess"))
    held = tail.groupBy(F.expr(f"(rank - 1) div {ENTITIES}").alias("block"), "k").agg(F.array_sort(F.collect_list(F.struct("rank", "excess"))).alias("rows"))
    blocks = stored(held.select("block", "k", F.col("rows.excess").alias("excess")))

    def sums(frames):
        for frame in frames:
            for row in frame.itertuples():
                w = kernels.times(row.deal, row.k, ENTITIES, row.block, len(row.excess))
                yield pd.DataFrame({"salt": row.deal * DEALT + np.arange(DEALT), "drawn": w.sum(1), "held": w @ np.asarray(row.excess, float)})

    deals = dealt(plain_salts(spark, 1, TAIL_REPLICATES)).select("deal")
    alphas = spread_out(blocks.crossJoin(F.broadcast(deals))).mapInPandas(sums, "salt long, drawn long, held double").groupBy("salt").agg((F.sum("drawn") / F.sum("held")).alias("alpha"))
    spread = alphas.agg(F.round(F.stddev_samp("alpha"), 8).alias("bootstrap_se"), F.round(F.percentile("alpha", 0.025), 8).alias("low"), F.round(F.percentile("alpha", 0.975), 8).alias("high"), F.count(F.lit(1)).alias("replicates"))
    own = tail.agg(F.round(1 / F.avg("excess"), 8).alias("alpha"), F.max("k").alias("k")).withColumn("asymptotic_se", F.round(F.col("alpha") / F.sqrt("k"), 8))
    return own.crossJoin(F.broadcast(spread))


@register()
def x92_pareto_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every excess over each window's thresholds beside the quantile of the fitted law at its plotting position, (i - 0.5) / k, i counted from the smallest."""
    rows, cuts = thresholds(spark, sf_dir)
    fits = pareto_fits(rows, cuts, tail_blocks(rows, cuts))
    tail = rows.drop("n").join(F.broadcast(cuts), "window").where("volume > threshold").join(F.broadcast(fits), "problem").where("shape is not null")
    p = (F.col("k") - F.col("rank") + 0.5) / F.col("k")
    law = F.when(F.abs("shape") < 1e-9, -F.col("scale") * F.log1p(-p)).otherwise(F.col("scale") * F.expm1(-F.col("shape") * F.log1p(-p)) / F.col("shape"))
    return described(tail.drop("window", "share")).select("window", "share", (F.col("k") - F.col("rank") + 1).alias("i"), F.round(p, 10).alias("position"), F.round(F.col("volume") - F.col("threshold"), 2).alias("excess"), F.round(law, 4).alias("model_quantile"))


#: Thresholds of the mean excess: so many quantiles evenly from 0.70 to 0.99.
GRID = 60
SQL_GRID = f"""WITH {SQL_VOLUMES}, g AS (SELECT unnest(range(0, {GRID})) AS i), u AS (SELECT i, (SELECT quantile_cont(volume, [{", ".join(f"{4130 + 29 * i}/5900.0" for i in range(GRID))}]) FROM r)[i + 1] AS u FROM g)
    SELECT CAST(i AS INTEGER) AS i, round(u, 4) AS threshold, count(volume) AS n_above, CASE WHEN count(volume) > 5 THEN round(avg(volume - u), 4) END AS mean_excess FROM u LEFT JOIN r ON volume > u + 1e-6 GROUP BY i, u"""


@register(SQL_GRID)
def x92_mean_excess_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of what exceeds a threshold over sixty thresholds between the quantiles 0.70 and 0.99 (type 7); null where no more than five entities do."""
    vol = stored(volumes(spark, sf_dir))
    cuts = interpolated(vol, "volume", {f"p{i}": f"{4130 + 29 * i}/5900" for i in range(GRID)}).unpivot([], [f"p{i}" for i in range(GRID)], "i", "threshold")
    cuts = cuts.select(F.substring("i", 2, 2).cast("int").alias("i"), "threshold")
    above = vol.crossJoin(F.broadcast(cuts)).where("volume > threshold + 1e-6").groupBy("i").agg(F.count(F.lit(1)).alias("n_above"), F.avg(F.col("volume") - F.col("threshold")).alias("mean"))
    return cuts.join(above, "i", "left").select("i", F.round("threshold", 4).alias("threshold"), F.coalesce("n_above", F.lit(0).cast("long")).alias("n_above"), F.when(F.col("n_above") > 5, F.round("mean", 4)).alias("mean_excess"))
