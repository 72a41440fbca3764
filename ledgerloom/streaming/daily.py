"""The daily activity series as a stream: the batch product's tumbling day over events that may come late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_activity(events: DataFrame, time: str = "block_time", late: str = "2 days") -> DataFrame:
    """date, legs, priced legs, volume and estimated distinct takers of each day of a stream with columns time, amount_usd and taker. A day is
    given out once the watermark has passed it; exact distinct counts need the batch product, since a stream keeps a sketch."""
    timed = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    days = timed.groupBy(F.window("_time", "1 day").alias("day")).agg(
        F.count(F.lit(1)).alias("sandwich_trade_count"),
        F.count("amount_usd").alias("priced_trade_count"),
        F.round(F.sum("amount_usd"), 2).alias("total_sandwich_volume_usd"),
        F.approx_count_distinct("taker", 0.02).alias("unique_sandwich_bots"),
    )
    return days.select(F.to_date("day.start").alias("date"), *[c for c in days.columns if c != "day"])


def marked(events: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """A stream with a column is_known: whether its keys are among those of a static table (a left join, so that nothing is lost)."""
    return events.join(keys.select(*on).distinct().withColumn("_known", F.lit(1)), on, "left").withColumn("is_known", F.col("_known").isNotNull()).drop("_known")
