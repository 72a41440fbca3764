"""Exact ranks and quantiles without a global sort in one task.

Equal values are counted first (partial sums), so that a value that fills a third of the rows is one record. Values are dealt into
buckets by a monotone function; the counts of the buckets, of which there is a bounded number, give every bucket its
offset, and inside a bucket a running sum gives every value its ranks.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each factor of e in value.
FINENESS = 1024


def bucket(value: Column) -> Column:
    """A whole number that never falls as the value rises."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * FINENESS).cast("long")


def value_ranks(df: DataFrame, value: str, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """by..., value, copies, below (rows with a smaller value), n (rows) for each distinct value that isn't null. weight: a column of
    whole numbers, as which many rows each counts."""
    copies = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(copies.alias("copies")).withColumn("_bucket", bucket(F.col(value)))
    order = Window.partitionBy(*by).orderBy("_bucket")
    sizes = (
        counted.groupBy(*by, "_bucket")
        .agg(F.sum("copies").alias("_size"))
        .select(*by, "_bucket", (F.sum("_size").over(order) - F.col("_size")).alias("_offset"), F.sum("_size").over(Window.partitionBy(*by)).alias("n"))
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(value)
    below = F.col("_offset") + F.sum("copies").over(inside) - F.col("copies")
    return counted.join(sizes, [*by, "_bucket"]).select(*by, value, "copies", below.alias("below"), "n")


def quantiles(df: DataFrame, value: str, probabilities: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """by..., n and for each name the type-1 quantile: the smallest value whose rank is at least p * n."""
    ranks = value_ranks(df, value, by)
    picks = []
    for name, p in probabilities.items():
        f = Fraction(p)
        rank = F.expr(f"(n * {f.numerator} + {f.denominator - 1}) div {f.denominator}")
        picks.append(F.max(F.when((F.col("below") < rank) & (rank <= F.col("below") + F.col("copies")), F.col(value))).alias(name))
    return ranks.groupBy(*by).agg(F.max("n").alias("n"), *picks)


def interpolated(df: DataFrame, value: str, probabilities: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """As quantiles, but type 7: linear between the two order statistics around 1 + (n - 1) * p."""
    ranks, picks = value_ranks(df, value, by), []
    for name, p in probabilities.items():
        f = Fraction(p)
        whole = F.expr(f"((n - 1) * {f.numerator}) div {f.denominator}")
        part = F.expr(f"((n - 1) * {f.numerator}) % {f.denominator}") / f.denominator
        at = lambda r: F.max(F.when((F.col("below") < r) & (r <= F.col("below") + F.col("copies")), F.col(value)))
        low, high = at(whole + 1), at(F.least(whole + 2, F.col("n")))
        picks.append((low + (high - low) * F.max(part)).alias(name))
    return ranks.groupBy(*by).agg(F.max("n").alias("n"), *picks)
