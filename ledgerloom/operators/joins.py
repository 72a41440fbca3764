"""Joins that state what they rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unique_on(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, with an error from the engine as soon as a row of a repeated key is met: a join to it can't fan out."""
    counted = df.withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return counted.where(F.assert_true(F.col("_copies") == 1, F.lit(f"repeated key {keys}")).isNull()).drop("_copies")


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join in which every left row meets at most one right row; a repeated right key raises."""
    return left.join(unique_on(right, keys), keys, how)


def missing_keys(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are expected and not there."""
    return expected.select(*keys).distinct().join(found.select(*keys).distinct(), keys, "left_anti")


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    """Whether both hold the same set of keys."""
    return missing_keys(a, b, keys).isEmpty() and missing_keys(b, a, keys).isEmpty()
