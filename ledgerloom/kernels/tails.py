"""P-values from the mathematics library inside the JVM; tail probabilities that 1 - cdf would round to nothing come from the beta function."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _distributions(spark: SparkSession):
    return spark._jvm.org.apache.commons.math3


def t_two_sided(spark: SparkSession, t: float, df: float) -> float:
    return f_tail(spark, t * t, 1, df)


def f_tail(spark: SparkSession, f: float, d1: float, d2: float) -> float:
    return float(_distributions(spark).special.Beta.regularizedBeta(float(d2 / (d2 + d1 * f)), float(d2 / 2), float(d1 / 2)))


def chi_square_tail(spark: SparkSession, x: float, df: float) -> float:
    return float(_distributions(spark).special.Gamma.regularizedGammaQ(float(df / 2), float(x / 2)))


def normal_two_sided(spark: SparkSession, z: float) -> float:
    return float(_distributions(spark).special.Erf.erfc(float(abs(z) / 2**0.5)))


def t_quantile(spark: SparkSession, p: float, df: float) -> float:
    return float(_distributions(spark).distribution.TDistribution(float(df)).inverseCumulativeProbability(float(p)))


def with_holm(rows: list[list], at: int) -> None:
    """Appends Holm's corrected p to every row, whose p stands at a place; a null p is no test and stays null."""
    order = sorted((i for i, r in enumerate(rows) if r[at] is not None), key=lambda i: rows[i][at])
    worst, corrected = 0.0, dict.fromkeys(range(len(rows)))
    for turn, i in enumerate(order):
        worst = max(worst, min(1.0, (len(order) - turn) * rows[i][at]))
        corrected[i] = worst
    for i, row in enumerate(rows):
        row.append(corrected[i])
