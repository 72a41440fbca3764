"""Numbers as a report writes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(x: Column, places: int = 0) -> Column:
    return F.format_number(x, places)


def currency(x: Column, sign: str = "$", places: int = 2) -> Column:
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lit(sign), F.format_number(F.abs(x), places))


def percent(x: Column, places: int = 2) -> Column:
    """x is in percent already."""
    return F.concat(F.regexp_replace(F.format_number(x, places), ",", ""), F.lit("%"))
