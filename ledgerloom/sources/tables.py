"""The event relations: all swaps, attacker legs and victim swaps, laid over order-line tables.

A relation is built from the columns that a query asks for: the joins that bring the sender (orders) or the protocol (part) are
only there if their columns are, so that Catalyst reads and shuffles nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Window:
    """A half-open range of days."""

    start: str
    end: str

    def holds(self, time: Column) -> Column:
        """Bare column against constants, so that the range reaches the scan."""
        return (time >= F.lit(self.start).cast("timestamp_ntz")) & (time < F.lit(self.end).cast("timestamp_ntz"))


#: All data; and the nested pair that cross-window checks compare.
FULL = Window("1995-01-01", "2002-01-01")
PRIMARY = Window("1997-01-01", "1999-01-01")
LONGER = Window("1997-01-01", "1999-07-01")

ROLES = {"trades": None, "victims": "R", "attackers": "A"}
SENDER, PROTOCOL = {"tx_from"}, {"project", "version"}


def relation(spark: SparkSession, sf_dir: str, role: str, columns: list[str], window: Window = FULL, lines: DataFrame | None = None) -> DataFrame:
    """The named columns of a relation inside a window. amount_usd is NULL (unpriced) or 0 on two line numbers each."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet") if lines is None else lines
    lines = lines.where(window.holds(F.col("l_shipdate")))
    if ROLES[role]:
        lines = lines.where(F.col("l_returnflag") == ROLES[role])
    amount = F.when(F.col("l_linenumber") == 7, None).when(F.col("l_linenumber") == 6, 0.0).otherwise(F.col("l_extendedprice"))
    named = {
        "tx_hash": F.col("l_orderkey"),
        "evt_index": F.col("l_linenumber"),
        "block_time": F.col("l_shipdate"),
        "amount_usd": amount,
        "taker": F.col("l_suppkey"),
        "quantity": F.col("l_quantity"),
    }
    if SENDER & set(columns):
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        named["tx_from"] = F.col("o_custkey")
    if PROTOCOL & set(columns):
        part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_type")
        lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        named |= {"project": F.col("p_brand"), "version": F.col("p_type")}
    return lines.select(*[named[c].alias(c) for c in columns])


#: The same relations for the oracle engine.
SQL_RELATIONS = """
trades AS (
    SELECT l_orderkey AS tx_hash, l_linenumber AS evt_index, l_shipdate AS block_time,
        CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 0.0 ELSE l_extendedprice END AS amount_usd,
        l_suppkey AS taker, o_custkey AS tx_from, p_brand AS project, p_type AS version, l_quantity AS quantity, l_returnflag AS flag
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '2002-01-01'
), victims AS (SELECT * FROM trades WHERE flag = 'R'), attackers AS (SELECT * FROM trades WHERE flag = 'A')
"""
