"""Connected components of large graphs: union-find inside partitions, then alternating stars over the whole graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes other than the smallest of each component of these edges, and that smallest node."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == label[b]).all():
            break
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != (up := label[label])).any():
            label = up
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges, replaced by the stars of its own components."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a = np.append(a, np.asarray(batch.column("a"), np.int64))
        b = np.append(b, np.asarray(batch.column("b"), np.int64))
        if len(a) > 4_000_000:
            a, b = forest(a, b)
    a, b = forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def connected(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """node, component for every node that has an edge to another; component is the smallest node of its component, which
    itself has no row. Every round halves what is left of long chains; a node with very many edges is never gathered: its
    smallest neighbour is a partial minimum, and the join that hands it round is one that the engine can split."""
    now = stored(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").mapInArrow(_local, "a long, b long").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # The sum of hashes, as a decimal, tells whether a round has changed anything.
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.count_distinct("a").alias("nodes")).first()
        roots_only = state["n"] == state["nodes"] and now.alias("x").join(now.alias("y"), F.col("x.b") == F.col("y.a"), "left_semi").isEmpty()
        if roots_only or (state["n"], state["h"]) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = (state["n"], state["h"])
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        # Written first: only a join of plain tables is one that the engine splits where a node has very many edges.
        least = stored(least, "least")
        large = both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "large_star")
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = stored(small.unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct(), "small_star")
    raise RuntimeError(f"components are still joining after {max_rounds} rounds")
