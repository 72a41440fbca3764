"""Exact Jaccard links inside families of candidate sets.

A family is a component of the candidate graph, so that no link leaves it. A small family is verified as a whole. In a
larger one a few members, its hubs, are first compared with all others, which are dealt over tasks; what hangs together by
then is not compared again. The members that no hub has brought into the family's largest part are dealt into blocks, and so
are all others; each pair of blocks with a block of those is a task's work of its own. So thousands of near copies of one text cost
some comparisons each, and no family, however large, has to fit into one task. What leaves a task are the edges of a spanning
forest of the links found, never the pairs. A member goes to each of those pairs, so blocks are a sixteenth of the family as
long as they stay small: what is copied then grows with the family and not with a power of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored
from .components import connected, forest

BLOCK, SLICE, HUBS = 128, 1 << 16, 8
#: Blocks that a large family is dealt into, as long as one has no more members and bytes of data than these.
BLOCKS, MOST, MOST_BYTES = 16, 1024, 1 << 20
#: Numbers of an incidence matrix.
MATRIX = 1 << 23
#: Members of a cell whose sets are merged pair by pair; products of matrices pay off beyond that.
FEW = 8
#: Bytes of data, of many small cells, of which sets are made at once.
BATCH_BYTES = 150_000
Compare = Callable[[np.ndarray, list[bytes], np.ndarray, int], tuple[np.ndarray, np.ndarray]]
SetsOf = Callable[[list[bytes]], list[np.ndarray]]


def intersections(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sorted sets, by products of their incidence matrices, a slice of the
    shared elements at a time. Counts stay far below 2**24, so that 32-bit products are exact."""
    out = np.zeros((len(sets), len(others)), np.float32)
    both = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (sets, others)]
    shared = np.intersect1d(*both)
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (sets, others)]
    at = [np.minimum(np.searchsorted(shared, x), max(0, len(shared) - 1)) for x in both]
    hit = [shared[a] == x if len(shared) else np.zeros(len(x), bool) for a, x in zip(at, both)]
    step = max(1, min(SLICE, MATRIX // max(1, len(sets), len(others))))
    for low in range(0, len(shared), step):
        made = []
        for side, n in ((0, len(sets)), (1, len(others))):
            inside = hit[side] & (at[side] >= low) & (at[side] < low + step)
            m = np.zeros((n, min(step, len(shared) - low)), np.float32)
            m[owner[side][inside], at[side][inside] - low] = 1
            made.append(m)
        out += made[0] @ made[1].T
    return np.rint(out).astype(np.int64)


def links(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between nodes: across the two sides, or inside one if all are on the same."""
    a = np.flatnonzero(side == side.min())
    b = np.flatnonzero(side == side.max())
    n = np.array([len(s) for s in sets], np.int64)
    if len(nodes) <= FEW:
        root, x, y = list(range(len(nodes))), [], []
        for i in range(1, len(nodes)):
            for j in range(i):
                # What hangs together already needs no other link.
                if root[i] == root[j] or len(a) + len(b) == len(nodes) and side[i] == side[j]:
                    continue
                total, least = len(sets[i]) + len(sets[j]), min(len(sets[i]), len(sets[j]))
                if 100 * least >= percent * (total - least):
                    both = np.concatenate([sets[i], sets[j]])
                    both.sort()
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    if common and 100 * common >= percent * (total - common):
                        old, new = root[i], root[j]
                        root = [new if r == old else r for r in root]
                        x.append(i)
                        y.append(j)
        return nodes[np.array(x, np.int64)], nodes[np.array(y, np.int64)]
    common = intersections([sets[i] for i in a], [sets[i] for i in b])
    linked = 100 * common >= percent * (n[a][:, None] + n[b][None, :] - common)
    x, y = np.nonzero(linked & (common > 0))
    return forest(nodes[a[x]], nodes[b[y]])


def hashes_of(data: list[bytes]) -> list[np.ndarray]:
    """Sets that travel as sorted unsigned 64-bit hashes."""
    return [np.frombuffer(d, np.uint64) for d in data]


def compared(dealt: DataFrame, percent: int, compare: Compare | None, sets_of: SetsOf = hashes_of) -> DataFrame:
    """a, b: the links in each cell (family, i, j) of rows with slot, node, data: across its two slots, or inside the one where i = j.
    Without compare they are those of the sets that sets_of makes of data, of many small cells at once."""
    keys = ["family", "i", "j"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, nodes, data_of, side = None, [], [], []
        out: list[tuple[np.ndarray, np.ndarray]] = []
        cells: list[tuple[np.ndarray, list[bytes], np.ndarray]] = []
        size = 0

        def all_cells() -> None:
            nonlocal size
            sets, at = sets_of([d for _, data, _ in cells for d in data]), 0
            for own, data, sides in cells:
                out.append(links(own, sets[at : at + len(data)], sides, percent))
                at += len(data)
            cells.clear()
            size = 0

        def done() -> None:
            nonlocal size
            if len(nodes) > 1 and (held_key[1] == held_key[2] or len(set(side)) == 2):
                cell = np.array(nodes, np.int64), data_of, np.array(side)
                if compare:
                    out.append(compare(*cell, percent))
                    return
                cells.append(cell)
                size += sum(map(len, data_of))
                if size > BATCH_BYTES:
                    all_cells()

        for batch in batches:
            for family, i, j, slot, node, data in zip(*(batch.column(c).to_pylist() for c in (*keys, "slot", "node", "data"))):
                if (family, i, j) != held_key:
                    done()
                    held_key, nodes, data_of, side = (family, i, j), [], [], []
                nodes.append(node)
                data_of.append(data)
                side.append(slot)
        done()
        all_cells()
        a, b = forest(*(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = dealt.select(*keys, "slot", "node", "data")
    return rows.repartition(partitions(dealt.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(verify, "a long, b long")


def verified_links(members: DataFrame, percent: int, block: int = BLOCK, compare: Compare | None = None, sets_of: SetsOf = hashes_of) -> DataFrame:
    """a, b (nodes) for members (family, node, data, and size, the members of the family, where it is known): edges that connect exactly what is linked, directly or over others, by
    100 * intersection >= percent * union of the sets in data, as compare finds them or sets_of makes them."""
    spark = members.sparkSession
    if "size" in members.columns:
        sizes = members = stored(members.select("family", "node", "data", "size"), "members")
    else:
        members = stored(members.select("family", "node", "data"), "members")
        sizes = stored(members.groupBy("family").agg(F.count(F.lit(1)).alias("size")), "family_sizes")
        members = members.join(sizes, "family")
    zero = F.lit(0)
    small = compared(members.where(F.col("size") <= block).select("*", zero.alias("i"), zero.alias("j"), zero.alias("slot")), percent, compare, sets_of)
    large = members.where(F.col("size") > block)
    if sizes.where(F.col("size") > block).isEmpty():
        return small
    small = stored(small, "links")
    # Dealt out by node first, so that the members of a large family are copied to their blocks by all tasks alike.
    crowd = stored(large.repartition(partitions(spark), "node"), "crowd")
    first = Window.partitionBy("family").orderBy(F.xxhash64("node"), "node")
    hubs = crowd.select("family", "node").withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= HUBS).select("family", "node")
    width = F.greatest(F.lit(block), F.ceil(F.sqrt("size")))
    slots = F.ceil(F.col("size") / width).cast("int")
    spread = crowd.withColumns({"i": F.pmod(F.xxhash64("node"), slots).cast("int"), "slot": zero})
    around = crowd.join(hubs, ["family", "node"], "left_semi").withColumns({"i": F.explode(F.sequence(zero, slots - 1)), "slot": F.lit(1)})
    by_hubs = stored(compared(spread.unionByName(around).withColumn("j", F.lit(-1)), percent, compare, sets_of), "hub_links")
    label = connected(by_hubs)
    labelled = stored(crowd.join(label, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), "labelled")
    counts = labelled.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("data")).alias("bytes"))
    counts = counts.groupBy("family").agg(F.max(F.struct("n", "label")).alias("main"), F.greatest(F.sum("bytes"), F.lit(1)).alias("bytes"))
    parts = stored(counts.select("family", F.col("main.label").alias("main"), F.col("main.n").alias("n_main"), "bytes"), "main_parts")
    width = F.greatest(width, F.least(F.ceil(F.col("size") / BLOCKS), F.lit(MOST), F.floor(MOST_BYTES * F.col("size") / F.col("bytes"))))
    rest = labelled.join(parts, "family").where(F.col("n_main") < F.col("size")).withColumn("alone", F.col("label") != F.col("main"))
    n_main, n_rest = F.ceil(F.col("n_main") / width).cast("int"), F.ceil((F.col("size") - F.col("n_main")) / width).cast("int")
    turn = F.xxhash64("node")
    copied = (
        rest.withColumn("slot", F.when(F.col("alone"), n_main + F.pmod(turn, n_rest)).otherwise(F.pmod(turn, n_main)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.when(F.col("alone"), 0).otherwise(n_main), n_main + n_rest - 1)))
        .withColumns({"i": F.least("slot", "other"), "j": F.greatest("slot", "other")})
    )
    return small.unionByName(by_hubs).unionByName(compared(copied, percent, compare, sets_of))
