"""Approximate nearest neighbours: a robust-pruned directed graph over each shard of the vectors, searched by beams.

Equal vectors are one node of a graph, with those of their ids that an answer can hold (the smallest, one more than an answer has): a
window whose limit works before its exchange finds them, so copies never meet. Nodes are dealt by hash into shards of some thousand; a
shard's graph is built in one task, in batches: beams from the node nearest to the mean propose neighbours on the graph so far, and relaxed pruning keeps
a proposal unless one kept before is nearer to it by the factor RELAXED; edges back are added, and lists that overflow are pruned alike. The
index is a row for each shard. Queries are packed by some thousand and pass through every shard of their length one pack after
another, all of a pack's beams in step; what the beams end with is measured again in double precision, in the order of the components. The k
nearest of each shard are merged by a window over at most k rows for each query and shard.

Every row is in the index, and every shard is searched by every query; only what a beam misses in a shard is lost. A test and the README have the recall.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of different lengths are
never compared; an id that occurs on several rows is as many candidates; a query with the id on several rows has an answer for each different
vector, and none of the id's rows is in it; a null id is no query and no candidate; an empty table gives an empty result; other columns are
ignored. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, partitions, stored

#: Nodes of a shard (about), edges of a node at most, width of beams while building and searching, and the factor of relaxed pruning.
SHARD, DEGREE, BUILDING, SEARCHING, RELAXED = 4096, 32, 64, 96, 1.2
#: Nodes that are added at a time, nodes of a beam that are followed at a time, queries of a pack, queries that are searched in step.
ADDED, FOLLOWED, PACK, IN_STEP = 256, 4, 4096, 256
#: Elements of the tables of distances that pruning holds at a time.
ROOM = 4 << 20


def apart(points: np.ndarray, norms: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances (but for the query's own norm) of q (a row each) to the points at (a row of places each)."""
    return norms[at] - 2 * np.matmul(points[at], q[:, :, None])[:, :, 0]


def beams(points: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, width: int) -> np.ndarray:
    """For every query (row of q) the places of the width nearest found, nearest first, -1 where there are fewer. All beams move in step."""
    n, width = len(points), min(width, len(points))
    at = np.full((len(q), width), -1, np.int32)
    far = np.full((len(q), width), np.inf, np.float32)
    fresh = np.zeros((len(q), width), bool)
    seen = np.zeros((len(q), n + 1), bool)  # the last place stands for none
    seen[:, n] = True
    at[:, 0], fresh[:, 0], seen[:, start] = start, True, True
    far[:, 0] = apart(points, norms, np.full((len(q), 1), start), q)[:, 0]
    live = np.arange(len(q))
    while len(live):
        order = np.cumsum(fresh[live], axis=1)
        follow = fresh[live] & (order <= FOLLOWED)
        fresh[live] &= ~follow
        rows, places = np.nonzero(follow)
        turn = (order[rows, places] - 1).astype(np.int64)
        next_ = np.full((len(live), FOLLOWED, graph.shape[1]), n, np.int32)
        next_[rows, turn] = graph[at[live[rows], places]]
        next_ = next_.reshape(len(live), -1)
        next_[next_ < 0] = n
        next_.sort(axis=1)
        known = seen[live[:, None], next_]
        known[:, 1:] |= next_[:, 1:] == next_[:, :-1]
        seen[live[:, None], next_] = True
        # Places not seen before move to the front, so that only as many columns are measured as the fullest row has.
        front = np.argsort(known, axis=1, kind="stable")[:, : max(1, int((~known).sum(axis=1).max()))]
        next_, known = np.take_along_axis(next_, front, 1), np.take_along_axis(known, front, 1)
        near = apart(points, norms, np.where(known, 0, next_), q[live])
        near[known] = np.inf
        all_far = np.concatenate([far[live], near], axis=1)
        best = np.argsort(all_far, axis=1, kind="stable")[:, :width]
        take = lambda own, new: np.take_along_axis(np.concatenate([own, new], axis=1), best, 1)
        at[live], fresh[live] = take(at[live], next_), take(fresh[live], ~known)
        far[live] = np.take_along_axis(all_far, best, 1)
        fresh[live] &= np.isfinite(far[live])
        live = live[fresh[live].any(axis=1)]
    return np.where(np.isfinite(far), at, -1)


def pruned(points: np.ndarray, norms: np.ndarray, own: np.ndarray, offered: np.ndarray, degree: int, relaxed: float) -> np.ndarray:
    """Edges of the nodes own out of those offered (a row of places each, -1 for none): the nearest stays, and those it is much nearer to go."""
    out = np.full((len(own), degree), -1, np.int32)
    rows = max(1, ROOM // max(1, offered.shape[1] ** 2))
    for a in range(0, len(own), rows):
        some, mine = offered[a : a + rows], own[a : a + rows]
        some = np.sort(some, axis=1)
        none = (some < 0) | (some == mine[:, None])
        none[:, 1:] |= some[:, 1:] == some[:, :-1]
        place = np.where(none, 0, some)
        own_far = np.maximum(apart(points, norms, place, points[mine]) + norms[mine][:, None], 0)
        own_far[none] = np.inf
        order = np.argsort(own_far, axis=1, kind="stable")
        place, own_far = np.take_along_axis(place, order, 1), np.take_along_axis(own_far, order, 1)
        held = points[place]
        between = norms[place][:, :, None] + norms[place][:, None, :] - 2 * np.matmul(held, held.transpose(0, 2, 1))
        alive = np.isfinite(own_far)
        each = np.arange(len(mine))
        for turn in range(degree):
            first = alive.argmax(axis=1)
            any_ = alive[each, first]
            if not any_.any():
                break
            out[a : a + rows][any_, turn] = place[each, first][any_]
            alive &= relaxed * relaxed * between[each, first] > own_far
            alive[each, first] = False
    return out


def built(points: np.ndarray, seed: int, degree: int = DEGREE, width: int = BUILDING, relaxed: float = RELAXED) -> tuple[np.ndarray, int]:
    """The graph (a row of places for each point, -1 for none) and the place at which searches start."""
    n = len(points)
    points = points.astype(np.float32)
    norms = (points * points).sum(axis=1)
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    rng = np.random.default_rng(seed)
    graph = np.full((n, degree), -1, np.int32)
    if n > 1:
        own = rng.integers(0, n - 1, (n, min(degree, n - 1))).astype(np.int32)
        graph[:, : own.shape[1]] = own + (own >= np.arange(n)[:, None])  # random edges to begin with
    turn = rng.permutation(n)
    for a in range(0, n, ADDED):
        new = turn[a : a + ADDED]
        found = beams(points, norms, graph, start, points[new], width)
        graph[new] = pruned(points, norms, new, np.concatenate([found, graph[new]], axis=1), degree, relaxed)
        ends, begins = graph[new].reshape(-1), np.repeat(new, degree).astype(np.int32)
        begins, ends = begins[ends >= 0], ends[ends >= 0]
        there = (graph[ends] == begins[:, None]).any(axis=1)
        begins, ends = begins[~there], ends[~there]
        order = np.argsort(ends, kind="stable")
        begins, ends = begins[order], ends[order]
        nodes, at, count = np.unique(ends, return_index=True, return_counts=True)
        by_count = np.argsort(count, kind="stable")
        for some in np.array_split(by_count, max(1, -(-len(by_count) // ADDED))):
            if not len(some):
                continue
            wide = int(count[some].max())
            cells = at[some][:, None] + np.arange(wide)[None, :]
            more = np.where(np.arange(wide)[None, :] < count[some][:, None], begins[np.minimum(cells, len(begins) - 1)], -1)
            offered = np.concatenate([graph[nodes[some]], more], axis=1)
            full = (offered >= 0).sum(axis=1) > degree
            if (~full).any():
                graph[nodes[some][~full]] = -np.sort(-offered[~full], axis=1)[:, :degree]
            if full.any():
                graph[nodes[some][full]] = pruned(points, norms, nodes[some][full], offered[full], degree, relaxed)
    return graph, start


INDEX = "shard int, dims int, n int, start int, ids binary, sizes binary, data binary, graph binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (doubles) of the rows that take part."""
    whole = columns(vectors, id=id_col, vector=vector_col).where("id is not null and size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # Minus zero is zero, so that equal vectors are one.
    return whole.where(finite).where(F.exists("vector", lambda x: x != 0)).select(F.col("id").cast("long").alias("id"), F.transform("vector", lambda x: x.cast("double") + F.lit(0.0)).alias("vector"))


def build_index(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD) -> DataFrame:
    """INDEX: a row for each shard, for answers of at most k."""
    spark = vectors.sparkSession
    # Answers hold k ids besides the query's own, each at most k times.
    rows = usable(vectors, id_col, vector_col).groupBy("vector", "id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("place") <= k + 1)
    nodes = first.groupBy("vector").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("held"))
    nodes = stored(nodes.select("vector", F.size("vector").alias("dims"), F.expr("flatten(transform(held, h -> array_repeat(h.id, cast(h.n as int))))").alias("ids")), "nodes")
    lengths = nodes.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    # One row for each length of vectors; a shard's number tells it from those of other lengths.
    lengths = lengths.withColumn("before", F.sum("shards").over(Window.orderBy("dims")) - F.col("shards"))
    dealt = nodes.join(F.broadcast(lengths), "dims").select((F.col("before") + F.pmod(F.xxhash64("vector"), F.col("shards"))).cast("int").alias("shard"), "dims", "ids", "vector")
    count = lengths.agg(F.sum("shards")).first()[0] or 1
    each = -(-count // max(partitions(spark), -(-count // 16)))
    tasks = -(-count // each)

    def graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids, vectors_ = whole.column("ids").combine_chunks(), whole.column("vector").combine_chunks()
            points = np.asarray(vectors_.flatten(), np.float64).reshape(len(whole), -1)
            # The order of rows, and with it the graph, doesn't hang on the order of the exchange.
            order = np.lexsort(points.T[::-1])
            points = points[order]
            ids = ids.take(pa.array(order))
            graph, start = built(points, len(points))
            sizes = np.diff(np.asarray(ids.offsets, np.int32))
            values = [whole.column("shard")[0].as_py(), points.shape[1], len(points), start, np.asarray(ids.flatten(), np.int64).tobytes(), sizes.astype(np.int32).tobytes(), points.tobytes(), graph.tobytes()]
            kinds = [pa.int32()] * 4 + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], [c.split()[0] for c in INDEX.split(", ")])

        for b in batches:
            shard = np.asarray(b.column("shard"))
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, e in zip(cuts, cuts[1:]):
                if e > a:
                    if held and held[-1].column("shard")[0].as_py() != shard[a]:
                        yield made()
                    held.append(b.slice(a, e - a))
        if held:
            yield made()

    return stored(dealt.repartitionById(tasks, F.expr(f"shard div {each}").cast("int")).sortWithinPartitions("shard").mapInArrow(graphs, INDEX), "graphs")


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries of one length together: dims, their ids, the numbers that tell them apart, and components."""
    held: dict[int, list[tuple]] = {}

    def made(dims: int) -> pa.RecordBatch:
        ids, keys, data = zip(*held.pop(dims))
        values = [dims, np.array(ids, np.int64).tobytes(), np.array(keys, np.int64).tobytes(), np.array(data, np.float64).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int32(), *[pa.binary()] * 3])], ["dims", "ids", "keys", "data"])

    for b in batches:
        for row in zip(b.column("id").to_pylist(), b.column("key").to_pylist(), b.column("vector").to_pylist()):
            own = held.setdefault(len(row[2]), [])
            own.append(row)
            if len(own) >= PACK:
                yield made(len(row[2]))
    for dims in list(held):
        yield made(dims)


def nearest(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", width: int = SEARCHING) -> DataFrame:
    """query_id, rank (from 1), id and score (Euclidean distance) of the k nearest found of each query, its own id left out."""
    spark = queries.sparkSession
    asked = usable(queries, id_col, vector_col).distinct().withColumn("key", F.xxhash64("vector"))
    asked = asked.repartition(max(1, partitions(spark) // 4), "id").mapInArrow(packed, "dims int, ids binary, keys binary, data binary")
    asked = stored(asked, "queries")
    shards = index.select(F.col("dims").alias("d"), "shard", F.lit(0).alias("side"), *[c.split()[0] for c in INDEX.split(", ")[2:]])
    where = index.select("shard", F.col("dims").alias("d"))
    copies = asked.join(where, F.col("dims") == F.col("d")).select("d", "shard", F.lit(1).alias("side"), F.col("ids").alias("q_ids"), "keys", F.col("data").alias("q"))
    count = index.count()
    each = -(-max(1, count) // max(partitions(spark), -(-count // 16)))
    both = shards.unionByName(copies, allowMissingColumns=True).repartitionById(-(-max(1, count) // each), F.expr(f"shard div {each}").cast("int")).sortWithinPartitions("shard", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: tuple = ()
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if r["side"] == 0:
                    points = np.frombuffer(r["data"], np.float64).reshape(r["n"], -1)
                    small = points.astype(np.float32)
                    ends = np.cumsum(np.frombuffer(r["sizes"], np.int32))
                    shard = points, small, (small * small).sum(axis=1), np.frombuffer(r["graph"], np.int32).reshape(r["n"], -1), r["start"], np.frombuffer(r["ids"], np.int64), ends
                else:
                    q_ids, keys = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["keys"], np.int64)
                    q = np.frombuffer(r["q"], np.float64).reshape(len(q_ids), -1)
                    for a in range(0, len(q), IN_STEP):
                        yield answers(*shard, q_ids[a : a + IN_STEP], keys[a : a + IN_STEP], q[a : a + IN_STEP], k, width)

    found = both.mapInArrow(search, "query_id long, key long, id long, score double")
    ranked = Window.partitionBy("query_id", "key").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def answers(points: np.ndarray, small: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: int, ids: np.ndarray, ends: np.ndarray, q_ids: np.ndarray, keys: np.ndarray, q: np.ndarray, k: int, width: int) -> pa.RecordBatch:
    """The k nearest of a shard that beams find for each query, with their distances in double precision."""
    at = beams(small, norms, graph, start, q.astype(np.float32), max(width, k + 1))[:, : 2 * k + 2]  # more than k: single precision may order them otherwise
    who, place = np.nonzero(at >= 0)
    node = at[who, place]
    # Added up one component after another.
    score = np.sqrt(np.cumsum((points[node] - q[who]) ** 2, axis=1)[:, -1])
    sizes = np.diff(np.concatenate([[0], ends]))[node]
    rows = np.repeat(np.arange(len(node)), sizes)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    found = ids[(ends[node] - sizes)[rows] + within]
    who, score = who[rows], score[rows]
    other = found != q_ids[who]
    who, score, found = who[other], score[other], found[other]
    order = np.lexsort((found, score, who))
    who, score, found = who[order], score[order], found[order]
    starts = np.searchsorted(who, np.arange(len(q_ids)))
    held = np.arange(len(who)) - starts[who] < k
    return pa.RecordBatch.from_arrays([pa.array(q_ids[who[held]]), pa.array(keys[who[held]]), pa.array(found[held]), pa.array(score[held])], ["query_id", "key", "id", "score"])
