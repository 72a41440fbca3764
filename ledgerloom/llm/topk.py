"""Exact top-k search by inner product: branch and bound over vertical blocks of dimensions.

Vectors are packed, where they are read, into blocks that hold them dimension by dimension. The stated query set is dealt into cells of some
hundred queries, the candidates into columns; each pair of a cell and a column is one task, through which the
column's blocks pass one after another (block pairs, never row pairs), so that only the queries and one block are in memory. Both numbers grow with
the tables. A task keeps the k best of each query so far; the worst of these is the floor for all blocks that follow. Within a
block, queries that point the same way are scored together, dimensions with the most mass first; after each block of
dimensions, the product of the norms of what remains bounds what any candidate can still gain or lose, and candidates
that none of these queries can want any more are compacted away. Once few pairs are left, these are finished singly. The k best of each task are
merged by a window over at most k rows per query and column.

Cases: vectors that are null, empty or hold null or non-finite components take no part; a vector whose length is not
the most frequent one (the longest of those, if tied) takes no part either; an id that occurs on several rows is as
many candidates; a query with the id on several rows has an answer for each different vector, and none of the id's rows is in it; a null id is no query and no candidate; an empty table
gives an empty result; other columns are ignored. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, partitions, stored

#: Rows of a packed block of candidates and of a cell of queries, queries scored together, and dimensions taken at a time.
CANDIDATES, QUERIES, TOGETHER, DIMENSIONS = 4096, 512, 64, 16
#: Blocks of candidates that pass through one task, and the share of pairs from which on they are finished singly.
BLOCKS, FEW = 64, 1 / 16
PACKED = "n int, dims int, ids binary, keys binary, data binary"


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id and components floor(scale * x) of the rows that take part, all of one length."""
    whole = columns(vectors, id=id_col, vector=vector_col).where("id is not null and size(vector) > 0")
    finite = whole.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    common = finite.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).select("dims")
    return finite.join(F.broadcast(common), F.size("vector") == F.col("dims")).select(
        "id", "dims", F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector")
    )


def pack(rows_at_most: int):
    """Blocks of up to so many vectors, components in vertical layout (a row for each dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed(last: bool) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            end = whole.num_rows if last else whole.num_rows // rows_at_most * rows_at_most
            for at in range(0, end, rows_at_most):
                b = whole.slice(at, min(rows_at_most, end - at)).combine_chunks()
                vectors = b.column("vector").combine_chunks()
                flat = np.asarray(vectors.flatten(), np.int64).reshape(len(vectors), -1)
                ids, keys = (np.asarray(b.column(c), np.int64) for c in ("id", "key"))
                made = [pa.array([x]) for x in (ids.tobytes(), keys.tobytes(), np.ascontiguousarray(flat.T).tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([flat.shape[1]], pa.int32()), *made], ["n", "dims", "ids", "keys", "data"])
            if end < whole.num_rows:
                held.extend(whole.slice(end).to_batches())

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows_at_most:
                yield from packed(False)
        if sum(b.num_rows for b in held):
            yield from packed(True)

    return run


def first_k(who: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, in the order of query, score and id."""
    order = np.lexsort((ids, -score, who))
    starts = np.flatnonzero(np.append(True, who[order][1:] != who[order][:-1]))[: len(who)]
    place = np.arange(len(who)) - np.repeat(starts, np.diff(np.append(starts, len(who))))
    return order[place < k]


def best(
    q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, floors: np.ndarray | None = None, seen: list[float] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the queries (columns of q) the k best candidates (columns of c) each, as positions and scores: exact. Candidates under a query's
    floor may be left out. seen gets the share of pairs that are alive after each block of dimensions but the last.

    Products are summed as doubles where every partial sum stays below 2**53, so each is exact, else as integers.
    """
    dims = len(q)
    exact_floats = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dims < 2.0**52
    kind = np.float64 if exact_floats else np.int64
    # Dimensions with the most mass first: then little remains soon.
    order = np.argsort(-((q.astype(float) ** 2).sum(1) * (c.astype(float) ** 2).sum(1)), kind="stable")
    q, c = q[order].astype(kind), c[order].astype(kind)
    cuts = [*range(0, dims, DIMENSIONS), dims]
    # Norms of what remains after each block of dimensions, rounded up a little: the bound must not be too small.
    rest = [(np.sqrt((q[e:].astype(float) ** 2).sum(0)) * (1 + 1e-9), np.sqrt((c[e:].astype(float) ** 2).sum(0)) * (1 + 1e-9)) for e in cuts[1:]]
    alive, own = np.arange(c.shape[1]), q_ids[:, None] == c_ids[None, :]
    score = np.zeros((q.shape[1], len(alive)), kind)
    least = np.full(q.shape[1], -np.inf) if floors is None else floors.astype(float)
    whole = max(1, score.size)
    who = where = total = None
    for step, (a, e) in enumerate(zip(cuts, cuts[1:])):
        if who is not None:
            total = total + np.einsum("ij,ij->j", q[a:e, who], c[a:e, where])
        else:
            score += q[a:e].T @ c[a:e]
        if e == dims:
            break
        if who is None:
            slack = np.outer(*rest[step])
            if len(alive) > k and not np.isfinite(least).all():
                # The query's own rows, however many, are no candidates and hold up no bound.
                low = np.where(own, -np.inf, score - slack)
                least = np.maximum(least, np.partition(low, len(alive) - k, axis=1)[:, len(alive) - k])
            cells = (score + slack >= least[:, None] - 1e-6) & ~own
            left = np.count_nonzero(cells)
            wanted = cells.any(axis=0)
            if left < FEW * cells.size:
                who, where = np.nonzero(cells)
                total = score[who, where]
            elif not wanted.all():
                alive, own, score, c = alive[wanted], own[:, wanted], score[:, wanted], c[:, wanted]
                rest = [(x, y[wanted]) for x, y in rest]
        else:
            held = total + rest[step][0][who] * rest[step][1][where] >= least[who] - 1e-6
            who, where, total = who[held], where[held], total[held]
            left = len(who)
        if seen is not None:
            seen.append(left / whole)
    if who is None:
        who, where = np.nonzero((score >= least[:, None]) & ~own)
        total = score[who, where]
    place = first_k(who, c_ids[alive[where]], total, k)
    return who[place], alive[where[place]], total[place].astype(np.int64)


def alike(q: np.ndarray) -> np.ndarray:
    """An order of the queries (columns) in which those that point the same way are near each other: by their largest components and the signs of these."""
    if not q.size:
        return np.arange(q.shape[1])
    largest = np.argsort(-np.abs(q), axis=0, kind="stable")[:2]
    signs = np.take_along_axis(q, largest, axis=0) < 0
    return np.lexsort((signs[-1], largest[-1], signs[0], largest[0]))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id and score of the k rows of vectors with the highest inner product with each query,
    the query's own id left out; components are floor(scale * x)."""
    tasks = partitions(vectors.sparkSession)
    # The same rule picks the length of both sides, so that a query of another length takes no part.
    sides = integer_vectors(vectors, id_col, vector_col, scale)
    asked = sides.join(columns(queries, id=id_col).where("id is not null").distinct(), "id").dropDuplicates(["id", "vector"])
    asked = stored(asked.select("id", F.xxhash64("id", "vector").alias("key"), "vector"), "queries")
    cells = max(1, -(-asked.count() // QUERIES))
    across = max(-(-tasks // cells), -(-vectors.count() // (BLOCKS * CANDIDATES)))
    size = f"cell int, {PACKED}"
    blocks = sides.select("id", F.lit(0).cast("long").alias("key"), "vector").mapInArrow(pack(CANDIDATES), PACKED)
    right = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.pmod(F.xxhash64("ids"), F.lit(across)).cast("int").alias("col"), F.lit(1).alias("side"), "*")

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.asarray(b.column("key"), np.int64) % cells
            for x in np.unique(cell).tolist():
                for packed in pack(QUERIES)(iter([b.filter(pa.array(cell == x))])):
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()), *packed.columns], ["cell", *packed.schema.names])

    left = asked.mapInArrow(celled, size).select("cell", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("col"), F.lit(0).alias("side"), *PACKED.replace(" int", "").replace(" binary", "").split(", "))
    dealt = left.unionByName(right).repartitionById(cells * across, F.col("cell") * across + F.col("col")).sortWithinPartitions("side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_of: list[dict] = []
        groups: list[list] = []
        for b in batches:
            for r in b.to_pylist():
                if r["side"] == 0:
                    asked_of.append(r)
                    continue
                if asked_of:
                    ids, keys = (np.concatenate([np.frombuffer(x[c], np.int64) for x in asked_of]) for c in ("ids", "keys"))
                    data = np.concatenate([np.frombuffer(x["data"], np.int64).reshape(x["dims"], -1) for x in asked_of], axis=1)
                    turn, asked_of = alike(data), []
                    none = np.zeros(0, np.int64)
                    for at in range(0, len(turn), TOGETHER):
                        own = turn[at : at + TOGETHER]
                        groups.append([ids[own], keys[own], data[:, own], np.full(len(own), -np.inf), none, none, none])
                c_ids, c = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["data"], np.int64).reshape(r["dims"], -1)
                for g in groups:
                    q_ids, _, q, floors, who, found, scores = g
                    new_who, where, new = best(q_ids, q, c_ids, c, k, floors)
                    who, found, scores = np.append(who, new_who), np.append(found, c_ids[where]), np.append(scores, new)
                    place = first_k(who, found, scores, k)
                    g[4:] = who[place], found[place], scores[place]
                    full = np.bincount(g[4], minlength=len(q_ids)) == k
                    ends = np.searchsorted(g[4], np.arange(len(q_ids)), side="right") - 1
                    floors[full] = g[6][ends[full]]
        for q_ids, keys, _, _, who, found, scores in groups:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_ids[who], keys[who], found, scores)], ["query_id", "key", "id", "score"])

    found = dealt.mapInArrow(search, "query_id long, key long, id long, score long")
    ranked = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
