"""The graph search against brute force: recall, and exactly what an answer must be."""

import math

import numpy as np
import pytest

from ledgerloom.llm.graphsearch import build_index, built, nearest, pruned

SCHEMA = "vec_id long, embedding array<float>, ids string, shard string, score string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *["clash"] * 4) for i, v in rows], SCHEMA)


def brute(rows, queries, k):
    """(query_id, vector) -> the k nearest as (id, distance)."""
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    asked = {(i, tuple(v)): v for i, v in fine if i in queries}
    return {key: sorted((float(np.sqrt(np.cumsum((v - q) ** 2)[-1])), i) for i, v in fine if i != key[0] and len(v) == len(q))[:k] for key, q in asked.items()}


def results(spark, rows, queries, k=10, **options):
    vectors = frame(spark, rows)
    found = nearest(build_index(vectors, k, **options), vectors.where(vectors.vec_id.isin(list(queries)) if queries else "false"), k).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.id))
    return out


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, [-0.0, 1.0]), (10, [0.0, 1.0]), (11, [1.0, 2.0, 3.0]), (12, [1.0, 2.0, 4.0]), (13, [5.0])]
    rows += [(9, [-0.0, 1.0]), (14, [2.0, 2.0]), (14, [2.0, 2.0])]
    queries = {1, 3, 5, 8, 9, 11, 13, 14}
    expected = {key[0]: v for key, v in brute(rows, queries, 4).items() if v}
    assert results(spark, rows, queries, 4) == expected
    assert results(spark, [], set()) == {} and results(spark, rows, set()) == {}


def test_copies_give_the_smallest_ids(spark):
    """A third of all rows is one vector, and another stands on one id many times."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(600)] + [(1000 + i, [1.0] * 8) for i in range(300)] + [(2000, [1.5] * 8)] * 40
    expected = {key[0]: v for key, v in brute(rows, {1000, 1150, 2000, 7}, 10).items()}
    found = results(spark, rows, {1000, 1150, 2000, 7}, shard_rows=200)
    for q in (1000, 1150, 2000):
        assert found[q] == expected[q]
    assert len({i for _, i in found[7]} & {i for _, i in expected[7]}) >= 9


def test_an_id_on_several_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0])]
    vectors = frame(spark, rows)
    found = nearest(build_index(vectors), vectors.where("vec_id = 1")).collect()
    assert sorted((r.rank, r.id) for r in found) == [(1, 2), (1, 3), (2, 2), (2, 3)]


@pytest.mark.parametrize("kind", ["spread", "clusters"])
def test_recall(spark, kind):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(5000, 24)) if kind == "spread" else rng.normal(size=(20, 24))[rng.integers(0, 20, 5000)] + 0.01 * rng.normal(size=(5000, 24))
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    queries = set(range(0, 5000, 100))
    expected = {key[0]: v for key, v in brute(rows, queries, 10).items()}
    found = results(spark, rows, queries, shard_rows=1500)
    right = sum(len({i for _, i in found[q]} & {i for _, i in expected[q]}) for q in queries)
    assert right >= 0.95 * 10 * len(queries)
    for q in queries:  # what is found is measured exactly
        scores = dict((i, s) for s, i in expected[q])
        assert all(scores[i] == s for s, i in found[q] if i in scores) and found[q] == sorted(found[q]) and len(found[q]) == 10


def test_registered_query(spark, sf_dir):
    from ledgerloom.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    expected = {key[0]: v for key, v in brute(rows, {i for i, _ in rows if i % 100 == 0}, 10).items()}
    found = {}
    for r in QUERIES["op11_graph_search"](spark, sf_dir).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert found.keys() == expected.keys()
    assert sum(len(found[q] & {i for _, i in v}) for q, v in expected.items()) >= 0.9 * sum(map(len, expected.values()))


def test_pruning_keeps_the_nearest_and_what_it_does_not_hide():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [3, 0]], np.float32)
    norms = (points**2).sum(1)
    kept = pruned(points, norms, np.array([0]), np.array([[1, 2, 3, 4, 1, -1]], np.int32), 3, 1.2)
    assert kept.tolist() == [[1, 3, -1]]


def test_graphs_are_bounded_and_reach_all():
    points = np.random.default_rng(0).normal(size=(700, 6))
    graph, start = built(points, 1, degree=12)
    assert graph.shape == (700, 12) and (graph != np.arange(700)[:, None]).all() and graph.max() < 700
    seen, todo = {start}, [start]
    while todo:
        for x in graph[todo.pop()]:
            if x >= 0 and x not in seen:
                seen.add(int(x))
                todo.append(int(x))
    assert len(seen) >= 695
    assert all(len({x for x in row if x >= 0}) == sum(row >= 0) for row in graph)
