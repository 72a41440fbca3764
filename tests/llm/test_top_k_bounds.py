"""What the bounds of the search leave out, and different vectors under one id."""

import numpy as np


def clustered(rng, clusters, n, dims=64):
    centres = rng.normal(size=(clusters, dims)) * np.linspace(2, 0.1, dims)
    return (centres[np.arange(n) % clusters] + rng.normal(0, 0.05, (n, dims))).round(4)


def test_most_pairs_are_dropped_on_clustered_vectors():
    from ledgerloom.llm.topk import alike, best

    whole = np.floor(clustered(np.random.default_rng(3), 40, 4000) * 64).astype(np.int64)
    ids = np.arange(4000)
    queries = ids[::20]
    queries = queries[alike(whole[queries].T)]
    shares = []
    for at in range(0, len(queries), 64):
        own, seen = queries[at : at + 64], []
        who, where, score = best(own, whole[own].T, ids, whole.T, 20, seen=seen)
        shares.append(seen)
        for i, x in enumerate(own.tolist()):
            expected = sorted((-int(whole[x] @ w), j) for j, w in enumerate(whole) if j != x)[:20]
            assert [(-s, int(j)) for j, s in zip(where[who == i], score[who == i])] == expected
    after = np.mean(shares, axis=0)
    assert after[0] < 0.5 and after[1] < 0.1 and after[2] < 0.05


def test_floors_carry_over_blocks(spark, monkeypatch):
    from ledgerloom.llm import topk

    monkeypatch.setattr(topk, "QUERIES", 16)
    vectors = clustered(np.random.default_rng(4), 9, 900, 40)
    whole = np.floor(vectors * 64).astype(np.int64)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in topk.top_k(table, table.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.id))
    assert got == {i: sorted((-int(whole[i] @ w), j) for j, w in enumerate(whole) if j != i)[:20] for i in range(0, 900, 20)}


def test_different_vectors_of_one_id_have_an_answer_each(spark):
    from ledgerloom.llm.topk import top_k

    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.id, r.score) for r in top_k(table, table.where("vec_id = 0")).collect())
    assert got == [(1, 1, 64 * 64), (1, 2, 64 * 64), (2, 1, 64 * 6), (2, 2, 64 * 6)]
