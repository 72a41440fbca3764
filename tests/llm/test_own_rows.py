"""Several rows of a query's own id."""

import numpy as np


def test_top_k_with_several_own_rows(spark):
    from ledgerloom.llm.topk import best, top_k

    rng = np.random.default_rng(2)
    v = rng.normal(size=(1500, 64)) * np.linspace(2, 0.05, 64)
    v[:15] = v[0] * 3  # fifteen rows of one id, its own best matches
    ids = [7] * 15 + list(range(100, 1585))
    whole = np.floor(v * 64).astype(np.int64)
    expected = sorted(((-int(whole[0] @ w), i) for i, w in zip(ids, whole) if i != 7))[:20]
    _, where, score = best(np.array([7]), whole[:1].T, np.array(ids), whole.T, 20)
    assert [(-s, ids[j]) for j, s in zip(where, score)] == expected
    table = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>").coalesce(1)
    got = top_k(table, table.where("vec_id = 7").select("vec_id")).orderBy("rank").collect()
    assert [(-r.score, r.id) for r in got] == expected
