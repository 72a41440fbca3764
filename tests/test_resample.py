"""Resamples over blocks against brute force: that draws are of the named kind and number, that sums give the measures, fits and permutations."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom import registry
from ledgerloom.kernels import resample as kernels
from ledgerloom.kernels.resample import DEALT, allotted, moved, peak, profile, taken, tail_counts, tail_draws, times
from ledgerloom.plans import resampling

QUERIES, _ = registry.load()


def measures(drawn):
    """Of a list of volumes, as the definitions say."""
    x = np.sort(drawn)
    n, s = len(x), x.sum()
    tops = {"cr1": 1, "cr4": 4, "cr10": 10, "cr20": 20, "top_1pct": -(-n // 100)}
    gini = 2 * (np.arange(1, n + 1) * x).sum() / (n * s) - (n + 1) / n
    return {"gini": gini, "hhi": 10000 * ((x / s) ** 2).sum()} | {m: x[::-1][:k].sum() / s for m, k in tops.items()}


def drawn_counts(n, width, salt):
    """Of one replicate, how often each of n entities is drawn, block by block."""
    return np.concatenate([times(salt // DEALT, n, width, b, min(width, n - b * width))[salt % DEALT] for b in range(-(-n // width))])


@pytest.mark.parametrize("cap", [None, 1 << 50])
def test_blocks_add_up_to_the_measures(spark, cap):
    rng = np.random.default_rng(3)
    v, key = np.sort(np.round(rng.pareto(0.8, 333) + 1, 1))[::-1], rng.integers(-(2**63), 2**63, 333)
    blocks = spark.createDataFrame([(0, b, 333, 16, v[a : a + 16].tolist(), key[a : a + 16].tolist()) for b, a in enumerate(range(0, 333, 16))], "problem long, block long, n long, width long, volume array<double>, key array<long>")
    resamples = spark.range(400, 640).select(F.lit(0).cast("long").alias("problem"), F.col("id").alias("salt"), F.lit(cap).cast("long").alias("cap"))
    got = {(r.salt, r.measure): r.value for r in resampling.resampled(blocks, resamples if cap else resamples.drop("cap"), values=("cap",) if cap else ()).collect()}
    assert len(got) == 240 * 7
    for salt in (400, 499, 500, 639):
        drawn = np.repeat(v, taken(key, np.array([salt]), np.array([cap]))[0] if cap else drawn_counts(333, 16, salt))
        assert cap or len(drawn) == 333
        for measure, value in measures(drawn).items():
            assert got[salt, measure] == pytest.approx(value, rel=1e-9), (salt, measure)


@pytest.mark.parametrize(("n", "width"), [(1, 4), (7, 4), (4096, 512), (1000, 33)])
def test_every_replicate_draws_exactly_n(n, width):
    whole = sum(times(3, n, width, b, min(width, n - b * width)).sum(1) for b in range(-(-n // width)))
    assert (whole == n).all()


def test_draws_are_multinomial():
    w = np.concatenate([times(d, 60, 16, b, min(16, 60 - 16 * b)) for d in range(8) for b in [0]] + [])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - (1 - 1 / 60)) < 0.03
    both = [np.concatenate([times(d, 60, 16, b, 16)[:, 0] for d in range(40)]) for b in (0, 2)]
    assert abs(np.corrcoef(*both)[0, 1] + 1 / 59) < 0.03


def test_numbers_of_resamples(spark, sf_dir):
    boot = QUERIES["x10_x11_bootstrap"](spark, sf_dir).collect()
    assert {(r.window, r.measure) for r in boot} == {(w, m) for w in ("primary", "longer", "all") for m in ("gini", "hhi", "cr1", "cr4", "cr10", "cr20", "top_1pct")} and {r.replicates for r in boot} == {10_000}
    some = QUERIES["x12_subsamples"](spark, sf_dir).collect()
    assert {r.replicates for r in some} == {2_000} and {(r.window, r.power) for r in some} == {(w, p) for w in ("primary", "longer", "all") for p in (0.5, 0.75, 0.9)}
    rows = QUERIES["x18_permutation_spearman"](spark, sf_dir).collect()
    assert len(rows) == 4 and {r.permutations for r in rows} == {10_000} and all(1 / 10_001 <= r.p <= 1 for r in rows)
    assert QUERIES["x37_sup_f_bootstrap"](spark, sf_dir).first().replicates == 999
    hill = QUERIES["x89_x91_tail_bootstrap"](spark, sf_dir).first()
    assert hill.replicates == 2_000 and hill.low < hill.alpha < hill.high


def test_bootstrap_of_the_gini(spark, sf_dir):
    """Against draws of numpy's own, within what chance allows."""
    v = np.array([r.volume for r in resampling.volumes(spark, sf_dir, resampling.PRIMARY).collect()])
    rng = np.random.default_rng(1)
    own = np.array([measures(rng.choice(v, len(v)))["gini"] for _ in range(2000)])
    got = {r.measure: r for r in QUERIES["x10_x11_bootstrap"](spark, sf_dir).where("window = 'primary'").collect()}["gini"]
    assert got.mean == pytest.approx(own.mean(), abs=5 * own.std() / 40) and got.sd == pytest.approx(own.std(), rel=0.08)
    assert got.low == pytest.approx(np.percentile(own, 2.5), abs=0.3 * own.std()) and got.high == pytest.approx(np.percentile(own, 97.5), abs=0.3 * own.std())


def test_subsamples_have_their_size(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(resampling, "SUBSAMPLES", 20)
    caps = []
    monkeypatch.setattr(resampling, "resampled", lambda blocks, limits, values: (caps.append((blocks.collect(), limits.collect())), limits.select("problem", "salt", F.lit("x").alias("measure"), F.lit(1.0).alias("value")))[1])
    sizes = {(r.window, r.power): r.m for r in QUERIES["x12_subsamples"](spark, sf_dir).collect()}
    blocks, limits = caps[0]
    for i, window in enumerate(("primary", "longer", "all")):
        key = np.concatenate([np.array(b.key) for b in blocks if b.problem == i])
        own = [r for r in limits if r.problem == i]
        assert len(own) == 60
        for r in own:
            assert taken(key, np.array([r.salt]), np.array([r.cap])).sum() == sizes[window, (0.5, 0.75, 0.9)[r.salt % 3]]


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_permutations_are_bijections(n):
    whole = moved(np.arange(n), n, np.arange(1, 40))
    assert (np.sort(whole, axis=1) == np.arange(n)).all()
    assert (np.concatenate([moved(np.arange(a, min(n, a + 7)), n, np.array([3, 9])) for a in range(0, n, 7)], axis=1) == moved(np.arange(n), n, np.array([3, 9]))).all()
    if n == 1000:
        assert len({tuple(r) for r in whole[:, :5]}) == 39 and abs(np.mean([np.corrcoef(np.arange(n), r)[0, 1] for r in whole])) < 0.03


def test_every_small_permutation_comes_up():
    rows, counts = np.unique(moved(np.arange(4), 4, np.arange(6000)), axis=0, return_counts=True)
    assert len(rows) == 24 and counts.min() > 150 and counts.max() < 360


@pytest.mark.parametrize("width", [7, 4096])
def test_turned_ranks(spark, width):
    """In blocks of any width the permutations match the same places."""
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"entity": [f"e{i}" for i in range(45)], "volume": rng.integers(1, 30, 45).astype(float)})
    frame["a"], frame["b"] = frame.volume + rng.normal(size=45) * 20, rng.integers(0, 4, 45).astype(float)
    rows = spark.createDataFrame(frame)
    got = {r.pair: r for r in resampling.turned(rows, "volume", {"a": "a", "b": "b"}, 400, width).collect()}
    ranks = frame.assign(**{c: frame[c].rank() for c in ("volume", "a", "b")}).sort_values(["volume", "entity"], ascending=[False, True])
    x = ranks.volume.to_numpy() - 23
    for pair in ("a", "b"):
        y = ranks[pair].to_numpy() - 23
        norm = ((x @ x) * (y @ y)) ** 0.5
        null = np.array([x @ y[p] / norm for p in moved(np.arange(45), 45, np.arange(1, 401))])
        assert got[pair].rho == pytest.approx(x @ y / norm) and got[pair].permutations == 400 and got[pair].hits == (np.abs(null) >= abs(x @ y / norm) - 1e-12).sum()


def loglik(x, shape, scale):
    inside = 1 + shape * x / scale
    return -np.inf if scale <= 0 or inside.min() <= 0 else -len(x) * np.log(scale) - (1 + 1 / shape) * np.log(inside).sum()


@pytest.mark.parametrize("shape", [0.9, 0.25, -0.3])
def test_peaks_are_maxima(shape):
    u = np.random.default_rng(8).random(3000)
    x = 5 * (u**-shape - 1) / shape
    found = peak(profile(x / x.max()).mean(0), x.max())
    assert found[0] == pytest.approx(shape, abs=0.15)
    best = loglik(x, *found)
    for a in (-1e-2, -1e-3, 1e-3, 1e-2):
        assert loglik(x, found[0] + a, found[1]) < best + 1e-3 and loglik(x, found[0], found[1] * (1 + a)) < best + 1e-3
    assert peak(profile(np.ones(50)).mean(0), 3.0) is None


def test_pareto_fits(spark, sf_dir):
    """Against Newton's steps on both parameters in numpy."""
    got = {(r.window, r.share): r for r in QUERIES["x89_pareto_fit"](spark, sf_dir).collect()}
    assert len(got) == 8
    for window, days in resampling.WINDOWS.items():
        v = np.array([r.volume for r in resampling.volumes(spark, sf_dir, days).collect()])
        for share in (0.05, 0.1, 0.15, 0.2):
            r, u = got[window, share], np.quantile(v, 1 - share)
            x = v[v > u] - u
            assert (r.n, r.k, r.threshold) == (len(v), len(x), pytest.approx(u))
            if r.shape is None:
                continue
            theta = r.shape / r.scale
            f, d = np.log1p(theta * x).mean(), (x / (1 + theta * x)).mean()
            assert r.shape == pytest.approx(f, abs=1e-6) and 1 / theta - d * (1 + 1 / f) == pytest.approx(0, abs=1e-5 / abs(theta))
            assert loglik(x, r.shape, r.scale) >= max(loglik(x, r.shape + a, r.scale * b) for a in (-0.01, 0.01) for b in (0.99, 1, 1.01))


def test_tails_add_up(spark):
    """Draws of a fitted tail over its parts, and of what lies below, give the measures of all of them together."""
    rng = np.random.default_rng(4)
    n, k, width = 500, 60, 64
    below, shape, scale = np.sort(rng.random(n - k))[::-1] * 10, 0.4, 3.0
    parts = 3
    rows = [(0, i, n, k, parts, 10.0, 1, None) for i in range(parts)] + [(0, parts + b, n, k, parts, 10.0, width, below[a : a + width].tolist()) for b, a in enumerate(range(0, n - k, width))]
    blocks = spark.createDataFrame(rows, "problem long, block long, n long, k long, parts long, threshold double, width long, volume array<double>")
    salts = spark.range(DEALT).select(F.lit(0).cast("long").alias("problem"), F.col("id").alias("salt"), F.lit(shape).alias("shape"), F.lit(scale).alias("scale"))
    got = {(r.salt, r.measure): r.value for r in resampling.resampled(blocks, salts, kernels.tail_sums, kernels.tail_tops, ("shape", "scale")).collect()}
    counts = tail_counts(0, n, k)
    assert abs(counts.mean() - k) < 2 and abs(counts.std() - (n * k / n * (1 - k / n)) ** 0.5) < 1
    for salt in (0, 17, 499):
        own = SimpleNamespace(deal=0, n=n, k=k, parts=parts, threshold=10.0, shape=[shape], scale=[scale])
        tail = []
        for i in range(parts):
            own.block = i
            _, x = tail_draws(own, np.array([salt]))
            assert (np.diff(x) <= 0).all() and (not tail or not len(x) or x[0] <= min(tail))
            tail += x.tolist()
        assert len(tail) == counts[salt] and min(tail) >= 10
        rest = np.concatenate([times(0, n - k, width, b, min(width, n - k - b * width), n - counts, 4)[salt] for b in range(-(-(n - k) // width))])
        drawn = np.concatenate([tail, np.repeat(below, rest)])
        assert len(drawn) == n
        for measure, value in measures(drawn).items():
            if measure != "gini":
                assert got[salt, measure] == pytest.approx(value, rel=1e-9), (salt, measure)
    whole = np.concatenate([tail_draws(SimpleNamespace(deal=d, n=n, k=k, parts=1, block=0, threshold=10.0, shape=[shape] * DEALT, scale=[scale] * DEALT), np.arange(d * DEALT, (d + 1) * DEALT))[1] for d in range(3)])
    for p in (0.5, 0.9, 0.99):
        assert np.quantile(whole, p) == pytest.approx(10 + scale * ((1 - p) ** -shape - 1) / shape, rel=0.03)


def test_tail_intervals(spark, sf_dir):
    rows = QUERIES["x90_x91_tail_intervals"](spark, sf_dir).collect()
    fits = {(r.window, r.share): r for r in QUERIES["x89_pareto_fit"](spark, sf_dir).collect()}
    assert {(r.window, r.share, r.measure) for r in rows} == {(*key, m) for key, f in fits.items() if f.shape is not None for m in ("cr1", "cr4", "top_1pct", "hhi")}
    for r in rows:
        assert r.replicates == 2_000 and r.low <= r.mean <= r.high and r.shape == fits[r.window, r.share].shape and 0 <= r.refits_without_peak <= 2_000
        assert r.plain_low <= r.plain_high and (r.alpha_low is None or 0 < r.alpha_low <= r.alpha_high)


def test_allotments_are_shared():
    counts = np.arange(DEALT)
    assert (sum(allotted(counts, 100, 9, b, 5) for b in range(12)) == counts).all()


@pytest.mark.parametrize(("n", "shard"), [(1, 1), (5, 2), (100, 30), (1000, 256)])
def test_permutations_over_shards_are_bijections(n, shard):
    whole = moved(np.arange(n), n, np.arange(1, 40), shard)
    assert (np.sort(whole, axis=1) == np.arange(n)).all()
    if n == 1000:
        rho = [np.corrcoef(np.arange(n), r)[0, 1] for r in moved(np.arange(n), n, np.arange(1, 1000), shard)]
        assert abs(np.var(rho) * (n - 1) - 1) < 0.15 and abs(np.mean(rho)) < 0.004


def test_every_small_permutation_comes_up_over_shards():
    rows, counts = np.unique(moved(np.arange(4), 4, np.arange(6000), 2), axis=0, return_counts=True)
    assert len(rows) == 24 and counts.min() > 150 and counts.max() < 360


def test_turned_ranks_over_shards(spark):
    """No rank leaves its pair of shards, whatever the number of shards: what a task returns is one sum for each permutation and pair."""
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"entity": [f"e{i:03}" for i in range(203)], "volume": rng.permutation(203).astype(float)})
    frame["a"], frame["b"] = frame.volume + rng.normal(size=203) * 900, rng.integers(0, 4, 203).astype(float)
    got = {r.pair: r for r in resampling.turned(spark.createDataFrame(frame), "volume", {"a": "a", "b": "b"}, 700, 16, 60).collect()}
    ranks = frame.assign(**{c: frame[c].rank() for c in ("volume", "a", "b")}).sort_values("volume", ascending=False)
    to = moved(np.arange(203), 203, np.arange(1, 701), 60)
    for pair in ("a", "b"):
        x, y = ranks.volume.to_numpy() - 102, ranks[pair].to_numpy() - 102
        dots, norm = np.array([x @ y[p] for p in to]), ((x @ x) * (y @ y)) ** 0.5
        assert got[pair].permutations == 700 and got[pair].rho == pytest.approx(x @ y / norm) and got[pair].hits == (np.abs(dots) >= abs(x @ y) - 1e-12 * norm).sum()


def peak_memory(kernel, row: dict) -> float:
    """Of a kernel on one pair, in MB."""
    frames = iter([pd.DataFrame([row])])
    tracemalloc.start()
    list(kernel(frames))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def test_sums_hold_a_few_replicates_at_a_time():
    """A deal of 500 replicates over 4,096 entities is 16 MB of draws; counts of all replicates at once, and what is made of them, were several times that."""
    v = np.sort(np.random.default_rng(2).pareto(1, 4096))[::-1]
    row = {"deal": 3, "n": 50_000, "width": 4096, "block": 2, "volume": v, "salt": 3 * DEALT + np.arange(DEALT)}
    assert peak_memory(kernels.block_sums, row) < 45
    got, w = next(kernels.block_sums(iter([pd.DataFrame([row])]))), times(3, 50_000, 4096, 2, 4096)
    assert (got.drawn == w.sum(1)).all() and got.held.to_numpy() == pytest.approx(w @ v) and got.squares.to_numpy() == pytest.approx(w @ (v * v))
    assert got.inside.to_numpy() == pytest.approx((w * (2 * np.cumsum(w, 1) - w)) @ v)


@pytest.mark.parametrize("m", [1, 70, 2000])
def test_numbers_near_the_limit(m):
    key, salts = np.random.default_rng(7).integers(-(2**63), 2**63, 4096), np.arange(DEALT)
    row = {"salt": salts, "m": np.full(DEALT, m), "n": 4096, "key": key}
    assert m > 1 or peak_memory(kernels.near_limit, row) < 8
    got = next(kernels.near_limit(iter([pd.DataFrame([row])])))
    for salt in (0, 7, 499):
        h, r = np.sort(kernels.keyed(key, np.array([salt]))[0]), got.iloc[salt]
        assert r.salt == salt and r.m == m and np.sort(r.near)[m - r.below - 1] == h[m - 1] and (h < min(r.near)).sum() == r.below


def test_refits_add_up_blocks_before_they_are_exchanged():
    rng = np.random.default_rng(9)
    q = [rng.random(64) for _ in range(5)]
    row = lambda deal, b: {"deal": deal, "k": 320, "most": 2.0, "width": 64, "block": b, "share": q[b]}
    got = list(kernels.refit_sums(iter([pd.DataFrame([row(0, b) for b in range(5)]), pd.DataFrame([row(1, 0)])])))
    assert [len(f) for f in got] == [DEALT, DEALT] and got[1]["salt"].min() == DEALT
    whole = sum(times(0, 320, 64, b, 64, stream=1) @ profile(q[b]) for b in range(5))
    assert np.stack([np.frombuffer(x) for x in got[0]["data"]]) == pytest.approx(whole)
    assert not list(kernels.refit_sums(iter([])))


def test_windows_in_one_pass(spark, sf_dir):
    """Each window's volumes are those of its own query."""
    rows = resampling.ranked_windows(spark, sf_dir, resampling.ALSO_ALL).collect()
    for i, window in enumerate(resampling.ALSO_ALL.values()):
        own = {r.entity: r.volume for r in resampling.volumes(spark, sf_dir, window).collect()}
        assert own and {r.entity: r.volume for r in rows if r.problem == i} == own and sorted(r["rank"] for r in rows if r.problem == i) == list(range(1, len(own) + 1))


def test_fewer_windows_draw_the_same(spark, sf_dir):
    of = lambda rows: {(r.window, r.measure): (r.mean, r.low, r.high, r.replicates) for r in rows.collect()}
    some, every = of(resampling.bootstrapped(spark, sf_dir, resampling.WINDOWS)), of(QUERIES["x10_x11_bootstrap"](spark, sf_dir))
    assert len(some) == 14 and some.items() <= every.items()
