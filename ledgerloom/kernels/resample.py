"""Keyed draws and what resamples add up to over blocks of ranked entities, as kernels for tasks.

A block holds the values of some thousand entities in falling order; it says for each replicate what its own draws add up to, and the sums over
blocks give the measures: no row is ever copied once for each replicate. A bootstrap draws exactly n of n: how many draws fall on a block
follows from splitting them in two over and over, down to the block, by binomials that hang on the node and the deal of replicates only, so every task finds
the same numbers. A subsample takes the entities with the smallest keyed numbers. A tail's draws come from a generalised Pareto law, by
equal parts of its probability, which are blocks in falling order as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Numbers worked on at a time (they stay in a core's cache), replicates of a deal, and what all draws hang on.
AT_ONCE, DEALT, SEED = 1 << 15, 500, 42


def keyed(keys: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """A whole number in [0, 2**53) for every salt (row) and key (column)."""
    u = np.uint64
    with np.errstate(over="ignore"):
        h = np.asarray(keys, np.int64).view(u)[None, :] + (np.asarray(salts, np.int64).view(u) * u(0x9E3779B97F4A7C15))[:, None]
        spare = np.empty_like(h)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h ^= np.right_shift(h, u(shift), out=spare)
            h *= u(factor)
        h ^= np.right_shift(h, u(31), out=spare)
        h >>= u(11)
    return h.view(np.int64)


def slices(rows: int, width: int) -> Iterator[slice]:
    step = max(1, AT_ONCE // max(1, width))
    return (slice(a, min(rows, a + step)) for a in range(0, rows, step))


def taken(keys: np.ndarray, salts: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """1 for the entities whose number is at most the limit, for each salt (row)."""
    return (keyed(keys, salts) <= limits[:, None]).astype(np.int64)


def generator(*key: int) -> np.random.Generator:
    return np.random.default_rng([SEED, *(int(k) for k in key)])


def allotted(counts: np.ndarray, n: int, width: int, block: int, *key: int) -> np.ndarray:
    """How many of counts draws (one number for each replicate of a deal) fall on a block of width entities out of n."""
    size = lambda a, b: min(n, b * width) - min(n, a * width)
    a, b = 0, max(1, -(-n // width))
    while b - a > 1:
        middle = (a + b) // 2
        left = generator(*key, a, b).binomial(counts, size(a, middle) / size(a, b))
        counts, a, b = (left, a, middle) if block < middle else (counts - left, middle, b)
    return counts


def places(deal: int, n: int, width: int, block: int, size: int, draws: np.ndarray | None = None, stream: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """How many of the draws, n of n (or draws of n) with replacement, fall on a block's size entities in each replicate of a deal, and on which of them, replicate by replicate."""
    whole = np.full(DEALT, n, np.int64) if draws is None else draws
    own = allotted(whole, n, width, block, stream, deal)
    return own, generator(stream, deal, block).integers(0, size, own.sum())


def times(deal: int, n: int, width: int, block: int, size: int, draws: np.ndarray | None = None, stream: int = 0) -> np.ndarray:
    """How often each of a block's size entities is drawn in each replicate of a deal (a row each)."""
    own, at = places(deal, n, width, block, size, draws, stream)
    out, ends = np.empty((DEALT, size), np.int64), np.cumsum(own)
    for i, (end, k) in enumerate(zip(ends.tolist(), own.tolist())):
        out[i] = np.bincount(at[end - k : end], minlength=size)
    return out


def drawn_up_to(own: np.ndarray, at: np.ndarray, size: int, which: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """From places, for some replicates, a few at a time: how many draws fall on each entity and those before it."""
    ends, held = np.cumsum(own), np.empty((max(1, AT_ONCE // size), size))
    for s in slices(len(which), size):
        out = held[: len(which[s])]
        for i, j in enumerate(which[s].tolist()):
            out[i] = np.bincount(at[ends[j] - own[j] : ends[j]], minlength=size)
        yield s, np.cumsum(out, axis=1, out=out)  # the same numbers' place every time


def counts_of(row, salts: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """For the given salts, in parts, how many draws fall on each entity of a block and those before it: of a subsample where the block's row has limits, else of a bootstrap."""
    if "cap" in row._fields and row.cap is not None:
        limits, key = np.asarray(row.cap, np.int64), np.asarray(row.key, np.int64)
        for s in slices(len(salts), len(key)):
            yield s, np.cumsum(keyed(key, salts[s]) <= limits[s][:, None], axis=1, dtype=float)
    else:
        yield from drawn_up_to(*places(row.deal, row.n, row.width, row.block, len(row.volume)), len(row.volume), salts % DEALT)


def falls(v: np.ndarray) -> np.ndarray:
    """By how much each value exceeds the next: sums of draws follow from these and from how many draws fall on each entity and those before it."""
    return -np.diff(v, append=0.0)


SUMS = "block long, salt long, drawn long, held double, squares double, inside double"


def sums_of(block: int, salts: np.ndarray, parts: list[np.ndarray]) -> pd.DataFrame:
    sums = np.concatenate(parts) if parts else np.zeros((0, 4))
    return pd.DataFrame({"block": block, "salt": salts, "drawn": sums[:, 0].astype(np.int64), "held": sums[:, 1], "squares": sums[:, 2], "inside": sums[:, 3]})


def block_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For pairs of a block and a deal: what the block's draws add up to. inside: the sum of volume times (twice the draws before it in the
    block, and its own)."""
    for frame in frames:
        for row in frame.itertuples():
            v, salts = np.asarray(row.volume, float), np.asarray(row.salt, np.int64)
            by, out = np.stack([falls(v), falls(v * v)], axis=1), []
            for _, c in counts_of(row, salts):
                # An entity's draws, w, and those before it, c - w: w (2 c - w) = c ** 2 - (c - w) ** 2.
                out.append(np.column_stack([c[:, -1].copy(), c @ by, np.square(c, out=c) @ by[:, 0]]))
            yield sums_of(row.block, salts, out)


def block_tops(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For blocks with questions (salt, cap, measure, take): the volume of the block's first so many draws."""
    for frame in frames:
        for row in frame.itertuples():
            v, salts, takes = np.asarray(row.volume, float), np.asarray(row.salt, np.int64), np.asarray(row.take, np.int64)
            out = [np.minimum(c, takes[s][:, None]) @ falls(v) for s, c in counts_of(row, salts)]
            yield pd.DataFrame({"salt": salts, "measure": row.measure, "top": np.concatenate(out)})


def near_limit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For pairs of a block and a list of subsamples (salt, m, n): how many numbers lie below all that can be the m-th smallest of n, and
    those that can be it."""
    for frame in frames:
        for row in frame.itertuples():
            salts, m = np.asarray(row.salt, np.int64), np.asarray(row.m, float)
            width = 9 * np.sqrt(m) + 9
            low, high = np.ceil((m - width) / row.n * 2.0**53).astype(np.int64), np.floor((m + width) / row.n * 2.0**53).astype(np.int64)
            below, near, key = [], [], np.asarray(row.key, np.int64)
            for s in slices(len(salts), len(key)):
                h = keyed(key, salts[s])
                h -= low[s][:, None]
                below += np.count_nonzero(h < 0, axis=1).tolist()
                at = np.flatnonzero(h.view(np.uint64) <= (high - low)[s].view(np.uint64)[:, None])  # those below wrap round
                which = at // len(key)
                near += np.split(h.reshape(-1)[at] + low[s][which], np.searchsorted(which, np.arange(1, len(h))))
            yield pd.DataFrame({"salt": salts, "m": np.asarray(row.m, np.int64), "below": below, "near": near})


# A generalised Pareto law of excesses x up to M: theta = shape / scale is searched as s = log(1 + theta * M), which covers all admissible values.
NODES = np.linspace(-6.0, 18.0, 241)
ZERO = 60  # the node at which the law is exponential
#: Below this the law counts as exponential: what the slope is made of cancels.
FLAT = 1e-5


def profile(q: np.ndarray) -> np.ndarray:
    """For excesses as shares q of M (a row each): log(1 + theta x) and its slope in s at all nodes, and the square of q."""
    e, q = np.exp(NODES)[None, :], q[:, None]
    return np.concatenate([np.log1p((e - 1) * q), e * q / (1 + (e - 1) * q), q * q], axis=1)


def peak(means: np.ndarray, most: float) -> tuple[float, float] | None:
    """Shape and scale where the profile likelihood has its highest peak with a shape above -1, from means of profile; None if it has none. Between nodes the
    mean of log(1 + theta x), which is the shape, follows the cubic through its values and slopes."""
    f, d, square = means[: len(NODES)], means[len(NODES) : -1], means[-1]
    f[ZERO] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        rise = 1 / -np.expm1(-NODES) - d * (1 + 1 / f)
    rise[ZERO] = square / (2 * d[ZERO]) - d[ZERO]  # the limit
    best = None
    for i in np.flatnonzero((rise[:-1] > 0) & (rise[1:] <= 0)).tolist():
        width, held = NODES[i + 1] - NODES[i], (f[i], d[i], f[i + 1], d[i + 1])

        def at(s: float, start: float = NODES[i], width: float = width, held: tuple = held) -> tuple[float, float]:
            t = (s - start) / width
            value = [2 * t**3 - 3 * t**2 + 1, (t**3 - 2 * t**2 + t) * width, -2 * t**3 + 3 * t**2, (t**3 - t**2) * width]
            change = [(6 * t**2 - 6 * t) / width, 3 * t**2 - 4 * t + 1, (6 * t - 6 * t**2) / width, 3 * t**2 - 2 * t]
            return float(np.dot(value, held)), float(np.dot(change, held))

        low, high = NODES[i], NODES[i + 1]
        for _ in range(50):
            s = (low + high) / 2
            if abs(s) < FLAT:
                break
            shape, change = at(s)
            low, high = (s, high) if 1 / -np.expm1(-s) - change * (1 + 1 / shape) > 0 else (low, s)
        s = (low + high) / 2
        s = s if abs(s) >= FLAT else FLAT
        shape = at(s)[0] if abs(s) > FLAT else d[ZERO] * s
        scale = shape * most / np.expm1(s)
        if shape > -1 and scale > 0 and (best is None or -np.log(scale) - shape > best[0]):
            best = -np.log(scale) - shape, float(shape), float(scale)
    return best and best[1:]


def refit_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For pairs of a block of a tail (excess as shares) and a deal, ordered by deal: of each replicate, k of k draws, the sums of profile over the blocks that a task has."""
    held, total = None, None

    def out():
        deal, k, most = held
        return pd.DataFrame({"salt": deal * DEALT + np.arange(DEALT), "k": k, "most": most, "data": [x.tobytes() for x in total]})

    for frame in frames:
        for row in frame.itertuples():
            q, about = np.asarray(row.share, float), (row.deal, row.k, row.most)
            own = times(row.deal, row.k, row.width, row.block, len(q), stream=1).astype(float) @ profile(q)
            if about != held and held is not None:
                yield out()
            held, total = about, total + own if about == held else own
    if held is not None:
        yield out()


def refits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shape and scale of every replicate, from its sums over blocks; null where the likelihood has no peak."""
    total: dict[tuple, np.ndarray] = {}
    for frame in frames:
        for salt, k, most, data in zip(frame["salt"], frame["k"], frame["most"], frame["data"]):
            own, key = np.frombuffer(data, float), (salt, k, most)
            total[key] = total[key] + own if key in total else own
    if total:
        found = [peak(v / k, most) or (None, None) for (_, k, most), v in total.items()]
        yield pd.DataFrame({"salt": [s for s, _, _ in total], "shape": [f[0] for f in found], "scale": [f[1] for f in found]}).astype({"shape": float, "scale": float})


def tail_counts(deal: int, n: int, k: int) -> np.ndarray:
    """How many of n draws fall on the tail in each replicate of a deal; at least one, and at most all but one."""
    return np.clip(generator(2, deal).binomial(n, k / n, DEALT), 1, max(1, n - 1))


def tail_draws(row, salts: np.ndarray, falling: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Place of the salt and value of the draws of a part (row.block of row.parts) of a fitted tail, by salt and, if asked for, falling value."""
    own = allotted(tail_counts(row.deal, row.n, row.k), row.parts, 1, row.block, 3, row.deal)
    u = (row.block + 1 - generator(3, row.deal, row.block).random(own.sum())) / row.parts
    who = np.repeat(np.arange(DEALT), own)
    place = np.full(DEALT, -1)
    place[salts % DEALT] = np.arange(len(salts))
    held = place[who] >= 0
    who, u = place[who[held]], u[held]
    shape, scale = np.asarray(row.shape, float)[who], np.asarray(row.scale, float)[who]
    flat = np.abs(shape) < 1e-9
    value = row.threshold + np.where(flat, -scale * np.log(u), scale * np.expm1(-shape * np.log(u)) / np.where(flat, 1, shape))
    if not falling:
        return who, value
    order = np.lexsort((u, who))  # the larger the value, the smaller what lies above it
    return who[order], value[order]


def tail_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SUMS for pairs of a part of a tail, or of a block of what lies below it, and a deal."""
    for frame in frames:
        for row in frame.itertuples():
            salts = np.asarray(row.salt, np.int64)
            if row.volume is None:
                who, x = tail_draws(row, salts, falling=False)
                out = [np.bincount(who, weights, len(salts)) for weights in (None, x, x * x)]
                yield sums_of(row.block, salts, [np.stack([*out, np.zeros(len(salts))], axis=1)])
            else:
                v = np.asarray(row.volume, float)
                by = np.stack([falls(v), falls(v * v)], axis=1)
                yield sums_of(row.block, salts, [np.column_stack([c[:, -1], c @ by, np.zeros(len(c))]) for _, c in bulk_counts(row, salts)])


def bulk_counts(row, salts: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """As counts_of, for a block of entities below the tail; such blocks follow the tail's parts."""
    drawn = places(row.deal, row.n - row.k, row.width, row.block - row.parts, len(row.volume), row.n - tail_counts(row.deal, row.n, row.k), 4)
    return drawn_up_to(*drawn, len(row.volume), salts % DEALT)


def tail_tops(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """As block_tops, for tail_sums' blocks; a salt is asked for once for each measure."""
    for frame in frames:
        for row in frame.itertuples():
            asked, takes = np.asarray(row.salt, np.int64), np.asarray(row.take, np.int64)
            salts, at, first = np.unique(asked, return_inverse=True, return_index=True)[0], *np.unique(asked, return_inverse=True, return_index=True)[:0:-1]
            if row.volume is None:
                who, x = tail_draws(row._replace(shape=np.asarray(row.shape)[first], scale=np.asarray(row.scale)[first]), salts)
                starts = np.searchsorted(who, np.arange(len(salts) + 1))
                ahead = np.concatenate([[0.0], np.cumsum(x)])
                top = ahead[np.minimum(starts[at] + takes, starts[at + 1])] - ahead[starts[at]]
            else:
                by = falls(np.asarray(row.volume, float))
                top = np.concatenate([np.minimum(c, takes[s][:, None]) @ by for s, c in bulk_counts(row, asked)])
            yield pd.DataFrame({"salt": asked, "measure": row.measure, "top": top})


# Permutations: how many places of a shard go to which other is drawn as a uniform permutation has it; which ones, and where to, say keyed bijections of either shard's places, so
# that no permutation is ever sorted or exchanged.
#: Places of a shard; rounds of a scramble; places scrambled at a time.
SHARD, ROUNDS, STEP = 1 << 18, 3, 1 << 14


def shard_starts(n: int, shard: int = SHARD) -> np.ndarray:
    """Where the shards of n places, equal but for one place, begin, and the end of the last."""
    count = max(1, -(-n // shard))
    return np.arange(count + 1) * n // count


def transports(deal: int, n: int, shard: int = SHARD) -> np.ndarray:
    """How many places of each shard (second axis) each permutation of a deal (first axis) puts in each shard (third axis)."""
    sizes, draws = np.diff(shard_starts(n, shard)), generator(5, deal)
    out, free = np.zeros((DEALT, len(sizes), len(sizes)), np.int64), np.tile(sizes, (DEALT, 1))
    for a, size in enumerate(sizes):
        rest = np.full(DEALT, size)
        for b in range(len(sizes) - 1):
            out[:, a, b] = draws.hypergeometric(free[:, b], free[:, b + 1 :].sum(1), rest)
            rest -= out[:, a, b]
        out[:, a, -1] = rest
        free -= out[:, a]
    return out


def runs(moves: np.ndarray) -> np.ndarray:
    """From transports, for each permutation and pair of shards: the number of places, and where their runs begin in the scrambled order of the first and of the second shard (last axis)."""
    return np.stack([moves, np.cumsum(moves, 2) - moves, np.cumsum(moves, 1) - moves], axis=3)


def turns(size: int, *key: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Random turns of the rows and of the columns of the square that size places fill, for each round."""
    shift, draws = (max(0, size - 1).bit_length() + 1) // 2, generator(6, *key)
    rows = -(-size // (1 << shift))
    return [(draws.integers(0, 1 << shift, rows), draws.integers(0, rows, 1 << shift)) for _ in range(ROUNDS)]


def scrambled(at: np.ndarray, size: int, rounds: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Where turning each row and then each column by its own number puts the given places, again for those that leave the range."""
    shift, rows = (max(0, size - 1).bit_length() + 1) // 2, np.uint64(len(rounds[0][0]))
    mask = (1 << shift) - 1
    row, col = at >> shift, at & mask
    for by_row, by_col in rounds:
        col += by_row.take(row)
        col &= mask
        row += by_col.take(col)
        high = row.view(np.uint64)
        np.minimum(high, high - rows, out=high)  # below rows the difference wraps round
    out = row << shift | col
    outside = np.flatnonzero(out >= size)
    if len(outside):
        out[outside] = scrambled(out[outside], size, rounds)
    return out


def matches(run: np.ndarray, sizes: tuple[int, int], number: int, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of shard a, and those of shard b (from 0 in each) that a permutation puts them at, in parts."""
    first, second = turns(sizes[0], number, 0, a), turns(sizes[1], number, 1, b)
    for start in range(0, int(run[0]), STEP):
        at = np.arange(start, min(start + STEP, int(run[0])))
        yield scrambled(at + run[1], sizes[0], first), scrambled(at + run[2], sizes[1], second)


def moved(places: np.ndarray, n: int, numbers: np.ndarray, shard: int = SHARD) -> np.ndarray:
    """Where each of the numbered permutations of n places (a row each) puts the given ones."""
    starts, out = shard_starts(n, shard), np.empty((len(numbers), len(places)), np.int64)
    sizes = np.diff(starts).tolist()
    held = {deal: runs(transports(deal, n, shard)) for deal in {int(r) // DEALT for r in numbers}}
    for i, r in enumerate(np.asarray(numbers).tolist()):
        whole = np.empty(n, np.int64)
        for a, b in np.ndindex(len(sizes), len(sizes)):
            for x, y in matches(held[r // DEALT][r % DEALT, a, b], (sizes[a], sizes[b]), r, a, b):
                whole[starts[a] + x] = starts[b] + y
        out[i] = whole[places]
    return out


def met(n: int, permutations: int, shard: int = SHARD):
    """For a pair of shards (a, b): r, pair, dot: products of x of the places of a with each list of b (side from 1; x is side 0) where a permutation puts them. Side -1 has the runs of
    whole deals (start)."""
    sizes = np.diff(shard_starts(n, shard)).tolist()

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        a, b = int(key[0]), int(key[1])
        held = {side: rows.sort_values("start") for side, rows in frame.groupby("side")}
        x, *ys = (np.concatenate(held[side]["data"].to_numpy()) for side in sorted(held) if side >= 0)
        y, r, dots = np.stack(ys, axis=1), [], []
        for deal, data in zip(held[-1]["start"].tolist(), held[-1]["data"]):
            for j, own in enumerate(np.asarray(data).astype(np.int64).reshape(DEALT, 3)):
                number = deal * DEALT + j
                if 1 <= number <= permutations:
                    r.append(number)
                    dots.append(sum((x.take(at) @ y.take(to, axis=0) for at, to in matches(own, (sizes[a], sizes[b]), number, a, b)), np.zeros(len(ys))))
        whole = np.array(dots).reshape(-1, len(ys))
        return pd.concat([pd.DataFrame({"r": r, "pair": pair, "dot": whole[:, pair]}) for pair in range(len(ys))])

    return run
