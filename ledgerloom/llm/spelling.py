"""Grouping of spelling variants: Bloom-guided neighbourhoods over the vocabulary of a corpus.

Every task counts the words of its own documents and sends each of them once for some hundred thousand; counts are added up by word. Two
words are near if one code point inserted, deleted or replaced turns one into the other. The vocabulary is put into blocked Bloom
filters, one for each length, which are all that tasks share: their bits are added up by block, and together they never take more than
FILTER_BYTES (beyond that more edits pass them by chance, none is lost). Edits are hashed without being spelled: a word's hash is a sum
over its places, so that of an edit follows from it and from the sums before the place. Each pair is tried once, as a deletion from the longer word or as a
replacement by the larger code point; edits that the filter of their length holds are spelled and joined with the vocabulary, which removes those that passed by
chance. A word has no more near words than edits, so no group grows with the corpus. Forms lead to words of at least twice the
count, so the last of a chain is found by a few rounds that double their steps.

Cases: null and empty texts have no words; a null id counts as the text null in the draw; rows that repeat are read as often as they occur; ties
of counts go to the smaller word in code-point order; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, mix, stored

#: Letters A-Z are lowered; every other ASCII byte ends a run; what is outside ASCII is looked at in those words only that hold it.
RUN_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RUN = re.compile(r"[a-zÀ-ÿ]+")
#: Words that a task counts before it sends them, bytes of a text taken at a time, edits that are tried at a time.
HELD, TAKEN, TRIED = 300_000, 4 << 20, 1 << 20
#: Bits of the filters for each word, bits set in a block of 64 for each word, bytes of all filters at most, and the length from which on lengths share a filter.
BITS, MARKS, FILTER_BYTES, LONGEST = 24, 4, 32 << 20, 64
#: A document's word loses a code point if this divides its draw.
DRAW = 97

STEP = 0x9E3779B97F4A7C15 | 1
BACK = pow(STEP, -1, 1 << 64)


def runs(text: str | None) -> Counter:
    """The lowered runs of Latin letters of a text, as UTF-8, and how often they occur."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(RUN_BYTES)
    found: Counter = Counter()
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + TAKEN) if len(raw) - at > TAKEN else -1
        found.update(raw[at : end if end >= 0 else len(raw)].split())
        at = end if end >= 0 else len(raw)
    for token in [t for t in found if not t.isascii()]:
        n = found.pop(token)
        for run in RUN.findall(token.decode("utf-8", "surrogatepass")):
            found[run.encode()] += n
    return found


def drawn(run: bytes, crc: int, every: int) -> bytes:
    """The run, or what is left of it where every divides the draw; crc is that of what stands before the run."""
    h = zlib.crc32(run, crc)
    if h % every:
        return run
    points = run.decode()
    at = h % len(points)
    return (points[:at] + points[at + 1 :]).encode()


def counted(least_length: int, every: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words of at least so many code points of a task's documents, with counts; every draws runs that lose a code point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def packed() -> pa.RecordBatch:
            own = [(w, n) for w, n in held.items() if len(w) >= least_length and (w.isascii() or len(w.decode()) >= least_length)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64())], ["word", "n"])

        for b in batches:
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                crc = zlib.crc32(f"{'null' if doc is None else doc}:".encode())
                for own, n in runs(text).items():
                    if len(own) >= least_length:  # bytes: a run of fewer can't give such a word
                        held[own if every is None else drawn(own, crc, every)] += n
                if len(held) > HELD:
                    yield packed()
        yield packed()

    return run


def vocabulary(docs: DataFrame, id_col: str, text_col: str, least_length: int, least_count: int, every: int | None) -> DataFrame:
    """word, n of all texts."""
    rows = columns(docs, id=id_col, text=text_col).select(F.col("id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(counted(least_length, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def values(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))


def powers(n: int, base: int = STEP) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(0, n - 1), base, np.uint64))])[:n].astype(np.uint64)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words of one length, and their code points (a row for each)."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        rows = max(1, TRIED // max(1, size))
        for a in range(0, len(at), rows):
            own = at[a : a + rows]
            yield own, np.frombuffer("".join(words[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), size)


def word_hashes(codes: np.ndarray) -> np.ndarray:
    return (values(codes) * powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def shard_of(length: np.ndarray | int) -> np.ndarray:
    return np.minimum(length, LONGEST)


class Filters:
    """Where each length's blocks begin and how many there are, the bits, and the alphabet."""

    def __init__(self, counts: dict[int, int], alphabet: np.ndarray):
        whole = sum(counts.values())
        per_word = min(BITS, FILTER_BYTES * 8 / max(1, whole)) / 64
        self.blocks = np.zeros(LONGEST + 1, np.int64)
        for length, n in counts.items():
            self.blocks[length] = max(1, int(n * per_word))
        self.starts = np.concatenate([[0], np.cumsum(self.blocks)])[:-1]
        self.bits, self.alphabet = np.zeros(int(self.blocks.sum()), np.uint64), np.sort(alphabet).astype(np.uint32)

    def places(self, hashes: np.ndarray, shard: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Block and mask of hashes whose words have the given shard; a shard without blocks gives block 0 and must be left out before."""
        h = mix(hashes)
        block = self.starts[shard] + ((h >> np.uint64(32)) * self.blocks[shard].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        mask = np.zeros(h.shape, np.uint64)
        for i in range(MARKS):
            mask |= np.uint64(1) << (h >> np.uint64(6 * i) & np.uint64(63))
        return block, mask

    def hold(self, hashes: np.ndarray, shard: int) -> np.ndarray:
        if not self.blocks[shard]:
            return np.zeros(hashes.shape, bool)
        block, mask = self.places(hashes, shard)
        return self.bits[block] & mask == mask


def filters(words: DataFrame) -> Filters:
    """The filters of a vocabulary: what comes to the driver has at most FILTER_BYTES of blocks, a count for each length, and the alphabet."""
    sizes = {r["s"]: r["n"] for r in words.groupBy(F.least(F.char_length("word"), F.lit(LONGEST)).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    # Of bounded size: code points are at most some 10 ** 6, and here Latin letters.
    alphabet = [ord(r[0]) for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()]
    out = Filters(sizes, np.array(alphabet, np.int64))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("word").to_pylist()
            for _, codes in by_length(own):
                block, mask = out.places(word_hashes(codes), int(shard_of(codes.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(mask.view(np.int64), pa.int64())], ["block", "mask"])

    found = words.select("word").mapInArrow(marked, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(len(out.bits), np.uint64)
    bits[np.asarray(found.column("block"), np.int64)] = np.ascontiguousarray(np.asarray(found.column("mask"), np.int64)).view(np.uint64)
    out.bits = bits
    return out


def edits(words: list[str], held: Filters) -> Iterator[tuple[int, str]]:
    """Place of a word and one of its edits, of those that the filters hold: deletions, and replacements by larger code points."""
    for own, codes in by_length(words):
        size = codes.shape[1]
        power, value = powers(size), values(codes)
        parts = value * power
        ahead = np.concatenate([np.zeros((len(own), 1), np.uint64), np.cumsum(parts, axis=1, dtype=np.uint64)], axis=1)
        whole = ahead[:, -1:]
        # Deleting any of a stretch of equal code points gives the same word.
        gone = ahead[:, :-1] + (whole - ahead[:, 1:]) * np.uint64(BACK)
        own_place = np.concatenate([np.ones((len(own), 1), bool), codes[:, 1:] != codes[:, :-1]], axis=1)
        if size > 1:
            for w, i in zip(*np.nonzero(held.hold(gone, int(shard_of(size - 1))) & own_place)):
                word = words[own[w]]
                yield int(own[w]), word[:i] + word[i + 1 :]
        step = max(1, TRIED // max(1, len(held.alphabet)))
        flat = np.arange(codes.size)
        new = values(held.alphabet)
        for a in range(0, codes.size, step):
            w, i = np.divmod(flat[a : a + step], size)
            hashes = whole[w] + (new[None, :] - value[w, i][:, None]) * power[i][:, None]
            found = held.hold(hashes, int(shard_of(size))) & (held.alphabet[None, :] > codes[w, i][:, None])
            for row, c in zip(*np.nonzero(found)):
                word = words[own[w[row]]]
                yield int(own[w[row]]), word[: i[row]] + chr(held.alphabet[c]) + word[i[row] + 1 :]


def tried(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, n = b.column("word").to_pylist(), np.asarray(b.column("n"), np.int64)
            at, made = [], []
            for i, edit in edits(words, shared.value):
                at.append(i)
                made.append(edit)
                if len(at) >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in at], pa.string()), pa.array(n[at]), pa.array(made, pa.string())], ["word", "n", "edit"])
                    at, made = [], []
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in at], pa.string()), pa.array(n[np.array(at, np.int64)]), pa.array(made, pa.string())], ["word", "n", "edit"])

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n for both directions of every pair of near words of a stored vocabulary (word, n)."""
    shared = words.sparkSession.sparkContext.broadcast(filters(words))
    candidates = words.mapInArrow(tried(shared), "word string, n long, edit string")
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = stored(candidates.join(known, F.col("edit") == F.col("other")).select("word", "n", "other", "other_n"), "near_words")
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(words: DataFrame) -> DataFrame:
    """word, root for (word, form): where forms lead to in the end. A round joins each word's place with that place's own, so steps double."""
    now = stored(words.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = now.where("word <> root").select(F.col("word").alias("via"), F.col("root").alias("next"))
        moved = stored(now.join(ahead, F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, ratio: int = 2, every: int | None = DRAW) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word: how often it occurs, how many near words it has, the most frequent of these if it occurs at
    least ratio times as often, and where forms lead in the end. every takes a code point from the runs of a document whose draw it divides; None from none."""
    words = stored(vocabulary(docs, id_col, text_col, least_length, least_count, every), "vocabulary")
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    wide = -F.col("best.less") >= ratio * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", F.when(wide, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(wide, -F.col("best.less")).alias("form_n")
    )
    rows = stored(rows, "forms")
    return rows.join(roots(rows), "word").select("word", "form", "root", "n", "n_near", "form_n")
