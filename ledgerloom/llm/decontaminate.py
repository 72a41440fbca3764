"""Benchmark decontamination: an FM-index over each shard of training documents, searched for benchmark windows.

A shard is a run of whole documents inside one task. Its words become numbers; words that are not in the benchmark's
vocabulary (told by a filter of fixed size, which lets a few others pass) are breaks, and runs shorter than the shortest window,
which can hold none, are left out. Over what remains stand, once for each shard, a suffix array, its Burrows-Wheeler
transform in a wavelet matrix, and every eighth suffix position. Blocks of windows pass by, one after another: all phrases of a
block are searched backward at once; the rows found are walked to sampled positions; occurrences become word
spans, which are merged in each document. Documents never leave their shard, so there is no shuffle, however often a
passage occurs. A block has about block_windows windows or BLOCK_BYTES at most; at most PASS_BLOCKS of them are sent out
at a time. Beyond that the result so far is written, they are taken back, and the next ones pass over it, so that what is
broadcast has a bound whatever the size of the benchmark.

Cases: null and empty texts have no words; a benchmark item without words finds nothing; an item whose id is null is
named "null"; repeated items count once; repeated documents are judged each; empty tables give an empty result or no
hits; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, stored, texts, words
from .packed import in_filter, key_filter

WINDOW, BLOCK_WINDOWS, SHARD_WORDS, SAMPLE = 13, 200_000, 2_000_000, 8
#: Bytes of a block's phrases and item names, and blocks that are broadcast at a time.
BLOCK_BYTES, PASS_BLOCKS = 64 << 20, 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of an integer text whose last symbol is smaller than all others, by doubling the compared length."""
    n, rank, step = len(text), np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        fresh = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        rank[order] = fresh
        step *= 2
        if fresh[-1] == n - 1 or step >= n:
            return order


class FMIndex:
    """Counts and locates patterns in an integer text (symbols from 1; 0 is added as its end)."""

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.append(text, 0)
        order = suffix_array(text)
        last = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.n, self.last = len(text), last
        self.levels: list[tuple[np.ndarray, int]] = []
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = (last >> bit) & 1
            rank = np.concatenate([[0], np.cumsum(ones)]).astype(np.int32)
            self.levels.append((rank, len(last) - int(rank[-1])))
            last = np.concatenate([last[ones == 0], last[ones == 1]])
        self.sampled = order % SAMPLE == 0
        self.slot = np.cumsum(self.sampled) - 1
        self.position = order[self.sampled]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        start, row = np.zeros_like(row), row.copy()
        for depth, (ones, zeros) in enumerate(self.levels):
            up = (symbol >> (len(self.levels) - 1 - depth)) & 1 == 1
            a, b = ones[start], ones[row]
            start, row = np.where(up, zeros + a, start - a), np.where(up, zeros + b, row - b)
        return row - start

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns (rows, filled up on the left) that occur, with their first and last row: taken from the last
        symbol to the first; patterns without rows drop out at once."""
        live = np.arange(len(patterns))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width = patterns.shape[1]
        for step in range(width):
            if not len(live):
                break
            symbol = patterns[live, width - 1 - step]
            lo, hi = self.before[symbol] + self.rank(symbol, lo), self.before[symbol] + self.rank(symbol, hi)
            ended = (sizes[live] == step + 1) & (lo < hi)
            done.append((live[ended], lo[ended], hi[ended]))
            on = (lo < hi) & (sizes[live] > step + 1)
            live, lo, hi = live[on], lo[on], hi[on]
        return tuple(np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in range(3))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row: steps back through the text until a sampled one is met."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            met = self.sampled[rows[todo]]
            out[todo[met]] = self.position[self.slot[rows[todo[met]]]] + steps[todo[met]]
            todo = todo[~met]
            symbol = self.last[rows[todo]]
            rows[todo] = self.before[symbol] + self.rank(symbol, rows[todo])
            steps[todo] += 1
        return out


class Windows:
    """A block of benchmark windows: words by their place in the block's vocabulary, each phrase once, beside the items that have it."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        by: dict[bytes, set[str]] = {}
        for item, phrase in rows:
            by.setdefault(phrase, set()).add(item)
        split = [phrase.split() for phrase in by]
        self.words = sorted({w for s in split for w in s})
        self.items = sorted({item for item, _ in rows})
        place, at = ({x: i for i, x in enumerate(known)} for known in (self.words, self.items))
        self.sizes = np.array(list(map(len, split)), np.int64)
        self.places = np.full((len(split), int(self.sizes.max(initial=0))), len(self.words), np.int32)
        for i, s in enumerate(split):
            self.places[i, -len(s) :] = [place[w] for w in s]
        self.n_items = np.array(list(map(len, by.values())), np.int64)
        self.item = np.array([at[x] for own in by.values() for x in own], np.int64)


class Shard:
    """Whole documents under one FM-index. Symbol 0 ends the text and 1 breaks it; words are numbered as the shard holds them."""

    def __init__(self, docs: list[list[bytes]], bits: np.ndarray, least: int):
        counts = np.fromiter(map(len, docs), np.int64, len(docs))
        self.first = np.cumsum(counts) - counts
        number: dict[bytes, int] = {}
        code = np.fromiter((number.setdefault(w, len(number)) for d in docs for w in d), np.int64, int(counts.sum()))
        known = in_filter(bits, word_names(list(number)))[code]
        self.owner = np.repeat(np.arange(len(docs)), counts)
        # Runs of words that the benchmark may have, inside one document, long enough for the shortest window; each with a break after it.
        new = np.append(True, (known[1:] != known[:-1]) | (self.owner[1:] != self.owner[:-1]))[: len(code)]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(code)))
        held = known[starts] & (sizes >= least)
        starts, sizes = starts[held], sizes[held]
        self.index, self.symbol = None, {}
        if not len(starts):
            return
        ends = np.cumsum(sizes + 1)
        self.source = np.repeat(starts - (ends - sizes - 1), sizes + 1) + np.arange(ends[-1])
        text = code[np.minimum(self.source, len(code) - 1)]
        text[ends - 1] = -1
        left, text = np.unique(text, return_inverse=True)
        all_words = list(number)
        self.symbol = {all_words[c]: i + 2 for i, c in enumerate(left[1:].tolist())}
        self.index = FMIndex(text.astype(np.int64) + 1, len(left) + 1)

    def find(self, block: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of the block's phrases (document, first word, end), and the documents and items that they bring together."""
        none = np.zeros(0, np.int64)
        if self.index is None:
            return (none,) * 5
        get = self.symbol.get
        symbols = np.array([*(get(w, -1) for w in block.words), 0], np.int64)
        patterns = symbols[block.places]
        able = np.flatnonzero((patterns >= 0).all(axis=1))
        which, lo, hi = self.index.search(patterns[able], block.sizes[able])
        which, n = able[which], hi - lo
        rows = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        which = np.repeat(which, n)
        word = self.source[self.index.locate(rows)]
        doc = self.owner[word]
        begin = word - self.first[doc]
        met = np.unique(doc * len(block.sizes) + which)
        met_doc, phrase = met // len(block.sizes), met % len(block.sizes)
        n = block.n_items[phrase]
        at = np.repeat((np.cumsum(block.n_items) - block.n_items)[phrase] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return doc, begin, begin + block.sizes[which], np.repeat(met_doc, n), block.item[at]


def word_names(own: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)).view(np.int64)


def vocabulary(phrases: DataFrame) -> DataFrame:
    """name: hashes of all words of the phrases."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(word_names(list({w for p in texts(b, "phrase") for w in p.split()})))], ["name"])

    return phrases.select("phrase").mapInArrow(named, "name long")


def merge_spans(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and touching spans become one."""
    if not len(begin):
        return []
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(np.append(True, begin[1:] > reach[:-1]))
    return list(zip(begin[cut].tolist(), reach[np.append(cut[1:], len(begin)) - 1].tolist()))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """item (string) and phrase (binary, words with spaces between): all windows of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, phrases = [], []
            for item, text in zip(batch.column("item").to_pylist(), texts(batch)):
                w = words(text)
                own = {b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else ()
                items += [item] * len(own)
                phrases += own
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(phrases, pa.binary())], ["item", "phrase"])

    named = columns(benchmark, item=id_col, text=text_col).withColumn("item", F.coalesce(F.col("item").cast("string"), F.lit("null")))
    return named.mapInArrow(cut, "item string, phrase binary").distinct()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """The id (and the columns in keep) of every document with n_words, n_hit, spans (merged; words from 0, end exclusive) and
    items (those with occurring windows, sorted as strings)."""
    kept = {} if keep is None else {c: c for c in keep if c != id_col}
    chosen = columns(docs, **{id_col: id_col}, **kept, **({} if text_col in kept else {text_col: text_col}))
    out = [id_col, *kept]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in dict.fromkeys([*out, text_col]))
    schema += ", n_words long, n_hit long, spans array<struct<start: long, end: long>>, items array<string>"
    spark = docs.sparkSession
    phrases = stored(benchmark_windows(benchmark, window=window), "windows")
    size = F.length("phrase") + F.octet_length("item")
    whole = phrases.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.min(F.size(F.split(F.decode("phrase", "ISO-8859-1"), " "))).alias("least")).first()
    blocks = max(1, -(-whole["n"] // block_windows), -(-(whole["bytes"] or 0) // BLOCK_BYTES))
    least, bits = whole["least"] or window, spark.sparkContext.broadcast(key_filter(vocabulary(phrases), "name"))
    result = chosen.withColumns({"spans": F.lit(None).cast("array<struct<start: long, end: long>>"), "items": F.lit(None).cast("array<string>")})

    def searched(parts):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                split = [words(t) for t in texts(whole, text_col)]
                counts = np.fromiter(map(len, split), np.int64, len(split))
                shard = np.cumsum(counts) // SHARD_WORDS
                bounds = [*np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist(), len(split)] if len(split) else [0]
                for a, e in zip(bounds, bounds[1:]):
                    batch = whole.slice(a, e - a)
                    own = Shard(split[a:e], bits.value, least)
                    items = [set(t or ()) for t in batch.column("items").to_pylist()]
                    before = [(i, x["start"], x["end"]) for i, s in enumerate(batch.column("spans").to_pylist()) for x in s or ()]
                    met = [[np.array(x, np.int64) for x in zip(*before)]] if before else []
                    for part in parts if own.index is not None else ():
                        block = pickle.loads(part.value)
                        *at, doc, item = own.find(block)
                        met.append(at)
                        for d, x in zip(doc.tolist(), item.tolist()):
                            items[d].add(block.items[x])
                    doc, begin, end = (np.concatenate(x) for x in zip(*met)) if met else (np.zeros(0, np.int64),) * 3
                    order = np.argsort(doc, kind="stable")
                    cut = np.searchsorted(doc[order], np.arange(e - a + 1))
                    merged = [merge_spans(begin[order[x:y]], end[order[x:y]]) for x, y in zip(cut, cut[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch.column(c) for c in dict.fromkeys([*out, text_col])),
                            pa.array(counts[a:e], pa.int64()),
                            pa.array([sum(y - x for x, y in m) for m in merged], pa.int64()),
                            pa.array([[{"start": x, "end": y} for x, y in m] for m in merged], span),
                            pa.array(list(map(sorted, items)), pa.list_(pa.string())),
                        ],
                        [*dict.fromkeys([*out, text_col]), "n_words", "n_hit", "spans", "items"],
                    )

        return run

    for first in range(0, blocks, PASS_BLOCKS):
        parts = []
        for b in range(first, min(first + PASS_BLOCKS, blocks)):
            rows = phrases.where(F.pmod(F.xxhash64("item", "phrase"), F.lit(blocks)) == b).collect()
            parts.append(spark.sparkContext.broadcast(pickle.dumps(Windows([(r["item"], bytes(r["phrase"])) for r in rows]))))
        result = result.mapInArrow(searched(parts), schema)
        if first + PASS_BLOCKS < blocks:
            result = stored(result, "searched")
            for part in parts:
                part.destroy()
    return result.select(*out, "n_words", "n_hit", "spans", "items")


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """A document is contaminated if benchmark windows cover at least a twentieth of its words."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
