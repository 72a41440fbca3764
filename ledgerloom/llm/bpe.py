"""Byte-pair encoding and decoding of whole texts with a published vocabulary.

Merging runs in rounds over many words at once: the symbols of all new words of a batch lie in one flat numpy
array, the rank of every neighbouring pair is found by binary search over the sorted pair keys, and in each round
every word joins its own lowest-ranked pair wherever it occurs. In a trained vocabulary a merge ranks after the
merges that make its two parts, so joining all places of one pair at once gives what joining them singly gives.

Only the vocabulary (of fixed size, checked) travels to the executors; texts never leave their partition, so there is
no shuffle. Cases: null and empty texts have no tokens and an empty decoded text; repeated rows are encoded each; an
empty table gives an empty result; other columns are ignored.
Very long texts are encoded whole, some hundred texts at a time; there are no ties (equal ranks go to the leftmost pair). Characters that the tables of this Python or its
regular expressions know, and those of the library don't (or the other way round), are listed below, so that every code point is split as the library does.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import columns, texts

#: The pre-tokenizer's pattern and white space as the vocabulary file and its library define them.
#: The first two are runs of code points, in hexadecimal, that the library's tables don't know yet as letters and as numbers.
LATER_LETTERS = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8
16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff
1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
LATER_NUMBERS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"


def charset(runs: str) -> str:
    """Runs of code points as the inside of a character class."""
    return "".join("-".join(chr(int(end, 16)) for end in run.split("-")) for run in runs.split())


PIECES = (
    r"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{L}--[" + charset(LATER_LETTERS) + r"]]+|[\p{N}--[" + charset(LATER_NUMBERS) + r"]]|[[^\s\p{L}\p{N}]||[" + charset(LATER_LETTERS + LATER_NUMBERS) + "]]+"
)
SEPARATORS = "\x1c\x1d\x1e\x1f"
WORD_END = "</w>"
#: A vocabulary larger than this is refused: it is sent to every executor.
MAX_MERGES = 1_000_000
#: Chunks kept between batches of a task; beyond it the memory is started anew.
CACHED_CHUNKS = 200_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + extra)
            extra += 1
    return [names[b] for b in range(256)]


#: Capitals that came into Unicode after the version that Python knows, by code point, and their small letters.
LATER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
LATER = regex.compile("[" + "".join(map(chr, LATER_LOWER)) + "]")


@dataclass(frozen=True)
class Vocabulary:
    """What encoding and decoding need of a tokenizer file."""

    first: np.ndarray  # id of each byte inside a word
    last: np.ndarray  # id of each byte that ends a word
    keys: np.ndarray  # sorted keys of mergeable pairs
    ranks: np.ndarray  # of the pair of each key
    made: np.ndarray  # id that each rank makes
    names: list[str]  # text of each id
    special: dict[str, int]


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    ids, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if len(merges) > MAX_MERGES:
        raise ValueError(f"{len(merges)} merges; at most {MAX_MERGES} are sent to executors")
    left, right = (np.array([ids[m[i]] for m in merges], np.uint64) for i in (0, 1))
    made = np.array([ids[a + b] for a, b in merges], np.int64)
    born = np.full(max(ids.values()) + 1, -1, np.int64)
    born[made] = np.arange(len(made))
    if (np.maximum(born[left.astype(np.int64)], born[right.astype(np.int64)]) >= np.arange(len(made))).any():
        raise ValueError("a merge ranks before one that makes its part; rounds would differ from single merges")
    keys = left << np.uint64(32) | right
    order = np.argsort(keys)
    names = [""] * (max([*ids.values(), *special.values()]) + 1)
    for name, i in [*ids.items(), *special.items()]:
        names[i] = name
    symbols = byte_symbols()
    return Vocabulary(
        np.array([ids[s] for s in symbols], np.int64),
        np.array([ids[s + WORD_END] for s in symbols], np.int64),
        keys[order],
        order.astype(np.int64),
        made,
        names,
        special,
    )


def merge_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one after another, and where each word's begin (one bound more than words)."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    symbols = v.first[raw]
    symbols[ends - 1] = v.last[raw[ends - 1]]
    owner = np.repeat(np.arange(len(words)), sizes)
    done_ids, done_owner = [], []
    none = len(v.ranks)
    while len(symbols):
        near = owner[:-1] == owner[1:]
        key = symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:].astype(np.uint64)
        at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        rank = np.where(near & (v.keys[at] == key), v.ranks[at], none)
        rank = np.append(rank, none)
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbols))))
        still = best < none
        if not still.all():
            done_ids.append(symbols[~still])
            done_owner.append(owner[~still])
            symbols, owner, rank, best = symbols[still], owner[still], rank[still], best[still]
            if not len(symbols):
                break
        hit = rank == best
        # In a run of equal symbols every place is a hit; joins are taken from the left and never overlap.
        run = np.arange(len(hit)) - np.maximum.accumulate(np.where(hit, -1, np.arange(len(hit)))) - 1
        joined = hit & (run % 2 == 0)
        symbols[joined] = v.made[rank[joined]]
        kept = np.append(True, ~joined[:-1])
        symbols, owner = symbols[kept], owner[kept]
    ids, of = np.concatenate(done_ids), np.concatenate(done_owner)
    ids = ids[np.argsort(of, kind="stable")]
    return ids, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))])


class Encoder:
    """Encodes and decodes texts; remembers the tokens of white-space chunks seen before."""

    def __init__(self, v: Vocabulary):
        self.v, self.pieces = v, regex.compile(PIECES)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, v.special)) + ")") if v.special else None
        self.white = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
        self.reset()

    def reset(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat, self.start, self.size, self.decoded = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def normal(self, text: str) -> list[str]:
        """Chunks between white space after composition and lower-casing, letter by letter."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")
        text = text.lower()
        if not text.isascii() and LATER.search(text):
            text = text.translate(LATER_LOWER)
        if any(c in text for c in SEPARATORS):
            return [x for x in self.white.split(text) if x]
        return text.split()

    def learn(self, chunks: set[str]) -> None:
        new, findall = list(chunks), self.pieces.findall
        parts = [(c,) if c.isalpha() else findall(c) for c in new]
        distinct: dict[str, int] = {}
        at = np.fromiter((distinct.setdefault(w, len(distinct)) for p in parts for w in p), np.int64)
        ids, bounds = merge_words([w.encode("utf-8", "surrogatepass") for w in distinct], self.v)
        tokens, cuts = list(map(self.v.names.__getitem__, ids.tolist())), bounds.tolist()
        said = [" ".join(tokens[i:j]) for i, j in zip(cuts, cuts[1:])]
        base = len(self.slot)
        self.slot.update(zip(new, range(base, base + len(new))))
        counts, where = np.fromiter(map(len, parts), np.int64, len(parts)), 0
        for n, w in zip(counts.tolist(), at[np.cumsum(counts) - counts].tolist()):
            self.decoded.append(said[w] if n == 1 else " ".join([said[x] for x in at[where : where + n].tolist()]))
            where += n
        size = np.diff(bounds)[at]
        upto = np.cumsum(size)
        flat = ids[np.repeat(bounds[at] - upto + size, size) + np.arange(upto[-1])]
        grown = np.add.reduceat(size, np.cumsum(counts) - counts)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(grown) - grown])
        self.size = np.concatenate([self.size, grown])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def batch(self, texts: list[str | None]) -> tuple[list[bytes], list[str], list[int]]:
        """For each text its ids as little-endian 32-bit integers, the decoded text and the number of ids."""
        split = []
        for text in texts:
            parts = [text or ""] if self.cut is None or not text or not any(x in text for x in self.v.special) else self.cut.split(text)
            split.append([(p, None) if p in self.v.special else (None, self.normal(p)) for p in parts])
        seen = set().union(*[c for parts in split for _, c in parts if c])
        if len(self.slot) + len(seen) > CACHED_CHUNKS:
            self.reset()
        if new := seen.difference(self.slot):
            self.learn(new)
        packed, decoded, counts = [], [], []
        for parts in split:
            ids, said = [], []
            for special, chunks in parts:
                if special is not None:
                    ids.append(np.array([self.v.special[special]], np.int32))
                    said.append(special)
                elif chunks:
                    at = np.fromiter(map(self.slot.__getitem__, chunks), np.int64, len(chunks))
                    size = self.size[at]
                    upto = np.cumsum(size)
                    ids.append(self.flat[np.repeat(self.start[at] - upto + size, size) + np.arange(upto[-1])])
                    said.append(" ".join(map(self.decoded.__getitem__, at.tolist())))
            whole = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            packed.append(whole.astype("<u4").tobytes())
            decoded.append(" ".join(said))
            counts.append(len(whole))
        return packed, decoded, counts


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 256) -> DataFrame:
    """id_col, n_tokens, ids (binary: little-endian unsigned 32-bit integers), decoded (string) for every row.

    vocabulary: path of the tokenizer file, read by the driver. rows: texts encoded together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                packed, decoded, counts = encoder.batch(texts(batch))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(counts, pa.int64()), pa.array(packed, pa.binary()), pa.array(decoded, pa.string())],
                    ["id", "n_tokens", "ids", "decoded"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    coded = columns(docs, id=id_col, text=text_col).mapInArrow(encode, f"id {kind}, n_tokens long, ids binary, decoded string")
    return coded.withColumnRenamed("id", id_col)
