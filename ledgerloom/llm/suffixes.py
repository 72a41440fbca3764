"""Deep-shallow suffix sorting to a fixed depth, and the exact removal of repeated byte strings that is built on it.

deep_shallow_sort orders suffixes by multikey quicksort on eight-byte keys down to a shallow depth; groups that still share
their whole prefix are ordered by blind tries over what follows.

Finding repeats over a corpus: a string of `length` bytes is named by its anchor, the 32-byte piece with the smallest
hash inside it, so that equal strings have equal anchors at equal offsets. Neighbouring strings with the same anchor
make up a segment. One packed record for each segment (about one for every 35 bytes) is dealt by anchor; segments of some megabytes of
text that are equal, byte by byte, are first reduced to the first of them. Where two or more segments share an anchor, all of them are
fetched from their texts, by an exact join, and dealt by anchor; their strings are suffix-sorted, and of equal ones the first
stays. An anchor that very many segments share would gather its surroundings in one task: its segments are cut by offset into four
stretches instead, dealt by the bytes that all strings of a stretch share. Texts travel only if a segment of theirs is asked
for, or if something is removed from them.

Hashes only say what may meet; every string that is removed has been compared with an earlier one in all its bytes.

Cases: a null text is empty; texts shorter than the length keep all bytes; rows of one id and text are one document; rows of one id
with different texts are different documents, ordered by a checksum of the text; a null id comes before all others; an
empty table gives an empty result; other columns are ignored. Ties (equal strings) go to the first in the order of id, checksum and
place. Very long texts are read whole and give the same strings the same anchors as short ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, mix, partitions, stored, texts
from .packed import PACKED, Columns, dealt, gathered, in_filter, in_parts, key_filter, turns, unpack

LENGTH, PIECE, STRETCHES, SHALLOW = 100, 32, 4, 64
#: Bytes that are hashed at a time; places in a text of any length fit in PLACE bits, the rest orders pieces by their hash.
BATCH_BYTES, PLACE = 250_000, np.uint64(40)
#: Segments and bytes among which equal ones are looked for before any are dealt.
LOT, LOT_BYTES = 200_000, 16 << 20
#: Segments of one anchor from which on they are cut into stretches.
CROWD = 4096
NO_ID = -(1 << 63)

_turn = np.random.default_rng(20240229)
BYTE = _turn.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class BlindTrie:
    """Strings of equal length in order. Inner nodes keep only the depth at which their strings part and the byte found
    there; an insertion walks down blindly, compares once with the leaf it reaches, and then knows where it belongs."""

    def __init__(self) -> None:
        self.root: list | None = None

    def insert(self, tail: bytes, member: int) -> None:
        if self.root is None:
            self.root = [len(tail), tail, [member]]
            return
        node = self.root
        while isinstance(node[1], dict):
            node = node[1].get(tail[node[0]]) or next(iter(node[1].values()))
        other = node[1]
        if other == tail:
            node[2].append(member)
            return
        at = next(i for i, (a, b) in enumerate(zip(tail, other)) if a != b)
        leaf = [len(tail), tail, [member]]
        above, node = None, self.root
        while node[0] < at:
            above, node = node, node[1][tail[node[0]]]
        if node[0] == at:
            node[1][tail[at]] = leaf
            return
        inner = [at, {tail[at]: leaf, other[at]: node}]
        if above is None:
            self.root = inner
        else:
            above[1][tail[above[0]]] = inner

    def leaves(self) -> Iterator[list[int]]:
        """Members of equal strings together, in the order of the strings."""
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if isinstance(node[1], dict):
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield node[2]


def keys_at(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number whose order is theirs."""
    return np.ndarray((max(0, len(text) - 7),), ">u8", text, strides=(1,))[at].astype(np.uint64)


def partitioned(key: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step of multikey quicksort for all groups (runs of equal numbers) at once: every key goes before, to or behind the equals of its
    group's pivot, the middle one of three. The places of the keys in the new order, and the side of each: 0, 1 or 2."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    last = np.append(first[1:], len(group)) - 1
    a, b, c = key[first], key[(first + last) // 2], key[last]
    pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), last - first + 1)
    side = (key >= pivot).astype(np.int64) + (key > pivot)
    to, head = np.empty(len(key), np.int64), np.repeat(first, last - first + 1)
    begin = head
    for s in range(3):
        mine = side == s
        before = np.cumsum(mine) - mine
        to[mine] = (begin + before - before[head])[mine]
        begin = begin + np.repeat(np.add.reduceat(mine, first), last - first + 1)
    return to, side


def deep_shallow_sort(text: np.ndarray, starts: np.ndarray, depth: int, shallow: int = SHALLOW, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first depth bytes, and which of them equal the one before to that depth; group, if given, has runs of
    numbers, inside which alone suffixes are ordered and can be equal.

    Groups are split by multikey quicksort; one whose keys are equal goes eight bytes deeper. text must reach at least depth bytes beyond every start."""
    shallow = min(shallow, depth) // 8 * 8
    n = len(starts)
    order, deep = np.arange(n), np.zeros(n, np.int64)
    same = np.append(False, np.ones(max(0, n - 1), bool) if group is None else group[1:] == group[:-1])[:n]
    while True:
        grouped = same | np.append(same[1:], False)
        places = np.flatnonzero(grouped & (deep < shallow))
        if not len(places):
            break
        owner = np.cumsum(~same)[places]
        to, side = partitioned(keys_at(text, starts[order[places]] + deep[places]), owner)
        for x, moved in ((order, order[places]), (deep, deep[places] + 8 * (side == 1))):
            x[places[to]] = moved
        part = np.empty(len(places), np.int64)
        part[to] = owner * 3 + side
        same[places] = np.append(False, part[1:] == part[:-1])
    grouped = np.flatnonzero(same | np.append(same[1:], False))
    if shallow < depth and len(grouped):
        raw, firsts = text.tobytes(), np.flatnonzero(~same[grouped])
        sizes = np.diff(np.append(firsts, len(grouped)))
        mixed = np.ones(len(firsts), bool)
        if depth - shallow >= 8:
            # A group whose strings are all equal is a trie of one leaf.
            at = starts[order[grouped]] + shallow
            equal = equal_bytes(text, at, np.repeat(at[firsts], sizes), np.full(len(at), depth - shallow))
            mixed = ~np.logical_and.reduceat(equal, firsts)
        for a, b in zip(firsts[mixed].tolist(), (firsts + sizes)[mixed].tolist()):
            places, trie = grouped[a:b], BlindTrie()
            for member, start in zip(order[places].tolist(), starts[order[places]].tolist()):
                trie.insert(raw[start + shallow : start + depth], member)
            members = list(trie.leaves())
            order[places] = [m for leaf in members for m in leaf]
            same[places] = [i > 0 for leaf in members for i in range(len(leaf))]
    return order, same


def equal_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether so many bytes (eight at least) from the places a are those from the places b."""
    equal = np.ones(len(a), bool)
    for k in range(0, int(size.max(initial=0)), 8):
        open_ = np.flatnonzero(equal & (size > k))
        at = np.minimum(k, size[open_] - 8)
        equal[open_] = keys_at(text, a[open_] + at) == keys_at(text, b[open_] + at)
    return equal


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every run of so many, by running minima from both ends of fixed blocks."""
    n = len(values) - width + 1
    pad = -len(values) % width
    blocks = np.append(values, np.full(pad, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Hasher:
    """Hashes of any stretch of a batch of bytes from running sums."""

    def __init__(self, size: int = BATCH_BYTES + 1):
        self.power, self.inverse = (np.cumprod(np.append(np.uint64(1), np.full(size, b, np.uint64))) for b in (BASE, INVERSE))

    def read(self, text: np.ndarray) -> None:
        if len(text) >= len(self.power):
            self.__init__(len(text) + 1)
        self.sums = np.append(np.uint64(0), np.cumsum(BYTE[text] * self.power[: len(text)]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def segments(hasher: Hasher, text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Segments of a batch of documents that end at the given places: start of the first string, number of strings, place of the anchor, anchor's hash."""
    if len(text) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    at = np.arange(len(text) - PIECE + 1)
    piece = hasher.of(at, at + PIECE)
    placed = piece >> PLACE << PLACE | at.astype(np.uint64)
    anchor = (window_minima(placed, length - PIECE + 1) & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    starts = np.arange(len(anchor))
    sizes = np.diff(np.append(0, ends))
    owner_end = np.repeat(ends, sizes)[: len(anchor)]
    valid = starts + length <= owner_end
    new = np.append(True, (anchor[1:] != anchor[:-1]) | ~valid[:-1]) & valid
    first = np.flatnonzero(new)
    # Strings that cross the end of a document lie between segments and belong to none.
    count = np.add.reduceat(valid, first).astype(np.int64) if len(first) else np.zeros(0, np.int64)
    return first, count, anchor[first], piece[anchor[first]]


def batches_of(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts of some million bytes in all, with id and checksum."""
    held: list[bytes] = []
    ids: list[int] = []
    size = 0
    for doc, text in zip(batch.column("id").to_pylist(), batch.column("text")):
        raw = text.as_buffer().to_pybytes() if text.is_valid else b""
        if held and size + len(raw) > BATCH_BYTES:
            yield held, np.array(ids, np.int64), np.array([zlib.crc32(x) for x in held], np.uint32)
            held, ids, size = [], [], 0
        held.append(raw)
        size += len(raw)
        ids.append(NO_ID if doc is None else doc)
    if held:
        yield held, np.array(ids, np.int64), np.array([zlib.crc32(x) for x in held], np.uint32)


def doc_key(doc: np.ndarray) -> np.ndarray:
    return mix(doc.view(np.uint64))


def later_ones(name: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all records in groups of one name, which of these are not their group's first in the order of documents, and that first's place."""
    order = np.argsort(name)
    new = np.append(True, name[order][1:] != name[order][:-1])[: len(name)]
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    order = order[many]
    order = order[np.lexsort((start[order], tag[order], doc[order], name[order]))]
    n, d, t, s = name[order], doc[order], tag[order], start[order]
    head = np.append(True, n[1:] != n[:-1])[: len(n)]
    group = np.cumsum(head) - 1
    first = np.flatnonzero(head)[group] if len(n) else group
    return order, (d != d[first]) | (t != t[first]) | (s != s[first]), order[first]


RUN = ["<u8", "<i8", "<u4", "<u4", "<u4"]  # key, document, checksum, first string, number of strings


def merged_runs(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, count: np.ndarray) -> Columns:
    """Runs of removed strings, joined where they overlap or touch."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start = doc[order], tag[order], start[order].astype(np.int64)
    end = start + count[order].astype(np.int64)
    if not len(doc):
        return [np.zeros(0, k) for k in RUN]
    other = np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))
    # Ends grow over documents when shifted apart, so one running maximum serves all.
    shift = (np.cumsum(other) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    cut = np.flatnonzero(other | np.append(True, (start + shift)[1:] > reach[:-1]))
    last = np.append(cut[1:], len(doc)) - 1
    ends = (reach - shift)[last]
    return [doc_key(doc[cut]), doc[cut], tag[cut], start[cut].astype(np.uint32), (ends - start[cut]).astype(np.uint32)]


SEGMENT = ["<u8", "<i8", "<u4", "<u4", "<u4"]  # anchor, document, checksum, start, number of strings; a number from REPEATED on: a run
REPEATED = np.uint32(1 << 31)
#: What a row of repeats holds, told by its part: runs, places of segments to be fetched, and those of a crowded anchor.
RUNS, ASKED, CROWDED = 0, 1, 2


def segment_records(docs: DataFrame, length: int) -> DataFrame:
    """Packed segments dealt by anchor; of equal ones among some megabytes only the first, the others as runs to be removed."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[Columns]:
        hasher, held, raw, size, bytes_ = Hasher(), [], [], 0, 0

        def reduced() -> Iterator[Columns]:
            anchor, doc, tag, start, count, name, at = (np.concatenate(c) for c in zip(*held))
            order, later, first = later_ones(name, doc, tag, start)
            again, first = order[later], first[later]
            equal = count[again] == count[first]
            again, first = again[equal], first[equal]
            equal = equal_bytes(np.frombuffer(b"".join(raw), np.uint8), at[again], at[first], count[again].astype(np.int64) + length - 1)
            again = again[equal]
            keep = np.ones(len(doc), bool)
            keep[again] = False
            yield [x[keep] for x in (anchor, doc, tag, start, count)]
            key, *run = merged_runs(doc[again], tag[again], start[again], count[again])
            yield [key, run[0], run[1], run[2], run[3] | REPEATED]

        for batch in batches:
            for raws, ids, tags in batches_of(batch):
                text = np.frombuffer(b"".join(raws), np.uint8)
                ends = np.cumsum([len(r) for r in raws])
                hasher.read(text)
                first, count, _, anchor = segments(hasher, text, ends, length)
                anchor = mix(anchor)  # anchors are minima: as they are, nearly all would go to the first few parts
                doc = np.searchsorted(ends, first, side="right")
                whole = hasher.of(first, first + count + length - 1)
                base = ends[doc] - np.diff(np.append(0, ends))[doc]
                held.append([anchor, ids[doc], tags[doc], (first - base).astype(np.uint32), count.astype(np.uint32), mix(anchor + mix(whole)), first + bytes_])
                raw += raws
                size += len(first)
                bytes_ += len(text)
                if size > LOT or bytes_ > LOT_BYTES:
                    yield from reduced()
                    held, raw, size, bytes_ = [], [], 0, 0
        if held:
            yield from reduced()

    return dealt(docs, emit)


def repeats(records: DataFrame) -> DataFrame:
    """Packed rows dealt by document: runs of strings in segments that are known to repeat, and the places of all segments whose anchor another
    segment shares."""
    parts = partitions(records.sparkSession)

    def rows(columns: Columns, kind: int) -> Iterator[pa.RecordBatch]:
        for b in gathered([columns], parts):
            yield b.set_column(0, "part", pa.array(np.asarray(b.column("part")) + kind * parts, pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, doc, tag, start, count = unpack(batches, SEGMENT)
        known = count >= REPEATED
        yield from rows(merged_runs(doc[known], tag[known], start[known], count[known] - REPEATED), RUNS)
        anchor, doc, tag, start = (x[~known] for x in (anchor, doc, tag, start))
        order = np.argsort(anchor)
        group = np.cumsum(np.append(True, anchor[order][1:] != anchor[order][:-1])[: len(anchor)]) - 1
        size = np.bincount(group)[group] if len(group) else group
        for kind, wanted in ((ASKED, (size > 1) & (size <= CROWD)), (CROWDED, size > CROWD)):
            at = order[wanted]
            yield from rows([doc_key(doc[at]), doc[at], tag[at], start[at]], kind)

    return in_parts(records, run, PACKED)


def of_kind(found: DataFrame, kind: int) -> DataFrame:
    parts = partitions(found.sparkSession)
    return found.where((F.col("part") >= kind * parts) & (F.col("part") < (kind + 1) * parts)).withColumn("part", F.col("part") - kind * parts)


def asked_texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """id, text, starts (binary) of the documents that have a segment to be fetched: an exact join; a filter of fixed size keeps others out of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, doc, tag, start = unpack(batches, ["<u8", "<i8", "<u4", "<u4"])
        order = np.lexsort((start, tag, doc))
        doc, tag, start = doc[order], tag[order], start[order]
        at = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))[: len(doc)])
        starts = [np.unique(start[a:b]).tobytes() for a, b in zip(at.tolist(), [*at[1:].tolist(), len(doc)])]
        yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(tag[at].astype(np.int64)), pa.array(starts, pa.binary())], ["key", "tag", "starts"])

    parts = partitions(docs.sparkSession)
    places = stored(asked.repartitionById(parts, F.col("part")).mapInArrow(run, "key long, tag long, starts binary"), "asked_places")
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(places, "key"))
    return tagged(docs, bits, True).join(places.hint("merge"), ["key", "tag"]).select("id", "text", "starts")


def tagged(docs: DataFrame, bits, met: bool) -> DataFrame:
    """The rows whose id the filter holds (or doesn't), with key (the id; a number for null) and tag (the text's checksum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(in_filter(bits.value, np.asarray(b.column("id").fill_null(NO_ID), np.int64)) == met))
            tags = [zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([*b.columns, b.column("id").fill_null(NO_ID), pa.array(tags, pa.int64())], ["id", "text", "key", "tag"])

    return docs.mapInArrow(run, "id long, text string, key long, tag long")


def stretch_width(length: int, stretches: int) -> int:
    return -(-(length - PIECE + 1) // stretches)


def stretch_records(docs: DataFrame, length: int, stretches: int, each: int | None = None) -> DataFrame:
    """Packed stretches of the segments that begin at starts, dealt by their anchor if there is one for each segment, else by the bytes that all
    strings of a stretch hold."""
    offsets, width = length - PIECE + 1, stretch_width(length, stretches)
    span = length + width - 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[Columns]:
        hasher = Hasher()
        for batch in batches:
            wanted, done = batch.column("starts").to_pylist(), 0
            for raws, ids, tags in batches_of(batch):
                text = np.frombuffer(b"".join([*raws, bytes(span)]), np.uint8)
                sizes = np.array([len(r) for r in raws], np.int64)
                ends = np.cumsum(sizes)
                hasher.read(text)
                first, count, anchor, piece = segments(hasher, text[: ends[-1]], ends, length)
                own = [np.frombuffer(x, np.uint32) for x in wanted[done : done + len(raws)]]
                done += len(raws)
                asked = np.concatenate([o + base for o, base in zip(own, (ends - sizes).tolist())]) if own else first[:0]
                held = np.isin(first, asked)
                first, count, anchor, piece = (x[held] for x in (first, count, anchor, piece))
                doc = np.searchsorted(ends, first, side="right")
                base = ends[doc] - sizes[doc]
                for q in range(stretches):
                    least, most = q * width, min(q * width + width, offsets) - 1
                    # Offsets of the anchor in this stretch's strings: least to most; their starts run the other way.
                    low, high = np.maximum(first, anchor - most), np.minimum(first + count - 1, anchor - least)
                    some = low <= high
                    lo, hi, a, d = low[some], high[some], anchor[some], doc[some]
                    core = mix(piece[some] + np.uint64(q))
                    if stretches > 1:
                        core = mix(hasher.of(a - least, a - most + length) + core)
                    data = text[lo[:, None] + np.arange(span)]
                    data = np.where(np.arange(span) < (hi - lo + length)[:, None], data, 0).astype(np.uint8)
                    yield [core, ids[d], tags[d], (lo - base[some]).astype(np.uint32), (hi - lo + 1).astype(np.uint32), (a - lo).astype(np.uint32), np.ascontiguousarray(data).view(f"V{span}").reshape(-1)]

    return dealt(docs, emit, each=each)


def sorted_repeats(stretched: DataFrame, length: int, stretches: int) -> DataFrame:
    """Packed runs of strings that suffix sorting finds equal to an earlier one."""
    span, parts = length + stretch_width(length, stretches) - 1, partitions(stretched.sparkSession)
    kinds = ["<u8", "<i8", "<u4", "<u4", "<u4", "<u4", f"V{span}"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, doc, tag, start, count, ahead, data = unpack(batches, kinds)
        order = np.argsort(core)
        new = np.append(True, core[order][1:] != core[order][:-1])[: len(core)]
        group = np.cumsum(new) - 1
        order = order[np.bincount(group)[group] > 1] if len(group) else order
        # Some hundred thousand strings are sorted at a time; a core's stretches stay together.
        bounds = np.flatnonzero(np.append(True, core[order][1:] != core[order][:-1])[: len(order)])
        sizes = np.add.reduceat(count[order].astype(np.int64), bounds) if len(bounds) else bounds
        lot = np.cumsum(sizes) // 500_000
        cuts = [0, *(bounds[1:][lot[1:] != lot[:-1]]).tolist(), len(order)] if len(bounds) else []
        for a, b in zip(cuts, cuts[1:]):
            part = order[a:b]
            text = np.append(np.ascontiguousarray(data[part]).view(np.uint8), np.zeros(8, np.uint8))
            n = count[part].astype(np.int64)
            which = np.repeat(np.arange(len(part)), n)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            # Equal strings have their anchor at the same offset: only those are sorted among each other.
            owner = np.cumsum(np.append(False, core[part][1:] != core[part][:-1]))[which] * (length + 1) + ahead[part][which] - inside
            turn = np.argsort(owner, kind="stable")
            which, inside = which[turn], inside[turn]
            sorted_, same = deep_shallow_sort(text, which * span + inside, length, group=owner[turn])
            source = part[which[sorted_]]
            at = start[source].astype(np.int64) + inside[sorted_]
            name = np.cumsum(~same).astype(np.uint64)
            held, later, _ = later_ones(name, doc[source], tag[source], at)
            again = held[later]
            yield from gathered([merged_runs(doc[source[again]], tag[source[again]], at[again], np.ones(len(again), np.int64))], parts)

    return in_parts(stretched, run, PACKED)


def removed_spans(runs: DataFrame, length: int) -> DataFrame:
    """id, tag, spans (array of start and end in bytes, merged) of every document that loses something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, doc, tag, start, count = unpack(batches, RUN)
        # A run of strings covers its last string to the end; runs that are closer than that share bytes.
        _, doc, tag, start, count = merged_runs(doc, tag, start, count.astype(np.int64) + length - 1)
        new = np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))[: len(doc)]
        at = np.flatnonzero(new)
        spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int64)), pa.array(start.astype(np.int64) + count)], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(doc)), pa.int32()), spans)
        yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(tag[at].astype(np.int64)), lists], ["id", "tag", "spans"])

    return runs.mapInArrow(run, "id long, tag long, spans array<struct<start: long, end: long>>")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, spans (removed runs of bytes; end exclusive), kept (binary: the remaining bytes) of every row."""
    if length < PIECE + STRETCHES:
        raise ValueError(f"strings of at least {PIECE + STRETCHES} bytes are compared")
    spark = docs.sparkSession
    read = columns(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    found = stored(repeats(segment_records(read, length)), "repeats")
    runs = of_kind(found, RUNS)
    for kind, stretches in ((ASKED, 1), (CROWDED, STRETCHES)):
        asked = of_kind(found, kind)
        if not asked.isEmpty():
            stretched = stretch_records(asked_texts(read, asked), length, stretches, turns(read))
            runs = runs.unionByName(stored(sorted_repeats(stretched, length, stretches), "sorted_repeats"))
    runs = runs.repartitionById(partitions(spark), F.col("part"))
    spans = stored(removed_spans(runs, length), "removed_spans")
    changed = spark.sparkContext.broadcast(key_filter(spans, "id"))
    out = ["id", "n_bytes", "n_removed", "spans", "kept"]
    schema = "id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batch: pa.RecordBatch, all_spans: list) -> pa.RecordBatch:
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts(batch)]
        kept, removed = [], []
        for raw, spans in zip(raws, all_spans):
            edges = [0, *(x for s in spans or () for x in (s["start"], s["end"])), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            removed.append(len(raw) - len(kept[-1]))
        arrays = [batch.column("id"), pa.array(map(len, raws), pa.int64()), pa.array(removed, pa.int64()), pa.array([s or [] for s in all_spans], span_type), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, out)

    def touched(batch: pa.RecordBatch) -> np.ndarray:
        ids = np.asarray(batch.column("id").fill_null(NO_ID), np.int64)
        return in_filter(changed.value, ids)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(~touched(b)))
            yield cut(b, [None] * b.num_rows)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield cut(b, b.column("spans").to_pylist())

    marked = tagged(read, changed, True).join(spans.withColumnRenamed("id", "key").hint("merge"), ["key", "tag"], "left").select("id", "text", "spans")
    return read.mapInArrow(whole, schema).unionByName(marked.mapInArrow(joined, schema)).withColumnRenamed("id", id_col)
