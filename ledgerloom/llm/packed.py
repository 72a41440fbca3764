"""Many small fixed-width records moved as few rows: numpy columns packed by the part that they are dealt to."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

PACKED = "part int, n int, data binary"
#: Records that a task gathers before it packs them: some ten megabytes, several times over while they are packed.
FLUSH = 200_000

Columns = list[np.ndarray]


def pack(columns: Columns, parts: int, key: bool = True) -> pa.RecordBatch:
    """Records dealt by their first column (a spread 64-bit hash), one row for each part; the column itself travels only if key is set."""
    part = ((columns[0] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts <= 1 << 16 else np.int32)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    columns = [c[order] for c in columns[not key :]]
    held = np.flatnonzero(np.diff(bounds))
    data = [b"".join(c[bounds[p] : bounds[p + 1]].tobytes() for c in columns) for p in held]
    return pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(np.diff(bounds)[held], pa.int32()), pa.array(data, pa.binary())], ["part", "n", "data"])


def gathered(made: Iterable[Columns], parts: int, key: bool = True) -> Iterator[pa.RecordBatch]:
    """Packs what comes as lists of columns, some millions of records at a time."""
    held: list[Columns] = []
    size = 0
    for columns in made:
        if len(columns[0]):
            held.append(columns)
            size += len(columns[0])
        if size >= FLUSH:
            yield pack([np.concatenate(c) for c in zip(*held)], parts, key)
            held, size = [], 0
    if held:
        yield pack([np.concatenate(c) for c in zip(*held)], parts, key)


def unpack(batches: Iterable[pa.RecordBatch], kinds: list[str]) -> Columns:
    """All records of a task, as columns of the given numpy types."""
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for batch in batches:
        for n, data in zip(batch.column("n").to_pylist(), batch.column("data")):
            buffer, at = data.as_buffer(), 0
            for column, kind in zip(out, kinds):
                column.append(np.frombuffer(buffer, kind, n, at))
                at += n * np.dtype(kind).itemsize
    return [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(out, kinds)]


#: Bytes of a plan's files for which one part is enough; a task of more works through several, one after another.
PART_BYTES, MOST_TURNS = 32 << 20, 64


def turns(df: DataFrame) -> int:
    """How many parts a task gets, so that one of them fits in its memory: by the size of the files that df reads."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(MOST_TURNS, -(-size // (PART_BYTES * partitions(df.sparkSession)))))


def dealt(df: DataFrame, emit: Callable[[Iterator[pa.RecordBatch]], Iterable[Columns]], key: bool = True, each: int | None = None) -> DataFrame:
    """Runs emit over every partition and deals its records out: a task gets each parts, in order (the engine sorts, and spills, whole rows)."""
    tasks, each = partitions(df.sparkSession), each or turns(df)  # after a join each must be given: the engine takes its size for the product
    rows = df.mapInArrow(lambda batches: gathered(emit(batches), tasks * each, key), PACKED)
    return rows.repartitionById(tasks, F.col("part")) if each == 1 else rows.repartitionById(tasks, (F.col("part") / each).cast("int")).sortWithinPartitions("part")


def by_part(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of a task, one part at a time; all together where none is left of a part (an empty task)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        part = np.asarray(batch.column("part"))
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                if held and held[-1].column("part")[0].as_py() != part[a]:
                    yield held
                    held = []
                held.append(batch.slice(a, b - a))
    yield held


def in_parts(df: DataFrame, run: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Runs run over every part that dealt has given out."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_part(batches):
            yield from run(rows)

    return df.mapInArrow(every, schema)


# A filter of fixed size over 64-bit keys: rows that can't be wanted stay where they are. It never misses a wanted key.
FILTER_BITS, FILTER_PIECES = 1 << 26, 64


def _places(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 26)


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """Bits of all keys (long, or binary with many of them): of fixed size (8 MB), put together in pieces, whatever the number of keys."""
    width = FILTER_BITS // FILTER_PIECES
    many = keys.schema[column].dataType.simpleString() == "binary"

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_buffer(), np.int64) for x in b.column("key"))]) if many else np.asarray(b.column("key"), np.int64)
            at = np.unique(_places(own)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // width, pa.int32()), pa.array(at % width, pa.int32())], ["piece", "bit"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for b in batches:
            piece, bit = np.asarray(b.column("piece")), np.asarray(b.column("bit"))
            for p in np.unique(piece).tolist():
                pieces.setdefault(p, np.zeros(width, bool))[bit[piece == p]] = True
        if pieces:
            yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int32()), pa.array([np.packbits(x).tobytes() for x in pieces.values()])], ["piece", "bits"])

    found = (
        keys.select((F.col(column) if many else F.col(column).cast("long")).alias("key")).where("key is not null").mapInArrow(places, "piece int, bit int").distinct()
        .repartition(min(FILTER_PIECES, partitions(keys.sparkSession)), "piece").mapInArrow(bits, "piece int, bits binary").collect()
    )
    out = np.zeros((FILTER_PIECES, width // 8), np.uint8)
    for r in found:
        out[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _places(keys)
    return (bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
