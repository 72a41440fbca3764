"""Helpers shared by the text operators: column selection, Arrow batches, shared folders."""

from __future__ import annotations

import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
SPACED_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b" \t\n\x0b\x0c\r" else b for b in range(256))


#: Rows of an Arrow batch: they hold whole texts, some of them very long.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def columns(df: DataFrame, **kept: str) -> DataFrame:
    """Only the named columns, under the given names. Anything else in the input, whatever its name, is left behind."""
    if df.sparkSession.conf.get(BATCH_ROWS) == "10000":  # as Spark has it; a setting of the user's own stays
        df.sparkSession.conf.set(BATCH_ROWS, "1000")
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in kept.items()])


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of letters, digits and everything outside ASCII, as UTF-8 bytes."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def spaced_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, as UTF-8 bytes."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(SPACED_BYTES).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, one is set if all run on one machine; a cluster has to name it."""
    name = spark.conf.get("spark.checkpoint.dir", None)
    if not name:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not kept.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        name = kept.get() if kept.isDefined() else f"/tmp/checkpoints/{uuid.uuid4().hex}"
        if not kept.isDefined():
            spark.sparkContext.setCheckpointDir(name)
    return name


def stored(df: DataFrame, label: str = "step") -> DataFrame:
    """df written once as Parquet in the shared folder and read back: cuts lineage and survives lost executors. What was shuffled
    for it is deleted at once; the session's own setting holds again afterwards."""
    path = os.path.join(shared_dir(df.sparkSession), f"{re.sub(r'[^a-z0-9_]', '_', label)}-{uuid.uuid4().hex}")
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(name).to_pylist()
