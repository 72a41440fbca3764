"""Quality classifier by compression: two zstandard dictionaries, built from good and from bad labelled text.

Each whole text is cut into pieces, every piece is compressed with either dictionary, and the difference of the two
total sizes over the larger of them is the text's evidence. A logistic curve, fitted on labelled texts that no
dictionary has seen, turns evidence into a probability. Dictionaries and curve are fitted on the driver from a bounded
sample of labelled rows (sample_rows of each class, the ones with the smallest hash of their id); scoring covers every
row inside its own partition, without a shuffle.

Cases: a null or empty text has evidence 0 and gets the score that the curve gives it; ids with contradicting labels,
null labels and null ids teach nothing; without labels of both classes every score is 0.5; repeated rows are scored
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, texts

PIECE_BYTES, DICTIONARY_BYTES, LEVEL = 512, 64 * 1024, 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


class Evidence:
    """Compares the sizes to which the two dictionaries bring a text."""

    def __init__(self, good: bytes, bad: bytes):
        made = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_FULLDICT if d[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT) for d in (good, bad)]
        self.both = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False) for d in made]

    def of(self, text: str | None) -> float:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0
        good, bad = (sum(len(c.compress(raw[i : i + PIECE_BYTES])) for i in range(0, len(raw), PIECE_BYTES)) for c in self.both)
        return (bad - good) / max(good, bad)


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the text itself serves as one where there is too little to train on."""
    pieces = [s[i : i + PIECE_BYTES] for s in samples for i in range(0, len(s), PIECE_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:] or b"\0" * 8


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic fit by Newton steps, slightly held back so that it always exists."""
    a, b = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    hold = np.diag([1e-7, 1e-7]) * weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a.T * (weight * p * (1 - p))) @ a + hold, a.T @ (weight * (y - p)) - hold @ b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """A model from at most sample_rows labelled texts of each class; None unless both classes occur."""
    known = (
        columns(labels, doc_id=id_col, quality=label_col)
        .where(F.col("quality").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("doc_id is not null and quality = most and pmod(crc32(cast(doc_id as string)), 3) <> 1")
        .select("doc_id", "quality", F.xxhash64("doc_id").alias("turn"))
    )
    total = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        return None
    chosen = [known.where(F.col("quality") == q).orderBy("turn", "doc_id").limit(sample_rows) for q in (0, 1)]
    drawn = (
        columns(docs, doc_id=id_col, text=text_col)
        .join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
        .where("text <> ''")
        .withColumn("text", F.col("text").cast("binary"))
        .orderBy("turn", "doc_id", "text")
        .limit(2 * sample_rows)
        .collect()
    )
    by = {q: [bytes(r["text"]) for r in drawn if r["quality"] == q] for q in (0, 1)}
    if not by[0] or not by[1]:
        return None
    # Every other text builds its class's dictionary; the rest, unseen by them, fit the curve.
    good, bad = (dictionary(by[q][::2]) for q in (1, 0))
    evidence = Evidence(good, bad)
    held = {q: by[q][1::2] or by[q] for q in (0, 1)}
    x = np.array([evidence.of(t.decode("utf-8", "surrogatepass")) for q in (0, 1) for t in held[q]])
    y = np.repeat([0.0, 1.0], [len(held[0]), len(held[1])])
    weight = np.concatenate([np.full(len(held[q]), total[q] / len(held[q])) for q in (0, 1)])
    return Model(good, bad, *logistic(x, y, weight / weight.mean()))


def quality_score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The id (and the columns in keep) with evidence and score, the calibrated probability of good quality."""
    kept = {} if keep is None else {c: c for c in keep if c != id_col}
    chosen = columns(docs, **{id_col: id_col}, **kept, **({} if text_col in kept else {text_col: text_col}))
    out = [id_col, *kept]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = None if model is None else Evidence(model.good, model.bad)
        for batch in batches:
            x = np.array([0.0 if evidence is None else evidence.of(t) for t in texts(batch, text_col)])
            p = np.full(len(x), 0.5) if model is None else 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -700, 700)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(x, pa.float64()), pa.array(p, pa.float64())], [*out, "evidence", "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in out)
    return chosen.mapInArrow(score, f"{schema}, evidence double, score double")
