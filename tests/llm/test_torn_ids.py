"""Different texts under one id."""

from pyspark.sql import functions as F


def test_row_falls_by_its_own_component(spark):
    from ledgerloom.llm.ngramjoin import drop_linked

    text = lambda n: " ".join(f"w{n}x{i}" for i in range(60))
    rows = [(1, text(1)), (5, text(1)), (5, text(2)), (6, text(3)), (6, text(3)), (8, text(2)), (9, text(1)), (9, ""), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(tuple(r) for r in drop_linked(docs, ["doc_id", "text"]).collect())
    assert kept == [(1, text(1)), (5, text(2)), (6, text(3)), (9, "")]
    assert drop_linked(docs.where(F.length("text") > 0), ["text", "doc_id"]).count() == 3
