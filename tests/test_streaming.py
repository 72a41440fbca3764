"""The streamed daily series against the batch product."""

from pyspark.sql import functions as F

from ledgerloom.operators.joins import many_to_one, missing_keys, same_keys
from ledgerloom.sources.tables import relation
from ledgerloom.streaming.daily import daily_activity, marked


def drain(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    legs = relation(spark, sf_dir, "attackers", ["block_time", "amount_usd", "taker"]).cache()
    legs.orderBy("block_time").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(legs.schema).parquet(str(tmp_path / "in"))
    drain(daily_activity(stream), "days", "complete")
    got = {r.date: tuple(r)[1:4] for r in spark.table("days").collect()}
    batch = legs.groupBy(F.to_date("block_time").alias("d")).agg(F.count(F.lit(1)), F.count("amount_usd"), F.round(F.sum("amount_usd"), 2))
    assert got == {r.d: tuple(r)[1:] for r in batch.collect()}
    known = legs.where("taker <= 3").select("taker")
    drain(marked(stream, known, ["taker"]), "flags", "append")
    flags = spark.table("flags").groupBy("is_known").count().collect()
    assert {r.is_known: r["count"] for r in flags} == {True: legs.where("taker <= 3").count(), False: legs.where("taker > 3").count()}


def test_validated_joins(spark):
    import pytest

    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (3, 30)], "k int, w int")
    assert sorted(map(tuple, many_to_one(left, right, ["k"]).collect()), key=str) == [(1, "a", 10), (1, "b", 10), (2, "c", None)]
    with pytest.raises(Exception, match="repeated key"):
        many_to_one(right, left, ["k"]).collect()
    assert [r.k for r in missing_keys(left, right, ["k"]).collect()] == [2]
    assert not same_keys(left, right, ["k"]) and same_keys(left, left.limit(3), ["k"])
