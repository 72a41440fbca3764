"""Extracts: markers, spellings of numbers and times, aliases, strictness and containment."""

import datetime
import hashlib

import pytest
from pyspark.sql import types as T

from ledgerloom.sources.extracts import DataValidationError, contained, inventory, read_extract, read_optional, write_extract

SCHEMA = T.StructType([T.StructField("project", T.StringType()), T.StructField("trades", T.LongType()), T.StructField("volume", T.DoubleType()), T.StructField("seen", T.TimestampType())])


def write(folder, text):
    path = folder / "x.csv"
    path.write_text(text)
    return str(path)


def test_reads_what_exports_write(spark, tmp_path):
    path = write(tmp_path, "project,victim_count,volume,seen,more\na,3.753857e+06,<nil>,2024-01-01 00:03:23.000 UTC,1\n NULL ,7,1.239e-23,nan,2\n")
    rows = read_extract(spark, path, SCHEMA, {"victim_count": "trades"}).collect()
    assert [tuple(r) for r in rows] == [("a", 3753857, None, datetime.datetime(2024, 1, 1, 0, 3, 23)), (None, 7, 1.239e-23, None)]


@pytest.mark.parametrize("bad", ["1.5", "many", "9007199254740993"])
def test_strictness(spark, tmp_path, bad):
    path = write(tmp_path, f"project,trades,volume,seen\na,{bad},1,2024-01-01\n")
    with pytest.raises(Exception, match="trades holds"):
        read_extract(spark, path, SCHEMA).collect()
    assert read_extract(spark, path, SCHEMA, strict=False).first().trades is None


def test_missing_columns_and_files(spark, tmp_path):
    with pytest.raises(DataValidationError, match="trades"):
        read_extract(spark, write(tmp_path, "project,volume,seen\n"), SCHEMA)
    empty = read_optional(spark, str(tmp_path / "none.csv"), SCHEMA)
    assert empty.count() == 0 and empty.schema == SCHEMA


def test_round_trip_and_inventory(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.5, datetime.datetime(2024, 5, 6)), (None, None, None, None)], SCHEMA)
    write_extract(df, str(tmp_path / "out"))
    assert sorted(map(str, read_extract(spark, str(tmp_path / "out"), SCHEMA).collect())) == sorted(map(str, df.collect()))
    path = write(tmp_path, "a,b\n1,2\n")
    found = {r.path.rsplit("/", 1)[1]: r for r in inventory(spark, str(tmp_path)).collect()}
    assert found["x.csv"].header == "a,b" and found["x.csv"].sha256 == hashlib.sha256(open(path, "rb").read()).hexdigest()


def test_containment(tmp_path):
    assert contained(str(tmp_path), "a/b.csv").startswith(str(tmp_path))
    with pytest.raises(DataValidationError):
        contained(str(tmp_path), "../b.csv")
