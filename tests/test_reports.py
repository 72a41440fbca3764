"""Windows, staging, tables for print, reports, manifests, steps and acceptance."""

import json

import pytest

from ledgerloom.sources.extracts import DataValidationError, columns_of, read_extract, write_extract
from ledgerloom.sources.reports import accepted, latex_table, manifest, markdown_report, only_file, run_steps, staged, window_of, windows


def test_windows_and_files(tmp_path):
    for name in ("revised-24m", "revised-30m", "other", "empty-12m"):
        (tmp_path / name).mkdir()
        if name != "empty-12m":
            (tmp_path / name / "a.csv").write_text("x\n1\n")
    assert set(windows(str(tmp_path))) == {"24m", "30m"} and window_of(str(tmp_path / "revised-24m" / "a.csv")) == "24m" and window_of("a/b") is None
    (tmp_path / "legacy-24m").mkdir()
    (tmp_path / "legacy-24m" / "b1.csv").write_text("y\n")
    (tmp_path / "legacy-24m" / "b2.csv").write_text("y\n")
    with pytest.raises(DataValidationError, match="24m"):
        windows(str(tmp_path))
    folder = str(tmp_path / "legacy-24m")
    with pytest.raises(DataValidationError, match="ambiguous"):
        only_file(folder, "b*.csv")
    assert only_file(folder, "c*.csv", "b1*.csv").endswith("b1.csv")
    with pytest.raises(DataValidationError, match="none"):
        only_file(folder, "z*")
    copy = staged(f"{folder}/b1.csv", str(tmp_path / "data"), "in/b.csv")
    assert open(copy).read() == "y\n"
    with pytest.raises(DataValidationError):
        staged(f"{folder}/b1.csv", str(tmp_path / "data"), "../b.csv")


def test_tables_reports_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 1234, 5.678, True), (None, None, None, None)], "name string, n long, x double, ok boolean")
    latex_table(df, str(tmp_path / "t.tex"), "50% of it", "tab:t")
    text = (tmp_path / "t.tex").read_text()
    assert r"a\_b & 1,234 & 5.68 & yes \\" in text and r"50\% of it" in text and "--- & --- & --- & ---" in text
    assert columns_of(spark, str(tmp_path / "t.csv")) == df.columns
    markdown_report(str(tmp_path / "r.md"), "# {{title}}\n\n{{rows}}\n", {"rows": df}, {"title": "Report"})
    assert "| a_b | 1,234 | 5.68 | yes |" in (tmp_path / "r.md").read_text()
    with pytest.raises(DataValidationError, match="missing"):
        markdown_report(str(tmp_path / "r.md"), "{{missing}}", {}, {})
    whole = manifest(spark, str(tmp_path), str(tmp_path / "m.json"), window="24m")
    assert json.loads((tmp_path / "m.json").read_text())["window"] == "24m" and whole["n_files"] == 1 and whole["files"][0]["n_rows"] == 2


def test_writing_keeps_the_old_table_until_the_new_is_whole(spark, tmp_path):
    from pyspark.sql import functions as F

    path, schema = str(tmp_path / "out"), spark.createDataFrame([], "a long").schema
    write_extract(spark.range(3).toDF("a"), path)
    with pytest.raises(Exception, match="broken"):
        write_extract(spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).cast("long").alias("a")), path)
    assert read_extract(spark, path, schema).count() == 3
    write_extract(spark.range(5).toDF("a"), path)
    assert read_extract(spark, path, schema).count() == 5


def test_steps_and_acceptance(tmp_path):
    def bad():
        raise DataValidationError("no rows")

    record = run_steps([("a", lambda: 1, ()), ("b", bad, ("a",)), ("c", lambda: 1, ("b",)), ("d", lambda: 1 / 0, ()), ("e", lambda: 1, ("a",))])
    assert [r["status"] for r in record] == ["done", "invalid data", "skipped", "failed", "done"]
    (tmp_path / "x.md").write_text("it holds")
    rows = accepted([("sum", True), ("other", False)], [str(tmp_path / "x.md"), str(tmp_path / "y")], {str(tmp_path / "x.md"): ["holds", "fails"]})
    assert [r["status"] for r in rows] == ["PASS", "FAIL", "PASS", "FAIL", "PASS", "FAIL"]


def test_missing_tier_is_an_error(spark):
    from ledgerloom.plans.audits import selected

    rows = spark.createDataFrame([("a", 1)], "tier string, n long")
    assert selected(rows, "tier", ["a"]).first().position == 0
    with pytest.raises(Exception, match="no row of tier b"):
        selected(rows, "tier", ["b", "a"]).collect()
