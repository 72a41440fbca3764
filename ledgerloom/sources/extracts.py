"""Aggregate extracts as CSV: everything is read as text, then named, cleaned and cast by one projection that loses nothing silently."""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How extracts spell a missing value (trimmed, lower case).
MISSING = ("", "<nil>", "null", "nan", "none", "na", "n/a")
#: Whole numbers beyond this lose digits in a double.
LARGEST = 2**53 - 1


class DataValidationError(ValueError):
    """The data is at fault; other errors are the program's."""


def cleaned(column: str) -> Column:
    text = F.trim(F.col(f"`{column}`"))
    return F.when(~F.lower(text).isin(*MISSING), text)


def typed(text: Column, kind: T.DataType) -> Column:
    """A value of the kind, NULL if it can't be read: counts may come as 3.7e+06, times may end in UTC."""
    if isinstance(kind, (T.LongType, T.IntegerType)):
        number = text.try_cast("double")
        return F.when((F.floor(number) == number) & (F.abs(number) <= LARGEST), number.cast(kind))
    if isinstance(kind, T.TimestampType):
        return F.regexp_replace(text, r"\s*UTC$", "").try_cast("timestamp")
    return text.try_cast(kind)


def read_extract(spark: SparkSession, path: str, schema: T.StructType, aliases: dict[str, str] | None = None, strict: bool = True) -> DataFrame:
    """A CSV file or folder in the given schema. aliases: older column names to those of the schema. strict: a value that is there but
    can't be read raises as the row is met; otherwise it becomes NULL. A column that is missing raises at once."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=False)
    known = {(aliases or {}).get(c, c): c for c in raw.columns}
    if missing := [f.name for f in schema if f.name not in known]:
        raise DataValidationError(f"{path} lacks {missing}")
    out = []
    for f in schema:
        text = cleaned(known[f.name])
        value = typed(text, f.dataType)
        if strict:
            lost = text.isNotNull() & value.isNull()
            value = F.when(lost, F.raise_error(F.concat(F.lit(f"{f.name} holds "), text)).cast(f.dataType)).otherwise(value)
        out.append(value.alias(f.name))
    return raw.select(*out)


def read_optional(spark: SparkSession, path: str, schema: T.StructType, aliases: dict[str, str] | None = None) -> DataFrame:
    """As read_extract; an empty table where there is no such file."""
    try:
        return read_extract(spark, path, schema, aliases)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def write_extract(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers. It is written beside the path and takes its place when it is whole; until then the old one stays."""
    spark, beside = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.option("header", True).csv(beside)
    jvm = spark._jvm.org.apache.hadoop.fs
    new, target, old = (jvm.Path(x) for x in (beside, path, f"{beside}.old"))
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    held = fs.exists(target)
    if held and not fs.rename(target, old):
        fs.delete(new, True)
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(new, target):
        if held:
            fs.rename(old, target)
        raise OSError(f"{path} can't be replaced")
    if held:
        fs.delete(old, True)


def columns_of(spark: SparkSession, path: str) -> list[str]:
    """The column names of an extract; its rows aren't read."""
    return spark.read.csv(path, header=True, inferSchema=False).columns


def inventory(spark: SparkSession, folder: str, pattern: str = "*.csv", roles: dict[str, str] | None = None) -> DataFrame:
    """path, bytes, sha256, header, n_rows and role of every file below a folder (role: of the first key of roles that the name contains, else
    'other'). Files are extracts: each is read whole by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    text, role = F.decode("content", "UTF-8"), F.lit("other")
    for key, label in reversed((roles or {}).items()):
        role = F.when(F.substring_index("path", "/", -1).contains(key), label).otherwise(role)
    rows = F.greatest(F.lit(0), F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")) - 1)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.substring_index(text, "\n", 1).alias("header"), rows.alias("n_rows"), role.alias("role"))


def contained(root: str, path: str) -> str:
    """The absolute path, which must lie below root after links are followed."""
    real, top = os.path.realpath(os.path.join(root, path)), os.path.realpath(root)
    if os.path.commonpath([real, top]) != top:
        raise DataValidationError(f"{path} leaves {root}")
    return real
