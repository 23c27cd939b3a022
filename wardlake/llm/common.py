"""What several operators of this package share: tables, words, shared intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.session import scratch_path

SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def space_words(text: Column) -> Column:
    """Array of the runs of non-space characters; empty for null, empty or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: short lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def offsets(totals: DataFrame) -> DataFrame:
    """(part, before) from (part, n), a row for each partition of a written table: prefix sums of so few rows, made on the driver."""
    rows, start = [], 0
    for row in totals.orderBy("part").collect():
        rows.append((row.part, start))
        start += row.n
    return totals.sparkSession.createDataFrame(rows, "part long, before long")


def number_array(values: list[float]) -> Column:
    """A constant array column of a bounded number of weights, usable inside lambdas (subqueries are not)."""
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values)), ",").cast("array<double>")
