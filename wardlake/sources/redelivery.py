"""Lines that are delivered again: Bloom filters of stored line identities, beside the table.

A line that comes again has the same time, so it can only stand in the hour of that time. Every batch writes, for each hour that it
has rows of, a blocked Bloom filter of their identities. A new batch is tested against the filters of its own hours; only what they
cannot rule out is looked up in the table, and only in the months of those suspects. False positives cost that look and
no row. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TABLES
from .tables import read_batches, read_table, rewrite

#: Bits of a filter for each identity, and bits that an identity sets; a block has eight words of 64 bits.
BITS, HASHES, WORDS = 12, 5, 8
_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("hour", "blocks", "block", *[f"w{k}" for k in range(WORDS)])])


def filters_path(table: str, root: str) -> str:
    return f"{root}/_line_filters/{table}"


def _hour(time: str) -> Column:
    return F.floor(F.unix_timestamp(F.col(time)) / 3600).alias("hour")


def _masks() -> list[Column]:
    """The bits that an identity sets in its block, a column for each word."""
    h = F.xxhash64("line_id", F.lit(1))
    words = [F.shiftrightunsigned(h, 9 * j).bitwiseAND(F.lit(WORDS * 64 - 1)) for j in range(HASHES)]
    masks = []
    for k in range(WORDS):
        out = F.lit(0).cast("long")
        for w in words:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), (w % 64).cast("int"))
            out = out.bitwiseOR(F.when(F.floor(w / 64) == k, bit).otherwise(F.lit(0).cast("long")))
        masks.append(out.alias(f"m{k}"))
    return masks


def line_filters(rows: DataFrame, table: str) -> DataFrame:
    """(month, hour, blocks, block, w0, ...): the filters of the rows' identities."""
    lines = rows.filter(F.col("line_id").isNotNull()).select("month", _hour(TABLES[table].time_col), "line_id")
    sizes = lines.groupBy("hour").agg(F.ceil(F.count("*") * BITS / (WORDS * 64)).alias("blocks"))
    placed = lines.join(sizes, "hour").withColumn("block", F.pmod(F.xxhash64("line_id"), F.col("blocks")))
    return placed.select("month", "hour", "blocks", "block", *_masks()).groupBy("month", "hour", "blocks", "block").agg(
        *[F.bit_or(f"m{k}").alias(f"w{k}") for k in range(WORDS)]
    )


def write_filters(rows: DataFrame, table: str, root: str, batch: str) -> None:
    """Write the filters of one batch of a table; writing the same batch again replaces them."""
    out = line_filters(rows, table).withColumn("batch", F.lit(batch))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(filters_path(table, root))


def suspects(rows: DataFrame, table: str, root: str, batch: str) -> DataFrame:
    """(line_id, month) of rows that filters of other batches than ``batch`` cannot rule out."""
    spark = rows.sparkSession
    filters = read_batches(spark, filters_path(table, root), _SCHEMA).filter(F.col("batch") != batch)
    heads = filters.select("month", "hour", "batch", "blocks").distinct()
    lines = rows.filter(F.col("line_id").isNotNull()).select("month", _hour(TABLES[table].time_col), "line_id").distinct()
    asked = lines.join(heads, ["month", "hour"]).withColumn("block", F.pmod(F.xxhash64("line_id"), F.col("blocks")))
    met = asked.select("*", *_masks()).join(filters, ["month", "hour", "batch", "blocks", "block"])
    every = F.lit(True)
    for k in range(WORDS):
        every = every & (F.col(f"w{k}").bitwiseAND(F.col(f"m{k}")) == F.col(f"m{k}"))
    return met.filter(every).select("line_id", "month").distinct()


def stored_lines(found: DataFrame, table: str, root: str, batch: str) -> DataFrame:
    """The suspects that the table has, from other batches; only their months are read."""
    spark = found.sparkSession
    months = [r.month for r in found.select("month").distinct().collect()]
    schema = T.StructType([T.StructField("line_id", T.StringType())])
    rows = read_batches(spark, f"{root}/{table}", schema).filter(F.col("month").isin(months) & (F.col("batch") != batch))
    return rows.join(found, ["month", "line_id"], "left_semi").select("line_id").distinct()


def first_deliveries(rows: DataFrame, table: str, root: str, batch: str) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` (line_id, month, ...) without those whose line the table has from another batch than ``batch``.

    Also the suspects, which stay cached for the caller to release; None if there are none.
    """
    if not _exists(rows.sparkSession, filters_path(table, root)):
        return rows, None
    found = suspects(rows, table, root, batch).persist()
    if found.isEmpty():
        found.unpersist()
        return rows, None
    return rows.join(stored_lines(found, table, root, batch), "line_id", "left_anti"), found


def compact_filters(spark: SparkSession, table: str, root: str, month: str) -> None:
    """One filter for each hour of a month in place of one for each hour and batch, made from the table."""
    if not _exists(spark, filters_path(table, root)):
        return
    rows = read_table(spark, table, root, lines=True).filter(F.col("month") == month)
    rewrite(spark, filters_path(table, root), _SCHEMA, month, lambda _, batch: write_filters(rows, table, root, batch))


def _exists(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)
