"""Log sources: one reader per log kind, batch or tailed.

Schemas are always given, so no pass over the data is spent on inferring them and
a stream can start on an empty folder. The line as it was read is kept in
``raw_data``. For a tailed source Spark's checkpoint plays the part of a saved file
offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timing import parse_ts
from ..schemas import RAW, ZEEK_CONN_TSV
from .tail import read_lines

SENSOR_LOGS = ("cowrie", "dionaea", "conpot", "rtsp", "upnp", "suricata")
NETWORK_LOGS = ("conn", "http", "dns", "ssh")


def raw_schema(kind: str) -> T.StructType:
    return T.StructType.fromDDL(RAW[kind])


def _text(spark: SparkSession, path: str, stream: bool, files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    if stream and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def parse_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """JSON lines -> fields plus ``raw_data``; empty and unreadable lines are dropped. ``read_log`` gives these too, with a reason."""
    # a generator keeps the parse in one place; a filter above a projection would repeat it
    record = F.from_json("value", schema, {"mode": "PERMISSIVE", "allowNumericLeadingZeros": "true"})
    parsed = lines.filter(F.trim("value") != "").select(F.inline(F.array(record)), F.col("value").alias("raw_data"))
    known = F.coalesce(*[F.col(f"`{f.name}`").cast("string") for f in schema.fields if _simple(f)])
    return parsed.filter(known.isNotNull())


def split_lines(lines: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Lines (file, offset, value) of one log -> rows as ``parse_lines`` gives them, and the rejected lines with a reason.

    ``empty``, ``unreadable`` (no JSON, or none of the kind's fields), ``time`` (unreadable time: no query and no
    retention would ever see the row). Every line is in exactly one of the two.
    """
    schema = raw_schema(kind)
    record = F.from_json("value", schema, {"mode": "PERMISSIVE", "allowNumericLeadingZeros": "true"})
    parsed = lines.select("file", "offset", "value", F.inline(F.array(record)))
    known = F.coalesce(*[F.col(f"`{f.name}`").cast("string") for f in schema.fields if _simple(f)])
    time = parse_ts("ts" if kind.startswith("zeek_") else "timestamp")
    reason = F.when(F.trim("value") == "", "empty").when(known.isNull(), "unreadable").when(time.isNull(), "time")
    parsed = parsed.withColumn("_reason", reason)
    good = parsed.filter(F.col("_reason").isNull()).withColumns({"raw_data": F.col("value"), "line_id": line_id("file", F.col("offset"), "value")})
    good = good.drop("file", "offset", "value", "_reason")
    bad = parsed.filter(F.col("_reason").isNotNull()).select(F.lit(kind).alias("kind"), "file", "offset", F.col("_reason").alias("reason"), "value")
    return good, bad


def read_log(spark: SparkSession, folder: str, kind: str, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """A folder's logs as a table: their rows with ``line_id``, and the rejected lines; together all lines of the files."""
    return split_lines(read_lines(spark, folder, pattern), kind)


def line_id(file, offset, value):
    """Identity of a log line: equal only for a line that is delivered again, not for a line like it."""
    return F.sha2(F.concat_ws("|", file, offset.cast("string"), value), 256)


def _simple(field: T.StructField) -> bool:
    return not isinstance(field.dataType, (T.StructType, T.MapType, T.ArrayType))


def read_json_log(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType,
    stream: bool = False,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """JSON-lines log; ``schema`` is a log kind or an explicit schema."""
    wanted = raw_schema(schema) if isinstance(schema, str) else schema
    return parse_lines(_text(spark, path, stream, files_per_trigger), wanted)


def read_zeek_tsv(spark: SparkSession, path: str, files: str = "*.log") -> DataFrame:
    """Tab-separated connection log: no comment lines, '-' unset, compressed files skipped.

    ``files`` is the name pattern of plain logs. Fields are read as text; numbers are
    cast where the rows are normalised.
    """
    schema = T.StructType([T.StructField(name, T.StringType()) for name in ZEEK_CONN_TSV])
    return (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("comment", "#")
        .option("nullValue", "-")
        .option("quote", "")
        .option("pathGlobFilter", files)
        .csv(path)
    )


def read_zeek_json(spark: SparkSession, folder: str, kind: str, stream: bool = False) -> DataFrame:
    """One of the network logs (conn, http, dns, ssh), tagged with its type."""
    if kind not in NETWORK_LOGS:
        raise ValueError(f"kind must be one of {NETWORK_LOGS}")
    rows = read_json_log(spark, f"{folder}/{kind}.log", f"zeek_{kind}", stream)
    return rows.withColumn("type", F.lit(f"zeek_{kind}"))
