"""Table sinks and upkeep: append, fan-out, export, import, evolution, retention, order."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timing import as_datetime, since, stamp
from ..operators.normalise import conform
from ..schemas import TABLES

# Tables exported for the last days; profiles go out whole.
EXPORTED = ("honeypot_events", "ids_alerts", "network_connections", "http_requests", "downloaded_files", "credentials")


def with_month(df: DataFrame, table: str) -> DataFrame:
    return df.withColumn("month", F.date_format(TABLES[table].time_col, "yyyy-MM"))


def append_table(df: DataFrame, table: str, root: str, files_per_month: int | None = None) -> str:
    """Append conformed rows below ``root/table``: a folder for each month, in it one for each append or batch.

    Rows are sorted by month and the table's sort key inside each task, so a task
    keeps one file open and row groups carry tight statistics. Tasks stay as they are,
    because a month is far too coarse to shuffle by: a backfill of one month
    would end in one task. ``files_per_month`` compacts instead, by range.
    """
    t = TABLES[table]
    rows = with_month(conform(df, table), table)
    if files_per_month:
        rows = rows.repartitionByRange(files_per_month, "month", *t.sort)
    return write_rows(rows, table, root, f"append-{uuid.uuid4().hex}")


def write_rows(rows: DataFrame, table: str, root: str, batch: str) -> str:
    """Write rows with their month as the folders of ``batch``; writing the same batch again replaces them."""
    path = f"{root}/{table}"
    rows = rows.withColumn("batch", F.lit(batch)).sortWithinPartitions("month", *TABLES[table].sort)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch")
    for col in ("source_ip_hash", "md5_hash", "sha256_hash", "line_id"):
        if col in rows.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{col}", "true")
    writer.parquet(path)
    return path


def read_table(spark: SparkSession, table: str, root: str, lines: bool = False) -> DataFrame:
    """The table with its ``month``, whoever wrote it: appends, imports and ingested batches share one layout.

    ``lines`` adds ``line_id``, the identity of the log line that a row came from; null where rows were not read from a log.
    """
    return read_batches(spark, f"{root}/{table}", _stored_schema(table)).drop("batch", *([] if lines else ["line_id"]))


def _stored_schema(table: str) -> T.StructType:
    return T.StructType([*TABLES[table].schema.fields, T.StructField("line_id", T.StringType())])


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows below ``path`` with ``month`` and ``batch``, without batches that a rewrite has replaced or not finished."""
    folders = [T.StructField("month", T.StringType()), T.StructField("batch", T.StringType())]
    rows = spark.read.schema(T.StructType([*schema.fields, *folders])).parquet(path)
    finished = _replacements(spark, path)
    rows = rows.filter(~F.col("batch").startswith(REWRITTEN) | F.col("batch").isin(sorted(finished)))
    gone = {}
    for names in finished.values():
        for name in names:
            month, batch = name.split("/")
            gone.setdefault(month, []).append(batch)
    for month, batches in sorted(gone.items()):
        rows = rows.filter((F.col("month") != month) | ~F.col("batch").isin(batches))
    return rows


def route(df: DataFrame, targets: dict[str, Column]) -> dict[str, DataFrame]:
    """One input, several outputs: a filtered view per target. Rows may go to several."""
    return {name: df.filter(cond) for name, cond in targets.items()}


def append_routed(df: DataFrame, targets: dict[str, Callable[[DataFrame], DataFrame]], root: str) -> None:
    """Write every target's projection of one batch; the batch is read once."""
    kept = df.persist()
    try:
        for table, project in targets.items():
            append_table(project(kept), table, root)
    finally:
        kept.unpersist()


def export_window(df: DataFrame, as_of, path: str | None = None, days: int = 7, col: str = "timestamp") -> DataFrame:
    """Rows of the last ``days``; written to ``path`` as Parquet when given."""
    rows = since(df, as_of, days=days, col=col)
    if path:
        rows.write.mode("overwrite").parquet(path)
    return rows


def export_tables(tables: dict, as_of, folder: str, days: int = 7) -> dict:
    """Export the event tables' last days and the profiles in full."""
    written = {}
    for name, df in tables.items():
        path = f"{folder}/{name}"
        if name in EXPORTED:
            export_window(df, as_of, path, days)
        else:
            df.write.mode("overwrite").parquet(path)
        written[name] = path
    return written


def import_table(spark: SparkSession, path: str, table: str, root: str) -> DataFrame:
    """Append an export to its table and return the table."""
    append_table(spark.read.parquet(path), table, root)
    return read_table(spark, table, root)


def evolve(df: DataFrame, target_ddl: dict, defaults: dict | None = None) -> DataFrame:
    """Add columns that are absent, with a default; present ones keep their values.

    ``target_ddl`` maps a column to its type.
    """
    defaults = defaults or {}
    out = df
    for name, dtype in target_ddl.items():
        value = F.lit(defaults.get(name, "" if dtype == "string" else 0)).cast(dtype)
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return out


# Columns that later versions added, by table.
LATER_COLUMNS = {
    "ids_alerts": {"source_ip_country": "string", "mitre_technique_id": "string", "mitre_tactic": "string"},
    "network_connections": {"source_ip_country": "string"},
    "http_requests": {"source_ip_country": "string"},
}


def apply_ttl(df: DataFrame, as_of, days: int, col: str = "timestamp") -> DataFrame:
    """Rows still within retention; on a table with months, older folders are not read."""
    limit = as_datetime(as_of) - timedelta(days=days)
    out = df.filter(F.col(col) > stamp(limit))
    if "month" in df.columns:
        out = out.filter(F.col("month") >= limit.strftime("%Y-%m"))
    return out


def expired_months(spark: SparkSession, table: str, root: str, as_of) -> DataFrame:
    """Months of a stored table that lie wholly outside its retention, by the names of its folders."""
    limit = as_datetime(as_of) - timedelta(days=TABLES[table].ttl_days)
    months = [name.removeprefix("month=") for name in _folders(spark, f"{root}/{table}") if name.startswith("month=")]
    gone = [(m,) for m in months if m < limit.strftime("%Y-%m")]
    return spark.createDataFrame(gone, "month string")


def expire(spark: SparkSession, table: str, root: str, as_of) -> list[str]:
    """Drop the folders of expired months, and the expired days of the month in which retention ends, which is rewritten."""
    months = sorted(r.month for r in expired_months(spark, table, root, as_of).collect())
    for month in months:
        _delete(spark, f"{root}/{table}/month={month}")
    limit, t = as_datetime(as_of) - timedelta(days=TABLES[table].ttl_days), TABLES[table]
    month = limit.strftime("%Y-%m")
    if f"month={month}" in _folders(spark, f"{root}/{table}"):
        rows = read_table(spark, table, root).filter(F.col("month") == month)
        if not rows.filter(F.col(t.time_col) <= stamp(limit)).isEmpty():
            kept = lambda old, batch: write_rows(old.filter(F.col(t.time_col) > stamp(limit)), table, root, batch)
            rewrite(spark, f"{root}/{table}", _stored_schema(table), month, kept)
    return months


def compact(spark: SparkSession, table: str, root: str, month: str, files: int = 1) -> None:
    """Rewrite one month's many small batches as ``files`` ranges in the table's sort order."""
    ordered = lambda old, batch: write_rows(old.repartitionByRange(files, *TABLES[table].sort), table, root, batch)
    rewrite(spark, f"{root}/{table}", _stored_schema(table), month, ordered)


REWRITTEN = "compact-"
_LISTS = "_replaced"


def rewrite(spark: SparkSession, path: str, schema: T.StructType, month: str, write: Callable[[DataFrame, str], object]) -> None:
    """Replace a month's batches by the one that ``write`` makes of their rows; it gets the rows and the new batch's name.

    Readers see the old batches until a small file, put in place by one rename, names what the new one replaces; from then on they see
    the new one alone. Batches that come while this runs stay as they are. The old folders are deleted last; a lost driver leaves
    either state, and the next rewrite takes up what is left. A batch that is retried after it was replaced is a new batch.
    """
    finished = _replacements(spark, path)
    hidden = {name for names in finished.values() for name in names}
    here = [name.removeprefix("batch=") for name in _folders(spark, f"{path}/month={month}")]
    old = [b for b in here if f"{month}/{b}" not in hidden and (not b.startswith(REWRITTEN) or b in finished)]
    batch = f"{REWRITTEN}{uuid.uuid4().hex}"
    rows = read_batches(spark, path, schema).filter((F.col("month") == month) & F.col("batch").isin(old)).drop("batch")
    write(rows, batch)
    _put(spark, f"{path}/{_LISTS}/{batch}", "\n".join(f"{month}/{b}" for b in old))
    for b in here:
        _delete(spark, f"{path}/month={month}/batch={b}")
        if b in finished:  # a rewritten batch holds rows of one month only
            _delete(spark, f"{path}/{_LISTS}/{b}")
    _put(spark, f"{path}/{_LISTS}/{batch}", "")


def _replacements(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Of each finished rewrite the batches (month/batch) that it replaces and that may not be deleted yet."""
    folder, store = _path(spark, f"{path}/{_LISTS}")
    if not store.exists(folder):
        return {}
    names = [(s.getPath().getName(), s.getLen()) for s in store.listStatus(folder)]
    texts = {name: _get(spark, f"{path}/{_LISTS}/{name}") if size else "" for name, size in names if name.startswith(REWRITTEN)}
    return {name: text.split("\n") if text else [] for name, text in texts.items()}


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file whose content is there as a whole or not at all."""
    target, store = _path(spark, path)
    folder, name = path.rsplit("/", 1)
    draft, _ = _path(spark, f"{folder}/.{name}")
    out = store.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    store.delete(target, False)
    store.rename(draft, target)


def _get(spark: SparkSession, path: str) -> str:
    file, store = _path(spark, path)
    stream = store.open(file)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def _folders(spark: SparkSession, path: str) -> list[str]:
    jpath, store = _path(spark, path)
    return [s.getPath().getName() for s in store.listStatus(jpath) if s.isDirectory()] if store.exists(jpath) else []


def _delete(spark: SparkSession, path: str) -> None:
    jpath, store = _path(spark, path)
    store.delete(jpath, True)


def cluster_by(df: DataFrame, cols: list, partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by other columns than the table's own order.

    The table's time column follows as a tie-breaker, so one frequent value still
    spreads over several ranges.
    """
    keys = [*cols, *(["timestamp"] if "timestamp" in df.columns and "timestamp" not in cols else [])]
    spread = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return spread.sortWithinPartitions(*keys)


#: Rows that the bounds of a curve's steps are taken from, and bits of a step's number.
CURVE_SAMPLE, CURVE_BITS = 20_000, 6


def curve_steps(df: DataFrame, cols: list, bits: int = CURVE_BITS, sample: int = CURVE_SAMPLE) -> list[Column]:
    """For each column the number of a row's step among 2 ** bits steps in the column's own order, so that a range of steps is a range of the column.

    The bounds of the steps come from a bounded sample, which reaches the driver. A row finds its step by halving: ``bits`` comparisons.
    """
    picked = df.select(*cols).orderBy(F.xxhash64(*cols)).limit(sample).collect()
    numbers = []
    for c in cols:
        values = sorted({r[c] for r in picked if r[c] is not None})
        steps = min(1 << bits, len(values))
        bounds = [values[len(values) * k // steps] for k in range(1, steps)] if steps else []
        # few values are spread over all numbers, so that the first bits part them evenly
        places = [(k << bits) // max(1, steps) for k in range(len(bounds) + 1)]
        numbers.append(F.when(F.col(c).isNull(), 0).otherwise(_halved(c, bounds, places)).cast("long"))
    return numbers


def _halved(c: str, bounds: list, places: list) -> Column:
    """The place that belongs to the number of ``bounds`` up to the value of a column."""
    if not bounds:
        return F.lit(places[0])
    half = len(bounds) // 2
    above = _halved(c, bounds[half + 1 :], places[half + 1 :])
    return F.when(F.lit(bounds[half]) <= F.col(c), above).otherwise(_halved(c, bounds[:half], places[: half + 1]))


def curve(numbers: list, bits: int = CURVE_BITS) -> tuple[Column, Column]:
    """A place on a space-filling curve over several columns of step numbers: rows near to each other in any of them tend to be near on it.

    The steps' bits are interleaved (the first result, to be stored as column ``_bits``) and put in the order of the Gray code, in which neighbours
    differ in one bit (the second one): a file that reaches over the border of two cells is wider in one column only.
    """
    mixed = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for n in numbers:
            mixed = mixed * 2 + F.shiftright(n, bit).bitwiseAND(F.lit(1))
    out = F.col("_bits")
    for shift in (1, 2, 4, 8, 16, 32):
        out = out.bitwiseXOR(F.shiftright(out, shift))
    return mixed, out


def cluster_by_curve(df: DataFrame, cols: list, partitions: int | None = None) -> DataFrame:
    """Rows by ranges of a curve over ``cols``: a filter on any one of them skips most files and row groups."""
    steps = [f"_step{k}" for k in range(len(cols))]
    mixed, place = curve(steps)
    # through generators: each part is computed once, not wherever the next one or the order mentions it
    rows = df.select("*", F.inline(F.array(F.struct(*[n.alias(s) for n, s in zip(curve_steps(df, cols), steps, strict=True)]))))
    rows = rows.select(*df.columns, F.explode(F.array(mixed)).alias("_bits"))
    rows = rows.select(*df.columns, F.explode(F.array(place)).alias("_curve"))
    spread = rows.repartitionByRange(partitions, "_curve", *cols) if partitions else rows.repartitionByRange("_curve", *cols)
    return spread.sortWithinPartitions("_curve", *cols).drop("_curve")


def compact_by_curve(spark: SparkSession, table: str, root: str, month: str, cols: list, files: int) -> None:
    """As ``compact``, in the order of a curve over several columns."""

    def write(rows: DataFrame, batch: str) -> None:
        out = cluster_by_curve(rows, cols, files).withColumn("batch", F.lit(batch))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(f"{root}/{table}")

    rewrite(spark, f"{root}/{table}", _stored_schema(table), month, write)
