"""Daily rollups that are kept up to date as rows arrive.

Every batch adds partial states that merge: sums, distinct sketches, and the distinct values themselves as rows. They lie in folders
of month and batch like the tables, so a batch that is retried replaces its own states and nothing is added twice. Reading unites them; compaction
unites a month's batches for good. A distinct count is exact (values are counted) or estimated (sketches are united, which reads one row
for each group and batch).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TABLES
from ..sources.tables import read_batches, rewrite
from .rollups import SETS, day, event_cells


@dataclass(frozen=True)
class Rollup:
    """Counts by day and ``keys``; ``flags`` counts true values of a column, ``distinct`` different ones."""

    table: str
    keys: tuple[str, ...]
    count: str
    distinct: dict[str, str]
    flags: dict[str, str] | None = None
    where: str = "true"

    @property
    def group(self) -> list[str]:
        return ["date", *self.keys]

    @property
    def sums(self) -> list[str]:
        return [self.count, *(self.flags or {})]

    def schema(self) -> T.StructType:
        types = TABLES[self.table].schema
        keys = [T.StructField("date", T.DateType()), *[types[k] for k in self.keys]]
        sums = [T.StructField(c, T.LongType()) for c in self.sums]
        return T.StructType([*keys, *sums, *[T.StructField(f"{c}_sketch", T.BinaryType()) for c in self.distinct]])

    def values_schema(self) -> T.StructType:
        types = TABLES[self.table].schema
        keys = [T.StructField("date", T.DateType()), *[types[k] for k in self.keys]]
        return T.StructType([*keys, T.StructField("what", T.StringType()), T.StructField("value", T.StringType())])


ROLLUPS = {
    "daily_attack_stats": Rollup(
        "honeypot_events", ("honeypot_type", "event_type"), "event_count", {"unique_attackers": "source_ip_hash", "unique_ports": "dest_port"}
    ),
    "top_attacked_services": Rollup("network_connections", ("dest_port", "protocol"), "connection_count", {"unique_sources": "source_ip_hash"}),
    "credential_stats": Rollup(
        "credentials", ("username", "password"), "attempt_count", {"unique_sources": "source_ip_hash"}, {"success_count": "success"}
    ),
    "mitre_attack_stats": Rollup(
        "ids_alerts", ("mitre_tactic", "mitre_technique_id"), "technique_count",
        {"unique_attackers": "source_ip_hash", "unique_targets": "dest_port"}, where="mitre_technique_id <> ''",
    ),
    "geographic_attack_stats": Rollup(
        "honeypot_events", ("source_ip_country", "honeypot_type"), "attack_count",
        {"unique_attackers": "source_ip_hash", "unique_ports_targeted": "dest_port"}, where="source_ip_country <> ''",
    ),
}
PROFILES = "attacker_profiles"
_CELL_KEYS = ["source_ip_hash", "date", "dest_port", "protocol", "source_ip_country", "event_type"]


def _cells() -> T.StructType:
    types = TABLES["honeypot_events"].schema
    keys = [T.StructField(c, T.DateType()) if c == "date" else types[c] for c in _CELL_KEYS]
    return T.StructType([*keys, T.StructField("lo", T.TimestampType()), T.StructField("hi", T.TimestampType()), T.StructField("n", T.LongType())])


def _month(rows: DataFrame) -> DataFrame:
    return rows.withColumn("month", F.date_format("date", "yyyy-MM"))


def partial(rows: DataFrame, r: Rollup) -> tuple[DataFrame, DataFrame]:
    """States of some rows: (keys, sums, sketches), and (keys, what, value), every distinct value once."""
    rows = rows.filter(r.where).select(day(), *r.keys, *(r.flags or {}).values(), *sorted(set(r.distinct.values()) - set(r.keys)))
    flags = [F.count_if(F.col(c)).alias(name) for name, c in (r.flags or {}).items()]
    sketches = [F.hll_sketch_agg(F.col(c).cast("string")).alias(f"{name}_sketch") for name, c in r.distinct.items()]
    sums = rows.groupBy(*r.group).agg(F.count(F.lit(1)).alias(r.count), *flags, *sketches)
    pairs = F.array(*[F.struct(F.lit(name).alias("what"), F.col(c).cast("string").alias("value")) for name, c in r.distinct.items()])
    values = rows.select(*r.group, F.explode(pairs).alias("p")).select(*r.group, "p.what", "p.value").distinct()
    return _month(sums), _month(values)


def united(sums: DataFrame, r: Rollup) -> DataFrame:
    """One state of each group out of several."""
    sketches = [F.hll_union_agg(f"{c}_sketch").alias(f"{c}_sketch") for c in r.distinct]
    return sums.groupBy(*r.group).agg(*[F.sum(c).alias(c) for c in r.sums], *sketches)


def _write(states: DataFrame, path: str, batch: str) -> None:
    writer = states.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("month", "batch").parquet(path)


def _paths(name: str, root: str) -> tuple[str, str]:
    return f"{root}/_rollups/{name}", f"{root}/_rollups/{name}_values"


def add_batch(rows: DataFrame, table: str, root: str, batch: str) -> None:
    """Add the states of one batch of a table's rows to all rollups over it; the same batch again replaces them."""
    for name, r in ROLLUPS.items():
        if r.table == table:
            for states, path in zip(partial(rows, r), _paths(name, root), strict=True):
                _write(states, path, batch)
    if table == "honeypot_events":
        _write(_month(event_cells(rows)), _paths(PROFILES, root)[0], batch)


def read_rollup(spark: SparkSession, name: str, root: str, exact: bool = True) -> DataFrame:
    """A rollup of all that was added: date, keys, sums and distinct counts."""
    r, (path, values_path) = ROLLUPS[name], _paths(name, root)
    sums = united(read_batches(spark, path, r.schema()), r)
    if not exact:
        counts = [F.hll_sketch_estimate(f"{c}_sketch").alias(c) for c in r.distinct]
        return sums.select(*r.group, *r.sums, *counts)
    values = read_batches(spark, values_path, r.values_schema()).select(*r.group, "what", "value").distinct()
    counts = values.groupBy(*r.group).agg(*[F.count_if(F.col("what") == c).alias(c) for c in r.distinct])
    return sums.select(*r.group, *r.sums).join(counts, r.group)


def read_profiles(spark: SparkSession, root: str) -> DataFrame:
    """A source's first and last event, number of events and value sets, of all that was added."""
    cells = read_batches(spark, _paths(PROFILES, root)[0], _cells())
    return cells.groupBy("source_ip_hash").agg(
        F.min("lo").alias("first_seen"), F.max("hi").alias("last_seen"), F.sum("n").alias("total_events"),
        *[F.sort_array(F.collect_set(src)).alias(name) for name, src in SETS.items()],
    )


def compact_rollup(spark: SparkSession, name: str, root: str, month: str) -> None:
    """Unite the states of one month's batches."""
    path, values_path = _paths(name, root)
    if name == PROFILES:
        bounds = (F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
        merged = lambda old, batch: _write(_month(old.groupBy(*_CELL_KEYS).agg(*bounds)), path, batch)
        rewrite(spark, path, _cells(), month, merged)
        return
    r = ROLLUPS[name]
    rewrite(spark, path, r.schema(), month, lambda old, batch: _write(_month(united(old, r)), path, batch))
    distinct = lambda old, batch: _write(_month(old.select(*r.group, "what", "value").distinct()), values_path, batch)
    rewrite(spark, values_path, r.values_schema(), month, distinct)
