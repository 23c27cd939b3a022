"""Continuous ingestion: tail a log, normalise, fan out to tables per micro-batch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import maintained
from ..operators import normalise as n
from ..sources import redelivery
from ..sources.logs import split_lines
from ..sources.tables import read_table, with_month, write_rows
from ..sources.tail import tail_lines

TARGETS: dict[str, dict[str, Callable[[DataFrame], DataFrame]]] = {
    "cowrie": {
        "honeypot_events": lambda df: n.sensor_events(df, "cowrie"),
        "credentials": n.to_credentials,
        "downloaded_files": n.cowrie_downloads,
    },
    "dionaea": {
        "honeypot_events": lambda df: n.sensor_events(df, "dionaea"),
        "downloaded_files": n.dionaea_downloads,
    },
    "conpot": {"honeypot_events": lambda df: n.sensor_events(df, "conpot")},
    "rtsp": {
        "honeypot_events": lambda df: n.sensor_events(df, "rtsp"),
        "rtsp_attacks": lambda df: n.sensor_attacks(df, "rtsp"),
    },
    "upnp": {
        "honeypot_events": lambda df: n.sensor_events(df, "upnp"),
        "upnp_attacks": lambda df: n.sensor_attacks(df, "upnp"),
    },
    "suricata": {"ids_alerts": lambda df: df},
    "zeek_conn": {"network_connections": lambda df: df},
    "zeek_http": {"http_requests": lambda df: df},
    "zeek_dns": {"dns_queries": lambda df: df},
    "zeek_ssh": {"ssh_auth": lambda df: df},
}

NORMALISERS = {
    "cowrie": n.cowrie_normalise,
    "dionaea": n.dionaea_normalise,
    "conpot": n.conpot_normalise,
    "rtsp": n.rtsp_normalise,
    "upnp": n.upnp_normalise,
    "suricata": n.ids_normalise,
    "zeek_conn": n.zeek_conn_normalise,
    "zeek_http": n.zeek_http_normalise,
    # neither has a country
    "zeek_dns": lambda raw, salt, ranges: n.zeek_dns_queries(raw, salt),
    "zeek_ssh": lambda raw, salt, ranges: n.zeek_ssh_auth(raw, salt),
}
REJECTED = "rejected_lines"


def query_id(spark, checkpoint: str) -> str:
    """The id of the streaming query that a checkpoint belongs to: the same after every restart, another one for every other source."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]


def write_batch(kind: str, root: str, salt: str, ranges=None, source: str | Callable[[], str] = "", once_each: bool = False, rollups: bool = False):
    """A ``foreachBatch`` function that writes one batch of lines to all tables of its kind, and what it rejects.

    A batch is known by its kind, its ``source`` (a name, or a function that gives it) and its number. Its folders are replaced when it
    is retried after a lost driver or executor, so no row is doubled; sources never share them. Accepted and rejected
    lines together are the lines read. With ``once_each``, lines that another batch has stored already are left out (redelivered
    lines); with ``rollups``, the batch's states are added to the maintained rollups.
    """
    names: list[str] = []

    def run(batch: DataFrame, batch_id: int) -> None:
        names[:] = names or [source() if callable(source) else source]
        batch = batch.persist()
        label = "-".join([kind, *filter(None, names), f"{batch_id:012d}"])
        found = kept = None
        try:
            good, bad = split_lines(batch, kind)
            rows = NORMALISERS[kind](good, salt, ranges)
            main, project = next(iter(TARGETS[kind].items()))
            if once_each:
                lines = with_month(n.conform(project(rows), main), main).select("line_id", "month", "timestamp")
                fresh, found = redelivery.first_deliveries(lines, main, root, label)
                # kept, or every table below would parse the lines and look them up again
                rows = kept = (rows if found is None else rows.join(fresh.select("line_id"), "line_id", "left_semi")).persist()
            for table, project in TARGETS[kind].items():
                out = with_month(n.conform(project(rows), table), table)
                write_rows(out, table, root, label)
                if rollups:
                    maintained.add_batch(out, table, root, label)
            if once_each:
                redelivery.write_filters(with_month(n.conform(TARGETS[kind][main](rows), main), main), main, root, label)
            writer = bad.withColumn("batch", F.lit(label)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("batch").parquet(f"{root}/{REJECTED}")
        finally:
            for df in (batch, kept, found):
                if df is not None:
                    df.unpersist()

    return run


def ingest(
    spark, kind: str, folder: str, root: str, checkpoint: str, salt: str, ranges=None, pattern: str = "*", once: bool = True,
    every: str = "1 minute", batch_bytes: int | None = None, once_each: bool = False, rollups: bool = False,
    catch_up: int | None = None,
) -> StreamingQuery:
    """Tail the logs of one kind in ``folder`` into their tables.

    Any number of sources of a kind may write to one ``root``, each with its own checkpoint. ``ranges`` is a table of address ranges or a stored
    geo index. ``once`` stops when what was there is read; with ``batch_bytes`` that is one batch of about so many bytes (``drain`` takes them all).
    ``catch_up`` lets a batch be larger, up to such a part of what was read before it.
    """
    run = write_batch(kind, root, salt, ranges, lambda: query_id(spark, checkpoint), once_each, rollups)
    writer = tail_lines(spark, folder, pattern, checkpoint, batch_bytes, catchup=catch_up).writeStream.foreachBatch(run)
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def drain(spark, *args, catch_up: int | None = 16, **options) -> int:
    """``ingest`` batch after batch until nothing is left; the number of batches with rows (of the last hundred at most).

    Every batch costs about the same however small it is, so after the first sixteen (``catch_up``) their size follows what was read:
    ten times the backlog takes some forty batches more. None keeps them all at ``batch_bytes``.
    """
    query = ingest(spark, *args, once=False, every="0 seconds", catch_up=catch_up, **options)
    try:
        query.processAllAvailable()
        return sum(p.numInputRows > 0 for p in query.recentProgress)
    finally:
        query.stop()


def read_ingested(spark, table: str, root: str, lines: bool = False) -> DataFrame:
    return read_table(spark, table, root, lines)


def read_rejected(spark, root: str) -> DataFrame:
    schema = "kind string, file string, offset long, reason string, value string, batch string"
    return spark.read.schema(schema).parquet(f"{root}/{REJECTED}").drop("batch")


def without_repeats(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop redelivered lines of a stream, by ``line_id``; those later than ``delay`` may pass twice.

    Events of one session, second and type stay: they come from different lines.
    """
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["line_id"])


def batch_without_repeats(events: DataFrame) -> DataFrame:
    """The same on a table (``read_table`` with ``lines``), exact: one row of each ``line_id``, the smallest.

    Rows without one were not read from a log and stay.
    """
    rest = [c for c in events.columns if c != "line_id"]
    lined = events.filter(F.col("line_id").isNotNull())
    one = lined.groupBy("line_id").agg(F.min(F.struct(*rest)).alias("r")).select("line_id", "r.*").select(*events.columns)
    return one.unionByName(events.filter(F.col("line_id").isNull()))
