"""Joins on time distance."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timing import as_datetime, between, epoch, since


def _bucket(sec: Column, width: int) -> Column:
    return F.floor(sec / width).cast("long")


def _probes(sec: Column, width: int) -> Column:
    b = _bucket(sec, width)
    return F.explode(F.array(b - 1, b, b + 1))


def near_join(left: DataFrame, right: DataFrame, key: str, seconds: int, lt: str, rt: str) -> DataFrame:
    """Pairs with equal ``key`` and at most ``seconds`` between ``lt`` and ``rt``.

    The join key is (key, time bucket as wide as the distance); the right side
    visits its own bucket and both neighbours. A hot key is thereby cut along
    time, and AQE can split what is left of it.
    """
    width = max(seconds, 1)
    lhs = left.withColumns({"_ls": epoch(lt), "_b": _bucket(epoch(lt), width)})
    rhs = right.withColumns({"_rs": epoch(rt), "_b": _probes(epoch(rt), width)})
    return lhs.join(rhs, [key, "_b"]).filter(F.abs(F.col("_ls") - F.col("_rs")) <= seconds).drop("_b", "_ls", "_rs")


def near_exists(left: DataFrame, right: DataFrame, key: str, seconds: int, lt: str, rt: str) -> DataFrame:
    """Rows of ``left`` with any ``right`` row of the same key within ``seconds``.

    The right side is reduced to its distinct seconds first: at most ``seconds``
    rows per bucket, whatever the key's volume, and no pair is ever built.
    """
    width = max(seconds, 1)
    marks = right.select(key, epoch(rt).alias("_rs")).distinct()
    marks = marks.withColumn("_b", _probes(F.col("_rs"), width)).withColumnRenamed(key, "_k")
    lhs = left.withColumns({"_ls": epoch(lt), "_lb": _bucket(epoch(lt), width)})
    close = (F.col(key) == F.col("_k")) & (F.col("_lb") == F.col("_b")) & (F.abs(F.col("_ls") - F.col("_rs")) <= seconds)
    return lhs.join(marks, close, "left_semi").drop("_ls", "_lb")


def correlate(
    events: DataFrame, alerts: DataFrame, as_of, seconds: int = 10, days: int = 1, n: int | None = 100
) -> DataFrame:
    """Events paired with alerts of the same source at most ``seconds`` apart, newest first.

    For a top-n the pairs of all events are never built: an event either has a
    pair or not, so the first n events that have one already hold the first n
    pairs. They are found by a semi join and only they are then joined.
    """
    recent = since(events, as_of, days=days).select(
        F.col("timestamp").alias("honeypot_time"), "event_id", "source_ip_hash", "honeypot_type", "dest_port", "event_type"
    )
    # an alert that can pair lies in the events' span, widened on both sides
    end, reach = as_datetime(as_of), timedelta(seconds=seconds)
    marks = between(alerts, end - timedelta(days=days) - reach, end + reach).select(
        F.col("timestamp").alias("ids_time"), "alert_id", "source_ip_hash", "alert_signature", "mitre_technique_id"
    )
    order = [F.desc("honeypot_time"), "source_ip_hash", "event_id"]
    out = ["honeypot_time", "ids_time", "source_ip_hash", "honeypot_type", "dest_port", "event_type",
           "alert_signature", "mitre_technique_id"]
    if n is None:
        return near_join(recent, marks, "source_ip_hash", seconds, "honeypot_time", "ids_time").select(*out)
    head = near_exists(recent, marks, "source_ip_hash", seconds, "honeypot_time", "ids_time").orderBy(*order).limit(n)
    # ``head`` has at most n rows, so sending it to every task is safe
    pairs = marks.join(F.broadcast(head), "source_ip_hash").filter(
        F.abs(epoch("honeypot_time") - epoch("ids_time")) <= seconds
    )
    return pairs.orderBy(*order, "ids_time", "alert_id").limit(n).select(*out)


def alert_context(alerts: DataFrame, conns: DataFrame, minutes: int = 5) -> DataFrame:
    """Connections of each alert's source within ``minutes`` of the alert."""
    marks = alerts.select("alert_id", "source_ip_hash", F.col("timestamp").alias("alert_time"))
    lines = conns.select("source_ip_hash", "uid", "timestamp", "dest_ip", "dest_port")
    return near_join(lines, marks, "source_ip_hash", minutes * 60, "timestamp", "alert_time").select(
        "alert_id", "uid", "timestamp", "dest_ip", "dest_port"
    )


def context_windows(alerts: DataFrame, conns: DataFrame, minutes: int = 5) -> DataFrame:
    """Every connection near any alert of its source, once, with the nearest alert times.

    The linear form of :func:`alert_context` for sources that alert all the time.
    Alert seconds are reduced to one (first, last) pair per source and bucket, so
    a connection meets at most three rows however often the source alerted:
    a hit needs an alert in reach, which the buckets' extremes decide together
    with the connection's own bucket.
    """
    reach = minutes * 60
    sec = epoch("timestamp")
    marks = alerts.groupBy("source_ip_hash", sec.alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    lanes = (
        marks.groupBy("source_ip_hash", _bucket(F.col("_s"), reach).alias("_ab"))
        .agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
        .withColumn("_b", F.explode(F.array(F.col("_ab") - 1, F.col("_ab"), F.col("_ab") + 1)))
        .groupBy("source_ip_hash", "_b")
        .agg(
            # last alert of the bucket before, any alert of the own one, first alert of the one after
            F.max(F.when(F.col("_ab") < F.col("_b"), F.col("_hi"))).alias("_prev"),
            F.max(F.when(F.col("_ab") == F.col("_b"), F.col("_lo"))).alias("_own"),
            F.min(F.when(F.col("_ab") > F.col("_b"), F.col("_lo"))).alias("_next"),
        )
    )
    lines = conns.select("source_ip_hash", "uid", "timestamp", "dest_ip", "dest_port", sec.alias("_c"))
    lines = lines.withColumn("_b", _bucket(F.col("_c"), reach))
    near = (
        F.col("_own").isNotNull()
        | (F.col("_c") - F.col("_prev") <= reach)
        | (F.col("_next") - F.col("_c") <= reach)
    )
    return (
        lines.join(lanes, ["source_ip_hash", "_b"])
        .filter(F.coalesce(near, F.lit(False)))
        .select("source_ip_hash", "uid", "timestamp", "dest_ip", "dest_port")
    )
