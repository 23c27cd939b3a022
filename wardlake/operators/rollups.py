"""Daily rollups: full recompute, mergeable partials and their merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def day() -> Column:
    return F.to_date("timestamp").alias("date")


def _n() -> Column:
    return F.count(F.lit(1))


def daily_attack_stats(events: DataFrame) -> DataFrame:
    return events.groupBy(day(), "honeypot_type", "event_type").agg(
        _n().alias("event_count"),
        F.count_distinct("source_ip_hash").alias("unique_attackers"),
        F.count_distinct("dest_port").alias("unique_ports"),
    )


def top_attacked_services(conns: DataFrame) -> DataFrame:
    return conns.groupBy(day(), "dest_port", "protocol").agg(
        _n().alias("connection_count"), F.count_distinct("source_ip_hash").alias("unique_sources")
    )


def credential_stats(creds: DataFrame) -> DataFrame:
    return creds.groupBy(day(), "username", "password").agg(
        _n().alias("attempt_count"),
        F.count_distinct("source_ip_hash").alias("unique_sources"),
        F.count_if("success").alias("success_count"),
    )


def mitre_attack_stats(alerts: DataFrame) -> DataFrame:
    named = alerts.filter(F.col("mitre_technique_id") != "")
    return named.groupBy(day(), "mitre_tactic", "mitre_technique_id").agg(
        _n().alias("technique_count"),
        F.count_distinct("source_ip_hash").alias("unique_attackers"),
        F.count_distinct("dest_port").alias("unique_targets"),
    )


def geographic_attack_stats(events: DataFrame) -> DataFrame:
    placed = events.filter(F.col("source_ip_country") != "")
    return placed.groupBy(day(), "source_ip_country", "honeypot_type").agg(
        _n().alias("attack_count"),
        F.count_distinct("source_ip_hash").alias("unique_attackers"),
        F.count_distinct("dest_port").alias("unique_ports_targeted"),
    )


def event_cells(events: DataFrame, by_day: bool = True) -> DataFrame:
    """Counts per (source[, day], port, protocol, country, event type).

    The first step of every per-source set: a plain hash aggregate with map-side
    combine, after which a busy source has one row per distinct combination (all
    small domains; ports at most 65 536) instead of one per event.
    """
    days = [day()] if by_day else []
    return events.groupBy(
        "source_ip_hash", *days, "dest_port", "protocol", "source_ip_country", "event_type"
    ).agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), _n().alias("n"))


SETS = {
    "unique_ports_targeted": "dest_port",
    "protocols_used": "protocol",
    "countries": "source_ip_country",
    "attack_types": "event_type",
}


def profile_states(events: DataFrame) -> DataFrame:
    """Partial profile per source and day: extremes, count and four value sets."""
    return event_cells(events).groupBy("source_ip_hash", "date").agg(
        F.min("lo").alias("first_seen"),
        F.max("hi").alias("last_seen"),
        F.sum("n").alias("total_events"),
        *[F.sort_array(F.collect_set(src)).alias(name) for name, src in SETS.items()],
    )


def finish_profiles(states: DataFrame) -> DataFrame:
    """Merge partial profiles of any days (or batches) into one row per source."""
    return states.groupBy("source_ip_hash").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("total_events").alias("total_events"),
        *[F.sort_array(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name) for name in SETS],
    )


def sketched_rollup(df: DataFrame, keys: list, distinct: dict, sums: dict | None = None) -> DataFrame:
    """A rollup whose distinct counts stay mergeable: sums plus HLL sketches.

    ``distinct`` maps an output name to the counted column, ``sums`` an output
    name to an aggregate expression.
    """
    sums = sums or {"event_count": _n()}
    return df.groupBy(*keys).agg(
        *[expr.alias(name) for name, expr in sums.items()],
        *[F.hll_sketch_agg(F.col(src)).alias(f"{name}_sketch") for name, src in distinct.items()],
    )


def merge_rollup(old: DataFrame, new: DataFrame, keys: list, sums: list, sketches: list) -> DataFrame:
    """Add two rollups of the same layout: sums add up, sketches unite.

    Adding finished distinct counts would count a source once per batch; sketches
    do not.
    """
    return (
        old.unionByName(new)
        .groupBy(*keys)
        .agg(
            *[F.sum(s).alias(s) for s in sums],
            *[F.hll_union_agg(F.col(f"{s}_sketch")).alias(f"{s}_sketch") for s in sketches],
        )
    )


def estimate(rollup: DataFrame, sketches: list) -> DataFrame:
    """Replace sketch columns by their estimates."""
    out = rollup.withColumns({s: F.hll_sketch_estimate(f"{s}_sketch") for s in sketches})
    return out.drop(*[f"{s}_sketch" for s in sketches])
