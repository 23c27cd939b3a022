"""Attacker profiles: build, extend, count and report."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timing import as_datetime, since, stamp
from .rollups import SETS, event_cells

COUNTERS = ("credential_attempts", "successful_logins", "files_downloaded")


def build_profiles(events: DataFrame, as_of, days: int = 1) -> DataFrame:
    """One profile per source active in the last ``days``, counters at zero."""
    cells = event_cells(since(events, as_of, days=days), by_day=False)
    return cells.groupBy("source_ip_hash").agg(
        F.min("lo").alias("first_seen"),
        F.max("hi").alias("last_seen"),
        F.sum("n").alias("total_events"),
        *[F.sort_array(F.collect_set(src)).alias(name) for name, src in SETS.items()],
        *[F.lit(0).cast("long").alias(c) for c in COUNTERS],
    )


def new_profiles(events: DataFrame, profiles: DataFrame, as_of, days: int = 1) -> DataFrame:
    """Profiles of sources not profiled yet.

    The anti join comes after the aggregation: it then meets one row per source, already
    partitioned by it, instead of every event of the busy ones.
    """
    return build_profiles(events, as_of, days).join(profiles.select("source_ip_hash"), "source_ip_hash", "left_anti")


def _login_counts(creds: DataFrame) -> DataFrame:
    return creds.groupBy("source_ip_hash").agg(
        F.count(F.lit(1)).alias("_attempts"), F.count_if("success").alias("_logins"), F.max("timestamp").alias("_last")
    )


def _active(as_of, days: int):
    lo = as_datetime(as_of) - timedelta(days=days)
    return F.col("_last").between(stamp(lo), stamp(as_datetime(as_of)))


def set_credential_counts(profiles: DataFrame, creds: DataFrame, as_of, active_days: int = 1) -> DataFrame:
    """Replace credential counters by all-time totals, for sources active lately.

    "Active" is read off the newest attempt of the same grouped pass, so the
    credentials are scanned and shuffled once.
    """
    stats = _login_counts(creds.filter(F.col("timestamp") <= stamp(as_datetime(as_of)))).filter(_active(as_of, active_days))
    joined = profiles.join(stats, "source_ip_hash", "left")
    return joined.withColumns(
        {
            "credential_attempts": F.coalesce("_attempts", "credential_attempts"),
            "successful_logins": F.coalesce("_logins", "successful_logins"),
        }
    ).select(*profiles.columns)


def set_download_counts(profiles: DataFrame, files: DataFrame, as_of, active_days: int = 1) -> DataFrame:
    """Replace the download counter likewise."""
    stats = (
        files.filter(F.col("timestamp") <= stamp(as_datetime(as_of)))
        .groupBy("source_ip_hash")
        .agg(F.count(F.lit(1)).alias("_files"), F.max("timestamp").alias("_last"))
        .filter(_active(as_of, active_days))
    )
    joined = profiles.join(stats, "source_ip_hash", "left")
    return joined.withColumn("files_downloaded", F.coalesce("_files", "files_downloaded")).select(*profiles.columns)


def add_daily_counts(profiles: DataFrame, creds: DataFrame, files: DataFrame, run_date) -> DataFrame:
    """Add the counts of the day before ``run_date`` to the counters, once per date.

    The profile carries ``last_run``; a second run for the same (or an older) date
    leaves its row unchanged.
    """
    day = as_datetime(run_date)
    if "last_run" not in profiles.columns:
        profiles = profiles.withColumn("last_run", F.lit(None).cast("date"))
    logins = _login_counts(since(creds, day, days=1)).drop("_last")
    loads = since(files, day, days=1).groupBy("source_ip_hash").agg(F.count(F.lit(1)).alias("_files"))
    this_run = F.lit(day.strftime("%Y-%m-%d")).cast("date")
    due = F.col("last_run").isNull() | (F.col("last_run") < this_run)

    def plus(col, extra):
        return F.col(col) + F.when(due, F.coalesce(F.col(extra), F.lit(0))).otherwise(0)

    joined = profiles.join(logins, "source_ip_hash", "left").join(loads, "source_ip_hash", "left")
    return joined.withColumns(
        {
            "credential_attempts": plus("credential_attempts", "_attempts"),
            "successful_logins": plus("successful_logins", "_logins"),
            "files_downloaded": plus("files_downloaded", "_files"),
            "last_run": F.when(due, this_run).otherwise(F.col("last_run")),
        }
    ).select(*profiles.columns)


def refresh_profiles(events, creds, files, profiles, as_of, days: int = 1) -> DataFrame:
    """The daily job as one plan: keep known profiles, add new ones, set all counters."""
    grown = profiles.unionByName(new_profiles(events, profiles, as_of, days).select(*profiles.columns))
    return set_download_counts(set_credential_counts(grown, creds, as_of, days), files, as_of, days)


def top_profiles(profiles: DataFrame, as_of, n: int = 10, days: int = 1) -> DataFrame:
    """The busiest profiles seen in the last ``days``."""
    return (
        since(profiles, as_of, days=days, col="last_seen")
        .select(
            "source_ip_hash",
            "total_events",
            F.size("unique_ports_targeted").alias("ports_count"),
            F.size("protocols_used").alias("protocols_count"),
            "credential_attempts",
            "files_downloaded",
        )
        .orderBy(F.desc("total_events"), "source_ip_hash")
        .limit(n)
    )


def dossier(profiles: DataFrame, creds: DataFrame, files: DataFrame, source: str) -> dict:
    """Everything known about one source: profile, credentials in time order, files."""
    mine = F.col("source_ip_hash") == source
    return {
        "profile": profiles.filter(mine),
        "credentials": creds.filter(mine).orderBy("timestamp", "session_id"),
        "files": files.filter(mine).orderBy("timestamp", "file_id"),
    }


def profile_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Profiles before, added and after a refresh."""
    tagged = old.select(F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(
        new.select(F.lit(0).alias("o"), F.lit(1).alias("n"))
    )
    sums = tagged.agg(F.coalesce(F.sum("o"), F.lit(0)).alias("existing"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return sums.select("existing", (F.col("total") - F.col("existing")).alias("added"), "total")
