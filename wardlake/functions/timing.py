"""Time parsing and time filters shared by all queries."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_ts(col: Column | str) -> Column:
    """ISO-8601 text, ``yyyy-MM-dd HH:mm:ss`` text or UNIX epoch -> whole-second timestamp.

    A purely numeric text is an epoch; anything else goes through Spark's own
    timestamp parser, which reads both date layouts. Unreadable text gives null.
    """
    text = F.trim(F.col(col) if isinstance(col, str) else col).cast("string")
    numeric = text.rlike(r"^\d+(\.\d+)?([eE]\d+)?$")
    parsed = F.when(numeric, F.timestamp_seconds(text.try_cast("double"))).otherwise(F.try_to_timestamp(text))
    return F.date_trunc("second", parsed)


def epoch(col: Column | str) -> Column:
    """Whole seconds since 1970 (floors fractions)."""
    return F.unix_timestamp(F.col(col) if isinstance(col, str) else col)


def as_datetime(as_of: str | datetime) -> datetime:
    return datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of


def stamp(moment: datetime) -> Column:
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def between(df: DataFrame, start, end, col: str = "timestamp") -> DataFrame:
    """Rows with ``start <= col <= end``; also prunes ``month`` partitions when the table has them.

    Spark does not derive a bound on ``month`` from a bound on ``timestamp``, so
    both are stated.
    """
    lo, hi = as_datetime(start), as_datetime(end)
    out = df.filter((F.col(col) >= stamp(lo)) & (F.col(col) <= stamp(hi)))
    if "month" in df.columns:
        out = out.filter(F.col("month").between(lo.strftime("%Y-%m"), hi.strftime("%Y-%m")))
    return out


def since(df: DataFrame, as_of, *, days=0, hours=0, minutes=0, col: str = "timestamp") -> DataFrame:
    """Rows of the last days/hours/minutes before ``as_of`` (which stands in for "now")."""
    end = as_datetime(as_of)
    return between(df, end - timedelta(days=days, hours=hours, minutes=minutes), end, col)


def on_day(df: DataFrame, day, col: str = "timestamp") -> DataFrame:
    """Rows of one calendar day, as a range so the scan can prune."""
    start = as_datetime(day).replace(hour=0, minute=0, second=0, microsecond=0)
    return between(df, start, start + timedelta(days=1) - timedelta(seconds=1), col)
