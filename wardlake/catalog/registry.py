"""Registered queries: a Spark callable and, where SQL can say it, an independent oracle."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .views import AS_OF, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    """Dates, times and arrays as text, so that any client compares them alike."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            col = col.cast("string")
        elif isinstance(field.dataType, T.ArrayType):
            col = F.array_join(col.cast("array<string>"), "|")
        elif isinstance(field.dataType, (T.MapType, T.StructType)):
            col = F.to_json(col)
        out.append(col.alias(field.name))
    return df.select(*out)


def add(key: str, build: Callable[[Views], DataFrame], sql: str | None = None) -> None:
    if key in QUERIES:
        raise ValueError(f"{key} is registered twice")
    QUERIES[key] = lambda spark, folder: present(build(Views(spark, folder)))
    if sql is not None:
        ORACLES[key] = sql


def ago(days: int = 0, hours: int = 0, as_of: str = AS_OF) -> str:
    """``as_of`` minus a span, as text for both sides."""
    return (datetime.fromisoformat(as_of) - timedelta(days=days, hours=hours)).strftime("%Y-%m-%d %H:%M:%S")


def window(days: int = 0, hours: int = 0, col: str = "timestamp", as_of: str = AS_OF) -> str:
    """The same span as a SQL condition."""
    return f"{col} >= TIMESTAMP '{ago(days, hours, as_of)}' AND {col} <= TIMESTAMP '{as_of}'"


def chain_sql(hits: str, seconds: str) -> str:
    """WITH members that walk expiring windows: ``hits`` (key, sec, cnt[, ...]) -> ``walked``.

    ``seconds`` is an expression over a row ``c`` of the chain. Each step of the recursion
    finds the first hit after the window before has expired.
    """
    return f"""sec_hits AS ({hits}),
chain(key, anchor) AS (
  SELECT key, min(sec) FROM sec_hits GROUP BY key
  UNION ALL
  SELECT c.key, min(s.sec) FROM chain c JOIN sec_hits s ON s.key = c.key AND s.sec >= c.anchor + {seconds}
  GROUP BY c.key, c.anchor
),
walked AS (
  SELECT *, coalesce(sum(cnt) OVER (PARTITION BY key, anchor ORDER BY sec
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_before
  FROM (SELECT s.*, c.anchor FROM sec_hits s ASOF JOIN chain c ON s.key = c.key AND s.sec >= c.anchor)
)"""


def fire_sql(n: str, mode: str) -> str:
    """The hits of ``walked`` that fire, as a sub-select with column ``hit``."""
    lo = {"threshold": f"((n_before + {n}) // {n}) * {n}", "both": f"greatest(n_before + 1, {n})",
          "limit": "n_before + 1", "every": f"greatest(n_before + 1, {n})"}[mode]
    hi = "n_before + cnt" if mode in ("threshold", "every") else f"least(n_before + cnt, {n})"
    step = n if mode == "threshold" else "1"
    return f"(SELECT *, unnest(generate_series(({lo})::BIGINT, ({hi})::BIGINT, ({step})::BIGINT)) AS hit FROM walked)"
