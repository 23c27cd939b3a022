"""Alert rules: a value per minute, a threshold, a hold time, routing.

The value rules count per minute first; trailing windows then add up those few
rows by sending each minute to the minutes that can see it. Nothing larger than
one row per minute (and source, for the login rule) is shuffled after that.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.timing import as_datetime, epoch, stamp
from ..operators.folds import first_in_window

def _minute() -> Column:
    return F.date_trunc("minute", "timestamp")


# Rule -> label, severity, hold minutes, state without data, state on error.
RULES = {
    "SuricataHighAlertRate": ("critical", 2, "NoData", "Error"),
    "HoneypotConnectionSpike": ("critical", 3, "NoData", "Error"),
    "MalwareCaptured": ("high", 1, "NoData", "OK"),
    "BruteForceAttack": ("high", 5, "NoData", "Error"),
    "ICSProtocolAttack": ("high", 5, "NoData", "Error"),
    "PipelineLag": ("warning", 5, "Alerting", "Error"),
}

# Routes in order: label, value, receiver, repeat interval in seconds; the last takes the rest.
ROUTES = (
    ("severity", "critical", "Discord Critical Alerts", 3600),
    ("severity", "high", "Discord Security Alerts", 7200),
    ("severity", "warning", "Discord Security Alerts", 21600),
    ("alertname", "SuricataHighAlertRate", "Discord Critical Alerts", 1800),
    (None, None, "Discord Security Alerts", 14400),
)


# --- the six tables the rules are written against, as views


def rule_views(events: DataFrame, alerts: DataFrame, creds: DataFrame, files: DataFrame) -> dict:
    def of(kind):
        return events.filter(F.col("honeypot_type") == kind)

    return {
        "suricata_alerts": alerts,
        "cowrie_sessions": of("cowrie"),
        "cowrie_auth": creds.withColumn("src_ip", F.col("source_ip_hash")),
        "dionaea_connections": of("dionaea"),
        "dionaea_binaries": files,
        "conpot_events": of("conpot"),
    }


def _per_minute(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(_minute().alias("minute"), *keys).agg(F.count(F.lit(1)).alias("value"))


def _trailing(counts: DataFrame, minutes: int, *keys: str) -> DataFrame:
    """Sum over the minute and the ``minutes - 1`` before it."""
    if minutes == 1:
        return counts
    seen_by = F.sequence(F.lit(0), F.lit(minutes - 1))
    spread = counts.withColumn("_d", F.explode(seen_by)).withColumn(
        "minute", F.timestamp_seconds(epoch("minute") + F.col("_d") * 60)
    )
    return spread.groupBy("minute", *keys).agg(F.sum("value").alias("value"))


def _judge(series: DataFrame, limit: float) -> DataFrame:
    return series.withColumn("breach", F.col("value") > limit)


def alert_rate(alerts: DataFrame, limit: int = 1000) -> DataFrame:
    return _judge(_per_minute(alerts), limit)


def connection_spike(events: DataFrame, limit: int = 500) -> DataFrame:
    three = events.filter(F.col("honeypot_type").isin("cowrie", "dionaea", "conpot"))
    return _judge(_per_minute(three), limit)


def malware_captured(files: DataFrame, limit: int = 1, minutes: int = 5) -> DataFrame:
    return _judge(_trailing(_per_minute(files), minutes), limit)


def brute_force(creds: DataFrame, limit: int = 50, minutes: int = 10) -> DataFrame:
    """Per minute the source with most failed logins in the trailing window."""
    failed = _per_minute(creds.filter(~F.col("success")), "source_ip_hash")
    counts = _trailing(failed, minutes, "source_ip_hash")
    # largest value; of equal ones the smallest source
    best = counts.groupBy("minute").agg(F.min(F.struct((-F.col("value")).alias("v"), "source_ip_hash")).alias("b"))
    series = best.select("minute", F.col("b.source_ip_hash").alias("source_ip_hash"), (-F.col("b.v")).alias("value"))
    return _judge(series, limit)


def ics_attack(events: DataFrame, limit: int = 10, minutes: int = 10) -> DataFrame:
    wanted = F.col("protocol").isin(*lists.ICS_PROTOCOLS) | F.col("event_type").isin(*lists.ICS_EVENTS)
    hits = events.filter((F.col("honeypot_type") == "conpot") & wanted)
    return _judge(_trailing(_per_minute(hits), minutes), limit)


def minute_grid(spark, start: str | datetime, end: str | datetime) -> DataFrame:
    """All minutes of a span, generated on the executors."""
    lo, hi = as_datetime(start), as_datetime(end)
    total = int((hi - lo).total_seconds() // 60) + 1
    first = epoch(F.date_trunc("minute", stamp(lo)))
    return spark.range(total).select(F.timestamp_seconds(first + F.col("id") * 60).alias("minute"))


def pipeline_lag(
    events: DataFrame, alerts: DataFrame, start, end, limit: int = 300, scope_minutes: int = 60
) -> DataFrame:
    """Seconds since the newest row, at every minute; no row within the scope breaches too."""
    two = events.filter(F.col("honeypot_type").isin("cowrie", "dionaea")).select("timestamp")
    newest = (
        two.unionByName(alerts.select("timestamp")).groupBy(_minute().alias("at")).agg(F.max("timestamp").alias("newest"))
    )
    # rows of a minute are visible from the next one on, for as long as the scope lasts
    visible = newest.withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(scope_minutes)))).select(
        F.timestamp_seconds(epoch("at") + F.col("_d") * 60).alias("minute"), "newest"
    )
    latest = visible.groupBy("minute").agg(F.max("newest").alias("newest"))
    grid = minute_grid(events.sparkSession, start, end).join(latest, "minute", "left")
    lag = epoch("minute") - epoch("newest")
    return grid.select("minute", lag.alias("lag_seconds"), F.coalesce(lag > limit, F.lit(True)).alias("breach"))


# --- state


def fill_states(series: DataFrame, start, end, limits: dict, policies: dict | None = None) -> DataFrame:
    """Series (rule, minute, value) on a full minute grid, judged with the rule's policies.

    ``limits``: rule -> threshold. A missing minute takes the rule's no-data state, a row
    without a value its error state; "Alerting" counts as a breach. Rules are
    configuration, so the grid is rules × minutes of the span.
    """
    spark = series.sparkSession
    policies = policies or {name: (r[2], r[3]) for name, r in RULES.items()}
    rules = spark.createDataFrame(
        [(r, float(v), *policies.get(r, ("NoData", "Error"))) for r, v in limits.items()],
        "rule string, limit double, no_data string, on_error string",
    )
    grid = minute_grid(spark, start, end).withColumn("rule", F.explode(F.array(*[F.lit(r) for r in limits])))
    rows = series.select("rule", "minute", "value", F.lit(True).alias("present"))
    joined = grid.join(rows, ["rule", "minute"], "left").join(F.broadcast(rules), "rule")
    state = (
        F.when(F.col("present").isNull(), F.col("no_data"))
        .when(F.col("value").isNull(), F.col("on_error"))
        .when(F.col("value") > F.col("limit"), "Alerting")
        .otherwise("Normal")
    )
    return joined.select("rule", "minute", "value", state.alias("state"), (state == "Alerting").alias("breach"))


def evaluate(series: DataFrame, hold_minutes: dict | int) -> DataFrame:
    """Pending / firing / resolved rows of a judged series (rule, minute, breach).

    A breach is pending until it has held for the rule's minutes, then firing; the
    first minute without breach after firing is resolved. A missing minute ends a
    run. One rule's minutes form a window partition: at most 1 440 rows a day.
    """
    if isinstance(hold_minutes, dict):
        hold = F.coalesce(
            F.try_element_at(F.create_map(*[F.lit(x) for kv in hold_minutes.items() for x in kv]), F.col("rule")), F.lit(0)
        )
    else:
        hold = F.lit(hold_minutes)
    by_rule = Window.partitionBy("rule").orderBy("minute")
    sec = epoch("minute")
    prev_breach, prev_sec = F.lag("breach").over(by_rule), F.lag(sec).over(by_rule)
    follows = F.coalesce(prev_breach & (prev_sec == sec - 60), F.lit(False))
    runs = series.withColumns({"_start": F.when(F.col("breach") & ~follows, sec), "_follows": follows})
    begun = F.last("_start", ignorenulls=True).over(by_rule.rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("_held", (sec - begun) / 60)
    state = F.when(F.col("breach"), F.when(F.col("_held") >= hold, "firing").otherwise("pending")).when(
        F.col("_follows") & (F.col("_held") - 1 >= hold), "resolved"
    )
    return runs.withColumn("state", state).filter(F.col("state").isNotNull()).select("rule", "minute", "state")


# --- routing


def route_alerts(firing: DataFrame, routes=ROUTES) -> DataFrame:
    """Notifications for firing rows (alertname, source, severity, minute).

    The first route whose label matches takes the alert; within a route alerts are
    grouped by name and source, and a group is sent again only after the route's
    repeat interval.
    """
    index = F.lit(None).cast("int")
    for i, (label, value, _, _) in reversed(list(enumerate(routes))):
        index = F.lit(i) if label is None else F.when(F.col(label) == value, F.lit(i)).otherwise(index)

    def of(pos: int) -> Column:
        return F.element_at(F.array(*[F.lit(r[pos]) for r in routes]), F.col("route") + 1)

    routed = firing.withColumn("route", index)
    routed = routed.withColumns({"receiver": of(2), "repeat_s": of(3)})
    keys = ["route", "alertname", "source"]
    sent = first_in_window(routed, keys, "repeat_s", "minute")
    return sent.select("receiver", F.concat_ws("/", "alertname", "source").alias("group"), F.col("minute").alias("sent_at"))
