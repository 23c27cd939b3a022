"""How well the sensors see known attacks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, lists
from ..functions.timing import as_datetime, between, since, stamp


def _windows(df: DataFrame, scenarios: list, *extra) -> DataFrame:
    """Rows × the scenarios whose window holds them.

    Scenarios are a hand-written list of test runs, so they become constants of one
    projection; a row meets each of them in place instead of through a join.
    """
    spans = [(name, as_datetime(lo), as_datetime(hi)) for name, lo, hi in scenarios]
    held = [F.col("timestamp").between(stamp(lo), stamp(hi)) for _, lo, hi in spans]
    inside = [F.when(cond, F.lit(name)) for cond, (name, _, _) in zip(held, spans, strict=True)]
    # stated as a filter as well: a condition inside the array would not reach the scan
    df = df.filter(reduce(or_, held, F.lit(False)))
    if "month" in df.columns:
        months = [F.col("month").between(lo.strftime("%Y-%m"), hi.strftime("%Y-%m")) for _, lo, hi in spans]
        df = df.filter(reduce(or_, months, F.lit(False)))
    return df.select(F.explode(F.array_compact(F.array(*inside))).alias("scenario"), *extra)


def scenario_results(scenarios: list, events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Events, alerts and first technique within each scenario's window.

    ``scenarios``: (name, start, end). "First" is by time, then by alert id.
    """
    spark = events.sparkSession
    names = spark.createDataFrame([(name,) for name, _, _ in scenarios], "scenario string")
    seen = _windows(events, scenarios).groupBy("scenario").agg(F.count(F.lit(1)).alias("events_count"))
    technique = F.when(
        F.col("mitre_technique_id") != "", F.struct("timestamp", "alert_id", F.col("mitre_technique_id").alias("t"))
    )
    alerted = (
        _windows(alerts, scenarios, technique.alias("hit"))
        .groupBy("scenario")
        .agg(F.count(F.lit(1)).alias("alerts_count"), F.min("hit").alias("first"))
    )
    return (
        names.join(seen, "scenario", "left")
        .join(alerted, "scenario", "left")
        .select(
            "scenario",
            F.coalesce("events_count", F.lit(0)).alias("events_count"),
            F.coalesce("alerts_count", F.lit(0)).alias("alerts_count"),
            F.coalesce(F.col("first.t"), F.lit("")).alias("technique"),
        )
    )


def effectiveness(results: DataFrame, required: float = 0.80) -> DataFrame:
    """Detection report over scenario results; all listed scenarios count as executed."""
    executed = F.col("executed") if "executed" in results.columns else F.lit(True)
    sensor, ids = F.col("events_count") > 0, F.col("alerts_count") > 0
    counts = results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(executed).alias("executed"),
        F.count_if(sensor).alias("honeypot_detected"),
        F.count_if(ids).alias("ids_detected"),
        F.count_if(sensor & ids).alias("both_detected"),
        F.count_if(F.col("technique") != "").alias("mitre_mapped"),
        F.count_if(executed & (sensor | ids)).alias("_true"),
    )
    tpr = F.when(F.col("executed") > 0, F.col("_true") / F.col("executed")).otherwise(F.lit(0.0))
    return counts.withColumn("tpr", F.round(tpr, 3)).withColumn("passed", tpr >= required).drop("_true")


def tpr_band(tpr):
    return (
        F.when(tpr >= 0.90, "Excellent").when(tpr >= 0.80, "Good").when(tpr >= 0.70, "Acceptable").otherwise("Failing")
    )


def false_positive_rate(alerts: DataFrame, test_sources: DataFrame, start, end, limit: float = 0.05) -> DataFrame:
    """Share of a span's alerts that no test source explains, and how many test sources raised one."""
    span = between(alerts, start, end).select("source_ip_hash")
    known = test_sources.select(F.col("ip_hash").alias("source_ip_hash"), F.lit(True).alias("_test")).distinct()
    per_source = span.groupBy("source_ip_hash").agg(F.count(F.lit(1)).alias("n"))
    joined = per_source.join(known, "source_ip_hash", "full")
    n, tested = F.coalesce(F.col("n"), F.lit(0)), F.col("_test").isNotNull()
    counts = joined.agg(
        F.coalesce(F.sum(F.when(~tested, n)), F.lit(0)).alias("false_alerts"),
        F.coalesce(F.sum(n), F.lit(0)).alias("all_alerts"),
        F.count_if(tested & (n > 0)).alias("_seen"),
        F.count_if(tested).alias("_tested"),
    )

    def ratio(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    fpr, tpr = ratio("false_alerts", "all_alerts"), ratio("_seen", "_tested")
    return counts.select(
        "false_alerts", "all_alerts", F.round(fpr, 4).alias("fpr"), (fpr <= limit).alias("within_limit"),
        F.round(tpr, 4).alias("tpr"), tpr_band(tpr).alias("tpr_band"),
    )


def alert_counts(alerts: DataFrame, as_of, hours: int = 1) -> DataFrame:
    return since(alerts, as_of, hours=hours).agg(
        F.count_distinct("signature_id").alias("unique_alerts"), F.count(F.lit(1)).alias("total_alerts")
    )


def phase_coverage(alerts: DataFrame) -> DataFrame:
    """Detections per kill-chain phase."""
    phase = classify.kill_chain_stage("mitre_technique_id", "signature_id")
    return alerts.select(phase.alias("phase")).filter("phase <> ''").groupBy("phase").agg(
        F.count(F.lit(1)).alias("detections")
    )


def protocol_coverage(alerts: DataFrame) -> DataFrame:
    """Detections per protocol by the alerts meant for it, with the expected rate."""
    by_sid = {sid: name for name, (sids, _) in lists.PROTOCOL_SIDS.items() for sid in sids}
    expected = {name: rate for name, (_, rate) in lists.PROTOCOL_SIDS.items()}
    named = alerts.select(classify.lookup(F.col("signature_id").cast("int"), by_sid, "").alias("protocol"))
    counts = named.filter("protocol <> ''").groupBy("protocol").agg(F.count(F.lit(1)).alias("detections"))
    return counts.withColumn("expected_tpr", classify.lookup(F.col("protocol"), expected, 0.0))
