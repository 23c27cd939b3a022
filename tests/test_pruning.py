"""Time bounds of correlation and scenario reports reach the scans on both sides."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wardlake.operators.intervals import correlate
from wardlake.plans.evaluation import scenario_results
from wardlake.sources.tables import append_table, read_table


def stored(spark, tmp_path):
    start = datetime(2024, 1, 1)
    times = [start + timedelta(hours=6 * i) for i in range(300)]
    events = spark.createDataFrame([(str(i), t, "h", "ssh") for i, t in enumerate(times)], "event_id string, timestamp timestamp, source_ip_hash string, event_type string")
    alerts = spark.createDataFrame([(str(i), t + timedelta(seconds=5), "h", "T1") for i, t in enumerate(times)], "alert_id string, timestamp timestamp, source_ip_hash string, mitre_technique_id string")
    append_table(events, "honeypot_events", str(tmp_path))
    append_table(alerts, "ids_alerts", str(tmp_path))
    return read_table(spark, "honeypot_events", str(tmp_path)), read_table(spark, "ids_alerts", str(tmp_path))


def scans(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "FileScan" in line]


def test_correlation_reads_only_its_span(spark, tmp_path):
    events, alerts = stored(spark, tmp_path)
    pairs = correlate(events, alerts, "2024-02-02 00:00:00", seconds=10, days=1)
    found = scans(pairs)
    assert len(found) >= 3
    assert all("GreaterThanOrEqual(timestamp" in line and "month" in line.split("PartitionFilters: ")[1].split("PushedFilters")[0] for line in found)
    assert pairs.count() == 5  # midnight to midnight, every six hours


def test_alerts_just_outside_the_events_span_still_pair(spark, tmp_path):
    events, alerts = stored(spark, tmp_path)
    last = correlate(events, alerts, "2024-02-01 12:00:00", seconds=10, days=1).agg(F.max("ids_time")).first()[0]
    assert last == datetime(2024, 2, 1, 12, 0, 5)


def test_scenarios_read_only_their_windows(spark, tmp_path):
    events, alerts = stored(spark, tmp_path)
    windows = [("a", "2024-01-05 00:00:00", "2024-01-05 23:59:59"), ("b", "2024-02-05 00:00:00", "2024-02-05 23:59:59")]
    report = scenario_results(windows, events, alerts)
    assert all("Or(" in line.split("PushedFilters: ")[1] for line in scans(report))
    assert [(r.scenario, r.events_count, r.alerts_count) for r in report.orderBy("scenario").collect()] == [("a", 4, 4), ("b", 4, 4)]
