from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardlake.operators import detections as d
from wardlake.operators import intervals, profiles, rollups
from wardlake.plans import alerts as al
from wardlake.plans import analytics as a
from wardlake.plans import evaluation as ev

T0 = datetime(2024, 1, 1, 10, 0, 0)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def series(spark, values, rule="r"):
    return spark.createDataFrame([(rule, at(60 * m), v) for m, v in values], "rule string, minute timestamp, value long")


def states(rows, df):
    return [(int((m - T0).total_seconds() // 60), s) for m, s in rows(df, "minute", "state")]


def test_breach_is_pending_then_firing_then_resolved(spark, rows):
    df = series(spark, enumerate([1, 9, 9, 9, 1, 9, 1])).withColumn("breach", F.col("value") > 5)
    assert states(rows, al.evaluate(df, 2)) == [(1, "pending"), (2, "pending"), (3, "firing"), (4, "resolved"), (5, "pending")]


def test_missing_minute_ends_a_run(spark, rows):
    df = series(spark, [(0, 9), (1, 9), (3, 9), (4, 9)]).withColumn("breach", F.lit(True))
    assert states(rows, al.evaluate(df, 1)) == [(0, "pending"), (1, "firing"), (3, "pending"), (4, "firing")]


def test_hold_differs_by_rule(spark, rows):
    both = series(spark, enumerate([9, 9]), "a").unionByName(series(spark, enumerate([9, 9]), "b")).withColumn("breach", F.lit(True))
    out = al.evaluate(both, {"a": 0, "b": 5})
    assert rows(out, "rule", "state") == [("a", "firing"), ("a", "firing"), ("b", "pending"), ("b", "pending")]


def test_connection_spike_of_six_hundred_rows(spark, rows):
    n = 4 * 600
    events = spark.range(n).select(
        F.timestamp_seconds(F.lit(1704103200) + F.floor(F.col("id") / 10)).alias("timestamp"), F.lit("cowrie").alias("honeypot_type")
    )
    judged = al.connection_spike(events).withColumn("rule", F.lit("HoneypotConnectionSpike"))
    assert rows(judged, "value", "breach") == [(600, True)] * 4
    fired = al.evaluate(judged, 3)
    assert [s for _, s in states(rows, fired)] == ["pending", "pending", "pending", "firing"]


def test_malware_needs_more_than_one(spark, rows):
    one = spark.createDataFrame([(at(0),)], "timestamp timestamp")
    assert {r[0] for r in rows(al.malware_captured(one), "breach")} == {False}
    two = spark.createDataFrame([(at(0),), (at(200),)], "timestamp timestamp")
    assert [r[1] for r in rows(al.malware_captured(two), "minute", "breach")] == [False] * 3 + [True] * 2 + [False] * 3


def test_no_data_and_error_policies(spark, rows):
    df = series(spark, [(0, 9), (1, None), (2, 1)], "PipelineLag")
    out = al.fill_states(df, at(0), at(180), {"PipelineLag": 5})
    assert [s for _, s in states(rows, out)] == ["Alerting", "Error", "Normal", "Alerting"]
    out = al.fill_states(series(spark, [(0, None)], "MalwareCaptured"), at(0), at(60), {"MalwareCaptured": 1})
    assert [s for _, s in states(rows, out)] == ["OK", "NoData"]


def test_routes_take_the_first_match_and_repeat_late(spark, rows):
    def firing(name, severity, minutes):
        return [(name, "s", severity, at(60 * m)) for m in minutes]

    df = spark.createDataFrame(
        firing("SuricataHighAlertRate", "critical", range(0, 130)) + firing("Other", "high", [0, 119, 120]) + firing("Odd", "info", [0, 239, 240]),
        "alertname string, source string, severity string, minute timestamp",
    )
    sent = rows(al.route_alerts(df).select("receiver", "group", (F.unix_timestamp("sent_at") - F.lit(1704103200)).alias("s")))
    assert sent == [
        ("Discord Critical Alerts", "SuricataHighAlertRate/s", 0),
        ("Discord Critical Alerts", "SuricataHighAlertRate/s", 3600),
        ("Discord Critical Alerts", "SuricataHighAlertRate/s", 7200),
        ("Discord Security Alerts", "Odd/s", 0),
        ("Discord Security Alerts", "Odd/s", 14400),
        ("Discord Security Alerts", "Other/s", 0),
        ("Discord Security Alerts", "Other/s", 7200),
    ]


def test_lag_breaches_without_data(spark, rows):
    ev_ = spark.createDataFrame([(at(0), "cowrie")], "timestamp timestamp, honeypot_type string")
    none = spark.createDataFrame([], "timestamp timestamp")
    out = al.pipeline_lag(ev_, none, at(0), at(62 * 60))
    got = {int((m - T0).total_seconds() // 60): (lag, b) for m, lag, b in rows(out)}
    assert got[0] == (None, True) and got[1] == (60, False) and got[5] == (300, False)
    assert got[6] == (360, True) and got[60] == (3600, True) and got[61] == (None, True)


# --- joins on time


def events_and_alerts(spark):
    events = spark.createDataFrame(
        [("e1", "x", at(0)), ("e2", "y", at(0)), ("e3", "x", at(500))], "event_id string, source_ip_hash string, timestamp timestamp"
    ).withColumns({c: F.lit(v) for c, v in {"honeypot_type": "cowrie", "dest_port": 22, "event_type": "t"}.items()})
    alerts = spark.createDataFrame(
        [("a1", "x", at(10)), ("a2", "x", at(11)), ("a3", "x", at(-10))], "alert_id string, source_ip_hash string, timestamp timestamp"
    ).withColumns({"alert_signature": F.col("alert_id"), "mitre_technique_id": F.lit("")})
    return events, alerts


@pytest.mark.parametrize("n", [100, None])
def test_only_pairs_within_ten_seconds(spark, rows, n):
    events, alerts = events_and_alerts(spark)
    out = intervals.correlate(events, alerts, "2024-01-02 00:00:00", n=n)
    assert [r[0] for r in rows(out, "alert_signature")] == ["a1", "a3"]


def test_top_n_equals_the_head_of_all_pairs(spark, rows):
    ev_ = spark.range(300).selectExpr("CAST(id AS STRING) AS event_id", "concat('s', id % 3) AS source_ip_hash",
                                      "timestamp_seconds(1704103200 + id * 7 % 900) AS timestamp", "'c' AS honeypot_type", "1 AS dest_port", "'t' AS event_type")
    al_ = spark.range(200).selectExpr("CAST(id AS STRING) AS alert_id", "concat('s', id % 3) AS source_ip_hash",
                                      "timestamp_seconds(1704103200 + id * 11 % 900) AS timestamp", "CAST(id AS STRING) AS alert_signature", "'' AS mitre_technique_id")
    every = intervals.correlate(ev_, al_, "2024-01-02 00:00:00", seconds=10, n=None).collect()
    some = intervals.correlate(ev_, al_, "2024-01-02 00:00:00", seconds=10, n=25).collect()
    assert len(every) > 300 and len(some) == 25
    newest = sorted((r.honeypot_time for r in every), reverse=True)[:25]
    assert [r.honeypot_time for r in some] == newest


def test_context_windows_equal_the_pairs(spark, rows):
    conns = spark.range(400).selectExpr("CAST(id AS STRING) AS uid", "concat('s', id % 4) AS source_ip_hash",
                                        "timestamp_seconds(1704103200 + id * 37 % 20000) AS timestamp", "'d' AS dest_ip", "1 AS dest_port")
    alerts = spark.range(12).selectExpr("CAST(id AS STRING) AS alert_id", "concat('s', id % 3) AS source_ip_hash",
                                        "timestamp_seconds(1704103200 + id * 1931 % 20000) AS timestamp")
    pairs = {r[0] for r in rows(intervals.alert_context(alerts, conns), "uid")}
    once = [r[0] for r in rows(intervals.context_windows(alerts, conns), "uid")]
    assert len(once) == len(set(once)) and set(once) == pairs and 0 < len(pairs) < 400


# --- profiles, rollups, evaluation


def test_additive_counters_are_added_once_per_date(spark, rows):
    base = profiles.build_profiles(
        spark.createDataFrame([("x", at(0), 22, "ssh", "", "t")], "source_ip_hash string, timestamp timestamp, dest_port int, protocol string, source_ip_country string, event_type string"),
        "2024-01-02 00:00:00",
    )
    creds = spark.createDataFrame([("x", at(5), True), ("x", at(6), False)], "source_ip_hash string, timestamp timestamp, success boolean")
    files = spark.createDataFrame([("x", at(5))], "source_ip_hash string, timestamp timestamp")
    cols = ["credential_attempts", "successful_logins", "files_downloaded"]
    once = profiles.add_daily_counts(base, creds, files, "2024-01-02")
    again = profiles.add_daily_counts(once, creds, files, "2024-01-02")
    next_day = profiles.add_daily_counts(again, creds, files, "2024-01-03")
    assert rows(once, *cols) == rows(again, *cols) == rows(next_day, *cols) == [(2, 1, 1)]


def test_merged_sketches_do_not_count_a_source_twice(spark, rows):
    df = spark.createDataFrame([("a", "k"), ("b", "k")], "source_ip_hash string, k string")
    part = rollups.sketched_rollup(df, ["k"], {"u": "source_ip_hash"})
    merged = rollups.estimate(rollups.merge_rollup(part, part, ["k"], ["event_count"], ["u"]), ["u"])
    assert rows(merged) == [("k", 4, 2)]


def test_eight_of_nine_scenarios_pass(spark, rows):
    results = spark.createDataFrame([(f"s{i}", int(i < 5), int(i == 7 or i in (5, 6)), "") for i in range(9)],
                                    "scenario string, events_count int, alerts_count int, technique string")
    assert rows(ev.effectiveness(results), "total", "honeypot_detected", "ids_detected", "tpr", "passed") == [(9, 5, 3, 0.889, True)]


def test_port_mapping_abuse(spark, rows):
    df = spark.createDataFrame([("x#AddPortMapping", ""), ("x#DeletePortMapping", ""), ("x#AddPortMapping", "<u:DeletePortMapping>"), ("x#Get", "")],
                               "soap_action string, body_preview string")
    assert rows(d.port_mapping_abuse(df), "attack_detected", "attack_type") == [
        (False, ""), (True, "AddPortMapping abuse"), (True, "DeletePortMapping abuse"), (True, "DeletePortMapping abuse"),
    ]


def test_ssdp_targets(spark, rows):
    df = spark.createDataFrame([(0, None), (1, "SSDP:ALL"), (2, "urn:other"), (3, "uuid:me")], "i int, search_target string")
    assert [r[1] for r in rows(d.ssdp_relevant(df, device_id="uuid:me"), "i", "relevant")] == [True, True, False, True]


def test_rtsp_overflow_and_brute_force(spark, rows):
    auth = "Basic " + "A" * 2048
    df = spark.createDataFrame([("s", at(i // 2), auth if i == 0 else "Basic x", "u") for i in range(6)],
                               "session_id string, timestamp timestamp, authorization string, url string")
    assert rows(d.rtsp_overflow(df), "detection_type", "count") == [("buffer_overflow", 2054)]
    assert rows(d.rtsp_bruteforce(df), "count") == [(6,)]


def test_web_exploits_of_known_inputs(spark, rows):
    bodies = ["' OR '1'='1", "' UNION SELECT NULL--"]
    agents = ["() { :; }; echo", "() { :;}; /bin/bash", "() { ignored; }; x :;", "() { _; } >_[$($())] { x; :; }"]
    table = [(b, "x", "POST") for b in bodies] + [("", u, "GET") for u in agents]
    df = spark.createDataFrame(table, "request_body string, user_agent string, method string").selectExpr(
        "*", "timestamp'2024-01-01' AS timestamp", "'s' AS source_ip_hash", "'/' AS uri", "'' AS referrer", "'h' AS host"
    )
    assert d.http_exploit(df, "shellshock").count() == 4
    assert d.http_exploit(df, "sql_injection").count() == 1


def test_encoded_traversal_is_seen(spark):
    uris = ["/..%2f..%2fetc", "/%2e%2e/%2e%2e/x", "/a%zz../x", "/plain"]
    df = spark.createDataFrame([(u,) for u in uris], "uri string").selectExpr(
        "*", "timestamp'2024-01-01' AS timestamp", "'s' AS source_ip_hash", "'' AS referrer", "'h' AS host", "'' AS user_agent", "'' AS request_body"
    )
    assert {r.note for r in d.http_exploit(df, "path_traversal").collect()} == set(uris[:3])


def test_high_rate_gives_a_row_only_above_the_limit(spark, rows):
    df = spark.range(20).selectExpr("timestamp_seconds(1704103170 + id) AS timestamp")
    assert rows(a.high_rate(df, "2024-01-01 10:00:00", limit=19)) == [(20,)]
    assert rows(a.high_rate(df, "2024-01-01 10:00:00", limit=20)) == []


def test_month_partitions_are_pruned(spark, tmp_path):
    from wardlake.functions.timing import since
    from wardlake.sources import tables

    events = spark.range(200).selectExpr("timestamp_seconds(1701388800 + id * 86400) AS timestamp", "CAST(id AS STRING) AS event_id")
    tables.append_table(events, "honeypot_events", str(tmp_path))
    stored = tables.read_table(spark, "honeypot_events", str(tmp_path))
    recent = since(stored, "2024-03-10 00:00:00", days=7)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "2024-03" in plan and "GreaterThanOrEqual(timestamp" in plan
    assert recent.count() == 8
    assert {r.month for r in tables.expired_months(spark, "honeypot_events", str(tmp_path), "2024-06-01").collect()} == {"2023-12", "2024-01", "2024-02"}
    assert tables.apply_ttl(stored, "2024-06-17 00:00:00", 90).count() == 90
