"""A third of all rows in one source, joins without broadcast."""

import pytest
from pyspark.sql import functions as F

import loops
from wardlake.operators import detections as d
from wardlake.operators import folds, intervals, profiles
from wardlake.plans import analytics as a

N = 6000


@pytest.fixture(scope="module", autouse=True)
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1KB")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4KB")
    yield
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        spark.conf.unset(key)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("skew") / "events")
    spark.range(N, numPartitions=6).selectExpr(
        "IF(id % 3 = 0, 'hot', concat('s', id % 40)) AS source_ip_hash", "timestamp_seconds(1704067200 + id * 7919 % 3600) AS timestamp",
        "CAST(id AS STRING) AS event_id", "CAST(id AS STRING) AS uid", "element_at(array(22, 23, 80, 8080), CAST(id % 4 AS INT) + 1) AS dest_port",
        "'cowrie' AS honeypot_type", "'tcp' AS protocol", "'x' AS event_type", "concat('C', id % 3) AS source_ip_country", "'d' AS dest_ip",
        "id % 11 = 0 AS authenticated",
    ).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def plain(events):
    return [(r.source_ip_hash, int(r.s), r.event_id, r.dest_port, r.authenticated)
            for r in events.withColumn("s", F.unix_timestamp("timestamp")).collect()]


def alerts_of(events):
    return events.filter("uid % 29 = 0").select(
        "source_ip_hash", "timestamp", F.col("uid").alias("alert_id"), F.lit("a").alias("alert_signature"),
        F.lit("").alias("mitre_technique_id"), F.lit(1).alias("signature_id"),
    )


def test_counters(events, plain, rows):
    got = folds.count_alarm(events, ["source_ip_hash"], 9, 120, "threshold")
    assert rows(got, "source_ip_hash", "sec", "hit") == loops.alarm([p[:2] for p in plain], 9, 120, "threshold")
    ports = folds.distinct_alarm(events, ["source_ip_hash"], "dest_port", 3, 120)
    assert rows(ports, "source_ip_hash", "sec", "hits", "distinct_items") == loops.distinct([(p[0], p[1], p[3]) for p in plain], 3, 120)


def test_logins(events, plain, rows):
    ordered = [(k, s, ok) for k, s, _, _, ok in plain]
    brute, won = loops.logins(ordered, 6, 300)
    assert rows(d.ssh_bruteforce(events, 6, 300), "source", F.unix_timestamp("ts"), "count") == brute
    assert rows(d.ssh_success_after_failures(events, 300), "source", F.unix_timestamp("ts"), "count") == won


def test_pairs_and_existence(events, plain, rows):
    alerts = alerts_of(events)
    marks = [p for p in plain if int(p[2]) % 29 == 0]
    near = [(p, m) for m in marks for p in plain if p[0] == m[0] and abs(p[1] - m[1]) <= 10]
    pairs = intervals.correlate(events, alerts, "2024-01-02 00:00:00", n=None)
    assert pairs.count() == len(near)
    alive = intervals.near_exists(events, alerts, "source_ip_hash", 10, "timestamp", "timestamp")
    assert {r[0] for r in rows(alive, "event_id")} == {p[2] for p, _ in near}
    top = intervals.correlate(events, alerts, "2024-01-02 00:00:00", n=50).select(F.unix_timestamp("honeypot_time"))
    assert sorted((r[0] for r in top.collect()), reverse=True) == sorted((p[1] for p, _ in near), reverse=True)[:50]


def test_anti_joins(spark, events, plain, rows):
    known = profiles.build_profiles(events.filter("source_ip_hash = 'hot'"), "2024-01-02 00:00:00")
    fresh = profiles.new_profiles(events, known, "2024-01-02 00:00:00")
    assert {r[0] for r in rows(fresh, "source_ip_hash")} == {p[0] for p in plain} - {"hot"}
    test_sources = spark.createDataFrame([("hot",)], "ip_hash string")
    left = a.false_positive_candidates(alerts_of(events), test_sources, "2024-01-01", "2024-01-02", 10)
    kept = [p for p in plain if int(p[2]) % 29 == 0 and p[0] != "hot"]
    assert rows(left, "alert_count", "unique_sources") == [(len(kept), len({p[0] for p in kept}))]
