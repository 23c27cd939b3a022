import random

import pytest
from pyspark.sql import functions as F

import loops
from wardlake.operators import detections as d
from wardlake.operators import folds

T0 = 1_704_067_200


def hits(spark, events, *extra):
    names = ["source_ip_hash", "sec", *extra]
    df = spark.createDataFrame(events, names)
    return df.withColumn("timestamp", F.timestamp_seconds("sec")).drop("sec")


def sample(seed, n=200, keys=4, span=1500):
    rnd = random.Random(seed)
    # one key holds about half of all rows
    return [(rnd.choice(["hot", "hot", "hot"] + [f"k{i}" for i in range(keys - 1)]), T0 + rnd.randrange(span)) for _ in range(n)]


@pytest.mark.parametrize("mode", ["threshold", "both", "limit", "every"])
@pytest.mark.parametrize("seed", [1, 2])
def test_modes_match_a_loop(spark, rows, mode, seed):
    events = sample(seed)
    fired = folds.count_alarm(hits(spark, events), ["source_ip_hash"], 4, 60, mode)
    assert rows(fired, "source_ip_hash", "sec", "hit") == loops.alarm(events, 4, 60, mode)


def test_reset_on_fire_equals_every_nth_hit(spark, rows):
    events = sample(3, 300)
    fired = folds.count_alarm(hits(spark, events), ["source_ip_hash"], 5, 300, "threshold")
    assert rows(fired, "source_ip_hash", "sec") == loops.zeek_reset(events, 5, 300)


def test_rates_of_twelve_hits(spark, rows):
    events = [("a", T0 + 5 * i) for i in range(12)]
    df = hits(spark, events)
    got = {m: [r[2] for r in rows(folds.count_alarm(df, ["source_ip_hash"], 5, 60, m), "source_ip_hash", "sec", "hit")]
           for m in ("threshold", "both", "limit")}
    assert got == {"threshold": [5, 10], "both": [5], "limit": [1, 2, 3, 4, 5]}


def test_many_hits_in_one_second(spark, rows):
    events = [("a", T0)] * 23 + [("a", T0 + 1)] * 4
    fired = folds.count_alarm(hits(spark, events), ["source_ip_hash"], 5, 60, "threshold")
    assert rows(fired, "sec", "hit") == [(T0, 5), (T0, 10), (T0, 15), (T0, 20), (T0 + 1, 25)]


def test_telnet_scan_fires_once_at_the_fifth(spark, rows):
    at = [0, 60, 120, 180, 240, 270]
    df = hits(spark, [("a", T0 + s, 23, 1.0) for s in at], "dest_port", "duration")
    out = d.telnet_scan(df)
    assert [r[0] for r in rows(out, F.unix_timestamp("ts"))] == [T0 + 240]


def test_window_is_anchored_at_its_first_hit(spark, rows):
    at = [0, 60, 120, 240, 301]
    df = hits(spark, [("a", T0 + s, 23, 1.0) for s in at], "dest_port", "duration")
    assert rows(d.telnet_scan(df)) == []


def test_distinct_items_match_a_loop(spark, rows):
    rnd = random.Random(5)
    events = [(k, s, rnd.choice([22, 23, 80, 2323])) for k, s in sample(5, 200, span=600)]
    out = folds.distinct_alarm(hits(spark, events, "dest_port"), ["source_ip_hash"], "dest_port", 3, 120)
    assert rows(out, "source_ip_hash", "sec", "hits", "distinct_items") == loops.distinct(events, 3, 120)


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_logins_match_a_loop(spark, rows, seed):
    rnd = random.Random(seed)
    events = sorted({(k, s) for k, s in sample(seed, 200, span=900)})
    events = [(k, s, rnd.random() < 0.15) for k, s in events]
    df = hits(spark, events, "authenticated")
    brute, won = loops.logins(events, 3, 200)
    key = ["source", F.unix_timestamp("ts"), "count"]
    assert rows(d.ssh_bruteforce(df, 3, 200), *key) == brute
    assert rows(d.ssh_success_after_failures(df, 200), *key) == won


def test_success_resets_the_count(spark, rows):
    df = hits(spark, [("a", T0 + i, i == 3) for i in range(5)], "authenticated")
    out = d.ssh_success_after_failures(df)
    assert rows(out, F.unix_timestamp("ts"), "count") == [(T0 + 3, 3)]


@pytest.mark.parametrize("seed", [11, 12])
def test_rapid_logins_match_a_loop(spark, rows, seed):
    tries, shorts = sample(seed, 150, span=900), sample(seed + 50, 100, span=900)
    auth = hits(spark, [(k, s, False) for k, s in tries], "authenticated")
    conns = hits(spark, [(k, s, 22, "ssh", 1.0) for k, s in shorts], "dest_port", "protocol", "duration")
    out = d.ssh_rapid(auth, conns, 6, 200)
    assert rows(out, "source", F.unix_timestamp("ts"), "count") == loops.rapid(tries, shorts, 6, 200)


def test_fifteen_attempts_fire_once(spark, rows):
    df = hits(spark, [("a", T0 + 30 * i, False) for i in range(16)], "authenticated")
    assert rows(d.ssh_rapid(df), F.unix_timestamp("ts"), "count") == [(T0 + 30 * 14, 15)]


def test_trailing_count_matches_a_loop(spark, rows):
    events = sample(21, 150, span=600)
    out = folds.trailing_count(hits(spark, events), ["source_ip_hash"], 60, 3)
    assert rows(out, "source_ip_hash", "sec", "hit") == loops.trailing(events, 60, 3)


def test_first_in_window_keeps_the_opening_row(spark, rows):
    df = hits(spark, [("a", T0, "x"), ("a", T0 + 10, "y"), ("a", T0 + 61, "z"), ("b", T0 + 5, "w")], "note")
    out = folds.first_in_window(df, ["source_ip_hash"], 60)
    assert rows(out, "source_ip_hash", "note") == [("a", "x"), ("a", "z"), ("b", "w")]


def test_a_key_is_carried_across_batches(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        events = sample(31, 120, keys=2)
        fired = folds.count_alarm(hits(spark, events), ["source_ip_hash"], 4, 300, "threshold")
        assert rows(fired, "source_ip_hash", "sec", "hit") == loops.alarm(events, 4, 300, "threshold")
        ports = [(k, s, s % 3) for k, s in events]
        out = folds.distinct_alarm(hits(spark, ports, "dest_port"), ["source_ip_hash"], "dest_port", 3, 120)
        assert rows(out, "source_ip_hash", "sec", "hits", "distinct_items") == loops.distinct(ports, 3, 120)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_null_keys_are_a_key_of_their_own(spark, rows):
    df = hits(spark, [(None, T0), (None, T0 + 1), ("", T0 + 2), ("", T0 + 3)])
    fired = folds.count_alarm(df, ["source_ip_hash"], 2, 60, "both")
    assert rows(fired, "source_ip_hash", "sec") == [("", T0 + 3), (None, T0 + 1)]


@pytest.mark.parametrize("seed", [41, 42])
def test_ssh_log_matches_a_loop(spark, rows, seed):
    rnd = random.Random(seed)
    tries = [(k, s, rnd.random() < 0.15) for k, s in sample(seed, 250, span=900)]
    shorts = sample(seed + 50, 80, span=900)
    auth = hits(spark, [(*t, "10.0.0.1", 22) for t in tries], "authenticated", "dest_ip", "dest_port")
    conns = hits(spark, [(k, s, "10.0.0.1", 22, "ssh", 4.0, "ssh") for k, s in shorts], "dest_ip", "dest_port", "protocol", "duration", "service")
    creds = spark.createDataFrame([(T0, "a", "oracle")], "t long, source_ip_hash string, username string").withColumn("timestamp", F.timestamp_seconds("t"))
    log = d.ssh_log(auth, conns, creds, fails=4, rapid=6, window=200)
    counted = log.filter("detection_type <> 'weak_credentials'")
    assert rows(counted, "src", F.unix_timestamp("ts"), "detection_type", "conn_attempts", "failed_logins") == loops.ssh_log(tries, shorts, 4, 6, 200)
    assert rows(log.filter("detection_type = 'weak_credentials'"), "src", "dst_port", "note") == [("a", 22, "oracle")]
    assert {r[0] for r in rows(counted, "dst")} == {"10.0.0.1"}
