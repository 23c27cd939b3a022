"""Several sources, redelivery, bounded batches, maintained rollups, any address, sets and silence on streams."""

import ipaddress
import json
import os
import random
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_logs import SALT, drain, login, stream_of, write
from wardlake.operators import detections, geo, maintained, rollups
from wardlake.operators import normalise as n
from wardlake.operators import signatures as s
from wardlake.operators.folds import distinct_alarm
from wardlake.plans import alerts as al
from wardlake.plans import heavy
from wardlake.sources import logs, redelivery, tables
from wardlake.sources.tail import TailReader
from wardlake.streaming import ingest, rollup, stateful


def sessions(spark, root):
    return sorted(r.session_id for r in ingest.read_ingested(spark, "honeypot_events", root).collect())


# --- sources and batches


def test_sources_of_a_kind_share_a_root(spark, tmp_path):
    root = str(tmp_path / "t")
    write(tmp_path / "a" / "cowrie.json", [login(i, True) for i in range(5)])
    write(tmp_path / "b" / "cowrie.json", [login(i, True) for i in range(10, 13)])
    for host in ("a", "b", "a"):  # the third run finds nothing new
        ingest.ingest(spark, "cowrie", str(tmp_path / host), root, str(tmp_path / f"state-{host}"), SALT).awaitTermination()
    assert sessions(spark, root) == sorted(f"s{i}" for i in [*range(5), *range(10, 13)])


def test_a_retried_batch_of_one_source_replaces_only_itself(spark, tmp_path):
    lines = lambda name, k: spark.createDataFrame([(name, i, json.dumps(login(i, True))) for i in range(k)], "file string, offset long, value string")
    root = str(tmp_path / "t")
    for source, k in (("one", 4), ("two", 3), ("one", 4)):
        ingest.write_batch("cowrie", root, SALT, source=source)(lines(source, k), 0)
    assert len(sessions(spark, root)) == 7
    with pytest.raises(ValueError):
        ingest.tail_lines(spark, str(tmp_path), batch_bytes=10)


def test_redelivered_lines_are_stored_once(spark, tmp_path):
    root, folder = str(tmp_path / "t"), tmp_path / "in"
    write(folder / "cowrie.json", [login(i, True) for i in range(30)])
    run = lambda state: ingest.ingest(spark, "cowrie", str(folder), root, str(tmp_path / state), SALT, once_each=True, rollups=True).awaitTermination()
    run("one")
    with (folder / "cowrie.json").open("a") as f:
        f.write(json.dumps(login(40, True)) + "\n")
    run("two")  # a lost checkpoint: all lines again, and a new one
    assert sessions(spark, root) == sorted(f"s{i}" for i in [*range(30), 40])
    for table in ("credentials", "honeypot_events"):
        assert ingest.read_ingested(spark, table, root).count() == 31
    assert maintained.read_rollup(spark, "credential_stats", root).select(F.sum("attempt_count")).first()[0] == 31
    redelivery.compact_filters(spark, "honeypot_events", root, "2024-01")
    tables.compact(spark, "honeypot_events", root, "2024-01", 2)
    run("three")
    assert len(sessions(spark, root)) == 31
    stored = ingest.read_ingested(spark, "honeypot_events", root, lines=True)
    assert stored.select("line_id").distinct().count() == 31


def test_only_months_of_suspects_are_read(spark, tmp_path):
    root = str(tmp_path)
    at = lambda month, i: (datetime(2024, month, 1, i % 24), "cowrie", f"{month}-{i}")
    rows = spark.createDataFrame([at(m, i) for m in (1, 2, 3) for i in range(200)], "timestamp timestamp, honeypot_type string, line_id string")
    rows = tables.with_month(n.conform(rows, "honeypot_events"), "honeypot_events")
    tables.write_rows(rows, "honeypot_events", root, "b-0")
    redelivery.write_filters(rows, "honeypot_events", root, "b-0")
    new = spark.createDataFrame([at(2, 7), at(2, 9), (datetime(2024, 3, 1), "cowrie", "new")], "timestamp timestamp, honeypot_type string, line_id string")
    new = tables.with_month(new, "honeypot_events")
    found = redelivery.suspects(new, "honeypot_events", root, "b-1")
    assert {"2-7", "2-9"} <= {r.line_id for r in found.collect()}
    again = redelivery.stored_lines(found.filter("month = '2024-02'"), "honeypot_events", root, "b-1")
    assert sorted(r.line_id for r in again.collect()) == ["2-7", "2-9"]
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "2024-02" in plan and "2024-01" not in plan
    fresh, kept = redelivery.first_deliveries(new, "honeypot_events", root, "b-1")
    assert [r.line_id for r in fresh.collect()] == ["new"] and kept is not None
    own, _ = redelivery.first_deliveries(new, "honeypot_events", root, "b-0")
    assert own.count() == 3  # a retried batch is not its own repeat


def test_filters_miss_nothing_and_seldom_err(spark, tmp_path):
    ids = spark.range(20_000).selectExpr("timestamp_seconds(1704067200 + id % 40) AS timestamp", "concat('x', id) AS line_id", "'2024-01' AS month")
    redelivery.write_filters(ids, "honeypot_events", str(tmp_path), "b-0")
    assert redelivery.suspects(ids, "honeypot_events", str(tmp_path), "b-1").count() == 20_000
    others = ids.withColumn("line_id", F.concat(F.lit("y"), "line_id"))
    assert redelivery.suspects(others, "honeypot_events", str(tmp_path), "b-1").count() < 400


# --- the tailing source


def read_all(reader, limit=100):
    """Lines and batches until nothing new is planned; every batch starts where the one before ended."""
    got, at, batches, sizes = [], reader.initialOffset(), 0, []
    while batches < limit:
        end = json.loads(json.dumps(reader.latestOffset()))
        parts = reader.partitions(at, end)
        if not parts:
            return got, at, batches, sizes
        new = [v for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()]
        sizes.append(sum(p.stop - p.start for p in parts))
        got, at, batches = got + new, end, batches + 1
    raise AssertionError("never done")


def test_a_backlog_drains_in_bounded_batches(tmp_path):
    lines = []
    for k in range(40):
        own = [f"{k} " + "x" * ((7 * i) % 90) for i in range(30)]
        (tmp_path / f"{k:02d}.log").write_text("\n".join(own) + "\n")
        os.utime(tmp_path / f"{k:02d}.log", (1_700_000_000 + k, 1_700_000_000 + k))
        lines += own
    for limit in (500, 4000, 10**9):
        got, at, batches, sizes = read_all(TailReader({"path": str(tmp_path), "batchbytes": limit}), 1000)
        assert got == lines and max(sizes) < limit + 100
        assert (batches > 5) == (limit < 10**9) and len(at["files"]) == 40


def test_a_long_backlog_takes_few_more_batches(tmp_path):
    counts = []
    for k, size in enumerate((200, 2000, 20_000)):
        folder = tmp_path / str(k)
        folder.mkdir()
        lines = [f"{i:049d}" for i in range(size)]
        (folder / "a.log").write_text("\n".join(lines) + "\n")
        got, _, batches, sizes = read_all(TailReader({"path": str(folder), "batchbytes": 500, "catchup": 16}), 10**6)
        assert got == lines
        read = 0
        for taken in sizes:
            assert taken <= max(500, read / 16) + 50
            read += taken
        counts.append(batches)
    assert counts[2] - counts[1] <= 45 and counts[2] < 120  # 2 000 batches of 500 bytes


def test_a_long_line_is_not_cut(tmp_path):
    (tmp_path / "a.log").write_text("a\n" + "b" * 5000 + "\nc\n")
    got, _, batches, _ = read_all(TailReader({"path": str(tmp_path), "batchbytes": 10}))
    assert got == ["a", "b" * 5000, "c"] and batches == 3


def test_old_files_leave_the_offset(tmp_path):
    log_folder, state = tmp_path / "in", tmp_path / "state"
    log_folder.mkdir(), (state / "offsets").mkdir(parents=True)
    reader = TailReader({"path": str(log_folder), "checkpoint": str(state), "maxage": "100", "settle": "1e12"})
    at, got, kept = reader.initialOffset(), [], []
    for k in range(12):
        file = log_folder / f"{k}.log"
        file.write_text(f"line {k}\n")
        os.utime(file, (1_700_000_000 + 60 * k, 1_700_000_000 + 60 * k))
        end = reader.latestOffset()
        (state / "offsets" / str(k)).write_text("v1\n{}\n" + json.dumps(end))
        got += [v for p in reader.partitions(at, end) for b in reader.read(p) for v in b.column("value").to_pylist()]
        at = json.loads(json.dumps(end))
        kept.append(len(at["files"]))
    assert got == [f"line {k}" for k in range(12)] and max(kept) <= 3


def test_the_last_line_of_a_file_at_rest_needs_no_break(tmp_path):
    reader, log = TailReader({"path": str(tmp_path)}), tmp_path / "a.log"
    log.write_text("1\n2\n3")
    at = json.loads(json.dumps(reader.latestOffset()))
    lines = lambda a, b: [v for p in reader.partitions(a, b) for x in reader.read(p) for v in x.column("value").to_pylist()]
    assert lines(reader.initialOffset(), at) == ["1", "2"]
    log.rename(tmp_path / "a.log.1")  # rotated with its last line unfinished
    log.write_text("4\n5")
    now = json.loads(json.dumps(reader.latestOffset()))
    assert sorted(lines(at, now)) == ["3", "4"]
    os.utime(log, (1_700_000_000, 1_700_000_000))  # unchanged for long
    last = json.loads(json.dumps(reader.latestOffset()))
    assert lines(now, last) == ["5"]
    assert reader.partitions(last, reader.latestOffset()) == []


def test_ingestion_drains_a_backlog_and_survives_restarts(spark, tmp_path):
    folder, root, state = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "state")
    for k in range(6):
        write(folder / f"{k}.json", [login(10 * k + i, True) for i in range(8)])
    assert ingest.drain(spark, "cowrie", str(folder), root, state, SALT, batch_bytes=1500) > 3
    assert len(sessions(spark, root)) == 48
    write(folder / "7.json", [login(59, True)])
    assert ingest.drain(spark, "cowrie", str(folder), root, state, SALT, batch_bytes=1500) == 1
    assert len(sessions(spark, root)) == 49


def test_a_table_of_all_lines(spark, rows, tmp_path):
    (tmp_path / "c.json").write_text(f"{json.dumps(login(1, True))}\n\noops\n{json.dumps(login(2, True))}")
    good, bad = logs.read_log(spark, str(tmp_path), "cowrie")
    assert rows(good, "session") == [("s1",), ("s2",)] and good.select("line_id").distinct().count() == 2
    assert rows(bad, "reason") == [("empty",), ("unreadable",)]


# --- tables


def test_readers_see_a_rewrite_as_a_whole_or_not(spark, tmp_path):
    root = str(tmp_path)
    at = lambda *days: spark.createDataFrame([(datetime(2024, 1, d), "cowrie") for d in days], "timestamp timestamp, honeypot_type string")
    count = lambda: tables.read_table(spark, "honeypot_events", root).count()
    for d in (1, 2, 3):
        tables.append_table(at(d), "honeypot_events", root)

    def lost(rows, batch):
        tables.write_rows(rows, "honeypot_events", root, batch)
        raise RuntimeError("driver lost")

    with pytest.raises(RuntimeError):
        tables.rewrite(spark, f"{root}/honeypot_events", tables._stored_schema("honeypot_events"), "2024-01", lost)
    assert count() == 3
    seen = []
    delete = tables._delete
    try:
        tables._delete = lambda *a: (seen.append(count()), delete(*a))
        tables.compact(spark, "honeypot_events", root, "2024-01")
    finally:
        tables._delete = delete
    assert seen and set(seen) == {3} and count() == 3
    tables.append_table(at(4), "honeypot_events", root)
    tables.compact(spark, "honeypot_events", root, "2024-01")
    assert count() == 4 and len(list((tmp_path / "honeypot_events" / "month=2024-01").iterdir())) == 1


def test_days_expire(spark, rows, tmp_path):
    root = str(tmp_path)
    at = lambda *days: spark.createDataFrame([(datetime(2024, 1, d), "x") for d in days], "timestamp timestamp, uid string")
    tables.append_table(at(1, 10, 20), "network_connections", root)
    tables.append_table(at(2, 30), "network_connections", root)
    assert tables.expire(spark, "network_connections", root, "2024-02-14 00:00:00") == []
    assert rows(tables.read_table(spark, "network_connections", root), F.dayofmonth("timestamp")) == [(20,), (30,)]


# --- rollups


def test_rollups_of_three_batches_one_retried(spark, rows, tmp_path):
    rng = random.Random(1)
    events = [(datetime(2024, 1 + i % 2, 1 + i % 5), rng.choice("ab"), f"s{rng.randrange(20)}", rng.randrange(9), rng.choice(["", "DE", "FR"])) for i in range(600)]
    df = n.conform(spark.createDataFrame(events, "timestamp timestamp, honeypot_type string, source_ip_hash string, dest_port int, source_ip_country string"), "honeypot_events")
    df = df.withColumn("_p", F.pmod(F.xxhash64("source_ip_hash", "dest_port", "timestamp"), F.lit(3))).cache()
    for part in (0, 1, 2, 1):
        maintained.add_batch(df.filter(F.col("_p") == part).drop("_p"), "honeypot_events", str(tmp_path), f"b-{part}")
    for _ in range(2):
        for name, recompute in (("daily_attack_stats", rollups.daily_attack_stats), ("geographic_attack_stats", rollups.geographic_attack_stats)):
            want = recompute(df)
            assert rows(maintained.read_rollup(spark, name, str(tmp_path)), *want.columns) == rows(want)
            near = maintained.read_rollup(spark, name, str(tmp_path), exact=False)
            assert rows(near, *want.columns) == rows(want)  # so few values that a sketch counts them
        profiles = rollups.finish_profiles(rollups.profile_states(df))
        assert rows(maintained.read_profiles(spark, str(tmp_path)), *profiles.columns) == rows(profiles)
        for name in ("daily_attack_stats", "geographic_attack_stats", maintained.PROFILES):
            maintained.compact_rollup(spark, name, str(tmp_path), "2024-01")


# --- frequent groups and a curve


@pytest.mark.parametrize("skew", [True, False])
def test_frequent_groups_equal_the_full_way(spark, rows, skew):
    rng = random.Random(7)
    many = [(f"u{i}", None) for i in range(3000)]  # once each
    common = [(f"c{k}", "p" if k % 3 else None) for k in range(12) for _ in range(40 + 10 * k if skew else 1)] + [("tie", "a"), ("tie", "b")] * 45
    data = many + common
    rng.shuffle(data)
    df = spark.createDataFrame(data, "u string, p string").repartition(4)
    want = df.groupBy("u", "p").count().orderBy(F.desc("count"), "u", "p").limit(10)
    got = heavy.of_top(df, ["u", "p"], 10, 512).groupBy("u", "p").count()
    assert rows(got) == rows(want)
    left = heavy.candidates(df, ["u", "p"], 10, 512).count()
    assert left < 0.6 * len(data) if skew else left >= 0.5 * len(data)
    assert rows(heavy.of_top(df.limit(0), ["u", "p"], 10)) == []


def test_a_curve_lets_filters_on_any_column_skip(spark, tmp_path):
    import pyarrow.parquet as pq

    rng = random.Random(8)
    data = [(datetime(2024, 1, 1 + rng.randrange(28), rng.randrange(24)), f"{rng.randrange(1 << 30):08x}"[:6], f"C{rng.randrange(40)}") for _ in range(20_000)]
    df = spark.createDataFrame(data, "timestamp timestamp, source_ip_hash string, source_ip_country string")
    cols = ["timestamp", "source_ip_hash", "source_ip_country"]
    tables.append_table(df, "honeypot_events", str(tmp_path))
    tables.compact_by_curve(spark, "honeypot_events", str(tmp_path), "2024-01", cols, 64)
    assert tables.read_table(spark, "honeypot_events", str(tmp_path)).count() == len(data)
    groups = []
    for file in (tmp_path / "honeypot_events").rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            groups.append({c: (columns[c].min, columns[c].max) for c in cols[1:]})
    assert len(groups) >= 60
    for c, value in (("source_ip_hash", data[5][1]), ("source_ip_country", data[5][2])):
        read = [g for g in groups if g[c][0] <= value <= g[c][1]]
        assert 0 < len(read) < 0.5 * len(groups)


def test_a_row_finds_its_step_once(spark):
    data = [(k % 97 if k % 5 else None, f"s{k % 3}" if k % 7 else None, None) for k in range(300)]
    df = spark.createDataFrame(data, "n int, s string, z string").repartition(3)
    cols = ["n", "s", "z"]
    steps = df.select(*cols, *tables.curve_steps(df, cols)).collect()
    for at, c in enumerate(cols):
        values = sorted({r[at] for r in steps if r[at] is not None})
        count = min(64, len(values))
        bounds = [values[len(values) * k // count] for k in range(1, count)]
        assert all(r[3 + at] == (sum(b <= r[at] for b in bounds) * 64 // count if r[at] is not None else 0) for r in steps)
    out = tables.cluster_by_curve(df, cols, 4)
    assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    # a bound of the text column is compared once, not for each bit and each step of the Gray code
    assert out._jdf.queryExecution().optimizedPlan().toString().count("(s2 <= s#") == 1


# --- addresses


def test_addresses_in_all_spellings(spark):
    good = ["1.2.3.4", "255.255.255.255", "::", "::1", "2001:db8::1", "2001:DB8:0:0:0:0:0:1", "::ffff:1.2.3.4", "64:ff9b::1.2.3.4", "fe80::1%eth0",
            "[2001:db8::5]", " 1::8 ", "1:2:3:4:5:6:7:8", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8"]
    bad = ["", None, "1.2.3", "256.1.1.1", "1::2::3", "12345::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::1.2.3.400", "g::1", "word", ":1", "1:", ":::", "::ffff:1.2.3"]
    df = spark.createDataFrame([(t,) for t in good + bad], "ip string")
    got = {r.ip: r.h for r in df.select("ip", geo.address_hex("ip").alias("h")).collect()}
    for text in good:
        address = ipaddress.ip_address(text.strip().strip("[]").split("%")[0])
        number = int(address) + (0xFFFF << 32 if address.version == 4 else 0)
        assert got[text] == f"{number:032x}", text
    assert all(got[text] is None for text in bad), [t for t in bad if got[t]]


def test_narrowest_range_of_any_kind(spark, rows, tmp_path):
    rng = random.Random(4)
    ranges = []
    for i in range(120):
        if i % 2:
            low = rng.randrange(1 << 32)
            ranges.append((low + (0xFFFF << 32), min(low + rng.randrange(1 << rng.randrange(1, 30)), (1 << 32) - 1) + (0xFFFF << 32), f"c{i}"))
        else:
            low = (0x20010DB8 << 96) + rng.randrange(1 << 20)
            ranges.append((low, low + rng.randrange(1 << rng.randrange(1, 19)), f"c{i}"))
    ranges.append((0x20010DB8 << 96, (0x20010DB8 << 96) + (1 << 96) - 1, "wide"))
    text = lambda x: str(ipaddress.ip_address(x - (0xFFFF << 32))) if x >> 32 == 0xFFFF else str(ipaddress.IPv6Address(x))
    df = spark.createDataFrame([(text(a), text(b), c) for a, b, c in ranges], "start_ip string, end_ip string, country string")
    index = geo.build_geo_index(df, str(tmp_path / "geo"))
    asked = [x + d for a, b, _ in ranges for x in (a, b, (a + b) // 2) for d in (-1, 0, 1)]
    asked = [x for x in asked if x >> 32 != 0x10000 and x >> 32 != 0xFFFE]
    want = {}
    for x in asked:
        inside = [(b - a, c) for a, b, c in ranges if a <= x <= b]
        want[text(x)] = min(inside)[1] if inside else "?"
    told = spark.createDataFrame([(t,) for t in [*want, "junk", None]] + [("junk",)] * 5, "ip string")
    out = geo.geo_enrich(told, "ip", index, "country", "?")
    assert out.columns == ["ip", "country"] and out.count() == told.count()
    got = {r.ip: r.country for r in out.collect()}
    assert {k: got[k] for k in want} == want and got["junk"] == got[None] == "?"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path / "geo") in plan and "start_ip" not in plan  # the stored index is read, nothing is built
    assert geo.read_geo_index(spark, index.path) == index


def test_networks_as_ranges(spark, rows):
    df = spark.createDataFrame([("10.0.0.0/8", "a"), ("2001:db8::/33", "b"), ("1.2.3.4", "c"), ("junk/8", "d")], "network string, country string")
    got = {r.country: (r.start_ip, r.end_ip) for r in geo.networks(df).collect()}
    for text, c in (("10.0.0.0/8", "a"), ("2001:db8::/33", "b"), ("1.2.3.4/32", "c")):
        net = ipaddress.ip_network(text)
        mapped = 0xFFFF << 32 if net.version == 4 else 0
        assert got.pop(c) == tuple(f"{int(x) + mapped:032x}" for x in (net[0], net[-1]))
    assert got == {}


def test_micro_batches_read_the_stored_index(spark, rows, tmp_path):
    ranges = spark.createDataFrame([("1.0.0.0", "1.255.255.255", "AU"), ("2001:db8::", "2001:db8:ffff::", "DE")], "start_ip string, end_ip string, country string")
    index = geo.build_geo_index(ranges, str(tmp_path / "geo"))
    root, folder = str(tmp_path / "t"), tmp_path / "in"
    for k, ip in enumerate(("1.2.3.4", "2001:db8::7", "::ffff:1.9.9.9", "9.9.9.9")):
        write(folder / f"{k}.json", [login(k, True, src_ip=ip)])
        ingest.ingest(spark, "cowrie", str(folder), root, str(tmp_path / "state"), SALT, index).awaitTermination()
    assert rows(ingest.read_ingested(spark, "honeypot_events", root), "session_id", "source_ip_country") == [("s0", "AU"), ("s1", "DE"), ("s2", "AU"), ("s3", "")]


# --- rules and sides


def test_home_side_of_rules(spark):
    row = ("uname -a", "", "", "", "GET", "", "http", 80, "10.0.0.5", "s")
    cols = "payload string, uri string, user_agent string, header string, method string, body string, protocol string, dest_port int, dest_ip string, source_ip_hash string"
    df = spark.createDataFrame([row, (*row[:1], "/bins/a.mips", *row[2:8], "8.8.8.8", "t")], cols)
    sids = lambda **how: {(r.source_ip_hash, r.sid) for r in s.match_rules(df, **how).collect()}
    assert {("s", 2000034), ("t", 2000034), ("t", 2000029)} <= sids()
    sided = sids(home=["10.0.0.0/8", "2001:db8::/32"])
    assert ("s", 2000034) in sided and ("t", 2000034) not in sided and ("t", 2000029) in sided


def test_rules_without_their_columns_are_an_error(spark):
    df = spark.createDataFrame([("x", "tcp", 22, "s")], "payload string, protocol string, dest_port int, source_ip_hash string")
    with pytest.raises(ValueError, match="2000010"):
        s.match_rules(df)
    assert s.match_rules(df, without=s.not_evaluated(df)).count() == 0


# --- streams


def test_stream_set_counter_equals_the_batch_one(spark, rows, tmp_path):
    rng = random.Random(2)
    df = spark.createDataFrame([(f"k{rng.randrange(4)}", rng.randrange(6), 1704067200 + rng.randrange(4000)) for _ in range(500)], "k string, item int, sec long")
    df = df.select("k", "item", F.timestamp_seconds("sec").alias("timestamp"))
    out = drain(spark, stateful.stream_distinct_alarm(stream_of(spark, tmp_path, df), "k", "item", 4, 200, "30 seconds"), tmp_path)
    closed = df.agg(F.max(F.unix_timestamp("timestamp"))).first()[0] - 30
    want = [r for r in rows(distinct_alarm(df, ["k"], "item", 4, 200)) if r[1] + 1 <= closed]
    assert want and rows(out) == want


def test_stream_services_equal_the_batch_ones(spark, rows, tmp_path):
    rng = random.Random(3)
    df = spark.createDataFrame([(f"h{rng.randrange(3)}", f"p{rng.randrange(5)}", 1704067200 + rng.randrange(3000)) for _ in range(300)], "host string, service string, sec long")
    df = df.select("host", "service", F.timestamp_seconds("sec").alias("timestamp"))
    out = drain(spark, stateful.stream_new_services(stream_of(spark, tmp_path, df), "host", "service", 400, "30 seconds"), tmp_path)
    closed = df.agg(F.max(F.unix_timestamp("timestamp"))).first()[0] - 30
    want = detections.new_sightings(df, ["host", "service"], 400).filter(F.unix_timestamp("first_seen") + 1 <= closed)
    assert rows(out) == rows(want) and out.count() > 30


class _Store:
    """State of one key in memory, with the number of times it was asked or told something."""

    def __init__(self):
        self.value, self.entries, self.timers, self.calls = None, {}, set(), 0

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, *schemas):
        store = self

        class Map:
            def containsKey(self, k):
                store.calls += 1
                return k in store.entries

            def updateValue(self, k, v):
                store.calls += 1
                store.entries[k] = v

            def clear(self):
                store.calls += 1
                store.entries.clear()

        return Map()

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def _fed(processor, store, batches, key):
    processor.init(store)
    return [tuple(r) for b in batches for f in processor.handleInputRows(key, iter([b]), None) for r in f.itertuples(index=False)]


def test_set_counters_ask_the_store_per_item_and_not_per_row():
    rng = random.Random(12)
    seen = sorted((rng.randrange(6000), f"i{rng.randrange(6)}") for _ in range(6000))
    frame = lambda part: pd.DataFrame([(s, i, 1) for s, i in part], columns=["sec", "item", "cnt"])
    want, start, items, at = [], None, set(), {}
    for sec, item in seen:
        if start is None or sec >= start + 300:
            start, items = sec, set()
        items.add(item)
        at[sec] = (start, len(items), at.get(sec, (0, 0, 0))[2] + 1)
    want = [("k", sec, a, hits, known) for sec, (a, known, hits) in at.items() if known >= 3]
    cuts = [k for k in (0, 1500, 1501, 4000, 6000)]
    while any(0 < c < len(seen) and seen[c - 1][0] == seen[c][0] for c in cuts):  # seconds arrive whole
        cuts = [c + (0 < c < len(seen) and seen[c - 1][0] == seen[c][0]) for c in cuts]
    store = _Store()
    got = _fed(stateful._distinct_counter(3, 300), store, [frame(seen[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b], ("k",))
    assert got == want
    assert store.timers == {(start + 300) * 1000} and set(store.entries) == {(i,) for i in items}
    assert store.calls <= 4 * 16


def test_sightings_jump_from_one_to_the_next():
    rng = random.Random(13)
    secs = sorted(rng.randrange(9000) for _ in range(5000))
    want = []
    for sec in secs:
        if not want or sec >= want[-1] + 400:
            want.append(sec)
    batches = [pd.DataFrame({"sec": rng.sample(secs[a:b], b - a)}) for a, b in ((0, 1000), (1000, 1001), (1001, 5000))]
    store = _Store()
    assert _fed(stateful._sightings(400), store, batches, ("h", "p")) == [("h", "p", sec) for sec in want]
    assert store.timers == {(want[-1] + 400) * 1000} and store.value == (want[-1],)
    assert store.calls <= 3 * 3


def test_stream_rollup_counts_distinct_values_exactly(spark, rows, tmp_path):
    df = spark.range(60_000).selectExpr(
        "timestamp_seconds(1704067200 + id * 3) AS timestamp", "IF(id % 4 = 0, NULL, 'a') AS honeypot_type", "'e' AS event_type",
        "IF(id % 50 = 0, NULL, concat('s', id % 20000)) AS source_ip_hash", "CAST(IF(id % 3 = 0, NULL, id % 9000) AS INT) AS dest_port")
    out = drain(spark, rollup.stream_rollup(stream_of(spark, tmp_path, df), "1 day"), tmp_path)
    day = F.date_trunc("day", "timestamp").alias("window_start")
    want = df.filter("timestamp < '2024-01-03'").groupBy(day, "honeypot_type", "event_type").agg(
        F.count("*"), F.count_distinct("source_ip_hash"), F.count_distinct("dest_port"))
    assert rows(out) == rows(want) and out.count() == 4


def test_stream_ssh_log_equals_the_batch_log(spark, rows, tmp_path):
    rng = random.Random(5)
    second = lambda: 1704067200 + rng.randrange(4000)
    auth = spark.createDataFrame([(second(), f"s{rng.randrange(3)}", f"d{rng.randrange(2)}", 22, rng.random() < 0.2) for _ in range(300)],
                                 "sec long, source_ip_hash string, dest_ip string, dest_port int, authenticated boolean")
    conns = spark.createDataFrame([(second(), f"s{rng.randrange(3)}", f"d{rng.randrange(2)}", 22, "ssh", rng.choice(["", "ssh"]), rng.random() * 10) for _ in range(200)],
                                  "sec long, source_ip_hash string, dest_ip string, dest_port int, protocol string, service string, duration double")
    timed = lambda df: df.withColumn("timestamp", F.timestamp_seconds("sec")).drop("sec")
    auth, conns = timed(auth), timed(conns)
    creds = spark.createDataFrame([], "timestamp timestamp, source_ip_hash string, username string")
    parts = [stream_of(spark, tmp_path / name, df) for name, df in (("a", auth), ("c", conns))]
    out = drain(spark, stateful.stream_ssh_log(*parts, None, 5, 6, 600, watermark="30 seconds"), tmp_path)
    closed = min(df.agg(F.max(F.unix_timestamp("timestamp"))).first()[0] for df in (auth, conns)) - 30
    counted = lambda df: rows(df.filter("conn_attempts IS NOT NULL").filter(F.unix_timestamp("ts") + 1 <= closed))
    want = detections.ssh_log(auth, conns, creds, 5, 6, 600)
    assert counted(out) == counted(want) and len(counted(out)) > 20
    assert rows(out.filter("detection_type = 'scanner'")) == rows(want.filter("detection_type = 'scanner'"))


def test_silence_becomes_a_state(spark, rows, tmp_path):
    base = 1704067200
    minutes = [(0, "a"), (1, "a"), (2, "a"), (12, "a"), *[(m, "b") for m in range(20)]]
    df = spark.createDataFrame([(r, base + 60 * m, False) for m, r in minutes], "rule string, sec long, breach boolean")
    df = df.select("rule", F.timestamp_seconds("sec").alias("minute"), "breach", F.timestamp_seconds("sec").alias("timestamp"))
    states = stateful.stream_alert_states(stream_of(spark, tmp_path, df).drop("timestamp"), 2, "1 minute", {"a": "Alerting"})
    out = drain(spark, states, tmp_path)
    lo, hi = "2024-01-01 00:00:00", "2024-01-01 00:17:00"
    series = df.filter("rule = 'a'").select("rule", "minute", F.lit(0.0).alias("value"))
    filled = al.fill_states(series, lo, hi, {"a": 1.0}, {"a": ("Alerting", "Error")})
    assert rows(out) == rows(al.evaluate(filled, 2)) and ("firing",) in rows(out, "state")


def test_a_clock_tells_of_silence_of_all_rules(spark, rows, tmp_path):
    base = 1704067200
    df = spark.createDataFrame([("a", base + 60 * m, False) for m in range(3)], "rule string, sec long, breach boolean")
    df = df.select("rule", F.timestamp_seconds("sec").alias("minute"), "breach", F.timestamp_seconds("sec").alias("timestamp"))
    clock = spark.range(12).select(F.timestamp_seconds(F.lit(base) + 60 * F.col("id")).alias("minute"), F.timestamp_seconds(F.lit(base) + 60 * F.col("id")).alias("timestamp"))
    streams = [stream_of(spark, tmp_path / x, f).drop("timestamp") for x, f in (("s", df), ("c", clock))]
    out = drain(spark, stateful.stream_alert_states(streams[0], 2, "1 minute", {"a": "Alerting"}, streams[1]), tmp_path)
    assert [(r[0].minute, r[1]) for r in rows(out, "minute", "state")] == [(3, "pending"), (4, "pending"), *[(m, "firing") for m in range(5, 10)]]
