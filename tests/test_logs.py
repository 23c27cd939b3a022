import gzip
import json
from datetime import datetime

from pyspark.sql import functions as F

import loops
from wardlake.operators import normalise as n
from wardlake.sources import logs, tables
from wardlake.sources.tail import TailReader
from wardlake.streaming import ingest, stateful

SALT = "salt"


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def login(i, ok, **more):
    return {"timestamp": f"2024-01-01T00:00:{i:02d}.5Z", "eventid": f"cowrie.login.{'success' if ok else 'failed'}", "src_ip": "1.2.3.4",
            "session": f"s{i}", "username": "root", "password": "x", "dst_port": 22, **more}


def test_json_log_keeps_lines_and_skips_junk(spark, rows, tmp_path):
    write(tmp_path / "cowrie.json", [login(1, True, extra="?"), "", "not json", login(2, False)])
    df = logs.read_json_log(spark, str(tmp_path), "cowrie")
    assert rows(df, "session", "dst_port") == [("s1", 22), ("s2", 22)]
    assert json.loads(rows(df, "raw_data")[0][0])["extra"] == "?"


def test_zeek_tsv(spark, rows, tmp_path):
    line = ["1704067200.7", "C1", "1.2.3.4", "1000", "5.6.7.8", "23", "tcp", "-", "-", "-", "7"] + ["SF"] + ["-"] * 8
    write(tmp_path / "conn.log", ["#separator \\x09", "#fields\tts", "", "\t".join(line)])
    write(tmp_path / "conn.log.gz", ["rubbish"])
    df = n.zeek_conn_normalise(logs.read_zeek_tsv(spark, str(tmp_path)), SALT)
    assert rows(df, "uid", "dest_port", "payload_size") == [("C1", "23", 7)]
    table = n.conform(df, "network_connections")
    assert rows(table, "service", "duration", "orig_bytes", "resp_bytes") == [("", 0.0, 0, 7)]


def test_zeek_json_kinds(spark, rows, tmp_path):
    ids = {"id.orig_h": "1.2.3.4", "id.orig_p": 9, "id.resp_h": "5.6.7.8", "id.resp_p": 53}
    write(tmp_path / "dns.log", [{"ts": 1704067200.1, "uid": "D", **ids, "query": "xmr.nanopool.org"}])
    write(tmp_path / "ssh.log", [{"ts": 1704067200.1, "uid": "S", **ids, "auth_success": True}, {"ts": 1704067201.0, "uid": "T", **ids}])
    dns = logs.read_zeek_json(spark, str(tmp_path), "dns")
    assert rows(dns, "type", "query") == [("zeek_dns", "xmr.nanopool.org")]
    assert rows(n.zeek_dns_queries(dns, SALT), F.unix_timestamp("timestamp"), "query") == [(1704067200, "xmr.nanopool.org")]
    auth = n.zeek_ssh_auth(logs.read_zeek_json(spark, str(tmp_path), "ssh"), SALT)
    assert rows(auth, "dest_port", "authenticated") == [(53, False), (53, True)]


def test_flat_and_nested_ids_agree(spark, rows, tmp_path):
    base = {"ts": 1704067200.0, "uid": "C", "orig_bytes": 1}
    write(tmp_path / "conn.log", [{**base, "id": {"orig_h": "1.2.3.4", "resp_p": 22}}, {**base, "id.orig_h": "1.2.3.4", "id.resp_p": 22}])
    out = n.conform(n.zeek_conn_normalise(logs.read_zeek_json(spark, str(tmp_path), "conn"), SALT), "network_connections")
    first, second = rows(out)
    assert first == second and first[6] == 22


def test_fan_out_of_one_log(spark, rows, tmp_path):
    lines = [login(1, True), login(2, False), {"timestamp": "2024-01-01T00:00:03Z", "eventid": "cowrie.session.file_download", "src_ip": "1.2.3.4",
             "session": "s3", "shasum": "ab", "url": "http://x", "outfile": "/o"}]
    write(tmp_path / "in" / "cowrie.json", lines)
    root, checkpoint = str(tmp_path / "tables"), str(tmp_path / "state")
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(spark, "cowrie", str(tmp_path / "in"), root, checkpoint, SALT).awaitTermination()
    counts = {t: ingest.read_ingested(spark, t, root).count() for t in ("honeypot_events", "credentials", "downloaded_files")}
    assert counts == {"honeypot_events": 3, "credentials": 2, "downloaded_files": 1}
    write(tmp_path / "in" / "cowrie2.json", [login(4, True)])
    ingest.ingest(spark, "cowrie", str(tmp_path / "in"), root, checkpoint, SALT).awaitTermination()
    events = ingest.read_ingested(spark, "honeypot_events", root)
    assert rows(events, "session_id", "success") == [("s1", True), ("s2", False), ("s3", False), ("s4", True)]
    assert "src_ip" not in events.columns


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    write(tmp_path / "in" / "cowrie.json", [login(1, True), login(2, True)])
    lines = spark.read.text(str(tmp_path / "in")).selectExpr("'f' AS file", "0L AS offset", "value")
    run = ingest.write_batch("cowrie", str(tmp_path / "t"), SALT)
    run(lines, 0)
    run(lines, 0)
    assert ingest.read_ingested(spark, "honeypot_events", str(tmp_path / "t")).count() == 2


def test_download_hash_must_be_sha256(spark, rows):
    df = spark.createDataFrame([("m", "a" * 128), (None, "b" * 64), (None, None)], "md5_hash string, sha512_hash string")
    assert rows(n.dionaea_downloads(df), "md5_hash", "sha256_hash") == [("", "b" * 64), ("m", "")]


def test_export_and_import(spark, rows, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:00:00", "old"), ("2024-01-09 00:00:00", "new")], "timestamp string, event_id string")
    events = n.conform(events, "honeypot_events")
    paths = tables.export_tables({"honeypot_events": events}, "2024-01-10 00:00:00", str(tmp_path / "out"))
    back = tables.import_table(spark, paths["honeypot_events"], "honeypot_events", str(tmp_path / "tables"))
    assert rows(back, "event_id", "month") == [("new", "2024-01")]


def test_evolve_adds_and_keeps(spark, rows):
    df = spark.createDataFrame([("a", None), ("b", "X")], "k string, source_ip_country string")
    out = tables.evolve(df, {"source_ip_country": "string", "n": "int", "flag": "string"}, {"flag": "?"})
    assert rows(out) == [("a", "", 0, "?"), ("b", "X", 0, "?")]


def stream_of(spark, tmp_path, df, parts=3):
    """A stream that delivers ``df`` in time order over several micro-batches."""
    path = str(tmp_path / "stream")
    edges = [r[0] for r in df.select(F.unix_timestamp("timestamp")).orderBy("timestamp").collect()]
    cuts = [edges[len(edges) * i // parts] for i in range(parts)] + [edges[-1] + 1]
    for lo, hi in zip(cuts, cuts[1:]):
        sec = F.unix_timestamp("timestamp")
        df.filter((sec >= lo) & (sec < hi)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, sdf, tmp_path):
    out = str(tmp_path / "out")
    sdf.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.schema(sdf.schema).parquet(out)


def test_stream_counter_equals_the_batch_fold(spark, rows, tmp_path):
    events = [("hot" if i % 3 else f"k{i % 5}", 1704067200 + i * 7) for i in range(200)]
    df = spark.createDataFrame(events, "source_ip_hash string, sec long").select("source_ip_hash", F.timestamp_seconds("sec").alias("timestamp"))
    fired = drain(spark, stateful.stream_count_alarm(stream_of(spark, tmp_path, df), "source_ip_hash", 4, 120, "threshold", "30 seconds"), tmp_path)
    closed = max(s for _, s in events) - 30
    assert rows(fired) == [r for r in loops.alarm(events, 4, 120, "threshold") if r[1] + 1 <= closed]


def test_append_routed_and_aliases(spark, rows, tmp_path):
    from wardlake.schemas import ALIASES

    df = spark.createDataFrame(
        [("2024-01-01 00:00:00", "cowrie", "u", "p"), ("2024-02-01 00:00:00", "dionaea", None, None)],
        "timestamp string, honeypot_name string, username string, password string",
    )
    df = n.rename_aliases(df, ALIASES)
    assert "honeypot_type" in df.columns
    tables.append_routed(df, {"honeypot_events": lambda x: x, "credentials": n.to_credentials}, str(tmp_path))
    assert rows(tables.read_table(spark, "honeypot_events", str(tmp_path)), "month", "honeypot_type") == [("2024-01", "cowrie"), ("2024-02", "dionaea")]
    assert rows(tables.read_table(spark, "credentials", str(tmp_path)), "username", "month") == [("u", "2024-01")]


def test_cluster_by_spreads_a_frequent_value(spark):
    df = spark.range(4000).selectExpr("IF(id % 10 < 9, 'hot', 'cold') AS c", "timestamp_seconds(id) AS timestamp")
    out = tables.cluster_by(df, ["c"], 8)
    sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) >= 6 and max(sizes) < 1500


def test_stream_dedupe_keeps_one_per_identifier(spark, rows, tmp_path):
    df = spark.range(60).selectExpr("timestamp_seconds(1704067200 + id) AS ts", "'k' AS detection_type", "concat('s', id % 3) AS identifier")
    path = str(tmp_path / "stream")
    df.write.parquet(path)
    out = drain(spark, stateful.stream_dedupe(spark.readStream.schema(df.schema).parquet(path)), tmp_path)
    assert rows(out, "identifier") == [("s0",), ("s1",), ("s2",)]


def test_a_growing_and_rotated_log_loses_no_line(spark, rows, tmp_path):
    folder, root, checkpoint = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "state")
    folder.mkdir()
    log = folder / "cowrie.json"

    def sessions():
        ingest.ingest(spark, "cowrie", str(folder), root, checkpoint, SALT, pattern="cowrie.json*").awaitTermination()
        return [r[0] for r in rows(tables.read_table(spark, "honeypot_events", root), "session_id")]

    text = lambda i: json.dumps(login(i, True)) + "\n"
    log.write_text(text(1))
    assert sessions() == ["s1"]
    with log.open("a") as f:
        f.write(text(2) + text(3) + text(4)[:20])
    assert sessions() == ["s1", "s2", "s3"]  # the unfinished line waits
    with log.open("a") as f:
        f.write(text(4)[20:] + text(5))
    log.rename(folder / "cowrie.json.1")
    log.write_text(text(6))
    (folder / "cowrie.json.2.gz").write_bytes(b"x")
    assert sessions() == ["s1", "s2", "s3", "s4", "s5", "s6"]
    assert sessions() == ["s1", "s2", "s3", "s4", "s5", "s6"]


def test_ranges_of_a_log_hold_every_line_once(tmp_path):
    lines = ["x" * (i % 37) + str(i) for i in range(500)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\nunfinished")
    for size in (7, 64, 1000, 1 << 20):
        reader = TailReader({"path": str(tmp_path), "rangebytes": size})
        end = reader.latestOffset()
        got = [v for p in reader.partitions(reader.initialOffset(), end) for b in reader.read(p) for v in b.column("value").to_pylist()]
        assert got == lines
        assert reader.partitions(end, end) == []


def poll(reader, start):
    """(lines by file name, new offset) of what a reader finds after ``start``."""
    end, got = json.loads(json.dumps(reader.latestOffset())), {}
    for p in reader.partitions(start, end):
        for b in reader.read(p):
            got.setdefault(p.file.rsplit("/", 1)[1], []).extend(b.column("value").to_pylist())
    return got, end


def test_files_that_begin_alike_are_all_read(tmp_path):
    reader, head = TailReader({"path": str(tmp_path)}), "#fields" + "x" * 5000 + "\n"
    one, two = tmp_path / "a.log", tmp_path / "b.log"
    one.write_text(head + "a1\na2\n")
    two.write_text(head + "b1\n")
    got, at = poll(reader, reader.initialOffset())
    assert got == {"a.log": [head[:-1], "a1", "a2"], "b.log": [head[:-1], "b1"]}
    with two.open("a") as f:  # the shorter one becomes the longer one
        f.write("b2\nb3\nb4\n")
    got, at = poll(reader, at)
    assert got == {"b.log": ["b2", "b3", "b4"]}
    one.rename(tmp_path / "a.log.1")  # a rotated log goes on, the new one of its name begins anew with the same line
    with (tmp_path / "a.log.1").open("a") as f:
        f.write("a3\n")
    one.write_text(head + "a4\na5\na6\na7\n")
    got, at = poll(reader, at)
    assert got == {"a.log.1": ["a3"], "a.log": [head[:-1], "a4", "a5", "a6", "a7"]}
    one.write_text(head + "a8\n")  # cut off and written anew
    assert poll(reader, at)[0] == {"a.log": [head[:-1], "a8"]}


def test_compressed_logs_are_read_from_where_the_plain_one_was(tmp_path):
    reader = TailReader({"path": str(tmp_path)})
    log, packed = tmp_path / "a.log.1", tmp_path / "a.log.1.gz"
    log.write_text("head\na1\n")
    (tmp_path / "old.gz").write_bytes(gzip.compress(b"head\no1\no2") + gzip.compress(b"\no3\n"))
    (tmp_path / "bad.gz").write_bytes(b"no gzip file")
    got, at = poll(reader, reader.initialOffset())
    bad = got.pop("bad.gz")
    assert len(bad) == 1 and bad[0].startswith("unreadable") and got == {"a.log.1": ["head", "a1"], "old.gz": ["head", "o1", "o2", "o3"]}
    whole = log.read_text() + "a2\na3"
    log.write_text(whole)
    packed.write_bytes(gzip.compress(whole.encode())[:-9])  # still being made
    got, at = poll(reader, at)
    assert got == {"a.log.1": ["a2"]}
    packed.write_bytes(gzip.compress(whole.encode()))
    assert poll(reader, at)[0] == {}
    log.unlink()
    got, at = poll(reader, at)
    assert got == {"a.log.1.gz": ["a3"]}
    packed.rename(tmp_path / "a.log.2.gz")
    assert poll(reader, at)[0] == {}


def test_real_events_of_one_second_stay_and_redelivered_lines_go(spark, rows):
    same = [("s", datetime(2024, 1, 1), "command", f"cmd {i}") for i in range(3)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(same)] + [(*same[0], 0)], "event_id string, timestamp timestamp, event_type string, raw string, at int")
    lined = df.withColumn("line_id", logs.line_id(F.lit("f"), F.col("at"), F.col("raw"))).drop("at")
    assert rows(ingest.batch_without_repeats(lined), "raw") == [("cmd 0",), ("cmd 1",), ("cmd 2",)]


def test_every_line_is_accepted_or_rejected(spark, rows):
    good = json.dumps(login(1, True))
    lines = [good, "", "oops", "{}", '{"eventid":"x","timestamp":"never"}', good]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "file string, offset long, value string")
    kept, bad = logs.split_lines(df, "cowrie")
    assert kept.count() == 2
    assert rows(bad, "offset", "reason") == [(1, "empty"), (2, "unreadable"), (3, "unreadable"), (4, "time")]


def test_upkeep_of_one_layout(spark, rows, tmp_path):
    root = str(tmp_path)
    at = lambda *t: spark.createDataFrame([(datetime(*d), "cowrie") for d in t], "timestamp timestamp, honeypot_type string")
    tables.append_table(at((2023, 1, 5), (2024, 1, 5)), "honeypot_events", root)
    tables.write_rows(tables.with_month(n.conform(at((2024, 1, 6)), "honeypot_events"), "honeypot_events"), "honeypot_events", root, "b-1")
    count = lambda: tables.read_table(spark, "honeypot_events", root).count()
    assert count() == 3
    tables.compact(spark, "honeypot_events", root, "2024-01")
    assert count() == 3 and len(list((tmp_path / "honeypot_events" / "month=2024-01").iterdir())) == 1
    assert tables.expire(spark, "honeypot_events", root, "2024-02-01") == ["2023-01"]
    assert count() == 2
