from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wardlake.operators import signatures as s
from wardlake.operators.rules import RULES, Content

COLS = "payload string, uri string, user_agent string, header string, method string, body string, protocol string, dest_port int"


def text_sids(spark, payload="", port=80, protocol="ssh", uri="", agent="", header="", method="", body=""):
    row = (payload, uri, agent, header, method, body, protocol, port)
    return {r.sid for r in s.match_rules(spark.createDataFrame([row], COLS)).select("sid").collect()}


def byte_sids(spark, payload, port, protocol="modbus"):
    df = spark.createDataFrame([(bytearray(payload), protocol, port)], "payload binary, protocol string, dest_port int")
    return {r.sid for r in s.match_rules(df, binary=True).select("sid").collect()}


def test_table_is_complete(spark):
    assert len(RULES) == len({r.sid for r in RULES}) == 68
    assert s.rules_table(spark).count() == 68


def test_positions_become_gaps():
    chain = [Content("ab", depth=5), Content("c", distance=2, within=3)]
    assert s.chain_regex(chain) == "(?s)^.{0,3}ab.{2,4}c"


@pytest.mark.parametrize(
    "payload, port, sid, hit",
    [
        ("root\r\nadmin", 23, 2000002, True),
        ("ROOT admin", 23, 2000002, True),
        ("admin root", 23, 2000002, False),  # the second must follow the first
        ("xxxxxxxxxxxroot admin", 23, 2000002, False),  # beyond the depth
        ("root" + "x" * 60 + "admin", 23, 2000002, False),  # beyond the distance
        ("root admin", 2323, 2000002, False),  # other port
        ("admin:admin", 22, 2000006, True),
        ("admin", 22, 2000006, False),
        ("crontab -e", 22, 2000033, True),
        ("crontab" + " " * 30 + "-e", 22, 2000033, False),
        ("SSH-2.0 -R 80", 22, 2000035, True),
        ("xSSH-2.0 -R 80", 22, 2000035, False),
        ("WGET HTTP://x", 9, 1000005, True),
        ("http wget", 9, 1000005, False),
        ("${JNDI:ldap}", 9, 1000022, True),
        ("/bin/bash\n-i", 9, 1000023, True),
    ],
)
def test_payload_rules(spark, payload, port, sid, hit):
    assert (sid in text_sids(spark, payload, port)) is hit


def test_udp_rules_need_udp(spark):
    message = "M-SEARCH * HTTP/1.1\r\nMAN: ssdp:discover"
    assert 2000016 in text_sids(spark, message, 1900, "ssdp")
    assert 2000016 not in text_sids(spark, message, 1900, "tcp")


def test_http_rules(spark):
    assert text_sids(spark, uri="/cgi-bin/x;id", method="GET", protocol="http") >= {2000011, 2000013}
    assert 2000008 in text_sids(spark, agent="() { :;}", method="GET", protocol="http")
    assert 2000008 not in text_sids(spark, agent="() {" + " " * 20 + ":;", method="GET", protocol="http")
    assert {2000027, 2000029} <= text_sids(spark, uri="/bins/a.mips?x=.SH", method="GET", protocol="http")
    assert 2000027 not in text_sids(spark, uri="/x.sh", method="POST", protocol="http")
    assert 1000008 in text_sids(spark, body="<?php system('id')", method="POST", protocol="http")


def test_long_payloads_are_read_to_the_end(spark):
    assert 2000034 in text_sids(spark, "x" * 300_000 + "uname -a", 9)


def test_byte_rules(spark):
    assert byte_sids(spark, b"\x00\x00\x00\x00\x00\x03" + b"\0" * 5 + b"\x10", 502) == {2000018, 2000019}
    assert 2000018 not in byte_sids(spark, b"\x00\x00\x00\x00" + b"\0" * 7 + b"\x0f", 502)
    assert byte_sids(spark, b"\x00\x00\x00\x00\x01\x02\x03", 502) == {1000011}
    assert byte_sids(spark, b"\xffSMB\x73\x00\x00\x00\x31", 445, "smb") == {1000009, 2000023}
    assert byte_sids(spark, b"\xffSMB\x73\x00\x00\x31", 445, "smb") == {2000023}
    assert byte_sids(spark, b"\xffSMB\x73\x01\x00\x00\x00\x31", 445, "smb") == {1000009}
    assert byte_sids(spark, b"\x81\x0c", 47808, "bacnet") == {2000020}
    assert byte_sids(spark, b"\x00\x81\x0c", 47808, "bacnet") == set()
    assert byte_sids(spark, b"\x00\x00\x00\x01..PING", 9, "x") == {2000004}
    big = b"DESCRIBE rtsp://" + b"a" * 15 + b"\x04\x01"
    assert byte_sids(spark, big, 554, "rtsp") == {2000015}
    assert byte_sids(spark, big[:-1] + b"\x00", 554, "rtsp") == set()


def test_rules_that_lack_a_column_are_named(spark):
    whole = spark.createDataFrame([], COLS + ", history string")
    assert s.not_evaluated(whole) == []
    assert s.not_evaluated(whole.drop("history")) == [r.sid for r in RULES if not r.contents and r.flags == "0"]
    missing = s.not_evaluated(whole.drop("uri"))
    assert missing and all(any(c.buffer == "uri" for c in r.contents) for r in RULES if r.sid in missing)


def test_scan_rules_and_beacons(spark, rows):
    df = spark.createDataFrame(
        [("a", 2323, "S0", "S", "tcp", 50, 1, True), ("b", 81, "S0", "", "tcp", 900, 3, True), ("c", 502, "SF", "S", "modbus", 0, 0, True)],
        "uid string, dest_port int, conn_state string, history string, protocol string, orig_bytes long, orig_pkts long, local_orig boolean",
    )
    hits = {}
    for uid, sid in rows(s.scan_hits(df), "uid", "sid"):
        hits.setdefault(uid, set()).add(sid)
    assert hits == {"a": {2000003, 2000025, 1000025}, "b": {2000025, 1000020, 1000025, 1000026}, "c": {2000037}}
    assert rows(s.beacon_hits(df), "uid", "sid") == [("a", 1000027)]
    assert rows(s.beacon_hits(df.withColumn("local_orig", F.lit(False)))) == []


def test_own_rates(spark, rows):
    t0 = datetime(2024, 1, 1)
    hits = spark.createDataFrame(
        [(sid, "x", t0.replace(second=i)) for sid in (2000003, 2000028, 1000020) for i in range(12)],
        "sid int, source_ip_hash string, timestamp timestamp",
    )
    fired = rows(s.apply_rates(hits).groupBy("sid").count())
    # every tenth; once at the third; no rate, so all
    assert fired == [(1000020, 12), (2000003, 1), (2000028, 1)]


def test_rates_agree_on_lists_and_single_hits(spark, rows):
    df = spark.range(3000).selectExpr(
        "concat('s', id % 2) AS source_ip_hash", "timestamp_seconds(1704067200 + id * 13 % 400) AS timestamp", "'tcp' AS protocol",
        "element_at(array(23, 81, 8080, 502), CAST(id % 4 AS INT) + 1) AS dest_port", "IF(id % 3 = 0, 'S0', 'SF') AS conn_state",
        "IF(id % 5 = 0, '', 'S') AS history")
    single = rows(s.apply_rates(s.scan_hits(df)), "sid", "source_ip_hash", F.unix_timestamp("timestamp"), "hit")
    listed = rows(s.apply_rates(s.scan_hits(df, as_list=True)), "sid", "source_ip_hash", F.unix_timestamp("timestamp"), "hit")
    assert single == listed and len({r[0] for r in single}) >= 4


def test_suppression(spark, rows):
    df = spark.createDataFrame(
        [(1, 2000024, "192.168.1.7"), (2, 2000024, "192.168.2.7"), (3, 2000005, "192.168.1.50"), (4, 2000005, "192.168.1.51"), (5, 2000024, None)],
        "i int, sid int, src_ip string",
    )
    kept = s.suppress(df, [(2000024, "192.168.1.0/24"), (2000005, "192.168.1.50")])
    assert [r[0] for r in rows(kept, "i")] == [2, 4, 5]
    with pytest.raises(ValueError):
        s.suppress(df, [(1, "not a network")])


def test_alert_rows(spark, rows):
    out = s.to_alerts(spark.createDataFrame([(2000021,), (1000001,)], "sid int"))
    assert rows(out, "signature_id", "alert_category", "mitre_technique_id", "mitre_tactic") == [
        (1000001, "attempted-user", "", ""), (2000021, "attempted-dos", "T0855", "ICS Lateral Movement"),
    ]
