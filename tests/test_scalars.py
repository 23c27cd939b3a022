import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from wardlake.functions import classify, identity
from wardlake.functions.timing import between, on_day, parse_ts, since
from wardlake.operators import geo
from wardlake.operators import normalise as n
from wardlake.sources.logs import parse_lines, raw_schema


def one(spark, rows, schema, **cols):
    return spark.createDataFrame(rows, schema).select(*[c.alias(k) for k, c in cols.items()])


def test_timestamps_in_three_formats(spark, rows):
    texts = ["2024-01-02T03:04:05.678Z", "2024-01-02 03:04:05", "1704164645", "1704164645.9", "nonsense", "", None]
    df = one(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string", i=F.col("i"), s=F.unix_timestamp(parse_ts("t")))
    assert [r[1] for r in rows(df)] == [1704164645] * 4 + [None] * 3


def test_pseudonym_is_salted_sha_prefix(spark, rows):
    df = one(spark, [("1.2.3.4",), (None,)], "ip string", h=identity.anon_ip("ip", "salt"))
    assert rows(df) == [(hashlib.sha256(b"salt1.2.3.4").hexdigest()[:16],), (None,)]


@pytest.mark.parametrize("salt", ["salt", "x" * 80, ""])
def test_hmac_equals_the_standard_library(spark, rows, salt):
    ips = ["1.2.3.4", "10.0.0.1", "", "0.0.0.0"]
    df = one(spark, [(i,) for i in ips], "ip string", ip=F.col("ip"), h=identity.hmac_ip("ip", salt))
    want = {i: "" if i in ("", "0.0.0.0") else hmac.new(salt.encode(), i.encode(), "sha256").hexdigest() for i in ips}
    assert dict(rows(df)) == want


def test_hashed_secret_drops_the_plain_one(spark, rows):
    df = identity.hash_secret(spark.createDataFrame([("a", "pw"), ("b", "")], "u string, password string"))
    assert df.columns == ["u", "password_hash"]
    assert rows(df) == [("a", hashlib.sha256(b"pw").hexdigest()), ("b", "")]


def test_exploit_classes(spark, rows):
    urls = ["() { :; }", "/../../etc/passwd", "?q=UNION SELECT", "/index", "() {../select", None]
    df = one(spark, [(i, u) for i, u in enumerate(urls)], "i int, u string", i=F.col("i"), c=classify.http_exploit("u"))
    assert [r[1] for r in rows(df)] == ["shellshock", "path_traversal", "sqli", "", "shellshock", ""]


def test_tactics_and_labels(spark, rows):
    df = one(spark, [("T1110.001",), ("T0855",), ("T9999",), ("",)], "t string", t=F.col("t"), y=classify.mitre_tactic("t"))
    assert dict(rows(df)) == {"T1110.001": "Credential Access", "T0855": "ICS Lateral Movement", "T9999": "Unknown", "": ""}
    df = one(spark, [(1,), (2,), (3,), (9,), (None,)], "s int", s=F.col("s"), y=classify.severity_label("s"))
    assert dict(rows(df)) == {1: "critical", 2: "high", 3: "medium", 9: "low", None: "low"}


def test_password_weakness(spark, rows):
    words = ["123456", "abc", "letmein", "Zx9!kkkk"]
    df = one(spark, [(w,) for w in words], "p string", p=F.col("p"), w=classify.password_weakness("p"))
    assert dict(rows(df)) == {"123456": "Very Common", "abc": "Too Short", "letmein": "All Lowercase", "Zx9!kkkk": "Other"}


@pytest.mark.parametrize(
    "meta",
    [
        '["mitre_technique_id T1190","mitre_tactic_id TA0001"]',
        '{"mitre_technique_id":"T1190"}',
        '[{"mitre_technique_id":"T1190"}]',
        '[{"mitre_tactic":"x"},{"mitre_technique_id":"T1190"}]',
        '{"mitre_technique_id":["T1190"]}',
    ],
)
def test_technique_in_every_metadata_shape(spark, rows, meta):
    df = one(spark, [(meta,)], "m string", t=n.mitre_extract("m", "mitre_technique_id"))
    assert rows(df) == [("T1190",)]


@pytest.mark.parametrize(
    "meta, tactic",
    [
        ('["mitre_technique_id T1572","mitre_tactic_id lateral-movement"]', "lateral-movement"),
        ('{"mitre_technique_id":"T1572","mitre_tactic_id":"lateral-movement"}', "lateral-movement"),
        ('[{"mitre_technique_id":"T1572"},{"mitre_tactic_id":"TA0008"}]', "Lateral Movement"),
        ('{"mitre_technique_id":["T1190"],"mitre_tactic":["Discovery"]}', "Discovery"),
        ('["mitre_tactic TA0099","mitre_technique_id T1190"]', "Initial Access"),
        ('{"mitre_tactic_id":"TA0010"}', "Exfiltration"),
    ],
)
def test_tactic_in_every_metadata_shape(spark, rows, meta, tactic):
    line = '{"event_type":"alert","timestamp":"2024-01-01T00:00:00Z","src_ip":"1.2.3.4","alert":{"signature":"s","metadata":%s}}' % meta
    raw = parse_lines(spark.createDataFrame([(line,)], "value string"), raw_schema("suricata"))
    assert rows(n.ids_normalise(raw, "salt"), "mitre_tactic") == [(tactic,)]


def test_metadata_without_technique(spark, rows):
    df = one(spark, [("[]",), ("null",), (None,), ("{}",), ("oops",)], "m string", t=n.mitre_extract("m", "mitre_technique_id"))
    assert rows(df) == [("",)] * 5


def test_remote_in_both_forms(spark, rows):
    df = spark.createDataFrame([('["1.2.3.4",502]',), ("1.2.3.4:502",), ("1.2.3.4",), (None,)], "remote string")
    got = rows(n.split_remote(df), "temp_ip", "source_port")
    assert got == [("1.2.3.4", 502), ("1.2.3.4", 502), ("1.2.3.4", None), (None, None)]


def test_default_ports(spark, rows):
    df = one(spark, [(None, "modbus"), (None, "bacnet"), (None, "s7comm"), (77, "modbus"), (None, "x")], "p int, r string",
             r=F.col("r"), d=classify.default_port("p", "r"))
    assert rows(df) == [("bacnet", 47808), ("modbus", 77), ("modbus", 502), ("s7comm", 102), ("x", 0)]


def test_ics_fields_as_json_only_when_set(spark, rows):
    df = spark.createDataFrame([("3", None, "1"), (None, None, None)], "function_code string, slave_id string, unit_id string")
    assert rows(df.select(n.ics_metadata(df).alias("m"))) == [('{"function_code":"3","unit_id":"1"}',), (None,)]


def test_soap_action_and_params(spark, rows):
    body = '<u:AddPortMapping xmlns:u="x"><NewExternalPort>80</NewExternalPort><NewProtocol>TCP</NewProtocol>' \
           "<NewExternalPort>81</NewExternalPort><NewBad>1</NewOther></u:AddPortMapping>"
    df = one(spark, [(body,), ("",)], "b string", s=n.soap_params("b")).select("s.action", F.to_json("s.params").alias("p"))
    assert rows(df) == [("AddPortMapping", '{"NewProtocol":"TCP","NewExternalPort":"81"}'), ("unknown", "{}")]


def test_geo_lookup_edges(spark, rows):
    ranges = spark.createDataFrame(
        [(16777216, 16777471, "AA"), (16777472, 33554431, "BB"), (16777472, 16777600, "CC"), (3232235520, 3232301055, "PR")],
        "start_ip long, end_ip long, country string",
    )
    ips = ["1.0.0.0", "1.0.0.255", "1.0.1.0", "1.0.1.200", "1.255.255.255", "2.0.0.0", "192.168.3.4", "1.0.0.256", "x", "1.2.3", "", None]
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)], "i int, ip string")
    got = [r[1] for r in rows(geo.geo_enrich(df, "ip", ranges, default="XX"), "i", "source_ip_country")]
    assert got == ["AA", "AA", "CC", "BB", "BB", "XX", "PR", "XX", "XX", "XX", "XX", "XX"]


def test_geo_lookup_keeps_every_row_without_broadcast(spark, rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranges = spark.createDataFrame([(0, 16777215, "A"), (10, 20, "B")], "start_ip long, end_ip long, country string")
        df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN '0.0.0.15' WHEN id % 3 = 1 THEN NULL ELSE '0.1.1.1' END AS ip")
        got = geo.geo_enrich(df, "ip", ranges).groupBy("source_ip_country").count()
        assert rows(got) == [("", 1000), ("A", 1000), ("B", 1000)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_conform_fills_and_casts(spark, rows):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "bad", None)], "timestamp string, source_port string, protocol string")
    out = n.conform(df, "honeypot_events")
    assert out.columns[:4] == ["timestamp", "event_id", "honeypot_type", "source_ip_hash"]
    assert rows(out, "source_port", "protocol", "success", "username") == [(0, "", False, "")]


def test_time_filters(spark, rows):
    df = spark.createDataFrame([("2024-01-30 23:59:59",), ("2024-01-30 00:00:00",), ("2024-01-31 00:00:01",)], "t string")
    df = df.select(F.col("t").cast("timestamp").alias("timestamp"), F.lit("2024-01").alias("month"))
    assert since(df, "2024-01-31 00:00:00", days=1).count() == 2
    assert on_day(df, "2024-01-31").count() == 1
    assert between(df, "2024-01-30 12:00:00", "2024-02-01").count() == 2


def test_backfill_touches_only_missing_rows(spark, rows):
    df = spark.createDataFrame([("1.2.3.4", ""), ("1.2.3.4", "kept"), ("0.0.0.0", ""), ("", "")], "ip string, anon string")
    done = identity.backfill_anon(df, "ip", "anon", "salt")
    digest = hmac.new(b"salt", b"1.2.3.4", "sha256").hexdigest()
    assert rows(done) == sorted([("", ""), ("0.0.0.0", ""), ("1.2.3.4", digest), ("1.2.3.4", "kept")])
    assert rows(identity.backfill_anon(df, "ip", "anon", "salt", dry_run=True)) == [(1, 4)]
    assert rows(identity.count_unanonymised({"t": (done, "ip", "anon")})) == [("t", 0, 4, True)]
