"""Sources, sinks, normalisation and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, identity
from ..operators import geo
from ..operators import normalise as n
from ..session import scratch_path
from ..sources import logs, tables
from . import rawlogs
from .registry import add, ago, window
from .sqlviews import DEST, K, SESSION, pick, q
from .views import AS_OF, SALT

TS = "CAST(date_trunc('second', ts) AS VARCHAR)"
IP = "(user_id % 30) || '.' || (event_id % 256) || '.1.1'"
PORT = "CAST(1024 + event_id % 60000 AS INTEGER)"
HASH = f"substr(sha256('salt' || {IP}), 1, 16)"
# address is n.x.1.1; ranges start at n.0.0.0 and end 64 n_regionkey blocks of /10 earlier than the next
COUNTRY = (f"coalesce((SELECT n_name FROM nation WHERE n_nationkey = user_id % 30 AND "
           "(event_id % 256) * 65536 + 257 <= 16777215 - n_regionkey * 4194304), '')")


def parsed(v, kind: str):
    """Raw lines of a sensor through the reader's parser."""
    lines = getattr(rawlogs, kind)(v)
    return logs.parse_lines(lines, logs.raw_schema(kind))


def on_ids(where: str, **cols: str) -> str:
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in cols.items()) + f" FROM events WHERE {where}"


# --- address lookups and pseudonyms

add("e2_geo_enrich", lambda v: geo.geo_enrich(v.addresses(), "src_ip", v.geo_ranges(), default="XX").select(
    "c_custkey", "src_ip", "source_ip_country"), q(
    """SELECT c_custkey, src_ip, coalesce(country, 'XX') AS source_ip_country FROM (
    SELECT *, split_part(src_ip, '.', 1)::BIGINT * 16777216 + split_part(src_ip, '.', 2)::BIGINT * 65536 + 257 AS ip FROM addresses)
    LEFT JOIN geo_ranges ON ip BETWEEN start_ip AND end_ip""", "addresses", "geo_ranges"))
add("e3_anon_ip", lambda v: v.addresses().select("c_custkey", identity.anon_ip("src_ip", SALT).alias("source_ip_hash")), q(
    "SELECT c_custkey, substr(sha256('salt' || src_ip), 1, 16) AS source_ip_hash FROM addresses", "addresses"))
# HMAC written out in SQL: SHA-256 of (outer key || SHA-256 of (inner key || text)) on hex text
INNER = "".join(f"\\x{b ^ 0x36:02X}" for b in b"salt".ljust(64, b"\0"))
OUTER = "".join(f"\\x{b ^ 0x5C:02X}" for b in b"salt".ljust(64, b"\0"))
HMAC = f"sha256('{OUTER}'::BLOB || unhex(sha256('{INNER}'::BLOB || encode(listed_ip))))"
HMAC_SQL = f"CASE WHEN listed_ip IN ('', '0.0.0.0') THEN '' ELSE {HMAC} END"
add("e4_hmac_ip", lambda v: v.addresses().select("c_custkey", identity.hmac_ip("listed_ip", SALT).alias("source_ip_anon")), q(
    f"SELECT c_custkey, {HMAC_SQL} AS source_ip_anon FROM addresses", "addresses"))
MISSING = "listed_ip NOT IN ('', '0.0.0.0') AND source_ip_anon = ''"
add("e5_backfill", lambda v: identity.backfill_anon(v.addresses(), "listed_ip", "source_ip_anon", SALT).select(
    "c_custkey", "source_ip_anon"), q(
    f"SELECT c_custkey, CASE WHEN {MISSING} THEN {HMAC} ELSE source_ip_anon END AS source_ip_anon FROM addresses", "addresses"))
add("e5_backfill_dry_run", lambda v: identity.backfill_anon(v.addresses(), "listed_ip", "source_ip_anon", SALT, True), q(
    f"SELECT count(*) FILTER ({MISSING}) AS to_anonymise, count(*) AS total FROM addresses", "addresses"))


def _unanonymised(v):
    before = v.addresses()
    after = identity.backfill_anon(before, "listed_ip", "source_ip_anon", SALT)
    cols = ("listed_ip", "source_ip_anon")
    return identity.count_unanonymised({"before": (before, *cols), "after": (after, *cols)})


add("e6_count_unanonymised", _unanonymised, q(
    f"SELECT 'before' AS table_name, count(*) FILTER ({MISSING}) AS unanonymised, count(*) AS total, "
    f"count(*) FILTER ({MISSING}) = 0 AS verified FROM addresses UNION ALL SELECT 'after', 0, count(*), true FROM addresses",
    "addresses"))
add("e7_hash_secret", lambda v: identity.hash_secret(v.creds().select("event_id", "password")), q(
    "SELECT event_id, sha256(password) AS password_hash FROM credentials", "credentials"))

# --- shell sensor

CID = f"""CASE WHEN {K} % 10 = 9 THEN 'session_end' WHEN {K} % 10 = 8 THEN 'other' WHEN event_type = 'click' THEN 'command'
  WHEN event_type = 'view' THEN 'session_start' WHEN event_type = 'purchase' THEN 'login_success'
  WHEN event_type = 'signup' THEN 'login_failed' ELSE 'file_download' END"""
LOGIN = f"({CID}) IN ('login_success', 'login_failed')"
EVENT_COLS = ["timestamp", "event_id", "honeypot_type", "source_ip_hash", "source_ip_country", "source_port", "dest_ip",
              "dest_port", "protocol", "event_type", "username", "password", "command", "session_id", "success"]


def cowrie_rows(v):
    return n.cowrie_normalise(parsed(v, "cowrie"), SALT, v.geo_ranges())


COWRIE_SQL = on_ids(
    "true", timestamp=TS, event_id=SESSION, honeypot_type="'cowrie'", source_ip_hash=HASH, source_ip_country=COUNTRY,
    source_port=PORT, dest_ip=DEST, dest_port="22", protocol="'ssh'", event_type=CID,
    username=f"CASE WHEN {LOGIN} THEN 'u' || (user_id % 7) ELSE '' END",
    password=f"CASE WHEN {LOGIN} AND event_id % 9 <> 0 THEN 'p' || {K} ELSE '' END",
    command=f"CASE WHEN ({CID}) = 'command' THEN 'run ' || {K} ELSE '' END", session_id=SESSION,
    success=f"({CID}) = 'login_success'",
)
add("e1_e8_cowrie_events", lambda v: n.sensor_events(cowrie_rows(v), "cowrie").select(*EVENT_COLS), COWRIE_SQL)
add("e9_cowrie_classes", lambda v: classify.cowrie_classify(parsed(v, "cowrie")).groupBy(
    "eventid", "attack_technique", "attack_tactic", "severity", "is_bruteforce", "success_flag").agg(F.count(F.lit(1)).alias("rows")),
    f"""SELECT eventid, coalesce(t, '') AS attack_technique, coalesce(y, '') AS attack_tactic, coalesce(s, 'low') AS severity,
    coalesce(b, 0) AS is_bruteforce, coalesce(f, 0) AS success_flag, count(*) AS rows FROM (SELECT
      CASE {CID} WHEN 'session_end' THEN 'cowrie.session.closed' WHEN 'other' THEN 'cowrie.client.version'
       WHEN 'command' THEN 'cowrie.command.input' WHEN 'session_start' THEN 'cowrie.session.connect'
       WHEN 'login_success' THEN 'cowrie.login.success' WHEN 'login_failed' THEN 'cowrie.login.failed'
       ELSE 'cowrie.session.file_download' END AS eventid FROM events) LEFT JOIN (VALUES
      ('cowrie.login.success', 'T1078.001', 'Initial Access', 'medium', 1, 1),
      ('cowrie.login.failed', 'T1110.001', 'Credential Access', 'low', 1, 0),
      ('cowrie.command.input', 'T1059.004', 'Execution', 'high', 0, 0),
      ('cowrie.session.file_download', 'T1105', 'Command and Control', 'critical', 0, 0),
      ('cowrie.session.connect', 'T1021.004', 'Lateral Movement', 'info', 0, 0)) c(e, t, y, s, b, f) ON eventid = e
    GROUP BY ALL""")
add("e25_credentials", lambda v: n.to_credentials(cowrie_rows(v)), on_ids(
    f"{LOGIN} AND event_id % 9 <> 0", timestamp=TS, source_ip_hash=HASH, honeypot_type="'cowrie'", protocol="'ssh'",
    username="'u' || (user_id % 7)", password=f"'p' || {K}", success=f"({CID}) = 'login_success'", session_id=SESSION))
add("e26_cowrie_downloads", lambda v: n.to_downloads(cowrie_rows(v), "cowrie"), on_ids(
    f"({CID}) = 'file_download'", timestamp=TS, file_id=f"sha256({K}::VARCHAR)", source_ip_hash=HASH, honeypot_type="'cowrie'",
    filename="''", file_size="CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END", mime_type="''", md5_hash="''",
    sha1_hash="''", sha256_hash=f"sha256({K}::VARCHAR)", download_url=f"'http://h/' || {K}", file_path=f"'/tmp/' || {K}"))

# --- service sensor

add("e10_dionaea_events", lambda v: n.sensor_events(n.dionaea_normalise(parsed(v, "dionaea"), SALT, v.geo_ranges()), "dionaea").select(
    *EVENT_COLS), on_ids(
    "true", timestamp=TS, event_id="event_id::VARCHAR", honeypot_type="'dionaea'", source_ip_hash=HASH, source_ip_country=COUNTRY,
    source_port=PORT, dest_ip=DEST, dest_port="445", protocol="'tcp'",
    event_type=f"CASE {K} % 5 WHEN 0 THEN 'http' WHEN 1 THEN 'smb' WHEN 2 THEN 'download' WHEN 3 THEN 'mssql' ELSE 'connection' END",
    username="''", password="''", command="''", session_id="event_id::VARCHAR", success="false"))
EXP = "CASE event_id % 4 WHEN 0 THEN '{0}' WHEN 1 THEN '{1}' WHEN 2 THEN '{2}' ELSE '{3}' END"


def _by_kind(http: str, smb: str, download: str, other: str) -> str:
    return f"CASE {K} % 5 WHEN 0 THEN {http} WHEN 1 THEN '{smb}' WHEN 2 THEN '{download}' ELSE '{other}' END"


add("e11_dionaea_classes", lambda v: classify.dionaea_classify(parsed(v, "dionaea")).select(
    F.col("connection").alias("event_id"), "event_type", "exploit_type", "is_exploit", "attack_technique", "attack_tactic", "severity"),
    on_ids(
        "true", event_id="event_id::VARCHAR", event_type=_by_kind("'dionaea_http'", "dionaea_smb", "dionaea_download", "dionaea_connection"),
        exploit_type=_by_kind(EXP.format("shellshock", "path_traversal", "sqli", ""), "", "", ""),
        is_exploit=f"({K} % 5 = 0 AND event_id % 4 < 3)::INTEGER",
        attack_technique=_by_kind(EXP.format("T1190", "T1083", "T1190", ""), "T1210", "T1105", ""),
        attack_tactic=_by_kind(EXP.format("Initial Access", "Discovery", "Initial Access", ""), "Lateral Movement", "Command and Control", ""),
        severity=_by_kind(EXP.format("high", "medium", "high", "low"), "medium", "critical", "info")))
add("e26_dionaea_downloads", lambda v: n.to_downloads(n.dionaea_normalise(parsed(v, "dionaea"), SALT), "dionaea").select(
    "timestamp", "file_id", "source_ip_hash", "filename", "file_size", "md5_hash", "sha256_hash"), on_ids(
    f"{K} % 5 = 2", timestamp=TS, file_id=f"CASE WHEN event_id % 3 > 0 THEN md5({K}::VARCHAR) ELSE '' END", source_ip_hash=HASH,
    filename="'x.bin'", file_size="0::BIGINT", md5_hash=f"CASE WHEN event_id % 3 > 0 THEN md5({K}::VARCHAR) ELSE '' END",
    sha256_hash=f"CASE WHEN event_id % 2 = 0 THEN '' ELSE sha256({K}::VARCHAR) END"))

# --- control sensor

DTYPE = "CASE event_id % 5 WHEN 0 THEN 'modbus' WHEN 1 THEN 'bacnet' WHEN 2 THEN 's7comm' WHEN 3 THEN 'http' ELSE '' END"
REQ = rawlogs.REQUEST.format(k=K)
CLASS = f"""CASE WHEN event_id % 5 = 0 THEN CASE {K} % 6 WHEN 0 THEN 'modbus_write' WHEN 1 THEN 'modbus_read' WHEN 3 THEN 'modbus_read' ELSE 'modbus_other' END
  WHEN event_id % 5 = 1 THEN 'bacnet' WHEN event_id % 5 = 2 THEN 's7comm' WHEN event_id % 5 = 3 OR {K} % 6 = 3 THEN 'http' ELSE 'other' END"""
add("e12_conpot_classes", lambda v: classify.conpot_classify(parsed(v, "conpot")).select(
    F.col("id").alias("event_id"), "event_type", "protocol", "attack_technique", "attack_tactic", "severity"),
    f"""SELECT id::VARCHAR AS event_id, et AS event_type, pr AS protocol, te AS attack_technique, ta AS attack_tactic, se AS severity
    FROM (SELECT event_id AS id, {CLASS} AS class FROM events) JOIN (VALUES
      ('modbus_write', 'conpot_modbus', 'modbus', 'T0836', 'ICS Impair Process Control', 'high'),
      ('modbus_read', 'conpot_modbus', 'modbus', 'T0802', 'ICS Collection', 'medium'),
      ('modbus_other', 'conpot_modbus', 'modbus', '', '', 'low'), ('bacnet', 'conpot_bacnet', 'bacnet', 'T0846', 'ICS Collection', 'medium'),
      ('s7comm', 'conpot_s7comm', 's7comm', 'T0836', 'ICS Impair Process Control', 'medium'),
      ('http', 'conpot_http', 'http', 'T1190', 'Initial Access', 'medium'),
      ('other', 'conpot_connection', '', 'T0846', 'ICS Collection', 'info')) c(cl, et, pr, te, ta, se) ON class = cl""")
add("e13_e16_conpot_events", lambda v: n.sensor_events(n.conpot_normalise(parsed(v, "conpot"), SALT, v.geo_ranges()), "conpot").select(
    *EVENT_COLS), on_ids(
    "true", timestamp=TS, event_id="event_id::VARCHAR", honeypot_type="'conpot'", source_ip_hash=HASH, source_ip_country=COUNTRY,
    source_port=PORT, dest_ip="''",
    dest_port="CASE WHEN event_id % 4 <> 0 THEN 5020 WHEN event_id % 5 = 0 THEN 502 WHEN event_id % 5 = 1 THEN 47808 WHEN event_id % 5 = 2 THEN 102 ELSE 0 END",
    protocol=DTYPE, event_type=f"CASE WHEN {K} % 6 < 4 THEN 'request' ELSE 'connection' END", username="''", password="''",
    command=f"coalesce({REQ}, '')", session_id=SESSION, success="false"))
add("e15_ics_metadata", lambda v: n.conpot_normalise(parsed(v, "conpot"), SALT).select(
    "event_id", F.get_json_object("metadata", "$.function_code").alias("function_code"),
    F.get_json_object("metadata", "$.slave_id").alias("slave_id"), F.col("metadata").isNull().alias("unset")), on_ids(
    "true", event_id="event_id::VARCHAR", function_code=f"CASE WHEN event_id % 3 = 0 THEN {K}::VARCHAR END",
    slave_id=f"CASE WHEN event_id % 6 = 0 THEN ({K} % 8)::VARCHAR END", unset="event_id % 3 <> 0"))

# --- alerts

TECH = pick(["T1190", "T1110.001", "T0855", "T9999", "T1046"], f"{K} % 5")
TACTIC = pick(["Initial Access", "Credential Access", "ICS Lateral Movement", "Unknown", "Discovery"], f"{K} % 5")
add("e17_e18_ids_alerts", lambda v: n.ids_normalise(parsed(v, "suricata"), SALT, v.geo_ranges()), on_ids(
    "event_type <> 'view'", timestamp=TS, alert_id="event_id::VARCHAR", source_ip_hash=HASH, source_ip_country=COUNTRY, source_port=PORT,
    dest_ip=DEST, dest_port="80", protocol="'TCP'", alert_signature="'SIG'", alert_category="'cat'",
    alert_severity="CAST(1 + event_id % 4 AS INTEGER)", signature_id=f"CAST(2000000 + {K} AS BIGINT)", revision="1",
    payload=f"CASE WHEN event_id % 2 = 0 THEN 'p' || {K} ELSE '' END",
    mitre_technique_id=f"CASE WHEN event_id % 5 = 4 THEN '' ELSE {TECH} END",
    mitre_tactic=f"CASE event_id % 5 WHEN 4 THEN '' WHEN 2 THEN 'Named' WHEN 0 THEN 'Exfiltration' WHEN 3 THEN 'Impact' "
    f"ELSE CASE WHEN {K} % 2 = 0 THEN 'lateral-movement' ELSE {TACTIC} END END"))
TECHNIQUES = ["T1595.001", "T1078", "T1190", "T1059.004", "T1053", "T1056", "T1110.001", "T1557", "T1046", "T1082", "T1083", "T1021",
              "T1210", "T1074", "T1071", "T1105", "T1498", "T1584.005", "T0802", "T0846", "T0836", "T0831", "T0815", "T0855", "T1", ""]
add("e19_tactic_names", lambda v: v.raw("events").selectExpr(
    "element_at(array(" + ", ".join(repr(t) for t in TECHNIQUES) + "), CAST(event_id % 26 AS INT) + 1) AS technique").select(
        "technique", classify.mitre_tactic("technique").alias("tactic")).groupBy("technique", "tactic").agg(F.count(F.lit(1)).alias("rows")),
    f"""SELECT technique, CASE WHEN technique = '' THEN ''
    WHEN technique LIKE 'T1595%' THEN 'Reconnaissance' WHEN technique LIKE 'T1078%' OR technique LIKE 'T1190%' THEN 'Initial Access'
    WHEN technique LIKE 'T1059%' THEN 'Execution' WHEN technique LIKE 'T1053%' THEN 'Persistence'
    WHEN regexp_matches(technique, '^T1056|^T1110|^T1557') THEN 'Credential Access'
    WHEN regexp_matches(technique, '^T1046|^T1082|^T1083') THEN 'Discovery' WHEN regexp_matches(technique, '^T1021|^T1210') THEN 'Lateral Movement'
    WHEN technique LIKE 'T1074%' THEN 'Collection' WHEN regexp_matches(technique, '^T1071|^T1105') THEN 'Command and Control'
    WHEN technique LIKE 'T1498%' THEN 'Impact' WHEN technique LIKE 'T1584%' THEN 'Resource Development'
    WHEN regexp_matches(technique, '^T0802|^T0846') THEN 'ICS Collection' WHEN technique LIKE 'T0836%' THEN 'ICS Impair Process Control'
    WHEN technique LIKE 'T0831%' THEN 'ICS Inhibit Response Function' WHEN technique LIKE 'T0815%' THEN 'ICS Impact'
    WHEN technique LIKE 'T0855%' THEN 'ICS Lateral Movement' ELSE 'Unknown' END AS tactic, count(*) AS rows
    FROM (SELECT {pick(TECHNIQUES, 'event_id % 26')} AS technique FROM events) GROUP BY ALL""")
add("e20_severity_labels", lambda v: v.raw("events").selectExpr("CAST(event_id % 6 AS INT) AS severity").select(
    "severity", classify.severity_label("severity").alias("label")).groupBy("severity", "label").agg(F.count(F.lit(1)).alias("rows")),
    "SELECT CAST(event_id % 6 AS INTEGER) AS severity, CASE event_id % 6 WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' "
    "ELSE 'low' END AS label, count(*) AS rows FROM events GROUP BY ALL")

# --- network logs

CONN_SQL = {
    "timestamp": TS, "uid": "'C' || event_id", "source_ip_hash": HASH, "source_port": PORT, "dest_ip": DEST, "dest_port": "23",
    "protocol": "'tcp'", "orig_bytes": f"CASE WHEN event_id % 4 <> 0 THEN {K} * 10 ELSE 0 END::BIGINT", "resp_bytes": f"{K}::BIGINT",
    "conn_state": "'SF'", "history": "'ShAD'", "orig_pkts": f"{K}::BIGINT", "resp_pkts": "0::BIGINT",
}
add("e21_zeek_conn", lambda v: n.conform(n.zeek_conn_normalise(parsed(v, "zeek_conn"), SALT, v.geo_ranges()), "network_connections").select(
    *CONN_SQL, "service", "source_ip_country", F.round(F.col("duration").cast("double"), 2).alias("duration")), on_ids(
    "true", **CONN_SQL, service="CASE WHEN event_id % 3 = 0 THEN 'ssh' ELSE '' END", source_ip_country=COUNTRY, duration="round(value, 2)"))
add("e21_zeek_payload_size", lambda v: n.zeek_conn_normalise(parsed(v, "zeek_conn"), SALT).select("uid", "payload_size", "metadata"), on_ids(
    "true", uid="'C' || event_id", payload_size=f"(CASE WHEN event_id % 4 <> 0 THEN {K} * 10 ELSE 0 END + {K})::BIGINT",
    metadata="'{\"conn_state\":\"SF\",\"history\":\"ShAD\"}'"))
HTTP_SQL = {
    "timestamp": TS, "source_ip_hash": HASH, "source_port": PORT, "dest_ip": DEST, "dest_port": "80", "method": "'GET'", "host": "'h'",
    "uri": f"'/' || {K}", "user_agent": "CASE WHEN event_id % 2 = 0 THEN 'curl' ELSE '' END", "referrer": "''", "status_code": "200",
    "response_body_len": "event_id", "request_body": "''",
}
add("e22_zeek_http", lambda v: n.zeek_http_normalise(parsed(v, "zeek_http"), SALT, v.geo_ranges()), on_ids(
    "true", **HTTP_SQL, source_ip_country=COUNTRY))

# --- camera and router sensors

add("e23_rtsp_events", lambda v: n.sensor_events(n.rtsp_normalise(parsed(v, "rtsp"), SALT), "rtsp").select(
    "timestamp", "event_id", "source_ip_hash", "source_port", "dest_port", "protocol", "event_type", "command", "success", "raw_data"), on_ids(
    "true", timestamp=TS, event_id=SESSION, source_ip_hash=HASH, source_port=f"CASE WHEN event_id % 5 <> 0 THEN {PORT} ELSE 0 END",
    dest_port="CASE WHEN event_id % 7 <> 0 THEN 8554 ELSE 554 END", protocol="'rtsp'",
    event_type="CASE WHEN event_id % 4 = 0 THEN 'attack_detected' ELSE 'rtsp_request' END",
    command=pick(["OPTIONS", "DESCRIBE", "SETUP"], "event_id % 3"), success="event_id % 11 = 0", raw_data=f"'rtsp://cam/' || {K}"))
add("e23_rtsp_attacks", lambda v: n.sensor_attacks(n.rtsp_normalise(parsed(v, "rtsp"), SALT), "rtsp").select(
    "timestamp", "attack_id", "dest_port", "attack_type", "rtsp_method", "attack_details"), on_ids(
    "event_id % 4 = 0 OR event_id % 6 = 0", timestamp=TS, attack_id=SESSION, dest_port="CASE WHEN event_id % 7 <> 0 THEN 8554 ELSE 554 END",
    attack_type="CASE WHEN event_id % 4 = 0 THEN 'CVE-2014-8361 buffer overflow' ELSE '' END",
    rtsp_method=pick(["OPTIONS", "DESCRIBE", "SETUP"], "event_id % 3"),
    attack_details=f"CASE WHEN event_id % 4 = 0 THEN '{{\"type\":\"buffer_overflow\",\"header_length\":' || {K} || '}}' ELSE '{{}}' END"))
# a generated id is a hash of the line; here it only has to be one
add("e24_upnp_events", lambda v: n.sensor_events(n.upnp_normalise(parsed(v, "upnp"), SALT), "upnp").withColumn(
    "event_id", F.when(F.col("event_id").rlike("^[0-9a-f]{32}$"), "generated").otherwise(F.col("event_id"))).select(
        "timestamp", "event_id", "source_ip_hash", "dest_port", "event_type", "command", "raw_data"),
    on_ids("true", timestamp=TS, event_id=f"CASE WHEN event_id % 2 = 0 THEN {SESSION} ELSE 'generated' END", source_ip_hash=HASH, dest_port="CASE WHEN event_id % 5 = 0 THEN 49152 ELSE 1900 END",
           event_type="CASE WHEN event_id % 3 = 0 THEN 'attack_detected' ELSE 'soap_request' END", command="'AddPortMapping'",
           raw_data="'urn:x#AddPortMapping'"))
add("e24_upnp_ids", lambda v: n.sensor_events(n.upnp_normalise(parsed(v, "upnp"), SALT), "upnp").agg(
    F.count(F.lit(1)).alias("rows"), F.count_if(F.col("event_id").rlike("^[0-9a-f]{32}$")).alias("generated"),
    F.count_distinct(F.when(F.col("event_id").rlike("^[0-9a-f]{32}$"), F.col("event_id"))).alias("different")),
    "SELECT count(*) AS rows, count(*) FILTER (event_id % 2 = 1) AS generated, count(*) FILTER (event_id % 2 = 1) AS different FROM events")
add("e24_upnp_attacks", lambda v: n.sensor_attacks(n.upnp_normalise(parsed(v, "upnp"), SALT), "upnp").select(
    "timestamp", "source_ip_hash", "dest_port", "attack_type", "soap_action", "upnp_action", "external_port", "internal_port", "protocol", "attack_details"),
    on_ids("event_id % 3 = 0", timestamp=TS, source_ip_hash=HASH, dest_port="CASE WHEN event_id % 5 = 0 THEN 49152 ELSE 5000 END",
           attack_type="'AddPortMapping abuse'", soap_action="'urn:x#AddPortMapping'", upnp_action="'AddPortMapping'",
           external_port=f"(8000 + {K})::VARCHAR", internal_port="''", protocol="'TCP'",
           attack_details=f"'{{\"NewExternalPort\":\"' || (8000 + {K}) || '\",\"NewProtocol\":\"TCP\"}}'"))
add("e27_drop_pii", lambda v: n.drop_pii(parsed(v, "cowrie")).drop("raw_data").groupBy("eventid").agg(F.count(F.lit(1)).alias("rows")).select(
    "rows", F.lit("src_ip" in n.drop_pii(parsed(v, "cowrie")).columns).alias("raw_address_left")),
    f"SELECT count(*) AS rows, false AS raw_address_left FROM (SELECT {CID} AS e FROM events) GROUP BY e")
SOAP = ("concat('<s:Envelope><u:', CASE WHEN event_id % 2 = 0 THEN 'AddPortMapping' ELSE 'DeletePortMapping' END, ' xmlns:u=\"x\">"
        "<NewExternalPort>', event_id, '</NewExternalPort><NewProtocol>TCP</NewProtocol></u:X></s:Envelope>')")
add("e28_soap_params", lambda v: v.raw("events").selectExpr("event_id", f"{SOAP} AS body").select(
    "event_id", n.soap_params("body").alias("s")).select(
        "event_id", F.col("s.action").alias("action"), F.col("s.params")["NewExternalPort"].alias("external"), F.size("s.params").alias("params")),
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'AddPortMapping' ELSE 'DeletePortMapping' END AS action, event_id::VARCHAR AS external, "
    "2 AS params FROM events")
add("e29_conform", lambda v: n.conform(v.raw("events").selectExpr(
    "ts AS timestamp", "CASE WHEN event_id % 2 = 0 THEN 'x' ELSE '25' END AS source_port", "user_id AS event_id", "CAST(NULL AS STRING) AS protocol"),
    "honeypot_events").select("event_id", "source_port", "protocol", "success", "dest_port"),
    "SELECT user_id::VARCHAR AS event_id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 25 END AS source_port, '' AS protocol, false AS success, "
    "0 AS dest_port FROM events")

# --- sources


def _from_file(v):
    path = rawlogs.write_lines(rawlogs.cowrie(v), "json-log")
    rows = logs.read_json_log(v.spark, path, "cowrie")
    return n.sensor_events(n.cowrie_normalise(rows, SALT, v.geo_ranges()), "cowrie").select(*EVENT_COLS)


def _from_tsv(v):
    path = rawlogs.write_lines(rawlogs.zeek_tsv(v), "tsv-log")
    # text sinks name their files .txt; the reader looks for .log
    rows = logs.read_zeek_tsv(v.spark, path, "*.txt")
    return n.conform(n.zeek_conn_normalise(rows, SALT), "network_connections").select(
        *CONN_SQL, F.round(F.col("duration").cast("double"), 2).alias("duration"))


def _from_zeek_json(v):
    path = rawlogs.write_lines(rawlogs.zeek_conn(v), "zeek-json", "conn.log")
    rows = logs.read_zeek_json(v.spark, path.rsplit("/", 1)[0], "conn")
    return n.zeek_conn_normalise(rows, SALT).select("type", "uid", "payload_size")


add("s1_json_log", _from_file, COWRIE_SQL)
add("s2_zeek_tsv", _from_tsv, on_ids("true", **CONN_SQL, duration="CASE WHEN event_id % 3 = 0 THEN 0 ELSE round(value, 2) END"))
add("s3_zeek_json", _from_zeek_json, on_ids(
    "true", type="'zeek_conn'", uid="'C' || event_id", payload_size=f"(CASE WHEN event_id % 4 <> 0 THEN {K} * 10 ELSE 0 END + {K})::BIGINT"))

# --- sinks and upkeep


def _appended(v):
    root = scratch_path(v.spark, "append")
    for part in (0, 1):
        tables.append_table(v.events().filter(F.col("event_id") % 2 == part), "honeypot_events", root)
    return tables.read_table(v.spark, "honeypot_events", root).groupBy("month", "honeypot_type").agg(F.count(F.lit(1)).alias("rows"))


add("s4_append", _appended, q(
    "SELECT strftime(timestamp, '%Y-%m') AS month, honeypot_type, count(*) AS rows FROM honeypot_events GROUP BY ALL", "honeypot_events"))


def _routed(v):
    rows = cowrie_rows(v)
    parts = tables.route(rows, {
        "honeypot_events": F.lit(True),
        "credentials": F.col("username").isNotNull() & F.col("password").isNotNull(),
        "downloaded_files": F.col("event_type") == "file_download",
    })
    counts = [df.agg(F.lit(name).alias("target"), F.count(F.lit(1)).alias("rows")) for name, df in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


add("s5_route", _routed, f"SELECT 'honeypot_events' AS target, count(*) AS rows FROM events UNION ALL "
    f"SELECT 'credentials', count(*) FILTER ({LOGIN} AND event_id % 9 <> 0) FROM events UNION ALL "
    f"SELECT 'downloaded_files', count(*) FILTER (({CID}) = 'file_download') FROM events")
COUNTED = "SELECT honeypot_type, count(*) AS rows FROM honeypot_events WHERE {w} GROUP BY 1"


def _by_sensor(df):
    return df.groupBy("honeypot_type").agg(F.count(F.lit(1)).alias("rows"))


def _exported(v):
    path = scratch_path(v.spark, "export")
    tables.export_window(v.events(ago(7)), AS_OF, path)
    return _by_sensor(v.spark.read.parquet(path))


def _imported(v):
    path = scratch_path(v.spark, "export")
    tables.export_window(v.events(ago(7)), AS_OF, path)
    return _by_sensor(tables.import_table(v.spark, path, "honeypot_events", scratch_path(v.spark, "import")))


add("s6_export_window", _exported, q(COUNTED.format(w=window(7)), "honeypot_events"))
add("s7_import", _imported, q(COUNTED.format(w=window(7)), "honeypot_events"))
add("s8_evolve", lambda v: tables.evolve(
    v.alerts().drop("mitre_tactic").withColumn("source_ip_country", F.when(F.col("source_ip_country") != "", F.col("source_ip_country"))),
    tables.LATER_COLUMNS["ids_alerts"]).select("alert_id", "source_ip_country", "mitre_technique_id", "mitre_tactic"), q(
    "SELECT alert_id, source_ip_country, mitre_technique_id, '' AS mitre_tactic FROM ids_alerts", "ids_alerts"))
add("s9_retention", lambda v: _by_sensor(tables.apply_ttl(v.events(ago(10)), AS_OF, 10)), q(
    COUNTED.format(w=f"timestamp > TIMESTAMP '{ago(10)}'"), "honeypot_events"))
add("s10_cluster_by", lambda v: tables.cluster_by(v.events(), ["source_ip_country"], 8).select("event_id", "source_ip_country", "timestamp"), q(
    "SELECT event_id, source_ip_country, CAST(timestamp AS VARCHAR) AS timestamp FROM honeypot_events", "honeypot_events"))
