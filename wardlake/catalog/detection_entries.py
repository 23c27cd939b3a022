"""Detections, signatures and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detections as d
from ..operators import signatures as s
from .registry import add, chain_sql, fire_sql
from .sqlviews import K, SECOND, h, q

HE, IA, CR, NC, HR, DF = (
    "honeypot_events", "ids_alerts", "credentials", "network_connections", "http_requests", "downloaded_files",
)
TS = "CAST(timestamp AS VARCHAR)"
WEEK = 7 * 86400


def flagged(table: str, cond: str, kind: str, note: str, ident: str = "source_ip_hash") -> str:
    return q(f"SELECT {TS} AS ts, source_ip_hash AS source, '{kind}' AS detection_type, 1::BIGINT AS count, "
             f"{note} AS note, {ident} AS identifier FROM {table} WHERE {cond}", table)


def counted(table: str, cond: str, n: int, seconds: int, mode: str, kind: str, note: str, suffix: str = "") -> str:
    """A counting detection in SQL, walked by recursion."""
    hits = (f"SELECT source_ip_hash AS key, epoch(timestamp)::BIGINT AS sec, count(*)::BIGINT AS cnt "
            f"FROM {table} WHERE {cond} GROUP BY 1, 2")
    return q(f"SELECT CAST(make_timestamp(sec * 1000000) AS VARCHAR) AS ts, key AS source, '{kind}' AS detection_type, hit AS count, "
             f"'{note}: ' || hit AS note, key || '{suffix}' AS identifier FROM {fire_sql(str(n), mode)}",
             table, recursive=True, extra=chain_sql(hits, str(seconds)))


def rx(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def dec(col: str) -> str:
    return f"coalesce(url_decode({col}), {col})"


# --- bot infections

add("d_mir_1_bot_scanner", lambda v: d.bot_scanner(v.conns()), flagged(
    NC, "dest_port IN (23, 2323) AND duration < 2", "bot_scanner", "'short telnet connection to ' || dest_port"))
add("d_mir_2_bot_credential", lambda v: d.bot_credential(v.creds()), flagged(
    CR, "username IN ('root', 'admin', 'user', 'support', 'ubnt') AND password IN "
    "('root', 'admin', 'xc3511', 'vizxv', '888888', 'xmhdipc', 'default', 'juantech', '123456')",
    "bot_credential", "username || ':' || password"))
add("d_mir_2_known_pair", lambda v: d.known_pair(v.creds()), flagged(
    CR, "(username, password) IN (('root', '123456'), ('root', 'password'), ('admin', 'password'), ('admin', '123456'))",
    "known_pair", "username || ':' || password"))
add("d_mir_3_bot_command", lambda v: d.bot_command(v.events()), flagged(
    HE, rx("command", r"bin/busybox|ECCHI|TSource|wget.*/bins/|tftp.*-g.*-r"), "bot_command", "command"))
add("d_mir_4_bot_download", lambda v: d.bot_download(v.requests()), flagged(
    HR, rx("uri", r"/bins/|\.sh|\.bot|mirai"), "bot_download", "uri"))
ATTEMPTS = "attempts so far in window"
DC, DA = "dense_conns", "dense_auth"
add("d_scn_1_telnet_scan", lambda v: d.telnet_scan(v.dense_conns()), counted(
    DC, "dest_port IN (23, 2323) AND duration < 10", 5, 300, "threshold", "telnet_scan", ATTEMPTS))
add("d_scn_2_ssh_scan", lambda v: d.ssh_scan(v.dense_conns(), n=4), counted(
    DC, "dest_port = 22 AND duration < 15", 4, 300, "threshold", "ssh_scan", ATTEMPTS))
add("d_scn_1_telnet_scan_7d", lambda v: d.telnet_scan(v.conns(), 3, WEEK, 100), counted(
    NC, "dest_port IN (23, 2323) AND duration < 100", 3, WEEK, "threshold", "telnet_scan", ATTEMPTS))
add("d_scn_2_ssh_scan_7d", lambda v: d.ssh_scan(v.conns(), 3, WEEK, 100), counted(
    NC, "dest_port = 22 AND duration < 100", 3, WEEK, "threshold", "ssh_scan", ATTEMPTS))
PORTS6 = "dest_port IN (23, 2323, 22, 8080, 8081, 80)"
MULTI = f"""SELECT CAST(make_timestamp(sec * 1000000) AS VARCHAR) AS ts, key AS source, 'multi_port_scan' AS detection_type,
  max(seen)::BIGINT AS count, 'hits: ' || count(*) FILTER (seen >= 3) AS note, key || '-multiport' AS identifier FROM (
  SELECT e.*, (SELECT count(DISTINCT f.dest_port) FROM placed f WHERE f.key = e.key AND f.anchor = e.anchor
     AND f.sec <= e.sec) AS seen FROM placed e)
GROUP BY key, sec HAVING max(seen) >= 3"""


def multi(table: str, seconds: int) -> str:
    hits = (f"SELECT source_ip_hash AS key, epoch(timestamp)::BIGINT AS sec, count(*)::BIGINT AS cnt FROM {table} "
            f"WHERE {PORTS6} GROUP BY 1, 2")
    return q(MULTI, table, recursive=True, extra=chain_sql(hits, str(seconds)) + f""",
placed AS (SELECT w.key, w.sec, w.anchor, c.uid, c.dest_port FROM walked w JOIN {table} c
  ON c.source_ip_hash = w.key AND epoch(c.timestamp)::BIGINT = w.sec WHERE {PORTS6})""")


add("d_scn_3_multi_port", lambda v: d.multi_port_scan(v.dense_conns()), multi(DC, 300))
add("d_scn_3_multi_port_1d", lambda v: d.multi_port_scan(v.conns(), n=3, window=86400), multi(NC, 86400))
add("d_scn_4_rapid_telnet", lambda v: d.rapid_telnet(v.conns()), flagged(
    NC, "protocol = 'telnet' AND duration < 5", "rapid_telnet", "'short telnet session'", f"source_ip_hash || {TS}"))

# --- devices

PORTS7 = "dest_port IN (81, 554, 8080, 8081, 8000, 8443, 9000)"
add("d_iot_1_port_scan", lambda v: d.device_port_scan(v.dense_conns(), n=5), counted(
    DC, PORTS7, 5, 60, "every", "device_port_scan", "connections in window"))
add("d_iot_1_port_scan_7d", lambda v: d.device_port_scan(v.conns(), n=3, window=WEEK), counted(
    NC, PORTS7, 3, WEEK, "every", "device_port_scan", "connections in window"))
add("d_iot_2_device_path", lambda v: d.device_path(v.requests()), flagged(
    HR, rx("uri", r"/cgi-bin/|/web/|/admin/|/config/|/system/|/setup.cgi|/goform/"), "device_path", "uri"))
add("d_iot_3_device_agent", lambda v: d.device_agent(v.requests()), flagged(
    HR, rx("user_agent", "DVR|IPCamera|DNVRS|NETSurveillance|Hikvision|Dahua"), "device_agent", "user_agent"))
add("d_iot_4_rtsp_contact", lambda v: d.rtsp_contact(v.conns()), flagged(
    NC, "dest_port = 554", "rtsp_contact", "'camera port contacted'"))

# --- mining

PORTSM = "dest_port IN (3333, 4444, 5555, 7777, 8888, 9999, 14444)"
add("d_cry_1_mining_port", lambda v: d.mining_port(v.conns()), flagged(
    NC, PORTSM, "mining_port", "CAST(dest_port AS VARCHAR)"))
add("d_cry_2_pool_query", lambda v: d.pool_query(v.dns()), flagged(
    "dns_queries", rx("query", "minergate|nicehash|pool[.]ntp[.]org|supportxmr|moneropool|nanopool|f2pool|slushpool|antpool|poolto"), "pool_query", "query"))
add("d_cry_3_miner_download", lambda v: d.miner_download(v.requests()), flagged(
    HR, rx("uri", "xmrig|cpuminer|cgminer|bfgminer|ethminer|phoenixminer|claymore|ewbf|ccminer"), "miner_download", "uri"))
add("d_cry_4_mining_session", lambda v: d.mining_session(v.conns(), min_s=200), flagged(
    NC, f"{PORTSM} AND duration > 200 AND orig_pkts > 100", "mining_session", "dest_ip || ':' || dest_port"))
add("d_cry_5_stratum", lambda v: d.stratum_text(v.alerts(), "payload"), flagged(
    IA, rx("payload", r"stratum\+tcp|stratum\+ssl|mining\.subscribe|mining\.authorize"), "stratum_text", "payload"))

# --- web exploits

BODY = "request_body"
SHELL = r"\(\)\s*\{.*:;"
TRAV = r"\.\.[/\\]|\.\.%2[fF]|\.\.%5[cC]"
SQLI = r"(?i)(union.*select|select.*from|insert.*into|update.*set|delete.*from|drop.*table|exec.*\(|xp_.*cmdshell)"
CMDI = r"\||;|`|\$\(|<\(|>\(|&lt;&lt;|%0[aA]|%0[dD]"
CGIQ = r"\?.*=.*[;|&`$]"


def uri_rx(p: str) -> str:
    return f"({rx('uri', p)} OR {rx(dec('uri'), p)})"


IS_CGI = uri_rx("cgi-bin")
WEB = {
    "shellshock": f"({' OR '.join(rx(c, SHELL) for c in ('user_agent', 'referrer', 'host', BODY))} OR ({IS_CGI} AND {uri_rx(SHELL)}))",
    "path_traversal": uri_rx(TRAV),
    "sql_injection": f"({uri_rx(SQLI)} OR {rx(BODY, SQLI)})",
    "command_injection": f"({uri_rx(CMDI)} OR {rx(BODY, CMDI)})",
    "cgi_exploit": f"({IS_CGI} AND ({uri_rx(CGIQ)} OR {uri_rx(SHELL)}))",
    "suspicious_ua": rx("user_agent", "(?i)^(Mirai|Gafgyt|python-requests|curl|wget|Nikto|sqlmap|nmap|masscan|ZmEu|DirBuster)"),
}
for _i, (_kind, _cond) in enumerate(WEB.items(), start=1):
    add(f"d_htt_{_i}_{_kind}", lambda v, kind=_kind: d.http_exploit(v.requests(), kind), flagged(HR, _cond, _kind, "uri"))
add("d_htt_7_exploit_log", lambda v: d.exploit_log(v.requests()), q(" UNION ALL ".join(
    f"SELECT {TS} AS ts, source_ip_hash AS source, source_port, dest_ip AS dest, dest_port, method, uri, user_agent, "
    f"'{kind}' AS exploit_type, substr(uri || ' ' || user_agent || ' ' || request_body, 1, 200) AS note "
    f"FROM http_requests WHERE {cond}" for kind, cond in WEB.items()), HR))

# --- SSH

RUNS = f"""runs AS (
  SELECT *, sum_to - fails - coalesce(max(CASE WHEN wins > 0 THEN sum_to END) OVER (PARTITION BY key, anchor ORDER BY sec
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_start
  FROM (SELECT x.key, x.sec, x.fails, x.wins, c.anchor,
          sum(x.fails) OVER (PARTITION BY x.key, c.anchor ORDER BY x.sec) AS sum_to
        FROM (SELECT source_ip_hash AS key, epoch(timestamp)::BIGINT AS sec, count(*) FILTER (NOT authenticated) AS fails,
                count(*) FILTER (authenticated) AS wins FROM {{auth}} GROUP BY 1, 2) x
        ASOF JOIN chain c ON x.key = c.key AND x.sec >= c.anchor WHERE x.sec < c.anchor + {{w}}))"""
FAILS = (f"SELECT source_ip_hash AS key, epoch(timestamp)::BIGINT AS sec, count(*)::BIGINT AS cnt FROM {{auth}} "
         "WHERE NOT authenticated GROUP BY 1, 2")


def ssh(select: str, seconds: int, auth: str = "ssh_auth") -> str:
    members = chain_sql(FAILS.format(auth=auth), str(seconds)) + ",\n" + RUNS.format(w=seconds, auth=auth)
    return q(select, auth, recursive=True, extra=members)


SSH_COLS = ("SELECT CAST(make_timestamp(sec * 1000000) AS VARCHAR) AS ts, key AS source, '{kind}' AS detection_type, "
            "hit::BIGINT AS count, '{note}: ' || hit::BIGINT AS note, key || '{suffix}' AS identifier FROM ")
BRUTE = (SSH_COLS.format(kind="bruteforce", note="failed logins", suffix="")
         + "(SELECT *, unnest(generate_series(greatest(n_start + 1, {n})::BIGINT, (n_start + fails)::BIGINT)) AS hit FROM runs WHERE fails > 0)")
ENDED = (SSH_COLS.format(kind="bruteforce_success", note="failures before success", suffix="-success")
         + "(SELECT *, n_start + fails AS hit FROM runs) WHERE wins > 0 AND hit > 0")
add("d_ssh_1_bruteforce", lambda v: d.ssh_bruteforce(v.dense_auth()), ssh(BRUTE.format(n=10), 600, DA))
add("d_ssh_2_success_after_failures", lambda v: d.ssh_success_after_failures(v.dense_auth()), ssh(ENDED, 600, DA))
add("d_ssh_1_bruteforce_7d", lambda v: d.ssh_bruteforce(v.auth(), 5, WEEK), ssh(BRUTE.format(n=5), WEEK))
add("d_ssh_2_success_after_failures_7d", lambda v: d.ssh_success_after_failures(v.auth(), WEEK), ssh(ENDED, WEEK))


def rapid(n: int, seconds: int, auth: str) -> str:
    hits = f"SELECT source_ip_hash AS key, epoch(timestamp)::BIGINT AS sec, count(*)::BIGINT AS cnt FROM {auth} GROUP BY 1, 2"
    return q("SELECT CAST(make_timestamp(sec * 1000000) AS VARCHAR) AS ts, key AS source, 'rapid_connections' AS detection_type, "
             f"{n}::BIGINT AS count, 'attempts: {n}' AS note, key || '-rapid' AS identifier FROM " + fire_sql(str(n), "threshold"),
             auth, recursive=True, extra=chain_sql(hits, str(seconds)))


add("d_ssh_3_rapid", lambda v: d.ssh_rapid(v.dense_auth()), rapid(15, 600, DA))
add("d_ssh_3_rapid_7d", lambda v: d.ssh_rapid(v.auth(), None, 6, WEEK), rapid(6, WEEK, "ssh_auth"))
add("d_ssh_3_rapid_with_sessions_7d", lambda v: d.ssh_rapid(v.auth(), v.conns(), 6, WEEK, 100))
add("d_ssh_4_scanner", lambda v: d.ssh_scanner(v.conns(), by="conn_state"), flagged(
    NC, "dest_port = 22 AND duration < 3 AND conn_state <> 'SF'", "scanner", "'quick disconnect'", f"source_ip_hash || {TS}"))
add("d_ssh_4_scanner_by_service", lambda v: d.ssh_scanner(v.conns()), flagged(
    NC, "dest_port = 22 AND duration < 3 AND service = ''", "scanner", "'quick disconnect'", f"source_ip_hash || {TS}"))
add("d_ssh_5_weak_username", lambda v: d.weak_username(v.creds()), flagged(
    CR, "username IN ('root', 'admin', 'user', 'test', 'guest', 'pi', 'ubuntu', 'oracle', 'support', 'default', 'user1', "
    "'administrator', 'Administrator', 'daemon', 'ftp', 'postgres', 'mysql', 'www-data', 'nobody')",
    "weak_credentials", "username"))
add("d_ssh_6_log", lambda v: d.ssh_log(v.auth(), v.conns(), v.creds(), fails=5, rapid=6, window=WEEK))

# --- downloads

add("d_dwn_1_download_log", lambda v: d.download_log(v.requests(), v.files()), q(
    r"""SELECT CAST(timestamp AS VARCHAR) AS ts, source_ip_hash AS source, dest_ip AS dest, method, uri AS url,
    regexp_extract(uri, '([^/?]+\.[A-Za-z0-9]+)(?:\?.*)?$', 1) AS filename, '' AS mime_type, response_body_len AS size,
    '' AS md5, '' AS sha1, '' AS sha256 FROM http_requests WHERE filename <> ''
    UNION ALL SELECT CAST(timestamp AS VARCHAR), source_ip_hash, '', '', download_url, filename, mime_type, file_size, md5_hash,
    sha1_hash, sha256_hash FROM downloaded_files""", HR, DF))
EXT = r"\.exe|\.dll|\.scr|\.bat|\.cmd|\.vbs|\.ps1|\.sh|\.elf|\.bin|\.mips|\.arm|\.x86"
add("d_dwn_2_malware_extension", lambda v: d.malware_extension(v.files()), flagged(
    DF, rx("filename", EXT), "malware_extension", "filename"))
add("d_dwn_3_suspicious_get", lambda v: d.suspicious_get(v.requests()), flagged(
    HR, "method = 'GET' AND " + rx("uri", EXT + r"|\.bash|\.py|\.pl|\.php|\.jsp|\.asp"), "suspicious_get", "uri"))
add("d_dwn_4_ftp_retrieve", lambda v: d.ftp_retrieve(v.events()), flagged(
    HE, "split_part(command, ' ', 1) = 'RETR'", "ftp_retrieve", "command"))

# --- repeats, first sightings

SCANS = "SELECT source_ip_hash AS key, epoch(timestamp)::BIGINT AS sec, count(*)::BIGINT AS cnt FROM {t} WHERE {c} GROUP BY 1, 2"
add("d_ntc_dedupe", lambda v: d.dedupe(d.mining_port(v.conns())), q(
    f"SELECT min({TS}) AS ts, source_ip_hash AS source, 'mining_port' AS detection_type, 1::BIGINT AS count, "
    f"min(CAST(dest_port AS VARCHAR)) AS note, source_ip_hash AS identifier FROM {NC} WHERE {PORTSM} GROUP BY source_ip_hash", NC))
add("d_ntc_dedupe_1d", lambda v: d.dedupe(d.mining_port(v.conns()), 86400), q(
    "SELECT CAST(make_timestamp(sec * 1000000) AS VARCHAR) AS ts, key AS source, 'mining_port' AS detection_type, "
    "1::BIGINT AS count, '3333' AS note, key AS identifier FROM walked WHERE n_before = 0",
    NC, recursive=True, extra=chain_sql(SCANS.format(t=NC, c=PORTSM), "86400")))
add("d_new_hosts", lambda v: d.new_sightings(v.conns(), ["source_ip_hash"]), q(
    "SELECT key AS source_ip_hash, CAST(make_timestamp(sec * 1000000) AS VARCHAR) AS first_seen FROM walked WHERE n_before = 0",
    NC, recursive=True, extra=chain_sql(SCANS.format(t=NC, c="true"), "86400")))
add("d_new_services", lambda v: d.new_sightings(v.conns(), ["dest_ip", "dest_port", "protocol"]), q(
    "SELECT split_part(key, '#', 1) AS dest_ip, split_part(key, '#', 2)::INTEGER AS dest_port, split_part(key, '#', 3) AS protocol, "
    "CAST(make_timestamp(sec * 1000000) AS VARCHAR) AS first_seen FROM walked WHERE n_before = 0",
    NC, recursive=True, extra=chain_sql(
        f"SELECT dest_ip || '#' || dest_port || '#' || protocol AS key, epoch(timestamp)::BIGINT AS sec, count(*)::BIGINT AS cnt "
        f"FROM {NC} GROUP BY 1, 2", "86400")))

# --- cameras and routers

RQ = "rtsp_requests"
RTSP = ("SELECT CAST(timestamp AS VARCHAR) AS ts, session_id AS source, '{kind}' AS detection_type, {n}::BIGINT AS count, "
        "'{note}' AS note, session_id AS identifier FROM rtsp_requests WHERE {cond}")
add("d_rts_1_overflow", lambda v: d.rtsp_overflow(v.rtsp_requests()), q(RTSP.format(
    kind="buffer_overflow", n='length("authorization")', note="authorization longer than 1024", cond='length("authorization") > 1024'), RQ))
TRAIL = """SELECT CAST(make_timestamp(sec * 1000000) AS VARCHAR) AS ts, session_id AS source, 'brute_force' AS detection_type,
  hit AS count, 'auth requests: ' || hit AS note, session_id AS identifier FROM (
  SELECT *, unnest(generate_series(greatest(before + 1, {n} + 1)::BIGINT, (before + cnt)::BIGINT)) AS hit FROM (
   SELECT *, coalesce(sum(cnt) OVER (PARTITION BY session_id ORDER BY sec RANGE BETWEEN {w} - 1 PRECEDING AND 1 PRECEDING), 0) AS before
   FROM (SELECT session_id, epoch(timestamp)::BIGINT AS sec, count(*)::BIGINT AS cnt FROM rtsp_requests WHERE "authorization" <> ''
         GROUP BY 1, 2)))"""
add("d_rts_2_bruteforce_6h", lambda v: d.rtsp_bruteforce(v.rtsp_requests(), 1, 21600), q(TRAIL.format(n=1, w=21600), RQ))
add("d_rts_3_long_uri", lambda v: d.rtsp_long_uri(v.rtsp_requests()), q(RTSP.format(
    kind="uri_overflow", n="length(url)", note="url longer than 2048", cond="length(url) > 2048"), RQ))
add("d_rts_4_sessions", lambda v: d.rtsp_sessions(v.rtsp_requests()), q(
    "SELECT session_id, (epoch(max(timestamp)) - epoch(min(timestamp)))::BIGINT AS duration, count(*) AS requests_count "
    "FROM rtsp_requests GROUP BY 1", RQ))
add("d_upn_1_port_mapping", lambda v: d.port_mapping_abuse(v.raw("events").selectExpr(
    "event_id", f"element_at(array('urn:x#AddPortMapping', 'urn:x#DeletePortMapping', 'urn:x#GetInfo'), CAST(event_id % 3 AS INT) + 1) AS soap_action",
    "CASE WHEN event_id % 5 = 0 THEN '<u:DeletePortMapping>' ELSE '' END AS body_preview")).select(
        "event_id", "attack_detected", "attack_type"),
    "SELECT event_id, event_id % 3 < 2 OR event_id % 5 = 0 AS attack_detected, CASE WHEN event_id % 3 = 1 OR event_id % 5 = 0 "
    "THEN 'DeletePortMapping abuse' WHEN event_id % 3 = 0 THEN 'AddPortMapping abuse' ELSE '' END AS attack_type FROM events")
add("d_upn_2_ssdp_relevant", lambda v: d.ssdp_relevant(v.raw("events").selectExpr(
    "event_id", "element_at(array('SSDP:ALL', 'upnp:rootdevice', 'urn:other', NULL, 'x urn:schemas-upnp-org:service:WANIPConnection:1'), "
    "CAST(event_id % 5 AS INT) + 1) AS search_target")).select("event_id", "relevant"),
    "SELECT event_id, event_id % 5 <> 2 AS relevant FROM events")

# --- signatures

add("r1_rules", lambda v: s.rules_table(v.spark).select("sid", "rev", "proto", "classtype", "technique", "msg").join(
    v.alerts().select(F.col("signature_id").cast("int").alias("sid")).groupBy("sid").agg(F.count(F.lit(1)).alias("alerts")), "sid", "left"), q(
    "SELECT r.*, alerts FROM (VALUES " + ", ".join(
        f"({r.sid}, {r.rev}, '{r.proto}', '{r.classtype}', '{r.technique}', '{r.msg}')" for r in s.RULES)
    + ") r(sid, rev, proto, classtype, technique, msg) LEFT JOIN (SELECT signature_id, count(*) AS alerts FROM ids_alerts GROUP BY 1) a "
    "ON signature_id = sid", IA))

IN_ORDER = {  # text rules written out for DuckDB: gate and conditions, independent of the rule table
    2000002: "dest_port = 23 AND regexp_matches(payload, '(?is)^.{0,6}root.{0,45}admin')",
    2000006: "dest_port IN (22, 23) AND regexp_matches(payload, '(?i)admin.*admin')",
    2000008: "method <> '' AND regexp_matches(user_agent, '(?s)\\(\\) \\{.{0,8}:;')",
    2000009: "method <> '' AND regexp_matches(header, '(?s)\\(\\) \\{.{0,8}:;')",
    2000010: "method <> '' AND contains(lower(uri), '/../')",
    2000011: "method <> '' AND regexp_matches(uri, '(?s)(?i:/cgi-bin/).*;')",
    2000012: "method <> '' AND regexp_matches(uri, '(?i)(%27)|('')|(--)|(%23)|(#)') AND contains(lower(uri), 'union')",
    2000013: "method <> '' AND regexp_matches(uri, '\\||;|`|\\$\\(|<\\(')",
    2000026: "contains(payload, '/bin/sh')",
    2000027: "method = 'GET' AND contains(lower(uri), '.sh')",
    2000029: "method <> '' AND regexp_matches(uri, '(?is)bins/.*\\.mips')",
    2000030: "method = 'GET' AND regexp_matches(uri, '(?is)xor.*ddos')",
    2000032: "dest_port IN (21, 23, 80) AND regexp_matches(payload, '(?is)^USER .*PASS ')",
    2000033: "regexp_matches(payload, '(?s)crontab.{0,18}-e')",
    2000034: "contains(payload, 'uname -a')",
    2000036: "contains(payload, 'tar -czf')",
    1000003: "dest_port = 23 AND regexp_matches(payload, '(?s)admin.*admin')",
    1000004: "dest_port = 23 AND contains(lower(payload), '/bin/busybox')",
    1000005: "regexp_matches(payload, '(?is)wget.*http')",
    1000006: "regexp_matches(payload, '(?is)curl.*-O')",
    1000007: "dest_port = 80 AND contains(lower(uri), '/bin/sh')",
    1000008: "dest_port = 80 AND regexp_matches(body, '(?s)<\\?php.*system')",
    1000016: "contains(lower(payload), 'stratum+tcp')",
    1000017: "contains(lower(payload), 'xmrig')",
    1000019: "regexp_matches(payload, '(?is)dvr.*nvr')",
    1000021: "dest_port = 80 AND contains(header, '() {')",
    1000022: "contains(lower(payload), '${jndi:')",
    1000023: "regexp_matches(payload, '(?s)/bin/bash.*-i')",
    1000024: "regexp_matches(payload, '(?s)socket\\.socket.*subprocess')",
    1000028: "dest_port = 80 AND contains(uri, '../')",
    1000029: "dest_port = 80 AND regexp_matches(uri, '(?i)(%27)|('')|(--)|(%23)|(#)')",
    2000001: "dest_port = 23 AND regexp_matches(payload, '(?is)^.{0,34}buildroot login:')",
    2000005: "dest_port = 22 AND starts_with(payload, 'SSH-')",
    2000007: "dest_port IN (22, 23) AND regexp_matches(payload, '(?i)support.*support')",
    2000014: "dest_port = 554 AND regexp_matches(payload, '(?s)^.{0,2}DESCRIBE.*(?i:authorization:)')",
    2000017: "dest_port IN (1900, 5000) AND protocol <> 'ssdp' AND regexp_matches(payload, '(?is)addportmapping.*newexternalport')",
    2000016: "dest_port = 1900 AND protocol = 'ssdp' AND regexp_matches(payload, '(?is)^.{0,2}m-search.*ssdp:discover')",
    2000031: "regexp_matches(header, '(?s)X-Requested-With:.*XMLHttpRequest')",
    2000035: "dest_port = 22 AND regexp_matches(payload, '(?s)^SSH-.*-R ')",
    1000001: "dest_port = 22 AND contains(payload, 'Failed password')",
    1000002: "dest_port = 23 AND contains(payload, 'Login incorrect')",
    1000015: "dest_port = 1433 AND contains(lower(payload), 'xp_cmdshell')",
    1000018: "dest_port = 445 AND contains(lower(payload), '.encrypted')",
    1000030: "dest_port = 21 AND contains(payload, 'USER')",
}
UDP_SIDS = {2000016}
HTTP_SIDS = {2000008, 2000009, 2000010, 2000011, 2000012, 2000013, 2000027, 2000029, 2000030}


def _text_hits(cols: str) -> str:
    parts = []
    for sid, cond in IN_ORDER.items():
        gate = "" if sid in HTTP_SIDS | UDP_SIDS else " AND protocol <> 'ssdp'"
        parts.append(f"SELECT {cols}, {sid} AS sid FROM signature_rows WHERE {cond}{gate}")
    return " UNION ALL ".join(parts)


add("r2_match_text", lambda v: s.match_rules(v.signature_rows()).select("row_kind", "row_id", "sid"), q(
    _text_hits("row_kind, row_id"), "signature_rows"))
BYTES = f"""byte_rows AS (SELECT event_id AS row_id, event_id % 5 AS form, {K} AS k, lpad(printf('%X', {K}), 2, '0') AS kx,
    {h('user_id')} AS source_ip_hash, {SECOND} AS timestamp FROM events)"""
# which byte rules the built payloads meet, worked out from how they are built
add("r3_match_bytes", lambda v: s.match_rules(v.byte_rows(), binary=True).select("row_id", "sid"), q(
    """SELECT row_id, 2000018 AS sid FROM byte_rows WHERE form = 0 AND (k & 16) <> 0
    UNION ALL SELECT row_id, 2000019 FROM byte_rows WHERE form = 0 AND k % 8 = 3
    UNION ALL SELECT row_id, 2000021 FROM byte_rows WHERE form = 0 AND k % 8 = 5
    UNION ALL SELECT row_id, 2000038 FROM byte_rows WHERE form = 0 AND k % 8 = 6
    UNION ALL SELECT row_id, 1000011 FROM byte_rows WHERE form = 0 AND false
    UNION ALL SELECT row_id, 2000023 FROM byte_rows WHERE form = 1
    UNION ALL SELECT row_id, 1000009 FROM byte_rows WHERE form = 1
    UNION ALL SELECT row_id, 2000020 FROM byte_rows WHERE form = 2 AND k % 2 = 0
    UNION ALL SELECT row_id, 1000013 FROM byte_rows WHERE form = 3 AND k % 2 = 0
    UNION ALL SELECT row_id, 2000015 FROM byte_rows WHERE form = 4 AND k * 256 > 1024""", extra=BYTES))

SCAN = {
    2000003: "dest_port = 2323 AND conn_state = 'S0'",
    2000024: "dest_port IN (21, 22, 23, 80, 443, 554, 8080, 8081) AND conn_state = 'S0'",
    2000025: "conn_state = 'S0'",
    2000028: "dest_port IN (6667, 6697, 8080, 31337, 12345)",
    2000037: "dest_port = 502",
    1000014: "dest_port = 3306",
    1000020: "dest_port = 81 AND conn_state = 'S0'",
    1000025: "conn_state = 'S0'",
    1000026: "history = ''",
}
SCAN_SQL = " UNION ALL ".join(
    f"SELECT uid, source_ip_hash, timestamp, {sid} AS sid FROM network_connections WHERE {cond} AND protocol <> 'ssdp'"
    for sid, cond in SCAN.items())
add("r4_scan_rules", lambda v: s.scan_hits(v.conns()).select("uid", "sid"), q(f"SELECT uid, sid FROM ({SCAN_SQL})", NC))


def rated(n: int, seconds: int, mode: str, hits: str, *views: str) -> str:
    cells = (f"SELECT sid || '#' || source_ip_hash AS key, epoch(timestamp)::BIGINT AS sec, count(*)::BIGINT AS cnt "
             f"FROM ({hits}) GROUP BY 1, 2")
    return q("SELECT CAST(make_timestamp(sec * 1000000) AS VARCHAR) AS timestamp, split_part(key, '#', 1)::INTEGER AS sid, "
             f"split_part(key, '#', 2) AS source_ip_hash, hit FROM {fire_sql(str(n), mode)}",
             *views, recursive=True, extra=chain_sql(cells, str(seconds)))


for _id, _mode in (("r5", "threshold"), ("r6", "both"), ("r7", "limit")):
    add(f"{_id}_{_mode}_1d", lambda v, m=_mode: s.rate(s.scan_hits(v.conns()), 3, 86400, m), rated(3, 86400, _mode, SCAN_SQL, NC))
OWN = {2000003: ("threshold", 10, 60), 2000024: ("threshold", 8, 10), 2000025: ("threshold", 50, 60),
       2000028: ("both", 3, 300), 2000037: ("both", 100, 10), 1000025: ("threshold", 20, 10), 1000026: ("threshold", 10, 10)}


def _by_rule(i: int, other: str) -> str:
    return "CASE split_part({k}, '#', 1) " + " ".join(f"WHEN '{sid}' THEN {r[i]!r}" for sid, r in OWN.items()) + f" ELSE {other} END"


def own_rates() -> str:
    """Every rule's own count and window; rules without a rate (id 1000020 here) alert on each hit."""
    hits = " UNION ALL ".join(
        f"SELECT source_ip_hash, timestamp, {sid} AS sid FROM dense_conns WHERE {cond}" for sid, cond in SCAN.items())
    cells = (f"SELECT sid || '#' || source_ip_hash AS key, epoch(timestamp)::BIGINT AS sec, count(*)::BIGINT AS cnt "
             f"FROM ({hits}) GROUP BY 1, 2")
    kind, n = _by_rule(0, "'free'").format(k="key"), _by_rule(1, "1").format(k="key")
    lo = f"CASE {kind} WHEN 'threshold' THEN ((n_before + {n}) // {n}) * {n} WHEN 'both' THEN greatest(n_before + 1, {n}) ELSE 1 END"
    hi = f"CASE {kind} WHEN 'both' THEN least(n_before + cnt, {n}) WHEN 'threshold' THEN n_before + cnt ELSE cnt END"
    step = f"CASE {kind} WHEN 'threshold' THEN {n} ELSE 1 END"
    return q("SELECT CAST(make_timestamp(sec * 1000000) AS VARCHAR) AS timestamp, split_part(key, '#', 1)::INTEGER AS sid, "
             "split_part(key, '#', 2) AS source_ip_hash, hit FROM (SELECT *, unnest(generate_series("
             f"({lo})::BIGINT, ({hi})::BIGINT, ({step})::BIGINT)) AS hit FROM walked)",
             "dense_conns", recursive=True, extra=chain_sql(cells, "(" + _by_rule(2, "1").format(k="c.key") + ")"))


add("r5_own_rates", lambda v: s.apply_rates(s.scan_hits(v.dense_conns(), as_list=True)), own_rates())
add("r8_suppress", lambda v: s.suppress(
    v.alerts().withColumns({"sid": F.col("signature_id"), "src_ip": F.concat(F.lit("192.168."), F.col("alert_id") % 4, F.lit("."), F.col("alert_id") % 250)}),
    [(2000024, "192.168.1.0/24"), (2000005, "192.168.1.50")]).select("alert_id", "signature_id"), q(
    "SELECT alert_id, signature_id FROM ids_alerts WHERE NOT (signature_id = 2000024 AND alert_id % 4 = 1) "
    "AND NOT (signature_id = 2000005 AND alert_id % 4 = 1 AND alert_id % 250 = 50)", IA))
add("r8_suppress_sources", lambda v: s.suppress_sources(
    v.alerts().withColumn("sid", F.col("signature_id")),
    v.test_sources().select(F.lit(2000024).cast("long").alias("sid"), F.col("ip_hash").alias("source_ip_hash"))).select(
        "alert_id", "signature_id"), q(
    "SELECT alert_id, signature_id FROM ids_alerts WHERE NOT (signature_id = 2000024 AND source_ip_hash IN "
    "(SELECT ip_hash FROM test_sources))", IA, "test_sources"))
add("r9_beacon_1d", lambda v: s.rate(s.beacon_hits(v.conns()), 3, 86400, "threshold"), rated(
    3, 86400, "threshold", "SELECT 1000027 AS sid, source_ip_hash, timestamp FROM network_connections "
    "WHERE local_orig AND orig_pkts > 0 AND orig_bytes / orig_pkts < 100", NC))
add("r10_alert_rows", lambda v: s.to_alerts(s.scan_hits(v.conns()).select("uid", "sid", "source_ip_hash", "timestamp")).select(
    "uid", "signature_id", "alert_signature", "alert_category", "revision", "mitre_technique_id", "mitre_tactic"), q(
    f"""SELECT uid, sid::BIGINT AS signature_id, m AS alert_signature, c AS alert_category, 1 AS revision,
    t AS mitre_technique_id, y AS mitre_tactic FROM ({SCAN_SQL}) JOIN (VALUES
    (2000003, 'IoT Mirai botnet - Alternative Telnet port scan', 'attempted-recon', 'T1595.001', 'Reconnaissance'),
    (2000024, 'IoT Multi-port scan detected', 'attempted-recon', 'T1046', 'Discovery'),
    (2000025, 'IoT Aggressive port scanner - Masscan/Zmap signature', 'attempted-recon', 'T1595.001', 'Reconnaissance'),
    (2000028, 'IoT C2 beacon to suspicious port', 'trojan-activity', 'T1071', 'Command and Control'),
    (2000037, 'ICS Denial of service via Modbus flooding', 'attempted-dos', 'T0815', 'ICS Impact'),
    (1000025, 'HONEYPOT SYN Scan Detected', 'attempted-recon', '', ''),
    (1000026, 'HONEYPOT NULL Scan Detected', 'attempted-recon', '', '')) r(s, m, c, t, y) ON sid = r.s""", NC))
