"""Raw log lines written from the driver's tables, one line per source row.

They give the readers and normalisers whole tables of input in the producers' own
formats. The SQL side states the expected rows directly from the source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import scratch_path
from ..schemas import ZEEK_CONN_TSV
from .views import DEST, K, SESSION, Views, _pick

ISO = "date_format(CAST(ts AS TIMESTAMP), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"
IP = "concat(user_id % 30, '.', event_id % 256, '.1.1')"
PORT = "CAST(1024 + event_id % 60000 AS INT)"
EPOCH = "unix_micros(CAST(ts AS TIMESTAMP)) / 1000000"

# Fixed here: which log event a driver event stands for.
COWRIE_ID = f"""CASE WHEN {K} % 10 = 9 THEN 'cowrie.session.closed' WHEN {K} % 10 = 8 THEN 'cowrie.client.version'
  WHEN event_type = 'click' THEN 'cowrie.command.input' WHEN event_type = 'view' THEN 'cowrie.session.connect'
  WHEN event_type = 'purchase' THEN 'cowrie.login.success' WHEN event_type = 'signup' THEN 'cowrie.login.failed'
  ELSE 'cowrie.session.file_download' END"""


def _json(v: Views, fields: dict, extra: str = "") -> DataFrame:
    """One JSON text per event; null fields are left out. ``extra`` is SQL giving leading members as text."""
    inner = ", ".join(f"{sql} AS `{name}`" for name, sql in fields.items())
    body = f"to_json(struct({inner}))"
    value = f"concat('{{', {extra}, ',', substring({body}, 2))" if extra else body
    # a generator, so that filters on the text above do not write it a second time
    return v.base().selectExpr(f"inline(array(struct({value} AS value)))")


def cowrie(v: Views) -> DataFrame:
    login = f"({COWRIE_ID}) LIKE 'cowrie.login.%'"
    load = f"({COWRIE_ID}) = 'cowrie.session.file_download'"
    return _json(v, {
        "timestamp": ISO, "eventid": COWRIE_ID, "src_ip": IP, "src_port": PORT, "dst_ip": DEST, "dst_port": "22",
        "protocol": "'ssh'", "session": SESSION,
        "username": f"CASE WHEN {login} THEN concat('u', user_id % 7) END",
        "password": f"CASE WHEN {login} AND event_id % 9 <> 0 THEN concat('p', {K}) END",
        "input": f"CASE WHEN ({COWRIE_ID}) = 'cowrie.command.input' THEN concat('run ', {K}) END",
        "url": f"CASE WHEN {load} THEN concat('http://h/', {K}) END",
        "shasum": f"CASE WHEN {load} THEN sha2(CAST({K} AS STRING), 256) END",
        "outfile": f"CASE WHEN {load} THEN concat('/tmp/', {K}) END",
        "size": f"CASE WHEN {load} AND event_id % 2 = 0 THEN event_id END",
    })


DIONAEA_URL = _pick(["() { :; }; id", "/../../etc/passwd", "/?q=UNION SELECT 1", "/index"], "event_id % 4")


def dionaea(v: Views) -> DataFrame:
    return _json(v, {
        "timestamp": f"CAST(CAST({EPOCH} AS DECIMAL(20,6)) AS STRING)", "connection": "CAST(event_id AS STRING)",
        "connection_type": f"CASE {K} % 5 WHEN 0 THEN 'http' WHEN 1 THEN 'smb' WHEN 2 THEN 'download' WHEN 3 THEN 'mssql' END",
        "connection_remote_host": f"CASE WHEN event_id % 3 = 0 THEN {IP} END",
        "remote_host": f"CASE WHEN event_id % 3 = 1 THEN {IP} END", "src_ip": f"CASE WHEN event_id % 3 = 2 THEN {IP} END",
        "connection_remote_port": PORT, "connection_local_host": DEST, "connection_local_port": "445",
        "connection_protocol": "'tcp'", "url": f"CASE WHEN {K} % 5 = 0 THEN {DIONAEA_URL} END",
        "md5_hash": f"CASE WHEN {K} % 5 = 2 AND event_id % 3 > 0 THEN md5(CAST({K} AS STRING)) END",
        "sha512_hash": f"CASE WHEN {K} % 5 = 2 THEN sha2(CAST({K} AS STRING), CASE WHEN event_id % 2 = 0 THEN 512 ELSE 256 END) END",
        "filename": f"CASE WHEN {K} % 5 = 2 THEN 'x.bin' END",
    })


REQUEST = "CASE {k} % 6 WHEN 0 THEN 'Write registers' WHEN 1 THEN 'read coils' WHEN 2 THEN 'diag' WHEN 3 THEN 'GET / HTTP/1.1' END"
DATA_TYPE = "CASE event_id % 5 WHEN 0 THEN 'modbus' WHEN 1 THEN 'bacnet' WHEN 2 THEN 's7comm' WHEN 3 THEN 'http' END"


def conpot(v: Views) -> DataFrame:
    remote = (f"CASE WHEN event_id % 2 = 0 THEN concat('\"remote\":[\"', {IP}, '\",', {PORT}, ']') "
              f"ELSE concat('\"remote\":\"', {IP}, ':', {PORT}, '\"') END")
    public = "CASE WHEN event_id % 4 = 0 THEN '' ELSE ',\"public_ip\":[\"172.20.0.12\",5020]' END"
    return _json(v, {
        "timestamp": "date_format(CAST(ts AS TIMESTAMP), 'yyyy-MM-dd HH:mm:ss')", "id": "CAST(event_id AS STRING)",
        "data_type": DATA_TYPE, "request": REQUEST.format(k=K), "session_id": SESSION,
        "function_code": f"CASE WHEN event_id % 3 = 0 THEN {K} END", "slave_id": f"CASE WHEN event_id % 6 = 0 THEN {K} % 8 END",
    }, f"concat({remote}, {public})")


def rtsp(v: Views) -> DataFrame:
    info = f"CASE WHEN event_id % 4 = 0 THEN concat('\"attack_info\":{{\"type\":\"buffer_overflow\",\"header_length\":', {K}, '}}') ELSE '\"x\":1' END"
    return _json(v, {
        "timestamp": ISO, "event_type": "'rtsp_request'", "session_id": SESSION, "src_ip": IP,
        "src_port": f"CASE WHEN event_id % 5 <> 0 THEN {PORT} END", "dest_ip": DEST,
        "dest_port": "CASE WHEN event_id % 7 <> 0 THEN 8554 END", "method": _pick(["OPTIONS", "DESCRIBE", "SETUP"], "event_id % 3"),
        "url": f"concat('rtsp://cam/', {K})", "authenticated": "event_id % 11 = 0",
        "attack_detected": "event_id % 4 = 0 OR event_id % 6 = 0",
        "attack_type": "CASE WHEN event_id % 4 = 0 THEN 'CVE-2014-8361 buffer overflow' END",
    }, info)


def upnp(v: Views) -> DataFrame:
    params = f"CASE WHEN event_id % 3 = 0 THEN map('NewExternalPort', CAST(8000 + {K} AS STRING), 'NewProtocol', 'TCP') END"
    return _json(v, {
        "timestamp": ISO, "event_type": "'soap_request'", "session_id": f"CASE WHEN event_id % 2 = 0 THEN {SESSION} END",
        "src_ip": IP, "src_port": PORT, "dest_ip": DEST, "dest_port": "CASE WHEN event_id % 5 = 0 THEN 49152 END",
        "protocol": "'http'", "soap_action": "'urn:x#AddPortMapping'", "action": "'AddPortMapping'", "params": params,
        "attack_detected": "event_id % 3 = 0", "attack_type": "CASE WHEN event_id % 3 = 0 THEN 'AddPortMapping abuse' END",
        "body_preview": "CAST(event_id AS STRING)",
    })


TECH = _pick(["T1190", "T1110.001", "T0855", "T9999", "T1046"], f"{K} % 5")


def suricata(v: Views) -> DataFrame:
    meta = (f"CASE event_id % 5 WHEN 0 THEN concat('[\"mitre_technique_id ', {TECH}, '\",\"mitre_tactic_id TA0010\"]') "
            f"WHEN 1 THEN concat('{{\"mitre_technique_id\":\"', {TECH}, '\"', CASE WHEN {K} % 2 = 0 THEN ',\"mitre_tactic_id\":\"lateral-movement\"' ELSE '' END, '}}') "
            f"WHEN 2 THEN concat('[{{\"mitre_technique_id\":\"', {TECH}, '\"}},{{\"mitre_tactic\":\"Named\"}}]') "
            f"WHEN 3 THEN concat('{{\"mitre_technique_id\":[\"', {TECH}, '\"],\"mitre_tactic_id\":[\"TA0040\"]}}') ELSE 'null' END")
    alert = (f"concat('\"alert\":{{\"signature\":\"SIG\",\"category\":\"cat\",\"severity\":', 1 + event_id % 4, ',\"signature_id\":', "
             f"2000000 + {K}, ',\"rev\":1,\"metadata\":', {meta}, '}}')")
    return _json(v, {
        "timestamp": ISO, "event_type": "CASE WHEN event_type = 'view' THEN 'flow' ELSE 'alert' END", "flow_id": "event_id",
        "src_ip": IP, "src_port": PORT, "dest_ip": DEST, "dest_port": "80", "proto": "'TCP'",
        "payload_printable": f"CASE WHEN event_id % 2 = 0 THEN concat('p', {K}) END",
    }, alert)


def zeek_conn(v: Views) -> DataFrame:
    return _json(v, {
        "ts": EPOCH, "uid": "concat('C', event_id)", "id": f"named_struct('orig_h', {IP}, 'orig_p', {PORT}, 'resp_h', {DEST}, 'resp_p', 23)",
        "proto": "'tcp'", "service": "CASE WHEN event_id % 3 = 0 THEN 'ssh' END", "duration": "value",
        "orig_bytes": f"CASE WHEN event_id % 4 <> 0 THEN {K} * 10 END", "resp_bytes": f"{K}", "conn_state": "'SF'", "history": "'ShAD'",
        "orig_pkts": f"{K}",
    })


def zeek_http(v: Views) -> DataFrame:
    return _json(v, {
        "ts": EPOCH, "uid": "concat('H', event_id)", "id.orig_h": IP, "id.orig_p": PORT, "id.resp_h": DEST, "id.resp_p": "80",
        "method": "'GET'", "host": "'h'", "uri": f"concat('/', {K})", "user_agent": "CASE WHEN event_id % 2 = 0 THEN 'curl' END",
        "status_code": "200", "response_body_len": "event_id",
    })


def zeek_dns(v: Views) -> DataFrame:
    return _json(v, {
        "ts": EPOCH, "uid": "concat('D', event_id)", "id.orig_h": IP, "id.orig_p": PORT, "id.resp_h": DEST, "id.resp_p": "53",
        "query": f"concat('host', {K}, '.example')", "qtype_name": "'A'",
    })


def zeek_ssh(v: Views) -> DataFrame:
    return _json(v, {
        "ts": EPOCH, "uid": "concat('S', event_id)", "id.orig_h": IP, "id.orig_p": PORT, "id.resp_h": DEST, "id.resp_p": "22",
        "auth_success": "CASE WHEN event_id % 3 < 2 THEN event_id % 3 = 0 END", "auth_attempts": "1",
    })


def zeek_tsv(v: Views) -> DataFrame:
    """Lines of a tab-separated log, ``-`` for unset; every hundredth is preceded by comments and a blank line."""
    cells = {
        "ts": f"CAST(CAST({EPOCH} AS DECIMAL(20,6)) AS STRING)", "uid": "concat('C', event_id)", "id.orig_h": IP, "id.orig_p": PORT,
        "id.resp_h": DEST, "id.resp_p": "23", "proto": "'tcp'", "service": "'-'", "duration": "CASE WHEN event_id % 3 = 0 THEN '-' ELSE CAST(value AS STRING) END",
        "orig_bytes": f"CASE WHEN event_id % 4 = 0 THEN '-' ELSE CAST({K} * 10 AS STRING) END", "resp_bytes": f"{K}", "conn_state": "'SF'",
        "history": "'ShAD'", "orig_pkts": f"{K}",
    }
    line = "concat_ws('\\t', " + ", ".join(f"CAST({cells.get(c, repr('-'))} AS STRING)" for c in ZEEK_CONN_TSV) + ")"
    rows = v.base().selectExpr(f"CASE WHEN event_id % 100 = 0 THEN array('#fields', '', {line}) ELSE array({line}) END AS l")
    return rows.selectExpr("explode(l) AS value")


def write_lines(lines: DataFrame, label: str, name: str = "part.log") -> str:
    """Lines as text files in a fresh folder; ``name`` only labels the folder's last part."""
    path = f"{scratch_path(lines.sparkSession, label)}/{name}"
    lines.write.text(path)
    return path
