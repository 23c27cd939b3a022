"""Canonical tables: columns in order, retention and sort order.

Text columns default to '', numbers to 0 and booleans to false; no column of an
event table is null once :func:`wardlake.operators.normalise.conform` has run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    name: str
    ddl: str
    sort: tuple[str, ...]
    ttl_days: int | None
    time_col: str = "timestamp"

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()


# Column names, order, retention and sort keys of the event tables.
TABLES = {
    t.name: t
    for t in [
        Table(
            "honeypot_events",
            "timestamp timestamp, event_id string, honeypot_type string, source_ip_hash string, "
            "source_ip_country string, source_port int, dest_ip string, dest_port int, protocol string, "
            "event_type string, username string, password string, command string, session_id string, "
            "success boolean, raw_data string",
            ("timestamp", "honeypot_type", "source_ip_hash"),
            90,
        ),
        Table(
            "ids_alerts",
            "timestamp timestamp, alert_id string, source_ip_hash string, source_ip_country string, "
            "source_port int, dest_ip string, dest_port int, protocol string, alert_signature string, "
            "alert_category string, alert_severity int, signature_id long, revision int, payload string, "
            "mitre_technique_id string, mitre_tactic string",
            ("timestamp", "alert_severity", "source_ip_hash"),
            90,
        ),
        Table(
            "network_connections",
            "timestamp timestamp, uid string, source_ip_hash string, source_ip_country string, "
            "source_port int, dest_ip string, dest_port int, protocol string, service string, "
            "duration float, orig_bytes long, resp_bytes long, conn_state string, local_orig boolean, "
            "local_resp boolean, missed_bytes long, history string, orig_pkts long, resp_pkts long",
            ("timestamp", "source_ip_hash", "dest_port"),
            30,
        ),
        Table(
            "http_requests",
            "timestamp timestamp, source_ip_hash string, source_ip_country string, source_port int, "
            "dest_ip string, dest_port int, method string, host string, uri string, user_agent string, "
            "referrer string, status_code int, response_body_len long, request_body string",
            ("timestamp", "source_ip_hash", "uri"),
            90,
        ),
        Table(
            "downloaded_files",
            "timestamp timestamp, file_id string, source_ip_hash string, honeypot_type string, "
            "filename string, file_size long, mime_type string, md5_hash string, sha1_hash string, "
            "sha256_hash string, download_url string, file_path string",
            ("timestamp", "md5_hash"),
            180,
        ),
        Table(
            "credentials",
            "timestamp timestamp, source_ip_hash string, honeypot_type string, protocol string, "
            "username string, password string, success boolean, session_id string",
            ("timestamp", "username", "password"),
            90,
        ),
        Table(
            "rtsp_attacks",
            "timestamp timestamp, attack_id string, source_ip_hash string, source_ip_country string, "
            "source_port int, dest_ip string, dest_port int, attack_type string, rtsp_method string, "
            "rtsp_url string, attack_details string",
            ("timestamp", "attack_type", "source_ip_hash"),
            90,
        ),
        Table(
            "upnp_attacks",
            "timestamp timestamp, attack_id string, source_ip_hash string, source_ip_country string, "
            "source_port int, dest_ip string, dest_port int, attack_type string, soap_action string, "
            "upnp_action string, external_port string, internal_port string, internal_client string, "
            "protocol string, attack_details string",
            ("timestamp", "attack_type", "source_ip_hash"),
            90,
        ),
        Table(
            "attacker_profiles",
            "source_ip_hash string, first_seen timestamp, last_seen timestamp, total_events long, "
            "unique_ports_targeted array<int>, protocols_used array<string>, countries array<string>, "
            "attack_types array<string>, credential_attempts long, successful_logins long, "
            "files_downloaded long",
            ("source_ip_hash", "first_seen"),
            None,
            "first_seen",
        ),
        # name queries and log-in attempts of the network sensor: what the mining and shell detections read
        Table("dns_queries", "timestamp timestamp, source_ip_hash string, query string", ("timestamp", "source_ip_hash"), 30),
        Table(
            "ssh_auth",
            "timestamp timestamp, source_ip_hash string, dest_ip string, dest_port int, authenticated boolean",
            ("timestamp", "source_ip_hash"),
            30,
        ),
    ]
}

# The sensor kinds an event may come from.
SENSORS = ("cowrie", "dionaea", "conpot", "rtsp", "upnp")

# Names used by older documents and dashboards -> canonical column.
ALIASES = {
    "honeypot_name": "honeypot_type",
    "signature": "alert_signature",
    "category": "alert_category",
    "severity": "alert_severity",
    "orig_h": "source_ip_hash",
    "resp_h": "dest_ip",
    "resp_p": "dest_port",
    "proto": "protocol",
    "file_hash": "sha256_hash",
    "source_ip_anon": "source_ip_hash",
    "country_code": "source_ip_country",
    "attack_technique": "mitre_technique_id",
    "attack_tactic": "mitre_tactic",
}

# Raw log layouts (superset of the fields any producer writes). Fields that come
# in more than one JSON shape are read as text and taken apart later.
RAW = {
    "cowrie": "timestamp string, eventid string, src_ip string, src_port int, dst_ip string, dst_port int, "
    "protocol string, session string, username string, password string, input string, url string, "
    "shasum string, outfile string, filename string, size long, duration double",
    "dionaea": "timestamp string, connection string, connection_type string, connection_remote_host string, "
    "remote_host string, src_ip string, connection_remote_port int, connection_local_host string, "
    "connection_local_port int, connection_protocol string, url string, user_agent string, method string, "
    "md5_hash string, sha512_hash string, filename string, file_size long, download_url string",
    "conpot": "timestamp string, id string, remote string, public_ip string, data_type string, "
    "request string, session_id string, function_code string, slave_id string, unit_id string",
    "rtsp": "timestamp string, honeypot_type string, event_type string, session_id string, src_ip string, "
    "src_port int, dest_ip string, dest_port int, protocol string, method string, url string, "
    "response_code int, authenticated boolean, attack_detected boolean, attack_type string, "
    "attack_info string, duration double, requests_count int",
    "upnp": "timestamp string, honeypot_type string, event_type string, session_id string, src_ip string, "
    "src_port int, dest_ip string, dest_port int, protocol string, search_target string, "
    "man_header string, mx string, path string, soap_action string, action string, "
    "params map<string,string>, body_preview string, attack_detected boolean, attack_type string, "
    "user_agent string, details map<string,string>",
    "suricata": "timestamp string, event_type string, flow_id long, src_ip string, src_port int, "
    "dest_ip string, dest_port int, proto string, payload_printable string, "
    "alert struct<signature:string,category:string,severity:int,signature_id:long,rev:int,metadata:string>",
    "zeek_conn": "ts double, uid string, `id.orig_h` string, `id.orig_p` int, `id.resp_h` string, "
    "`id.resp_p` int, proto string, service string, duration double, orig_bytes long, resp_bytes long, "
    "conn_state string, local_orig boolean, local_resp boolean, missed_bytes long, history string, "
    "orig_pkts long, orig_ip_bytes long, resp_pkts long, resp_ip_bytes long, "
    "id struct<orig_h:string,orig_p:int,resp_h:string,resp_p:int>",
    "zeek_http": "ts double, uid string, `id.orig_h` string, `id.orig_p` int, `id.resp_h` string, "
    "`id.resp_p` int, method string, host string, uri string, user_agent string, referrer string, "
    "status_code int, response_body_len long, id struct<orig_h:string,orig_p:int,resp_h:string,resp_p:int>",
    "zeek_dns": "ts double, uid string, `id.orig_h` string, `id.orig_p` int, `id.resp_h` string, "
    "`id.resp_p` int, query string, qtype_name string, "
    "id struct<orig_h:string,orig_p:int,resp_h:string,resp_p:int>",
    "zeek_ssh": "ts double, uid string, `id.orig_h` string, `id.orig_p` int, `id.resp_h` string, "
    "`id.resp_p` int, auth_success boolean, auth_attempts int, "
    "id struct<orig_h:string,orig_p:int,resp_h:string,resp_p:int>",
}

# The 20 columns of a tab-separated connection log, in file order.
ZEEK_CONN_TSV = (
    "ts uid id.orig_h id.orig_p id.resp_h id.resp_p proto service duration orig_bytes resp_bytes "
    "conn_state local_orig local_resp missed_bytes history orig_pkts orig_ip_bytes resp_pkts resp_ip_bytes"
).split()
