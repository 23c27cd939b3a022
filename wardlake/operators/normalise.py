"""Raw log rows -> canonical table rows.

Every function is a chain of column expressions: time, country, pseudonym, class
names, renames, defaults, in that order, so that the raw address is only needed
up to the point where it is dropped. Geo ranges are optional; without them the
country stays ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classify, lists
from ..functions.classify import lookup
from ..functions.identity import anon_ip
from ..functions.timing import parse_ts
from ..schemas import TABLES
from .geo import geo_enrich

PII = ("src_ip", "remote_host", "orig_h", "temp_ip", "geoip")


def _default(dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, (T.TimestampType, T.ArrayType)):
        return F.lit(None).cast(dtype)
    return F.lit(0).cast(dtype)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns, order, types and defaults of a canonical table.

    Missing columns get the default; values that do not cast get it too, so one bad
    field never loses its row. The identity of the line that a row was read from stays, if it is known.
    """
    out = [F.col("line_id")] if "line_id" in df.columns else []
    for field in TABLES[table].schema.fields:
        if field.name not in df.columns:
            out.append(_default(field.dataType).alias(field.name))
            continue
        value = F.col(f"`{field.name}`").try_cast(field.dataType)
        if not isinstance(field.dataType, (T.TimestampType, T.ArrayType)):
            value = F.coalesce(value, _default(field.dataType))
        out.append(value.alias(field.name))
    return df.select(*out[1:], out[0]) if "line_id" in df.columns else df.select(*out)


def rename_aliases(df: DataFrame, aliases: dict) -> DataFrame:
    """Older column names -> canonical ones, where the canonical one is not there yet."""
    return df.withColumnsRenamed({k: v for k, v in aliases.items() if k in df.columns and v not in df.columns})


def drop_pii(df: DataFrame) -> DataFrame:
    return df.drop(*PII)


def _identify(df: DataFrame, ip: str, salt: str, ranges: DataFrame | None) -> DataFrame:
    """Country first (it needs the raw address), then the pseudonym."""
    placed = geo_enrich(df, ip, ranges) if ranges is not None else df.withColumn("source_ip_country", F.lit(""))
    return placed.withColumn("source_ip_hash", F.coalesce(anon_ip(ip, salt), F.lit("")))


def _raw_line(df: DataFrame) -> DataFrame:
    """Keep the line as read; rows that came without it get it rebuilt from their fields."""
    return df if "raw_data" in df.columns else df.withColumn("raw_data", F.to_json(F.struct("*")))


def cowrie_normalise(raw: DataFrame, salt: str, ranges: DataFrame | None = None) -> DataFrame:
    """Shell-sensor lines with canonical names, still wide enough to fan out."""
    df = _identify(_raw_line(raw).withColumn("timestamp", parse_ts("timestamp")), "src_ip", salt, ranges)
    return drop_pii(
        df.withColumns(
            {
                "event_type": classify.cowrie_event_type("eventid"),
                "honeypot_type": F.lit("cowrie"),
                "success": F.coalesce(F.col("eventid") == "cowrie.login.success", F.lit(False)),
            }
        ).withColumnsRenamed(
            {"session": "session_id", "src_port": "source_port", "dst_ip": "dest_ip", "dst_port": "dest_port",
             "input": "command"}
        )
    ).withColumn("event_id", F.col("session_id"))


def to_credentials(df: DataFrame) -> DataFrame:
    """Rows that carry a user and a password, as ``credentials``."""
    return conform(df.filter(F.col("username").isNotNull() & F.col("password").isNotNull()), "credentials")


def cowrie_downloads(df: DataFrame) -> DataFrame:
    got = df.filter(F.col("event_type") == "file_download")
    return conform(
        got.withColumns(
            {
                "file_id": F.col("shasum"),
                "file_size": F.col("size"),
                "sha256_hash": F.col("shasum"),
                "download_url": F.col("url"),
                "file_path": F.col("outfile"),
            }
        ),
        "downloaded_files",
    )


def dionaea_downloads(df: DataFrame) -> DataFrame:
    """Rows with an MD5 or SHA-512; the latter only fits ``sha256_hash`` when 64 long."""
    got = df.filter(F.col("md5_hash").isNotNull() | F.col("sha512_hash").isNotNull())
    digest = F.when(F.length("sha512_hash") == 64, F.col("sha512_hash")).otherwise("")
    # this sensor's size is not carried over
    return conform(
        got.withColumns({"file_id": F.col("md5_hash"), "sha256_hash": digest, "file_size": F.lit(0)}).drop("download_url"),
        "downloaded_files",
    )


def to_downloads(df: DataFrame, sensor: str) -> DataFrame:
    return cowrie_downloads(df) if sensor == "cowrie" else dionaea_downloads(df)


def dionaea_normalise(raw: DataFrame, salt: str, ranges: DataFrame | None = None) -> DataFrame:
    df = _raw_line(raw).withColumns(
        {
            "timestamp": parse_ts("timestamp"),
            "remote_host": F.coalesce("connection_remote_host", "remote_host", "src_ip"),
        }
    )
    df = _identify(df, "remote_host", salt, ranges).drop("connection_remote_host")
    return drop_pii(
        df.withColumnsRenamed(
            {"connection_remote_port": "source_port", "connection_local_host": "dest_ip",
             "connection_local_port": "dest_port", "connection_protocol": "protocol"}
        ).withColumns(
            {
                "event_type": F.coalesce("connection_type", F.lit("connection")),
                "honeypot_type": F.lit("dionaea"),
                "event_id": F.col("connection"),
                "session_id": F.col("connection"),
            }
        )
    )


def split_remote(df: DataFrame, col: str = "remote") -> DataFrame:
    """``"ip:port"`` or ``["ip", port]`` -> ``temp_ip`` and ``source_port``."""
    text = F.trim(F.col(col))
    listed = F.from_json(text, "array<string>")
    parts = F.when(text.startswith("["), listed).otherwise(F.split(text, ":"))
    return df.withColumns(
        {"temp_ip": F.try_element_at(parts, F.lit(1)), "source_port": F.try_element_at(parts, F.lit(2)).try_cast("int")}
    )


def ics_metadata(df: DataFrame) -> Column:
    """JSON of the control fields that are set, null when none is."""
    fields = ("function_code", "slave_id", "unit_id")
    any_set = F.coalesce(*[F.col(c) for c in fields]).isNotNull()
    return F.when(any_set, F.to_json(F.struct(*fields)))


def conpot_normalise(raw: DataFrame, salt: str, ranges: DataFrame | None = None) -> DataFrame:
    """Control-sensor lines; the sensor's own (public) port is the target port."""
    df = split_remote(_raw_line(raw).withColumn("timestamp", parse_ts("timestamp")))
    df = _identify(df, "temp_ip", salt, ranges)
    own = F.try_element_at(F.from_json("public_ip", "array<string>"), F.lit(2)).try_cast("int")
    return drop_pii(
        df.withColumns(
            {
                "protocol": F.col("data_type"),
                "event_type": F.when(F.col("request").isNotNull(), "request").otherwise("connection"),
                "command": F.col("request"),
                "honeypot_type": F.lit("conpot"),
                "event_id": F.col("id"),
                "dest_port": classify.default_port(own, "data_type"),
                "metadata": ics_metadata(df),
            }
        ).drop("remote")
    )


# --- intrusion alerts


def mitre_extract(metadata: Column | str, key: str) -> Column:
    """A value from alert metadata in any of its four JSON shapes.

    ``["k v", ...]``, ``{"k": "v"}``, ``[{"k": "v"}, ...]`` and ``{"k": ["v", ...]}``. A list
    is read by its last entry that has the key, an inner list by its first.
    """
    text = F.trim(F.coalesce(F.col(metadata) if isinstance(metadata, str) else metadata, F.lit("")))
    items = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))

    def of_object(obj):
        raw = F.get_json_object(obj, f"$.{key}")
        first = F.try_element_at(F.from_json(raw, "array<string>"), F.lit(1))
        return F.when(raw.startswith("["), first).otherwise(raw)

    def of_item(item):
        word = F.split(F.trim(item), r"\s+")
        rest = F.trim(F.regexp_replace(F.trim(item), r"^\S+", ""))
        return F.when(F.ltrim(item).startswith("{"), of_object(item)).when(F.element_at(word, 1) == key, rest)

    found = F.filter(F.transform(items, of_item), lambda v: v.isNotNull())
    listed = F.try_element_at(found, F.lit(-1))
    return F.coalesce(F.when(text.startswith("["), listed).when(text.startswith("{"), of_object(text)), F.lit(""))


def ids_normalise(raw: DataFrame, salt: str, ranges: DataFrame | None = None) -> DataFrame:
    """Alert rows of an event log, flattened to ``ids_alerts``.

    The tactic is the one named in the metadata (``mitre_tactic_id``, else ``mitre_tactic``; numbers of
    tactics become their names), else it is derived from the technique.
    """
    df = raw.filter(F.col("event_type") == "alert").withColumn("timestamp", parse_ts("timestamp"))
    df = _identify(df, "src_ip", salt, ranges)
    technique = mitre_extract("alert.metadata", "mitre_technique_id")
    named = [mitre_extract("alert.metadata", key) for key in ("mitre_tactic_id", "mitre_tactic")]
    named = F.when(named[0] != "", named[0]).otherwise(named[1])
    named = lookup(named, lists.TACTIC_NUMBERS, F.when(named.rlike("^TA[0-9]"), "").otherwise(named))
    df = df.withColumns({"_technique": technique, "_named": named})
    return conform(
        df.select(
            "timestamp",
            F.col("flow_id").alias("alert_id"),
            "source_ip_hash",
            "source_ip_country",
            F.col("src_port").alias("source_port"),
            "dest_ip",
            "dest_port",
            F.col("proto").alias("protocol"),
            F.col("alert.signature").alias("alert_signature"),
            F.col("alert.category").alias("alert_category"),
            F.col("alert.severity").alias("alert_severity"),
            F.col("alert.signature_id").alias("signature_id"),
            F.col("alert.rev").alias("revision"),
            F.col("payload_printable").alias("payload"),
            F.col("_technique").alias("mitre_technique_id"),
            F.when(F.col("_named") != "", F.col("_named"))
            .otherwise(classify.mitre_tactic("_technique"))
            .alias("mitre_tactic"),
            *[c for c in df.columns if c == "line_id"],
        ),
        "ids_alerts",
    )


# --- network logs


def _endpoint(df: DataFrame, name: str) -> Column:
    """``id.name`` as a flat column or inside the ``id`` struct; '-' means unset."""
    sources = []
    if f"id.{name}" in df.columns:
        sources.append(F.col(f"`id.{name}`").cast("string"))
    if "id" in df.columns:
        sources.append(F.col("id")[name].cast("string"))
    value = F.coalesce(*sources)
    return F.when(value != "-", value)


def _flatten_ids(df: DataFrame) -> DataFrame:
    ends = {n: _endpoint(df, n) for n in ("orig_h", "orig_p", "resp_h", "resp_p")}
    return df.withColumns(ends).drop("id", *[f"`id.{n}`" for n in ends])


def zeek_conn_normalise(raw: DataFrame, salt: str, ranges: DataFrame | None = None) -> DataFrame:
    """Connection log -> ``network_connections`` columns plus ``payload_size`` and ``metadata``."""
    df = _flatten_ids(raw).withColumn("timestamp", F.date_trunc("second", F.timestamp_seconds(F.col("ts").try_cast("double"))))
    df = _identify(df, "orig_h", salt, ranges)

    def whole(name):
        return F.coalesce(F.col(name).try_cast("long"), F.lit(0))

    state = F.to_json(F.struct(F.coalesce("conn_state", F.lit("")).alias("conn_state"),
                               F.coalesce("history", F.lit("")).alias("history")))
    return drop_pii(
        df.withColumns(
            {
                "payload_size": whole("orig_bytes") + whole("resp_bytes"),
                "metadata": F.when(F.col("conn_state").isNotNull(), state),
                "source_port": F.col("orig_p"),
                "dest_ip": F.col("resp_h"),
                "dest_port": F.col("resp_p"),
                "protocol": F.col("proto"),
            }
        )
    )


def zeek_http_normalise(raw: DataFrame, salt: str, ranges: DataFrame | None = None) -> DataFrame:
    df = _flatten_ids(raw).withColumn("timestamp", F.date_trunc("second", F.timestamp_seconds(F.col("ts").try_cast("double"))))
    df = _identify(df, "orig_h", salt, ranges)
    ends = {"source_port": F.col("orig_p"), "dest_ip": F.col("resp_h"), "dest_port": F.col("resp_p")}
    return conform(drop_pii(df.withColumns(ends)), "http_requests")


def zeek_dns_queries(raw: DataFrame, salt: str) -> DataFrame:
    df = _flatten_ids(raw)
    lined = [c for c in raw.columns if c == "line_id"]
    return df.select(
        *lined,
        F.date_trunc("second", F.timestamp_seconds("ts")).alias("timestamp"),
        anon_ip("orig_h", salt).alias("source_ip_hash"),
        F.coalesce("query", F.lit("")).alias("query"),
    )


def zeek_ssh_auth(raw: DataFrame, salt: str) -> DataFrame:
    df = _flatten_ids(raw)
    lined = [c for c in raw.columns if c == "line_id"]
    return df.select(
        *lined,
        F.date_trunc("second", F.timestamp_seconds("ts")).alias("timestamp"),
        anon_ip("orig_h", salt).alias("source_ip_hash"),
        F.col("resp_h").alias("dest_ip"),
        F.col("resp_p").try_cast("int").alias("dest_port"),
        F.coalesce("auth_success", F.lit(False)).alias("authenticated"),
    )


# --- camera and router sensors


def rtsp_normalise(raw: DataFrame, salt: str, ranges: DataFrame | None = None) -> DataFrame:
    """Camera-sensor lines; attack rows become ``attack_detected`` and keep their own type aside."""
    df = _identify(raw.withColumn("timestamp", parse_ts("timestamp")), "src_ip", salt, ranges)
    attack = F.coalesce("attack_detected", F.lit(False))
    typed = attack & F.col("attack_type").isNotNull()
    return drop_pii(
        df.withColumns(
            {
                "honeypot_type": F.coalesce("honeypot_type", F.lit("rtsp")),
                "attack_details": F.when(attack, F.coalesce("attack_info", F.lit("{}"))),
                "original_event_type": F.when(typed, F.col("event_type")),
                "event_type": F.when(typed, "attack_detected").otherwise(F.col("event_type")),
                "source_port": F.coalesce("src_port", F.lit(0)),
                "dest_port": F.coalesce("dest_port", F.lit(554)),
                "protocol": F.lit("rtsp"),
                "event_id": F.col("session_id"),
                "attack_id": F.col("session_id"),
                "command": F.col("method"),
                "raw_data": F.col("url"),
                "rtsp_method": F.col("method"),
                "rtsp_url": F.col("url"),
                "success": F.coalesce("authenticated", F.lit(False)),
                "is_attack": attack,
            }
        )
    )


def upnp_normalise(raw: DataFrame, salt: str, ranges: DataFrame | None = None) -> DataFrame:
    """Router-sensor lines with the mapping parameters lifted out.

    Rows without a session get an id derived from their content, so a replay
    produces the same id.
    """
    content = [F.col(f"`{c}`") for c in raw.columns if c != "line_id"]
    row_id = F.substring(F.sha2(F.to_json(F.struct(*content)), 256), 1, 32)
    df = raw.withColumns({"event_id": F.coalesce("session_id", row_id), "timestamp": parse_ts("timestamp")})
    df = _identify(df, "src_ip", salt, ranges)
    attack = F.coalesce("attack_detected", F.lit(False))
    typed = attack & F.col("attack_type").isNotNull()
    lifted = {"external_port": "NewExternalPort", "internal_port": "NewInternalPort",
              "internal_client": "NewInternalClient", "upnp_protocol": "NewProtocol"}
    return drop_pii(
        df.withColumns(
            {
                "honeypot_type": F.coalesce("honeypot_type", F.lit("upnp")),
                "session_id": F.col("event_id"),
                "attack_id": F.col("event_id"),
                "attack_details": F.when(attack, F.coalesce(F.to_json("params"), F.lit("{}"))),
                "original_event_type": F.when(typed, F.col("event_type")),
                "event_type": F.when(typed, "attack_detected").otherwise(F.col("event_type")),
                "source_port": F.coalesce("src_port", F.lit(0)),
                "listed_port": F.col("dest_port"),
                "command": F.col("action"),
                "upnp_action": F.col("action"),
                "raw_data": F.col("soap_action"),
                "is_attack": attack,
                **{name: F.try_element_at(F.col("params"), F.lit(p)) for name, p in lifted.items()},
            }
        )
    )


def sensor_events(df: DataFrame, sensor: str) -> DataFrame:
    """Normalised rows of one sensor as ``honeypot_events``."""
    if sensor == "upnp":
        df = df.withColumn("dest_port", F.coalesce("listed_port", F.lit(1900)))
    return conform(df, "honeypot_events")


def sensor_attacks(df: DataFrame, sensor: str) -> DataFrame:
    """Attack rows of the camera or router sensor as their attack table."""
    hits = df.filter("is_attack")
    if sensor == "upnp":
        hits = hits.withColumns({"dest_port": F.coalesce("listed_port", F.lit(5000)), "protocol": F.col("upnp_protocol")})
        return conform(hits, "upnp_attacks")
    return conform(hits, "rtsp_attacks")


def soap_params(body: Column | str) -> Column:
    """Action name and all ``New*`` parameters of a SOAP body, as a struct.

    The action is the first word of the first ``u:``/``m:`` tag; ``unknown`` without one.
    """
    text = F.coalesce(F.col(body) if isinstance(body, str) else body, F.lit(""))
    tag = r"<[mu]:[^>]*?(\w+)[^>]*?>"
    pair = r"<(New\w+)>([^<]+)</\1>"
    names = F.regexp_extract_all(text, F.lit(pair), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(pair), F.lit(2))
    entries = F.zip_with(names, values, lambda n, v: F.struct(n.alias("key"), v.alias("value")))
    # of equal names the last one counts
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"]))
    params = F.map_from_entries(last)
    action = F.regexp_extract(text, tag, 1)
    return F.struct(
        F.when(action == "", "unknown").otherwise(action).alias("action"), params.alias("params")
    )
