"""Scalar classification rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lists


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lookup(key: Column, table: dict, default) -> Column:
    """A small constant dictionary as a map literal; unknown keys give ``default``."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


# Shell-sensor event id -> short name.
COWRIE_NAMES = {
    "cowrie.login.success": "login_success",
    "cowrie.login.failed": "login_failed",
    "cowrie.command.input": "command",
    "cowrie.session.file_download": "file_download",
    "cowrie.session.connect": "session_start",
    "cowrie.session.closed": "session_end",
}

# Shell-sensor event id -> technique, tactic, severity, brute-force flag, success flag.
COWRIE_CLASSES = {
    "cowrie.login.success": ("T1078.001", "Initial Access", "medium", 1, 1),
    "cowrie.login.failed": ("T1110.001", "Credential Access", "low", 1, 0),
    "cowrie.command.input": ("T1059.004", "Execution", "high", 0, 0),
    "cowrie.session.file_download": ("T1105", "Command and Control", "critical", 0, 0),
    "cowrie.session.connect": ("T1021.004", "Lateral Movement", "info", 0, 0),
}


def cowrie_event_type(eventid: Column | str) -> Column:
    return lookup(_c(eventid), COWRIE_NAMES, "other")


def cowrie_classify(df: DataFrame, eventid: str = "eventid") -> DataFrame:
    """Technique, tactic, severity and login flags of shell-sensor events."""
    key = F.col(eventid)

    def pick(i, default):
        return lookup(key, {k: v[i] for k, v in COWRIE_CLASSES.items()}, default)

    return df.withColumns(
        {
            "attack_technique": pick(0, ""),
            "attack_tactic": pick(1, ""),
            "severity": pick(2, "low"),
            "is_bruteforce": pick(3, 0),
            "success_flag": pick(4, 0),
        }
    )


def http_exploit(url: Column | str) -> Column:
    """First matching exploit class of a URL, '' when none."""
    u = F.coalesce(_c(url), F.lit(""))
    return (
        F.when(u.rlike(r"\(\)\s*\{"), "shellshock")
        .when(u.rlike(r"\.\./|\.\.\\"), "path_traversal")
        .when(u.rlike(r"(?i)union|select|insert|update|delete"), "sqli")
        .otherwise("")
    )


# Exploit class -> technique, tactic, severity.
EXPLOIT_CLASSES = {
    "shellshock": ("T1190", "Initial Access", "high"),
    "path_traversal": ("T1083", "Discovery", "medium"),
    "sqli": ("T1190", "Initial Access", "high"),
}


def dionaea_classify(df: DataFrame) -> DataFrame:
    """Event kind, exploit class and technique of service-sensor rows.

    Reads ``connection_type``, ``url``, ``md5_hash``; a row is HTTP when it says
    so or carries a URL, then SMB, then a download, else a plain connection.
    """
    kind = F.coalesce(F.col("connection_type"), F.lit(""))
    is_http = (kind == "http") | F.col("url").isNotNull()
    is_smb = kind == "smb"
    is_download = (kind == "download") | F.col("md5_hash").isNotNull()
    exploit = F.when(is_http, http_exploit("url")).otherwise("")

    def by_kind(http, smb, download, other):
        return F.when(is_http, http).when(is_smb, F.lit(smb)).when(is_download, F.lit(download)).otherwise(other)

    def of_exploit(i, default):
        return lookup(exploit, {k: v[i] for k, v in EXPLOIT_CLASSES.items()}, default)

    return df.withColumns(
        {
            "event_type": by_kind(F.lit("dionaea_http"), "dionaea_smb", "dionaea_download", "dionaea_connection"),
            "exploit_type": exploit,
            "is_exploit": (exploit != "").cast("int"),
            "attack_technique": by_kind(of_exploit(0, ""), "T1210", "T1105", ""),
            "attack_tactic": by_kind(of_exploit(1, ""), "Lateral Movement", "Command and Control", ""),
            "severity": by_kind(of_exploit(2, "low"), "medium", "critical", "info"),
        }
    )


# Industrial-control class -> event type, protocol, technique, tactic, severity.
CONPOT_CLASSES = {
    "modbus_write": ("conpot_modbus", "modbus", "T0836", "ICS Impair Process Control", "high"),
    "modbus_read": ("conpot_modbus", "modbus", "T0802", "ICS Collection", "medium"),
    "modbus_other": ("conpot_modbus", "modbus", "", "", "low"),
    "bacnet": ("conpot_bacnet", "bacnet", "T0846", "ICS Collection", "medium"),
    "s7comm": ("conpot_s7comm", "s7comm", "T0836", "ICS Impair Process Control", "medium"),
    "http": ("conpot_http", "http", "T1190", "Initial Access", "medium"),
    "other": ("conpot_connection", "", "T0846", "ICS Collection", "info"),
}

# Default port of each industrial-control protocol.
ICS_PORTS = {"modbus": 502, "bacnet": 47808, "s7comm": 102}


def conpot_class(data_type: Column | str, request: Column | str) -> Column:
    kind = F.coalesce(_c(data_type), F.lit(""))
    req = F.coalesce(_c(request), F.lit(""))
    modbus = (
        F.when(req.rlike("(?i)write|set"), "modbus_write")
        .when(req.rlike("(?i)read|get"), "modbus_read")
        .otherwise("modbus_other")
    )
    return (
        F.when((kind == "modbus") | req.rlike("(?i)modbus"), modbus)
        .when(kind.isin("bacnet", "s7comm"), kind)
        .when((kind == "http") | req.rlike("(?i)^(GET|POST|HEAD)"), "http")
        .otherwise("other")
    )


def conpot_classify(df: DataFrame) -> DataFrame:
    names = ("event_type", "protocol", "attack_technique", "attack_tactic", "severity")
    keyed = df.withColumn("_class", conpot_class("data_type", "request"))
    cols = {
        name: lookup(F.col("_class"), {k: v[i] for k, v in CONPOT_CLASSES.items()}, "")
        for i, name in enumerate(names)
    }
    return keyed.withColumns(cols).drop("_class")


def default_port(port: Column | str, protocol: Column | str) -> Column:
    """The given port, else the protocol's usual one, else 0."""
    return F.coalesce(_c(port).cast("int"), lookup(_c(protocol), ICS_PORTS, 0))


def mitre_tactic(technique: Column | str) -> Column:
    """Tactic of a technique id by its five-character prefix; '' for '', else Unknown."""
    t = F.coalesce(_c(technique), F.lit(""))
    return F.when(t == "", "").otherwise(lookup(F.substring(t, 1, 5), lists.TACTICS, "Unknown"))


def severity_label(severity: Column | str) -> Column:
    return lookup(_c(severity).cast("int"), {1: "critical", 2: "high", 3: "medium"}, "low")


def password_weakness(password: Column | str) -> Column:
    p = _c(password)
    return (
        F.when(p.isin(*lists.COMMON_PASSWORDS), "Very Common")
        .when(F.length(p) < 6, "Too Short")
        .when(p.rlike("^[a-z]+$"), "All Lowercase")
        .otherwise("Other")
    )


def kill_chain_stage(technique: Column | str, sid: Column | str | None = None) -> Column:
    """Phase of an alert or event: by alert id first, then by technique prefix; '' when none."""
    prefix = F.substring(F.coalesce(_c(technique), F.lit("")), 1, 5)
    by_sid = {s: stage for stage, v in lists.STAGES.items() for s in v["sids"]}
    by_technique = {t: stage for stage, v in lists.STAGES.items() for t in v["techniques"]}
    fallback = lookup(prefix, by_technique, "")
    if sid is None:
        return fallback
    named = lookup(_c(sid).cast("int"), by_sid, "")
    return F.when(named != "", named).otherwise(fallback)


def transport(protocol: Column | str) -> Column:
    """tcp or udp of an application protocol name."""
    p = F.lower(F.coalesce(_c(protocol), F.lit("")))
    return F.when(p.isin("udp", "ssdp", "bacnet", "snmp", "dns"), "udp").otherwise("tcp")
