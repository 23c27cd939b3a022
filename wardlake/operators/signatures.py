"""Signature matching: 68 rules evaluated in one scan.

Each rule becomes one boolean column expression (port and transport first, then its
contents, plain ones as ``contains``, positioned ones as a single regex). A row is
matched against all of them in the same projection and then exploded to its
hits, so neither a join nor a second pass over the rows is needed.

Rows may carry: payload (text or binary), uri, user_agent, header, method, body,
protocol, dest_port. Rules on buffers a row set lacks must be left out by name. All but two rules are about targets on the home side; where
rows can have others too, ``home`` names the networks of that side, and ``dest_ip`` is tested.
"""

from __future__ import annotations

import re
from ipaddress import ip_network

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classify import lookup, mitre_tactic, transport
from .folds import anchored, firings, per_second
from .geo import address_hex, ipv4_long
from .rules import RULES, Content, Rule

RULE_SCHEMA = (
    "sid int, rev int, proto string, ports array<int>, contents array<string>, rate_kind string, rate_count int, "
    "rate_seconds int, classtype string, technique string, tactic string, msg string, flags string"
)


def rules_table(spark: SparkSession) -> DataFrame:
    """The rules as a table of fixed size."""
    rows = [
        (
            r.sid, r.rev, r.proto, list(r.ports), [c.text for c in r.contents],
            *(r.rate or (None, None, None)), r.classtype, r.technique, r.tactic, r.msg, r.flags,
        )
        for r in RULES
    ]
    return spark.createDataFrame(rows, T.StructType.fromDDL(RULE_SCHEMA))


# --- one content or chain of contents as a regex


def _bytes(text: str) -> str:
    """A content with ``|xx|`` parts as the characters it stands for, one per byte."""
    parts = text.split("|")
    return "".join(bytes.fromhex(p).decode("latin-1") if i % 2 else p for i, p in enumerate(parts))


def _escape(literal: str) -> str:
    return "".join(ch if ch.isalnum() and ord(ch) < 128 else f"\\x{ord(ch):02x}" for ch in literal)


def chain_regex(chain: list[Content]) -> str:
    """Contents that follow each other in one buffer, as one regex with explicit gaps."""
    out = "(?s)"
    for item in chain:
        literal = _bytes(item.text)
        body = _escape(literal)
        if item.nocase:
            body = f"(?i:{body})"
        if item.distance is not None:
            gap = f".{{{item.distance},}}?"
            if item.within is not None:
                # ``within`` counts from where ``distance`` leads to, up to the content's end
                gap = f".{{{item.distance},{item.distance + item.within - len(literal)}}}"
        elif item.depth is not None:
            gap = f"^.{{{item.offset},{item.depth - len(literal)}}}"
        else:
            gap = f"^.{{{item.offset},}}?" if item.offset else ""
        out += gap + body
    return out


def _chains(rule: Rule) -> list[list[Content]]:
    """Contents grouped into runs: one that has no distance starts a new run."""
    runs: list[list[Content]] = []
    for item in rule.contents:
        if not item.regex and item.distance is not None and runs and not runs[-1][0].regex:
            runs[-1].append(item)
        else:
            runs.append([item])
    return runs


def is_binary(rule: Rule) -> bool:
    """Rules that look at bytes rather than text."""
    hexed = any("|" in c.text and not c.regex and c.buffer == "payload" for c in rule.contents)
    return hexed or rule.byte_test is not None


def _match(buffer: Column, chain: list[Content]) -> Column:
    first = chain[0]
    if first.regex:
        return buffer.rlike(("(?i)" if first.nocase else "") + first.text)
    literal = _bytes(first.text)
    anywhere = first.depth is None and not first.offset
    gate = F.lower(buffer).contains(literal.lower()) if first.nocase else buffer.contains(literal)
    if len(chain) == 1 and anywhere:
        return gate
    # the cheap substring test spares most rows the regex
    return gate & buffer.rlike(chain_regex(chain))


def _byte_test(buffer: Column, rule: Rule) -> Column:
    width, operator, value, offset = rule.byte_test
    found = F.regexp_extract(buffer, f"{chain_regex(list(rule.contents))}.{{{offset}}}(.{{{width}}})", 1)
    number = F.conv(F.hex(F.encode(found, "ISO-8859-1")), 16, 10).cast("long")
    hit = number > value if operator == ">" else number.bitwiseAND(F.lit(value).cast("long")) != 0
    return (found != "") & hit


def _gate(rule: Rule) -> Column:
    cond = F.lit(True)
    if rule.ports:
        cond = F.col("dest_port").isin(*rule.ports)
    if rule.proto == "http":
        return cond & (F.coalesce(F.col("method"), F.lit("")) != "")
    return cond & (F.col("_transport") == rule.proto)


def rule_condition(rule: Rule, cols: set) -> Column | None:
    """The condition of a content rule, or None where the rows lack one of its buffers."""
    buffers = {c.buffer for c in rule.contents}
    if not rule.contents or not buffers <= cols or (rule.proto == "http" and "method" not in cols):
        return None
    cond = _gate(rule)
    for chain in _chains(rule):
        cond = cond & _match(F.coalesce(F.col(chain[0].buffer), F.lit("")), chain)
    if rule.byte_test:
        cond = cond & _byte_test(F.coalesce(F.col("payload"), F.lit("")), rule)
    return cond


def not_evaluated(rows: DataFrame, rules=RULES) -> list[int]:
    """Rules that ``match_rules`` and ``scan_hits`` cannot evaluate over these rows, as a column they look at is missing."""
    cols = set(rows.columns)
    missing = [r.sid for r in rules if r.contents and rule_condition(r, cols) is None]
    return missing + [r.sid for r in rules if not r.contents and r.flags == "0" and "history" not in cols]


def _hits(rows: DataFrame, conds: dict, as_list: bool) -> DataFrame:
    """One row per hit, or rows with the list of their hits."""
    sids = F.array_compact(F.array(*[F.when(cond, F.lit(sid)) for sid, cond in conds.items()]))
    if as_list:
        # through a generator, so that the filter does not evaluate every rule a second time
        return rows.withColumn("sids", F.explode(F.array(sids))).filter(F.size("sids") > 0)
    return rows.withColumn("sid", F.explode(sids))


def in_networks(ip: str, networks) -> Column:
    """Whether an address lies in one of some networks (``a.b.c.d/len`` or with colons); configuration, so it is part of the filter."""
    out = F.lit(False)
    for network in networks:
        found = ip_network(network, strict=False)
        low, high = (int(x) for x in (found[0], found[-1]))
        mapped = 0xFFFF << 32 if found.version == 4 else 0
        out = out | address_hex(ip).between(f"{low + mapped:032x}", f"{high + mapped:032x}")
    return F.coalesce(out, F.lit(False))


def _sided(conds: dict, rules, home) -> dict:
    """Conditions of home-side rules with the side added."""
    if home is None:
        return conds
    free = {r.sid for r in rules if not r.home}
    return {sid: c if sid in free else c & F.col("_home") for sid, c in conds.items()}


def _complete(rows: DataFrame, rules, without) -> None:
    missing = sorted(set(not_evaluated(rows, rules)) - set(without))
    if missing:
        raise ValueError(f"the rows lack columns for rules {missing}: add them, or leave these rules out by name")


def match_rules(rows: DataFrame, binary: bool = False, rules=RULES, as_list: bool = False, home=None, without=()) -> DataFrame:
    """Rows × matching rule ids (column ``sid``; with ``as_list`` a row keeps all its ids in ``sids``).

    ``binary=False`` evaluates the text rules on a text payload; ``binary=True`` the
    byte rules on a binary payload, read as one character per byte. Rows that lack a column of a rule are an error unless the
    rule is listed in ``without``. ``home``: networks of the home side; without it every target is taken to be there.
    """
    _complete(rows, [r for r in rules if r.contents and is_binary(r) == binary], without)
    work = rows.withColumn("_transport", transport("protocol"))
    work = work if home is None else work.withColumn("_home", in_networks("dest_ip", home))
    if binary:
        work = work.withColumn("_kept", F.col("payload")).withColumn("payload", F.decode("payload", "ISO-8859-1"))
    conds = {
        r.sid: cond
        for r in rules
        if is_binary(r) == binary and (cond := rule_condition(r, set(rows.columns))) is not None
    }
    hits = _hits(work, _sided(conds, rules, home), as_list).drop("_transport", "_home")
    return hits.withColumn("payload", F.col("_kept")).drop("_kept") if binary else hits


def scan_hits(conns: DataFrame, rules=RULES, as_list: bool = False, home=None, without=()) -> DataFrame:
    """Connection rows × rules on flags or on mere contact (no contents).

    A lone SYN shows as state S0, a packet without flags as an empty history.
    ``home`` and ``without`` as in :func:`match_rules`.
    """
    _complete(conns, [r for r in rules if not r.contents], without)
    has_history = "history" in conns.columns
    conds = {}
    for r in rules:
        if r.contents or r.max_bytes is not None or (r.flags == "0" and not has_history):
            continue
        cond = F.col("dest_port").isin(*r.ports) if r.ports else F.lit(True)
        if r.flags == "S":
            cond = cond & (F.col("conn_state") == "S0")
        elif r.flags == "0":
            cond = cond & (F.coalesce("history", F.lit("")) == "")
        conds[r.sid] = cond & (F.col("_transport") == r.proto)
    work = conns.withColumn("_transport", transport("protocol"))
    work = work if home is None else work.withColumn("_home", in_networks("dest_ip", home))
    return _hits(work, _sided(conds, rules, home), as_list).drop("_transport", "_home")


def beacon_hits(conns: DataFrame, max_bytes: int = 100) -> DataFrame:
    """Outbound connections whose mean packet from the originator is smaller than ``max_bytes``.

    Outbound: the originator is on the home side (``local_orig``); an unknown side is not outbound.
    """
    mean = F.col("orig_bytes") / F.when(F.col("orig_pkts") > 0, F.col("orig_pkts"))
    return conns.filter(F.col("local_orig") & (mean < max_bytes)).withColumn("sid", F.lit(1000027))


# --- rates


def rate(hits: DataFrame, n: int, seconds: int, mode: str, keys=("sid", "source_ip_hash")) -> DataFrame:
    """``threshold``, ``both`` or ``limit`` applied per rule and source: ts, keys, hit."""
    counted = anchored(per_second(hits, list(keys)), list(keys), seconds, None if mode == "limit" else n)
    return firings(counted, n, mode).select(F.timestamp_seconds("sec").alias("timestamp"), *keys, "hit")


def _rate_columns(hits: DataFrame) -> DataFrame:
    rated = {r.sid: r.rate for r in RULES if r.rate}
    return hits.withColumns(
        {
            "_kind": lookup(F.col("sid"), {s: v[0] for s, v in rated.items()}, "none"),
            "_n": lookup(F.col("sid"), {s: v[1] for s, v in rated.items()}, 1),
            "_secs": lookup(F.col("sid"), {s: v[2] for s, v in rated.items()}, 1),
        }
    )


def apply_rates(hits: DataFrame) -> DataFrame:
    """Every rule's own rate over its hits; rules without one alert on each hit.

    One pass for all rules: hits are summed per (rule, source, second), each row
    carrying its rule's count and window. Hits in list form (``sids``) are cheaper: rows are
    summed per (source, second, list), shuffled by source and multiplied by their rules
    inside the task that then counts them.
    """
    keys = ["source_ip_hash", "sid"]
    listed = "sids" in hits.columns
    if listed:
        # two lists of one second may share a rule; its hits then come as two rows of that second
        cells = per_second(hits, ["source_ip_hash", "sids"]).repartition("source_ip_hash")
        cells = cells.withColumn("sid", F.explode("sids")).drop("sids")
    else:
        cells = per_second(hits, keys)
    counted = anchored(_rate_columns(cells), keys, "_secs", "_n", placed=listed)
    fired = firings(counted, "_n", F.col("_kind"))
    return fired.select(F.timestamp_seconds("sec").alias("timestamp"), "sid", "source_ip_hash", "hit")


# --- suppression and output


def suppress(alerts: DataFrame, suppressions: list[tuple[int, str]], ip_col: str = "src_ip") -> DataFrame:
    """Drop alerts of a rule from a network; entries are (sid, "a.b.c.d/len" or address).

    The list is configuration (a handful of lines), so it becomes part of the filter.
    """
    ip = ipv4_long(ip_col)
    drop = F.lit(False)
    for sid, network in suppressions:
        base, _, length = network.partition("/")
        if not re.fullmatch(r"\d+(\.\d+){3}", base):
            raise ValueError(f"not an IPv4 network: {network!r}")
        size = 1 << (32 - int(length or 32))
        octets = [int(p) for p in base.split(".")]
        start = sum(o << (8 * (3 - i)) for i, o in enumerate(octets)) // size * size
        drop = drop | ((F.col("sid") == sid) & ip.between(start, start + size - 1))
    return alerts.filter(~F.coalesce(drop, F.lit(False)))


def suppress_sources(alerts: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Drop alerts whose (sid, source_ip_hash) is listed in a table."""
    return alerts.join(suppressions.select("sid", "source_ip_hash").distinct(), ["sid", "source_ip_hash"], "left_anti")


def to_alerts(hits: DataFrame) -> DataFrame:
    """Hits as alert rows: message, class, revision, technique and tactic of their rule."""

    def of(attr, default=""):
        return lookup(F.col("sid"), {r.sid: getattr(r, attr) for r in RULES}, default)

    technique = of("technique")
    return hits.withColumns(
        {
            "signature_id": F.col("sid").cast("long"),
            "alert_signature": of("msg"),
            "alert_category": of("classtype"),
            "revision": of("rev", 1),
            "mitre_technique_id": technique,
            "mitre_tactic": mitre_tactic(technique),
        }
    ).drop("sid")
