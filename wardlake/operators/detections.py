"""Detections on connection, login, web and sensor tables.

All return ``DETECTION`` columns: ts, source, detection_type, count, note,
identifier. Stateless ones are a filter and a projection; counting ones use
:mod:`wardlake.operators.folds`. De-duplicate with :func:`dedupe`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.timing import epoch
from .folds import anchored, count_alarm, distinct_alarm, first_in_window, per_second, reachable, trailing_count, walk

SRC = "source_ip_hash"
DETECTION = ["ts", "source", "detection_type", "count", "note", "identifier"]


def _text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def flag(df: DataFrame, cond: Column, kind: str, note: Column, ident: Column | None = None) -> DataFrame:
    """One detection per row that meets ``cond``."""
    return df.filter(cond).select(
        F.col("timestamp").alias("ts"),
        F.col(SRC).alias("source"),
        F.lit(kind).alias("detection_type"),
        F.lit(1).cast("long").alias("count"),
        note.alias("note"),
        (F.col(SRC) if ident is None else ident).alias("identifier"),
    )


def _counted(fired: DataFrame, kind: str, note: str, suffix: str = "", count: str = "hit") -> DataFrame:
    return fired.select(
        F.timestamp_seconds("sec").alias("ts"),
        F.col(SRC).alias("source"),
        F.lit(kind).alias("detection_type"),
        F.col(count).cast("long").alias("count"),
        F.concat(F.lit(f"{note}: "), F.col(count).cast("string")).alias("note"),
        F.concat(F.col(SRC), F.lit(suffix)).alias("identifier"),
    )


def dedupe(detections: DataFrame, ttl: int | None = None) -> DataFrame:
    """Hold back repeats of an identifier: for ``ttl`` seconds after the one kept, or for good."""
    keys = ["detection_type", "identifier"]
    if ttl is not None:
        return first_in_window(detections, keys, ttl, "ts").select(*detections.columns)
    rest = [c for c in detections.columns if c not in keys]
    # the earliest, as a map-side minimum instead of a sort per identifier
    first = detections.groupBy(*keys).agg(F.min(F.struct("ts", *[c for c in rest if c != "ts"])).alias("r"))
    return first.select(*keys, "r.*").select(*detections.columns)


# --- bot infections


def bot_scanner(conns: DataFrame, max_s: float = 2) -> DataFrame:
    """Very short telnet connections."""
    cond = F.col("dest_port").isin(*lists.TELNET_PORTS) & (F.col("duration") < max_s)
    return flag(conns, cond, "bot_scanner", F.concat(F.lit("short telnet connection to "), F.col("dest_port").cast("string")))


def bot_credential(creds: DataFrame, users=lists.BOT_USERS, passwords=lists.BOT_PASSWORDS) -> DataFrame:
    cond = F.col("username").isin(*users) & F.col("password").isin(*passwords)
    return flag(creds, cond, "bot_credential", F.concat_ws(":", "username", "password"))


def known_pair(creds: DataFrame, pairs=lists.LOGIN_PAIRS) -> DataFrame:
    """Logins with a user/password pair of a fixed list (a constant of the plan, not a join)."""
    accepted = [F.struct(F.lit(u).alias("u"), F.lit(p).alias("p")) for u, p in pairs]
    cond = F.struct(F.col("username").alias("u"), F.col("password").alias("p")).isin(*accepted)
    return flag(creds, cond, "known_pair", F.concat_ws(":", "username", "password"))


def bot_command(events: DataFrame, pattern: str = lists.BOT_COMMANDS) -> DataFrame:
    return flag(events, F.col("command").rlike(pattern), "bot_command", F.col("command"))


def bot_download(requests: DataFrame, pattern: str = lists.BOT_DOWNLOADS) -> DataFrame:
    return flag(requests, F.col("uri").rlike(pattern), "bot_download", F.col("uri"))


def telnet_scan(conns: DataFrame, n: int = 5, window: int = 300, max_s: float = 10) -> DataFrame:
    hits = conns.filter(F.col("dest_port").isin(*lists.TELNET_PORTS) & (F.col("duration") < max_s))
    return _counted(count_alarm(hits, [SRC], n, window, "threshold"), "telnet_scan", "attempts so far in window")


def ssh_scan(conns: DataFrame, n: int = 8, window: int = 300, max_s: float = 15) -> DataFrame:
    hits = conns.filter((F.col("dest_port") == 22) & (F.col("duration") < max_s))
    return _counted(count_alarm(hits, [SRC], n, window, "threshold"), "ssh_scan", "attempts so far in window")


def multi_port_scan(
    conns: DataFrame, ports=lists.BOT_TARGET_PORTS, n: int = 3, window: int = 300
) -> DataFrame:
    """Sources that reach ``n`` of the target ports in a window; one row per firing second.

    ``count`` is the number of ports known by then, the note gives the hits.
    """
    hits = conns.filter(F.col("dest_port").isin(*ports))
    fired = distinct_alarm(hits, [SRC], "dest_port", n, window)
    return fired.select(
        F.timestamp_seconds("sec").alias("ts"),
        F.col(SRC).alias("source"),
        F.lit("multi_port_scan").alias("detection_type"),
        F.col("distinct_items").cast("long").alias("count"),
        F.concat(F.lit("hits: "), F.col("hits").cast("string")).alias("note"),
        F.concat(F.col(SRC), F.lit("-multiport")).alias("identifier"),
    )


def rapid_telnet(conns: DataFrame, max_s: float = 5) -> DataFrame:
    cond = (F.col("protocol") == "telnet") & (F.col("duration") < max_s)
    return flag(conns, cond, "rapid_telnet", F.lit("short telnet session"), F.concat(F.col(SRC), F.col("timestamp").cast("string")))


# --- device attacks


def device_port_scan(conns: DataFrame, ports=lists.DEVICE_PORTS, n: int = 6, window: int = 60) -> DataFrame:
    """Fires on the n-th and every later hit of a window."""
    hits = conns.filter(F.col("dest_port").isin(*ports))
    return _counted(count_alarm(hits, [SRC], n, window, "every"), "device_port_scan", "connections in window")


def device_path(requests: DataFrame, pattern: str = lists.DEVICE_PATHS) -> DataFrame:
    return flag(requests, F.col("uri").rlike(pattern), "device_path", F.col("uri"))


def device_agent(requests: DataFrame, pattern: str = lists.DEVICE_AGENTS) -> DataFrame:
    return flag(requests, F.col("user_agent").rlike(pattern), "device_agent", F.col("user_agent"))


def rtsp_contact(conns: DataFrame, port: int = 554) -> DataFrame:
    return flag(conns, F.col("dest_port") == port, "rtsp_contact", F.lit("camera port contacted"))


# --- mining


def mining_port(conns: DataFrame, ports=lists.MINING_PORTS) -> DataFrame:
    return flag(conns, F.col("dest_port").isin(*ports), "mining_port", F.col("dest_port").cast("string"))


def pool_query(dns: DataFrame, pattern: str = lists.MINING_POOLS) -> DataFrame:
    return flag(dns, F.col("query").rlike(pattern), "pool_query", F.col("query"))


def miner_download(requests: DataFrame, pattern: str = lists.MINER_NAMES) -> DataFrame:
    return flag(requests, F.col("uri").rlike(pattern), "miner_download", F.col("uri"))


def mining_session(conns: DataFrame, ports=lists.MINING_PORTS, min_s: float = 300, min_pkts: int = 100) -> DataFrame:
    cond = F.col("dest_port").isin(*ports) & (F.col("duration") > min_s) & (F.col("orig_pkts") > min_pkts)
    return flag(conns, cond, "mining_session", F.concat_ws(":", "dest_ip", F.col("dest_port").cast("string")))


def stratum_text(df: DataFrame, col: str, pattern: str = lists.STRATUM) -> DataFrame:
    return flag(df, F.col(col).rlike(pattern), "stratum_text", F.col(col))


# --- web exploits


def _any_part(pattern: str, cols: list) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | _text(c).rlike(pattern)
    return out


def _decoded() -> Column:
    """The URI with %xx resolved; text that is no valid encoding stays as it is."""
    return F.coalesce(F.try_url_decode("uri"), F.col("uri"), F.lit(""))


def _in_uri(pattern: str) -> Column:
    """A URI pattern, tried on the text as sent and decoded."""
    return _text("uri").rlike(pattern) | _decoded().rlike(pattern)


def exploit_conditions() -> dict:
    """Exploit class -> condition on an ``http_requests`` row."""
    shell_cols = ["user_agent", "referrer", "host", "request_body"]
    is_cgi = _in_uri("cgi-bin")
    return {
        "shellshock": _any_part(lists.SHELLSHOCK, shell_cols) | (is_cgi & _in_uri(lists.SHELLSHOCK)),
        "path_traversal": _in_uri(lists.TRAVERSAL),
        "sql_injection": _in_uri(lists.SQL_INJECTION) | _text("request_body").rlike(lists.SQL_INJECTION),
        "command_injection": _in_uri(lists.COMMAND_INJECTION) | _text("request_body").rlike(lists.COMMAND_INJECTION),
        "cgi_exploit": is_cgi & (_in_uri(lists.CGI_QUERY) | _in_uri(lists.SHELLSHOCK)),
        "suspicious_ua": _text("user_agent").rlike(lists.TOOL_AGENTS),
    }


def http_exploit(requests: DataFrame, kind: str) -> DataFrame:
    return flag(requests, exploit_conditions()[kind], kind, F.col("uri"))


def exploit_log(requests: DataFrame, sample: int = 200) -> DataFrame:
    """All exploit classes in one scan, one row per request and class."""
    kinds = F.array_compact(F.array(*[F.when(cond, F.lit(kind)) for kind, cond in exploit_conditions().items()]))
    return requests.select(
        F.col("timestamp").alias("ts"),
        F.col(SRC).alias("source"),
        "source_port",
        F.col("dest_ip").alias("dest"),
        "dest_port",
        "method",
        "uri",
        "user_agent",
        F.explode(kinds).alias("exploit_type"),
        F.substring(F.concat_ws(" ", "uri", "user_agent", "request_body"), 1, sample).alias("note"),
    )


# --- SSH


def _login_seconds(auth: DataFrame) -> DataFrame:
    """Failures and successes per source and second; inside a second failures come first."""
    return auth.groupBy(SRC, epoch("timestamp").alias("sec")).agg(
        F.count_if(~F.col("authenticated")).alias("fails"), F.count_if("authenticated").alias("wins")
    )


def _failure_walk(window: int):
    """Carry (source, window start, failures) through seconds sorted by source."""

    def run(batches):
        source, start, level = None, None, 0
        for pdf in batches:
            before = []
            for src, sec, fails, wins in zip(*[pdf[c].tolist() for c in (SRC, "sec", "fails", "wins")]):
                if src != source or (start is not None and sec >= start + window):
                    source, start, level = src, None, 0
                if fails and start is None:
                    start = sec
                before.append(level)
                # a success puts the count to zero but does not move the window
                level = 0 if wins else level + fails
            yield pdf.assign(n_start=before)[[SRC, "sec", "fails", "wins", "n_start"]]

    return run


def _failure_runs(auth: DataFrame, window: int, condition: Column) -> DataFrame:
    """Per second: failures so far (``n_start``) since window start or last success.

    Only failures open windows. ``condition`` names the sources that can fire, by ``_fails`` and ``_wins`` in all.
    """
    live = reachable(_login_seconds(auth), [SRC], condition, _fails=F.sum("fails"), _wins=F.sum("wins"))
    schema = f"{SRC} string, sec long, fails long, wins long, n_start long"
    return walk(live, [SRC], _failure_walk(window), schema, placed=True)


def ssh_bruteforce(auth: DataFrame, n: int = 10, window: int = 600) -> DataFrame:
    """Fires on the n-th and every later failure since window start or last success."""
    runs = _failure_runs(auth, window, F.col("_fails") >= n)
    lo, hi = F.greatest(F.col("n_start") + 1, F.lit(n).cast("long")), F.col("n_start") + F.col("fails")
    fired = runs.withColumns({"_lo": lo, "_hi": hi}).filter("fails > 0 and _lo <= _hi")
    fired = fired.withColumn("hit", F.explode(F.sequence("_lo", "_hi")))
    return _counted(fired, "bruteforce", "failed logins")


def ssh_success_after_failures(auth: DataFrame, window: int = 600) -> DataFrame:
    """A success after failures; ``count`` is the number of failures it ends."""
    ended = _failure_runs(auth, window, (F.col("_fails") > 0) & (F.col("_wins") > 0)).withColumn("hit", F.col("n_start") + F.col("fails"))
    return _counted(ended.filter("wins > 0 and hit > 0"), "bruteforce_success", "failures before success", "-success")


def ssh_rapid(
    auth: DataFrame, conns: DataFrame | None = None, n: int = 15, window: int = 600, max_s: float = 5
) -> DataFrame:
    """Fires at the login attempt that brings the counter to ``n``, then starts from zero.

    Short SSH sessions count too but do not fire by themselves. Inside a second
    attempts come before closing sessions.
    """
    logins = auth.groupBy(SRC, epoch("timestamp").alias("sec")).agg(F.count(F.lit(1)).alias("tries"))
    hits = logins.withColumn("shorts", F.lit(0).cast("long"))
    if conns is not None:
        short = conns.filter((F.col("dest_port") == 22) & (F.col("protocol") == "ssh") & (F.col("duration") < max_s))
        closed = short.groupBy(SRC, epoch("timestamp").alias("sec")).agg(F.count(F.lit(1)).alias("shorts"))
        both = hits.unionByName(closed.withColumn("tries", F.lit(0).cast("long")))
        hits = both.groupBy(SRC, "sec").agg(F.sum("tries").alias("tries"), F.sum("shorts").alias("shorts"))
    live = reachable(hits, [SRC], (F.col("_tries") + F.col("_shorts") >= n) & (F.col("_tries") > 0), _tries=F.sum("tries"), _shorts=F.sum("shorts"))
    fired = walk(live, [SRC], _rapid_walk(n, window), f"{SRC} string, sec long, hit long", placed=True)
    return _counted(fired, "rapid_connections", "attempts", "-rapid")


def _rapid_walk(n: int, window: int):
    """Carry (source, window start, counter) through sorted seconds; one row per firing."""

    def run(batches):
        source, start, level = None, 0, 0
        for pdf in batches:
            out = []
            for src, sec, tries, shorts in zip(*[pdf[c].tolist() for c in (SRC, "sec", "tries", "shorts")]):
                if src != source or sec >= start + window:
                    source, start, level = src, sec, 0
                # short sessions may have left the counter above n; the next attempt fires
                left, reached = tries, max(level + 1, n)
                while left and level + left >= n:
                    left -= max(n - level, 1)
                    out.append((src, sec, reached))
                    level, reached = 0, n
                level += left + shorts
            yield pd.DataFrame(out, columns=[SRC, "sec", "hit"])

    return run


def scanner_condition(max_s: float = 3, by: str = "service") -> Column:
    """``by`` says what shows that no SSH exchange took place: an empty ``service``, or a ``conn_state`` but SF."""
    if by not in ("service", "conn_state"):
        raise ValueError(f"by is service or conn_state, not {by!r}")
    quiet = F.col("service") == "" if by == "service" else F.col("conn_state") != "SF"
    return (F.col("dest_port") == 22) & (F.col("duration") < max_s) & quiet


def ssh_scanner(conns: DataFrame, max_s: float = 3, by: str = "service") -> DataFrame:
    """Connections to the SSH port closed early without an SSH exchange.

    "No exchange" is an empty service name; for tables without one, ``by="conn_state"`` takes a
    connection state other than a normal close.
    """
    ident = F.concat(F.col(SRC), F.col("timestamp").cast("string"))
    return flag(conns, scanner_condition(max_s, by), "scanner", F.lit("quick disconnect"), ident)


def weak_username(creds: DataFrame, users=lists.WEAK_USERS) -> DataFrame:
    return flag(creds, F.col("username").isin(*users), "weak_credentials", F.col("username"))


LOG_SCHEMA = (
    f"{SRC} string, sec long, dst string, dst_port int, detection_type string, lo long, hi long, step long, "
    "tries long, turn long, fails long, failed long"
)


def failure_walk_step(fails_n: int, rapid_n: int, window: int):
    """One second of a source: (failure window, failures, attempt window, attempts), -1 without a window -> the same behind it, firings.

    Inside a second: failures, successes, closing short sessions. The attempts of a second are numbered from 1;
    each kind fires at a range of them, given by its ends and step, so a second costs the same however
    many attempts it has. ``turn`` is the attempt that first brings the rapid counter to its limit.
    """

    def step(state, sec, failed, won, shorts):
        fail_at, fails, try_at, tries = state
        if fail_at >= 0 and sec >= fail_at + window:
            fail_at, fails = -1, 0
        if try_at < 0 or sec >= try_at + window:
            try_at, tries = sec, 0
        attempts, turn = failed + won, max(1, rapid_n - tries)
        ranges = [("bruteforce", max(1, fails_n - fails), failed, 1), ("rapid_connections", turn, attempts, rapid_n)]
        if won and fails + failed:
            ranges.append(("bruteforce_success", failed + 1, failed + 1, 1))
        fired = [(k, lo, hi, by, tries, turn, fails, failed) for k, lo, hi, by in ranges if lo <= hi]
        if failed and fail_at < 0:
            fail_at = sec
        fails = 0 if won else fails + failed
        tries = (tries + attempts if attempts < turn else (attempts - turn) % rapid_n) + shorts
        return (fail_at, fails, try_at, tries), fired

    return step


def _log_walk(fails_n: int, rapid_n: int, window: int):
    """Both SSH counters of a source side by side, each in its own expiring window."""
    step = failure_walk_step(fails_n, rapid_n, window)

    def run(batches):
        source, state = None, None
        columns = [SRC, "sec", "fails", "wins", "shorts", "dst", "dst_port"]
        names = [SRC, "sec", "dst", "dst_port", "detection_type", "lo", "hi", "step", "tries", "turn", "fails", "failed"]
        for pdf in batches:
            out = []
            for src, sec, failed, won, shorts, dst, port in zip(*[pdf[c].tolist() for c in columns]):
                if src != source:
                    source, state = src, (-1, 0, -1, 0)
                state, fired = step(state, sec, failed, won, shorts)
                out += [(src, sec, dst, port, *f) for f in fired]
            yield pd.DataFrame(out, columns=names)

    return run


def short_session(max_s: float = 5) -> Column:
    return (F.col("dest_port") == 22) & (F.col("protocol") == "ssh") & (F.col("duration") < max_s)


def ssh_log(
    auth: DataFrame, conns: DataFrame, creds: DataFrame, fails: int = 10, rapid: int = 15, window: int = 600, max_s: float = 5,
    scanner_by: str = "service",
) -> DataFrame:
    """All SSH detections as one log: destination, kind, both counters, note.

    The counters are those the detection saw; scanner and weak-name rows have none. The
    destination is that of an attempt of the firing second; a credential has none.
    """
    when = epoch("timestamp").alias("sec")
    zero = F.lit(0).cast("long")
    logins = auth.groupBy(SRC, when).agg(
        F.count_if(~F.col("authenticated")).alias("fails"), F.count_if("authenticated").alias("wins"), zero.alias("shorts"),
        F.min("dest_ip").alias("dst"), F.min("dest_port").alias("dst_port"),
    )
    closed = conns.filter(short_session(max_s)).groupBy(SRC, when).agg(
        zero.alias("fails"), zero.alias("wins"), F.count(F.lit(1)).alias("shorts"),
        F.min("dest_ip").alias("dst"), F.min("dest_port").alias("dst_port"),
    )
    seconds = logins.unionByName(closed).groupBy(SRC, "sec").agg(
        *[F.sum(c).alias(c) for c in ("fails", "wins", "shorts")], F.min("dst").alias("dst"), F.min("dst_port").alias("dst_port")
    )
    can_fire = (F.col("_fails") >= fails) | ((F.col("_fails") > 0) & (F.col("_wins") > 0))
    can_fire = can_fire | (F.col("_fails") + F.col("_wins") + F.col("_shorts") >= rapid)
    live = reachable(seconds, [SRC], can_fire, _fails=F.sum("fails"), _wins=F.sum("wins"), _shorts=F.sum("shorts"))
    counted = walk(live, [SRC], _log_walk(fails, rapid, window), LOG_SCHEMA, placed=True)
    return ssh_plain_rows(finish_ssh_log(counted, rapid), conns, creds, scanner_by)


def finish_ssh_log(counted: DataFrame, rapid: int) -> DataFrame:
    """Rows of the log from ranges of firing attempts."""
    counted = counted.withColumn("at", F.explode(F.sequence("lo", "hi", "step")))
    # the counters as the attempt saw them: the rapid one starts anew after each turn, a success ends the failures
    since_turn = (F.col("at") - F.col("turn") - 1) % rapid + 1
    seen = F.when(F.col("at") <= F.col("failed"), F.col("fails") + F.col("at"))
    seen = seen.when(F.col("detection_type") == "bruteforce_success", F.col("fails") + F.col("failed")).otherwise(0)
    counted = counted.withColumn("failed_logins", seen)
    counted = counted.withColumn("conn_attempts", F.when(F.col("at") <= F.col("turn"), F.col("tries") + F.col("at")).otherwise(since_turn))
    saw = F.concat_ws(" ", F.col("conn_attempts").cast("string"), F.lit("attempts,"), F.col("failed_logins").cast("string"), F.lit("failed"))
    return counted.select(
        F.timestamp_seconds("sec").alias("ts"), F.col(SRC).alias("src"), "dst", "dst_port", "detection_type", "conn_attempts",
        "failed_logins", saw.alias("note"),
    )


def ssh_plain_rows(counted: DataFrame, conns: DataFrame, creds: DataFrame | None, scanner_by: str) -> DataFrame:
    """The log's counted rows with those that need no counter: quick disconnects and weak names."""

    def plain(rows, dst, port, kind, note):
        return rows.select(
            F.col("timestamp").alias("ts"), F.col(SRC).alias("src"), dst.alias("dst"), port.cast("int").alias("dst_port"),
            F.lit(kind).alias("detection_type"), F.lit(None).cast("long").alias("conn_attempts"),
            F.lit(None).cast("long").alias("failed_logins"), note.alias("note"),
        )

    quick = plain(conns.filter(scanner_condition(by=scanner_by)), F.col("dest_ip"), F.col("dest_port"), "scanner", F.lit("quick disconnect"))
    out = counted.unionByName(quick)
    if creds is None:
        return out
    return out.unionByName(plain(creds.filter(F.col("username").isin(*lists.WEAK_USERS)), F.lit(""), F.lit(22), "weak_credentials", F.col("username")))


# --- downloads


def download_log(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requests for files and captured files as one download log."""
    name = F.regexp_extract("uri", r"([^/?]+\.[A-Za-z0-9]+)(?:\?.*)?$", 1)
    asked = requests.filter(name != "").select(
        F.col("timestamp").alias("ts"), F.col(SRC).alias("source"), F.col("dest_ip").alias("dest"),
        "method", F.col("uri").alias("url"), name.alias("filename"), F.lit("").alias("mime_type"),
        F.col("response_body_len").cast("long").alias("size"),
        F.lit("").alias("md5"), F.lit("").alias("sha1"), F.lit("").alias("sha256"),
    )
    got = files.select(
        F.col("timestamp").alias("ts"), F.col(SRC).alias("source"), F.lit("").alias("dest"),
        F.lit("").alias("method"), F.col("download_url").alias("url"), "filename", "mime_type",
        F.col("file_size").cast("long").alias("size"), F.col("md5_hash").alias("md5"),
        F.col("sha1_hash").alias("sha1"), F.col("sha256_hash").alias("sha256"),
    )
    return asked.unionByName(got)


def malware_extension(files: DataFrame, pattern: str = lists.MALWARE_EXTENSIONS) -> DataFrame:
    return flag(files, F.col("filename").rlike(pattern), "malware_extension", F.col("filename"))


def suspicious_get(
    requests: DataFrame, binaries: str = lists.MALWARE_EXTENSIONS, scripts: str = lists.SCRIPT_EXTENSIONS
) -> DataFrame:
    cond = (F.col("method") == "GET") & F.col("uri").rlike(f"{binaries}|{scripts}")
    return flag(requests, cond, "suspicious_get", F.col("uri"))


def ftp_retrieve(events: DataFrame, command: str = "RETR") -> DataFrame:
    first_word = F.substring_index(_text("command"), " ", 1)
    return flag(events, first_word == command, "ftp_retrieve", F.col("command"))


# --- camera and router sensors


def rtsp_overflow(requests: DataFrame, limit: int = 1024) -> DataFrame:
    return requests.filter(F.length("authorization") > limit).select(
        F.col("timestamp").alias("ts"), F.col("session_id").alias("source"),
        F.lit("buffer_overflow").alias("detection_type"), F.length("authorization").cast("long").alias("count"),
        F.lit(f"authorization longer than {limit}").alias("note"), F.col("session_id").alias("identifier"),
    )


def rtsp_bruteforce(requests: DataFrame, n: int = 5, window: int = 60) -> DataFrame:
    """Authenticated requests of a session with more than ``n`` in the trailing window."""
    fired = trailing_count(requests.filter(_text("authorization") != ""), ["session_id"], window, n)
    return fired.select(
        F.timestamp_seconds("sec").alias("ts"), F.col("session_id").alias("source"),
        F.lit("brute_force").alias("detection_type"), F.col("hit").alias("count"),
        F.concat(F.lit("auth requests: "), F.col("hit").cast("string")).alias("note"),
        F.col("session_id").alias("identifier"),
    )


def rtsp_long_uri(requests: DataFrame, limit: int = 2048) -> DataFrame:
    return requests.filter(F.length("url") > limit).select(
        F.col("timestamp").alias("ts"), F.col("session_id").alias("source"),
        F.lit("uri_overflow").alias("detection_type"), F.length("url").cast("long").alias("count"),
        F.lit(f"url longer than {limit}").alias("note"), F.col("session_id").alias("identifier"),
    )


def rtsp_sessions(requests: DataFrame) -> DataFrame:
    span = F.max(epoch("timestamp")) - F.min(epoch("timestamp"))
    return requests.groupBy("session_id").agg(span.alias("duration"), F.count(F.lit(1)).alias("requests_count"))


def port_mapping_abuse(raw: DataFrame) -> DataFrame:
    """Flag router-control messages that add or delete a port mapping; delete wins."""
    text = F.concat_ws("\n", _text("soap_action"), _text("body_preview"))
    kind = F.when(text.contains("DeletePortMapping"), "DeletePortMapping abuse").when(
        text.contains("AddPortMapping"), "AddPortMapping abuse"
    )
    return raw.withColumns({"attack_detected": kind.isNotNull(), "attack_type": F.coalesce(kind, F.lit(""))})


def ssdp_relevant(raw: DataFrame, targets=lists.SSDP_TARGETS, device_id: str | None = None) -> DataFrame:
    """Whether a search names something the device offers; no target means all."""
    wanted = F.lower(F.coalesce("search_target", F.lit("ssdp:all")))
    hit = F.lit(False)
    for target in [*targets, *([device_id] if device_id else [])]:
        hit = hit | wanted.contains(target.lower())
    return raw.withColumn("relevant", hit)


# --- first sightings


def new_sightings(conns: DataFrame, keys: list, ttl: int = 86400) -> DataFrame:
    """Hosts or services seen for the first time, or again after ``ttl`` seconds from that."""
    seen = per_second(conns, keys)
    return anchored(seen, keys, ttl).filter("n_before = 0").select(*keys, F.timestamp_seconds("sec").alias("first_seen"))
