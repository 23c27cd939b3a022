"""What keeps running: several sources, redelivery, maintained rollups, stored lookups, stateful streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timing import since
from ..operators import geo, maintained, rollups
from ..plans import analytics as a
from ..plans import heavy
from ..session import scratch_path
from ..sources import tables
from ..streaming import ingest, stateful
from . import rawlogs
from .alert_entries import GRID, HE, SERIES, _drain, _replay, _spikes
from .detection_entries import DC, PORTS6
from .ingest_entries import CONN_SQL, COWRIE_SQL, EVENT_COLS, on_ids
from .registry import ORACLES, add, ago, chain_sql
from .sqlviews import K, q
from .views import AS_OF, SALT

# --- several sources of one kind, redelivered lines


def _folders(v, parts: int):
    """The shell sensor's lines dealt to the folders of several hosts."""
    lines = rawlogs.cowrie(v)
    part = F.pmod(F.xxhash64("value"), F.lit(parts))
    return [rawlogs.write_lines(lines.filter(part == k), f"host-{k}") for k in range(parts)]


def _hosts(v):
    """Three hosts tailed into one root, each with its own checkpoint; the last one in batches of limited size."""
    root = scratch_path(v.spark, "tables")
    one, two, three = _folders(v, 3)
    for folder in (one, two):
        ingest.ingest(v.spark, "cowrie", folder, root, scratch_path(v.spark, "state"), SALT, v.geo_ranges()).awaitTermination()
    ingest.drain(v.spark, "cowrie", three, root, scratch_path(v.spark, "state"), SALT, v.geo_ranges(), batch_bytes=512 << 10)
    return tables.read_table(v.spark, HE, root).select(*EVENT_COLS)


add("s1_several_hosts", _hosts, COWRIE_SQL)


def _redelivered(v, once_each: bool):
    """One folder read twice, the second time with a new checkpoint: every line comes again."""
    root, (folder,) = scratch_path(v.spark, "tables"), _folders(v, 1)
    for _ in range(2):
        state = scratch_path(v.spark, "state")
        ingest.ingest(v.spark, "cowrie", folder, root, state, SALT, v.geo_ranges(), once_each=once_each).awaitTermination()
    return tables.read_table(v.spark, HE, root, lines=True)


add("q45_once_each", lambda v: _redelivered(v, True).select(*EVENT_COLS), COWRIE_SQL)
add("q45_stored_repeats", lambda v: ingest.batch_without_repeats(_redelivered(v, False)).select(*EVENT_COLS), COWRIE_SQL)


def _tailed(v, kind, lines, table):
    root = scratch_path(v.spark, "tables")
    ingest.ingest(v.spark, kind, rawlogs.write_lines(lines, "tail-net"), root, scratch_path(v.spark, "state"), SALT).awaitTermination()
    return tables.read_table(v.spark, table, root).drop("month")


add("s3_stream_dns", lambda v: _tailed(v, "zeek_dns", rawlogs.zeek_dns(v), "dns_queries"), on_ids(
    "true", timestamp=CONN_SQL["timestamp"], source_ip_hash=CONN_SQL["source_ip_hash"], query=f"'host' || {K} || '.example'"))
add("s3_stream_ssh", lambda v: _tailed(v, "zeek_ssh", rawlogs.zeek_ssh(v), "ssh_auth"), on_ids(
    "true", timestamp=CONN_SQL["timestamp"], source_ip_hash=CONN_SQL["source_ip_hash"], dest_ip=CONN_SQL["dest_ip"], dest_port="22",
    authenticated="coalesce(CASE WHEN event_id % 3 < 2 THEN event_id % 3 = 0 END, false)"))

# --- rollups kept up to date batch by batch; one batch is retried, one month compacted


def _maintained(v, df, table: str, name: str, key: str):
    root = scratch_path(v.spark, "rollups")
    rows = df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(3)))
    for part in (0, 1, 1, 2):
        maintained.add_batch(rows.filter(F.col("_part") == part), table, root, f"batch-{part}")
    maintained.compact_rollup(v.spark, name, root, "2024-01")
    maintained.add_batch(rows.limit(0), table, root, "batch-3")
    return maintained.read_profiles(v.spark, root) if name == maintained.PROFILES else maintained.read_rollup(v.spark, name, root)


for _key, _name, _rows, _id in (
    ("a1_daily_attack_stats", "daily_attack_stats", lambda v: v.events(), "event_id"),
    ("a2_top_attacked_services", "top_attacked_services", lambda v: v.conns(), "uid"),
    ("a3_credential_stats", "credential_stats", lambda v: v.creds(), "event_id"),
    ("a4_profiles_from_states", maintained.PROFILES, lambda v: v.events(), "event_id"),
    ("a5_mitre_attack_stats", "mitre_attack_stats", lambda v: v.alerts(), "alert_id"),
    ("a6_geographic_attack_stats", "geographic_attack_stats", lambda v: v.events(), "event_id"),
):
    _table = HE if _name == maintained.PROFILES else maintained.ROLLUPS[_name].table
    add(f"{_key.split('_')[0]}_maintained", lambda v, t=_table, m=_name, r=_rows, i=_id: _maintained(v, r(v), t, m, i), ORACLES[_key])


def _ingested_rollup(v):
    """The rollup that two hosts' ingestion keeps, against a recompute over the tables that it wrote."""
    root = scratch_path(v.spark, "tables")
    for folder in _folders(v, 2):
        ingest.ingest(v.spark, "cowrie", folder, root, scratch_path(v.spark, "state"), SALT, rollups=True).awaitTermination()
    kept = maintained.read_rollup(v.spark, "daily_attack_stats", root)
    return kept.join(rollups.daily_attack_stats(tables.read_table(v.spark, HE, root)), kept.columns, "left_semi")


add("a1_ingested", _ingested_rollup, f"""SELECT CAST(CAST(timestamp AS TIMESTAMP)::DATE AS VARCHAR) AS date, honeypot_type, event_type, count(*) AS event_count,
  count(DISTINCT source_ip_hash) AS unique_attackers, count(DISTINCT dest_port) AS unique_ports FROM ({COWRIE_SQL}) GROUP BY ALL""")

# --- addresses of both kinds against a stored index

_SIX = "concat('2001:db8:', lower(hex(c_custkey % 4096)), '::', lower(hex(c_custkey)))"
_FOUR = "concat(c_nationkey, '.', c_custkey % 256, '.1.1')"


def _any_address(v):
    """Customers' addresses in five spellings; every nation has a range of each kind, every fifth a narrower one in its neighbour's."""
    told = v.raw("customer").selectExpr(
        "c_custkey", f"""CASE c_custkey % 5 WHEN 0 THEN {_FOUR} WHEN 1 THEN concat('::ffff:', {_FOUR}) WHEN 2 THEN {_SIX}
        WHEN 3 THEN concat('[', upper({_SIX}), '%eth0]') ELSE concat('2001:db8:', c_custkey) END AS src_ip""")
    nation = v.raw("nation")
    ranges = nation.selectExpr(
        "concat(n_nationkey, '.0.0.0') AS start_ip", "concat(n_nationkey, '.', 255 - n_regionkey * 64, '.255.255') AS end_ip", "n_name AS country")
    six = lambda lo, hi, name, where: nation.filter(where).selectExpr(
        f"concat('2001:db8:', lower(hex({lo})), '::') AS start_ip",
        f"concat('2001:db8:', lower(hex({hi})), ':ffff:ffff:ffff:ffff:ffff') AS end_ip", f"{name} AS country")
    ranges = ranges.unionByName(six("n_nationkey * 150 + 7", "n_nationkey * 150 + 120", "n_name", "true"))
    ranges = ranges.unionByName(six("n_nationkey * 150 + 60", "n_nationkey * 150 + 66", "concat('part of ', n_name)", "n_nationkey % 5 = 0"))
    index = geo.build_geo_index(ranges, scratch_path(v.spark, "geo"))
    return geo.geo_enrich(told, "src_ip", index, default="XX").select("c_custkey", "source_ip_country")


add("e2_any_address", _any_address, """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 < 2 THEN four.n_name WHEN c_custkey % 5 < 4 THEN
    CASE WHEN six.n_nationkey % 5 = 0 AND g BETWEEN six.n_nationkey * 150 + 60 AND six.n_nationkey * 150 + 66 THEN 'part of ' || six.n_name
    ELSE six.n_name END END, 'XX') AS source_ip_country
  FROM (SELECT *, c_custkey % 4096 AS g FROM customer)
  LEFT JOIN nation four ON four.n_nationkey = c_nationkey AND c_custkey % 256 <= 255 - four.n_regionkey * 64
  LEFT JOIN nation six ON g BETWEEN six.n_nationkey * 150 + 7 AND six.n_nationkey * 150 + 120""")

# --- export and import of all tables, retention by day


def _all_tables(v):
    return {HE: v.events(), "ids_alerts": v.alerts(), "network_connections": v.conns(), "http_requests": v.requests(),
            "downloaded_files": v.files(), "credentials": v.creds(),
            "attacker_profiles": rollups.finish_profiles(rollups.profile_states(v.events()))}


def _counts(frames):
    parts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows")) for name, df in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _export_all(v):
    paths = tables.export_tables(_all_tables(v), AS_OF, scratch_path(v.spark, "export"))
    return _counts({name: v.spark.read.parquet(path) for name, path in paths.items()})


def _import_all(v):
    root = scratch_path(v.spark, "import")
    paths = tables.export_tables(_all_tables(v), AS_OF, scratch_path(v.spark, "export"))
    return _counts({name: tables.import_table(v.spark, path, name, root) for name, path in paths.items()})


_ALL_SQL = q(" UNION ALL ".join(
    [f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t} WHERE timestamp >= TIMESTAMP '{ago(7)}' AND timestamp <= TIMESTAMP '{AS_OF}'"
     for t in tables.EXPORTED] + ["SELECT 'attacker_profiles', count(DISTINCT source_ip_hash) FROM honeypot_events"]),
    HE, "ids_alerts", "network_connections", "http_requests", "downloaded_files", "credentials")
add("s6_export_all", _export_all, _ALL_SQL)
add("s7_import_all", _import_all, _ALL_SQL)


def _expired_days(v):
    """Retention ends inside January: its expired days go, the others and later batches stay."""
    root = scratch_path(v.spark, "expire")
    for k in (0, 1):
        tables.append_table(v.conns().filter(F.col("uid") % 2 == k), "network_connections", root)
    tables.expire(v.spark, "network_connections", root, "2024-02-10 12:00:00")
    return tables.read_table(v.spark, "network_connections", root).groupBy("protocol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("oldest"))


add("s9_expired_days", _expired_days, q(
    "SELECT protocol, count(*) AS rows, CAST(min(timestamp) AS VARCHAR) AS oldest FROM network_connections "
    "WHERE timestamp > TIMESTAMP '2024-01-11 12:00:00' GROUP BY 1", "network_connections"))

# --- the most frequent groups, counted among candidates only


def _of_top(rows, keys, n):
    # as few buckets as the small tables need to leave something out
    return heavy.of_top(rows, keys, n, 256)


for _key, _build in {
    "q05_top_credentials": lambda v: a.top_credentials(_of_top(since(v.creds(ago(30)), AS_OF, days=30), ["username", "password"], 100), AS_OF),
    "q06_targeted_usernames": lambda v: a.targeted_usernames(_of_top(since(v.creds(ago(30)), AS_OF, days=30), ["username"], 50), AS_OF),
    "q30_top_uris": lambda v: a.top_uris(_of_top(since(v.requests(), AS_OF, days=30), ["uri"], 20), AS_OF, 30),
    "q31_pair_counts": lambda v: a.pair_counts(_of_top(since(v.creds(ago(7)), AS_OF, days=7), ["username", "password"], 20), AS_OF),
}.items():
    add(f"{_key}_heavy", _build, ORACLES[_key])


def _curved(v):
    """One month compacted along a curve over time, source and country."""
    root = scratch_path(v.spark, "curve")
    tables.append_table(v.events(), HE, root)
    tables.compact_by_curve(v.spark, HE, root, "2024-01", ["timestamp", "source_ip_hash", "source_ip_country"], 16)
    return tables.read_table(v.spark, HE, root).select("event_id", "source_ip_hash", "source_ip_country", "timestamp")


add("s10_curve", _curved, q(
    "SELECT event_id::VARCHAR AS event_id, source_ip_hash, source_ip_country, CAST(timestamp AS VARCHAR) AS timestamp FROM honeypot_events", HE))

# --- counters, sets and states on streams


def _stream_multi(v):
    hits = v.dense_conns().filter(F.col("dest_port").isin(23, 2323, 22, 8080, 8081, 80)).select("timestamp", "source_ip_hash", "dest_port")
    fired = stateful.stream_distinct_alarm(_replay(v, hits, "multi"), "source_ip_hash", "dest_port", 3, 300)
    return _drain(v, fired, "multi").select(F.col("key").alias("source"), "sec", "hits", "distinct_items")


_PORT_HITS = f"SELECT source_ip_hash AS key, epoch(timestamp)::BIGINT AS sec, count(*)::BIGINT AS cnt FROM {DC} WHERE {PORTS6} GROUP BY 1, 2"
add("d_scn_3_stream", _stream_multi, q(
    """SELECT key AS source, sec, count(*)::BIGINT AS hits, max(seen)::BIGINT AS distinct_items FROM (
      SELECT e.*, (SELECT count(DISTINCT f.dest_port) FROM placed f WHERE f.key = e.key AND f.anchor = e.anchor AND f.sec <= e.sec) AS seen
      FROM placed e) WHERE sec + 1 <= (SELECT max(sec) FROM sec_hits) - 600 GROUP BY key, sec HAVING max(seen) >= 3""",
    DC, recursive=True, extra=chain_sql(_PORT_HITS, "300") + f""",
placed AS (SELECT w.key, w.sec, w.anchor, c.uid, c.dest_port FROM walked w JOIN {DC} c
  ON c.source_ip_hash = w.key AND epoch(c.timestamp)::BIGINT = w.sec WHERE {PORTS6})"""))


def _stream_services(v):
    rows = v.conns().select("timestamp", "dest_ip", F.concat_ws("#", F.col("dest_port").cast("string"), "protocol").alias("service"))
    return _drain(v, stateful.stream_new_services(_replay(v, rows, "services"), "dest_ip", "service"), "services")


add("d_new_stream", _stream_services, q(
    "SELECT split_part(key, '|', 1) AS dest_ip, split_part(key, '|', 2) AS service, CAST(make_timestamp(sec * 1000000) AS VARCHAR) AS first_seen "
    "FROM walked WHERE n_before = 0 AND sec + 1 <= (SELECT max(epoch(timestamp)) FROM network_connections) - 600",
    "network_connections", recursive=True, extra=chain_sql(
        "SELECT dest_ip || '|' || dest_port || '#' || protocol AS key, epoch(timestamp)::BIGINT AS sec, count(*)::BIGINT AS cnt "
        "FROM network_connections GROUP BY 1, 2", "86400")))

# one row for each attempt and closing session in order, both counters carried from row to row
SSH_ROWS = """ssh_rows AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY sec, kind, nr) AS rn, min(dst) OVER (PARTITION BY key, sec) AS at_ip,
    min(port) OVER (PARTITION BY key, sec) AS at_port FROM (
    SELECT source_ip_hash AS key, epoch(timestamp)::BIGINT AS sec, CASE WHEN authenticated THEN 1 ELSE 0 END AS kind, dest_ip AS dst, dest_port AS port,
      row_number() OVER () AS nr FROM ssh_auth
    UNION ALL SELECT source_ip_hash, epoch(timestamp)::BIGINT, 2, dest_ip, dest_port, 0 FROM network_connections
      WHERE dest_port = 22 AND protocol = 'ssh' AND duration < {short})),
steps AS (
  SELECT key, rn, sec, kind, at_ip, at_port, sec AS try_at, CASE WHEN kind = 0 THEN sec END AS fail_at,
    CASE WHEN kind = 0 THEN 1 ELSE 0 END AS fails, 1 AS tries, 0 AS was, false AS rapid FROM ssh_rows WHERE rn = 1
  UNION ALL
  SELECT key, rn, sec, kind, at_ip, at_port, new_try, CASE WHEN kind = 0 AND old_fail IS NULL THEN sec ELSE old_fail END,
    CASE kind WHEN 0 THEN level + 1 WHEN 1 THEN 0 ELSE level END, count + 1, level, kind < 2 AND count + 1 >= {rapid} FROM (
    SELECT e.key, e.rn, e.sec, e.kind, e.at_ip, e.at_port,
      CASE WHEN e.sec >= s.try_at + {window} THEN e.sec ELSE s.try_at END AS new_try,
      CASE WHEN e.sec >= s.try_at + {window} OR s.rapid THEN 0 ELSE s.tries END AS count,
      CASE WHEN e.sec >= s.fail_at + {window} THEN NULL ELSE s.fail_at END AS old_fail,
      CASE WHEN e.sec >= s.fail_at + {window} THEN 0 ELSE s.fails END AS level
    FROM steps s JOIN ssh_rows e ON e.key = s.key AND e.rn = s.rn + 1)),
counted AS (
  SELECT sec, key, at_ip, at_port, 'bruteforce' AS kind_name, tries, fails AS failed FROM steps WHERE kind = 0 AND fails >= {fails}
  UNION ALL SELECT sec, key, at_ip, at_port, 'bruteforce_success', tries, was FROM steps WHERE kind = 1 AND was > 0
  UNION ALL SELECT sec, key, at_ip, at_port, 'rapid_connections', tries, CASE kind WHEN 0 THEN fails ELSE 0 END FROM steps WHERE rapid)"""
SSH_COUNTED = """SELECT CAST(make_timestamp(sec * 1000000) AS VARCHAR) AS ts, key AS src, at_ip AS dst, at_port AS dst_port, kind_name AS detection_type,
  tries::BIGINT AS conn_attempts, failed::BIGINT AS failed_logins, tries || ' attempts, ' || failed || ' failed' AS note FROM counted"""
SSH_PLAIN = """ UNION ALL SELECT CAST(timestamp AS VARCHAR), source_ip_hash, dest_ip, dest_port, 'scanner', NULL, NULL, 'quick disconnect'
  FROM network_connections WHERE dest_port = 22 AND duration < 3 AND service = ''"""
SSH_WEAK = """ UNION ALL SELECT CAST(timestamp AS VARCHAR), source_ip_hash, '', 22, 'weak_credentials', NULL, NULL, username
  FROM credentials WHERE username IN ('root', 'admin', 'user', 'test', 'guest', 'pi', 'ubuntu', 'oracle', 'support', 'default', 'user1',
    'administrator', 'Administrator', 'daemon', 'ftp', 'postgres', 'mysql', 'www-data', 'nobody')"""
_WEEK = 7 * 86400
ORACLES["d_ssh_6_log"] = q(
    SSH_COUNTED + SSH_PLAIN + SSH_WEAK, "ssh_auth", "network_connections", "credentials", recursive=True,
    extra=SSH_ROWS.format(short=5, window=_WEEK, rapid=6, fails=5))
ORACLES["d_ssh_3_rapid_with_sessions_7d"] = q(
    "SELECT CAST(make_timestamp(sec * 1000000) AS VARCHAR) AS ts, key AS source, 'rapid_connections' AS detection_type, tries::BIGINT AS count, "
    "'attempts: ' || tries AS note, key || '-rapid' AS identifier FROM steps WHERE rapid", "ssh_auth", "network_connections",
    recursive=True, extra=SSH_ROWS.format(short=100, window=_WEEK, rapid=6, fails=5))


def _stream_ssh(v):
    auth = v.auth().select("timestamp", "source_ip_hash", "dest_ip", "dest_port", "authenticated")
    conns = v.conns().select("timestamp", "source_ip_hash", "dest_ip", "dest_port", "protocol", "service", "duration", "conn_state")
    log = stateful.stream_ssh_log(_replay(v, auth, "auth"), _replay(v, conns, "sessions"), None, 5, 6, _WEEK)
    return _drain(v, log, "ssh-log")


_CLOSED = "least((SELECT max(epoch(timestamp)) FROM ssh_auth), (SELECT max(epoch(timestamp)) FROM network_connections))"
add("d_ssh_6_stream", _stream_ssh, q(
    SSH_COUNTED + f" WHERE sec + 1 <= {_CLOSED} - 600" + SSH_PLAIN, "ssh_auth", "network_connections",
    recursive=True, extra=SSH_ROWS.format(short=5, window=_WEEK, rapid=6, fails=5)))


def _stream_silence(v):
    """Rules whose rows stop: minutes without a row are breaches, told by timers."""
    series = _spikes(v).filter("rule = 'ICSProtocolAttack' AND value > 0").select("rule", "minute", F.lit(False).alias("breach"))
    states = stateful.stream_alert_states(_replay(v, series, "silence"), 3, no_data={"ICSProtocolAttack": "Alerting"})
    return _drain(v, states, "silence")


add("l8_stream_no_data", _stream_silence, q(
    f"""SELECT rule, CAST(minute AS VARCHAR) AS minute, state FROM (SELECT rule, minute, CASE WHEN breach THEN CASE WHEN pos - 1 >= 3 THEN 'firing' ELSE 'pending' END
      WHEN prev_breach AND prev_pos - 1 >= 3 THEN 'resolved' END AS state FROM (
      SELECT *, lag(breach) OVER w AS prev_breach, lag(pos) OVER w AS prev_pos FROM (
        SELECT rule, minute, missing AS breach, row_number() OVER (PARTITION BY rule, missing, isl ORDER BY minute) AS pos FROM (
          SELECT *, (epoch(minute) / 60)::BIGINT - row_number() OVER (PARTITION BY rule, missing ORDER BY minute) AS isl FROM grid
          WHERE rule = 'ICSProtocolAttack' AND minute >= (SELECT min(minute::TIMESTAMP) FROM series WHERE rule = 'ICSProtocolAttack')))
      WINDOW w AS (PARTITION BY rule ORDER BY minute)))
    WHERE state IS NOT NULL AND minute + INTERVAL 1 minute <= (SELECT max(minute::TIMESTAMP) FROM series WHERE rule = 'ICSProtocolAttack') - INTERVAL 2 minute""",
    HE, extra=f"{SERIES},\n{GRID}"))
