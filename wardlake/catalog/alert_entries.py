"""Alert rules, evaluation and streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import normalise as n
from ..plans import alerts as al
from ..plans import evaluation as ev
from ..session import scratch_path
from ..sources import tables
from ..sources.logs import line_id
from ..streaming import ingest, rollup, stateful
from . import rawlogs
from .ingest_entries import CONN_SQL, COWRIE_SQL, EVENT_COLS, HTTP_SQL, on_ids
from .registry import add, chain_sql, fire_sql, window
from .sqlviews import q
from .views import AS_OF, SALT, SCENARIOS

HE, IA, CR, DF = "honeypot_events", "ids_alerts", "credentials", "downloaded_files"
LO, HI = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
MINUTE = "date_trunc('minute', timestamp)"


def trailing(table: str, cond: str, minutes: int, limit: int, key: str = "") -> str:
    """Counts over a minute and those before it, stated as a join of minutes with rows."""
    k = f"{key}, " if key else ""
    return (f"SELECT CAST(m AS VARCHAR) AS minute, {k}count(*) AS value, count(*) > {limit} AS breach FROM "
            f"(SELECT {k}unnest(generate_series({MINUTE}, {MINUTE} + INTERVAL {minutes - 1} minute, INTERVAL 1 minute)) AS m "
            f"FROM {table} WHERE {cond}) GROUP BY m{', ' + key if key else ''}")




def _rule_views(v):
    views = al.rule_views(v.events(), v.alerts(), v.creds(), v.files())
    counts = [df.agg(F.lit(name).alias("view"), F.count(F.lit(1)).alias("rows")) for name, df in views.items()]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


add("l0_rule_views", _rule_views, q(
    "SELECT 'suricata_alerts' AS view, count(*) AS rows FROM ids_alerts UNION ALL "
    "SELECT 'cowrie_auth', count(*) FROM credentials UNION ALL SELECT 'dionaea_binaries', count(*) FROM downloaded_files UNION ALL "
    "SELECT 'cowrie_sessions', count(*) FROM honeypot_events WHERE honeypot_type = 'cowrie' UNION ALL "
    "SELECT 'dionaea_connections', count(*) FROM honeypot_events WHERE honeypot_type = 'dionaea' UNION ALL "
    "SELECT 'conpot_events', count(*) FROM honeypot_events WHERE honeypot_type = 'conpot'", HE, IA, CR, DF))
add("l1_alert_rate", lambda v: al.alert_rate(v.alerts(), 1), q(trailing(IA, "true", 1, 1), IA))
THREE = "honeypot_type IN ('cowrie', 'dionaea', 'conpot')"
add("l2_connection_spike", lambda v: al.connection_spike(v.events(), 1), q(trailing(HE, THREE, 1, 1), HE))
add("l3_malware_captured", lambda v: al.malware_captured(v.files()), q(trailing(DF, "true", 5, 1), DF))
BRUTE = f"""SELECT minute, source_ip_hash, value, value > 1 AS breach FROM ({trailing(CR, 'NOT success', 10, 1, 'source_ip_hash')})
  QUALIFY row_number() OVER (PARTITION BY minute ORDER BY value DESC, source_ip_hash) = 1"""
add("l4_brute_force", lambda v: al.brute_force(v.creds(), 1), q(BRUTE, CR))
ICS = "honeypot_type = 'conpot' AND (protocol IN ('modbus', 's7comm', 'bacnet', 'ipmi') OR event_type IN ('write', 'command'))"
add("l5_ics_attack", lambda v: al.ics_attack(v.events(), 0), q(trailing(HE, ICS, 10, 0), HE))
LAG = f"""SELECT CAST(minute AS VARCHAR) AS minute, (epoch(minute) - epoch(newest))::BIGINT AS lag_seconds,
    coalesce(epoch(minute) - epoch(newest) > 300, true) AS breach FROM (
  SELECT minute, CASE WHEN {MINUTE} >= minute - INTERVAL 60 minute THEN timestamp END AS newest
  FROM (SELECT unnest(generate_series(TIMESTAMP '{LO}', TIMESTAMP '{HI}', INTERVAL 1 minute)) AS minute) g
  ASOF LEFT JOIN (SELECT timestamp FROM honeypot_events WHERE honeypot_type IN ('cowrie', 'dionaea')
                  UNION ALL SELECT timestamp FROM ids_alerts) r ON g.minute > r.timestamp)"""
add("l6_pipeline_lag", lambda v: al.pipeline_lag(v.events(), v.alerts(), LO, HI), q(LAG, HE, IA))


def _spikes(v):
    """Minutes in which two sensors' rules hold more than one row, as one series."""
    one = al.connection_spike(v.events(), 0).withColumn("rule", F.lit("HoneypotConnectionSpike"))
    two = al.ics_attack(v.events(), 0).withColumn("rule", F.lit("ICSProtocolAttack"))
    return one.unionByName(two)


SERIES = f"""series AS (
  SELECT 'HoneypotConnectionSpike' AS rule, minute, value FROM ({trailing(HE, THREE, 1, 0)})
  UNION ALL SELECT 'ICSProtocolAttack', minute, value FROM ({trailing(HE, ICS, 10, 0)}))"""
GRID = f"""grid AS (SELECT rule, m AS minute, value, value IS NULL AS missing FROM
  (SELECT unnest(generate_series(TIMESTAMP '{LO}', TIMESTAMP '{HI}', INTERVAL 1 minute)) AS m) g
  CROSS JOIN (VALUES ('HoneypotConnectionSpike'), ('ICSProtocolAttack')) r(rule)
  LEFT JOIN (SELECT rule AS sr, minute AS sm, value FROM series) s ON sr = rule AND sm::TIMESTAMP = m)"""
STATES = """states AS (SELECT rule, minute, CASE WHEN breach THEN CASE WHEN pos - 1 >= hold THEN 'firing' ELSE 'pending' END
    WHEN prev_run - 1 >= hold THEN 'resolved' END AS state FROM (
  SELECT *, CASE rule WHEN 'HoneypotConnectionSpike' THEN 1 ELSE 5 END AS hold,
    row_number() OVER (PARTITION BY rule, breach, isl ORDER BY minute) AS pos,
    CASE WHEN lag(breach) OVER w THEN lag(run) OVER w END AS prev_run FROM (
    SELECT *, count(*) OVER (PARTITION BY rule, breach, isl ORDER BY minute) AS run FROM (
      SELECT *, (epoch(minute) / 60)::BIGINT - row_number() OVER (PARTITION BY rule, breach ORDER BY minute) AS isl
      FROM (SELECT rule, minute, coalesce(value > 0, false) AS breach FROM grid)))
  WINDOW w AS (PARTITION BY rule ORDER BY minute)))"""
LIMITS = {"HoneypotConnectionSpike": 0, "ICSProtocolAttack": 0}
HOLDS = {"HoneypotConnectionSpike": 1, "ICSProtocolAttack": 5}


def _filled(v):
    return al.fill_states(_spikes(v), LO, HI, LIMITS)


def _states(v):
    return al.evaluate(_filled(v), HOLDS)


add("l7_rule_states", _states, q(
    "SELECT rule, CAST(minute AS VARCHAR) AS minute, state FROM states WHERE state IS NOT NULL", HE,
    extra=f"{SERIES},\n{GRID},\n{STATES}"))
add("l8_no_data_states", lambda v: _filled(v).drop("value"), q(
    "SELECT rule, CAST(minute AS VARCHAR) AS minute, CASE WHEN missing THEN 'NoData' ELSE 'Alerting' END AS state, NOT missing AS breach "
    "FROM grid", HE, extra=f"{SERIES},\n{GRID}"))


def _routed(v):
    firing = _states(v).filter("state = 'firing'")
    severity = F.when(F.col("rule") == "HoneypotConnectionSpike", "critical").otherwise("high")
    return al.route_alerts(firing.select(F.col("rule").alias("alertname"), F.lit("sensor").alias("source"), severity.alias("severity"), "minute"))


FIRED = "SELECT rule AS key, epoch(minute)::BIGINT AS sec, 1::BIGINT AS cnt FROM states WHERE state = 'firing'"
add("l9_routed", _routed, q(
    "SELECT CASE key WHEN 'HoneypotConnectionSpike' THEN 'Discord Critical Alerts' ELSE 'Discord Security Alerts' END AS receiver, "
    "key || '/sensor' AS \"group\", CAST(make_timestamp(sec * 1000000) AS VARCHAR) AS sent_at FROM walked WHERE n_before = 0",
    HE, recursive=True, extra=f"{SERIES},\n{GRID},\n{STATES},\n" + chain_sql(
        FIRED, "CASE c.key WHEN 'HoneypotConnectionSpike' THEN 3600 ELSE 7200 END")))

# --- evaluation

SC = ", ".join(f"('{n}', TIMESTAMP '{lo}', TIMESTAMP '{hi}')" for n, lo, hi in SCENARIOS)
RESULTS = f"""results AS (SELECT scenario,
  (SELECT count(*) FROM honeypot_events e WHERE e.timestamp BETWEEN lo AND hi) AS events_count,
  (SELECT count(*) FROM ids_alerts a WHERE a.timestamp BETWEEN lo AND hi) AS alerts_count,
  coalesce((SELECT arg_min(mitre_technique_id, (a.timestamp, a.alert_id)) FROM ids_alerts a
    WHERE a.timestamp BETWEEN lo AND hi AND mitre_technique_id <> ''), '') AS technique
  FROM (VALUES {SC}) s(scenario, lo, hi))"""


def _results(v):
    return ev.scenario_results(SCENARIOS, v.events(), v.alerts())


add("v1_scenarios", _results, q("SELECT * FROM results", HE, IA, extra=RESULTS))
add("v2_effectiveness", lambda v: ev.effectiveness(_results(v)), q(
    """SELECT count(*) AS total, count(*) AS executed, count(*) FILTER (events_count > 0) AS honeypot_detected,
    count(*) FILTER (alerts_count > 0) AS ids_detected, count(*) FILTER (events_count > 0 AND alerts_count > 0) AS both_detected,
    count(*) FILTER (technique <> '') AS mitre_mapped,
    round(count(*) FILTER (events_count > 0 OR alerts_count > 0)::DOUBLE / count(*), 3) AS tpr,
    count(*) FILTER (events_count > 0 OR alerts_count > 0)::DOUBLE / count(*) >= 0.8 AS passed FROM results""", HE, IA, extra=RESULTS))
add("v3_false_positive_rate", lambda v: ev.false_positive_rate(v.alerts(), v.test_sources(), LO, HI), q(
    """SELECT f AS false_alerts, n AS all_alerts, round(f::DOUBLE / n, 4) AS fpr, f::DOUBLE / n <= 0.05 AS within_limit,
    round(seen::DOUBLE / tested, 4) AS tpr, CASE WHEN seen::DOUBLE / tested >= 0.9 THEN 'Excellent' WHEN seen::DOUBLE / tested >= 0.8 THEN 'Good'
      WHEN seen::DOUBLE / tested >= 0.7 THEN 'Acceptable' ELSE 'Failing' END AS tpr_band FROM (
    SELECT (SELECT count(*) FROM ids_alerts) AS n,
     (SELECT count(*) FROM ids_alerts WHERE source_ip_hash NOT IN (SELECT ip_hash FROM test_sources)) AS f,
     (SELECT count(DISTINCT source_ip_hash) FROM ids_alerts WHERE source_ip_hash IN (SELECT ip_hash FROM test_sources)) AS seen,
     (SELECT count(*) FROM test_sources) AS tested)""", IA, "test_sources"))
add("v4_alert_counts", lambda v: ev.alert_counts(v.alerts(), AS_OF, 24), q(
    f"SELECT count(DISTINCT signature_id) AS unique_alerts, count(*) AS total_alerts FROM ids_alerts WHERE {window(1)}", IA))
STAGE = """CASE WHEN signature_id IN (2000005, 2000002) THEN 'Delivery' WHEN signature_id = 2000027 THEN 'Installation'
  WHEN signature_id = 2000035 THEN 'Actions on Objectives' WHEN mitre_technique_id = 'T1046' THEN 'Reconnaissance'
  WHEN mitre_technique_id LIKE 'T1110%' THEN 'Delivery' WHEN mitre_technique_id = 'T1190' THEN 'Exploitation'
  WHEN mitre_technique_id = 'T1105' THEN 'Installation' ELSE '' END"""
add("v5_phase_coverage", lambda v: ev.phase_coverage(v.alerts()), q(
    f"SELECT phase, count(*) AS detections FROM (SELECT {STAGE} AS phase FROM ids_alerts) WHERE phase <> '' GROUP BY 1", IA))
add("v5_protocol_coverage", lambda v: ev.protocol_coverage(v.alerts()), q(
    """SELECT p AS protocol, count(*) AS detections, any_value(r)::DOUBLE AS expected_tpr FROM ids_alerts JOIN (VALUES
    (2000005, 'SSH', 0.95), (2000002, 'Telnet', 0.95), (2000008, 'HTTP', 0.90), (2000009, 'HTTP', 0.90), (2000019, 'Modbus', 0.80),
    (2000020, 'Modbus', 0.80)) x(s, p, r) ON signature_id = s GROUP BY 1""", IA))

# --- streaming: a table is replayed as a stream, drained, and what it wrote is read back


def _replay(v, df, label):
    """Write ``df`` as a stored table and open it as a stream."""
    path = scratch_path(v.spark, label)
    df.write.parquet(path)
    return v.spark.readStream.schema(df.schema).parquet(path)


def _drain(v, sdf, label, mode="append"):
    out, checkpoint = scratch_path(v.spark, f"{label}-out"), scratch_path(v.spark, f"{label}-state")
    query = (
        sdf.writeStream.format("parquet").outputMode(mode).option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return v.spark.read.schema(sdf.schema).parquet(out)


def _stream_rollup(v):
    return _drain(v, rollup.stream_rollup(_replay(v, v.events(), "rollup"), "1 day"), "rollup")


add("a8_stream_rollup", _stream_rollup, q(
    """SELECT CAST(d AS VARCHAR) AS window_start, honeypot_type, event_type, count(*) AS event_count,
    count(DISTINCT source_ip_hash) AS unique_attackers, count(DISTINCT dest_port) AS unique_ports
    FROM (SELECT *, date_trunc('day', timestamp)::TIMESTAMP AS d FROM honeypot_events)
    WHERE d + INTERVAL 1 day <= (SELECT max(timestamp) FROM honeypot_events) - INTERVAL 10 minute GROUP BY d, 2, 3""", HE))


def _ingested(v):
    source = rawlogs.write_lines(rawlogs.cowrie(v), "tail")
    root, checkpoint = scratch_path(v.spark, "tables"), scratch_path(v.spark, "tail-state")
    ingest.ingest(v.spark, "cowrie", source, root, checkpoint, SALT, v.geo_ranges()).awaitTermination()
    return ingest.read_ingested(v.spark, "honeypot_events", root).select(*EVENT_COLS)


add("s1_stream_ingest", _ingested, COWRIE_SQL)


def _tailed(v, kind, lines, table):
    """A network log tailed into its table."""
    source = rawlogs.write_lines(lines, "tail-net")
    root, checkpoint = scratch_path(v.spark, "tables"), scratch_path(v.spark, "tail-state")
    ingest.ingest(v.spark, kind, source, root, checkpoint, SALT).awaitTermination()
    return tables.read_table(v.spark, table, root)


add("s3_stream_conn", lambda v: _tailed(v, "zeek_conn", rawlogs.zeek_conn(v), "network_connections").select(*CONN_SQL), on_ids("true", **CONN_SQL))
add("s3_stream_http", lambda v: _tailed(v, "zeek_http", rawlogs.zeek_http(v), "http_requests").select(*HTTP_SQL), on_ids("true", **HTTP_SQL))


def _rejects(v):
    """Good lines and, for every third event, one that cannot be read; accepted and rejected add up."""
    junk = v.base().filter("event_id % 3 = 0").selectExpr(
        "CASE event_id % 9 WHEN 0 THEN concat('not json ', event_id) WHEN 3 THEN ' ' ELSE "
        "concat('{\"eventid\":\"x', event_id, '\",\"timestamp\":\"soon\"}') END AS value")
    source = rawlogs.write_lines(rawlogs.cowrie(v).unionByName(junk), "tail-junk")
    root, checkpoint = scratch_path(v.spark, "tables"), scratch_path(v.spark, "tail-state")
    ingest.ingest(v.spark, "cowrie", source, root, checkpoint, SALT).awaitTermination()
    bad = ingest.read_rejected(v.spark, root).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
    return bad.unionByName(tables.read_table(v.spark, HE, root).agg(F.lit("accepted").alias("reason"), F.count(F.lit(1)).alias("rows")))


add("s1_rejects", _rejects, """SELECT CASE event_id % 9 WHEN 0 THEN 'unreadable' WHEN 3 THEN 'empty' ELSE 'time' END AS reason, count(*) AS rows
    FROM events WHERE event_id % 3 = 0 GROUP BY 1 UNION ALL SELECT 'accepted', count(*) FROM events""")


def _upkeep(v):
    """Half of the rows appended, half ingested as a batch that is retried; one month compacted, old months expired."""
    root = scratch_path(v.spark, "upkeep")
    part = lambda k: v.events().filter(F.col("event_id") % 2 == k)
    old = v.events().withColumn("timestamp", F.add_months("timestamp", -24).cast("timestamp"))
    tables.append_table(part(0), HE, root)
    tables.append_table(old, HE, root)
    for _ in range(2):
        tables.write_rows(tables.with_month(n.conform(part(1), HE), HE), HE, root, "cowrie-000000000000")
    tables.compact(v.spark, HE, root, "2024-01", 4)
    tables.expire(v.spark, HE, root, AS_OF)
    return tables.read_table(v.spark, HE, root).groupBy("month", "honeypot_type").agg(F.count(F.lit(1)).alias("rows"))


add("s9_upkeep", _upkeep, q(
    "SELECT strftime(timestamp, '%Y-%m') AS month, honeypot_type, count(*) AS rows FROM honeypot_events GROUP BY ALL", HE))


def _stream_scan(v):
    hits = v.dense_conns().filter(F.col("dest_port").isin(23, 2323) & (F.col("duration") < 10)).select("timestamp", "source_ip_hash")
    alarms = stateful.stream_count_alarm(_replay(v, hits, "scan"), "source_ip_hash", 5, 300)
    return _drain(v, alarms, "scan").select(F.col("key").alias("source"), "sec", "hit")


SCAN_HITS = ("SELECT source_ip_hash AS key, epoch(timestamp)::BIGINT AS sec, count(*)::BIGINT AS cnt FROM dense_conns "
             "WHERE dest_port IN (23, 2323) AND duration < 10 GROUP BY 1, 2")
add("d_scn_1_stream", _stream_scan, q(
    "SELECT key AS source, sec, hit FROM " + fire_sql("5", "threshold") + " WHERE sec + 1 <= (SELECT max(sec) FROM sec_hits) - 600",
    "dense_conns", recursive=True, extra=chain_sql(SCAN_HITS, "300")))


def _stream_states(v):
    series = _filled(v).filter("rule = 'ICSProtocolAttack'").select("rule", "minute", "breach")
    return _drain(v, stateful.stream_alert_states(_replay(v, series, "states"), 5), "states")


add("l7_stream_states", _stream_states, q(
    f"SELECT rule, CAST(minute AS VARCHAR) AS minute, state FROM states WHERE state IS NOT NULL AND rule = 'ICSProtocolAttack' "
    f"AND minute + INTERVAL 1 minute <= TIMESTAMP '{HI}' - INTERVAL 2 minute", HE, extra=f"{SERIES},\n{GRID},\n{STATES}"))


def _lined(v):
    """Events with the identity of the line they came from."""
    return v.events().withColumn("line_id", line_id(F.lit("events.log"), F.col("event_id"), F.col("raw_data")))


def _repeated(v):
    """A redelivered stream: each row twice, one copy dropped."""
    rows = _lined(v)
    kept = ingest.without_repeats(_replay(v, rows.unionByName(rows), "repeat"))
    return _drain(v, kept.select("event_id", "event_type", "timestamp"), "repeat")


add("q45_stream_repeats", _repeated, q(
    "SELECT event_id, event_type, CAST(timestamp AS VARCHAR) AS timestamp FROM honeypot_events", HE))
add("q45_batch_repeats", lambda v: ingest.batch_without_repeats(_lined(v).unionByName(_lined(v))).select(
    "event_id", "event_type", "timestamp"), q(
    "SELECT event_id, event_type, CAST(timestamp AS VARCHAR) AS timestamp FROM honeypot_events", HE))
