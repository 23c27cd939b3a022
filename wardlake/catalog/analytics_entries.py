"""Rollups, profiles and analytic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, profiles, rollups
from ..plans import analytics as a
from .registry import add, ago, window
from .sqlviews import q
from .views import AS_OF

HE, IA, CR, NC, HR, DF = (
    "honeypot_events", "ids_alerts", "credentials", "network_connections", "http_requests", "downloaded_files",
)
DAY = "CAST(CAST(timestamp AS DATE) AS VARCHAR)"
U = "count(DISTINCT source_ip_hash)"


def txt(col: str) -> str:
    return f"CAST({col} AS VARCHAR)"


def lst(col: str) -> str:
    """A sorted set as joined text. Numbers sort as numbers."""
    return f"array_to_string(list_sort(list(DISTINCT {col})), '|')"


# --- rollups

add("a1_daily_attack_stats", lambda v: rollups.daily_attack_stats(v.events()), q(
    f"SELECT {DAY} AS date, honeypot_type, event_type, count(*) AS event_count, {U} AS unique_attackers, "
    "count(DISTINCT dest_port) AS unique_ports FROM honeypot_events GROUP BY ALL", HE))
add("a2_top_attacked_services", lambda v: rollups.top_attacked_services(v.conns()), q(
    f"SELECT {DAY} AS date, dest_port, protocol, count(*) AS connection_count, {U} AS unique_sources "
    "FROM network_connections GROUP BY ALL", NC))
add("a3_credential_stats", lambda v: rollups.credential_stats(v.creds()), q(
    f"SELECT {DAY} AS date, username, password, count(*) AS attempt_count, {U} AS unique_sources, "
    "count(*) FILTER (success) AS success_count FROM credentials GROUP BY ALL", CR))
SETS_SQL = (f"{lst('dest_port')} AS unique_ports_targeted, {lst('protocol')} AS protocols_used, "
            f"{lst('source_ip_country')} AS countries, {lst('event_type')} AS attack_types")
add("a4_profile_states", lambda v: rollups.profile_states(v.events()), q(
    f"SELECT source_ip_hash, {DAY} AS date, {txt('min(timestamp)')} AS first_seen, {txt('max(timestamp)')} AS last_seen, "
    f"count(*) AS total_events, {SETS_SQL} FROM honeypot_events GROUP BY source_ip_hash, 2", HE))
add("a4_profiles_from_states", lambda v: rollups.finish_profiles(rollups.profile_states(v.events())), q(
    f"SELECT source_ip_hash, {txt('min(timestamp)')} AS first_seen, {txt('max(timestamp)')} AS last_seen, "
    f"count(*) AS total_events, {SETS_SQL} FROM honeypot_events GROUP BY source_ip_hash", HE))
add("a5_mitre_attack_stats", lambda v: rollups.mitre_attack_stats(v.alerts()), q(
    f"SELECT {DAY} AS date, mitre_tactic, mitre_technique_id, count(*) AS technique_count, {U} AS unique_attackers, "
    "count(DISTINCT dest_port) AS unique_targets FROM ids_alerts WHERE mitre_technique_id <> '' GROUP BY ALL", IA))
add("a6_geographic_attack_stats", lambda v: rollups.geographic_attack_stats(v.events()), q(
    f"SELECT {DAY} AS date, source_ip_country, honeypot_type, count(*) AS attack_count, {U} AS unique_attackers, "
    "count(DISTINCT dest_port) AS unique_ports_targeted FROM honeypot_events WHERE source_ip_country <> '' GROUP BY ALL", HE))


def _merged_counts(v):
    """Rollups of the first and second half of the month, merged; one day lies in both.

    Sums must equal a full recompute, and the merged sketches must come close to the exact
    distinct counts (adding the halves' own counts would not, on the shared day).
    """
    keys, distinct = [rollups.day(), "event_type"], {"unique_attackers": "source_ip_hash"}
    early = v.events().filter("timestamp < timestamp'2024-01-15 12:00:00'")
    late = v.events().filter("timestamp >= timestamp'2024-01-15 12:00:00'")
    parts = [rollups.sketched_rollup(df, keys, distinct) for df in (early, late)]
    merged = rollups.merge_rollup(*parts, ["date", "event_type"], ["event_count"], ["unique_attackers"])
    exact = v.events().groupBy(rollups.day(), "event_type").agg(F.count_distinct("source_ip_hash").alias("exact"))
    close = F.abs(F.col("unique_attackers") - F.col("exact")) <= F.greatest(F.lit(1), F.col("exact") * 0.06)
    return rollups.estimate(merged, ["unique_attackers"]).join(exact, ["date", "event_type"]).select(
        "date", "event_type", "event_count", close.alias("sketch_is_close"))


add("a7_merged_rollup", _merged_counts, q(
    f"SELECT {DAY} AS date, event_type, count(*) AS event_count, true AS sketch_is_close FROM honeypot_events GROUP BY 1, 2", HE))

# --- profiles

PROFILE_SQL = (
    f"SELECT source_ip_hash, {txt('min(timestamp)')} AS first_seen, {txt('max(timestamp)')} AS last_seen, "
    f"count(*) AS total_events, {SETS_SQL}, 0::BIGINT AS credential_attempts, 0::BIGINT AS successful_logins, "
    "0::BIGINT AS files_downloaded FROM honeypot_events WHERE {cond} GROUP BY source_ip_hash"
)
add("p1_build_profiles", lambda v: profiles.build_profiles(v.events(ago(30)), AS_OF, 30), q(
    PROFILE_SQL.format(cond=window(30)), HE))
add("p1_build_profiles_1d", lambda v: profiles.build_profiles(v.events(ago(1)), AS_OF, 1), q(
    PROFILE_SQL.format(cond=window(1)), HE))


def _old_profiles(v):
    """Profiles as they stood five days before."""
    return profiles.build_profiles(v.events(), ago(5), 1)


OLD = f"SELECT DISTINCT source_ip_hash FROM honeypot_events WHERE {window(1, as_of=ago(5))}"
add("p2_new_profiles", lambda v: profiles.new_profiles(v.events(ago(1)), _old_profiles(v), AS_OF, 1), q(
    PROFILE_SQL.format(cond=window(1) + f" AND source_ip_hash NOT IN ({OLD})"), HE))
BASE = f"base AS (SELECT DISTINCT source_ip_hash FROM honeypot_events WHERE {window(30)})"
add("p3_credential_counts", lambda v: profiles.set_credential_counts(
    profiles.build_profiles(v.events(ago(30)), AS_OF, 30), v.creds(), AS_OF, 1
).select("source_ip_hash", "credential_attempts", "successful_logins"), q(
    f"""SELECT b.source_ip_hash, coalesce(c.n, 0) AS credential_attempts, coalesce(c.s, 0) AS successful_logins
    FROM base b LEFT JOIN (SELECT source_ip_hash, count(*) AS n, count(*) FILTER (success) AS s FROM credentials
      WHERE source_ip_hash IN (SELECT source_ip_hash FROM credentials WHERE {window(1)}) GROUP BY 1) c
    USING (source_ip_hash)""", HE, CR, extra=BASE))
FILE_DAY = "2024-01-02 00:00:00"
add("p4_download_counts", lambda v: profiles.set_download_counts(
    profiles.build_profiles(v.events(ago(30)), AS_OF, 30), v.files(), FILE_DAY, 1
).select("source_ip_hash", "files_downloaded"), q(
    f"""SELECT b.source_ip_hash, coalesce(c.n, 0) AS files_downloaded
    FROM base b LEFT JOIN (SELECT source_ip_hash, count(*) AS n FROM downloaded_files
      WHERE timestamp <= TIMESTAMP '{FILE_DAY}' GROUP BY 1 HAVING max(timestamp) >= TIMESTAMP '2024-01-01') c
    USING (source_ip_hash)""", HE, DF, extra=BASE))


def _additive(v):
    base = profiles.build_profiles(v.events(ago(30)), AS_OF, 30)
    once = profiles.add_daily_counts(base, v.creds(), v.files(), FILE_DAY)
    # the second run of the same date must change nothing
    twice = profiles.add_daily_counts(once, v.creds(), v.files(), FILE_DAY)
    return twice.select("source_ip_hash", "credential_attempts", "successful_logins", "files_downloaded")


add("p5_additive_counts", _additive, q(
    f"""SELECT b.source_ip_hash, coalesce(c.n, 0) AS credential_attempts, coalesce(c.s, 0) AS successful_logins,
      coalesce(d.n, 0) AS files_downloaded FROM base b
    LEFT JOIN (SELECT source_ip_hash, count(*) AS n, count(*) FILTER (success) AS s FROM credentials
      WHERE {window(1, as_of=FILE_DAY)} GROUP BY 1) c USING (source_ip_hash)
    LEFT JOIN (SELECT source_ip_hash, count(*) AS n FROM downloaded_files WHERE {window(1, as_of=FILE_DAY)} GROUP BY 1) d
    USING (source_ip_hash)""", HE, CR, DF, extra=BASE))


def _full(v):
    base = profiles.build_profiles(v.events(ago(30)), AS_OF, 30)
    return profiles.set_download_counts(profiles.set_credential_counts(base, v.creds(), AS_OF, 30), v.files(), AS_OF, 30)


FULL = f"""prof AS (SELECT e.*, coalesce(c.n, 0) AS credential_attempts, coalesce(d.n, 0) AS files_downloaded FROM
   (SELECT source_ip_hash, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) AS total_events,
     count(DISTINCT dest_port) AS ports_count, count(DISTINCT protocol) AS protocols_count
     FROM honeypot_events WHERE {window(30)} GROUP BY 1) e
   LEFT JOIN (SELECT source_ip_hash, count(*) AS n FROM credentials GROUP BY 1) c USING (source_ip_hash)
   LEFT JOIN (SELECT source_ip_hash, count(*) AS n FROM downloaded_files GROUP BY 1) d USING (source_ip_hash))"""
add("p6_top_profiles", lambda v: profiles.top_profiles(_full(v), AS_OF), q(
    f"""SELECT source_ip_hash, total_events, ports_count, protocols_count, credential_attempts, files_downloaded
    FROM prof WHERE {window(1, col='last_seen')} ORDER BY total_events DESC, source_ip_hash LIMIT 10""", HE, CR, DF, extra=FULL))
ME = "substr(sha256('salt' || '1'), 1, 16)"


def _me():
    import hashlib

    return hashlib.sha256(b"salt1").hexdigest()[:16]


add("p7_dossier_profile", lambda v: profiles.dossier(_full(v), v.creds(), v.files(), _me())["profile"].select(
    "source_ip_hash", "first_seen", "last_seen", "total_events", "credential_attempts", "files_downloaded"), q(
    f"SELECT source_ip_hash, {txt('first_seen')} AS first_seen, {txt('last_seen')} AS last_seen, total_events, "
    f"credential_attempts, files_downloaded FROM prof WHERE source_ip_hash = {ME}", HE, CR, DF, extra=FULL))
add("p7_dossier_credentials", lambda v: profiles.dossier(_old_profiles(v), v.creds(), v.files(), _me())["credentials"], q(
    f"SELECT * REPLACE ({txt('timestamp')} AS timestamp) FROM credentials WHERE source_ip_hash = {ME}", CR))
add("p7_dossier_files", lambda v: profiles.dossier(_old_profiles(v), v.creds(), v.files(), _me())["files"], q(
    f"SELECT * REPLACE ({txt('timestamp')} AS timestamp) FROM downloaded_files WHERE source_ip_hash = {ME}", DF))
add("p8_profile_delta", lambda v: profiles.profile_delta(
    _old_profiles(v), profiles.refresh_profiles(v.events(), v.creds(), v.files(), _old_profiles(v), AS_OF)), q(
    f"""SELECT existing, total - existing AS added, total FROM (SELECT (SELECT count(*) FROM ({OLD})) AS existing,
    (SELECT count(DISTINCT source_ip_hash) FROM honeypot_events
     WHERE ({window(1)}) OR ({window(1, as_of=ago(5))})) AS total)""", HE))

# --- overview

add("q01_daily_overview", lambda v: a.daily_overview(v.events(ago(30)), AS_OF), q(
    f"""SELECT {DAY} AS date, count(*) AS total_attacks, {U} AS unique_attackers,
    count(DISTINCT dest_port) AS unique_ports_targeted, count(*) FILTER (honeypot_type = 'cowrie') AS ssh_attacks,
    count(*) FILTER (honeypot_type = 'dionaea') AS dionaea_attacks, count(*) FILTER (honeypot_type = 'conpot') AS ics_attacks
    FROM honeypot_events WHERE {window(30)} GROUP BY 1""", HE))
add("q02_top_ports", lambda v: a.top_ports(v.events(ago(7)), AS_OF), q(
    f"""SELECT dest_port, protocol, count(*) AS connection_count, {U} AS unique_attackers, protocol AS service_protocol
    FROM honeypot_events WHERE {window(7)} GROUP BY ALL ORDER BY connection_count DESC, dest_port, protocol LIMIT 20""", HE))


def _share_sql(cond: str, limit: int, count: str = "attack_count", attackers: bool = True) -> str:
    uniq = f", {U} AS unique_attackers" if attackers else ""
    return (
        f"SELECT source_ip_country, count(*) AS {count}{uniq}, "
        f"round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percentage FROM honeypot_events "
        f"WHERE {cond} AND source_ip_country <> '' GROUP BY 1 ORDER BY {count} DESC, source_ip_country LIMIT {limit}"
    )


add("q03_country_share", lambda v: a.country_share(v.events(ago(30)), AS_OF), q(_share_sql(window(30), 50), HE))
add("q03_country_share_24h", lambda v: a.country_share(v.events(ago(1)), AS_OF, 1, 10), q(_share_sql(window(1), 10), HE))
add("q04_technique_distribution", lambda v: a.technique_distribution(v.alerts(ago(30)), AS_OF), q(
    f"""SELECT mitre_tactic, mitre_technique_id, min(alert_signature) AS example_alert, count(*) AS occurrence_count,
    {U} AS unique_attackers FROM ids_alerts WHERE {window(30)} AND mitre_technique_id <> '' GROUP BY 1, 2
    ORDER BY 4 DESC, 1, 2 LIMIT 30""", IA))
add("q05_top_credentials", lambda v: a.top_credentials(v.creds(ago(30)), AS_OF), q(
    f"""SELECT username, password, count(*) AS attempt_count, {U} AS unique_sources,
    count(*) FILTER (success) AS successful_attempts,
    round(count(*) FILTER (success) * 100.0::DOUBLE / count(*), 2) AS success_rate
    FROM credentials WHERE {window(30)} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 100""", CR))
add("q06_targeted_usernames", lambda v: a.targeted_usernames(v.creds(ago(30)), AS_OF), q(
    f"""SELECT username, count(*) AS total_attempts, {U} AS unique_attackers,
    count(DISTINCT password) AS unique_passwords_tried, count(*) FILTER (success) AS successful_logins
    FROM credentials WHERE {window(30)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""", CR))
add("q07_password_strength", lambda v: a.password_strength(v.creds(ago(30)), AS_OF), q(
    f"""SELECT password, count(*) AS usage_count, {U} AS used_by_attackers, CAST(length(password) AS INTEGER) AS password_length,
    CASE WHEN password IN ('123456', 'password', 'admin', '12345678', 'root') THEN 'Very Common'
         WHEN length(password) < 6 THEN 'Too Short'
         WHEN password = lower(password) AND regexp_full_match(password, '[a-z]+') THEN 'All Lowercase'
         ELSE 'Other' END AS weakness_category
    FROM credentials WHERE {window(30)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""", CR))
add("q08_ics_protocols", lambda v: a.ics_protocols(v.events(ago(30)), AS_OF), q(
    f"""SELECT protocol, event_type, count(*) AS attack_count, {U} AS unique_attackers, min(command) AS example_command
    FROM honeypot_events WHERE {window(30)} AND honeypot_type = 'conpot' GROUP BY 1, 2""", HE))


def _campaign_sql(min_days: int) -> str:
    return f"""SELECT source_ip_hash, {txt('min(timestamp)')} AS campaign_start, {txt('max(timestamp)')} AS campaign_end,
    CAST(count(DISTINCT CAST(timestamp AS DATE)) AS INTEGER) AS active_days, count(*) AS total_events,
    {lst('dest_port')} AS targeted_ports, {lst('event_type')} AS attack_types,
    CAST(count(DISTINCT honeypot_type) AS INTEGER) AS honeypots_attacked
    FROM honeypot_events WHERE {window(30)} GROUP BY 1 HAVING active_days >= {min_days} AND honeypots_attacked >= 2
    ORDER BY total_events DESC, source_ip_hash LIMIT 50"""


add("q09_campaigns", lambda v: a.campaigns(v.events(ago(30)), AS_OF), q(_campaign_sql(3), HE))
add("q09_campaigns_27_days", lambda v: a.campaigns(v.events(ago(30)), AS_OF, min_days=27), q(_campaign_sql(27), HE))
add("q10_malware", lambda v: a.malware(v.files(), AS_OF), q(
    f"""SELECT md5_hash, sha256_hash, min(filename) AS filename, min(mime_type) AS mime_type, count(*) AS download_count,
    {U} AS unique_downloaders, {txt('min(timestamp)')} AS first_seen, {txt('max(timestamp)')} AS last_seen
    FROM downloaded_files WHERE {window(30)} GROUP BY 1, 2 ORDER BY 5 DESC, 1, 2 LIMIT 50""", DF))
add("q11_noisy_signatures", lambda v: a.noisy_signatures(v.alerts(ago(7)), AS_OF), q(
    f"""SELECT signature_id, min(alert_signature) AS signature, min(alert_category) AS category, count(*) AS alert_count,
    {U} AS unique_sources, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percentage
    FROM ids_alerts WHERE {window(7)} GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 50""", IA))


def _correlate_sql(seconds: int, days: int, limit: int | None) -> str:
    tail = f" ORDER BY h.timestamp DESC, h.source_ip_hash, h.event_id, i.timestamp, i.alert_id LIMIT {limit}" if limit else ""
    return f"""SELECT {txt('h.timestamp')} AS honeypot_time, {txt('i.timestamp')} AS ids_time, h.source_ip_hash,
    h.honeypot_type, h.dest_port, h.event_type, i.alert_signature, i.mitre_technique_id
    FROM honeypot_events h JOIN ids_alerts i ON h.source_ip_hash = i.source_ip_hash
     AND abs(epoch(h.timestamp) - epoch(i.timestamp)) <= {seconds}
    WHERE {window(days, col='h.timestamp')}{tail}"""


add("q12_correlate", lambda v: intervals.correlate(v.events(ago(1)), v.alerts(), AS_OF), q(_correlate_sql(10, 1, 100), HE, IA))
add("q12_correlate_1h", lambda v: intervals.correlate(v.events(ago(7)), v.alerts(), AS_OF, 3600, 7, 100), q(
    _correlate_sql(3600, 7, 100), HE, IA))
add("q12_correlate_all_pairs", lambda v: intervals.correlate(v.events(ago(30)), v.alerts(), AS_OF, 3600, 30, None), q(
    _correlate_sql(3600, 30, None), HE, IA))

# --- lateral movement

LAT = "dest_ip LIKE '172.20.0.%'"
LATERAL_COLS = (f"{txt('timestamp')} AS timestamp, source_ip_hash, dest_ip, dest_port, protocol, event_type, "
                "'Potential Lateral Movement' AS alert_type")
add("q13_lateral_events", lambda v: a.lateral_events(v.events(ago(7)), AS_OF), q(
    f"SELECT {LATERAL_COLS} FROM (SELECT * FROM honeypot_events WHERE {window(7)} AND {LAT} "
    "ORDER BY timestamp DESC, event_id LIMIT 100)", HE))
add("q13_lateral_events_24h", lambda v: a.lateral_events(v.events(ago(1)), AS_OF, days=1, n=None), q(
    f"SELECT {LATERAL_COLS} FROM honeypot_events WHERE {window(1)} AND {LAT}", HE))
add("q13_lateral_count", lambda v: a.lateral_count(v.events(ago(7)), AS_OF), q(
    f"SELECT count(*) AS lateral_events FROM honeypot_events WHERE {window(7)} AND {LAT}", HE))
add("q13_lateral_latest", lambda v: a.lateral_latest(v.events(ago(7)), AS_OF), q(
    f"SELECT {txt('timestamp')} AS timestamp, honeypot_type, source_ip_hash, dest_ip, dest_port FROM (SELECT * FROM "
    f"honeypot_events WHERE {window(7)} AND {LAT} ORDER BY timestamp DESC, event_id LIMIT 5)", HE))
RAW_IP = "'172.20.' || (user_id % 3) || '.' || (user_id % 250)"
add("q13b_lateral_from_inside", lambda v: a.lateral_from_inside(v.raw("events").selectExpr(
    "date_trunc('second', CAST(ts AS TIMESTAMP)) AS timestamp", "event_id",
    "concat('172.20.', user_id % 3, '.', user_id % 250) AS src_ip",
    "substring(sha2(concat('salt', user_id), 256), 1, 16) AS source_ip_hash", "'10.0.0.1' AS dest_ip", "22 AS dest_port",
    "'ssh' AS protocol", "event_type"), AS_OF, n=None), q(
    f"SELECT {txt('timestamp')} AS timestamp, source_ip_hash, '10.0.0.1' AS dest_ip, 22 AS dest_port, 'ssh' AS protocol, "
    f"event_type, 'Potential Lateral Movement' AS alert_type FROM (SELECT date_trunc('second', ts) AS timestamp, event_type, "
    f"substr(sha256('salt' || user_id), 1, 16) AS source_ip_hash FROM events WHERE {RAW_IP} LIKE '172.20.0.%') WHERE {window(7)}"))
add("q14_lateral_alerts", lambda v: a.lateral_alerts(v.alerts(ago(7)), AS_OF), q(
    f"SELECT {txt('timestamp')} AS timestamp, alert_signature, source_ip_hash, dest_ip, dest_port, payload "
    f"FROM ids_alerts WHERE {window(7)} AND signature_id = 2000035", IA))
add("q14_lateral_alerts_wide", lambda v: a.lateral_alerts_wide(v.alerts()), q(
    f"SELECT {txt('timestamp')} AS timestamp, alert_signature, source_ip_hash, dest_ip, dest_port, mitre_technique_id, "
    "mitre_tactic FROM ids_alerts WHERE alert_signature LIKE '%LATERAL%' OR signature_id = 2000035 "
    "OR mitre_tactic IN ('lateral-movement', 'Lateral Movement')", IA))
add("q15_traffic_matrix", lambda v: a.traffic_matrix(v.events()), q(
    f"SELECT source_ip_hash, dest_ip, count(*) AS events FROM honeypot_events WHERE {LAT} GROUP BY 1, 2", HE))
add("q15_lateral_timeline", lambda v: a.lateral_timeline(v.events()), q(
    f"SELECT CAST(date_trunc('hour', timestamp) AS VARCHAR) AS bucket, honeypot_type, count(*) AS events "
    f"FROM honeypot_events WHERE {LAT} GROUP BY 1, 2", HE))

# --- quality and status


def _pct(num: str, den: str) -> str:
    return f"round({num} * 100.0::DOUBLE / {den}, 2)"


add("q16_missing_country", lambda v: a.missing_country(v.events(ago(1)), v.alerts(ago(1)), AS_OF), q(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) FILTER (source_ip_country = '') AS missing_country, count(*) AS total_records, "
    f"{_pct('missing_country', 'total_records')} AS missing_percentage FROM {t} WHERE {window(1)}" for t in (HE, IA)), HE, IA))
add("q16_country_coverage", lambda v: a.country_coverage(v.events(ago(1)), v.alerts(ago(1)), AS_OF), q(" UNION ALL ".join(
    f"SELECT '{name}' AS source, count(*) FILTER (source_ip_country <> '') AS with_country, count(*) AS total, "
    f"{_pct('with_country', 'total')} AS coverage_percent FROM {t} WHERE {window(1)}"
    for t, name in ((HE, "Honeypot Events"), (IA, "IDS Alerts"))), HE, IA))
add("q17_missing_technique", lambda v: a.missing_technique(v.alerts(ago(1)), AS_OF), q(
    f"SELECT count(*) FILTER (mitre_technique_id = '') AS without_mitre, count(*) AS total_alerts, "
    f"{_pct('without_mitre', 'total_alerts')} AS missing_percentage FROM ids_alerts WHERE {window(1)}", IA))
add("q17_technique_coverage", lambda v: a.technique_coverage(v.alerts(ago(1)), AS_OF), q(
    f"SELECT count(*) FILTER (mitre_technique_id <> '') AS with_mitre, count(*) AS total_alerts, "
    f"{_pct('with_mitre', 'total_alerts')} AS coverage_percent FROM ids_alerts WHERE {window(1)}", IA))
add("q18_table_counts", lambda v: a.table_counts(v.events(ago(1)), v.alerts(ago(1)), v.conns(ago(1)), AS_OF), q(" UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS total_events, {U} AS unique_attackers FROM {t} WHERE {window(1)}"
    for t, name in ((HE, "Honeypot Events"), (IA, "IDS Alerts"), (NC, "Network Connections"))), HE, IA, NC))
add("q19_sensor_breakdown", lambda v: a.sensor_breakdown(v.events(ago(1)), AS_OF), q(
    f"SELECT honeypot_type, count(*) AS events, {U} AS unique_attackers, count(DISTINCT dest_port) AS unique_ports "
    f"FROM honeypot_events WHERE {window(1)} GROUP BY 1", HE))


def _techniques_sql(hours: int, limit: int | None, attackers: bool) -> str:
    uniq = f", {U} AS unique_attackers" if attackers else ""
    tail = f" ORDER BY detections DESC, mitre_tactic, mitre_technique_id LIMIT {limit}" if limit else ""
    return (f"SELECT mitre_tactic, mitre_technique_id, count(*) AS detections{uniq} FROM ids_alerts "
            f"WHERE {window(hours=hours)} AND mitre_technique_id <> '' GROUP BY 1, 2{tail}")


add("q20_top_techniques", lambda v: a.top_techniques(v.alerts(ago(1)), AS_OF), q(_techniques_sql(24, 10, False), IA))
add("q20_top_techniques_7d", lambda v: a.top_techniques(v.alerts(ago(7)), AS_OF, 168, 10), q(_techniques_sql(168, 10, False), IA))
add("q20_all_techniques_30d", lambda v: a.top_techniques(v.alerts(ago(30)), AS_OF, 720, None, True), q(_techniques_sql(720, None, True), IA))
add("q21_top_attackers", lambda v: a.top_attackers(v.events(ago(1)), AS_OF), q(
    f"""SELECT source_ip_hash, source_ip_country, count(*) AS total_events, {lst('dest_port')} AS ports_targeted,
    {txt('min(timestamp)')} AS first_seen, {txt('max(timestamp)')} AS last_seen FROM honeypot_events WHERE {window(1)}
    GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10""", HE))

REPORT_DAY = "2024-01-01"
TODAY = f"CAST(timestamp AS DATE) = DATE '{REPORT_DAY}'"
REPORT = {
    "total": ("SELECT count(*) AS count FROM honeypot_events WHERE {t}", HE),
    "by_sensor": ("SELECT honeypot_type, count(*) AS count FROM honeypot_events WHERE {t} GROUP BY 1", HE),
    "top_sources": ("SELECT source_ip_hash, count(*) AS count FROM honeypot_events WHERE {t} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", HE),
    "top_ports": ("SELECT dest_port, count(*) AS count FROM honeypot_events WHERE {t} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", HE),
    "top_credentials": ("SELECT username, password, count(*) AS count FROM credentials WHERE {t} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10", CR),
    "by_severity": ("SELECT alert_severity, count(*) AS count FROM ids_alerts WHERE {t} GROUP BY 1", IA),
    "files": ("SELECT count(*) AS count, coalesce(sum(file_size), 0)::BIGINT AS total_bytes FROM downloaded_files WHERE {t}", DF),
}
for _name, (_sql, _table) in REPORT.items():
    add(f"q22_report_{_name}", lambda v, name=_name: a.daily_report(
        v.events(), v.creds(), v.alerts(), v.files(), REPORT_DAY)[name], q(_sql.format(t=TODAY), _table))

# --- dashboard

LO, HI = "2024-01-05 00:00:00", "2024-01-25 00:00:00"
SPAN = f"timestamp BETWEEN TIMESTAMP '{LO}' AND TIMESTAMP '{HI}'"
add("q23_dashboard_numbers", lambda v: a.dashboard_numbers(
    v.events(LO).withColumn("event_type", F.when(F.col("event_type") == "purchase", "login_success")
                            .when(F.col("event_type") == "signup", "login_failed").otherwise(F.col("event_type"))),
    v.alerts(LO), LO, HI), q(
    f"SELECT 'Total Events' AS panel, count(*) AS value FROM honeypot_events WHERE {SPAN} UNION ALL "
    f"SELECT 'Unique Attackers', {U} FROM honeypot_events WHERE {SPAN} UNION ALL "
    f"SELECT 'Brute Force Attempts', count(*) FILTER (event_type IN ('purchase', 'signup')) FROM honeypot_events WHERE {SPAN} "
    f"UNION ALL SELECT 'IDS Alerts', count(*) FROM ids_alerts WHERE {SPAN}", HE, IA))
add("q24_timeline", lambda v: a.timeline(v.events(LO), LO, HI), q(
    f"SELECT CAST(time_bucket(INTERVAL 5 minute, timestamp) AS VARCHAR) AS t, count(*) AS events "
    f"FROM honeypot_events WHERE {SPAN} GROUP BY 1", HE))
add("q25_panel_countries", lambda v: a.panel_countries(v.events(LO), LO, HI), q(
    f"SELECT source_ip_country, count(*) AS attacks FROM honeypot_events WHERE {SPAN} AND source_ip_country NOT IN ('XX', '') "
    "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", HE))
add("q25_panel_tactics", lambda v: a.panel_tactics(v.alerts(LO), LO, HI), q(
    f"SELECT mitre_tactic, count(*) AS count FROM ids_alerts WHERE {SPAN} AND mitre_tactic <> '' GROUP BY 1", IA))
add("q25_panel_usernames", lambda v: a.panel_usernames(v.creds(LO), LO, HI), q(
    f"SELECT username, count(*) AS attempts FROM credentials WHERE {SPAN} AND NOT success AND username <> '' "
    "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", CR))
add("q25_panel_ports", lambda v: a.panel_ports(v.events(LO), LO, HI), q(
    f"SELECT dest_port, count(*) AS hits FROM honeypot_events WHERE {SPAN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", HE))
add("q25_panel_techniques", lambda v: a.panel_techniques(v.alerts(LO), LO, HI), q(
    f"SELECT mitre_technique_id, mitre_tactic, count(*) AS occurrences FROM ids_alerts WHERE {SPAN} "
    "AND mitre_technique_id <> '' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20", IA))
add("q26_by_protocol", lambda v: a.by_protocol(v.events(ago(1)), AS_OF), q(
    f"SELECT protocol, count(*) AS cnt FROM honeypot_events WHERE {window(1)} GROUP BY 1", HE))
for _days in (7, 30):
    add(f"q26_top_countries_{_days}d", lambda v, d=_days: a.top_countries(v.events(ago(d)), AS_OF, d), q(
        f"SELECT source_ip_country, count(*) AS attacks FROM honeypot_events WHERE {window(_days)} "
        "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", HE))

# --- lists

EXPLOIT = """CASE WHEN regexp_matches(uri, '\\(\\)\\s*\\{') THEN 'shellshock'
    WHEN contains(uri, '../') OR contains(uri, '..\\') THEN 'path_traversal'
    WHEN regexp_matches(lower(uri), 'union|select|insert|update|delete') THEN 'sqli' ELSE '' END"""
add("q27_exploits", lambda v: a.exploits(v.requests(), AS_OF, 30), q(
    f"SELECT {txt('timestamp')} AS timestamp, source_ip_hash, 'http' AS protocol, {EXPLOIT} AS exploit_type, uri AS url, "
    f"user_agent FROM http_requests WHERE {window(30)} AND {EXPLOIT} <> ''", HR))
add("q28_frequent_alerts", lambda v: a.frequent_alerts(v.alerts(ago(7)), AS_OF), q(
    f"SELECT alert_signature AS signature, signature_id, count(*) AS cnt FROM ids_alerts WHERE {window(7)} "
    "GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20", IA))
add("q28_severe_alerts", lambda v: a.severe_alerts(v.alerts(ago(1)), AS_OF, 24), q(
    f"SELECT {txt('timestamp')} AS timestamp, alert_signature AS signature, source_ip_country, dest_port FROM ids_alerts "
    f"WHERE {window(1)} AND alert_severity = 1", IA))
add("q28_noisy_sids", lambda v: a.noisy_sids(v.alerts(ago(7)), AS_OF), q(
    f"SELECT signature_id, count(*) AS cnt FROM ids_alerts WHERE {window(7)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", IA))
add("q29_services", lambda v: a.services(v.conns(ago(1)), AS_OF), q(
    f"SELECT service, count(*) AS conn_count FROM network_connections WHERE {window(1)} GROUP BY 1", NC))
add("q29_failed_connections", lambda v: a.failed_connections(v.conns(ago(1)), AS_OF, 24), q(
    f"SELECT {txt('timestamp')} AS timestamp, source_ip_hash, dest_port, conn_state FROM (SELECT * FROM network_connections "
    f"WHERE {window(1)} AND conn_state IN ('REJ', 'S0', 'RSTO') ORDER BY timestamp DESC, uid LIMIT 100)", NC))
add("q30_top_uris", lambda v: a.top_uris(v.requests(), AS_OF, 30), q(
    f"SELECT uri, count(*) AS requests FROM http_requests WHERE {window(30)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", HR))
add("q30_suspicious_agents", lambda v: a.suspicious_agents(v.requests(), AS_OF, 30), q(
    f"SELECT {txt('timestamp')} AS timestamp, user_agent, uri, source_ip_country FROM http_requests WHERE {window(30)} "
    "AND (user_agent LIKE '%() { :; }%' OR user_agent LIKE '%${jndi:%' OR user_agent LIKE '%sqlmap%')", HR))
add("q31_pair_counts", lambda v: a.pair_counts(v.creds(ago(7)), AS_OF), q(
    f"SELECT username, password, count(*) AS attempts FROM credentials WHERE {window(7)} GROUP BY 1, 2 "
    "ORDER BY 3 DESC, 1, 2 LIMIT 20", CR))
add("q31_successful_logins", lambda v: a.successful_logins(v.creds(ago(1)), AS_OF), q(
    f"SELECT {txt('timestamp')} AS timestamp, source_ip_hash, username, password, protocol FROM credentials "
    f"WHERE {window(1)} AND success", CR))
add("q31_credential_diversity", lambda v: a.credential_diversity(v.creds(ago(30)), AS_OF, 30, 10), q(
    f"SELECT source_ip_hash, count(DISTINCT username) AS unique_usernames, count(DISTINCT password) AS unique_passwords, "
    f"count(*) AS total_attempts FROM credentials WHERE {window(30)} GROUP BY 1 HAVING count(*) > 10", CR))
add("q32_top_files", lambda v: a.top_files(v.files(), AS_OF), q(
    f"SELECT sha256_hash AS file_hash, filename, count(*) AS download_count, {U} AS unique_sources FROM downloaded_files "
    f"WHERE {window(30)} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10", DF))
add("q32_recent_downloads", lambda v: a.recent_downloads(v.files(), "2024-01-01 12:00:00"), q(
    f"SELECT {txt('timestamp')} AS timestamp, filename, sha256_hash AS file_hash, source_ip_hash, download_url "
    f"FROM downloaded_files WHERE {window(1, as_of='2024-01-01 12:00:00')}", DF))

# --- rates

add("q33_two_day_summary", lambda v: a.two_day_summary(v.events(ago(2)), AS_OF), q(
    f"SELECT {DAY} AS date, count(*) AS events, {U} AS unique_attackers FROM honeypot_events WHERE {window(2)} GROUP BY 1", HE))
for _step in ("hour", "minute"):
    add(f"q33_rate_per_{_step}", lambda v, s=_step: a.event_rate(v.events(ago(1)), AS_OF, s), q(
        f"SELECT CAST(date_trunc('{_step}', timestamp) AS VARCHAR) AS bucket, count(*) AS events FROM honeypot_events "
        f"WHERE {window(1)} GROUP BY 1", HE))
add("q33_events_per_second", lambda v: a.events_per_second(v.events(ago(1)), AS_OF, 1440), q(
    f"SELECT round(count(*) / 86400.0::DOUBLE, 4) AS events_per_second FROM honeypot_events WHERE {window(1)}", HE))
add("q33_last_hour", lambda v: a.last_hour_count(v.events(ago(0, 1)), AS_OF), q(
    f"SELECT count(*) AS events FROM honeypot_events WHERE {window(hours=1)}", HE))
add("q34_high_rate", lambda v: a.high_rate(v.events(ago(1)), AS_OF, 100, 1440), q(
    f"SELECT count(*) AS events_per_minute FROM honeypot_events WHERE {window(1)} HAVING count(*) > 100", HE))
ICS = "honeypot_type = 'conpot'"
add("q35_ics_attackers", lambda v: a.ics_attackers(v.events(ago(1)), AS_OF), q(
    f"SELECT source_ip_hash, source_ip_country, count(*) AS event_count FROM honeypot_events WHERE {window(1)} AND {ICS} "
    "GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10", HE))
add("q35_ics_by_protocol", lambda v: a.ics_by_protocol(v.events(ago(7)), AS_OF), q(
    f"SELECT protocol, count(*) AS count FROM honeypot_events WHERE {window(7)} AND {ICS} GROUP BY 1", HE))
add("q35_ics_hourly", lambda v: a.ics_hourly(v.events(ago(1)), AS_OF), q(
    f"SELECT CAST(date_trunc('hour', timestamp) AS VARCHAR) AS hour, count(*) AS events FROM honeypot_events "
    f"WHERE {window(1)} AND {ICS} GROUP BY 1", HE))

# --- cameras and routers

RT = "honeypot_type = 'rtsp'"
add("q36_rtsp_latest", lambda v: a.rtsp_latest(v.events()), q(
    f"SELECT {txt('timestamp')} AS timestamp, event_type, source_ip_hash, dest_port FROM (SELECT * FROM honeypot_events "
    f"WHERE {RT} ORDER BY timestamp DESC, event_id LIMIT 10)", HE))
add("q36_rtsp_attacks_latest", lambda v: a.rtsp_attacks_latest(v.rtsp_attacks()), q(
    f"SELECT {txt('timestamp')} AS timestamp, attack_type, rtsp_method, source_ip_country FROM (SELECT * FROM rtsp_attacks "
    "ORDER BY timestamp DESC, attack_id LIMIT 10)", "rtsp_attacks"))
add("q36_rtsp_hourly", lambda v: a.rtsp_hourly(v.events()), q(
    f"SELECT CAST(date_trunc('hour', timestamp) AS VARCHAR) AS time, count(*) AS events FROM honeypot_events WHERE {RT} GROUP BY 1", HE))
add("q36_rtsp_hourly_by_type", lambda v: a.rtsp_hourly(v.events(), True), q(
    f"SELECT CAST(date_trunc('hour', timestamp) AS VARCHAR) AS time, event_type, count(*) AS events FROM honeypot_events "
    f"WHERE {RT} GROUP BY 1, 2", HE))
CVE = "attack_type LIKE '%CVE-2014-8361%'"
add("q36_rtsp_cve_daily", lambda v: a.rtsp_cve_daily(v.rtsp_attacks()), q(
    f"SELECT {DAY} AS date, count(*) AS attacks FROM rtsp_attacks WHERE {CVE} GROUP BY 1", "rtsp_attacks"))
add("q36_rtsp_cve_countries", lambda v: a.rtsp_cve_countries(v.rtsp_attacks()), q(
    f"SELECT source_ip_country, count(*) AS attacks FROM rtsp_attacks WHERE {CVE} GROUP BY 1", "rtsp_attacks"))
add("q36_rtsp_countries", lambda v: a.rtsp_countries(v.rtsp_attacks()), q(
    "SELECT source_ip_country, count(*) AS attacks FROM rtsp_attacks WHERE source_ip_country <> '' GROUP BY 1 "
    "ORDER BY 2 DESC, 1 LIMIT 10", "rtsp_attacks"))
add("q36_rtsp_attackers", lambda v: a.rtsp_attackers(v.rtsp_attacks()), q(
    f"SELECT source_ip_hash, source_ip_country, count(*) AS total_attacks, count(*) FILTER ({CVE}) AS cve_attacks "
    "FROM rtsp_attacks GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10", "rtsp_attacks"))
add("q37_upnp_attacks", lambda v: a.upnp_attacks_latest(v.upnp_attacks()), q(
    f"SELECT * REPLACE ({txt('timestamp')} AS timestamp) FROM upnp_attacks", "upnp_attacks"))

# --- verification

MIN = 60 * 24 * 30
ALERT_COLS = ["timestamp", "alert_id", "signature_id", "source_ip_hash"]
ALERT_SQL = f"SELECT {txt('timestamp')} AS timestamp, alert_id, signature_id, source_ip_hash FROM ids_alerts WHERE {window(30)}"
add("q38_verify_sids", lambda v: a.verify(v.alerts(ago(30)), a.sid_in(2000005, 2000002), AS_OF, MIN).select(*ALERT_COLS), q(
    f"{ALERT_SQL} AND signature_id IN (2000005, 2000002)", IA))
add("q38_verify_sid_range", lambda v: a.verify(v.alerts(ago(30)), a.sid_between(2000015, 2000025), AS_OF, MIN, True), q(
    f"SELECT count(*) AS matches FROM ids_alerts WHERE {window(30)} AND signature_id BETWEEN 2000015 AND 2000025", IA))
add("q38_verify_ics_sids", lambda v: a.verify(v.alerts(ago(30)), a.sid_in(*a.ICS_SIDS), AS_OF, MIN).select(*ALERT_COLS), q(
    f"{ALERT_SQL} AND signature_id IN (2000018, 2000019, 2000020, 2000021, 2000037, 2000038)", IA))
add("q38_verify_technique", lambda v: a.verify(
    v.alerts(ago(30)), F.col("mitre_technique_id") == "T1110.001", AS_OF, MIN, True), q(
    f"SELECT count(*) AS matches FROM ids_alerts WHERE {window(30)} AND mitre_technique_id = 'T1110.001'", IA))
add("q38_verify_uri", lambda v: a.verify(v.requests(), F.col("uri").like("%cgi-bin%"), AS_OF, MIN).select("timestamp", "uri"), q(
    f"SELECT {txt('timestamp')} AS timestamp, uri FROM http_requests WHERE {window(30)} AND uri LIKE '%cgi-bin%'", HR))
add("q39_connections_to_sensor", lambda v: a.to_sensor(v.conns(ago(1)), "172.20.0.10", AS_OF, 1440, ["uid"]), q(
    f"SELECT {txt('timestamp')} AS timestamp, dest_ip, dest_port, protocol, conn_state FROM network_connections "
    f"WHERE {window(1)} AND dest_ip = '172.20.0.10'", NC))
add("q39_requests_to_sensor", lambda v: a.to_sensor(v.requests(), "172.20.0.11", AS_OF, MIN, ["uri"]), q(
    f"SELECT {txt('timestamp')} AS timestamp, dest_ip, dest_port, method, uri, user_agent FROM http_requests "
    f"WHERE {window(30)} AND dest_ip = '172.20.0.11'", HR))
add("q40_false_positive_candidates", lambda v: a.false_positive_candidates(
    v.alerts(LO), v.test_sources(), LO, HI, 20), q(
    f"SELECT signature_id, alert_signature AS signature, count(*) AS alert_count, {U} AS unique_sources FROM ids_alerts "
    f"WHERE {SPAN} AND source_ip_hash NOT IN (SELECT ip_hash FROM test_sources) GROUP BY 1, 2 HAVING count(*) > 20",
    IA, "test_sources"))
# a time is five characters longer in Spark's JSON (T, milliseconds, Z)
add("q41_data_volume", lambda v: a.data_volume(v.events(ago(7)), AS_OF), q(
    f"SELECT {DAY} AS date, round(sum(length(to_json(e)::VARCHAR) + 5) / 1048576.0, 4) AS data_mb FROM honeypot_events e WHERE {window(7)} GROUP BY 1", HE))
STAGE = """CASE WHEN sid = 1000025 THEN 'Reconnaissance' WHEN sid IN (2000005, 2000002) THEN 'Delivery'
    WHEN sid = 2000027 THEN 'Installation' WHEN sid = 2000035 THEN 'Actions on Objectives'
    WHEN t LIKE 'T1046%' OR t LIKE 'T1595%' THEN 'Reconnaissance' WHEN t LIKE 'T1110%' THEN 'Delivery'
    WHEN t LIKE 'T1190%' OR t LIKE 'T1059%' THEN 'Exploitation' WHEN t LIKE 'T1105%' THEN 'Installation'
    WHEN t LIKE 'T1071%' THEN 'C2' WHEN t LIKE 'T1570%' THEN 'Actions on Objectives' ELSE '' END"""
STAGED = f"""staged AS (SELECT * FROM (
  SELECT timestamp, source_ip_hash, CASE event_type WHEN 'view' THEN 'Reconnaissance' WHEN 'signup' THEN 'Delivery'
    WHEN 'purchase' THEN 'Delivery' WHEN 'click' THEN 'Exploitation' ELSE '' END AS stage FROM honeypot_events
  UNION ALL
  SELECT timestamp, source_ip_hash, {STAGE} AS stage FROM
    (SELECT timestamp, source_ip_hash, signature_id AS sid, mitre_technique_id AS t FROM ids_alerts)) WHERE stage <> '')"""
DRIVER_STAGES = {"view": "Reconnaissance", "signup": "Delivery", "purchase": "Delivery", "click": "Exploitation"}
add("q42_stage_timeline", lambda v: a.stage_timeline(a.staged(v.events(), v.alerts(), DRIVER_STAGES)), q(
    "SELECT CAST(date_trunc('hour', timestamp) AS VARCHAR) AS bucket, stage, count(*) AS events FROM staged GROUP BY 1, 2",
    HE, IA, extra=STAGED))
add("q42_stage_paths", lambda v: a.stage_paths(a.staged(v.events(), v.alerts(), DRIVER_STAGES)), q(
    "SELECT source_ip_hash, string_agg(stage, '|' ORDER BY f, stage) AS stages FROM (SELECT source_ip_hash, stage, "
    "min(timestamp) AS f FROM staged GROUP BY 1, 2) GROUP BY 1", HE, IA, extra=STAGED))


def _heat(v):
    return a.heat_map(v.alerts(), ["Credential Access", "Initial Access"])


add("q43_heat_map", _heat, q("SELECT mitre_technique_id, " + ", ".join(
    f"count(*) FILTER (mitre_tactic = '{t}') AS \"{t}\"" for t in ("Credential Access", "Initial Access")) +
    ", count(*) FILTER (mitre_tactic NOT IN ('Credential Access', 'Initial Access')) AS other"
    " FROM ids_alerts WHERE mitre_technique_id <> '' GROUP BY 1", IA))
add("q44_country_flows", lambda v: a.country_flows(v.events()), q(
    "SELECT source_ip_country, dest_port, protocol, count(*) AS events FROM honeypot_events GROUP BY 1, 2, 3", HE))
add("q45_duplicates", lambda v: a.duplicates(v.events(), ["source_ip_hash", "honeypot_type", "dest_port", "event_type"]), q(
    "SELECT source_ip_hash, honeypot_type, dest_port, event_type, count(*) AS copies FROM honeypot_events "
    "GROUP BY 1, 2, 3, 4 HAVING count(*) > 1", HE))
NEAR = ("ids_alerts a JOIN network_connections c ON a.source_ip_hash = c.source_ip_hash "
        "AND abs(epoch(a.timestamp) - epoch(c.timestamp)) <= 300")
add("q46_alert_context", lambda v: intervals.alert_context(v.alerts(), v.conns()), q(
    f"SELECT alert_id, uid, {txt('c.timestamp')} AS timestamp, c.dest_ip, c.dest_port FROM {NEAR}", IA, NC))
add("q46_context_windows", lambda v: intervals.context_windows(v.alerts(), v.conns()), q(
    f"SELECT DISTINCT c.source_ip_hash, uid, {txt('c.timestamp')} AS timestamp, c.dest_ip, c.dest_port FROM {NEAR}", IA, NC))
