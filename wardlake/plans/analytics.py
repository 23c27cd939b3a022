"""Dashboard, report and investigation queries.

Each takes canonical tables and ``as_of`` (in place of "now") and returns a lazy
DataFrame. Ties in every ordering are broken by the group keys, so results are
reproducible. "Any value of a group" is its smallest.

Shares of a total use a window over the *grouped* rows: one row per country or
signature reaches that step, never an event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, lists
from ..functions.timing import between, on_day, since

SRC = "source_ip_hash"


def n_rows() -> Column:
    return F.count(F.lit(1))


def uniq(col: str, approx: bool = False) -> Column:
    """Distinct count; exact unless a sketch is asked for."""
    return F.approx_count_distinct(col) if approx else F.count_distinct(F.col(col))


def share(part: Column | str, whole: Column | str) -> Column:
    """Percentage with two digits."""
    p = F.col(part) if isinstance(part, str) else part
    w = F.col(whole) if isinstance(whole, str) else whole
    return F.round(p * F.lit(100.0) / w, 2)


def share_of_all(col: str) -> Column:
    return share(F.col(col), F.sum(col).over(Window.partitionBy()))


def top(df: DataFrame, by: str, ties: list, n: int | None) -> DataFrame:
    out = df.orderBy(F.desc(by), *ties)
    return out if n is None else out.limit(n)


def newest(df: DataFrame, ties: list, n: int | None, cols: list) -> DataFrame:
    out = df.orderBy(F.desc("timestamp"), *ties)
    return (out if n is None else out.limit(n)).select(*cols)


def stack(parts: list) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- overview


def daily_overview(events, as_of, days=30):
    def of(kind):
        return F.count_if(F.col("honeypot_type") == kind)

    return (
        since(events, as_of, days=days)
        .groupBy(F.to_date("timestamp").alias("date"))
        .agg(
            n_rows().alias("total_attacks"),
            uniq(SRC).alias("unique_attackers"),
            uniq("dest_port").alias("unique_ports_targeted"),
            of("cowrie").alias("ssh_attacks"),
            of("dionaea").alias("dionaea_attacks"),
            of("conpot").alias("ics_attacks"),
        )
        .orderBy(F.desc("date"))
    )


def top_ports(events, as_of, days=7, n=20):
    grouped = (
        since(events, as_of, days=days)
        .groupBy("dest_port", "protocol")
        .agg(n_rows().alias("connection_count"), uniq(SRC).alias("unique_attackers"))
        .withColumn("service_protocol", F.col("protocol"))
    )
    return top(grouped, "connection_count", ["dest_port", "protocol"], n)


def country_share(events, as_of, days=30, n=50):
    """Countries by events; the percentage is of all placed events, not of the top n."""
    grouped = (
        since(events, as_of, days=days)
        .filter(F.col("source_ip_country") != "")
        .groupBy("source_ip_country")
        .agg(n_rows().alias("attack_count"), uniq(SRC).alias("unique_attackers"))
        .withColumn("percentage", share_of_all("attack_count"))
    )
    return top(grouped, "attack_count", ["source_ip_country"], n)


def technique_distribution(alerts, as_of, days=30, n=30):
    grouped = (
        since(alerts, as_of, days=days)
        .filter(F.col("mitre_technique_id") != "")
        .groupBy("mitre_tactic", "mitre_technique_id")
        .agg(
            F.min("alert_signature").alias("example_alert"),
            n_rows().alias("occurrence_count"),
            uniq(SRC).alias("unique_attackers"),
        )
    )
    return top(grouped, "occurrence_count", ["mitre_tactic", "mitre_technique_id"], n)


# --- credentials


def top_credentials(creds, as_of, days=30, n=100):
    grouped = (
        since(creds, as_of, days=days)
        .groupBy("username", "password")
        .agg(
            n_rows().alias("attempt_count"),
            uniq(SRC).alias("unique_sources"),
            F.count_if("success").alias("successful_attempts"),
        )
        .withColumn("success_rate", share("successful_attempts", "attempt_count"))
    )
    return top(grouped, "attempt_count", ["username", "password"], n)


def targeted_usernames(creds, as_of, days=30, n=50):
    grouped = (
        since(creds, as_of, days=days)
        .groupBy("username")
        .agg(
            n_rows().alias("total_attempts"),
            uniq(SRC).alias("unique_attackers"),
            uniq("password").alias("unique_passwords_tried"),
            F.count_if("success").alias("successful_logins"),
        )
    )
    return top(grouped, "total_attempts", ["username"], n)


def password_strength(creds, as_of, days=30, n=100):
    grouped = (
        since(creds, as_of, days=days)
        .groupBy("password")
        .agg(n_rows().alias("usage_count"), uniq(SRC).alias("used_by_attackers"))
        .withColumns(
            {
                "password_length": F.length("password"),
                "weakness_category": classify.password_weakness("password"),
            }
        )
    )
    return top(grouped, "usage_count", ["password"], n)


def pair_counts(creds, as_of, days=7, n=20):
    grouped = since(creds, as_of, days=days).groupBy("username", "password").agg(n_rows().alias("attempts"))
    return top(grouped, "attempts", ["username", "password"], n)


def successful_logins(creds, as_of, hours=24):
    rows = since(creds, as_of, hours=hours).filter("success")
    return newest(rows, [SRC, "username"], None, ["timestamp", SRC, "username", "password", "protocol"])


def credential_diversity(creds, as_of, days=7, more_than=10):
    grouped = (
        since(creds, as_of, days=days)
        .groupBy(SRC)
        .agg(
            uniq("username").alias("unique_usernames"),
            uniq("password").alias("unique_passwords"),
            n_rows().alias("total_attempts"),
        )
        .filter(F.col("total_attempts") > more_than)
    )
    return top(grouped, "total_attempts", [SRC], None)


# --- industrial control


def ics_protocols(events, as_of, days=30):
    grouped = (
        since(events, as_of, days=days)
        .filter(F.col("honeypot_type") == "conpot")
        .groupBy("protocol", "event_type")
        .agg(n_rows().alias("attack_count"), uniq(SRC).alias("unique_attackers"), F.min("command").alias("example_command"))
    )
    return top(grouped, "attack_count", ["protocol", "event_type"], None)


def ics_attackers(events, as_of, hours=24, n=10):
    grouped = (
        since(events, as_of, hours=hours)
        .filter(F.col("honeypot_type") == "conpot")
        .groupBy(SRC, "source_ip_country")
        .agg(n_rows().alias("event_count"))
    )
    return top(grouped, "event_count", [SRC, "source_ip_country"], n)


def ics_by_protocol(events, as_of, days=7):
    grouped = (
        since(events, as_of, days=days)
        .filter(F.col("honeypot_type") == "conpot")
        .groupBy("protocol")
        .agg(n_rows().alias("count"))
    )
    return top(grouped, "count", ["protocol"], None)


def ics_hourly(events, as_of, hours=24):
    return (
        since(events, as_of, hours=hours)
        .filter(F.col("honeypot_type") == "conpot")
        .groupBy(F.date_trunc("hour", "timestamp").alias("hour"))
        .agg(n_rows().alias("events"))
        .orderBy("hour")
    )


# --- lateral movement


def lateral_events(events, as_of, prefix="172.20.0.", days=7, minutes=0, n=100):
    rows = since(events, as_of, days=days, minutes=minutes).filter(F.col("dest_ip").startswith(prefix))
    rows = rows.withColumn("alert_type", F.lit("Potential Lateral Movement"))
    cols = ["timestamp", SRC, "dest_ip", "dest_port", "protocol", "event_type", "alert_type"]
    return newest(rows, ["event_id"], n, cols)


def lateral_count(events, as_of, prefix="172.20.0.", days=7):
    return (
        since(events, as_of, days=days).filter(F.col("dest_ip").startswith(prefix)).agg(n_rows().alias("lateral_events"))
    )


def lateral_latest(events, as_of, prefix="172.20.0.", days=7, n=5):
    rows = since(events, as_of, days=days).filter(F.col("dest_ip").startswith(prefix))
    return newest(rows, ["event_id"], n, ["timestamp", "honeypot_type", SRC, "dest_ip", "dest_port"])


def lateral_from_inside(raw_events, as_of, prefix="172.20.0.", days=7, n=100, ip_col="src_ip"):
    """Events that *originate* inside; needs the raw address, so it runs before pseudonyms."""
    rows = since(raw_events, as_of, days=days).filter(F.col(ip_col).startswith(prefix))
    rows = rows.withColumn("alert_type", F.lit("Potential Lateral Movement"))
    cols = ["timestamp", SRC, "dest_ip", "dest_port", "protocol", "event_type", "alert_type"]
    return newest(rows, ["event_id"], n, cols)


def lateral_alerts(alerts, as_of, sid=2000035, days=7):
    rows = since(alerts, as_of, days=days).filter(F.col("signature_id") == sid)
    cols = ["timestamp", "alert_signature", SRC, "dest_ip", "dest_port", "payload"]
    return newest(rows, ["alert_id"], None, cols)


def lateral_alerts_wide(alerts, sid=2000035):
    """By rule id, by name or by tactic (either spelling)."""
    cond = (
        F.col("alert_signature").contains("LATERAL")
        | (F.col("signature_id") == sid)
        | F.col("mitre_tactic").isin("lateral-movement", "Lateral Movement")
    )
    cols = ["timestamp", "alert_signature", SRC, "dest_ip", "dest_port", "mitre_technique_id", "mitre_tactic"]
    return newest(alerts.filter(cond), ["alert_id"], None, cols)


def traffic_matrix(events, prefix="172.20.0."):
    inside = events.filter(F.col("dest_ip").startswith(prefix))
    return inside.groupBy(SRC, "dest_ip").agg(n_rows().alias("events"))


def lateral_timeline(events, prefix="172.20.0.", step="1 hour"):
    inside = events.filter(F.col("dest_ip").startswith(prefix))
    return inside.groupBy(F.window("timestamp", step)["start"].alias("bucket"), "honeypot_type").agg(
        n_rows().alias("events")
    )


# --- campaigns, malware, noisy alerts


def campaigns(events, as_of, days=30, min_days=3, min_sensors=2, n=50):
    """Sources active on several days against several sensors.

    Events are first counted per source, day, sensor, port and type; the sets and
    distinct counts then work on those cells.
    """
    cells = (
        since(events, as_of, days=days)
        .groupBy(SRC, F.to_date("timestamp").alias("date"), "honeypot_type", "dest_port", "event_type")
        .agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), n_rows().alias("n"))
    )
    grouped = (
        cells.groupBy(SRC)
        .agg(
            F.min("lo").alias("campaign_start"),
            F.max("hi").alias("campaign_end"),
            F.size(F.collect_set("date")).alias("active_days"),
            F.sum("n").alias("total_events"),
            F.sort_array(F.collect_set("dest_port")).alias("targeted_ports"),
            F.sort_array(F.collect_set("event_type")).alias("attack_types"),
            F.size(F.collect_set("honeypot_type")).alias("honeypots_attacked"),
        )
        .filter((F.col("active_days") >= min_days) & (F.col("honeypots_attacked") >= min_sensors))
    )
    return top(grouped, "total_events", [SRC], n)


def malware(files, as_of, days=30, n=50):
    grouped = (
        since(files, as_of, days=days)
        .groupBy("md5_hash", "sha256_hash")
        .agg(
            F.min("filename").alias("filename"),
            F.min("mime_type").alias("mime_type"),
            n_rows().alias("download_count"),
            uniq(SRC).alias("unique_downloaders"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
        )
    )
    return top(grouped, "download_count", ["md5_hash", "sha256_hash"], n)


def noisy_signatures(alerts, as_of, days=7, n=50):
    grouped = (
        since(alerts, as_of, days=days)
        .groupBy("signature_id")
        .agg(
            F.min("alert_signature").alias("signature"),
            F.min("alert_category").alias("category"),
            n_rows().alias("alert_count"),
            uniq(SRC).alias("unique_sources"),
        )
        .withColumn("percentage", share_of_all("alert_count"))
    )
    return top(grouped, "alert_count", ["signature_id"], n)


# --- data quality


def missing_country(events, alerts, as_of, days=1):
    def of(name, df):
        return since(df, as_of, days=days).agg(
            F.lit(name).alias("table_name"),
            F.count_if(F.col("source_ip_country") == "").alias("missing_country"),
            n_rows().alias("total_records"),
        )

    both = stack([of("honeypot_events", events), of("ids_alerts", alerts)])
    return both.withColumn("missing_percentage", share("missing_country", "total_records"))


def country_coverage(events, alerts, as_of, hours=24):
    def of(name, df):
        return since(df, as_of, hours=hours).agg(
            F.lit(name).alias("source"),
            F.count_if(F.col("source_ip_country") != "").alias("with_country"),
            n_rows().alias("total"),
        )

    both = stack([of("Honeypot Events", events), of("IDS Alerts", alerts)])
    return both.withColumn("coverage_percent", share("with_country", "total"))


def missing_technique(alerts, as_of, days=1):
    counts = since(alerts, as_of, days=days).agg(
        F.count_if(F.col("mitre_technique_id") == "").alias("without_mitre"), n_rows().alias("total_alerts")
    )
    return counts.withColumn("missing_percentage", share("without_mitre", "total_alerts"))


def technique_coverage(alerts, as_of, hours=24):
    counts = since(alerts, as_of, hours=hours).agg(
        F.count_if(F.col("mitre_technique_id") != "").alias("with_mitre"), n_rows().alias("total_alerts")
    )
    return counts.withColumn("coverage_percent", share("with_mitre", "total_alerts"))


def duplicates(df, keys):
    return df.groupBy(*keys).agg(n_rows().alias("copies")).filter("copies > 1")


def data_volume(events, as_of, days=7):
    """Approximate megabytes per day: length of the rows written as JSON."""
    rows = since(events, as_of, days=days)
    size = F.sum(F.length(F.to_json(F.struct(*[F.col(c) for c in events.columns]))))
    return (
        rows.groupBy(F.to_date("timestamp").alias("date"))
        .agg(F.round(size / F.lit(1048576.0), 4).alias("data_mb"))
        .orderBy("date")
    )


# --- status


def table_counts(events, alerts, conns, as_of, hours=24):
    def of(name, df):
        return since(df, as_of, hours=hours).agg(
            F.lit(name).alias("table_name"), n_rows().alias("total_events"), uniq(SRC).alias("unique_attackers")
        )

    return stack([of("Honeypot Events", events), of("IDS Alerts", alerts), of("Network Connections", conns)])


def sensor_breakdown(events, as_of, hours=24):
    grouped = (
        since(events, as_of, hours=hours)
        .groupBy("honeypot_type")
        .agg(n_rows().alias("events"), uniq(SRC).alias("unique_attackers"), uniq("dest_port").alias("unique_ports"))
    )
    return top(grouped, "events", ["honeypot_type"], None)


def top_techniques(alerts, as_of, hours=24, n=10, attackers=False):
    aggs = [n_rows().alias("detections")] + ([uniq(SRC).alias("unique_attackers")] if attackers else [])
    grouped = (
        since(alerts, as_of, hours=hours)
        .filter(F.col("mitre_technique_id") != "")
        .groupBy("mitre_tactic", "mitre_technique_id")
        .agg(*aggs)
    )
    return top(grouped, "detections", ["mitre_tactic", "mitre_technique_id"], n)


def top_attackers(events, as_of, hours=24, n=10):
    """Counts per source, country and port first, so the port sets grow from cells, not events."""
    recent = since(events, as_of, hours=hours)
    cells = recent.groupBy(SRC, "source_ip_country", "dest_port").agg(
        n_rows().alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")
    )
    grouped = cells.groupBy(SRC, "source_ip_country").agg(
        F.sum("n").alias("total_events"),
        F.sort_array(F.collect_set("dest_port")).alias("ports_targeted"),
        F.min("lo").alias("first_seen"),
        F.max("hi").alias("last_seen"),
    )
    return top(grouped, "total_events", [SRC, "source_ip_country"], n)


def daily_report(events, creds, alerts, files, date, n=10):
    """The seven sections of the daily report, by name."""
    e, c, a, f = (on_day(df, date) for df in (events, creds, alerts, files))

    def counted(df, keys, limit=None):
        return top(df.groupBy(*keys).agg(n_rows().alias("count")), "count", keys, limit)

    return {
        "total": e.agg(n_rows().alias("count")),
        "by_sensor": counted(e, ["honeypot_type"]),
        "top_sources": counted(e, [SRC], n),
        "top_ports": counted(e, ["dest_port"], n),
        "top_credentials": counted(c, ["username", "password"], n),
        "by_severity": a.groupBy("alert_severity").agg(n_rows().alias("count")).orderBy("alert_severity"),
        "files": f.agg(n_rows().alias("count"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_bytes")),
    }


# --- dashboard


def dashboard_numbers(events, alerts, start, end):
    """Totals of the headline panels, one row per number."""
    e, a = between(events, start, end), between(alerts, start, end)
    brute = F.col("event_type").isin("login_success", "login_failed", "cowrie.login.success", "cowrie.login.failed")
    numbers = e.agg(
        n_rows().alias("Total Events"), uniq(SRC).alias("Unique Attackers"), F.count_if(brute).alias("Brute Force Attempts")
    )
    long = numbers.unpivot([], ["Total Events", "Unique Attackers", "Brute Force Attempts"], "panel", "value")
    return long.unionByName(a.agg(F.lit("IDS Alerts").alias("panel"), n_rows().alias("value")))


def timeline(events, start, end, step="5 minutes"):
    return (
        between(events, start, end)
        .groupBy(F.window("timestamp", step)["start"].alias("t"))
        .agg(n_rows().alias("events"))
        .orderBy("t")
    )


def panel_countries(events, start, end, n=10):
    grouped = (
        between(events, start, end)
        .filter(~F.col("source_ip_country").isin("XX", ""))
        .groupBy("source_ip_country")
        .agg(n_rows().alias("attacks"))
    )
    return top(grouped, "attacks", ["source_ip_country"], n)


def panel_tactics(alerts, start, end):
    grouped = (
        between(alerts, start, end).filter(F.col("mitre_tactic") != "").groupBy("mitre_tactic").agg(n_rows().alias("count"))
    )
    return top(grouped, "count", ["mitre_tactic"], None)


def panel_usernames(creds, start, end, n=20):
    """Usernames of failed logins."""
    grouped = (
        between(creds, start, end)
        .filter(~F.col("success") & (F.col("username") != ""))
        .groupBy("username")
        .agg(n_rows().alias("attempts"))
    )
    return top(grouped, "attempts", ["username"], n)


def panel_ports(events, start, end, n=10):
    grouped = between(events, start, end).groupBy("dest_port").agg(n_rows().alias("hits"))
    return top(grouped, "hits", ["dest_port"], n)


def panel_techniques(alerts, start, end, n=20):
    grouped = (
        between(alerts, start, end)
        .filter(F.col("mitre_technique_id") != "")
        .groupBy("mitre_technique_id", "mitre_tactic")
        .agg(n_rows().alias("occurrences"))
    )
    return top(grouped, "occurrences", ["mitre_technique_id", "mitre_tactic"], n)


def by_protocol(events, as_of, hours=24):
    grouped = since(events, as_of, hours=hours).groupBy("protocol").agg(n_rows().alias("cnt"))
    return top(grouped, "cnt", ["protocol"], None)


def top_countries(events, as_of, days=7, n=10):
    grouped = since(events, as_of, days=days).groupBy("source_ip_country").agg(n_rows().alias("attacks"))
    return top(grouped, "attacks", ["source_ip_country"], n)


# --- lists of rows


def exploits(requests, as_of, days=1, n=None):
    """Requests that show an exploit class."""
    rows = since(requests, as_of, days=days).withColumn("exploit_type", classify.http_exploit("uri"))
    rows = rows.filter(F.col("exploit_type") != "").withColumns({"protocol": F.lit("http"), "url": F.col("uri")})
    return newest(rows, [SRC, "url"], n, ["timestamp", SRC, "protocol", "exploit_type", "url", "user_agent"])


def frequent_alerts(alerts, as_of, days=7, n=20):
    grouped = (
        since(alerts, as_of, days=days)
        .groupBy(F.col("alert_signature").alias("signature"), "signature_id")
        .agg(n_rows().alias("cnt"))
    )
    return top(grouped, "cnt", ["signature", "signature_id"], n)


def severe_alerts(alerts, as_of, hours=1, severity=1):
    rows = since(alerts, as_of, hours=hours).filter(F.col("alert_severity") == severity)
    cols = ["timestamp", F.col("alert_signature").alias("signature"), "source_ip_country", "dest_port"]
    return newest(rows, ["alert_id"], None, cols)


def noisy_sids(alerts, as_of, days=7, n=10):
    grouped = since(alerts, as_of, days=days).groupBy("signature_id").agg(n_rows().alias("cnt"))
    return top(grouped, "cnt", ["signature_id"], n)


def services(conns, as_of, hours=24):
    grouped = since(conns, as_of, hours=hours).groupBy("service").agg(n_rows().alias("conn_count"))
    return top(grouped, "conn_count", ["service"], None)


def failed_connections(conns, as_of, hours=1, n=100):
    rows = since(conns, as_of, hours=hours).filter(F.col("conn_state").isin("REJ", "S0", "RSTO"))
    return newest(rows, ["uid"], n, ["timestamp", SRC, "dest_port", "conn_state"])


def top_uris(requests, as_of, days=7, n=20):
    grouped = since(requests, as_of, days=days).groupBy("uri").agg(n_rows().alias("requests"))
    return top(grouped, "requests", ["uri"], n)


def suspicious_agents(requests, as_of, days=1, parts=lists.SUSPICIOUS_AGENT_PARTS):
    """Requests whose agent contains one of the parts; the time bound applies to all of them."""
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.col("user_agent").contains(part)
    rows = since(requests, as_of, days=days).filter(hit)
    return newest(rows, ["uri", SRC], None, ["timestamp", "user_agent", "uri", "source_ip_country"])


def top_files(files, as_of, days=30, n=10):
    grouped = (
        since(files, as_of, days=days)
        .groupBy(F.col("sha256_hash").alias("file_hash"), "filename")
        .agg(n_rows().alias("download_count"), uniq(SRC).alias("unique_sources"))
    )
    return top(grouped, "download_count", ["file_hash", "filename"], n)


def recent_downloads(files, as_of, days=1):
    rows = since(files, as_of, days=days).withColumn("file_hash", F.col("sha256_hash"))
    return newest(rows, ["file_id"], None, ["timestamp", "filename", "file_hash", SRC, "download_url"])


# --- rates


def two_day_summary(events, as_of, days=2):
    return (
        since(events, as_of, days=days)
        .groupBy(F.to_date("timestamp").alias("date"))
        .agg(n_rows().alias("events"), uniq(SRC).alias("unique_attackers"))
        .orderBy("date")
    )


def event_rate(events, as_of, step="hour", hours=24):
    """Events per hour or minute."""
    return (
        since(events, as_of, hours=hours)
        .groupBy(F.date_trunc(step, "timestamp").alias("bucket"))
        .agg(n_rows().alias("events"))
        .orderBy("bucket")
    )


def events_per_second(events, as_of, minutes=1):
    return since(events, as_of, minutes=minutes).agg(
        F.round(n_rows() / F.lit(60.0 * minutes), 4).alias("events_per_second")
    )


def last_hour_count(events, as_of):
    return since(events, as_of, hours=1).agg(n_rows().alias("events"))


def high_rate(events, as_of, limit=1000, minutes=1):
    """One row when more than ``limit`` events came in the last minutes, else none."""
    counted = since(events, as_of, minutes=minutes).agg(n_rows().alias("events_per_minute"))
    return counted.filter(F.col("events_per_minute") > limit)


# --- cameras and routers


def rtsp_latest(events, n=10):
    rows = events.filter(F.col("honeypot_type") == "rtsp")
    return newest(rows, ["event_id"], n, ["timestamp", "event_type", SRC, "dest_port"])


def rtsp_attacks_latest(attacks, n=10):
    return newest(attacks, ["attack_id"], n, ["timestamp", "attack_type", "rtsp_method", "source_ip_country"])


def rtsp_hourly(events, by_type=False):
    keys = [F.date_trunc("hour", "timestamp").alias("time")] + ([F.col("event_type")] if by_type else [])
    grouped = events.filter(F.col("honeypot_type") == "rtsp").groupBy(*keys).agg(n_rows().alias("events"))
    return grouped.orderBy("time", *(["event_type"] if by_type else []))


CVE = "CVE-2014-8361"


def rtsp_cve_daily(attacks, cve=CVE):
    rows = attacks.filter(F.col("attack_type").contains(cve))
    return rows.groupBy(F.to_date("timestamp").alias("date")).agg(n_rows().alias("attacks")).orderBy(F.desc("date"))


def rtsp_cve_countries(attacks, cve=CVE):
    rows = attacks.filter(F.col("attack_type").contains(cve))
    return top(rows.groupBy("source_ip_country").agg(n_rows().alias("attacks")), "attacks", ["source_ip_country"], None)


def rtsp_countries(attacks, n=10):
    rows = attacks.filter(F.col("source_ip_country") != "")
    return top(rows.groupBy("source_ip_country").agg(n_rows().alias("attacks")), "attacks", ["source_ip_country"], n)


def rtsp_attackers(attacks, cve=CVE, n=10):
    grouped = attacks.groupBy(SRC, "source_ip_country").agg(
        n_rows().alias("total_attacks"), F.count_if(F.col("attack_type").contains(cve)).alias("cve_attacks")
    )
    return top(grouped, "total_attacks", [SRC, "source_ip_country"], n)


def upnp_attacks_latest(attacks, n=None):
    return newest(attacks, ["attack_id"], n, attacks.columns)


# --- verification and tuning


def verify(df, predicate: Column, as_of, minutes=10, count=False):
    """Rows (or their number) that meet a predicate in the last minutes."""
    rows = since(df, as_of, minutes=minutes).filter(predicate)
    return rows.agg(n_rows().alias("matches")) if count else rows


def sid_in(*sids) -> Column:
    return F.col("signature_id").isin(*sids)


def sid_between(lo, hi) -> Column:
    return F.col("signature_id").between(lo, hi)


# The ids of the industrial-control signatures.
ICS_SIDS = (2000018, 2000019, 2000020, 2000021, 2000037, 2000038)


def to_sensor(df, dest_ip, as_of, minutes=10, ties=()):
    """Connections or requests to one sensor, newest first."""
    rows = since(df, as_of, minutes=minutes).filter(F.col("dest_ip") == dest_ip)
    wanted = ["timestamp", "dest_ip", "dest_port", "protocol", "conn_state", "method", "uri", "user_agent"]
    return newest(rows, list(ties), None, [c for c in wanted if c in df.columns])


def false_positive_candidates(alerts, test_sources, start, end, more_than=100):
    """Signatures that fire often while nobody is known to attack.

    Alerts are counted per signature and source before the anti join, so a busy source is
    a few rows there, and the sources of a signature are simply its rows.
    """
    cells = (
        between(alerts, start, end)
        .groupBy("signature_id", F.col("alert_signature").alias("signature"), SRC)
        .agg(n_rows().alias("n"))
    )
    known = test_sources.select(F.col("ip_hash").alias(SRC)).distinct()
    grouped = (
        cells.join(known, SRC, "left_anti")
        .groupBy("signature_id", "signature")
        .agg(F.sum("n").alias("alert_count"), n_rows().alias("unique_sources"))
        .filter(F.col("alert_count") > more_than)
    )
    return top(grouped, "alert_count", ["signature_id", "signature"], None)


# --- kill chain, heat map, flows

# Sensor event type -> kill-chain phase.
EVENT_STAGES = {
    "session_start": "Reconnaissance",
    "connection": "Reconnaissance",
    "login_failed": "Delivery",
    "login_success": "Delivery",
    "command": "Exploitation",
    "attack_detected": "Exploitation",
    "file_download": "Installation",
}


def staged(events, alerts, event_stages=None):
    """Events and alerts with their phase; rows of no phase are left out."""
    by_type = classify.lookup(F.col("event_type"), event_stages or EVENT_STAGES, "")
    by_alert = classify.kill_chain_stage("mitre_technique_id", "signature_id")
    both = events.select("timestamp", SRC, by_type.alias("stage")).unionByName(
        alerts.select("timestamp", SRC, by_alert.alias("stage"))
    )
    return both.filter(F.col("stage") != "")


def stage_timeline(stages, step="1 hour"):
    return stages.groupBy(F.window("timestamp", step)["start"].alias("bucket"), "stage").agg(n_rows().alias("events"))


def stage_paths(stages):
    """Phases of each source by first appearance (at most six per source)."""
    firsts = stages.groupBy(SRC, "stage").agg(F.min("timestamp").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "stage")))
    return firsts.groupBy(SRC).agg(ordered.alias("_p")).select(SRC, F.col("_p.stage").alias("stages"))


def heat_map(alerts, tactics: list | None = None):
    """Techniques × tactics; ``other`` counts the alerts of every tactic that is no column, so none is lost."""
    named = alerts.filter(F.col("mitre_technique_id") != "")
    columns = tactics or sorted(set(lists.TACTICS.values()) | {"Unknown"})
    tactic = F.col("mitre_tactic")
    column = F.when(tactic.isin(columns), tactic).otherwise("other")
    counts = named.withColumn("_column", column).groupBy("mitre_technique_id").pivot("_column", [*columns, "other"])
    return counts.agg(n_rows()).na.fill(0)


def country_flows(events):
    return events.groupBy("source_ip_country", "dest_port", "protocol").agg(n_rows().alias("events"))

