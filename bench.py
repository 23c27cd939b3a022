"""Time the headline queries and print one JSON line.

BENCH_SF_DIR chooses the data folder, BENCH_CPUS the number of local cores. Every query
runs once to warm up and is then timed over its full result (written to a sink that
discards it).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardlake.catalog import QUERIES  # noqa: E402
from wardlake.session import local_session, release  # noqa: E402

HEADLINE = [
    "q01_daily_overview",
    "q02_top_ports",
    "q03_country_share",
    "q04_technique_distribution",
    "q05_top_credentials",
    "q09_campaigns",
    "q10_malware",
    "q12_correlate_1h",
    "q46_context_windows",
    "a1_daily_attack_stats",
    "a4_profiles_from_states",
    "p1_build_profiles",
    "e1_e8_cowrie_events",
    "e2_geo_enrich",
    "d_scn_1_telnet_scan",
    "d_scn_3_multi_port",
    "d_ssh_1_bruteforce",
    "d_htt_7_exploit_log",
    "r2_match_text",
    "r5_own_rates",
    "l4_brute_force",
    "l7_rule_states",
]

# jobs the reference gives a duration for: the status report and the profile refresh
REPORTS = {
    "status_report": [
        "q18_table_counts", "q19_sensor_breakdown", "q03_country_share_24h", "q20_top_techniques", "q16_country_coverage",
        "q17_technique_coverage", "q13_lateral_count", "q13_lateral_latest", "q14_lateral_alerts", "q21_top_attackers",
    ],
    "profile_refresh": ["p8_profile_delta", "p1_build_profiles", "p6_top_profiles"],
}


def run(spark, folder: str, keys: list[str]) -> float:
    start = time.perf_counter()
    for key in keys:
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "wardlake-bench")
    jobs = {key: [key] for key in HEADLINE} | REPORTS
    times = {}
    for name, keys in jobs.items():
        run(spark, folder, keys)
        times[name] = round(run(spark, folder, keys), 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus) if cpus.isdigit() else cpus,
    }
    print(json.dumps(line))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
