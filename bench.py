"""Time the headline queries and print one JSON line.

Each query runs once to warm up (class loading, code generation, stored tables) and
once timed, writing to a sink that discards rows, so the whole result is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import registry  # noqa: E402
from checks.sources import Sources, stored  # noqa: E402
from fleetlens.session import get_session  # noqa: E402

HEADLINE = [
    # normalisation and facts
    "normalize_silver", "map_events", "user_activity_hourly", "user_activity_daily", "dev_activity_enriched",
    "object_activity_events", "license_utilization_daily", "latest_by_partition",
    # serving
    "top_users_30d", "capability_summary", "usage_by_capability", "leaderboard", "user_kpis", "active_monthly",
    "adoption_observed", "stickiness", "segments", "current_license_by_profile", "directory",
    "match_products", "product_rollups", "consumption_by_type", "top_products", "lifecycle", "assets", "product_metadata_summary",
    # maintenance and streaming
    "write_fact_partitions", "compaction_audit", "stream_hourly_activity", "late_data_lookback", "compact_partitions",
]


def run(spark, query, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.merged("QUERIES")
    # The tables the serving queries read are built once, before the clock of any query starts.
    started, sources = time.perf_counter(), Sources(spark, sf_dir)
    for name in [n for n, v in vars(Sources).items() if isinstance(v, stored)]:
        getattr(sources, name)
    cold = round(time.perf_counter() - started, 3)
    times = {}
    for name in HEADLINE:
        run(spark, queries[name], sf_dir)
        times[name] = round(run(spark, queries[name], sf_dir), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_warm_total", "value": total, "unit": "sec", "queries": times, "stored_tables_cold_build": cold, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
