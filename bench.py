"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
Each query is run to completion into the no-op sink, once unmeasured, so that class loading and code
generation don't count; the median of ``BENCH_RUNS`` (default 3) further runs does.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from clickspan.catalogue import QUERIES
from clickspan.session import build_session

HEADLINE = [
    "read_events", "event_count_daily", "event_breakdown", "active_users_daily", "dau_wau_mau",
    "window_funnel", "funnel_7d", "funnel_conversions", "funnel_dropoffs", "sessionize_30m",
    "session_summaries_30m", "session_metrics", "retention", "revenue_daily", "ltv_cumulative",
    "user_profile", "segment_count", "paths", "path_nodes", "attribution_first_touch",
    "attribution_last_touch", "attribution_linear", "experiment_results", "alert_metrics",
    "apply_cooldown", "campaign_triggers", "dedup_events", "ingest_events", "merge_profiles",
    "dau_rollup", "counts_from_rollup", "trailing_active_users_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
            # The bench tables are small: let post-shuffle tasks be small too.
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
            "spark.driver.memory": "12g",
            "spark.log.level": "ERROR",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings: dict[str, float] = {}
    for name in names:
        took = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - started)
        timings[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
