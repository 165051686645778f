"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import time

from tidemark.plans import QUERIES
from tidemark.session import local_session

HEADLINE = (
    "decode_events", "stitch_identity", "attribute_traffic", "page_daily", "model_hourly", "merge_rollup", "active_users",
    "active_users_bitmap", "merge_kpis", "statistic_history", "kpi_card", "top_n_other", "ccu_peaks", "count_pack",
    "build_pages", "with_flow", "sessionize", "session_at", "log_context", "page_relations", "flow_summary", "funnel_level",
    "discover_group", "funnel_open", "device_distribution", "top_pages", "priority_pages", "page_series", "scatter_sample_all",
    "minute_stats", "heatmap", "daily_percentile", "api_errors", "page_aggregate", "waterfall_rows", "timing_summary",
    "all_versions", "version_conversion", "device_lifecycle", "retention", "stack_frames", "map_frames", "active_users_sketch", "top_messages_sketch",
)


def counts(frame) -> dict[str, int]:
    """Table reads and shuffles of a query's plan before adaptive execution reuses any."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return {"scans": plan.count("FileScan"), "exchanges": len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Single|REBALANCE|Round)", plan))}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    QUERIES["top_pages"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the session's code paths
    seconds: dict[str, float] = {}
    plans: dict[str, dict[str, int]] = {}
    for name in names:
        start = time.perf_counter()
        frame = QUERIES[name](spark, sf_dir)
        frame.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        plans[name] = counts(frame)
    total = round(sum(seconds.values()), 3)
    scale = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": scale, "plans": plans}))


if __name__ == "__main__":
    main()
