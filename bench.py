"""Benchmark the headline queries.

Runs each query in ``BENCH_QUERIES`` against ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}``.

Each query is executed in full with the ``noop`` sink (every row is
produced, nothing is collected to the driver). One untimed warm-up query
starts the JVM and Python workers first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

BENCH_QUERIES = [
    "usage_15m", "usage_1h", "usage_1d", "usage_rollup_chain", "analytics_range", "batch_compact",
    "billing_daily", "cycle_totals", "billing_enriched", "balance_reconcile", "seq_gaps", "event_append",
    "insert_ignore", "nth_trigger", "state_audit", "tier_asof", "latency_summary", "run_metrics",
    "histogram_le", "batch_issues", "cycle_finalize", "rate_limit", "reorder_deliver", "payload_verdict",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from gaugeworks.plans.registry import QUERIES, load_all
    from gaugeworks.session import build_session

    load_all()
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in BENCH_QUERIES if n in QUERIES]
    QUERIES["usage_1mo"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times, failed = {}, {}
    for name in names:
        t0 = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as exc:  # keep timing the rest; report the failure
            failed[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
            continue
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    result = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
              "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    if failed:
        result["failed"] = failed
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
