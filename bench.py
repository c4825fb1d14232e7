"""Benchmark the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, optional), BENCH_REPEAT (default 1: best of N),
BENCH_EVENT_LOG (set: write Spark's event log to a fresh /tmp folder).
Each query is fully executed with the ``noop`` sink (no collect to the
driver); the time includes any writes the query performs itself.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tierline.plans import all_queries  # noqa: E402
from tierline.session import build_session  # noqa: E402

HEADLINE = [
    "customer_metrics", "quality_flag", "operator_profile", "rolling_24h", "rolling_multi",
    "txn_pattern_features", "pit_join", "feature_service", "latest_features",
    "mat_incr_merge", "dedup_latest", "stream_hourly", "stream_upsert_latest",
    "stratified_split", "outlier_score", "knn_exact", "rf_classify", "batch_predict",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    extra = None
    if os.environ.get("BENCH_EVENT_LOG"):
        # stage / task times without the UI: Spark's event log in a fresh scratch folder
        log_dir = tempfile.mkdtemp(prefix="tierline-events-")
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir}
        print(f"event log: {log_dir}", file=sys.stderr)
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), extra=extra)
    qs = all_queries()
    # JVM / JIT warm-up on the smallest data set next to the measured one (the
    # measured tables are not touched, so no cached pages or results carry over)
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for w in ("txn_summary", "quality_flag", "customer_metrics", "rolling_24h", "pit_join_ttl",
              "model_per_group"):   # the last one starts the Python (Arrow) workers
        qs[w](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
