"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is timed from the call (which includes eager model/statistics fits)
to the end of a full execution into Spark's ``noop`` sink (every row computed,
nothing collected to the driver).  Two untimed queries on sf0.001 warm up
the JVM and the Python workers first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from metricspark.plans import queries as Q  # noqa: E402
from metricspark.session import local_session  # noqa: E402

HEADLINE = [
    "host_health", "preprocess_pipeline", "profile_describe", "correlation_matrix", "moving_avg_20",
    "clip_iqr", "anomaly_zscore", "series_anomalies", "slope_forecast", "anomaly_isolation_forest",
    "hill_climb", "first_fit_schedule", "alert_suppression", "stream_alert_suppression", "fit_linear",
    "fit_random_forest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="metricspark-bench")
    # Untimed warm-up (JIT, codegen caches, Python workers) on the smallest scale factor.
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in ("host_health", "anomaly_isolation_forest"):
        Q.QUERIES[name](spark, warm_dir if os.path.isdir(warm_dir) else sf_dir).write.format("noop") \
            .mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        Q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
