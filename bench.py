"""Times the headline queries: one warm-up of the session, then wall seconds per query.

Stored inputs (baseline, windows) are built first and reported on their own, because a
deployment builds them once per model version; every query then reads the given tables.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from shoreline.queries import REGISTERED, inputs  # noqa: E402

HEADLINE = [
    "detect_drift",
    "detect_drift_exact",
    "drift_from_frame",
    "ks_statistic",
    "ks_test",
    "psi_continuous",
    "psi_categorical",
    "psi_bins_continuous",
    "count_windows",
    "count_windows_stream",
    "window_summary",
    "reference_profile",
    "category_proportions",
    "reference_sample",
    "output_baseline",
    "quantile_edges",
    "unpivot_features",
    "replay_events",
    "validate_events",
    "classify_nodes",
    "root_severity",
    "symptom_paths",
    "ancestors",
    "topological_order",
    "alert_cooldown",
    "incident_lifecycle",
    "incident_summary",
    "window_results",
    "monitoring_report",
    "binary_metrics",
    "roc_auc",
    "average_precision",
    "multiclass_metrics",
    "regression_metrics",
    "fairness_rates",
    "pii_key_scan",
    "dataset_fingerprint",
    "resample_reference",
    "shift_sensitivity",
    "attribution_topk",
    "attribution_summary",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.log.level", "ERROR")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='shoreline-bench-')}")
        .getOrCreate()
    )
    names = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)

    timed("build_baseline", lambda: inputs.baseline(spark, sf))
    timed("build_windows", lambda: inputs.windowed(spark, sf))
    for name in names:
        fn = REGISTERED[name][0]
        timed(name, lambda: fn(spark, sf).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
