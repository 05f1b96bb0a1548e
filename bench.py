"""Headline queries on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up (code generation, Python workers) and is then timed as the better of two
runs, plan building included, with all result rows produced.
"""

from __future__ import annotations

import json
import os
import sys
import time

from wattloom.plans import QUERIES
from wattloom.session import local_session

HEADLINE = [
    "enhanced_detection", "meter_features", "zone_asof_mean", "zone_mean", "sliding_windows", "window_labels", "standardize_train_only",
    "sigma_clip", "describe", "baseline_stats", "iqr_outliers", "value_counts", "correlation", "rolling_threshold", "threshold_strategies",
    "feature_contributions", "alert_cooldown", "adaptive_threshold", "global_threshold", "roc_auc", "pr_auc", "f1_threshold", "calibration_error",
    "temperature_fit", "metrics_by_type", "linear_impute", "consumer_aggregates", "attack_overlay", "packet_loss", "ledger_rows", "ledger_blocks",
    "ledger_chain", "ledger_validate", "stream_latest_bus", "stream_sliding_windows", "pca_recon_score",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="wattloom-bench")
    rows = spark.read.parquet(f"{folder}/events.parquet").count()
    first = {name: run(spark, name, folder) for name in names}
    times = {name: min(run(spark, name, folder), run(spark, name, folder)) for name in names}
    print(json.dumps({
        "metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "readings": rows, "first_run": first,
        "readings_per_sec": {name: round(rows / t, 1) for name, t in times.items()},
    }))


if __name__ == "__main__":
    main()
