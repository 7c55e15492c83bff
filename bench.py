"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from curalake.plans.registry import QUERIES  # noqa: E402

HEADLINE = [
    "per_class_metrics", "threshold_sweep", "confidence_summary", "manifest_violations", "cross_split_duplicates", "stratified_split",
    "size_profile", "difference_hash", "near_dup_all", "near_dup_cross_split", "near_dup_two_tables", "latest_feedback",
    "enriched_predictions", "feedback_fingerprint", "graph_edges", "parts_for_defect", "graph_upsert", "square_crop", "review_pages",
    "html_plain_text", "batch_score", "split_fingerprint", "stream_latest_feedback",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", "").split() or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(folder).name,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
