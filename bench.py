"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "ranked_new_alerts",
    "preview_top_alerts",
    "keyword_hits",
    "score_and_pass",
    "score_and_pass_native",
    "score_robotics",
    "score_multi_profile",
    "new_postings",
    "seen_upsert",
    "retain_newest",
    "first_per_source_id",
    "newest_n_per_company",
    "newest_100_per_source",
    "contiguous_page_prefix",
    "failure_streak",
    "failure_upsert",
    "health_report",
    "run_summary",
    "rule_eval",
    "strip_html",
    "alert_text",
    "normalize_greenhouse",
    "normalize_workday",
    "dispatch_sources",
    "stream_alerts",
    "stream_streak",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lookout-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lookout.plans.registered import QUERIES

    names = sys.argv[1:] or HEADLINE
    # Generated code, the JVM's compiler and the Python workers warm up outside the
    # timings, on the smallest tables where they exist.
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in names:
        warm = small if os.path.isdir(small) else sf_dir
        QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
