"""Time the registered headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "windowed_features_5m", "windowed_features_1h", "windowed_features_1d", "windowed_counts_1h",
    "windowed_counts_sketch_5m", "current_windows_1h", "latest_profile", "guarded_fold", "guarded_counts",
    "compaction_equiv", "feature_long", "feature_vector", "lookup_request_table", "latency_round",
    "decode_events", "decode_events_json", "reject_reasons", "contract_split", "contract_valid_events",
    "dead_letter_reasons", "contract_diff", "compat_issues", "compat_gate", "stats_report",
    "throughput_history", "top_user_share", "stream_job_vectors", "stream_ingest_events",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from tidemark.plans import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", "/tmp/tidemark-bench")
    names = sys.argv[1:] or HEADLINE
    queries = catalog.queries()
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # JVM and file system warm-up
    took, rates = {}, {}
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("events", "orders")}
    on_orders = ("contract_diff", "compat", "lookup_request", "latency")
    for name in names:
        begun = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begun, 3)
        source = "orders" if name.startswith(on_orders) else "events"
        rates[name] = round(rows[source] / took[name])
    print(json.dumps({
        "metric": "headline queries, total wall clock", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "input_rows_per_sec": rates, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
