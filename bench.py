"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line (the second run of each)."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINES = ["merge_within_cell", "merge_within_cell_stats", "cluster_labels_cell", "subcell_weighted", "profile_long", "mean_profile", "energy_containment_crop", "hist_log_energy", "pca_axis"]


def main() -> None:
    from showerlake.plans.queries import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINES:
        runs = []
        for _ in range(2):
            t = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        took[name] = round(runs[-1], 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
