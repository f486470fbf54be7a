"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from statewalk.plans.catalog import QUERIES
from statewalk.plans.stages import stage_table

HEADLINE = [
    "bfs_paths",
    "bfs_multi_source",
    "bfs_directed",
    "expand_once",
    "expand_dedup",
    "expand_two_pass",
    "bfs_states",
    "lookup_nodes",
    "supplier_powers",
    "apply_transitions",
    "fold_events",
    "fold_lineitem",
    "fold_history",
    "last_per_key",
    "concat_events",
    "explode_tokens",
    "key_flags",
    "key_buckets",
    "canonical_classes",
    "lookup_stage1",
    "lookup_stage2",
    "replay_stage1",
    "resolve_sequences",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("statewalk-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        # folds do much work per byte: keep all cores busy on small shuffles
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, builds = {}, {}
    for number in (1, 2, 3, 4):
        started = time.time()
        stage_table(spark, number)
        builds[f"build_stage{number}"] = round(time.time() - started, 3)
    for name in HEADLINE:
        started = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "stage_builds": builds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
