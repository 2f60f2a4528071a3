"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (/root/testdata/sf0.1), BENCH_CPUS the threads of
the local session. Each query runs once to warm up and then BENCH_REPEATS times;
the median counts. Results are drained into a sink that discards them.
"""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tallyweir import queries

HEADLINE = ["scan_projection", "filter_and", "filter_col_col", "pk_lookup", "join_inner", "anti_join", "agg_sum_global", "agg_group_sum_count", "agg_over_join", "sort_multi", "topk", "map_arithmetic", "mutation_fold", "ivm_group_delta", "ivm_join_delta", "mv_group", "dml_update", "kv_update"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        query, times = queries.queries()[name], []
        for _ in range(1 + int(os.environ.get("BENCH_REPEATS", "1"))):
            began = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "headline queries, seconds in all", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
