"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "flagship_zone_best_use", "j01_hazard_flags", "j02_jurisdiction_join", "j07_env_zoning_merge", "j10_adjacency_touches",
    "j11_neighbour_pairs", "j12_nearby_topk", "a01_a06_plan_objectives", "a08_compatibility_score", "a10_neighbourhood_summary",
    "a11_planning_metrics", "a31_metric_bundle", "p32_assignment_explanation", "t03_pareto_fronts", "t04_crowding_distance",
    "t10_vector_topk", "c02_chunking", "w01_job_progress",
)


def session(cpus: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("lotweave")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from lotweave.queries import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(cpus)
    spark.read.parquet(f"{folder}/customer.parquet").count()
    QUERIES[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
