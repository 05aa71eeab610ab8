"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from headway.jobs import registry

#: Jobs over the largest tables, one for each kind of work.
HEADLINE = [
    "d1_duplicate_key_stop_times", "d3_foreign_keys", "e_rows_stop_times", "f1_usage", "f2_stop_usage", "f10_transfer_trips", "g5_block_route_types", "g8_shape_distance_gaps", "h1_unsorted_stop_times", "h2_stop_time_times",
    "h4_stop_time_distance", "h7_trip_vs_shape_distance", "h9_fast_consecutive", "h10_fast_far", "i6_trips_per_date", "i8_block_overlap", "j4_transfer_distance", "j6_stop_to_shape", "j7_closest_shape_point", "k2_pathway_unreachable_location",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    took, rows = {}, {}
    for name in HEADLINE:
        began = time.time()
        rows[name] = queries[name](spark, sf_dir).count()
        took[name] = round(time.time() - began, 3)
    times = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(json.dumps({"metric": "sum of headline query seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "stop_times": times, "rows": rows}))


if __name__ == "__main__":
    main()
