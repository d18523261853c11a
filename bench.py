"""Headline queries, timed once each after a warm-up: one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from leafwright.plans import slate

HEADLINE = "risk_by_operator_category structural_codes policy_b routing_b decisions final_decisions threshold_sweep auroc extracted_fields token_overlaps item_split tree_paths best_anchor code_counts".split()


def main() -> None:
    place, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.files.maxPartitionBytes", "4m")  # the tables are small files; one task each would leave cores idle
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    own = slate.queries()
    own["structural_codes"](spark, place).limit(1).collect()
    took = {}
    for name in HEADLINE:
        began = time.time()
        own[name](spark, place).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": place.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
