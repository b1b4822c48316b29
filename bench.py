"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line of seconds by query."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from plotwise.plans.catalog import QUERIES

HEADLINE = ["deals_below_local_median", "market_buckets", "market_reference", "dedupe_survivors", "refile_nearest_town", "feedback_rerank", "upsert_merge", "price_changes", "score_land", "score_flip", "score_motivated", "rating_tiers", "norm_text", "page_details"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.local.dir": top, "spark.checkpoint.dir": f"file://{top}/shared", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["active_listings"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the workers and compiles
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
