"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all cores). Each query runs
to completion into Spark's no-op sink, which evaluates every row and column without writing them.
Query names given as arguments replace the headline list.
"""

from __future__ import annotations

import json
import os
import sys
import time

from catalog.queries import QUERIES
from pricetide.session import build_session

HEADLINE = [
    "daily_panel", "daily_panel_by_brand", "date_completeness_by_month", "top_products", "feature_panel",
    "standard_scaler_stats", "robust_scaler_stats", "scaled_panel", "product_registry", "global_median_price",
    "historical_action", "best_multiplier", "counterfactual_profit", "policy_backtest", "policy_kpis",
    "bootstrap_ci", "product_evaluation", "boosted_demand_quality",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    shuffles = str(os.cpu_count() if cpus == "*" else cpus)
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": shuffles, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()  # start the executor before timing
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
