"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query starts from the raw tables: stage tables of earlier queries are forgotten before each one.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tradewright.plans import catalog  # noqa: E402

HEADLINE = [
    "a1_cell_benchmark", "a2_leave_self_out", "a3_trader_metrics", "roster", "a9_by_symbol", "a13_pair_select",
    "d1_dedup_first_wins", "j9_as_of", "j10_interval_excursions", "w3_candle_features", "t6_trade_screen",
    "m5_mann_whitney", "o5_quantile_edges", "q5_net_vs_gross", "r12_funnel_okx", "e23_cell_drift",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("a9_by_symbol")  # JVM warm-up
    seconds = {}
    for name in HEADLINE:
        catalog.forget()
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


main()
