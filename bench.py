"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from scoreweave import suite

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["woe_bins_equal_width", "woe_bins", "woe_columns", "bins_cart", "bins_chi_merge", "bins_iv_optimal", "predictive_measures", "correlations", "logistic_stepwise", "scorecard_apply", "discrimination", "gains_table", "psi_monitor", "profit_curve", "decile_analysis", "monitor_summary"]


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(3):
            began = time.time()
            suite.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(median(times), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
