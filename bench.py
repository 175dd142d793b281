"""Wall seconds of the headline queries: prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every query runs once to warm up and then three times; the
fastest run counts. Results are written to the no-op sink, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from catalog.queries import QUERIES

HEADLINE = [
    "clean_events", "monthly_counts", "melt_share", "count_matrix", "area_rates", "points_inner", "area_rate_pipeline",
    "veil_flags", "top_n_ties_quantity", "natural_breaks_lines", "mean_ci", "every_nth_blank_first", "pivot_variables",
    "gee_fit", "gee_adjusted", "gee_battery",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("eventrates-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    best, cold = {}, {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        cold[name], best[name] = round(times[0], 3), round(min(times[1:]), 3)
    spark.stop()
    total = round(sum(best.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": best,
                "cold": cold,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
