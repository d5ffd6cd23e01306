"""Times headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON.

Each query runs once to warm up and then BENCH_RUNS times, of which the median counts; its rows go to Spark's
no-operation sink. ``value`` is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

os.environ.setdefault("OMP_NUM_THREADS", "1")  # one BLAS thread in each Python worker

from pyspark.sql import SparkSession  # noqa: E402

from bandloom.plans import catalogue  # noqa: E402

HEADLINE = (
    "temperature_maps", "solve_lines", "solve_dem", "solve_dem_gloci", "temp_all", "quantise_p99", "bandset_pivot", "manifest_first_per_group",
    "todo_antijoin", "nearest_rank_percentiles", "compare_golden", "band_minmax", "resp_binned",
)
if os.environ.get("BENCH_ONLY"):
    HEADLINE = tuple(os.environ["BENCH_ONLY"].split(","))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        took = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(median(took[1:]), 3)
    solved = catalogue.QUERIES["solve_lines"](spark, sf_dir).groupBy("valid").count().collect()
    pixels = {bool(row["valid"]): row["count"] for row in solved}
    out = {
        "metric": "sum of median query seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rpartition("sf")[2],
        "solver": {"valid_px_per_s": round(pixels.get(True, 0) / seconds["solve_lines"]), "invalid_share": round(pixels.get(False, 0) / max(1, sum(pixels.values())), 4), "nf": 6, "nt": 24, "nmu": 42, "outputs": "all", "cores": int(cpus), "batch": 256},
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
