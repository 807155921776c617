"""Times the headline queries; prints one JSON line.

Each query is warmed up once and then timed; the value is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tamarack.queries import QUERIES
from tamarack.session import build

HEADLINE = (
    "point_lookup", "category_scan", "value_range", "count_star", "category_aggregate", "top_n", "secondary_lookup",
    "join_inner", "join_star", "group_by", "exists_correlated", "correlated_scalar", "row_number", "union_distinct", "cte", "upsert", "asof",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = build(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        took = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = round(statistics.median(took[1:]), 4)
    spark.stop()
    print(json.dumps({"metric": "sum of median query times", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir}))


if __name__ == "__main__":
    main()
