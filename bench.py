"""Time the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

"queries" reads the Parquet files each time, "cached" the same tables held in memory by Spark.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from relspan import catalogue

NAMES = ["where_expr", "select_expr", "order_limit_offset", "inner_join", "left_join", "group_basic", "agg_stats", "agg_mode", "win_running_sum_part", "win_rank_part", "moving_average", "normalize", "pivot_sum", "distinct_on", "dashboard", "monthly_trend", "seven_op"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()

    def timed() -> dict[str, float]:
        times = {}
        for name in NAMES:
            best = float("inf")
            for _ in range(3):
                start = time.perf_counter()
                queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                best = min(best, time.perf_counter() - start)
            times[name] = round(best, 4)
        return times

    times = timed()
    for table in catalogue.KEYS:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").cache().count()
    cached = timed()
    print(json.dumps({"metric": "total of headline queries, best of 3", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "cached": cached, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
