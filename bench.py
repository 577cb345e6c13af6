"""Prints one JSON line: median seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from quern.operators import registry
from quern.session import Engine
from quern.sources.shared import new_folder

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))

NAMES = [
    "bench_select_all", "bench_point_lookup", "bench_range", "bench_group_count_avg", "bench_join_group", "bench_join_filter",
    "bench_exists", "bench_cte_join_order_limit", "bench_join_count_distinct_having", "flagship", "agg_group_multi", "agg_count_distinct",
    "correlated_scalar", "not_in_subquery", "union_distinct", "topk", "json_group",
]


def inserts(spark: SparkSession, n: int) -> None:
    """One prepared INSERT with n lists of parameters, in a transaction."""
    session = Engine(spark, new_folder(spark).removeprefix("file://").removeprefix("file:")).create_session()
    session.execute("CREATE TABLE products (id INTEGER PRIMARY KEY, name TEXT, price REAL, category TEXT); BEGIN")
    session.prepare("INSERT INTO products VALUES ($1, $2, $3, $4)").run_many([[i, f"product {i}", i * 7 % 100 + 0.25, f"category {i % 5}"] for i in range(n)])
    session.execute("COMMIT")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    jobs = {name: lambda f=queries[name]: f(spark, SF).write.format("noop").mode("overwrite").save() for name in NAMES}
    jobs |= {f"bench_insert_{n}": lambda n=n: inserts(spark, n) for n in (1000, 10000)}
    seconds = {}
    for name, job in jobs.items():
        job()
        times = []
        for _ in range(REPEATS):
            began = time.perf_counter()
            job()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times), 4)
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF.rstrip("/")), "cpus": CPUS, "repeats": REPEATS}))


if __name__ == "__main__":
    main()
