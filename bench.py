"""Time every query at one scale and print one JSON line.

BENCH_SF_DIR  folder of Parquet tables   (default /root/testdata/sf0.1)
BENCH_CPUS    threads of the local master (default 8)
BENCH_RUNS    timed runs per query; the median counts (default 1)
BENCH_WARM    1 for an untimed run of each query first (default 0: one query warms the session up)
BENCH_ONLY    comma-separated query names (default all)

A query's rows are all computed and thrown away, so that neither the driver nor a file system is
measured. `value` is the sum over the queries.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from crewledger.plans.catalogue import queries
from crewledger.session import build_session


def timed(query, spark, folder) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    warm = os.environ.get("BENCH_WARM", "0") == "1"
    only = [name for name in os.environ.get("BENCH_ONLY", "").split(",") if name]
    spark = build_session(
        "bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="8g", spark__sql__session__timeZone="UTC", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, query in queries().items():
        if only and name not in only:
            continue
        if warm or not seconds:
            timed(query, spark, folder)
        seconds[name] = round(statistics.median(timed(query, spark, folder) for _ in range(runs)), 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total seconds over all queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
