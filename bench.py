"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.session import session  # noqa: E402
from tessera.suite import base, meaning, orders, star  # noqa: E402, F401

HEADLINE = [
    "scan_count", "filter_count", "agg_returnflag", "q1_full", "q1_date", "q3_full", "q6_revenue", "q6_date", "join_revenue", "orders_agg", "multi_agg", "topn_price",
    "ds_q3", "ds_q7", "ds_q19", "ds_q27_rollup", "ds_q43_pivot", "ds_q55", "ds_q96_count", "str_like_contains", "str_upper", "str_pipeline", "pipe_filter_join_agg_sort", "osi_join",
]
RUNS = 3


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for k in range(RUNS + 1):  # the first warms up
            began = time.perf_counter()
            base.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(sorted(runs[1:])[RUNS // 2], 4)
    spark.stop()
    print(json.dumps({"metric": "headline queries, sum of median seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
