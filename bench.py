"""Time the queries and print one JSON line.

Every query is run once to warm up and then BENCH_RUNS times; the median counts. All of a result
is computed and thrown away, nothing is collected.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_RUNS
(default 1), BENCH_ONLY (comma list of queries, default all).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from larder.plans.registry import all_queries  # noqa: E402
from larder.session import local_session  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]
    spark = local_session(cpus, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    found = all_queries()
    names = [n for n in found if not only or n in only]

    def run(name: str) -> float:
        began = time.perf_counter()
        found[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    times = {}
    for n in names:
        run(n)
        times[n] = round(sorted(run(n) for _ in range(runs))[runs // 2], 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": spark.sparkContext.defaultParallelism,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
