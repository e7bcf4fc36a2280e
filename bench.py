"""Wall seconds per query after one warm-up run; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated, default all that have an SQL twin).
"""

from __future__ import annotations

import json
import os
import sys
import time

from palaver.session import local_session
from palaver.workload import ORACLES, QUERIES


#: Fits of some hundred short jobs; a warm-up would only double them.
UNWARMED = ("train_l1", "train_fit_metrics", "cross_validate", "class_sizes")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    named = os.environ.get("BENCH_QUERIES")
    names = named.split(",") if named else [n for n in QUERIES if n in ORACLES or n in UNWARMED]
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        if name not in UNWARMED:
            run(name)
        seconds[name] = round(run(name), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall seconds, one warm run per query",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
