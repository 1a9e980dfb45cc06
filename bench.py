"""Benchmark the headline queries.

Runs every registered query marked ``bench=True`` at ``$BENCH_SF_DIR``
(default ``/root/testdata/sf0.1``) on ``local[$BENCH_CPUS]`` and prints one
JSON line: ``{"metric", "value", "unit", "queries": {name: sec}, "sf"}``.

Each query is forced with a ``noop`` write: the whole plan runs on the
executors and nothing is collected to the driver.  One warm-up pass (JIT,
file listing) precedes the timed pass; the reported time is the timed pass.
``BENCH_QUERIES`` (comma-separated) narrows the set; ``BENCH_ALL=1`` times
every registered query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from shoplytics.session import get_spark
    from shoplytics.plans.registry import load_all

    spark: SparkSession = get_spark("shoplytics-bench", master=f"local[{cpus}]",
                                    shuffle_partitions=int(cpus) * 2)
    reg = load_all()
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    if only:
        names = [n for n in only if n in reg]
    elif os.environ.get("BENCH_ALL"):
        names = list(reg)
    else:
        names = [n for n, q in reg.items() if q.bench]

    def run(name: str) -> float:
        t0 = time.perf_counter()
        reg[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    times: dict[str, float] = {}
    for n in names:
        try:
            run(n)  # warm-up
            times[n] = round(run(n), 3)
        except Exception as ex:  # noqa: BLE001
            print(f"bench: {n} failed: {type(ex).__name__}: {str(ex)[:200]}", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))


if __name__ == "__main__":
    main()
