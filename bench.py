"""Headline queries, timed one after the other.

Reads ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one
JSON line. Each query is built and run to a sink that discards its rows; the best of
three runs counts, and nothing is cached between runs.
"""

from __future__ import annotations

import json
import os
import time

from checks import registry
from sourcelore.session import local_session

HEADLINES = [
    "file_authors",
    "change_frequency",
    "co_change",
    "co_change_top",
    "recently_modified",
    "text_metrics",
    "file_facts",
    "names_lexical",
    "import_edges",
    "dead_code",
    "contributor_stats",
    "enrich_files",
    "high_risk_files",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = local_session(cores, shuffle_partitions=cores, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    plans = registry.build()
    seconds = {}
    for name in HEADLINES:
        best = None
        for _ in range(RUNS):
            spark.catalog.clearCache()
            start = time.perf_counter()
            plans[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
