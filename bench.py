"""Times headline queries and prints one JSON line.

``BENCH_SF_DIR``: table directory, ``BENCH_CPUS``: local cores, ``BENCH_RUNS``:
timed runs per query after one warm-up, of which the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from pyspark.sql import SparkSession  # noqa: E402

from checks.queries import QUERIES  # noqa: E402
from tideline.session import configured  # noqa: E402

HEADLINE = (
    "scan_range",
    "upsert_dedup",
    "index_terms",
    "catalog_any",
    "rate_counter",
    "primary_avg",
    "primary_few_series",
    "primary_gapfill",
    "attr_merge",
    "rollup_avg_min_max",
    "process_counters",
    "select_with_lookback",
    "correlate_topn",
    "correlate_all",
    "correlate_catalog_terms",
    "correlate_job",
    "tree_flatten",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = configured(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    timings = {}
    for name in HEADLINE:
        once(name)
        timings[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, median of warm runs, summed",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
