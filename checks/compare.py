"""Runs queries and their SQL side by side: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES
from tideline.session import configured


def normal(value):
    if isinstance(value, float) and (math.isnan(value) or value == 0):
        return None if math.isnan(value) else 0.0
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    found = [tuple(normal(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(found, key=lambda row: [(v is None, str(type(v)), v if v is not None else 0) for v in row])


def connect(sf_dir: str):
    db = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return db


def compare(spark, db, sf_dir: str, name: str) -> str | None:
    """None when both agree, else what differs."""
    frame = QUERIES[name](spark, sf_dir)
    names, got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    answer = db.execute(ORACLES[name])
    wanted_names, wanted = canonical([c[0] for c in answer.description], answer.fetchall())
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    if len(got) != len(wanted):
        return f"{len(got)} rows != {len(wanted)}"
    differing = [(a, b) for a, b in zip(got, wanted) if a != b]
    return f"{len(differing)} of {len(got)} rows differ, first: {differing[0]}" if differing else None


def main(sf_dir: str, chosen: list[str]) -> int:
    builder = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    spark = configured(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    failed = 0
    for name in chosen or QUERIES:
        started = time.time()
        try:
            problem = compare(spark, db, sf_dir, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:26} {time.time() - started:6.1f}s  {problem or 'same'}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
