"""Tasks that make many rows of few: how many there are follows the input, not the bytes exchanged."""

import pytest
from pyspark.sql import functions as F

from checks import tables
from tideline.functions import grid as grids
from tideline.functions.grid import TimeGrid, hours
from tideline.model import ResultDescriptor
from tideline.operators import consolidate as consolidation
from tideline.operators import neighbours
from tideline.operators.consolidate import primary_data
from tideline.operators.rollup import roll_up
from tideline.sources.bucketed import read_bucketed, write_bucketed
from tideline.sources.samples import SAMPLE_SCHEMA

END = 600 * 60_000
D = ResultDescriptor(60_000).datasource("a", heartbeat_ms=hours(1)).datasource("b", heartbeat_ms=hours(1))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("spread") / "samples")
    rows = [(f"r{i % 40}", i * 20_000, "ab"[i % 3 % 2], "GAUGE", float(i % 17), None, i) for i in range(1500)]
    spark.createDataFrame(rows, SAMPLE_SCHEMA + ", seq bigint").write.parquet(path)
    return spark.read.parquet(path)


def primary(samples):
    return primary_data(samples, 60_000, END, D)


def rolled(samples):
    return roll_up(primary(samples), 60_000, END, D, 600_000)


@pytest.mark.parametrize("query", [primary, rolled])
def test_number_of_tasks_follows_the_input(spark, stored, query, monkeypatch):
    rows = lambda: sorted((r[0], r["ts_ms"], r[2], str(round(r["value"], 9))) for r in query(stored).collect())
    plain = rows()
    monkeypatch.setattr(neighbours, "TASK_BYTES", neighbours.input_bytes(stored) // 9)
    assert query(stored).rdd.getNumPartitions() >= 9
    assert rows() == plain


def test_inputs_of_unknown_size_get_the_sessions_number(spark, stored, monkeypatch):
    monkeypatch.setattr(neighbours, "TASK_BYTES", 1)
    unknown = spark.createDataFrame(stored.rdd, stored.schema)
    assert neighbours.input_bytes(unknown) >= neighbours.UNKNOWN_BYTES
    assert primary(unknown).count() == primary(stored.limit(0).union(unknown)).count() == 40 * 2 * 600


def test_a_table_read_twice_counts_once(stored):
    assert neighbours.input_bytes(stored.union(stored)) == neighbours.input_bytes(stored)


def test_buckets_stay_where_they_are(spark, stored, monkeypatch):
    write_bucketed(stored, "spread_samples", 3)
    monkeypatch.setattr(neighbours, "TASK_BYTES", 1000)
    plan = neighbours.previous_samples(read_bucketed(spark, "spread_samples").where(F.col("value").isNotNull()))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_few_keys_are_made_a_spine_by_many_tasks(spark, stored, monkeypatch):
    monkeypatch.setattr(neighbours, "TASK_BYTES", neighbours.input_bytes(stored) // 9)
    keys = neighbours.spread_keys(stored.select("resource", "metric").distinct())
    assert keys.rdd.getNumPartitions() >= 9 and keys.count() == 80


def test_daily_sums_are_made_where_rows_are_exchanged(spark, tmp_path, monkeypatch):
    """No hash table over a scan's rows; how many tasks sum follows the input."""
    columns = "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_returnflag string, day int"
    rows = [(i, i % 7, None if i % 50 == 0 else i % 9, None if i % 31 == 0 else float(i % 11), "AN"[i % 2], i % 5) for i in range(900)]
    given = spark.createDataFrame(rows, columns).withColumn("l_shipdate", F.timestamp_seconds(F.col("day") * 86_400))
    given.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(neighbours, "TASK_BYTES", 1000)
    sums = tables.daily_lines(spark, str(tmp_path))
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan[plan.index("Exchange") :] and plan.count("Exchange") == 1
    assert sums.rdd.getNumPartitions() >= neighbours.input_bytes(given.sparkSession.read.parquet(f"{tmp_path}/lineitem.parquet")) // 1000
    want = {}
    for _, _, supplier, quantity, flag, day in rows:
        key = (None if supplier is None else f"s{supplier}", flag, day * 86_400_000)
        want[key] = want.get(key) if quantity is None else (want.get(key) or 0.0) + quantity
    assert {(r["resource"], r["metric"], r["ts_ms"]): r["value"] for r in sums.collect()} == want and sums.count() == len(want)


def test_gaps_are_made_after_the_exchange(spark, monkeypatch):
    """Blocks of a few points, keys asked for twice, without samples, without a name; unasked ones are left out."""
    monkeypatch.setattr(consolidation, "SPINE_BLOCK", 7)
    monkeypatch.setattr(grids, "SPINE_BLOCK", 7)
    given = {("r0", "a"): {1_000: 1.0, 8_000: 8.0, 9_000: 9.0, 31_000: 3.0, 40_000: 4.0}, (None, "a"): {20_000: 2.0}, ("r9", "a"): {5_000: 5.0}}
    rows = [(r, m, 5, t, t, v) for (r, m), points in given.items() for t, v in points.items()]
    measured = spark.createDataFrame(rows, "resource string, metric string, heartbeat_ms long, bucket_ms long, interval_ms long, value double")
    asked = [("r0", "a", 5), ("r0", "a", 5), ("r1", "a", 5), (None, "a", 5)]
    filled = consolidation.fill_gaps(measured, spark.createDataFrame(asked, "resource string, metric string, heartbeat_ms long"), TimeGrid(1_000, 40_000, 1_000))
    got = sorted((str(r["resource"]), r["bucket_ms"], r["interval_ms"], r["value"] or 0.0) for r in filled.collect())
    assert got == sorted((str(r), t, t, given.get((r, "a"), {}).get(t, 0.0)) for r in ("r0", "r1", None) for t in range(1_000, 40_001, 1_000))


def test_gaps_of_primary_data_are_not_exchanged(stored):
    plan = primary(stored)._jdf.queryExecution().executedPlan().toString()
    # Read from the end: the exchange of measured rows and heads is below the rows of the grid.
    assert plan.index("sequence(interval_ms") < plan.index("Exchange hashpartitioning")


def test_a_list_sent_to_all_tasks_does_not_hide_the_size(spark, stored, monkeypatch):
    monkeypatch.setattr(neighbours, "TASK_BYTES", neighbours.input_bytes(stored) // 9)
    pieces = neighbours.chunked(stored, hot_rows=10)
    assert neighbours.CHUNK in pieces.columns and neighbours.input_bytes(pieces) == neighbours.input_bytes(stored)
    assert neighbours.previous_samples(stored, hot_rows=10).rdd.getNumPartitions() >= 9
