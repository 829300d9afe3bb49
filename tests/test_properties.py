"""Random series against a literal restatement of the definitions."""

import math
import random

import pytest

from helpers import samples_of
from tideline.functions.grid import TimeGrid
from tideline.model import Metric, ResultDescriptor, CorrelationRequest
from tideline.operators.consolidate import primary_data
from tideline.operators.neighbours import adjacent_samples, chunked, previous_samples, with_previous
from tideline.plans.correlation import score
from tideline.plans.measurements import process


def interval_value(points, ceiling, step, heartbeat, max_heartbeat):
    """Each millisecond of the interval belongs to the next sample in reach of it; a
    stretch of at least a heartbeat that belongs to one sample is unknown."""
    reach = sorted(ts for ts in points if abs(ts - ceiling) <= max_heartbeat)
    owners = [next((ts for ts in reach if ts >= ms), None) for ms in range(ceiling - step + 1, ceiling + 1)]
    # A sample owns the time before it in the interval, and, where it is the first one, what lies between the interval and it.
    stretches = {ts: owners.count(ts) for ts in set(owners) - {None}}
    after = [ts for ts in stretches if ts > ceiling and not any(ceiling - step < earlier <= ceiling for earlier in reach)]
    stretches |= {ts: ts - (ceiling - step) for ts in after}
    known = {ts: n for ts, n in stretches.items() if n < heartbeat}
    unknown = sum(n for n in stretches.values() if n >= heartbeat)
    return sum(points[ts] * n for ts, n in known.items()) / sum(known.values()) if unknown < sum(known.values()) else math.nan


def random_series(rng, count, span):
    names = [f"m{i}" for i in range(count)]
    series = {}
    for name in names:
        density = rng.choice([3, 10, 40])
        series[name] = {rng.randrange(span): float(rng.randrange(100)) for _ in range(density)}
    return series


@pytest.mark.parametrize("seed", range(3))
def test_consolidation_matches_the_definition(spark, seed):
    rng = random.Random(seed)
    span = 400
    series = random_series(rng, 8, span)
    step = rng.choice([7, 10, 25])
    short, long = rng.choice([(4, 30), (9, 9), (20, 75)])
    start, end = rng.randrange(60), span - rng.randrange(60)
    d = ResultDescriptor(step)
    for name in series:
        d = d.datasource(f"{name}-s", name, heartbeat_ms=short).datasource(f"{name}-l", name, heartbeat_ms=long)
    grid = TimeGrid.covering(start, end, step)
    expected = {
        (name, hb, t): interval_value(points, t, step, hb, max(short, long))
        for name, points in series.items()
        for hb in {short, long}
        for t in range(grid.lo, grid.hi + 1, step)
    }
    samples = samples_of(spark, series, unit=1)
    for hot_rows in (None, 1, 5):
        rows = primary_data(samples.repartition(3), start, end, d, hot_rows=hot_rows).collect()
        got = {(r["metric"], r["heartbeat_ms"], r["ts_ms"]): r["value"] for r in rows}
        assert len(rows) == len(got) and got.keys() == expected.keys()
        for key, value in expected.items():
            assert (math.isnan(got[key]) and math.isnan(value)) or abs(got[key] - value) < 1e-9, key


@pytest.mark.parametrize("hot_rows", [None, 1, 4, 1000])
def test_previous_is_lag_however_series_are_split(spark, hot_rows):
    rng = random.Random(7)
    series = random_series(rng, 5, 1000)
    series["burst"] = {500 + i: float(i) for i in range(60)} | {0: 1.0, 999: 2.0}
    samples = samples_of(spark, series, unit=1)
    expected = {}
    for name, points in series.items():
        before = (None, None)
        for ts in sorted(points):
            expected[name, ts] = before
            before = (ts, points[ts])
    rows = with_previous(samples.repartition(4), hot_rows).collect()
    assert len(rows) == len(expected)
    assert {(r["metric"], r["ts_ms"]): (r["prev_ts"], r["prev_value"]) for r in rows} == expected

    stamps = sorted({ts for points in series.values() for ts in points})
    before = dict(zip(stamps, [None, *stamps]))
    rows = adjacent_samples(samples, hot_rows).collect()
    assert len(rows) == len(expected)
    assert all(r["prev_row_ts"] == before[r["ts_ms"]] for r in rows)


def test_hot_series_becomes_many_groups(spark):
    series = {"hot": {t: 1.0 for t in range(0, 4000)}, "cold": {t: 1.0 for t in range(0, 4000, 100)}}
    rows = previous_samples(samples_of(spark, series, unit=1), hot_rows=100)
    sizes = {(r["metric"], r["_chunk"]): r["count"] for r in rows.groupBy("metric", "_chunk").count().collect()}
    assert sizes["cold", 0] == 40 and len([m for m, _ in sizes if m == "cold"]) == 1
    assert max(sizes.values()) <= 100 and sum(sizes.values()) == 4040
    assert "_chunk" not in previous_samples(samples_of(spark, series, unit=1)).columns


def test_a_burst_is_split_as_well(spark):
    burst = spark.range(99_990).selectExpr("10000000000 + id AS ts_ms").unionByName(spark.range(10).selectExpr("id * 1000000000L AS ts_ms"))
    samples = burst.selectExpr("'r' AS resource", "ts_ms", "'m' AS metric", "'GAUGE' AS metric_type", "1.0 AS value")
    rows = previous_samples(samples, hot_rows=1000)
    assert max(r["count"] for r in rows.groupBy("_chunk").count().collect()) <= 1000
    assert rows.where("prev_ts IS NULL").count() == 1 and rows.where("ts_ms - prev_ts = 1").count() == 99_989


def test_a_resource_of_many_metrics_is_cut_by_its_rows(spark):
    """Thousands of series, none of them long, most rows in a short time: chunks hold what they may, and the look back is right."""
    rows = spark.range(40_000).selectExpr(
        "'wide' AS resource", "CASE WHEN id < 30000 THEN 1000000 + id div 200 ELSE (id - 30000) * 1000 END AS ts_ms", "concat('m', id % 2000) AS metric"
    )
    small = spark.range(500).selectExpr("'small' AS resource", "id AS ts_ms", "'m' AS metric")
    samples = rows.unionByName(small).distinct().selectExpr("*", "'GAUGE' AS metric_type", "1.0 AS value")
    chunks = chunked(samples, ["resource"], 2000)
    sizes = {(r["resource"], r["_chunk"]): r["count"] for r in chunks.groupBy("resource", "_chunk").count().collect()}
    assert max(sizes.values()) <= 2000 and sum(sizes.values()) == samples.count()
    assert {c for r, c in sizes if r == "small"} == {0} and len(sizes) < 200
    split, whole = ({(r["resource"], r["metric"], r["ts_ms"]): (r["prev_ts"], r["prev_row_ts"]) for r in adjacent_samples(samples, n).collect()} for n in (2000, 10**9))
    assert split == whole


def test_groups_of_any_size_are_cut(spark):
    """From just above the limit to many times it, in one table."""
    series = {f"m{n}": {t: 1.0 for t in range(n)} for n in (99, 100, 101, 250, 1000, 5000)}
    sizes = {}
    for r in previous_samples(samples_of(spark, series, unit=1), hot_rows=100).groupBy("metric", "_chunk").count().collect():
        sizes.setdefault(r["metric"], []).append(r["count"])
    assert max(max(s) for s in sizes.values()) <= 100 and {m: sum(s) for m, s in sizes.items()} == {m: len(p) for m, p in series.items()}
    assert len(sizes["m99"]) == len(sizes["m100"]) == 1 < len(sizes["m101"]) and len(sizes["m5000"]) <= 400


def test_split_pipeline_gives_the_same(spark):
    rng = random.Random(3)
    series = random_series(rng, 6, 600)
    samples = samples_of(spark, series, kind="COUNTER", unit=1000)
    d = ResultDescriptor(20_000).datasource("m0").datasource("m1", heartbeat_ms=90_000).export("m0", "m1")
    key = lambda r: (r["ts_ms"], r["label"])
    def run(hot_rows, **options):
        rows = process(samples, 100_000, 600_000, d, 60_000, hot_rows=hot_rows, **options).collect()
        return {key(r): (None if math.isnan(r["value"]) else round(r["value"], 9)) for r in rows}

    for options in ({}, {"strict_adjacency": True}, {"with_attributes": True}):
        whole = run(None, **options)
        assert any(v is not None for v in whole.values())
        assert run(1, **options) == whole and run(5, **options) == whole

    request = CorrelationRequest(Metric("localhost", "m0"), 0, 600_000, 20_000)
    keys = samples.select("resource", "metric").distinct().where("metric <> 'm0'")
    def scores(hot_rows):
        rows = score(samples, request, keys, "zero", hot_rows=hot_rows).collect()
        return {r["metric"]: (None if math.isnan(r["coefficient"]) else round(r["coefficient"], 9)) for r in rows}
    assert scores(None) == scores(2) and len(scores(None)) == 5
    assert any(v is not None for v in scores(None).values())


def test_only_requested_resources_come_out(spark):
    samples = samples_of(spark, {"m": {t: 1.0 for t in range(100)}}, "a", unit=1).unionByName(
        samples_of(spark, {"m": {t: 2.0 for t in range(100)}}, "b", unit=1)
    )
    wanted = spark.createDataFrame([("b",), ("c",)], "resource string")
    d = ResultDescriptor(5).datasource("m").export("m")
    for rows in (
        process(samples, 10, 100, d, 10, resources=wanted).collect(),
        process(samples, 10, 100, d, 10, resources=wanted, with_attributes=True).collect(),
        primary_data(samples, 10, 100, d, resources=wanted).collect(),
    ):
        assert {r["resource"] for r in rows} == {"b", "c"}
        assert all(r["value"] == 2.0 if r["resource"] == "b" else math.isnan(r["value"]) for r in rows)


def test_every_bucket_of_every_requested_series(spark):
    samples = samples_of(spark, {"m0": {5: 1.0}}, unit=1)
    d = ResultDescriptor(3).datasource("m0").datasource("m1").export("m0", "m1")
    rows = process(samples, 10, 50, d, 9).collect()
    grid = TimeGrid.covering(10, 50, 9)
    assert len(rows) == 2 * grid.size
    assert {r["ts_ms"] for r in rows} == set(range(grid.lo, grid.hi + 1, 9))
