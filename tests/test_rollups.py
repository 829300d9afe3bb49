"""Stored rollups after upserts against computing them anew, and which files stay."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import samples_of
from tideline.functions.grid import days, hours
from tideline.functions.values import MAX, add
from tideline.model import ResultDescriptor
from tideline.plans.measurements import process
from tideline.plans.rollups import dirty_buckets, read_rollup, refresh_rollup, write_rollup
from tideline.sources.samples import latest_samples

START, END, STEP, RESOLUTION = hours(5), days(9) + hours(7), hours(1), hours(4)


def descriptor():
    d = ResultDescriptor(STEP).datasource("a").datasource("a-max", "a", MAX).datasource("b", heartbeat_ms=hours(5))
    return d.calculate("sum", add, "a", "b").export("a", "a-max", "b", "sum")


def frame(spark, points, kind, seq):
    """``points``: (resource, metric) -> {ts: value}."""
    parts = [samples_of(spark, {m: values}, r, kind, 1) for (r, m), values in points.items() if values]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("seq", F.lit(seq).cast("long"))


def random_points(rng, resources, count):
    return {(r, m): {rng.randrange(-days(1), days(10)): round(rng.uniform(0, 50), 2) for _ in range(count)} for r in resources for m in ("a", "b", "other")}


def table(rows):
    out = {(r["resource"], r["ts_ms"], r["label"]): None if r["value"] != r["value"] else round(r["value"], 9) for r in rows.collect()}
    assert len(out) == rows.count()
    return out


def files(path):
    return {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


@pytest.mark.parametrize("kind", ["GAUGE", "COUNTER"])
@pytest.mark.parametrize("seed", range(3))
def test_refreshed_equals_computed_anew(spark, tmp_path, kind, seed):
    """New samples, replaced and emptied ones, bursts, new resources, others' metrics; twice in a row."""
    rng = random.Random(seed)
    points = random_points(rng, ["r0", "r1", "r2"], 60)
    samples = frame(spark, points, kind, 0)
    path, d = str(tmp_path / "rollup"), descriptor()
    write_rollup(samples, path, START, END, d, RESOLUTION)
    assert table(read_rollup(spark, path).drop("period")) == table(process(samples, START, END, d, RESOLUTION))
    for turn in (1, 2):
        some = {key: {ts: rng.uniform(0, 50) for ts in rng.sample(sorted(values), 2)} for key, values in points.items() if rng.random() < 0.5}
        some[f"new{turn}", "a"] = {hours(30 + turn): 4.0, hours(31 + turn): 7.0}
        some["r1", "b"] = {hours(100) + i: float(i) for i in range(5)}
        changed = frame(spark, some, kind, turn)
        # A sample written without a value takes the place of the one before.
        emptied = frame(spark, {("r2", "a"): dict.fromkeys(rng.sample(sorted(points["r2", "a"]), 3), 0.0)}, kind, turn).withColumn("value", F.lit(None).cast("double"))
        changed = changed.unionByName(emptied)
        samples = latest_samples(samples.unionByName(changed)).cache()
        refresh_rollup(spark, path, samples, changed, START, END, d, RESOLUTION)
        assert table(read_rollup(spark, path).drop("period")) == table(process(samples, START, END, d, RESOLUTION))


def test_untouched_periods_keep_their_files(spark, tmp_path):
    steady = {(f"r{i}", m): {hours(h): float(h) for h in range(0, 230)} for i in range(3) for m in ("a", "b")}
    samples, path, d = frame(spark, steady, "GAUGE", 0), str(tmp_path / "rollup"), descriptor()
    write_rollup(samples, path, START, END, d, RESOLUTION)
    before = files(path)
    changed = frame(spark, {("r1", "a"): {hours(77) + 5: 1000.0}}, "GAUGE", 1)
    samples = samples.unionByName(changed)
    assert refresh_rollup(spark, path, samples, changed, START, END, d, RESOLUTION) == [days(3)]
    after = files(path)
    gone = {f.parent.name for f in before.keys() - after.keys()}
    assert gone == {f"period={days(3)}"} and {f for f in before if f.parent.name not in gone} <= after.keys()
    assert all(after[f] == before[f] for f in before.keys() & after.keys())
    assert table(read_rollup(spark, path).drop("period")) == table(process(samples, START, END, d, RESOLUTION))


def test_few_buckets_are_dirty(spark):
    steady = {("r0", "a"): {hours(h): float(h) for h in range(0, 230)}, ("r1", "a"): {0: 1.0, days(8): 2.0}}
    d = descriptor()
    dirty = lambda samples, changed: {(r["resource"], r["ts_ms"]) for r in dirty_buckets(samples, changed, START, END, d, RESOLUTION).collect()}
    samples = frame(spark, steady, "GAUGE", 0)
    assert dirty(samples, frame(spark, {("r0", "a"): {hours(50): 9.0}}, "GAUGE", 1)) == {("r0", hours(48)), ("r0", hours(52))}
    # The successor is reached however far away it is.
    assert dirty(samples, frame(spark, {("r1", "a"): {hours(20): 9.0}}, "GAUGE", 1)) == {("r1", hours(16)), ("r1", hours(20)), ("r1", days(8) - hours(4)), ("r1", days(8))}
    assert dirty(samples, frame(spark, {("r0", "other"): {hours(50): 9.0}}, "GAUGE", 1)) == set()


def test_nothing_changed(spark, tmp_path):
    samples, path = frame(spark, {("r0", "a"): {hours(9): 1.0}}, "GAUGE", 0), str(tmp_path / "rollup")
    write_rollup(samples, path, START, END, descriptor(), RESOLUTION)
    before = files(path)
    assert refresh_rollup(spark, path, samples, samples.where("ts_ms < 0"), START, END, descriptor(), RESOLUTION) == []
    assert files(path) == before


def test_what_a_rollup_is_not_kept_of(spark, tmp_path):
    samples = frame(spark, {("r0", "a"): {hours(9): 1.0}}, "GAUGE", 0)
    for option in ({"strict_adjacency": True}, {"pad_first_bucket": False}, {"with_attributes": True}):
        with pytest.raises(ValueError, match="rollup"):
            write_rollup(samples, str(tmp_path), START, END, descriptor(), RESOLUTION, **option)
