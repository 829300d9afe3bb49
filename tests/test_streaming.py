"""Streamed primary data against the batch, over several batches and runs, with late and repeated samples."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import samples_of
from tideline.functions.grid import hours, seconds
from tideline.model import ResultDescriptor
from tideline.operators.consolidate import primary_data
from tideline.sources.samples import SAMPLE_SCHEMA
from tideline.streaming.consolidation import run_available, stream_primary_data, with_rocks_db

START, END, STEP, DELAY = seconds(600), seconds(3600), seconds(60), seconds(400)
# The last sample moves the watermark beyond all that is asked for.
MARK = END + DELAY + seconds(1000)


def descriptor():
    return ResultDescriptor(STEP).datasource("m0").datasource("m0-long", "m0", heartbeat_ms=seconds(300)).datasource("m1")


def points_of(rng):
    out = {}
    for metric, every in (("m0", 40), ("m1", 90), ("unasked", 50)):
        ts = 0
        while ts < 4400:
            ts += rng.choice([1, 7, every, every, 4 * every])
            out.setdefault(metric, {})[ts] = round(rng.uniform(0, 9), 3)
    return out


def rows_of(frame):
    return {(r["resource"], r["metric"], r["heartbeat_ms"], r["ts_ms"]): None if math.isnan(r["value"]) else round(r["value"], 9) for r in frame.collect()}


@pytest.fixture
def feed(spark, tmp_path):
    """Appends samples as one file and runs the stream over what is new; the rows so far."""
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run(samples):
        samples.select("resource", "ts_ms", "metric", "metric_type", "value", "attributes").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SAMPLE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        rows = stream_primary_data(stream, START, END, descriptor(), DELAY)
        run_available(rows, sink, state)
        return spark.read.schema("resource string, ts_ms long, metric string, heartbeat_ms long, value double").parquet(sink)

    return run


def mark(spark):
    return samples_of(spark, {"clock": {MARK: 0.0}}, "clock", unit=1)


def test_batches_equal_the_whole(spark, feed):
    """Samples in five runs, out of order within the delay; every interval once, none after it was closed."""
    rng = random.Random(4)
    samples = None
    for resource in ("a", "b"):
        own = samples_of(spark, points_of(rng), resource)
        samples = own if samples is None else samples.unionByName(own)
    samples = samples.cache()
    seen = 0
    for k in range(5):
        part = samples.where(F.col("ts_ms").between(900_000 * k, 900_000 * (k + 1) - 1))
        # Some come a batch early, so that order and batches do not agree.
        early = samples.where(F.col("ts_ms").between(900_000 * (k + 1), 900_000 * (k + 1) + 300_000) & (F.col("ts_ms") % 2000 == 0))
        got = feed(part.unionByName(early))
        assert got.count() >= seen
        seen = got.count()
    assert 0 < seen
    got = feed(mark(spark))
    want = rows_of(primary_data(samples, START, END, descriptor()))
    assert rows_of(got) == want and got.count() == len(want)
    assert any(v is None for v in want.values()) and any(v is not None for v in want.values())


def test_late_samples_are_left_out(spark, feed):
    """A sample that the watermark had passed changes nothing, one just after it counts; both before any interval they reach was closed."""
    first = samples_of(spark, {"m0": {t: 1.0 for t in range(600, 2001, 100)}}, "a")
    feed(first)
    # The latest sample is at 2000 s, the watermark at 1600 s.
    got = feed(samples_of(spark, {"m0": {1590: 50.0, 1599: 60.0, 1610: 70.0}}, "a"))
    feed(samples_of(spark, {"m0": {t: 1.0 for t in range(2100, 4000, 100)}}, "a"))
    got = feed(mark(spark))
    in_time = samples_of(spark, {"m0": {t: 1.0 for t in range(600, 4000, 100)} | {1610: 70.0}}, "a")
    want = {k: v for k, v in rows_of(primary_data(in_time, START, END, descriptor())).items() if k[1] == "m0"}
    assert rows_of(got) == want


def test_a_waiting_sample_is_replaced(spark, feed):
    feed(samples_of(spark, {"m0": {t: 1.0 for t in range(600, 1301, 100)}}, "a"))
    feed(samples_of(spark, {"m0": {1250: 9.0, 1300: 5.0}}, "a"))
    got = feed(mark(spark))
    final = samples_of(spark, {"m0": {t: 1.0 for t in range(600, 1201, 100)} | {1250: 9.0, 1300: 5.0}}, "a")
    want = {k: v for k, v in rows_of(primary_data(final, START, END, descriptor())).items() if k[1] == "m0"}
    assert rows_of(got) == want


def test_samples_without_a_name_time_or_value_are_left_out(spark, feed):
    odd = samples_of(spark, {"m0": {700: 1.0, 760: 2.0}}, "a")
    blanks = [odd.withColumn(c, F.lit(None).cast(odd.schema[c].dataType)) for c in ("resource", "metric", "ts_ms", "value")]
    for blank in blanks:
        odd = odd.unionByName(blank)
    feed(odd)
    got = feed(mark(spark))
    want = rows_of(primary_data(samples_of(spark, {"m0": {700: 1.0, 760: 2.0}}, "a"), START, END, descriptor()))
    assert rows_of(got) == {k: v for k, v in want.items() if k[1] == "m0"}


def test_setting_is_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with with_rocks_db(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name, None) == before
    assert hours(1) > DELAY


@pytest.mark.parametrize("groups", [1, 3])
def test_series_of_a_group_share_calls_and_state(spark, tmp_path, groups):
    """Series that begin, pause and end apart, in fewer groups than series: each as in a batch of its own."""
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spans = {"a": (600, 4000), "b": (600, 1000), "c": (2500, 2600), "d": (900, 3900)}
    samples = None
    for place, (resource, (first, last)) in enumerate(spans.items()):
        own = samples_of(spark, {"m0": {t: float(t % 7 + place) for t in range(first, last, 90)}, "m1": {first: 1.0, last: 2.0}}, resource)
        samples = own if samples is None else samples.unionByName(own)
    samples = samples.cache()
    parts = [samples.where(F.col("ts_ms").between(1_500_000 * k, 1_500_000 * (k + 1) - 1)) for k in range(3)]
    for part in [*parts, mark(spark)]:
        part.select("resource", "ts_ms", "metric", "metric_type", "value", "attributes").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SAMPLE_SCHEMA).parquet(source)
        run_available(stream_primary_data(stream, START, END, descriptor(), DELAY, groups), sink, state)
        keys = spark.read.format("statestore").option("path", state).option("stateVarName", "group").load().count() if part is not parts[0] else 1
        assert 0 < keys <= groups
    got = spark.read.schema("resource string, ts_ms long, metric string, heartbeat_ms long, value double").parquet(sink)
    want = rows_of(primary_data(samples, START, END, descriptor()))
    assert rows_of(got) == want and got.count() == len(want) == 8 // 2 * 3 * 51
