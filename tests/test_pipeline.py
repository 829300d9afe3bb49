import math

import pytest
from pyspark.sql import functions as F

from helpers import BASE, samples_of, same, table_of
from tideline.functions.values import AVERAGE, MAX, MIN, Aggregation, add, collection_aggregation, vectorized
from tideline.model import ResultDescriptor
from tideline.operators.consolidate import primary_data
from tideline.operators.rate import rate
from tideline.operators.rollup import roll_up
from tideline.plans.measurements import process, select_measurements

NAN = math.nan
START, END, HOUR = (BASE + 3600) * 1000, (BASE + 7200) * 1000, 3_600_000
COUNTS = {BASE + 300 * i: 3000 * (i + 1) for i in range(25)}
LEVELS = {BASE + 300 * i: (1 if i <= 6 or 13 <= i <= 18 else 3) for i in range(25)}
STEP = ResultDescriptor(300_000)


def test_rollup_average_min_max(spark):
    values = {1: 1, **{t: 1 for t in range(300, 1800, 300)}, **{t: 3 for t in range(1800, 3600, 300)}}
    primary = spark.createDataFrame(
        [("localhost", ts * 1000, "m0", float(v)) for ts, v in values.items()],
        "resource string, ts_ms bigint, metric string, value double",
    )
    d = STEP
    for label, fn in (("m0-avg", AVERAGE), ("m0-min", MIN), ("m0-max", MAX)):
        d = d.datasource(label, "m0", fn, heartbeat_ms=600_000)
    rows = roll_up(primary, 1000, 3_300_000, d, HOUR).collect()
    same(
        table_of(rows, "label"),
        {
            0: {"m0-avg": NAN, "m0-min": NAN, "m0-max": NAN},
            3600: {"m0-avg": 2.0, "m0-min": 1.0, "m0-max": 3.0},
        },
    )


def test_resolution_must_be_a_multiple_of_the_step(spark):
    with pytest.raises(ValueError, match="multiple"):
        process(samples_of(spark, {"m0": {0: 1}}), 0, 1, STEP.datasource("m0"), 400_000)


@pytest.mark.parametrize("hot_rows", [None, 1, 7])
@pytest.mark.parametrize("with_attributes", [False, True])
def test_calculated(spark, hot_rows, with_attributes):
    d = STEP.datasource("m0").datasource("m1").calculate("total", add, "m0", "m1").export("total")
    samples = samples_of(spark, {"m0": COUNTS, "m1": COUNTS}, kind="COUNTER", attributes={"a": "b"})
    out = process(samples, START, END, d, HOUR, hot_rows=hot_rows, with_attributes=with_attributes)
    rows = out.collect()
    same(table_of(rows, "label"), {BASE + 3600: {"total": 20.0}, BASE + 7200: {"total": 20.0}})
    if with_attributes:
        assert [r["attributes"] for r in rows] == [None, None]


def test_counter_rate(spark):
    d = STEP.datasource("m0").export("m0")
    rows = process(samples_of(spark, {"m0": COUNTS}, kind="COUNTER"), START, END, d, HOUR).collect()
    same(table_of(rows, "label"), {BASE + 3600: {"m0": 10.0}, BASE + 7200: {"m0": 10.0}})


def test_gauge_average(spark):
    d = STEP.datasource("m0-avg", "m0", heartbeat_ms=600_000).export("m0-avg")
    out = process(samples_of(spark, {"m0": LEVELS}), START, END, d, HOUR)
    same(table_of(out.collect(), "label"), {BASE + 3600: {"m0-avg": 2.0}, BASE + 7200: {"m0-avg": 2.0}})


def test_stages_give_what_the_pipeline_gives(spark):
    d = STEP.datasource("m0-avg", "m0", heartbeat_ms=600_000).datasource("m0-max", "m0", MAX, 900_000)
    d = d.export("m0-avg", "m0-max")
    samples = samples_of(spark, {"m0": LEVELS, "other": COUNTS}, attributes={"k": "v"})
    whole = process(samples, START, END, d, HOUR, with_attributes=True)
    primary = primary_data(rate(samples, ["m0"]), START - HOUR, END, d, with_attributes=True)
    staged = roll_up(primary, START, END, d, HOUR, with_attributes=True)
    key = lambda r: (r["ts_ms"], r["label"], r["value"], r["attributes"])
    assert sorted(map(key, whole.collect())) == sorted(map(key, staged.select(whole.columns).collect()))
    assert all(r["attributes"] == {"k": "v"} for r in whole.collect())


def test_unknown_export_is_nan(spark):
    d = STEP.datasource("m0").export("m0", "nope")
    rows = process(samples_of(spark, {"m0": LEVELS}), START, END, d, HOUR).collect()
    table = table_of(rows, "label")
    assert all(math.isnan(cells["nope"]) for cells in table.values())
    assert {ts: cells["m0"] for ts, cells in table.items()} == {BASE + 3600: 2.0, BASE + 7200: 2.0}


def test_absent_source_and_absent_resource_are_nan(spark):
    d = STEP.datasource("m0").datasource("gone").export("gone", "m0")
    resources = spark.createDataFrame([("localhost",), ("silent",)], "resource string")
    rows = select_measurements(
        samples_of(spark, {"m0": LEVELS}), resources, d, HOUR, START, END, with_attributes=True
    ).collect()
    assert len(rows) == 2 * 2 * 2
    for r in rows:
        known = r["resource"] == "localhost" and r["label"] == "m0"
        assert (r["value"] == 2.0) if known else math.isnan(r["value"])


def test_custom_functions(spark):
    spread = Aggregation("SPREAD", lambda v: F.max(v) - F.min(v))
    count = collection_aggregation("COUNT", len)
    d = (
        STEP.datasource("spread", "m0", spread)
        .datasource("count", "m0", count)
        .calculate("scaled", vectorized(lambda a, b: a * b), "spread", "2.5")
        .calculate("again", add, "scaled", "1d")
        .export("spread", "count", "scaled", "again")
    )
    rows = process(samples_of(spark, {"m0": LEVELS}), START, END, d, HOUR).collect()
    expected = {"spread": 2.0, "count": 12.0, "scaled": 5.0, "again": 6.0}
    same(table_of(rows, "label"), {BASE + 3600: expected, BASE + 7200: expected})


def test_missing_argument_fails_early(spark):
    d = STEP.datasource("m0").calculate("x", add, "m0", "m9").export("x")
    with pytest.raises(ValueError, match="Missing measurement"):
        process(samples_of(spark, {"m0": LEVELS}), START, END, d, HOUR)


def test_coverage_needs_more_than_xff(spark):
    # Ends half way through the second bucket: 6 of its 12 intervals exist, all at level 1.
    end = (BASE + 3600 + 1800) * 1000
    for xff, expected in ((0.5, NAN), (0.49, 1.0)):
        d = STEP.datasource("m0", "m0", MAX, xff=xff).export("m0")
        rows = process(samples_of(spark, {"m0": LEVELS}), START, end, d, HOUR).collect()
        same(table_of(rows, "label"), {BASE + 3600: {"m0": 3.0}, BASE + 7200: {"m0": expected}})


def test_attribute_merge_takes_the_latest_writer(spark):
    rows = [
        ("r", 100_000, "m", "GAUGE", 1.0, {"a": "1", "b": "1"}),
        ("r", 200_000, "m", "GAUGE", 1.0, {"a": "2"}),
        ("r", 500_000, "m", "GAUGE", 1.0, {"c": "3"}),
        ("r", 800_000, "m", "GAUGE", 1.0, None),
    ]
    samples = spark.createDataFrame(
        rows, "resource string, ts_ms bigint, metric string, metric_type string, value double, attributes map<string,string>"
    )
    d = STEP.datasource("m")
    primary = primary_data(samples, 300_000, 900_000, d, with_attributes=True)
    found = {r["ts_ms"]: r["attributes"] for r in primary.collect()}
    # The sample at 500 s also covers the rest of the first interval.
    assert found == {300_000: {"a": "2", "b": "1", "c": "3"}, 600_000: {"c": "3"}, 900_000: {}}
    rolled = roll_up(primary, 300_000, 900_000, d.export("m"), 900_000, with_attributes=True)
    found = {r["ts_ms"]: r["attributes"] for r in rolled.collect()}
    assert found == {0: None, 900_000: {"a": "2", "b": "1", "c": "3"}}


def test_rate_rules(spark):
    samples = samples_of(
        spark, {"c": {0: 100, 300: 400, 600: 1000, 900: 1600}}, kind="COUNTER"
    ).unionByName(samples_of(spark, {"g": {0: 5, 600: 7}}))
    got = table_of(rate(samples).collect(), "metric")
    same(
        got,
        {0: {"c": NAN, "g": 5.0}, 300: {"c": 1.0}, 600: {"c": 2.0, "g": 7.0}, 900: {"c": 2.0}},
    )
    for hot_rows in (None, 1, 3):
        strict = table_of(rate(samples, strict_adjacency=True, hot_rows=hot_rows).collect(), "metric")
        same(strict, {0: {"c": NAN, "g": 5.0}, 300: {"c": 1.0}, 600: {"c": 2.0}, 900: {"c": 2.0}})


@pytest.mark.parametrize(
    "mode,expected", [("raw", -100.0), ("nan", NAN), ("wrap32", 2**32 - 100.0)]
)
def test_counter_resets(spark, mode, expected):
    samples = samples_of(spark, {"c": {0: 100, 1: 0}}, kind="COUNTER")
    got = table_of(rate(samples, counter_reset=mode).collect(), "metric")
    same(got, {0: {"c": NAN}, 1: {"c": expected}})
    derive = samples_of(spark, {"c": {0: 100, 1: 0}}, kind="DERIVE")
    assert table_of(rate(derive, counter_reset=mode).collect(), "metric")[1]["c"] == -100.0


@pytest.mark.parametrize("kind", ["decimal(20,0)", "decimal(22,2)"])
def test_64_bit_counters_wrap_exactly(spark, kind):
    samples = samples_of(spark, {"c": {0: 0, 1: 0}}, kind="COUNTER")
    near_the_end = F.when(F.col("ts_ms") > 0, F.lit("50")).otherwise(F.lit(str(2**64 - 50))).cast(kind)
    same(table_of(rate(samples.withColumn("value", near_the_end), counter_reset="wrap64").collect(), "metric"), {0: {"c": NAN}, 1: {"c": 100.0}})
    signed = samples.withColumn("value", F.when(F.col("ts_ms") > 0, F.lit(-5)).otherwise(F.lit(2**63 - 1)).cast("bigint"))
    same(table_of(rate(signed, counter_reset="wrap64").collect(), "metric"), {0: {"c": NAN}, 1: {"c": float(2**63 - 4)}})
    with pytest.raises(ValueError, match="wrap64"):
        rate(samples, counter_reset="wrap64")


def test_rate_within_a_second_is_unknown(spark):
    samples = samples_of(spark, {"c": {1000: 1, 1900: 5, 2100: 9}}, kind="COUNTER", unit=1)
    got = table_of(rate(samples).collect(), "metric", unit=1)
    same(got, {1000: {"c": NAN}, 1900: {"c": NAN}, 2100: {"c": 4.0}})


def test_unknown_type_is_refused(spark):
    with pytest.raises(Exception, match="unknown metric type"):
        rate(samples_of(spark, {"c": {0: 1}}, kind="HISTOGRAM")).collect()


def test_decimal_counters_are_differenced_exactly(spark):
    big = 2**63
    samples = samples_of(spark, {"c": {0: 0, 60: 0}}, kind="COUNTER")
    exact = F.when(F.col("ts_ms") > 0, F.lit(str(big + 60))).otherwise(F.lit(str(big))).cast("decimal(20,0)")
    for hot_rows in (None, 1):
        got = table_of(rate(samples.withColumn("value", exact), hot_rows=hot_rows).collect(), "metric")
        same(got, {0: {"c": NAN}, 60: {"c": 1.0}})
