"""Aggregations in Python by states that merge, however a bucket is split."""

import math
import random

import pytest

from helpers import BASE, samples_of, table_of
from tideline.functions.values import AVERAGE, MAX, collection_aggregation, merged_states, mergeable_aggregation, partial_states
from tideline.model import ResultDescriptor
from tideline.plans.measurements import process

GEOMETRIC = mergeable_aggregation(
    "GEOMETRIC",
    lambda: [0.0, 0.0],
    lambda s, v: [s[0] + len(v), s[1] + sum(map(math.log, v))],
    lambda a, b: [a[0] + b[0], a[1] + b[1]],
    lambda s: math.exp(s[1] / s[0]),
    skips_unknown=True,
)
ROWS = mergeable_aggregation("ROWS", lambda: [0.0], lambda s, v: [s[0] + len(v)], lambda a, b: [a[0] + b[0]], lambda s: s[0])


@pytest.mark.parametrize("held", [1, 50, None])
@pytest.mark.parametrize("partitions", [1, 7])
def test_a_split_bucket_is_merged(spark, partitions, held):
    """One large bucket over all partitions among small ones, with unknown values, a bucket of nothing else, and a null key."""
    rng = random.Random(1)
    rows = [("hot", rng.uniform(1, 9)) for _ in range(3000)] + [(f"b{i % 40}", rng.uniform(1, 9)) for i in range(400)]
    rows += [("hot", math.nan)] * 30 + [("none", math.nan), ("none", None), (None, 2.0), (None, 8.0)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "bucket string, value double").repartition(partitions)
    functions = {0: GEOMETRIC, 3: ROWS}
    partial = partial_states(frame, ["bucket"], functions, held)
    if held is None:
        # What is exchanged: a state per bucket, function and task, not a row per value.
        assert partial.count() <= partitions * 2 * 43
    got = {r["bucket"]: (r["_fn0"], r["_fn3"]) for r in merged_states(partial, ["bucket"], functions).collect()}
    assert len(got) == 43
    for bucket, (mean, count) in got.items():
        values = [v for b, v in rows if b == bucket]
        known = [v for v in values if v is not None and not math.isnan(v)]
        assert count == len(values)
        assert mean == pytest.approx(math.exp(sum(map(math.log, known)) / len(known))) if known else mean is None or math.isnan(mean)


@pytest.mark.parametrize("with_attributes", [False, True])
def test_beside_other_functions(spark, with_attributes):
    """In one descriptor with a built-in function and one that gathers; the exchange carries states."""
    samples = samples_of(spark, {"m0": {BASE + 300 * i: float(1 + i % 5) for i in range(40)}, "m1": {BASE: 1.0}})
    gathered = collection_aggregation("GATHERED", lambda v: math.exp(sum(map(math.log, v)) / len(v)), skips_unknown=True)
    d = ResultDescriptor(300_000).datasource("avg", "m0").datasource("geo", "m0", GEOMETRIC).datasource("also", "m0", gathered)
    d = d.datasource("max", "m0", MAX).datasource("rows", "m0", ROWS).datasource("avg1", "m1", AVERAGE).datasource("geo1", "m1", GEOMETRIC)
    rows = process(samples, (BASE + 3600) * 1000, (BASE + 10800) * 1000, d.export("avg", "geo", "also", "max", "rows", "avg1", "geo1"), 3_600_000, with_attributes=with_attributes)
    for ts, cells in table_of(rows.collect(), "label").items():
        assert cells["rows"] == 12.0 and math.isnan(cells["geo1"]) == math.isnan(cells["avg1"])
        assert (math.isnan(cells["geo"]) and math.isnan(cells["also"])) or cells["geo"] == pytest.approx(cells["also"]), ts
    assert "mapInArrow" in rows._jdf.queryExecution().optimizedPlan().toString() or "MapInArrow" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_no_expression(spark):
    with pytest.raises(TypeError, match="GEOMETRIC"):
        GEOMETRIC(spark.range(1)["id"])
