"""Resources without data in the requested range come out unknown, whatever the size of the request."""

import math

import pytest

from tideline.functions.values import AVERAGE
from tideline.model import ResultDescriptor
from tideline.operators import rollup


@pytest.mark.parametrize("with_attributes", [False, True])
@pytest.mark.parametrize("resource_rows", [100_000, 0])
def test_resource_outside_the_range(spark, monkeypatch, resource_rows, with_attributes):
    monkeypatch.setattr(rollup, "RESOURCE_ROWS", resource_rows)
    descriptor = ResultDescriptor(step_ms=300_000).datasource("m", "m", AVERAGE).export("m")
    rows = [("a", "m", ts, 1.0, {"k": "v"}) for ts in range(300_000, 3_900_000, 300_000)]
    rows += [("b", "m", 90_000_000, 2.0, {"k": "v"})]
    primary = spark.createDataFrame(rows, "resource string, metric string, ts_ms long, value double, attributes map<string, string>")
    found = rollup.roll_up(primary, 900_000, 2_700_000, descriptor, 900_000, with_attributes=with_attributes).collect()
    values = {(r.resource, r.ts_ms): r.value for r in found}
    assert len(found) == len(values) == 6 and {r for r, _ in values} == {"a", "b"}
    assert all(math.isnan(v) == (r == "b") for (r, _), v in values.items())
