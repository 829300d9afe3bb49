"""Fixture builders: samples from per-metric dictionaries, results as dictionaries."""

import math

import pyarrow as pa

BASE = 900_000_000


def samples_of(spark, series, resource="localhost", kind="GAUGE", unit=1000, attributes=None):
    """``series``: metric -> {timestamp: value}; ``unit``: ms per timestamp unit."""
    points = [(metric, ts * unit, float(v)) for metric, values in series.items() for ts, v in values.items()]
    entries = None if attributes is None else list(attributes.items())
    columns = {
        "resource": pa.array([resource] * len(points), pa.string()),
        "ts_ms": pa.array([ts for _, ts, _ in points], pa.int64()),
        "metric": pa.array([metric for metric, _, _ in points], pa.string()),
        "metric_type": pa.array([kind] * len(points), pa.string()),
        "value": pa.array([v for _, _, v in points], pa.float64()),
        "attributes": pa.array([entries] * len(points), pa.map_(pa.string(), pa.string())),
    }
    return spark.createDataFrame(pa.table(columns))


def table_of(rows, name, unit=1000):
    """{timestamp: {name: value}} of long rows."""
    out = {}
    for r in rows:
        out.setdefault(r["ts_ms"] // unit, {})[r[name]] = r["value"]
    return out


def same(actual, expected, tolerance=1e-8):
    assert actual.keys() == expected.keys(), (sorted(actual), sorted(expected))
    for ts, cells in expected.items():
        assert actual[ts].keys() == cells.keys(), (ts, actual[ts], cells)
        for name, value in cells.items():
            got = actual[ts][name]
            if math.isnan(value):
                assert math.isnan(got), (ts, name, got)
            else:
                assert abs(got - value) <= tolerance, (ts, name, got, value)
