import math

import pytest

from helpers import BASE, samples_of, same, table_of
from tideline.model import ResultDescriptor
from tideline.operators.consolidate import primary_data

NAN = math.nan


def descriptor(step, heartbeat=None, names=("m0", "m1")):
    d = ResultDescriptor(step * 1000)
    for name in names:
        d = d.datasource(name, heartbeat_ms=None if heartbeat is None else heartbeat * 1000)
    return d


def pair(points):
    """{ts: (m0, m1)} to metric -> {ts: value}, None where there is no sample."""
    return {
        f"m{i}": {ts: v[i] for ts, v in points.items() if v[i] is not None} for i in (0, 1)
    }


def cells(points):
    return {ts: {"m0": float(a), "m1": float(b)} for ts, (a, b) in points.items()}


SHORT = {0: (0, 1), 250: (1, 2), 550: (2, 3), 850: (3, 4)}
SHORT_VALUES = {300: (1 + 1 / 6, 2 + 1 / 6), 600: (2 + 1 / 6, 3 + 1 / 6), 900: (3, 4)}

CASES = {
    "leading_samples_miss": (
        {BASE + 600: (1, 1), BASE + 900: (2, 2), BASE + 1200: (3, 3)},
        (300, 600, BASE, BASE + 1200),
        {
            BASE: (NAN, NAN),
            BASE + 300: (NAN, NAN),
            BASE + 600: (1, 1),
            BASE + 900: (2, 2),
            BASE + 1200: (3, 3),
        },
    ),
    "short_samples": (SHORT, (300, 600, 300, 900), SHORT_VALUES),
    "very_short_samples": (
        SHORT,
        (300, 600, 300, 1500),
        {**SHORT_VALUES, 1200: (NAN, NAN), 1500: (NAN, NAN)},
    ),
    "skipped_sample": (
        {0: (0, 1), 250: (1, 2), 550: (None, 3), 840: (3, 4)},
        (300, 600, 300, 900),
        {300: (4 / 3, 2 + 1 / 6), 600: (3, 3 + 1 / 6), 900: (3, 4)},
    ),
    "many_to_one": (
        {300 * i: (i, i + 1) for i in range(8)},
        (900, 1800, 900, 1800),
        {900: (2, 3), 1800: (5, 6)},
    ),
    "one_to_one": (
        {300 * i: (i, i + 1) for i in range(4)},
        (300, 600, 300, 900),
        {300: (1, 2), 600: (2, 3), 900: (3, 4)},
    ),
    "one_to_many": (
        {0: (0, 1), 900: (1, 2), 1800: (2, 3)},
        (300, 1000, 300, 1800),
        {t: ((1, 2) if t <= 900 else (2, 3)) for t in range(300, 2100, 300)},
    ),
    "long_samples": (
        {0: (0, 1), 350: (1, 2), 650: (2, 3), 950: (3, 4)},
        (300, 600, 300, 900),
        {300: (1, 2), 600: (1 + 5 / 6, 2 + 5 / 6), 900: (2 + 5 / 6, 3 + 5 / 6)},
    ),
    "heartbeat_two": (
        {0: (0, 1), 300: (1, 2), 600: (2, None), 900: (3, 4)},
        (300, 601, 300, 900),
        {300: (1, 2), 600: (2, 4), 900: (3, 4)},
    ),
}


@pytest.mark.parametrize("hot_rows", [None, 1, 3])
@pytest.mark.parametrize("name", CASES)
def test_intervals(spark, name, hot_rows):
    points, (step, heartbeat, start, end), expected = CASES[name]
    rows = primary_data(
        samples_of(spark, pair(points)), start * 1000, end * 1000, descriptor(step, heartbeat), hot_rows=hot_rows
    ).collect()
    same(table_of(rows, "metric"), cells(expected))


def test_heartbeat_one_sample(spark):
    rows = primary_data(
        samples_of(spark, {"m1": {0: 1, 300: 2, 900: 4}}),
        300_000,
        900_000,
        descriptor(300, 601, ["m1"]),
    ).collect()
    same(table_of(rows, "metric"), {300: {"m1": 2.0}, 600: {"m1": 4.0}, 900: {"m1": 4.0}})


def test_heartbeat_is_strict(spark):
    rows = primary_data(
        samples_of(spark, {"m1": {0: 1, 300: 2, 900: 4}}),
        300_000,
        900_000,
        descriptor(300, 300, ["m1"]),
    ).collect()
    assert all(math.isnan(r["value"]) for r in rows)


def test_default_heartbeat_on_unrated_counters(spark):
    points = {BASE + 300 * i: 3000 * (i + 1) for i in range(25)}
    rows = primary_data(
        samples_of(spark, {"m0": points, "m1": points}, kind="COUNTER"),
        (BASE + 3600) * 1000,
        (BASE + 7200) * 1000,
        descriptor(300),
    ).collect()
    expected = {BASE + 300 * i: {"m0": 3000.0 * (i + 1), "m1": 3000.0 * (i + 1)} for i in range(12, 25)}
    same(table_of(rows, "metric"), expected)
