"""The pruned search for the best candidates against the full one."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import samples_of
from tideline.model import CorrelationRequest, Metric
from tideline.operators.spectrum import bounds, of_grid
from tideline.plans.correlation import correlate_known, score
from tideline.plans.pruned import candidates_left, correlate_pruned, read_spectra, request_grid, series_spectra, write_spectra

STEP, END = 10_000, 1_200_000
SERIES_COUNT = 60


def walks(rng):
    """Slow walks, waves alike up to scale, noise, constants, and gaps."""
    out = {}
    for i in range(SERIES_COUNT):
        value, points = 0.0, {}
        for t in range(0, END // 1000, 5):
            value += rng.gauss(0, 1)
            points[t] = value
        out[f"walk{i}"] = points
    wave = {t: math.sin(t / 90) for t in range(0, END // 1000, 5)}
    out["target"] = wave
    for i, scale in enumerate((2.0, 4.0, -2.0, -8.0)):
        out[f"tie{i}"] = {t: v * scale for t, v in wave.items()}
    out["offset"] = {t: 1e9 + v for t, v in wave.items()}
    out["noise"] = {t: rng.gauss(0, 1) for t in wave}
    out["constant"] = dict.fromkeys(wave, 3.0)
    out["half"] = {t: v for t, v in wave.items() if t < 600}
    out["once"] = {0: 1.0}
    return out


@pytest.fixture(scope="module")
def samples(spark):
    return samples_of(spark, walks(random.Random(11))).repartition(4).cache()


def request_of(target="target", top_n=5, **changed):
    return CorrelationRequest(Metric("localhost", target), **({"start_ms": 0, "end_ms": END, "resolution_ms": STEP, "top_n": top_n} | changed))


@pytest.fixture(scope="module")
def stored(spark, samples, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("spectra"))
    write_spectra(series_spectra(samples, samples.select("resource", "metric").distinct(), request_of()), path)
    # A second grid beside the first does not disturb it.
    write_spectra(series_spectra(samples, samples.select("resource", "metric").distinct(), request_of(end_ms=END // 2), 2), path, "append")
    return read_spectra(spark, path)


def rows(frame):
    return [tuple(r) for r in frame.collect()]


@pytest.mark.parametrize("top_n", [0, 1, 2, 4, 7, 200])
@pytest.mark.parametrize("target", ["target", "walk3", "noise", "constant", "nobody"])
def test_same_as_the_full_search(spark, samples, stored, target, top_n):
    """Ties at the last place, undefined coefficients, more places than candidates, repeated and absent candidates."""
    listed = samples.select("resource", "metric").distinct()
    extra = spark.createDataFrame([("localhost", "tie1"), ("localhost", "absent"), ("elsewhere", "tie1")], "resource string, metric string")
    candidates = listed.unionByName(extra)
    request = request_of(target, top_n)
    assert rows(correlate_pruned(samples, stored, request, candidates)) == rows(correlate_known(samples, request, candidates))


def test_list_order_decides_ties(spark, samples, stored):
    names = ["tie3", "walk1", "tie0", "tie2", "tie1", "half"]
    listed = [Metric("localhost", n) for n in names]
    got = rows(correlate_pruned(samples, stored, request_of(top_n=3), listed))
    assert got == rows(correlate_known(samples, request_of(top_n=3), listed))


@pytest.mark.parametrize("target", ["target", "walk3", "noise", "offset"])
def test_coefficients_lie_within_their_bounds(samples, stored, target):
    keys = samples.select("resource", "metric").distinct()
    on_grid = of_grid(stored, request_grid(request_of()))
    bounded = bounds(on_grid, on_grid.where(F.col("metric") == target))
    scored = score(samples, request_of(target), keys, "zero", drop_nan=True)
    both = bounded.join(scored, ["resource", "metric"]).collect()
    assert len(both) >= SERIES_COUNT
    for r in both:
        assert r["lower"] <= abs(r["coefficient"]) + 1e-12 and abs(r["coefficient"]) <= r["upper"] + 1e-12, r


def test_few_candidates_are_read(samples, stored):
    """How many are verified: the ties and what comes near them, not the noise; constants never."""
    keys = samples.select("resource", "metric").distinct().where("metric <> 'target'")
    left = {r["metric"] for r in candidates_left(stored, request_of(top_n=4), keys).collect()}
    assert {"tie0", "tie1", "tie2", "tie3"} <= left and "constant" not in left and "noise" not in left
    assert len(left) <= 6 < keys.count()
    assert candidates_left(stored, request_of("constant"), keys).count() == 0


def test_spectra_of_rows_left_out_are_those_of_zeros(spark, samples):
    from tideline.operators.spectrum import spectra

    grid = request_grid(request_of())
    values = {t: (0.0 if i % 3 else float(i)) for i, t in enumerate(range(grid.lo, grid.hi + 1, grid.step))}
    dense = spark.createDataFrame([("r", "m", t, v) for t, v in values.items()], "resource string, metric string, ts_ms long, value double")
    a, b = spectra(dense, grid).first(), spectra(dense.where("value <> 0"), grid).first()
    assert max(abs(x - y) for x, y in zip(a["coefficients"], b["coefficients"])) < 1e-12 and len(a["coefficients"]) == 16
