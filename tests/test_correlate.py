import math

import pytest

from helpers import samples_of
from tideline.model import CorrelationRequest, JobConfig, Metric
from tideline.operators import correlate as ops
from tideline.plans.correlation import answer, correlate, correlate_catalog, correlate_known, run_job, score
from tideline.sources import catalog as cat
from tideline.sources import results
from tideline.sources.requests import candidates_from_json, candidates_from_list
from tideline.sources.samples import upsert_samples, write_samples

SERIES = {
    "m1": {t: 5 for t in range(10)},
    "m2": {t: (t + 1) % 2 for t in range(10)},
    "m3": {t: t for t in range(10)},
    "m4": {t: 1 if t in (2, 5, 8) else 0 for t in range(10)},
    "m5": {t: 0 for t in range(10)},
}
REQUEST = CorrelationRequest(Metric("a", "m1"), 0, 10, 1, 1)


@pytest.fixture(scope="module")
def samples(spark):
    return samples_of(spark, SERIES, resource="a", unit=1, attributes={"metric": "true"}).cache()


def pairs(rows):
    return [(r["metric"], r["coefficient"]) for r in rows]


def test_best_of_the_catalog(spark, samples):
    index = cat.index_samples(samples)
    found = cat.match_term(index, "metric", "true")
    assert sorted(r["metric"] for r in found.collect()) == sorted(SERIES)
    best = correlate_known(samples, REQUEST, found).collect()
    assert [r["metric"] for r in best] == ["m2"]

    everyone = CorrelationRequest(Metric("a", "m1"), 0, 10, 1, 10)
    ranked = pairs(correlate_known(samples, everyone, found).collect())
    assert [m for m, _ in ranked] == ["m2", "m4", "m3"]
    assert [round(abs(c), 4) for _, c in ranked] == [0.6864, 0.6124, 0.4841]
    for hot_rows in (1, 3):
        split = pairs(correlate_known(samples, everyone, found, hot_rows=hot_rows).collect())
        assert [m for m, _ in split] == [m for m, _ in ranked]
        assert all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(split, ranked))


def test_propagated_nan(spark, samples):
    got = correlate(samples, REQUEST, [Metric("a", "m2")]).collect()
    assert len(got) == 1 and got[0]["metric"] == "m2" and math.isnan(got[0]["coefficient"])


def test_series_without_samples(spark):
    empty = samples_of(spark, {"x": {0: 1}}).where("false")
    request = CorrelationRequest(Metric("a.b", "m"), 0, 10, 1, 10)
    got = correlate(empty, request, [Metric("a.c", "n")]).collect()
    assert [(r["resource"], r["metric"]) for r in got] == [("a.c", "n")]
    assert math.isnan(got[0]["coefficient"])


def test_target_is_no_candidate_and_repeats_stay(spark, samples):
    request = CorrelationRequest(Metric("a", "m1"), 0, 10, 1, 10)
    wanted = [Metric("a", m) for m in ("m3", "m1", "m2", "m3")]
    got = correlate_known(samples, request, wanted).collect()
    assert [r["metric"] for r in got] == ["m2", "m3", "m3"]


def test_no_candidates(spark, samples):
    assert correlate_known(samples, REQUEST, cat.no_metrics(spark)).collect() == []
    assert correlate_known(samples, REQUEST, []).collect() == []


def test_top_n_is_a_prefix_and_ties_keep_list_order(spark):
    scored = spark.createDataFrame(
        [("r", "a", 0.5), ("r", "b", -0.5), ("r", "c", math.nan), ("r", "d", 0.9)],
        "resource string, metric string, coefficient double",
    )
    listed = candidates_from_list(spark, [Metric("r", m) for m in "bacd"])
    full = [r["metric"] for r in ops.top_candidates(listed, scored, 10).collect()]
    assert full == ["c", "d", "b", "a"]
    for n in range(5):
        assert [r["metric"] for r in ops.top_candidates(listed, scored, n).collect()] == full[:n]


def test_shuffled_target_gives_the_same(spark, samples, monkeypatch):
    request = CorrelationRequest(Metric("a", "m1"), 0, 10, 1, 10)
    others = [Metric("a", m) for m in SERIES]
    broadcast = pairs(correlate_known(samples, request, others).collect())
    monkeypatch.setattr(ops, "BROADCAST_MAX_BUCKETS", 0)
    plan = score(samples, request, candidates_from_list(spark, others), "zero")
    assert pairs(correlate_known(samples, request, others).collect()) == broadcast
    assert plan.count() == len(SERIES)


def test_negative_and_perfect(spark):
    series = {"x": {t: t * t for t in range(0, 100)}, "up": {}, "down": {}}
    series["up"] = {t: 3 * v + 1 for t, v in series["x"].items()}
    series["down"] = {t: -2 * v for t, v in series["x"].items()}
    request = CorrelationRequest(Metric("localhost", "x"), 10, 99, 1, 5)
    data = samples_of(spark, series, unit=1)
    got = dict(pairs(correlate_known(data, request, [Metric("localhost", m) for m in ("up", "down")]).collect()))
    assert abs(got["up"] - 1) < 1e-12 and abs(got["down"] + 1) < 1e-12


def test_job_reads_the_samples_table(spark, samples, tmp_path):
    path = str(tmp_path / "samples")
    write_samples(samples.selectExpr("*", "1L AS seq"), path)
    upsert_samples(spark, path, samples.where("metric = 'm1' AND ts_ms = 9").selectExpr("*", "2L AS seq"))
    config = {
        "metric": {"resource": "a", "metric": "m1"},
        "candidates": [{"resource": "a", "metric": m} for m in ("m2", "m4")],
        "from": 0,
        "to": 10,
        "resolution": 1,
        "topN": 10,
    }
    spark.conf.set("spark.tideline.samples.path", path)
    got = run_job(spark, config, nan_policy="zero", drop_nan=True).collect()
    assert [r["metric"] for r in got] == ["m2", "m4"]
    spark.conf.unset("spark.tideline.samples.path")
    with pytest.raises(ValueError, match="samples.path"):
        run_job(spark, config)
    with pytest.raises(ValueError, match="candidates"):
        JobConfig.parse({k: v for k, v in config.items() if k != "candidates"})
    with pytest.raises(ValueError, match="metric.resource"):
        JobConfig.parse({**config, "metric": {"metric": "m1"}})
    dotted = {**config, "metric.resource": "a", "metric.metric": "m1"}
    assert JobConfig.parse(dotted) == JobConfig.parse(config)


def test_mandatory_parameters():
    for missing in ("resource", "metric", "resolution_ms", "top_n"):
        given = {"resource": "r", "metric": "m", "resolution_ms": 1, "top_n": 3, missing: None}
        with pytest.raises(ValueError, match="Missing mandatory parameter"):
            CorrelationRequest.of(**given)
    request = CorrelationRequest.of("r", "m", 60_000, now=100_000_000)
    assert (request.start_ms, request.end_ms, request.top_n) == (13_600_000, 100_000_000, 10)


def test_answer(spark, samples):
    index = cat.index_samples(samples_of(spark, SERIES, resource="a", unit=1, attributes={"kind": "snmp"}))
    by_catalog = answer(samples, "a", "m1", 1, 1, 0, 10, catalog=index).collect()
    assert [r["metric"] for r in by_catalog] == ["m2"]
    bodies = spark.createDataFrame([('[{"resource":"a","metric":"m4"},{"resource":"a","metric":"m3"}]',)], "body string")
    by_body = answer(samples, "a", "m1", 1, 10, 0, 10, candidates=candidates_from_json(bodies)).collect()
    assert [r["metric"] for r in by_body] == ["m4", "m3"]
    with pytest.raises(ValueError):
        answer(samples, "a", None, 1, catalog=index)
    assert correlate_catalog(samples, REQUEST, cat.index_samples(samples)).collect() == []


def test_result_json_round_trip(spark):
    rows = spark.createDataFrame([("a", "b", 0.15), ("c", "d", math.nan)], results.RESULT_SCHEMA)
    text = [r["json"] for r in results.to_json(rows).collect()]
    assert text[0] == '{"resource":"a","metric":"b","coefficient":0.15}'
    back = results.from_json(results.to_json(rows)).collect()
    assert tuple(back[0]) == ("a", "b", 0.15) and math.isnan(back[1]["coefficient"])
    shuffled = spark.createDataFrame([('{"metric":"b","coefficient":0.15,"resource":"a"}',)], "json string")
    assert tuple(results.from_json(shuffled).first()) == ("a", "b", 0.15)
