"""Shapes of physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from tideline.functions.grid import hours
from tideline.model import CorrelationRequest, Metric, ResultDescriptor
from tideline.operators import neighbours
from tideline.operators.consolidate import primary_data
from tideline.operators.correlate import top_candidates
from tideline.operators.rate import rate
from tideline.plans.correlation import correlate, score
from tideline.plans.measurements import process
from tideline.sources.bucketed import read_bucketed, write_bucketed
from tideline.sources.requests import candidates_from_list
from tideline.sources.samples import SAMPLE_SCHEMA, touched_shards, write_samples


@pytest.fixture(scope="module")
def samples(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plan"))
    rows = [(f"r{i % 5}", i * 60_000, f"m{i % 3}", "GAUGE", float(i), None, i) for i in range(300)]
    write_samples(spark.createDataFrame(rows, SAMPLE_SCHEMA + ", seq bigint"), path)
    return spark.read.parquet(path)


@pytest.fixture
def static(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    """Hash exchanges, by the columns they distribute on."""
    found = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    return [", ".join(re.findall(r"(\w+)#", text)) for text in found]


REQUEST = CorrelationRequest(Metric("r0", "m0"), 0, hours(5), 300_000, 5)
DESCRIPTOR = ResultDescriptor(300_000).datasource("m0").datasource("m1").export("m1")


def test_process_shuffles_samples_once_and_intervals_once(spark, samples, static):
    resources = spark.createDataFrame([("r1",)], "resource string")
    plan = plan_of(process(samples, 0, hours(5), DESCRIPTOR, hours(1), resources=resources))
    assert sorted(exchanges(plan)) == ["resource, bucket_ms", "resource, metric"]
    assert "attributes" not in plan[plan.index("ReadSchema") :].split("\n")[0]
    assert re.search(r"PushedFilters: \[[^\]]*In\(metric, \[m0,m1\]\)", plan)


def scans(plan):
    return plan.count("FileScan parquet")


def test_hot_series_are_split_without_another_scan(spark, samples, static):
    resources = spark.createDataFrame([("r1",)], "resource string")
    plan = plan_of(process(samples, 0, hours(5), DESCRIPTOR, hours(1), resources=resources, hot_rows=10))
    found = exchanges(plan)
    # Samples go by chunk once, the summaries of chunks read that same exchange (which the
    # plan repeats where it is reused), and the carried rows go by chunk.
    assert found.count("resource, metric, _chunk") == 3
    assert len(re.findall(r"ReusedExchange [^\n]*_chunk[^\n]*REPARTITION_BY_COL", plan)) == 1
    assert found.count("resource, metric, bucket_ms") == 1 and found.count("resource, bucket_ms") == 1
    assert scans(plan) == 1
    assert scans(plan_of(process(samples, 0, hours(5), DESCRIPTOR, hours(1), resources=resources))) == 1


def test_ranges_reach_the_scan(spark, samples, static):
    resources = spark.createDataFrame([("r1",)], "resource string")
    plan = plan_of(primary_data(samples, hours(1), hours(2), DESCRIPTOR, resources=resources))
    pushed = re.search(r"PushedFilters: \[([^\]]*\)[^\]]*)", plan).group(1)
    assert "GreaterThanOrEqual(ts_ms" in pushed and "LessThanOrEqual(ts_ms" in pushed
    plan = plan_of(process(samples, hours(1), hours(2), DESCRIPTOR, hours(1), resources=resources))
    assert "LessThanOrEqual(ts_ms" in plan


def test_upserts_name_the_touched_shards(spark, samples, static):
    plan = plan_of(touched_shards(samples, [0, 600]))
    assert re.search(r"PartitionFilters: \[[^\]]*shard#\d+L? IN \(0,600\)", plan)


def test_correlation_reads_samples_once(spark, samples, static):
    """Candidates and target come from one pass, joined with their keys before the window, exchanged once for both."""
    catalog = samples.select("resource", "metric").distinct()
    plan = plan_of(score(samples, REQUEST, catalog, "zero"))
    assert "LeftSemi" in plan and plan.index("Window") < plan.index("LeftSemi")
    plan = plan_of(score(samples, REQUEST, candidates_from_list(spark, [Metric("r1", "m1")]), "zero"))
    assert scans(plan) == 1 and "ReusedExchange" in plan
    plan = plan_of(correlate(samples, REQUEST, [Metric("r1", "m1"), Metric("r2", "m0")], "zero"))
    assert plan.startswith("TakeOrderedAndProject")


def test_adaptive_correlation_reads_samples_once(spark, samples):
    """As run: of the stages, one scans the samples."""
    scored = score(samples, REQUEST, candidates_from_list(spark, [Metric("r1", "m1")]), "zero")
    assert len(scored.collect()) == 1
    final = plan_of(scored).split("Initial Plan")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final


def jobs_of(spark, run):
    """How many jobs a call starts."""
    context = spark.sparkContext
    context.setJobGroup("counted", "counted")
    try:
        run()
        return len(context.statusTracker().getJobIdsForGroup("counted"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_building_a_frame_starts_no_job(spark, samples):
    resources = spark.createDataFrame([("r1",)], "resource string")
    keys = candidates_from_list(spark, [Metric("r1", "m1")])
    assert jobs_of(spark, lambda: rate(samples)) == 0
    assert jobs_of(spark, lambda: rate(samples, strict_adjacency=True)) == 0
    assert jobs_of(spark, lambda: primary_data(samples, 0, hours(5), DESCRIPTOR)) == 0
    assert jobs_of(spark, lambda: process(samples, 0, hours(5), DESCRIPTOR, hours(1), resources=resources)) == 0
    assert jobs_of(spark, lambda: correlate(samples, REQUEST, keys, "zero")) == 0
    assert jobs_of(spark, lambda: rate(samples, hot_rows=10)) > 0


def test_large_inputs_are_counted(spark, samples, monkeypatch):
    monkeypatch.setattr(neighbours, "PLAIN_BYTES", 0)
    assert jobs_of(spark, lambda: rate(samples)) > 0
    assert neighbours.planned_bytes(samples) > 0


def test_bucketed_samples_are_looked_back_without_exchange_and_sort(spark, samples):
    write_bucketed(samples, "bucketed_samples", 4)
    try:
        stored = read_bucketed(spark, "bucketed_samples")
        plan = plan_of(rate(stored))
        below = plan[plan.index("Window") :]
        assert "Exchange" not in below and "Sort" not in below and "Bucketed: true" in below
        values = lambda rows: {(r["resource"], r["metric"], r["ts_ms"]): r["value"] for r in rows.collect()}
        counters = [rows.withColumn("metric_type", F.lit("DERIVE")) for rows in (stored, samples)]
        got, want = (values(rate(rows).where("NOT isnan(value)")) for rows in counters)
        assert got == want and len(want) == 285
    finally:
        spark.sql("DROP TABLE bucketed_samples")


def test_long_candidate_lists_are_spread(spark, samples):
    listed = [Metric(f"r{i}", "m1") for i in range(5000)]
    candidates = candidates_from_list(spark, listed)
    assert candidates.rdd.getNumPartitions() > 1 and candidates.count() == 5000
    rows = score(samples, REQUEST, candidates, "zero").collect()
    assert len(rows) == 5000


def test_unlisted_series_stay_out(spark, samples):
    rows = score(samples, REQUEST, candidates_from_list(spark, [Metric("r1", "m1")]), "zero").collect()
    assert [(r["resource"], r["metric"]) for r in rows] == [("r1", "m1")]


def test_ranking_keeps_no_full_sort(spark, static):
    scored = spark.createDataFrame([("r", "a", 0.5)], "resource string, metric string, coefficient double")
    plan = plan_of(top_candidates(scored.select("resource", "metric"), scored, 3))
    assert plan.startswith("TakeOrderedAndProject") and "Exchange rangepartitioning" not in plan
