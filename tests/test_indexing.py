"""Merged indexes against indexes built anew, and time functions in SQL."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.functions import sqlfunctions
from tideline.functions.grid import TimeGrid, spine
from tideline.sources.catalog import index_samples
from tideline.sources.indexing import CountedCatalog, index_counted, merge_index
from tideline.sources.samples import SAMPLE_SCHEMA, latest_samples


def random_samples(spark, rng, count, seqs):
    """Few keys, so that most are written again, and few values, so that some disappear."""
    rows = []
    for seq in rng.sample(seqs, count):
        attributes = rng.choice([None, {}, {"a": rng.choice("xyz")}, {"a": rng.choice("xyz"), "b": rng.choice("pq")}, {"c": None}])
        rows.append((f"r{rng.randrange(4)}", rng.randrange(12), rng.choice("mn"), "GAUGE", float(rng.randrange(3)), attributes, seq))
    return spark.createDataFrame(rows, SAMPLE_SCHEMA + ", seq bigint")


def content(catalog):
    return [sorted(map(repr, (tuple(r) for r in part.collect()))) for part in (catalog.terms, catalog.resource_attributes, catalog.resource_metrics)]


@pytest.mark.parametrize("seed", range(4))
def test_merged_is_built_anew(spark, seed, tmp_path):
    """Three upserts in a row, some samples of them written earlier than what is stored."""
    rng = random.Random(seed)
    stored = latest_samples(random_samples(spark, rng, 25, range(0, 1000))).cache()
    index = index_counted(stored)
    for turn in range(3):
        incoming = random_samples(spark, rng, rng.choice([1, 5, 20]), range(400 * turn, 400 * turn + 1500))
        merged = merge_index(index, stored, incoming)
        merged.write(str(tmp_path / str(turn)))
        index = CountedCatalog.read(spark, str(tmp_path / str(turn)))
        stored = latest_samples(stored.unionByName(incoming)).cache()
        assert content(index.catalog) == content(index_samples(stored))
        assert content(index) == content(index_counted(stored))


def test_incoming_samples_are_reduced_once(spark, tmp_path):
    """What is merged reads incoming samples where they were reduced, not where they came from."""
    rng = random.Random(7)
    stored = latest_samples(random_samples(spark, rng, 25, range(500))).cache()
    given = str(tmp_path / "given")
    random_samples(spark, rng, 20, range(300, 900)).write.parquet(given)
    incoming = spark.read.parquet(given)
    merged = merge_index(index_counted(stored), stored, incoming)
    for part in (merged.terms, merged.resource_attributes, merged.resource_metrics):
        assert not [f for f in part.inputFiles() if given in f]
    assert content(merged.catalog) == content(index_samples(latest_samples(stored.unionByName(incoming))))


def test_nothing_new(spark):
    stored = latest_samples(random_samples(spark, random.Random(9), 20, range(100)))
    index = index_counted(stored)
    assert content(merge_index(index, stored, stored.limit(0))) == content(index)
    assert content(merge_index(index, stored, stored)) == content(index)
    empty = stored.limit(0)
    assert content(merge_index(index_counted(empty), empty, stored)) == content(index)


@pytest.mark.parametrize("bounds", [(0, 0, 7), (-15, 22, 7), (5, 4, 10), (11, 2, 3), (1, 250_001, 10)])
def test_intervals_are_the_grid(spark, bounds):
    sqlfunctions.register(spark)
    grid = TimeGrid.covering(*bounds)
    if grid.lo > grid.hi:
        want = []
    else:
        want = sorted(r["ts_ms"] for r in spine(spark.createDataFrame([("r",)], "resource string"), grid).collect())
    assert sorted(r["ts_ms"] for r in spark.sql(f"SELECT * FROM intervals({bounds[0]}, {bounds[1]}, {bounds[2]})").collect()) == want
    assert len(want) == grid.size
    listed = spark.sql(f"SELECT interval_list({bounds[0]}, {bounds[1]}, {bounds[2]}) AS ts").first()["ts"]
    assert sorted(listed) == want


def test_sql_functions_leave_plans_whole(spark):
    sqlfunctions.register(spark)
    spark.createDataFrame([("r", -5), ("s", 12)], "resource string, at bigint").createOrReplaceTempView("moments")
    rows = spark.sql("SELECT resource, step_floor(at, 10) AS lo, step_ceiling(at, 10) AS hi, i.ts_ms FROM moments, LATERAL intervals(at, at + 10, 10) AS i")
    assert sorted(tuple(r) for r in rows.collect()) == [("r", -10, 0, -10), ("r", -10, 0, 0), ("r", -10, 0, 10), ("s", 10, 20, 10), ("s", 10, 20, 20), ("s", 10, 20, 30)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Python", "ArrowEval", "NestedLoop", "Cartesian"))
    assert rows.where(F.col("resource") == "r").count() == 3
