"""Cascades of many bits, cascades by parts of the universe, and mixes of ids that stand in steps."""

import time

import pytest
from pyspark.sql import functions as F

from tideline.llm import mixing, urls


def test_bits_of_the_largest_cascade_are_one_literal(spark):
    started = time.monotonic()
    bits = bytes([0b10000001]) * (urls.MAX_CASCADE_BITS // 8)
    frame = spark.range(100).select(F.concat(F.lit("k"), "id").alias("key"))
    found = frame.where(urls.Cascade((bits,)).contains(F.col("key"))).count()
    assert found < 100 and time.monotonic() - started < 30


@pytest.mark.parametrize("max_bits", [64, 1 << 12, 1 << 26])
def test_parts_of_the_universe_give_the_same_answers(spark, max_bits):
    n = 300 if max_bits == 64 else 20_000
    universe = spark.range(n).selectExpr("concat('host', id) AS key", "id % 7 = 0 AS listed")
    rows = universe.select(F.col("key").alias("host"), F.lit(1).alias("part"), F.col("listed").alias("wanted")).unionByName(
        spark.range(5000).select(F.lit("host7").alias("host"), F.lit(1).alias("part"), F.lit(True).alias("wanted"))
    ).unionByName(spark.createDataFrame([(None, 1, False)], "host string, part int, wanted boolean"))
    found = urls.mark_listed(rows, universe, "host", max_bits)
    assert found.columns == ["host", "part", "wanted", "listed"]
    assert found.count() == n + 5001 and found.where("listed <> wanted").count() == 0


def test_very_long_urls(spark):
    frame = spark.createDataFrame([(1, "http://" + "a" * 1_000_000 + ".spam.net/" + "b" * 1_000_000), (2, "x" * 2_000_000)], "page_id long, url string")
    found = {r.page_id: (len(r.host), len(r.path), r.verdict) for r in urls.judge(frame, [], ["spam"]).collect()}
    assert found == {1: (1_000_009, 1_000_001, "block"), 2: (0, 0, "allow")}


@pytest.mark.parametrize("ids", ["id * 1024", "cast(null AS long)", "id"])
def test_ranges_don_t_change_a_mix(spark, ids):
    docs = spark.range(3000).selectExpr(f"{ids} AS doc_id", "repeat('w ', cast(id % 3 AS int) + 1) AS text", "if(id % 3 = 0, 'a', 'b') AS source")
    taken = ["doc_id", "size", "source_size", "target", "taken"]
    whole = sorted(map(str, mixing.mix(docs).select(*taken).collect()))
    assert sorted(map(str, mixing.mix(docs, range_rows=100).select(*taken).collect())) == whole
    assert sorted(map(str, mixing.mix(docs.repartition(7), range_rows=70).select(*taken).collect())) == whole
