"""Rows of stored files are told apart by their place, others by a number written with them."""

import pytest

from tideline.llm import common, dedup, mixing


@pytest.fixture(scope="module")
def table(spark):
    rows = [(None, f"text {i % 40}", "s", i) for i in range(200)] + [(7, f"other {i}", "t", i) for i in range(50)] + [(8, None, None, 1), (8, "", None, 2)]
    return common.written(spark.createDataFrame(rows, "doc_id long, text string, source string, row_key int").repartition(6))


def test_places_are_keys(table):
    keyed = common.row_keyed(table, "key")
    keys = [r.key for r in keyed.collect()]
    assert len(set(keys)) == 252 and sorted(keys) == sorted(r.key for r in keyed.select("key").collect())


@pytest.mark.parametrize("derive", ["explode", "union", "join", "metadata"])
def test_derived_rows_are_numbered(table, derive):
    from pyspark.sql import functions as F

    rows = {
        "explode": lambda: table.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")),
        "union": lambda: table.unionByName(table),
        "join": lambda: table.join(table.sparkSession.range(2).withColumnRenamed("id", "n")),
        "metadata": lambda: common.written(table.unionByName(table).withColumn("_metadata", F.lit(1))),
    }[derive]()
    assert common.row_keyed(rows, "key").select("key").distinct().count() == 504


def test_stored_and_other_rows_are_decided_alike(spark, table):
    other = spark.createDataFrame(table.collect(), table.schema)
    for docs in (table, other):
        assert docs.columns == dedup.without_copies(docs).columns
        assert sorted(str((r.doc_id, r.text or "")) for r in dedup.without_copies(docs).collect()) == sorted(
            [str((None, f"text {i}")) for i in range(40)] + [str((7, f"other {i}")) for i in range(50)] + [str((8, ""))]
        )
    mixed = [sorted(str((r.doc_id, r.text)) for r in mixing.mixed_documents(docs).collect()) for docs in (table, other)]
    assert mixed[0] == mixed[1]
