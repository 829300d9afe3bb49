"""The samples table: schema, range scans, wide rows and upsert.

A sample is unique by (shard, resource, ts_ms, metric).  ``shard`` is derived
from the timestamp and partitions the table on storage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.grid import MILLIS_PER_SECOND, seconds, step_floor
from tideline.model import resolve_range

SAMPLE_COLUMNS = ["resource", "ts_ms", "metric", "metric_type", "value", "attributes"]
SAMPLE_SCHEMA = (
    "resource string, ts_ms bigint, metric string, metric_type string, value double, "
    "attributes map<string,string>"
)
STORED_SCHEMA = SAMPLE_SCHEMA + ", seq bigint, shard bigint"
SAMPLE_KEY = ["resource", "ts_ms", "metric"]

# Width of a storage shard.
SHARD_MS = seconds(600_000)

# Where a row group has too many resources for a dictionary, a Bloom filter tells which it does not have;
# the writer picks its size by what it has seen.
BLOOM_FILTER = {"parquet.bloom.filter.enabled#resource": "true", "parquet.bloom.filter.adaptive.enabled": "true"}

# Longest list of resources handed to the scan as an IN predicate.
PUSHED_RESOURCES = 1_000


def shard_of(ts_ms: Column) -> Column:
    """Shard of a timestamp: its start in epoch seconds."""
    return (step_floor(ts_ms, SHARD_MS) / F.lit(MILLIS_PER_SECOND)).cast("bigint")


def shard_bounds(start_ms: int, end_ms: int) -> tuple[int, int]:
    lower, upper = (v - v % SHARD_MS for v in (start_ms, end_ms))
    return lower // MILLIS_PER_SECOND, upper // MILLIS_PER_SECOND


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED_SCHEMA).parquet(path)


def in_range(samples: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Samples of a time range, both ends included, from its shards only."""
    if "shard" in samples.columns:
        samples = samples.where(F.col("shard").between(*shard_bounds(start_ms, end_ms)))
    return samples.where(F.col("ts_ms").between(start_ms, end_ms))


def select_samples(
    samples: DataFrame,
    resources: DataFrame | Sequence[str],
    start_ms: int | None = None,
    end_ms: int | None = None,
    metrics: Sequence[str] | None = None,
    now: int | None = None,
) -> DataFrame:
    """Samples of some resources over a time range (default: the last 24 hours).

    A list of resources becomes a predicate of the scan, a DataFrame a semi join.
    """
    start, end = resolve_range(start_ms, end_ms, now)
    found = in_range(samples, start, end)
    if metrics is not None:
        found = found.where(F.col("metric").isin(list(metrics)))
    if isinstance(resources, DataFrame):
        return found.join(resources.select("resource"), "resource", "left_semi")
    names = list(dict.fromkeys(resources))
    if len(names) <= PUSHED_RESOURCES:
        return found.where(F.col("resource").isin(names))
    listed = samples.sparkSession.createDataFrame([(name,) for name in names], "resource string")
    return found.join(listed, "resource", "left_semi")


def timestamp_rows(samples: DataFrame, metrics: Sequence[str], order: str | None = None) -> DataFrame:
    """One row per resource and timestamp with a column per metric.

    Of repeated samples the one with the largest ``order`` remains (the largest
    value without one); an absent metric is NULL.
    """
    pick = F.max("value") if order is None else F.max_by("value", order)
    return samples.groupBy("resource", "ts_ms").pivot("metric", list(metrics)).agg(pick)


def latest_samples(samples: DataFrame, order: str = "seq") -> DataFrame:
    """One sample per key, the one written last.

    ``max_by`` reduces repeated keys before the shuffle, so a key written over
    and over does not end up in one task.  Equal ``order`` falls back to type and value.
    """
    rest = [c for c in samples.columns if c not in SAMPLE_KEY]
    newest = F.max_by(F.struct(*rest), F.struct(order, "metric_type", "value")).alias("_newest")
    picked = samples.groupBy(*SAMPLE_KEY).agg(newest)
    return picked.select(*SAMPLE_KEY, *(F.col("_newest")[c].alias(c) for c in rest)).select(*samples.columns)


def write_samples(samples: DataFrame, path: str, order: str = "seq", mode: str = "overwrite") -> None:
    """Writes samples, last write per key, partitioned by shard.

    Rows are gathered by shard and rebalanced, so a large shard becomes several
    files of the advisory size; sorted files let a resource predicate skip row groups.
    """
    rows = latest_samples(samples, order).withColumn("shard", shard_of(F.col("ts_ms")))
    _writer(rows, order).mode(mode).parquet(path)


def touched_shards(stored: DataFrame, shards: Sequence[int]) -> DataFrame:
    return stored.where(F.col("shard").isin(list(shards)))


def upsert_samples(spark: SparkSession, path: str, incoming: DataFrame, order: str = "seq") -> None:
    """Merges samples into a table, rewriting only the shards they touch.

    Incoming samples replace stored ones of the same key and smaller ``order``.
    The touched shards, one per SHARD_MS of time, are listed first, so that the
    scan of the table names them and reads no others.
    """
    fresh = incoming.withColumn("shard", shard_of(F.col("ts_ms")))
    touched = [r["shard"] for r in fresh.select("shard").distinct().collect()]
    kept = touched_shards(read_samples(spark, path), touched).withColumnRenamed("seq", order)
    merged = latest_samples(kept.select(*fresh.columns).unionByName(fresh), order)
    (
        _writer(merged, order)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def _writer(rows: DataFrame, order: str):
    stored = rows.withColumnRenamed(order, "seq").select(*SAMPLE_COLUMNS, "seq", "shard")
    writer = stored.hint("rebalance", "shard").sortWithinPartitions("shard", *SAMPLE_KEY).write.partitionBy("shard")
    return writer.options(**BLOOM_FILTER)
