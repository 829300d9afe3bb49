"""Stored measurements, kept up to date by recomputing only the buckets that changed samples reach.

A rollup is a table ``resource, ts_ms, label, value`` partitioned by ``period``, the day of the bucket.
After an upsert of samples, ``refresh_rollup`` finds the dirty buckets, computes them from the
samples that they need, and rewrites the periods that have any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.grid import MILLIS_PER_DAY, ceiling_sql, step_floor
from tideline.model import SERIES, ResultDescriptor
from tideline.operators.neighbours import CHUNK, LookBack, chunked, look_back
from tideline.operators.rollup import bucket_grid
from tideline.plans.measurements import process

ROLLUP_SCHEMA = "resource string, ts_ms bigint, label string, value double, period bigint"
PERIOD = "period"
BUCKET_KEY = ["resource", "ts_ms"]

# Dirty buckets of a series from one sample, before the next explode.
REACHED = 10_000


def period_of(ts_ms: Column) -> Column:
    return step_floor(ts_ms, MILLIS_PER_DAY)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROLLUP_SCHEMA).parquet(path)


def _write(rows: DataFrame, path: str, dynamic: bool) -> None:
    gathered = rows.withColumn(PERIOD, period_of(F.col("ts_ms"))).hint("rebalance", PERIOD).sortWithinPartitions(PERIOD, "resource", "label")
    writer = gathered.write.mode("overwrite").partitionBy(PERIOD)
    (writer.option("partitionOverwriteMode", "dynamic") if dynamic else writer).parquet(path)


def write_rollup(samples: DataFrame, path: str, start_ms: int, end_ms: int, descriptor: ResultDescriptor, resolution_ms: int, **options) -> None:
    """The measurements of ``process`` over a range, as a table; ``options`` are those of ``process``."""
    _check(options)
    _write(process(samples, start_ms, end_ms, descriptor, resolution_ms, **options), path, False)


def _check(options: dict) -> None:
    if options.get("strict_adjacency") or not options.get("pad_first_bucket", True) or options.get("with_attributes"):
        raise ValueError("a rollup is kept of padded measurements without attributes and without strict adjacency")


def dirty_buckets(samples: DataFrame, changed: DataFrame, start_ms: int, end_ms: int, descriptor: ResultDescriptor, resolution_ms: int) -> DataFrame:
    """``resource, ts_ms`` of every requested bucket whose value may differ since samples changed.

    ``samples`` is the table after the upsert, ``changed`` has ``resource, metric, ts_ms`` of what was written.
    A sample counts in the intervals from its own back to those within a heartbeat; the one after it is followed
    by another stretch, and a counter's rate there by another predecessor.  So these two are looked at,
    whatever the distance between them; a written sample without a value leaves the table's values the same way.
    """
    changed = changed.where(F.col("metric").isin(descriptor.source_names)).select(*SERIES, "ts_ms").distinct()
    touched = samples.join(changed.select(*SERIES).distinct(), SERIES, "left_semi").where(F.col("value").isNotNull())
    points = (
        touched.select(*SERIES, "ts_ms", F.lit(False).alias("_changed"))
        .unionByName(changed.withColumn("_changed", F.lit(True)))
        .groupBy(*SERIES, "ts_ms")
        .agg(F.max("_changed").alias("_changed"))
    )
    followed = look_back(chunked(points), [LookBack(SERIES, {"_before": "_changed"})]).drop(CHUNK)
    affected = followed.where(F.col("_changed") | F.coalesce("_before", F.lit(False)))
    grid = bucket_grid(start_ms, end_ms, resolution_ms)
    step, reach = descriptor.step_ms, descriptor.max_heartbeat_ms
    first = ceiling_sql(ceiling_sql(f"(ts_ms - {reach}L)", step), resolution_ms)
    last = ceiling_sql(ceiling_sql("ts_ms", step), resolution_ms)
    spans = affected.selectExpr("resource", f"greatest({first}, {grid.lo}L) AS _lo", f"least({last}, {grid.hi}L) AS _hi").where("_lo <= _hi").distinct()
    block = resolution_ms * REACHED
    blocks = spans.withColumn("_lo", F.explode(F.expr(f"sequence(_lo, _hi, {block}L)"))).withColumn("_hi", F.expr(f"least(_hi, _lo + {block - resolution_ms}L)"))
    return blocks.select("resource", F.explode(F.expr(f"sequence(_lo, _hi, {resolution_ms}L)")).alias("ts_ms")).distinct()


def needed_samples(samples: DataFrame, resources: DataFrame, descriptor: ResultDescriptor, first_ms: int, last_ms: int) -> DataFrame:
    """The samples of some resources that values from ``first_ms`` to ``last_ms`` depend on: those within reach,
    and of every series the one before them, however old."""
    columns = [*SERIES, "ts_ms", "metric_type", "value"]
    own = samples.where(F.col("metric").isin(descriptor.source_names) & F.col("value").isNotNull()).select(*columns)
    own = own.join(resources, "resource", "left_semi")
    within = own.where(F.col("ts_ms").between(first_ms, last_ms + descriptor.max_heartbeat_ms))
    older = own.where(F.col("ts_ms") < first_ms).groupBy(*SERIES).agg(F.max_by(F.struct(*columns), "ts_ms").alias("_last"))
    return within.unionByName(older.select("_last.*"))


def refresh_rollup(
    spark: SparkSession, path: str, samples: DataFrame, changed: DataFrame, start_ms: int, end_ms: int, descriptor: ResultDescriptor, resolution_ms: int, **options
) -> list[int]:
    """Brings a rollup up to date and tells the periods that it rewrote.

    All but ``changed`` is as ``write_rollup`` was given it, ``samples`` with the changes in it.  A resource
    that the rollup does not have gets all its buckets, as it would have had.  The list of
    periods has one entry per day of the range at most.
    """
    _check(options)
    changed = changed.where(F.col("metric").isin(descriptor.source_names))
    stored = read_rollup(spark, path)
    grid = bucket_grid(start_ms, end_ms, resolution_ms)
    reached = dirty_buckets(samples, changed, start_ms, end_ms, descriptor, resolution_ms)
    # Every resource has a row in each bucket of the range, so its first one tells who is known.
    known = stored.where((F.col(PERIOD) == grid.lo - grid.lo % MILLIS_PER_DAY) & (F.col("ts_ms") == grid.lo)).select("resource").distinct()
    fresh = changed.select("resource").distinct().join(known, "resource", "left_anti")
    every = F.explode(F.sequence(*(F.lit(v).cast("bigint") for v in (grid.lo, grid.hi, grid.step))))
    dirty = reached.unionByName(fresh.select("resource", every.alias("ts_ms"))).distinct().persist()
    try:
        periods = dirty.groupBy(period_of(F.col("ts_ms")).alias(PERIOD)).agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi")).collect()
        if not periods:
            return []
        lo, hi = min(r["lo"] for r in periods), max(r["hi"] for r in periods)
        resources = dirty.select("resource").distinct()
        needed = needed_samples(samples, resources, descriptor, lo - resolution_ms - descriptor.max_heartbeat_ms, hi)
        computed = process(needed, max(lo, start_ms), min(hi, end_ms), descriptor, resolution_ms, resources=resources, **options)
        rewritten = sorted(r[PERIOD] for r in periods)
        kept = stored.where(F.col(PERIOD).isin(rewritten)).drop(PERIOD).join(dirty, BUCKET_KEY, "left_anti")
        _write(kept.unionByName(computed.join(dirty, BUCKET_KEY, "left_semi").select(*kept.columns)), path, True)
        return rewritten
    finally:
        dirty.unpersist()
