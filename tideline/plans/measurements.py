"""Measurement queries: samples to rates, intervals, buckets, calculations, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.grid import TimeGrid, spine
from tideline.functions.values import AVERAGE, Aggregation
from tideline.model import DEFAULT_HEARTBEAT_STEPS, DEFAULT_XFF, SERIES, ResultDescriptor, resolve_range
from tideline.operators.compute import calculate, lengthen, widen
from tideline.operators.consolidate import (
    BUCKET,
    HEARTBEAT,
    REQUESTED,
    SOURCE_KEY,
    consolidate,
    fill,
    interval_values,
    source_keys,
    with_heartbeats,
)
from tideline.operators.neighbours import spread_keys
from tideline.operators.rate import rated_samples
from tideline.operators.rollup import (
    COUNT,
    aggregate_buckets,
    bucket_grid,
    covered_value,
    distinct_functions,
    interval_grid,
    to_labels,
)
from tideline.sources.requests import prefiltered
from tideline.sources.samples import in_range


# Buckets of one series that may share a task.
SERIES_BUCKETS = 100_000


def requested_buckets(
    samples: DataFrame,
    keys: DataFrame,
    grid: TimeGrid,
    buckets: TimeGrid,
    max_heartbeat_ms: int,
    functions: Sequence[Aggregation],
    partition_by: Sequence[str],
    with_attributes: bool = False,
) -> DataFrame:
    """Aggregates ``_fn<i>`` of every bucket of every (resource, metric, heartbeat)
    in ``keys``; NULL where nothing is known.  Other columns of ``keys`` are kept.

    Series are reduced to buckets before the one exchange that adds the missing
    buckets.  Functions that must see unknown intervals have them added first.
    """
    if all(fn.skips_unknown for fn in functions):
        intervals = interval_values(samples, grid, max_heartbeat_ms, buckets.step, with_attributes)
        reduced = aggregate_buckets(intervals, functions, with_attributes).drop(COUNT)
        filled = fill(reduced, spine(spread_keys(keys), buckets, BUCKET), [*SOURCE_KEY, BUCKET], partition_by)
    else:
        intervals = consolidate(
            samples, keys, grid, max_heartbeat_ms, buckets.step, partition_by, with_attributes
        )
        filled = aggregate_buckets(intervals, functions, with_attributes)
    return filled.where(REQUESTED).where(F.col(BUCKET).between(buckets.lo, buckets.hi))


def process(
    samples: DataFrame,
    start_ms: int,
    end_ms: int,
    descriptor: ResultDescriptor,
    resolution_ms: int,
    resources: DataFrame | None = None,
    pad_first_bucket: bool = True,
    counter_reset: str = "raw",
    strict_adjacency: bool = False,
    with_attributes: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """The exported measurements of every resource, one row per bucket and label.

    ``samples`` should reach back before the start by as much as the first
    bucket needs (``select_measurements`` does so).  ``resources`` names who
    appears, with or without samples; by default those having samples of the
    descriptor's sources.
    """
    descriptor.check_resolution(resolution_ms)
    buckets = bucket_grid(start_ms, end_ms, resolution_ms)
    grid = interval_grid(start_ms, end_ms, descriptor.step_ms, resolution_ms, pad_first_bucket)
    if resources is None:
        named = samples.where(F.col("metric").isin(descriptor.source_names))
        resources = named.select("resource").distinct()

    pairs = descriptor.source_heartbeats
    # Later samples are out of every heartbeat's reach; earlier ones may be what a rate looks back on.
    used = [*SERIES, "ts_ms", "metric_type", "value", *(["attributes"] if with_attributes else [])]
    samples = samples.where(F.col("ts_ms") <= grid.hi + descriptor.max_heartbeat_ms).select(*used)
    rated = rated_samples(samples, descriptor.source_names, hot_rows, counter_reset, strict_adjacency)
    rolled = requested_buckets(
        with_heartbeats(rated, pairs),
        source_keys(resources, pairs),
        grid,
        buckets,
        descriptor.max_heartbeat_ms,
        distinct_functions(descriptor),
        partition_by=["resource", BUCKET],
        with_attributes=with_attributes,
    )
    present = grid.points_within(BUCKET, resolution_ms)
    measured = to_labels(rolled, descriptor, resolution_ms, present)
    wide = calculate(widen(measured, [d.label for d in descriptor.datasources]), descriptor.calculations)
    return lengthen(wide, descriptor.exports, with_attributes)


def average_series(
    samples: DataFrame,
    keys: DataFrame,
    start_ms: int,
    end_ms: int,
    step_ms: int,
    resolution_ms: int,
    pad_first_bucket: bool = True,
    hot_rows: int | None = None,
) -> DataFrame:
    """Bucket averages ``resource, metric, ts_ms, value`` of every series in
    ``keys``, all under the same default datasource, with other columns of ``keys``.

    The form of ``process`` for a correlation, where the metrics are data, as
    many as the catalog holds, instead of names in a descriptor.
    """
    heartbeat = DEFAULT_HEARTBEAT_STEPS * step_ms
    grid = interval_grid(start_ms, end_ms, step_ms, resolution_ms, pad_first_bucket)
    buckets = bucket_grid(start_ms, end_ms, resolution_ms)

    uniform = F.lit(heartbeat).cast("bigint")
    rolled = requested_buckets(
        rated_samples(samples.select(*SERIES, "ts_ms", "metric_type", "value"), hot_rows=hot_rows).withColumn(HEARTBEAT, uniform),
        keys.withColumn(HEARTBEAT, uniform),
        grid,
        buckets,
        heartbeat,
        [AVERAGE],
        # Few enough rows per series to stay together for what follows, or not.
        partition_by=SERIES if buckets.size <= SERIES_BUCKETS else [*SERIES, BUCKET],
    )
    present = grid.points_within(BUCKET, resolution_ms)
    value = covered_value(F.col("_fn0"), present, resolution_ms / step_ms, F.lit(DEFAULT_XFF))
    return rolled.select(*SERIES, F.col(BUCKET).alias("ts_ms"), value.alias("value"), *(c for c in keys.columns if c not in SERIES))


def select_measurements(
    samples: DataFrame,
    resources: DataFrame,
    descriptor: ResultDescriptor,
    resolution_ms: int,
    start_ms: int | None = None,
    end_ms: int | None = None,
    lookback_ms: int | None = None,
    now: int | None = None,
    **options,
) -> DataFrame:
    """Measurements of the given resources over a time range.

    Reads samples from ``lookback_ms`` (default: one resolution) before the
    start, so that the first rate and the first bucket have their data.
    """
    descriptor.check_resolution(resolution_ms)
    start, end = resolve_range(start_ms, end_ms, now)
    reach = resolution_ms if lookback_ms is None else lookback_ms
    # Adjacency looks at all metrics of a resource, otherwise only sources are read.
    metrics = None if options.get("strict_adjacency") else descriptor.source_names
    read = in_range(samples, start - reach, end)
    if metrics is not None:
        read = read.where(F.col("metric").isin(metrics))
    return process(prefiltered(read, resources, ["resource"]), start, end, descriptor, resolution_ms, resources=resources, **options)
