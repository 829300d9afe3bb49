"""Interval values to the coarser buckets of a resolution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.grid import TimeGrid, spine, step_ceiling
from tideline.functions.values import Aggregation, known_or_nan, merged_states, partial_states, unknown
from tideline.model import ResultDescriptor
from tideline.operators import attributes as attrs
from tideline.operators.consolidate import BUCKET, HEARTBEAT, INTERVAL, REQUESTED, SOURCE_KEY
from tideline.operators.neighbours import spread
from tideline.sources.requests import literal_rows

COUNT = "_count"

# Rows of the result that one resource may gather.
RESOURCE_ROWS = 100_000


def bucket_grid(start_ms: int, end_ms: int, resolution_ms: int) -> TimeGrid:
    return TimeGrid.covering(start_ms, end_ms, resolution_ms)


def interval_grid(start_ms: int, end_ms: int, step_ms: int, resolution_ms: int, pad_first_bucket: bool) -> TimeGrid:
    """Grid of the intervals that fall into some bucket.

    With padding the intervals begin one resolution before the start, so that
    the first bucket is covered like the others; those before it are left out.
    """
    first = start_ms - resolution_ms if pad_first_bucket else start_ms
    before_first_bucket = bucket_grid(start_ms, end_ms, resolution_ms).lo - resolution_ms
    return TimeGrid.covering(first, end_ms, step_ms).starting_at(before_first_bucket + step_ms)


def aggregate_buckets(
    intervals: DataFrame, functions: Sequence[Aggregation], with_attributes: bool = False
) -> DataFrame:
    """One row per source and bucket with a column ``_fn<i>`` for each function
    and the number of interval rows.  Keeps the partitioning of its input, unless a
    function merges states: then one row per bucket and task is exchanged."""
    merged = {i: fn for i, fn in enumerate(functions) if fn.merged is not None}
    plain = {i: fn for i, fn in enumerate(functions) if fn.merged is None}
    buckets = _aggregated(intervals, plain, with_attributes)
    if not merged:
        return buckets
    key = [*SOURCE_KEY, BUCKET]
    finished = merged_states(partial_states(intervals, key, merged), key, merged)
    rest = [c for c in [*buckets.columns, *(f"_fn{i}" for i in merged)] if c not in key]
    one = {"attributes": lambda c: F.any_value(c, ignoreNulls=True)}
    both = buckets.unionByName(finished, allowMissingColumns=True)
    return both.groupBy(*key).agg(*(one.get(c, F.max)(c).alias(c) for c in rest))


def _aggregated(intervals: DataFrame, functions: Mapping[int, Aggregation], with_attributes: bool) -> DataFrame:
    key = [*SOURCE_KEY, BUCKET]
    asked = [F.max(REQUESTED).alias(REQUESTED)] if REQUESTED in intervals.columns else []
    if not with_attributes:
        named = [fn(F.col("value")).alias(f"_fn{i}") for i, fn in functions.items()]
        return intervals.groupBy(*key).agg(F.count(F.lit(1)).alias(COUNT), *named, *asked)

    value = attrs.measure_only(F.col("value"))
    reduced = (
        attrs.unfold(intervals)
        .groupBy(*key, attrs.ENTRY_KEY)
        .agg(
            F.count(value).alias(COUNT),
            *(fn(value).alias(f"_fn{i}") for i, fn in functions.items()),
            F.max_by(attrs.ENTRY_VALUE, INTERVAL).alias(attrs.ENTRY_VALUE),
            *asked,
        )
    )
    measures = [COUNT, *(f"_fn{i}" for i in functions)]
    return reduced.groupBy(*key).agg(
        *(F.max(attrs.measure_only(F.col(name))).alias(name) for name in measures),
        attrs.folded_map().alias("attributes"),
        *asked,
    )


def covered_value(aggregate: Column, count: Column, intervals_per_bucket: float, xff: Column) -> Column:
    """The aggregate where more than the fraction ``xff`` of the bucket's
    intervals is present, otherwise unknown."""
    return F.when(count / F.lit(float(intervals_per_bucket)) > xff, known_or_nan(aggregate)).otherwise(unknown())


def to_labels(
    buckets: DataFrame, descriptor: ResultDescriptor, resolution_ms: int, count: Column, how: str = "inner"
) -> DataFrame:
    """Aggregated buckets of sources to measurements of the descriptor's labels; with ``how`` 'left' those without a label as well."""
    functions = distinct_functions(descriptor)
    rows = [
        {
            "metric": d.source,
            HEARTBEAT: descriptor.heartbeat_of(d),
            "label": d.label,
            "pick": functions.index(d.function),
            "xff": float(d.xff),
        }
        for d in descriptor.datasources
    ]
    # One row per datasource of the descriptor, which the driver holds.
    labels = literal_rows(
        buckets.sparkSession, rows, f"metric string, {HEARTBEAT} bigint, label string, pick int, xff double"
    )
    picked = F.get(F.array(*(F.col(f"_fn{i}").cast("double") for i in range(len(functions)))), F.col("pick"))
    per_bucket = resolution_ms / descriptor.step_ms
    extra = ["attributes"] if "attributes" in buckets.columns else []
    return buckets.join(F.broadcast(labels), ["metric", HEARTBEAT], how).select(
        "resource",
        F.col(BUCKET).alias("ts_ms"),
        "label",
        covered_value(picked, count, per_bucket, F.col("xff")).alias("value"),
        *extra,
    )


def distinct_functions(descriptor: ResultDescriptor) -> list[Aggregation]:
    return list(dict.fromkeys(d.function for d in descriptor.datasources))


def _filled_by_resource(measured: DataFrame, labels: Column, grid: TimeGrid) -> DataFrame:
    """All buckets and labels of the resources that ``measured`` has, without reading its input again for their names.

    Rows without a time or label only name their resource. What is gathered per resource are its
    rows of the result, a number that the request fixes.
    """
    extra = ["attributes"] if "attributes" in measured.columns else []
    row = F.struct("ts_ms", "label", "value", *extra)
    kind = measured.select(row.alias("_row")).schema["_row"].dataType.simpleString()
    points = F.sequence(*(F.lit(v).cast("bigint") for v in (grid.lo, grid.hi, grid.step))) if grid.size else F.array().cast("array<bigint>")
    blank = lambda ts, label: F.struct(
        ts.alias("ts_ms"), label.alias("label"), F.lit(None).cast("double").alias("value"), *(F.lit(None).cast(measured.schema[c].dataType).alias(c) for c in extra)
    )
    blanks = F.flatten(F.transform(labels, lambda label: F.transform(points, lambda ts: blank(ts, label))))
    gathered = spread(measured, ["resource"]).groupBy("resource").agg(F.collect_list(F.when(F.col("ts_ms").isNotNull() & F.col("label").isNotNull(), row)).alias("_rows"))
    both = gathered.select("resource", F.explode(F.concat("_rows", blanks.cast(f"array<{kind}>"))).alias("_row")).select("resource", "_row.*")
    found = [F.max("value").alias("value")] + [F.any_value(c, ignoreNulls=True).alias(c) for c in extra]
    filled = both.groupBy("resource", "ts_ms", "label").agg(*found)
    return filled.withColumn("value", known_or_nan(F.col("value")))


def roll_up(
    primary: DataFrame,
    start_ms: int,
    end_ms: int,
    descriptor: ResultDescriptor,
    resolution_ms: int,
    resources: DataFrame | None = None,
    with_attributes: bool = False,
) -> DataFrame:
    """Measurements per bucket and label from dense primary data.

    ``primary`` has a row for every interval of every source, unknown ones too,
    as ``primary_data`` emits them; their number decides the coverage rule.
    Buckets without any row, and every datasource of a resource without primary
    data, come out unknown.
    """
    descriptor.check_resolution(resolution_ms)
    grid = bucket_grid(start_ms, end_ms, resolution_ms)
    if HEARTBEAT not in primary.columns:
        # Without it a source has been consolidated once, for all its labels.
        table = literal_rows(
            primary.sparkSession,
            [{"metric": s, HEARTBEAT: h} for s, h in descriptor.source_heartbeats],
            f"metric string, {HEARTBEAT} bigint",
        )
        primary = primary.join(F.broadcast(table), "metric")
    gathers = resources is None and grid.size * len(descriptor.datasources) <= RESOURCE_ROWS
    intervals = primary.withColumn(BUCKET, step_ceiling(F.col("ts_ms"), resolution_ms))
    requested = F.col(BUCKET).between(grid.lo, grid.hi)
    # Where names are gathered with the rows, those of no requested bucket stay as one row per source.
    intervals = intervals.withColumn(BUCKET, F.when(requested, F.col(BUCKET))) if gathers else intervals.where(requested)
    intervals = intervals.withColumnRenamed("ts_ms", INTERVAL)
    buckets = aggregate_buckets(intervals, distinct_functions(descriptor), with_attributes)
    measured = to_labels(buckets, descriptor, resolution_ms, F.col(COUNT), "left" if gathers else "inner")

    labels = F.array(*(F.lit(d.label) for d in descriptor.datasources))
    if gathers:
        return _filled_by_resource(measured, labels, grid)
    if resources is None:
        resources = primary.select("resource").distinct()
    blanks = spine(resources.select("resource", F.explode(labels).alias("label")), grid)
    both = measured.unionByName(blanks, allowMissingColumns=True)
    found = [F.max("value").alias("value")]
    if with_attributes:
        found.append(F.any_value("attributes", ignoreNulls=True).alias("attributes"))
    filled = both.groupBy("resource", "ts_ms", "label").agg(*found)
    return filled.withColumn("value", known_or_nan(F.col("value")))
