"""Irregular samples onto a regular grid: time-weighted interval averages.

A sample's value holds backwards over the time since its predecessor.  Within
an interval, time covered by a stretch shorter than the heartbeat is known, the
rest unknown; the interval has a value when less than half of it is unknown.

The intervals a sample reaches follow from its own and its predecessor's
timestamp, so samples meet intervals by arithmetic instead of a range join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.grid import INTERVAL, SPINE_BLOCK, TimeGrid, ceiling_sql, floor_sql, spine
from tideline.functions.values import known_or_nan
from tideline.model import SERIES, ResultDescriptor
from tideline.operators import attributes as attrs
from tideline.operators.neighbours import CHUNK, PREV_TS, previous_samples, spread, spread_keys
from tideline.sources.requests import literal_rows

HEARTBEAT = "heartbeat_ms"
BUCKET = "bucket_ms"
SOURCE_KEY = [*SERIES, HEARTBEAT]

_SUMS = ("weighted", "known", "unknown")

# True on the rows of a series that was asked for.
REQUESTED = "_requested"


def with_heartbeats(samples: DataFrame, pairs: Sequence[tuple[str, int]]) -> DataFrame:
    """Keeps the named sources, one copy of a sample per distinct heartbeat."""
    sources = list(dict.fromkeys(source for source, _ in pairs))
    heartbeats = {heartbeat for _, heartbeat in pairs}
    named = samples.where(F.col("metric").isin(sources))
    if len(heartbeats) == 1:
        return named.withColumn(HEARTBEAT, F.lit(heartbeats.pop()).cast("bigint"))
    # One row per (source, heartbeat) of the descriptor, which the driver holds.
    table = literal_rows(
        samples.sparkSession,
        [{"metric": source, HEARTBEAT: heartbeat} for source, heartbeat in pairs],
        f"metric string, {HEARTBEAT} bigint",
    )
    return named.join(F.broadcast(table), "metric")


def contributions(samples: DataFrame, grid: TimeGrid, max_heartbeat_ms: int) -> DataFrame:
    """One row per sample and interval it counts in, with the elapsed time.

    Needs ``prev_ts`` and ``heartbeat_ms``.  The widest heartbeat bounds which
    intervals a sample reaches, its own decides between known and unknown time.
    """
    step, reach = grid.step, max_heartbeat_ms
    after_previous = ceiling_sql(f"({PREV_TS} + 1L)", step)
    lo = f"greatest({ceiling_sql(f'(ts_ms - {reach}L)', step)}, {after_previous}, {grid.lo}L)"
    hi = f"least({ceiling_sql('ts_ms', step)}, {floor_sql(f'(ts_ms + {reach}L)', step)}, {grid.hi}L)"
    reached = samples.selectExpr("*", f"{lo} AS _lo", f"{hi} AS _hi").where("_lo <= _hi")
    if 2 * reach // step > SPINE_BLOCK:
        # Long reaches are cut in two levels, so that no array is longer than a block.
        block = step * SPINE_BLOCK
        reached = reached.withColumn("_lo", F.explode(F.expr(f"sequence(_lo, _hi, {block}L)"))).withColumn("_hi", F.expr(f"least(_hi, _lo + {block - step}L)"))
    spread = reached.withColumn(INTERVAL, F.explode(F.expr(f"sequence(_lo, _hi, {step}L)"))).drop("_lo", "_hi")

    floor = f"({INTERVAL} - {step}L)"
    follows = f"{PREV_TS} > {floor} AND {PREV_TS} >= {INTERVAL} - {reach}L"
    elapsed = f"CASE WHEN {follows} THEN least(ts_ms, {INTERVAL}) - {PREV_TS} ELSE ts_ms - {floor} END"
    return spread.withColumn("elapsed", F.expr(elapsed))


def _partial_sums(rows: DataFrame, keys: Sequence[str], with_attributes: bool) -> DataFrame:
    counted = f"elapsed < {HEARTBEAT}"
    if not with_attributes:
        return rows.groupBy(*keys).agg(
            F.expr(f"sum(value * elapsed) FILTER (WHERE {counted}) AS weighted"),
            F.expr(f"sum(elapsed) FILTER (WHERE {counted}) AS known"),
            F.expr(f"sum(elapsed) FILTER (WHERE NOT {counted}) AS unknown"),
        )
    measure = f"{attrs.ENTRY_KEY} IS NULL"
    return (
        attrs.unfold(rows)
        .groupBy(*keys, attrs.ENTRY_KEY)
        .agg(
            F.expr(f"sum(value * elapsed) FILTER (WHERE {measure} AND {counted}) AS weighted"),
            F.expr(f"sum(elapsed) FILTER (WHERE {measure} AND {counted}) AS known"),
            F.expr(f"sum(elapsed) FILTER (WHERE {measure} AND NOT {counted}) AS unknown"),
            F.max_by(attrs.ENTRY_VALUE, "ts_ms").alias(attrs.ENTRY_VALUE),
            F.max("ts_ms").alias("ts_ms"),
        )
    )


def _interval_value() -> Column:
    valid = "coalesce(unknown, 0L) < coalesce(known, 0L)"
    return F.expr(f"CASE WHEN {valid} THEN weighted / known ELSE double('NaN') END AS value")


def interval_values(
    samples: DataFrame,
    grid: TimeGrid,
    max_heartbeat_ms: int,
    resolution_ms: int | None = None,
    with_attributes: bool = False,
) -> DataFrame:
    """Values of the intervals that samples reach.

    ``samples`` carry ``heartbeat_ms`` and ``prev_ts``.  Series are reduced
    where their window left them.  Chunks are reduced to sums per
    interval first, and only these are exchanged.  The output has the interval's
    ``bucket_ms`` (the interval itself without a resolution) and is partitioned
    so that a rollup needs no exchange.
    """
    split = CHUNK in samples.columns
    keys = [*SOURCE_KEY, CHUNK, INTERVAL] if split else [*SOURCE_KEY, INTERVAL]
    sums = _partial_sums(contributions(samples, grid, max_heartbeat_ms), keys, with_attributes)
    bucket = F.expr(ceiling_sql(INTERVAL, resolution_ms or grid.step))
    sums = sums.withColumn(BUCKET, bucket)

    key = [*SOURCE_KEY, BUCKET, INTERVAL]
    entry = [attrs.ENTRY_KEY] if with_attributes else []
    if split:
        merged = [F.sum(name).alias(name) for name in _SUMS]
        if with_attributes:
            merged.append(F.max_by(attrs.ENTRY_VALUE, "ts_ms").alias(attrs.ENTRY_VALUE))
        sums = spread(sums.drop(CHUNK), [*SERIES, BUCKET]).groupBy(*key, *entry).agg(*merged)
    if not with_attributes:
        return sums.select(*key, _interval_value())
    totals = sums.groupBy(*key).agg(
        *(F.max(attrs.measure_only(F.col(name))).alias(name) for name in _SUMS),
        attrs.folded_map().alias("attributes"),
    )
    return totals.select(*key, _interval_value(), "attributes")


def fill(measured: DataFrame, blanks: DataFrame, key: Sequence[str], partition_by: Sequence[str]) -> DataFrame:
    """Rows of ``measured`` and of the keys in ``blanks`` that it lacks, one per key.

    The column ``_requested`` is true for the keys in ``blanks``.  Telling apart
    who was asked for here, after the reduction, spares the samples a join.  Columns
    that only ``blanks`` have are kept.
    """
    marks = [c for c in blanks.columns if c not in (*key, *measured.columns)]
    rest = [c for c in measured.columns if c not in key] + marks
    merge = {"attributes": lambda c: F.any_value(c, ignoreNulls=True)}
    both = measured.unionByName(blanks.select(*key, *marks, F.lit(True).alias(REQUESTED)), allowMissingColumns=True)
    return spread(both, partition_by).groupBy(*key).agg(*(merge.get(c, F.max)(c).alias(c) for c in [*rest, REQUESTED]))


def fill_gaps(measured: DataFrame, keys: DataFrame, grid: TimeGrid) -> DataFrame:
    """Every grid point of every key in ``keys``, with what ``measured`` has for it; measured rows of other keys are left out.

    Exchanged are the measured rows and one head per key and block of the grid, which stands before the block's first
    point.  A row is followed by the gap up to the next one, so gaps are neither exchanged nor sorted.
    """
    first, step, width = grid.lo, grid.step, grid.step * SPINE_BLOCK
    rest = [c for c in measured.columns if c not in (*SOURCE_KEY, BUCKET, INTERVAL)]
    block = F.expr(f"{first}L + ({INTERVAL} - {first}L) div {width}L * {width}L").alias("_block")
    points = measured.select(*SOURCE_KEY, INTERVAL, block, F.lit(False).alias("_head"), *rest)
    blocks = spine(keys.select(*SOURCE_KEY), TimeGrid(first, grid.hi, width), "_block")
    heads = blocks.select(*SOURCE_KEY, F.expr(f"_block - {step}L").alias(INTERVAL), "_block", F.lit(True).alias("_head"))
    rows = spread(points.unionByName(heads, allowMissingColumns=True), [*SERIES, "_block"])

    ordered = Window.partitionBy(*SOURCE_KEY, "_block").orderBy(INTERVAL)
    end = F.least(F.lit(grid.hi).cast("bigint"), F.col("_block") + F.lit(width - step)) + F.lit(step)
    followed = rows.withColumns(
        {"_next": F.coalesce(F.lead(INTERVAL).over(ordered), end), REQUESTED: F.max("_head").over(ordered.rowsBetween(Window.unboundedPreceding, 0))}
    )
    # Of a key that was asked for more than once the last head is followed by points.
    reaching = followed.where(f"{REQUESTED} AND _next > {INTERVAL}")
    spanned = reaching.withColumn("_point", F.explode(F.expr(f"sequence({INTERVAL}, _next - {step}L, {step}L)")))
    own = F.col("_point") == F.col(INTERVAL)
    kept = spanned.where(~(F.col("_head") & own))
    return kept.select(*SOURCE_KEY, *(F.when(own, F.col(c)).alias(c) for c in rest), REQUESTED, F.col("_point").alias(INTERVAL), F.col("_point").alias(BUCKET))


def consolidate(
    samples: DataFrame,
    keys: DataFrame,
    grid: TimeGrid,
    max_heartbeat_ms: int,
    resolution_ms: int | None = None,
    partition_by: Sequence[str] = (*SERIES, BUCKET),
    with_attributes: bool = False,
) -> DataFrame:
    """Every interval of every (resource, metric, heartbeat) in ``keys``; with a resolution by ``partition_by``, so that a rollup needs no exchange."""
    measured = interval_values(samples, grid, max_heartbeat_ms, resolution_ms, with_attributes)
    if resolution_ms is None:
        filled = fill_gaps(measured, keys, grid)
    else:
        bucket = F.expr(ceiling_sql(INTERVAL, resolution_ms))
        blanks = spine(spread_keys(keys.select(*SOURCE_KEY)), grid, INTERVAL).withColumn(BUCKET, bucket)
        filled = fill(measured, blanks, [*SOURCE_KEY, BUCKET, INTERVAL], partition_by)
    return filled.withColumn("value", known_or_nan(F.col("value")))


def source_keys(resources: DataFrame, pairs: Sequence[tuple[str, int]]) -> DataFrame:
    """Every (resource, source, heartbeat) a descriptor asks for."""
    wanted = F.array(
        *(F.struct(F.lit(s).alias("metric"), F.lit(h).cast("bigint").alias(HEARTBEAT)) for s, h in pairs)
    )
    return resources.select("resource", F.inline(wanted))


def primary_data(
    samples: DataFrame,
    start_ms: int,
    end_ms: int,
    descriptor: ResultDescriptor,
    resources: DataFrame | None = None,
    hot_rows: int | None = None,
    with_attributes: bool = False,
) -> DataFrame:
    """Primary data of every resource on the descriptor's grid.

    Emits ``resource, ts_ms, metric, heartbeat_ms, value`` (and the merged
    ``attributes`` of the contributing samples) with a row for every interval.
    Without ``resources`` the spine covers the resources found in the samples.
    """
    grid = TimeGrid.covering(start_ms, end_ms, descriptor.step_ms)
    if resources is None:
        resources = samples.select("resource").distinct()
    # Earlier samples end before the grid and later ones are out of every heartbeat's reach.
    reaching = F.col("ts_ms").between(grid.lo - grid.step + 1, grid.hi + descriptor.max_heartbeat_ms)
    used = [*SERIES, "ts_ms", "value", *(["attributes"] if with_attributes else [])]
    present = samples.where(F.col("value").isNotNull() & reaching).select(*used)
    followed = previous_samples(present.where(F.col("metric").isin(descriptor.source_names)), hot_rows)
    pairs = descriptor.source_heartbeats
    consolidated = consolidate(
        with_heartbeats(followed, pairs),
        source_keys(resources, pairs),
        grid,
        descriptor.max_heartbeat_ms,
        with_attributes=with_attributes,
    )
    extra = ["attributes"] if with_attributes else []
    return consolidated.where(REQUESTED).select("resource", F.col(INTERVAL).alias("ts_ms"), "metric", HEARTBEAT, "value", *extra)

