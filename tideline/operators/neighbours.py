"""The previous sample of each sample, with hot series split over time.

A window over a whole series puts that series into one task.  Where an input is large
enough for that to matter, the samples of each series are counted first.  Series of more
than ``HOT_ROWS`` samples are cut into time chunks of about equal counts, each a window
partition of its own; the first sample of a chunk takes its predecessor from a summary with
one row per chunk, made of the same exchanged rows.  The result is the plain ``lag``
however a series is cut.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.model import SERIES

CHUNK = "_chunk"
PREV_TS = "prev_ts"
PREV_VALUE = "prev_value"
PREV_ROW_TS = "prev_row_ts"

# Samples one window partition should hold at most.
HOT_ROWS = 5_000_000

# An input of no more bytes is that of a task or two: whatever its series, no task gets more.
PLAIN_BYTES = 256 * 2**20

# Stored input that one task should stand for where it makes more rows than it reads.
TASK_BYTES = 4 * 2**20

# From here on the planner says that it doesn't know a size.
UNKNOWN_BYTES = 2**60

# Cuts per chunk at the least, and cuts side by side in the list of a key.
CUTS_PER_CHUNK = 4
CUT_BLOCK = 64


def hot_groups(samples: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """Groups of more than ``hot_rows`` samples and their size: at most one row per ``hot_rows`` input rows."""
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(f"_rows > {hot_rows}L")


def planned_bytes(rows: DataFrame) -> int:
    """What the planner takes the size of the rows for, from the files they are read from; starts no job."""
    return int(str(rows._jdf.queryExecution().analyzed().stats().sizeInBytes()))


def input_bytes(rows: DataFrame) -> int:
    """The size of what the rows are read from, each table once; starts no job.

    What is sent to all tasks, such as a list of hot groups, has a size the planner doesn't know; it doesn't count.
    """
    plan = rows._jdf.queryExecution().analyzed()
    leaves = plan.collectLeaves()
    total = _total_bytes(leaves.apply(i) for i in range(leaves.size()))
    return total if total < UNKNOWN_BYTES else _total_bytes(_exchanged_leaves(plan))


def _total_bytes(leaves) -> int:
    return sum({leaf.canonicalized().hashCode(): int(str(leaf.stats().sizeInBytes())) for leaf in leaves}.values())


def _exchanged_leaves(plan) -> list:
    if plan.nodeName() == "ResolvedHint" and "broadcast" in plan.hints().toString():
        return []
    children = plan.children()
    below = [leaf for i in range(children.size()) for leaf in _exchanged_leaves(children.apply(i))]
    return below if children.size() else [plan]


def is_large(rows: DataFrame) -> bool:
    """Whether what the rows are read from is more than a task's, as far as the planner knows."""
    return TASK_BYTES < input_bytes(rows) < UNKNOWN_BYTES


def spread(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows, exchanged by ``keys``, into parts small enough for tasks that make many rows of each.

    Adaptive execution joins parts by the bytes that are exchanged, which say little of the
    intervals and gaps that a task makes of them; it keeps a number that is given. That is the
    session's, or more where the input asks for them.
    """
    if not is_large(rows):
        return rows.repartition(*keys)
    session = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(session, -(-input_bytes(rows) // TASK_BYTES)), *keys)


def spread_keys(keys: DataFrame) -> DataFrame:
    """Keys of a spine: a few bytes each, so that one task would get them all, and make all rows of theirs."""
    return spread(keys, SERIES) if is_large(keys) else keys


def equi_depth_cuts(samples: DataFrame, keys: Sequence[str], hot_rows: int) -> list[tuple]:
    """Per hot group its key and the times at which its chunks begin, in blocks of ``CUT_BLOCK``.

    Two jobs, the second only if there is a hot group.  Times are taken from quantile
    summaries that tasks build and merge, so chunks follow the counts of rows: where they
    are dense, chunks are short.  Of n rows no chunk has more than about n / ``CUTS_PER_CHUNK``
    beyond what one moment holds; in all there are at most 2 * ``CUTS_PER_CHUNK`` cuts per ``hot_rows`` rows.
    """
    hot = hot_groups(samples, keys, hot_rows).collect()
    if not hot:
        return []
    listed = F.broadcast(samples.sparkSession.createDataFrame(hot))
    # As many cuts as the largest group needs; a smaller one takes each ``_every``-th.
    cuts = -(-CUTS_PER_CHUNK * max(r["_rows"] for r in hot) // hot_rows)
    shares = F.expr(f"array({', '.join(f'{i / cuts!r}D' for i in range(1, cuts + 1))})")
    accuracy = F.lit(min(8 * cuts, 2**31 - 1))
    every = F.expr(f"greatest(1L, ({cuts}L * {hot_rows}L) div (2L * _rows))")
    found = (
        samples.join(listed, list(keys))
        .groupBy(*keys, every.alias("_every"))
        .agg(F.percentile_approx("ts_ms", shares, accuracy).alias("_cuts"))
        .select(*keys, F.expr("array_distinct(filter(_cuts, (c, i) -> (i + 1) % _every = 0))").alias("_cuts"))
    )
    blocks = F.expr(f"transform(sequence(0, greatest(size(_cuts) - 1, 0), {CUT_BLOCK}), i -> slice(_cuts, i + 1, {CUT_BLOCK}))")
    return found.select(*keys, blocks.alias("_cuts")).collect()


def chunked(samples: DataFrame, keys: Sequence[str] = SERIES, hot_rows: int | None = None) -> DataFrame:
    """The samples, with the column ``_chunk`` if a group is hot.

    Inputs of more than ``PLAIN_BYTES``, and those for which ``hot_rows`` is given, are counted by
    key first, by a job that reads no other column of a stored table; others are left as they are
    without one.  Hot groups are cut by their row counts (``equi_depth_cuts``).  The cuts go
    through the driver, so that a chunk stays the same when lost tasks run again.  Chunks of
    other groups are all 0.  Samples without resource, metric or time belong to no series
    and are left out.
    """
    named = samples.where("resource IS NOT NULL AND metric IS NOT NULL AND ts_ms IS NOT NULL")
    if hot_rows is None and planned_bytes(named) <= PLAIN_BYTES:
        return named
    found = equi_depth_cuts(named, keys, HOT_ROWS if hot_rows is None else hot_rows)
    if not found:
        return named
    schema = ", ".join(f"{k} string" for k in keys) + ", _cuts array<array<bigint>>"
    listed = F.broadcast(samples.sparkSession.createDataFrame([tuple(r) for r in found], schema))
    # First the block, by its first cut, then the place in it.
    block = "size(filter(_cuts, b -> b[0] <= ts_ms))"
    place = f"CASE WHEN {block} = 0 THEN 0L ELSE ({block} - 1L) * {CUT_BLOCK}L + size(filter(_cuts[{block} - 1], c -> c <= ts_ms)) END"
    chunk = F.expr(f"CASE WHEN _cuts IS NULL THEN 0L ELSE {place} END")
    return named.join(listed, list(keys), "left").withColumn(CHUNK, chunk).drop("_cuts").where(f"{CHUNK} IS NOT NULL")


@dataclass(frozen=True)
class LookBack:
    """Columns (new name: source column) taken from the previous sample of a
    group, or, with ``distinct_ts``, from its previous distinct timestamp."""

    keys: Sequence[str]
    columns: Mapping[str, str]
    distinct_ts: bool = False

    def within(self, chunk: Sequence[str], prefix: str = "") -> dict[str, Column]:
        ordered = Window.partitionBy(*self.keys, *chunk).orderBy("ts_ms")
        if self.distinct_ts:
            earlier = ordered.rangeBetween(Window.unboundedPreceding, -1)
            return {prefix + name: F.max(source).over(earlier) for name, source in self.columns.items()}
        return {prefix + name: F.lag(source).over(ordered) for name, source in self.columns.items()}

    def carried(self, pieces: DataFrame) -> DataFrame:
        """What each chunk's first sample looks back on, one row per chunk.

        The last sample is taken with all its columns, so that this reads the very
        exchange that the windows read.
        """
        last = F.max_by(F.struct(*pieces.columns), "ts_ms").alias("_last")
        tails = pieces.groupBy(*self.keys, CHUNK).agg(last)
        tails = tails.select(*self.keys, CHUNK, *(F.col("_last")[source].alias(f"_tail_{n}") for n, source in self.columns.items()))
        by_chunk = Window.partitionBy(*self.keys).orderBy(CHUNK)
        looked_back = (F.lag(f"_tail_{n}").over(by_chunk).alias(f"_carried_{n}") for n in self.columns)
        return tails.select(*self.keys, CHUNK, *looked_back)


PREVIOUS_SAMPLE = LookBack(SERIES, {PREV_TS: "ts_ms", PREV_VALUE: "value"})
PREVIOUS_TIME = LookBack(SERIES, {PREV_TS: "ts_ms"})
PREVIOUS_ROW = LookBack(["resource"], {PREV_ROW_TS: "ts_ms"}, distinct_ts=True)


def look_back(samples: DataFrame, looks: Sequence[LookBack], partition_by: Sequence[str] = SERIES) -> DataFrame:
    """Adds the columns of all ``looks``.

    One exchange by ``partition_by``, which every key of ``looks`` contains,
    serves all their windows, and the summaries of chunks where there are any.
    """
    if CHUNK not in samples.columns:
        rows = samples if list(partition_by) == SERIES else spread(samples, partition_by)
        for look in looks:
            rows = rows.withColumns(look.within([]))
        return rows

    # Without this a preceding exchange by the keys alone would do for the windows.
    pieces = spread(samples, [*partition_by, CHUNK])
    rows = pieces
    for look in looks:
        rows = rows.withColumns(look.within([CHUNK], "_lag_"))
    for look in looks:
        first = f"_lag_{next(iter(look.columns))} IS NULL"
        names = list(look.columns)
        found = {n: F.expr(f"CASE WHEN {first} THEN _carried_{n} ELSE _lag_{n} END") for n in names}
        spent = [f"_carried_{n}" for n in names] + [f"_lag_{n}" for n in names]
        rows = rows.join(look.carried(pieces), [*look.keys, CHUNK], "left").withColumns(found).drop(*spent)
    return rows


def _stored_by_key(rows: DataFrame) -> bool:
    """Whether the rows come from buckets, so that an exchange may be spared."""
    return rows._jdf.queryExecution().sparkPlan().outputPartitioning().toString().startswith("hashpartitioning")


def previous_samples(samples: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """The samples with ``prev_ts`` and ``prev_value``, by series, or by series and ``_chunk`` where one is hot."""
    pieces = chunked(samples, SERIES, hot_rows)
    # Samples stored by series stay where they are; what a task or two can read needs no number.
    if CHUNK not in pieces.columns and is_large(pieces) and not _stored_by_key(pieces):
        pieces = spread(pieces, SERIES)
    return look_back(pieces, [PREVIOUS_SAMPLE])


def adjacent_samples(samples: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """The samples with ``prev_ts``, ``prev_value`` and ``prev_row_ts``: the latest
    earlier timestamp at which the resource has a sample of any metric.

    By resource, or by resource and ``_chunk`` where one is hot; a chunk then has about
    ``hot_rows`` samples at most, of all metrics together, unless one moment has more.
    """
    return look_back(chunked(samples, ["resource"], hot_rows), [PREVIOUS_ROW, PREVIOUS_SAMPLE], ["resource"])


def with_previous(samples: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Adds ``prev_ts`` and ``prev_value``, NULL for the first sample of a series.

    ``(resource, metric, ts_ms)`` must be unique.
    """
    return previous_samples(samples, hot_rows).drop(CHUNK)
