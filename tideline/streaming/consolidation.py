"""Primary data of samples that keep arriving, in any order within an allowed delay.

Per series the state holds the last sample that was counted, samples that the watermark has
not passed, and the sums of intervals that later samples may still reach.  A sample is counted
when the watermark passes it: nothing earlier can come then, so it meets the
predecessor that it has in a batch.  An interval is closed, and comes out once, when the watermark has
passed every sample that reaches it.  The state of a series is bounded by the delay and the
heartbeat, however long it lives.  Calls, timers and state are one for a group of series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tideline.functions.grid import TimeGrid
from tideline.functions.values import known_or_nan
from tideline.model import SERIES, ResultDescriptor
from tideline.operators.consolidate import HEARTBEAT

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

PRIMARY_SCHEMA = f"resource string, ts_ms bigint, metric string, {HEARTBEAT} bigint, value double"
STATE_SCHEMA = (
    "series array<struct<resource: string, metric: string, previous: bigint, next: bigint, waiting_ts: array<bigint>, waiting: array<double>, "
    f"interval: array<bigint>, {HEARTBEAT}: array<bigint>, weighted: array<double>, known: array<bigint>, unknown: array<bigint>>>"
)

# Groups that series are dealt to by hash, each a key of the state: a call and its round trips to the
# state cost milliseconds, whatever they are for. Fixed while a stream keeps its checkpoint.
GROUP = "_group"
GROUPS = 4096


def _ceiling(ts: int, step: int) -> int:
    return ts + -ts % step


class Consolidation:
    """One series between two calls: plain values, no Spark."""

    def __init__(self, heartbeats: list[int], reach: int, grid: TimeGrid):
        self.heartbeats, self.reach, self.grid = heartbeats, reach, grid
        self.previous: int | None = None
        self.next = grid.lo
        self.waiting: dict[int, float] = {}
        # (interval, heartbeat): weighted sum, known and unknown time.
        self.open: dict[tuple[int, int], list] = {}

    def count(self, ts: int, value: float) -> None:
        """Adds a sample that nothing earlier follows to the intervals it reaches."""
        step, reach, before = self.grid.step, self.reach, self.previous
        first = max(_ceiling(ts - reach, step), self.grid.lo)
        if before is not None:
            first = max(first, _ceiling(before + 1, step))
        last = min(_ceiling(ts, step), ts + reach - (ts + reach) % step, self.grid.hi)
        for interval in range(first, last + 1, step):
            floor = interval - step
            follows = before is not None and before > floor and before >= interval - reach
            elapsed = min(ts, interval) - before if follows else ts - floor
            for heartbeat in self.heartbeats:
                sums = self.open.setdefault((interval, heartbeat), [0.0, 0, 0])
                if elapsed < heartbeat:
                    sums[0] += value * elapsed
                    sums[1] += elapsed
                else:
                    sums[2] += elapsed
        self.previous = ts

    def advance(self, watermark: int) -> list[tuple[int, int, float]]:
        """Counts the samples that the watermark has passed and closes intervals: interval, heartbeat, value."""
        for ts in sorted(t for t in self.waiting if t <= watermark):
            value = self.waiting.pop(ts)
            # An interval that a sample this late could reach is closed; none such comes in order.
            if self.previous is None or ts > self.previous:
                self.count(ts, value)
        closed = []
        while self.next <= self.grid.hi and self.next + self.reach <= watermark:
            for heartbeat in self.heartbeats:
                weighted, known, unknown = self.open.pop((self.next, heartbeat), (0.0, 0, 0))
                closed.append((self.next, heartbeat, weighted / known if unknown < known else math.nan))
            self.next += self.grid.step
        return closed

    def due(self) -> int | None:
        """The watermark at which there is something to do."""
        times = [min(self.waiting)] if self.waiting else []
        if self.next <= self.grid.hi:
            times.append(self.next + self.reach)
        return min(times) if times else None

    def packed(self) -> tuple:
        keys = sorted(self.open)
        sums = [self.open[k] for k in keys]
        return (
            self.previous,
            self.next,
            list(self.waiting),
            list(self.waiting.values()),
            [i for i, _ in keys],
            [h for _, h in keys],
            *([s[j] for s in sums] for j in range(3)),
        )

    def unpack(self, state: tuple) -> "Consolidation":
        self.previous, self.next = state[0], state[1]
        self.waiting = dict(zip(state[2], state[3]))
        self.open = {(i, h): [w, k, u] for i, h, w, k, u in zip(*state[4:9])}
        return self


class PrimaryProcessor(StatefulProcessor):
    """``Consolidation`` of the series of a group; a timer per group wakes those that no sample does."""

    def __init__(self, pairs: list[tuple[str, int]], reach: int, grid: TimeGrid):
        self.heartbeats: dict[str, list[int]] = {}
        for source, heartbeat in pairs:
            self.heartbeats.setdefault(source, []).append(heartbeat)
        self.reach, self.grid = reach, grid

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("group", STATE_SCHEMA)

    def _fresh(self, metric: str) -> Consolidation:
        return Consolidation(self.heartbeats[metric], self.reach, self.grid)

    def _restored(self) -> dict[tuple[str, str], Consolidation]:
        state = self.state.get()
        return {} if state is None else {(r[0], r[1]): self._fresh(r[1]).unpack(tuple(r[2:])) for r in state[0]}

    def _advanced(self, group: dict[tuple[str, str], Consolidation], watermark: int) -> Iterator[pd.DataFrame]:
        closed = [(key, series.advance(watermark)) for key, series in group.items()]
        due = min((at for at in (series.due() for series in group.values()) if at is not None), default=None)
        # The one that has just fired is still listed, and goes by itself.
        set_for = [at for at in self.handle.listTimers() if at > watermark]
        if due is None:
            for at in set_for:
                self.handle.deleteTimer(at)
        elif not set_for or due < min(set_for):
            for at in set_for:
                self.handle.deleteTimer(at)
            # A timer fires when the watermark is beyond it.
            self.handle.registerTimer(max(due, watermark + 1))
        self.state.update(([(*key, *series.packed()) for key, series in group.items()],))
        if any(rows for _, rows in closed):
            intervals, heartbeats, values = zip(*chain.from_iterable(rows for _, rows in closed))
            resources, metrics = ([name for key, rows in closed for name in [key[i]] * len(rows)] for i in (0, 1))
            yield pd.DataFrame({"resource": resources, "ts_ms": intervals, "metric": metrics, HEARTBEAT: heartbeats, "value": values})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        group = self._restored()
        for batch in rows:
            for resource, metric, ts, value in zip(*(batch[c].tolist() for c in (*SERIES, "ts_ms", "value"))):
                if (resource, metric) not in group:
                    group[resource, metric] = self._fresh(metric)
                group[resource, metric].waiting[ts] = value
        yield from self._advanced(group, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advanced(self._restored(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_primary_data(samples: DataFrame, start_ms: int, end_ms: int, descriptor: ResultDescriptor, delay_ms: int, groups: int = GROUPS) -> DataFrame:
    """Primary data of the series of a stream of samples, each interval appended once it is closed.

    The rows are those of ``primary_data`` over the samples that arrive in time, for every series that
    has one, as far as the watermark, ``delay_ms`` behind the latest sample, has passed an interval and
    the widest heartbeat.  A sample at or before the watermark when it arrives is late and left out, the
    same for all intervals.  Of repeated samples that wait, the one arriving last counts.
    A task holds one of the ``groups`` at a time; like the number of shuffle partitions theirs stays the same while the checkpoint is kept.
    The session's state store has to be RocksDB (``with_rocks_db``).
    """
    grid = TimeGrid.covering(start_ms, end_ms, descriptor.step_ms)
    reach = descriptor.max_heartbeat_ms
    within = F.col("_time").between(*(F.timestamp_millis(F.lit(v)) for v in (grid.lo - grid.step + 1, grid.hi + reach)))
    named = samples.where("resource IS NOT NULL AND metric IS NOT NULL AND ts_ms IS NOT NULL AND value IS NOT NULL")
    # The watermark follows all samples, those of other metrics and times too; one condition on the
    # time keeps the optimizer from dropping them before.
    timed = named.withColumn("_time", F.timestamp_millis("ts_ms")).withWatermark("_time", f"{delay_ms} milliseconds")
    asked = F.when(within, F.col("metric").isin(descriptor.source_names)).otherwise(False)
    group = F.pmod(F.xxhash64(*SERIES), F.lit(groups)).cast("int").alias(GROUP)
    own = timed.where(asked).select(group, *SERIES, "_time", "ts_ms", F.col("value").cast("double").alias("value"))
    processor = PrimaryProcessor(descriptor.source_heartbeats, reach, grid)
    closed = own.groupBy(GROUP).transformWithStateInPandas(processor, PRIMARY_SCHEMA, "Append", "EventTime")
    # Arrow takes NaN in pandas for a missing value.
    return closed.withColumn("value", known_or_nan(F.col("value")))


@contextmanager
def with_rocks_db(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which these stages need; the setting is put back afterwards."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def run_available(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what a stream has to give now to a table, and ends; the next run goes on where this one stopped."""
    with with_rocks_db(rows.sparkSession):
        query = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
        query.awaitTermination()
