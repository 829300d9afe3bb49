"""Millisecond time arithmetic and interval grids.

Timestamps and durations are BIGINT milliseconds everywhere.  An interval is
named by its ceiling ``T`` and covers ``(T - step, T]``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MILLIS_PER_SECOND = 1_000
MILLIS_PER_HOUR = 3_600_000
MILLIS_PER_DAY = 86_400_000

# The column that names an interval.
INTERVAL = "interval_ms"

# Longest array one key contributes to a spine before the next explode.
SPINE_BLOCK = 10_000


def seconds(n: float) -> int:
    return int(n * MILLIS_PER_SECOND)


def hours(n: float) -> int:
    return int(n * MILLIS_PER_HOUR)


def days(n: float) -> int:
    return int(n * MILLIS_PER_DAY)


def epoch_seconds(ts_ms: Column) -> Column:
    """Whole seconds of a millisecond timestamp, truncated."""
    return F.call_function("div", ts_ms, F.lit(MILLIS_PER_SECOND))


def to_timestamp(ts_ms: Column) -> Column:
    return F.timestamp_millis(ts_ms)


def from_timestamp(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def step_floor(ts_ms: Column, step_ms: int) -> Column:
    """Largest multiple of the step that is not after ``ts_ms``."""
    return ts_ms - F.pmod(ts_ms, F.lit(step_ms).cast("bigint"))


def step_ceiling(ts_ms: Column, step_ms: int) -> Column:
    """Smallest multiple of the step that is not before ``ts_ms``."""
    return ts_ms + F.pmod(-ts_ms, F.lit(step_ms).cast("bigint"))


def floor_sql(ts_ms: str, step_ms: int) -> str:
    """``step_floor`` of a SQL expression, as SQL."""
    return f"({ts_ms} - pmod({ts_ms}, {step_ms}L))"


def ceiling_sql(ts_ms: str, step_ms: int) -> str:
    """``step_ceiling`` of a SQL expression, as SQL."""
    return f"({ts_ms} + pmod(-({ts_ms}), {step_ms}L))"


def is_multiple(duration_ms: int, of_ms: int) -> bool:
    return duration_ms % of_ms == 0


@dataclass(frozen=True)
class TimeGrid:
    """Interval ceilings ``lo, lo + step, ..., hi``; empty when ``lo > hi``."""

    lo: int
    hi: int
    step: int

    @classmethod
    def covering(cls, start_ms: int, end_ms: int, step_ms: int) -> "TimeGrid":
        """Floor of the start to ceiling of the end, both ends included."""
        if step_ms <= 0:
            raise ValueError(f"step must be positive, got {step_ms}")
        return cls(start_ms - start_ms % step_ms, end_ms + -end_ms % step_ms, step_ms)

    @property
    def size(self) -> int:
        return max(0, (self.hi - self.lo) // self.step + 1)

    def starting_at(self, lo: int) -> "TimeGrid":
        return TimeGrid(max(self.lo, lo), self.hi, self.step)

    def points_within(self, bucket: str, width_ms: int) -> Column:
        """How many grid points fall into ``(bucket - width, bucket]``."""
        upper = f"least({bucket}, {self.hi}L)"
        lower = f"greatest({bucket} - {width_ms}L, {self.lo - self.step}L)"
        return F.expr(f"greatest(({upper} - {lower}) div {self.step}L, 0L)")


def spine(keys: DataFrame, grid: TimeGrid, name: str = "ts_ms") -> DataFrame:
    """One row per key and grid point, generated on the executors.

    Long grids are generated in two levels so that no single array holds more
    than ``SPINE_BLOCK`` points.
    """
    lo, hi, step = (F.lit(v).cast("bigint") for v in (grid.lo, grid.hi, grid.step))
    if grid.size == 0:
        return keys.withColumn(name, lo).where(F.lit(False))
    if grid.size <= SPINE_BLOCK:
        return keys.withColumn(name, F.explode(F.sequence(lo, hi, step)))
    block = grid.step * SPINE_BLOCK
    blocks = keys.withColumn("_block", F.explode(F.sequence(lo, hi, F.lit(block).cast("bigint"))))
    last = F.least(hi, F.col("_block") + F.lit(block - grid.step))
    return blocks.withColumn(name, F.explode(F.sequence(F.col("_block"), last, step))).drop("_block")
