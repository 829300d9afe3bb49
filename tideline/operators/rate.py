"""Counter samples become per-second rates; gauges pass through."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, FractionalType, IntegralType

from tideline.functions.grid import epoch_seconds
from tideline.functions.values import known_or_nan, unknown
from tideline.model import COUNTER_TYPES, GAUGE
from tideline.operators.neighbours import (
    CHUNK,
    PREV_ROW_TS,
    PREV_TS,
    PREV_VALUE,
    PREVIOUS_TIME,
    adjacent_samples,
    look_back,
    previous_samples,
)

RESETS = ("raw", "nan", "wrap32", "wrap64")


def _delta(counter_reset: str, kind: DataType) -> Column:
    """The difference to the previous value as a double, counter overflows undone.

    Whole and decimal numbers are subtracted, and 2^64 added, as decimals: a double
    that large has no room for the difference.
    """
    value, before = F.col("value"), F.col(PREV_VALUE)
    if isinstance(kind, IntegralType):
        value, before = value.cast("decimal(20,0)"), before.cast("decimal(20,0)")
    exact = value - before
    delta = exact.cast("double")
    if counter_reset == "raw":
        return delta
    fallen = (F.col("metric_type") == "COUNTER") & (exact < 0)
    replacement = {
        "nan": unknown(),
        "wrap32": delta + F.lit(float(2**32)),
        "wrap64": (exact + F.lit(str(2**64)).cast("decimal(20,0)")).cast("double"),
    }[counter_reset]
    return F.when(fallen, replacement).otherwise(delta)


def _value(counter_reset: str, stored: DataType) -> Column:
    elapsed = epoch_seconds(F.col("ts_ms")) - epoch_seconds(F.col(PREV_TS))
    kind = F.col("metric_type")
    return (
        F.when(kind == GAUGE, F.col("value").cast("double"))
        .when(kind.isin(*COUNTER_TYPES), known_or_nan(F.try_divide(_delta(counter_reset, stored), elapsed)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown metric type: "), kind)).cast("double"))
    )


def rated_samples(
    samples: DataFrame,
    sources: Sequence[str] | None = None,
    hot_rows: int | None = None,
    counter_reset: str = "raw",
    strict_adjacency: bool = False,
) -> DataFrame:
    """``rate`` with the columns ``prev_ts``, so that consolidation needs no window
    of its own, and ``_chunk`` where a series is hot (see ``previous_samples``)."""
    if counter_reset not in RESETS:
        raise ValueError(f"counter_reset must be one of {RESETS}, got {counter_reset!r}")

    stored = samples.schema["value"].dataType
    if counter_reset == "wrap64" and isinstance(stored, FractionalType) and not isinstance(stored, DecimalType):
        raise ValueError(f"wrap64 needs whole or decimal values, {stored.simpleString()} can't hold 64-bit counters")

    def rated(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"value": _value(counter_reset, stored), "metric_type": F.lit(GAUGE)}).drop(PREV_VALUE)

    present = samples.where(F.col("value").isNotNull())
    if not strict_adjacency:
        named = present if sources is None else present.where(F.col("metric").isin(list(sources)))
        return rated(previous_samples(named, hot_rows))

    # A resource's rows include metrics that are not asked for.  Dropped rows
    # change who precedes whom.
    adjacent = f"{PREV_ROW_TS} IS NULL OR {PREV_TS} = {PREV_ROW_TS}"
    kept = adjacent_samples(present, hot_rows).where(adjacent).drop(PREV_ROW_TS)
    if sources is not None:
        kept = kept.where(F.col("metric").isin(list(sources)))
    return look_back(rated(kept).drop(PREV_TS), [PREVIOUS_TIME])


def rate(
    samples: DataFrame,
    sources: Sequence[str] | None = None,
    hot_rows: int | None = None,
    counter_reset: str = "raw",
    strict_adjacency: bool = False,
) -> DataFrame:
    """Samples with every counter replaced by its rate over whole seconds.

    The first sample of a counter series, and one less than a whole second after
    its predecessor, is NaN.  ``counter_reset`` says what a negative COUNTER
    difference means: ``raw`` keeps it, ``nan`` makes it unknown, ``wrap32`` and
    ``wrap64`` undo an overflow; ``wrap64`` takes whole or decimal values only.  ``strict_adjacency`` drops samples, gauges too,
    whose metric is absent at the resource's immediately preceding timestamp.
    ``hot_rows`` overrides the size from which a series is split over tasks.
    """
    return rated_samples(samples, sources, hot_rows, counter_reset, strict_adjacency).drop(PREV_TS, CHUNK)
