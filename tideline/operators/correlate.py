"""Correlation of many aligned series with one, and the top-N report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.values import known_or_nan, known_or_zero, pearson
from tideline.model import SERIES

# The target has one (bucket, value) row per bucket of the request.  Up to this
# many rows (16 bytes each) it is broadcast, beyond it is joined by shuffle.
BROADCAST_MAX_BUCKETS = 1_000_000

NAN_POLICIES = ("propagate", "zero")


def pair_with_target(candidates: DataFrame, target: DataFrame, target_rows: int) -> DataFrame:
    """Aligns each candidate value with the target's value of the same bucket.

    ``target_rows`` is the exact number of target rows, known from the grid.
    """
    side = target.select("ts_ms", F.col("value").alias("target_value"))
    if target_rows <= BROADCAST_MAX_BUCKETS:
        side = F.broadcast(side)
    return candidates.join(side, "ts_ms")


def coefficients(pairs: DataFrame, nan_policy: str = "propagate", drop_nan: bool = False) -> DataFrame:
    """Pearson coefficient per candidate series.

    ``propagate``: an unknown value makes the coefficient NaN.  ``zero``: unknown
    values count as 0.
    """
    if nan_policy not in NAN_POLICIES:
        raise ValueError(f"nan_policy must be one of {NAN_POLICIES}, got {nan_policy!r}")
    clean = known_or_zero if nan_policy == "zero" else known_or_nan
    values = pairs.select(*SERIES, clean(F.col("target_value")).alias("x"), clean(F.col("value")).alias("y"))
    result = values.groupBy(*SERIES).agg(pearson(F.col("x"), F.col("y")).alias("coefficient"))
    return result.where(~F.isnan("coefficient")) if drop_nan else result


def top_candidates(candidates: DataFrame, scored: DataFrame, top_n: int) -> DataFrame:
    """The ``top_n`` candidates of largest absolute coefficient, NaN first.

    Every entry of the candidate list is ranked, a repeated one repeatedly; ties
    keep list order (``ordinal`` where the list has one), then series order.
    """
    order = [F.abs("coefficient").desc_nulls_last()]
    order += [F.col("ordinal").asc()] if "ordinal" in candidates.columns else []
    listed = candidates.join(scored, SERIES)
    return listed.orderBy(*order, *SERIES).limit(top_n).select(*SERIES, "coefficient")
