"""Few Fourier coefficients per series, and what they say about its correlation with another.

A series on a grid of n buckets, less its mean and scaled to length 1, is a vector whose
inner product with another such vector is their Pearson coefficient.  In the orthonormal
Fourier basis both keep their length and their inner product (Parseval).  Of the first
coefficients of both, the inner product is known; the rest of each vector has the length that is
left to 1, so the rest of the inner product is at most the product of these lengths.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.grid import TimeGrid
from tideline.functions.values import known_or_zero
from tideline.model import SERIES

GRID = ["grid_lo", "grid_hi", "grid_step"]
SPECTRUM_SCHEMA = (
    "resource string, metric string, grid_lo bigint, grid_hi bigint, grid_step bigint, "
    "coefficients array<double>, slack double"
)

# Frequencies kept by default, with two coefficients each.
FREQUENCIES = 8

# What rounding may do to a coefficient of correlation besides what ``slack`` says.
ROUNDING = 1e-9


def of_grid(spectra: DataFrame, grid: TimeGrid) -> DataFrame:
    """The stored spectra of one grid."""
    return spectra.where((F.col("grid_lo") == grid.lo) & (F.col("grid_hi") == grid.hi) & (F.col("grid_step") == grid.step))


def spectra(averages: DataFrame, grid: TimeGrid, frequencies: int = FREQUENCIES) -> DataFrame:
    """The first Fourier coefficients of each series of ``resource, metric, ts_ms, value`` on the grid.

    Unknown values count as 0, as do buckets without a row, and coefficients are those of the series less its
    mean, at length 1.  Sums that merge: one exchange of partial aggregates, no series is
    gathered.  A constant series, which correlates with nothing, has NULL coefficients.  ``slack``
    bounds what rounding did to them, large where a series hardly varies about a large mean.
    """
    n = grid.size
    kept = max(0, min(frequencies, (n - 1) // 2))
    x = known_or_zero(F.col("value"))
    # A whole number of turns changes nothing, so angles stay small and exact.
    turn = f"((ts_ms - {grid.lo}L) div {grid.step}L)"
    waves = [F.expr(f"{wave}(pmod({turn} * {k}L, {n}L) * {2 * math.pi / n!r}D)") for k in range(1, kept + 1) for wave in ("cos", "sin")]
    sums = [F.sum(x * w).alias(f"_w{i}") for i, w in enumerate(waves)]
    totals = averages.where(F.col("ts_ms").between(grid.lo, grid.hi)).groupBy(*SERIES).agg(
        F.min(x).alias("_min"), F.max(x).alias("_max"), F.count(F.lit(1)).alias("_rows"), F.avg(x).alias("_mean"), F.var_pop(x).alias("_var"), *sums
    )
    # Buckets without a row are zeros: their part in mean and variance is added afterwards.
    present, absent = F.col("_rows").cast("double"), F.lit(float(n)) - F.col("_rows")
    spread = F.col("_var") * present + F.col("_mean") * F.col("_mean") * present * absent / F.lit(float(n))
    low, high = (F.when(absent > 0, f(F.col(c), F.lit(0.0))).otherwise(F.col(c)) for f, c in ((F.least, "_min"), (F.greatest, "_max")))
    length = F.sqrt(spread)
    scale = F.lit(math.sqrt(2 / n)) / length
    varies = (low < high) & (length > 0)
    coefficients = F.array(*(F.col(f"_w{i}") * scale for i in range(len(waves)))).cast("array<double>")
    slack = F.lit(8 * n * math.sqrt(n) * 2.0**-52) * F.greatest(F.abs(low), F.abs(high)) / length
    return totals.select(
        *SERIES,
        *(F.lit(v).cast("bigint").alias(c) for c, v in zip(GRID, (grid.lo, grid.hi, grid.step))),
        F.when(varies, coefficients).alias("coefficients"),
        F.when(varies, slack).alias("slack"),
    )


def bounds(candidates: DataFrame, target: DataFrame) -> DataFrame:
    """``candidates`` with ``lower`` and ``upper``, between which the size of their coefficient of correlation lies.

    Both are spectra of one grid, ``target`` those of one series.  Constant series have no
    coefficient and are left out.
    """
    own = target.where("coefficients IS NOT NULL").select(*GRID, F.col("coefficients").alias("_own"), F.col("slack").alias("_own_slack"))
    # One row, whatever the input.
    both = candidates.where("coefficients IS NOT NULL").join(F.broadcast(own), GRID)
    product = F.expr("aggregate(zip_with(coefficients, _own, (a, b) -> a * b), 0D, (s, v) -> s + v)")
    rest = [F.expr(f"sqrt(greatest(0D, 1D - aggregate({c}, 0D, (s, v) -> s + v * v)))") for c in ("coefficients", "_own")]
    off = F.col("slack") + F.col("_own_slack") + F.lit(ROUNDING)
    # Rounding in a length near 1 shows as its root in the rest.
    reach = (rest[0] + F.sqrt(F.lit(2.0) * off)) * (rest[1] + F.sqrt(F.lit(2.0) * off)) + off
    bounded = both.withColumns({"_product": F.abs(product), "_reach": reach})
    return bounded.select(
        *candidates.columns, F.greatest(F.lit(0.0), F.col("_product") - F.col("_reach")).alias("lower"), F.least(F.lit(1.0), F.col("_product") + F.col("_reach")).alias("upper")
    )


def hopeful(bounded: DataFrame, top_n: int) -> DataFrame:
    """The candidates that can be among the ``top_n`` of largest coefficient, ties with the last of them included.

    At least ``top_n`` candidates have a coefficient no smaller than the ``top_n``-th best lower bound;
    who can't reach it is out.  With fewer candidates all stay.
    """
    # top_n rows at most are brought together.
    best = bounded.orderBy(F.col("lower").desc()).limit(top_n).select(*GRID, "lower")
    needed = best.groupBy(*GRID).agg(F.when(F.count(F.lit(1)) >= top_n, F.min("lower")).otherwise(0.0).alias("_needed"))
    return bounded.join(F.broadcast(needed), GRID).where(F.col("upper") + F.lit(ROUNDING) >= F.col("_needed")).drop("_needed")
