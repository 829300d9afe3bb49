"""The exact top-N over many candidates, of which stored spectra leave few to be read.

``write_spectra`` keeps a few numbers per series for a grid of buckets that will be asked
for.  A request on that grid bounds every candidate's coefficient by them and reads the samples of
only those that can be among the best.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.grid import TimeGrid
from tideline.model import SERIES, CorrelationRequest, Metric
from tideline.operators.rollup import bucket_grid
from tideline.operators.spectrum import FREQUENCIES, GRID, SPECTRUM_SCHEMA, bounds, hopeful, of_grid, spectra
from tideline.plans.correlation import correlate_known
from tideline.plans.measurements import average_series
from tideline.sources.requests import candidates_from_list, prefiltered, without_target
from tideline.sources.samples import in_range


def request_grid(request: CorrelationRequest) -> TimeGrid:
    """The buckets that a request compares."""
    return bucket_grid(request.start_ms, request.end_ms, request.rollup_ms)


def series_spectra(samples: DataFrame, keys: DataFrame, request: CorrelationRequest, frequencies: int = FREQUENCIES, **options) -> DataFrame:
    """Spectra of the series in ``keys`` over the buckets of a request, whatever its target."""
    reach = options.pop("lookback_ms", None)
    read = in_range(samples, request.start_ms - (request.rollup_ms if reach is None else reach), request.end_ms)
    wanted = keys.select(*SERIES).distinct()
    averages = average_series(prefiltered(read, wanted, SERIES), wanted, request.start_ms, request.end_ms, request.resolution_ms, request.rollup_ms, **options)
    return spectra(averages, request_grid(request), frequencies)


def write_spectra(found: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder per grid, by series within, so that a lookup of one series skips most of it."""
    found.repartitionByRange(*GRID, *SERIES).sortWithinPartitions(*SERIES).write.mode(mode).partitionBy(*GRID).parquet(path)


def read_spectra(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPECTRUM_SCHEMA).parquet(path)


def candidates_left(stored: DataFrame, request: CorrelationRequest, candidates: DataFrame) -> DataFrame:
    """The candidates whose samples have to be read: a list as given, less the entries that can't be among the best.

    Without a spectrum of the target nothing correlates and nothing is left.
    """
    on_grid = of_grid(stored, request_grid(request))
    target = on_grid.where((F.col("resource") == request.target.resource) & (F.col("metric") == request.target.metric))
    # Each entry of the list is ranked, so each has its bound counted.
    listed = candidates.join(on_grid, SERIES)
    return hopeful(bounds(listed, target), request.top_n).select(*candidates.columns)


def correlate_pruned(samples: DataFrame, stored: DataFrame, request: CorrelationRequest, candidates: DataFrame | Iterable[Metric], **options) -> DataFrame:
    """``correlate_known`` with the same result, reading the samples of few candidates.

    ``stored`` has the spectra of target and candidates on the grid of the request, made from these
    samples with the same options.
    """
    if not isinstance(candidates, DataFrame):
        candidates = candidates_from_list(samples.sparkSession, candidates)
    left = candidates_left(stored, request, without_target(candidates, request.target))
    return correlate_known(samples, request, left, **options)
