"""Which candidate series correlate most with a target over a time range?

One lazy plan serves all candidates.  The requested resolution is the interval
step; series are compared at ``ROLLUP_STEPS`` times that.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.values import unknown
from tideline.model import DEFAULT_TOP_N, SERIES, CorrelationRequest, JobConfig, Metric
from tideline.operators.correlate import coefficients, pair_with_target, top_candidates
from tideline.operators.rollup import bucket_grid
from tideline.plans.measurements import average_series
from tideline.sources.catalog import DEFAULT_CONTEXT, Catalog, all_metrics
from tideline.sources.requests import candidates_from_list, prefiltered, without_target
from tideline.sources.samples import in_range, read_samples

# True on the rows of the target.
IS_TARGET = "_is_target"

SAMPLES_PATH_CONF = "spark.tideline.samples.path"


def correlate(
    samples: DataFrame,
    request: CorrelationRequest,
    candidates: DataFrame | Iterable[Metric],
    nan_policy: str = "propagate",
    drop_nan: bool = False,
    lookback_ms: int | None = None,
    pad_first_bucket: bool = True,
    hot_rows: int | None = None,
) -> DataFrame:
    """The top candidates as ``resource, metric, coefficient``, best first.

    The target itself is never a candidate.  A candidate without samples has
    unknown values throughout.
    """
    if not isinstance(candidates, DataFrame):
        candidates = candidates_from_list(samples.sparkSession, candidates)
    listed = without_target(candidates, request.target)
    scored = _others_scored(samples, request, listed, nan_policy, drop_nan, lookback_ms, pad_first_bucket, hot_rows)
    return top_candidates(listed, scored, request.top_n)


def score(
    samples: DataFrame,
    request: CorrelationRequest,
    candidates: DataFrame,
    nan_policy: str = "propagate",
    drop_nan: bool = False,
    lookback_ms: int | None = None,
    pad_first_bucket: bool = True,
    hot_rows: int | None = None,
) -> DataFrame:
    """The coefficient of every distinct candidate, unranked; NaN for the target itself."""
    scored = _others_scored(samples, request, candidates, nan_policy, drop_nan, lookback_ms, pad_first_bucket, hot_rows)
    if drop_nan:
        return scored
    own = (F.col("resource") == request.target.resource) & (F.col("metric") == request.target.metric)
    itself = candidates.where(own).select(*SERIES).distinct()
    return scored.unionByName(itself.withColumn("coefficient", unknown()))


def _others_scored(samples, request, candidates, nan_policy, drop_nan, lookback_ms, pad_first_bucket, hot_rows) -> DataFrame:
    """The coefficient of every distinct candidate but the target.

    Candidates and target are reduced together, in one pass over the samples; the target's buckets
    are told apart by a mark that the reduced rows carry.
    """
    target, start, end = request.target, request.start_ms, request.end_ms
    reach = request.rollup_ms if lookback_ms is None else lookback_ms
    read = in_range(samples, start - reach, end)
    listed = without_target(candidates.select(*SERIES).distinct(), target)
    own = candidates_from_list(samples.sparkSession, [target]).select(*SERIES)
    keys = listed.withColumn(IS_TARGET, F.lit(False)).unionByName(own.withColumn(IS_TARGET, F.lit(True)))
    averages = average_series(
        prefiltered(read, keys, SERIES), keys, start, end, request.resolution_ms, request.rollup_ms, pad_first_bucket, hot_rows
    )
    pairs = pair_with_target(averages.where(~F.col(IS_TARGET)), averages.where(IS_TARGET), bucket_grid(start, end, request.rollup_ms).size)
    return coefficients(pairs, nan_policy, drop_nan)


def correlate_known(samples: DataFrame, request: CorrelationRequest, candidates, **options) -> DataFrame:
    """The in-process form: unknown values count as 0, undefined results are dropped."""
    return correlate(samples, request, candidates, nan_policy="zero", drop_nan=True, **options)


def correlate_catalog(
    samples: DataFrame,
    request: CorrelationRequest,
    catalog: Catalog,
    context: str = DEFAULT_CONTEXT,
    **options,
) -> DataFrame:
    """``correlate_known`` against all metrics of the catalog."""
    return correlate_known(samples, request, all_metrics(catalog, context), **options)


def answer(
    samples: DataFrame,
    resource: str | None,
    metric: str | None,
    resolution: int | None,
    top: int | None = DEFAULT_TOP_N,
    from_ms: int | None = None,
    to_ms: int | None = None,
    candidates: DataFrame | Iterable[Metric] | None = None,
    catalog: Catalog | None = None,
    now: int | None = None,
) -> DataFrame:
    """A correlation as a service would be asked for it: mandatory parameters
    checked, range defaulting to the last 24 hours, candidates given or all
    metrics of the catalog."""
    request = CorrelationRequest.of(resource, metric, resolution, top, from_ms, to_ms, now)
    if candidates is not None:
        return correlate_known(samples, request, candidates)
    if catalog is None:
        raise ValueError("either candidates or a catalog is needed")
    return correlate_catalog(samples, request, catalog)


def run_job(
    spark: SparkSession, config: Mapping[str, Any], samples: DataFrame | None = None, **options
) -> DataFrame:
    """Correlation from a job configuration.

    Samples come from the table at ``spark.tideline.samples.path`` unless given.
    """
    job = JobConfig.parse(config)
    if samples is None:
        path = spark.conf.get(SAMPLES_PATH_CONF, None)
        if not path:
            raise ValueError(f"Missing configuration key: {SAMPLES_PATH_CONF}")
        samples = read_samples(spark, path)
    return correlate(samples, job.request, job.candidates, **options)
