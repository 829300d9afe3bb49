"""Request-sized inputs as DataFrames: candidate lists in JSON or as objects."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.model import SERIES, Metric


def literal_rows(spark: SparkSession, rows: Iterable[Mapping[str, Any]], schema: str) -> DataFrame:
    """Rows held by the driver as a DataFrame, passed as one JSON literal."""
    text = F.lit(json.dumps(list(rows)))
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(text, f"array<struct<{_fields(schema)}>>")))


def _fields(schema: str) -> str:
    return ", ".join(field.strip().replace(" ", ":", 1) for field in schema.split(","))


def candidates_from_json(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Candidates of JSON array bodies ``[{"resource": .., "metric": ..}, ..]``.

    Other columns are kept; ``ordinal`` is the position in the list.  A body that
    is not an array, is cut off, or has an entry without either field is an error.
    """
    kept = [c for c in bodies.columns if c != body]
    read = F.from_json(body, "array<struct<resource:string,metric:string>>")
    nameless = F.exists(read, lambda c: c.isNull() | c["resource"].isNull() | c["metric"].isNull())
    sound = F.col(body).rlike(r"(?s)^\s*\[.*\]\s*$") & read.isNotNull() & ~nameless
    refused = F.raise_error(F.concat(F.lit("not a list of candidates: "), F.coalesce(F.substring(body, 1, 200), F.lit("null"))))
    parsed = F.when(F.coalesce(sound, F.lit(False)), read).otherwise(refused.cast("array<struct<resource:string,metric:string>>"))
    return bodies.select(*kept, F.posexplode(parsed).alias("ordinal", "_candidate")).select(
        *kept, F.col("ordinal").cast("bigint").alias("ordinal"), "_candidate.resource", "_candidate.metric"
    )


# Longest list of candidates that goes into the plan; a longer one is spread over the tasks.
LITERAL_CANDIDATES = 2_000


def candidates_from_list(spark: SparkSession, metrics: Iterable[Metric]) -> DataFrame:
    """Candidates that the driver holds, in their order."""
    metrics = list(metrics)
    if len(metrics) > LITERAL_CANDIDATES:
        listed = [(i, m.resource, m.metric) for i, m in enumerate(metrics)]
        return spark.createDataFrame(listed, "ordinal bigint, resource string, metric string")
    rows = [{"ordinal": i, "resource": m.resource, "metric": m.metric} for i, m in enumerate(metrics)]
    return literal_rows(spark, rows, "ordinal bigint, resource string, metric string")


def without_target(candidates: DataFrame, target: Metric) -> DataFrame:
    """Drops the target from a candidate list, or its samples from a scan."""
    resource, metric = SERIES
    same = F.col(resource).eqNullSafe(target.resource) & F.col(metric).eqNullSafe(target.metric)
    return candidates.where(~same)


def prefiltered(samples: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """The samples of some keys.

    A semi join without a hint: whether the keys are sent to the samples or both
    are exchanged follows from the size that the keys turn out to have.
    """
    return samples.join(keys.select(*on), list(on), "left_semi")
