"""Correlation results as JSON rows and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT_FIELDS = ["resource", "metric", "coefficient"]
RESULT_SCHEMA = "resource string, metric string, coefficient double"


# What samples, primary data and measurements are told apart by, in the order of their output.
ORDER = ["resource", "metric", "label", "heartbeat_ms", "ts_ms"]


def ordered(rows: DataFrame) -> DataFrame:
    """Samples, primary data or measurements by series and time, as the last step.

    A range exchange: neighbouring series lie in neighbouring partitions, none holds them all.
    """
    return rows.orderBy(*(c for c in ORDER if c in rows.columns))


def to_json(results: DataFrame) -> DataFrame:
    """One JSON object per result in the column ``json``; NaN is written as a string."""
    return results.select(F.to_json(F.struct(*RESULT_FIELDS)).alias("json"))


def from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    return rows.select(F.from_json(column, RESULT_SCHEMA).alias("_r")).select("_r.*")


def write_json(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    results.select(*RESULT_FIELDS).write.mode(mode).json(path)
