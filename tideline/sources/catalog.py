"""The metric catalog: built from samples, searched for candidate metrics.

Three tables: ``terms(context, field, value, resource)``,
``resource_attributes(context, resource, attribute, value)`` and
``resource_metrics(context, resource, metric_name)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.model import SERIES

DEFAULT_CONTEXT = "default"

# The terms whose resources make up "all metrics".
ALL_METRICS_TERMS = ("response", "snmp")

TERMS = "terms"
RESOURCE_ATTRIBUTES = "resource_attributes"
RESOURCE_METRICS = "resource_metrics"


@dataclass(frozen=True)
class Catalog:
    terms: DataFrame
    resource_attributes: DataFrame
    resource_metrics: DataFrame

    def write(self, path: str, mode: str = "overwrite") -> None:
        for name in (TERMS, RESOURCE_ATTRIBUTES, RESOURCE_METRICS):
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Catalog":
        names = (TERMS, RESOURCE_ATTRIBUTES, RESOURCE_METRICS)
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in names))


def index_samples(samples: DataFrame, context: str = DEFAULT_CONTEXT) -> Catalog:
    """Catalog of the resources, attributes and metrics found in samples.

    An attribute written with several values keeps the latest as the resource's
    value; every value stays searchable as a term.
    """
    of_context = F.lit(context).alias("context")
    pairs = samples.select("resource", "ts_ms", F.explode("attributes").alias("attribute", "value"))
    terms = pairs.select(of_context, F.col("attribute").alias("field"), "value", "resource").distinct()
    attributes = (
        pairs.groupBy("resource", "attribute")
        .agg(F.max_by("value", F.struct("ts_ms", "value")).alias("value"))
        .select(of_context, "resource", "attribute", "value")
    )
    metrics = samples.select(of_context, "resource", F.col("metric").alias("metric_name")).distinct()
    return Catalog(terms, attributes, metrics)


def _metrics_of(catalog: Catalog, terms: DataFrame, context: str) -> DataFrame:
    resources = terms.where(F.col("context") == context).select("resource").distinct()
    recorded = catalog.resource_metrics.where(F.col("context") == context)
    return recorded.join(resources, "resource", "left_semi").select(
        "resource", F.col("metric_name").alias("metric")
    )


def match_any_value(catalog: Catalog, *values: str, context: str = DEFAULT_CONTEXT) -> DataFrame:
    """Metrics of the resources having an attribute with any of the values."""
    return _metrics_of(catalog, catalog.terms.where(F.col("value").isin(*values)), context)


def match_term(catalog: Catalog, field: str, value: str, context: str = DEFAULT_CONTEXT) -> DataFrame:
    """Metrics of the resources whose attribute ``field`` has the value."""
    found = catalog.terms.where((F.col("field") == field) & (F.col("value") == value))
    return _metrics_of(catalog, found, context)


def all_metrics(catalog: Catalog, context: str = DEFAULT_CONTEXT) -> DataFrame:
    return match_any_value(catalog, *ALL_METRICS_TERMS, context=context)


def no_metrics(spark: SparkSession) -> DataFrame:
    """A catalog answer without any metric."""
    return spark.createDataFrame([], "resource string, metric string")


def metrics_by_resource(metrics: DataFrame) -> DataFrame:
    """The set of metric names of each resource, as a sorted array."""
    distinct: Sequence[str] = SERIES
    return (
        metrics.select(*distinct)
        .distinct()
        .groupBy("resource")
        .agg(F.sort_array(F.collect_set("metric")).alias("metrics"))
    )
