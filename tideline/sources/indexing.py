"""The catalog kept up to date: an index that is merged with new samples instead of built again.

Beside each term and metric the index counts the samples that have it, and beside each attribute's
value it has the time of the sample that set it.  A sample that replaces another takes back what
that one counted for, so values that no sample has any more disappear.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import staged
from tideline.sources.catalog import DEFAULT_CONTEXT, RESOURCE_ATTRIBUTES, RESOURCE_METRICS, TERMS, Catalog
from tideline.sources.samples import SAMPLE_KEY, latest_samples

TERM_KEY = ["context", "field", "value", "resource"]
METRIC_KEY = ["context", "resource", "metric_name"]
ATTRIBUTE_KEY = ["context", "resource", "attribute"]


@dataclass(frozen=True)
class CountedCatalog:
    """``terms`` and ``resource_metrics`` with a column ``samples``, ``resource_attributes`` with ``ts_ms``."""

    terms: DataFrame
    resource_attributes: DataFrame
    resource_metrics: DataFrame

    @property
    def catalog(self) -> Catalog:
        """The plain catalog, to be searched."""
        return Catalog(
            self.terms.select(*TERM_KEY), self.resource_attributes.select(*ATTRIBUTE_KEY, "value"), self.resource_metrics.select(*METRIC_KEY)
        )

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """To a new path: an index that was read from a path can't overwrite it."""
        for name in (TERMS, RESOURCE_ATTRIBUTES, RESOURCE_METRICS):
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "CountedCatalog":
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in (TERMS, RESOURCE_ATTRIBUTES, RESOURCE_METRICS)))


def _pairs(samples: DataFrame, context: str, *more: str) -> DataFrame:
    return samples.select(F.lit(context).alias("context"), "resource", "ts_ms", *more, F.explode("attributes").alias("attribute", "value"))


def _counts(samples: DataFrame, context: str, sign: int) -> tuple[DataFrame, DataFrame]:
    terms = _pairs(samples, context).select("context", F.col("attribute").alias("field"), "value", "resource", F.lit(sign).cast("bigint").alias("samples"))
    metrics = samples.select(F.lit(context).alias("context"), "resource", F.col("metric").alias("metric_name"), F.lit(sign).cast("bigint").alias("samples"))
    return terms, metrics


def _summed(parts: Iterable[DataFrame], key: list[str]) -> DataFrame:
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first.groupBy(*key).agg(F.sum("samples").alias("samples")).where("samples > 0")


def _newest(pairs: DataFrame) -> DataFrame:
    """The value of the latest sample per attribute, of equal times the larger value."""
    best = F.max_by(F.struct("value", "ts_ms"), F.struct("ts_ms", "value")).alias("_best")
    return pairs.groupBy(*ATTRIBUTE_KEY).agg(best).select(*ATTRIBUTE_KEY, "_best.value", "_best.ts_ms")


def index_counted(samples: DataFrame, context: str = DEFAULT_CONTEXT) -> CountedCatalog:
    """The index of samples of unique keys."""
    terms, metrics = _counts(samples, context, 1)
    return CountedCatalog(_summed([terms], TERM_KEY), _newest(_pairs(samples, context)), _summed([metrics], METRIC_KEY))


def merge_index(index: CountedCatalog, before: DataFrame, incoming: DataFrame, context: str = DEFAULT_CONTEXT, order: str = "seq") -> CountedCatalog:
    """The index of ``before`` after an upsert of ``incoming``, from the index of ``before``.

    ``before`` is the table without the upsert, of unique keys.  It is read for the
    samples that incoming ones replace, by their keys, and, where a replaced sample had set the value of an attribute,
    for the next latest one of that resource.  Of incoming samples of one key the last written counts, and one
    written earlier than the stored sample changes nothing, as in the upsert.

    Incoming samples, the stored ones of their keys and what counts of them are written to the folder for
    intermediate tables: each part of the index reads them, and none reduces or joins them again.
    """
    columns = [*SAMPLE_KEY, "metric_type", "value", "attributes", order]
    stored = before.withColumnRenamed("seq", order) if order != "seq" else before
    stored = stored.select(*columns)
    newest = staged(latest_samples(incoming.select(*columns), order), "newest")
    # What latest_samples compares.
    rank = F.struct(order, "metric_type", "value")
    ranked = newest.withColumn("_rank", rank).select(*SAMPLE_KEY, "_rank")
    matched = stored.withColumn("_old", rank).join(ranked, SAMPLE_KEY)
    matched = staged(matched.select(*columns, F.expr("_rank > _old").alias("_replaced")), "matched")
    replaced = matched.where("_replaced").select(*columns)
    kept_back = matched.where("NOT _replaced").select(*SAMPLE_KEY)
    counted = staged(newest.join(kept_back, SAMPLE_KEY, "left_anti"), "counted")

    more_terms, more_metrics = _counts(counted, context, 1)
    less_terms, less_metrics = _counts(replaced, context, -1)
    terms = _summed([index.terms.select(*TERM_KEY, "samples"), more_terms, less_terms], TERM_KEY)
    metrics = _summed([index.resource_metrics.select(*METRIC_KEY, "samples"), more_metrics, less_metrics], METRIC_KEY)

    # Values that a replaced sample had set are looked for again.
    known = index.resource_attributes.select(*ATTRIBUTE_KEY, "value", "ts_ms")
    gone = _pairs(replaced, context).select(*ATTRIBUTE_KEY, "ts_ms").distinct()
    lost = known.join(gone, [*ATTRIBUTE_KEY, "ts_ms"], "left_semi").select(*ATTRIBUTE_KEY)
    standing = known.join(lost, ATTRIBUTE_KEY, "left_anti")
    remaining = stored.join(lost.select("resource").distinct(), "resource", "left_semi").join(replaced.select(*SAMPLE_KEY), SAMPLE_KEY, "left_anti")
    again = _pairs(remaining, context).join(lost, ATTRIBUTE_KEY, "left_semi")
    attributes = _newest(standing.unionByName(again).unionByName(_pairs(counted, context)))
    return CountedCatalog(terms, attributes, metrics)
