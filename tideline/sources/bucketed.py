"""Samples stored by series: a table whose buckets hold whole series in order of time.

Looking back within a series then needs neither an exchange nor a sort: each bucket is one sorted
file and one task.  Worth its writing where the same samples are rated or consolidated again and
again; the table by shards (``samples``) is the one for ranges and upserts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.model import SERIES
from tideline.sources.samples import SAMPLE_COLUMNS, latest_samples


def write_bucketed(samples: DataFrame, table: str, buckets: int, order: str = "seq") -> None:
    """Writes samples, last write per key, as a table of the session's catalog; replaces it if there.

    ``buckets`` is to fit the data: a bucket is read by one task.  Rows are brought to their
    buckets first, so that each is written as one file, sorted by series and time.
    """
    rows = latest_samples(samples, order).withColumnRenamed(order, "seq").select(*SAMPLE_COLUMNS, "seq")
    placed = rows.repartition(buckets, *SERIES).sortWithinPartitions(*SERIES, "ts_ms")
    placed.write.mode("overwrite").bucketBy(buckets, *SERIES).sortBy(*SERIES, "ts_ms").format("parquet").saveAsTable(table)


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    """The samples; the session's setting ``spark.sql.legacy.bucketedTableScan.outputOrdering`` (see ``tideline.session``)
    decides whether their order is used."""
    return spark.table(table)
