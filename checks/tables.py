"""The provided tables as samples, request parameters shared with the SQL side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.grid import days, hours
from tideline.model import Metric
from tideline.operators.neighbours import spread
from tideline.sources.samples import SAMPLE_KEY, shard_of

# 2024-01-01 and 1995-01-01, UTC, in epoch milliseconds.
EVENTS_START = 1_704_067_200_000
EVENTS_END = EVENTS_START + days(30)
LINES_START = 788_918_400_000
LINES_END = LINES_START + days(2_520)

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
EVENT_KINDS = {"click": "COUNTER", "error": "DERIVE", "purchase": "GAUGE", "signup": "ABSOLUTE", "view": "COUNTER"}

EVENT_STEP, EVENT_HEARTBEAT, EVENT_RESOLUTION = hours(6), hours(24), hours(24)
LINE_STEP, LINE_HEARTBEAT, LINE_RESOLUTION = days(7), days(30), days(28)

EVENT_TARGET = Metric("u0", "click")
LINE_TARGET = Metric("s0", "R")


def table(spark: SparkSession, sf_dir: str, name: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Events whose time of day is read as UTC, whatever the session's zone.

    A range in milliseconds is also stated on the stored column, where the scan
    can use it.
    """
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    rows = table(spark, sf_dir, "events", schema)
    if start_ms is not None:
        rows = rows.where(F.col("ts") >= F.timestamp_millis(F.lit(start_ms)))
    if end_ms is not None:
        rows = rows.where(F.col("ts") < F.timestamp_millis(F.lit(end_ms + 1)))
    return rows


def event_samples(
    spark: SparkSession,
    sf_dir: str,
    kinds: dict[str, str] | None = None,
    start_ms: int | None = None,
    end_ms: int | None = None,
) -> DataFrame:
    """One series per user and event type, gauges unless ``kinds`` says otherwise."""
    kind = F.lit("GAUGE")
    if kinds is not None:
        kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("event_type")]
    ts = F.unix_millis("ts")
    return events(spark, sf_dir, start_ms, end_ms).select(
        F.concat(F.lit("u"), "user_id").alias("resource"),
        ts.alias("ts_ms"),
        F.col("event_type").alias("metric"),
        kind.alias("metric_type"),
        "value",
        F.from_json("props", "map<string,string>").alias("attributes"),
        F.col("event_id").alias("seq"),
        shard_of(ts).alias("shard"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = (
        "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_quantity double, "
        "l_returnflag string, l_shipdate timestamp"
    )
    return table(spark, sf_dir, "lineitem", schema)


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as written samples, keys repeated: one per supplier, day and flag."""
    return lines(spark, sf_dir).select(
        F.concat(F.lit("s"), "l_suppkey").alias("resource"),
        F.unix_millis("l_shipdate").alias("ts_ms"),
        F.col("l_returnflag").alias("metric"),
        F.lit("GAUGE").alias("metric_type"),
        F.col("l_quantity").alias("value"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def daily_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily quantity per supplier and return flag.

    Few line items share a key, so sums where they are read would hold nearly all rows of a scan's
    task and spare no exchange: rows are exchanged by key and summed there.
    """
    by_key = spread(line_samples(spark, sf_dir), SAMPLE_KEY)
    return by_key.groupBy("resource", "metric", "metric_type", "ts_ms").agg(F.sum("value").alias("value"))


def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily quantity per return flag: few series that hold all the data."""
    return (
        line_samples(spark, sf_dir)
        .groupBy("metric", "metric_type", "ts_ms")
        .agg(F.sum("value").alias("value"))
        .withColumn("resource", F.lit("all"))
    )


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, supplier as a resource tree; suppliers and nations carry attributes."""

    def attribute(resource, metric):
        return F.struct(F.concat(*resource).alias("resource"), F.lit(metric).alias("metric"))

    region, nation, supplier = (table(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    none = F.array().cast("array<struct<resource:string,metric:string>>")
    roots = region.select(
        F.concat(F.lit("region%2F"), "r_regionkey").alias("id"),
        F.lit(None).cast("string").alias("parent"),
        F.col("r_regionkey").cast("bigint").alias("position"),
        none.alias("attributes"),
    )
    inner = nation.select(
        F.concat(F.lit("nation%2F"), "n_nationkey").alias("id"),
        F.concat(F.lit("region%2F"), "n_regionkey").alias("parent"),
        F.col("n_nationkey").cast("bigint").alias("position"),
        F.array(attribute([F.lit("n"), F.col("n_nationkey")], "load")).alias("attributes"),
    )
    leaves = supplier.select(
        F.concat(F.lit("supplier%2F"), "s_suppkey").alias("id"),
        F.concat(F.lit("nation%2F"), "s_nationkey").alias("parent"),
        F.col("s_suppkey").alias("position"),
        F.array(
            attribute([F.lit("s"), F.col("s_suppkey")], "A"),
            attribute([F.lit("s"), F.col("s_suppkey")], "R"),
            attribute([F.lit("n"), F.col("s_nationkey")], "balance"),
        ).alias("attributes"),
    )
    return roots.unionByName(inner).unionByName(leaves)
