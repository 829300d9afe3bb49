"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import WORD_PATTERN, fresh, row_keyed, written

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MAX_COPIES = 2
# Documents are put in order in ranges of about this many, so no rank needs a whole source, size or turn in one task.
RANGE_ROWS = 1_000_000
# Documents of one size take turns by id modulo this, so that neighbours in id don't stand side by side.
TURNS = 1024


def _source_key(column):
    """Text by which sources are joined; distinct for null and every value."""
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), column))


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """Per source its size, target and the offset of its sample; ``sizes`` has source, size and n_docs.

    The share without a limit is a level times the source's weight. Sources below
    that level stop at their limit. Sorted by limit over weight, the level is the
    first one that exceeds none of the sources left; from there on levels fall, so
    it is the largest of those. One row per source is windowed, never documents.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    filled = Window.orderBy("limit_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size").cast("double") * max_copies)
        .withColumn("limit_ratio", F.col("cap") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(everything).cast("double") * total_share)
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(filled), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
        .withColumn("level", (F.col("wanted") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("limit_ratio"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    digest = F.md5(_source_key(F.col("source")).cast("binary"))
    return level.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("copies_each"),
        (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0).alias("offset"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    total_share: float = TOTAL_SHARE,
    max_copies: int = MAX_COPIES,
    row_col: str | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies (0 to ``max_copies``), taken; and row, if ``row_col`` has a key of rows.

    Within a source every document expects target/size copies. Documents are laid
    end to end by size, turn and id; the prefix sum of expected copies plus the
    source's one offset passes an integer boundary once per copy taken. Ordering by
    size makes the words taken follow the target closely. Their numbers (no texts) are
    exchanged by ranges of that order, which cut any source, size or turn; a rank is the
    sum of counts before the document's size, before its range and within its range.

    Defined for odd input: a null text has size 0; a null source is the last one;
    a source without words has target 0 and takes nothing; rows repeated under one
    id are ranked one after the other; an empty table gives no rows. The offset
    comes from the source's name, so reruns agree.
    """
    # A few numbers per document, written once, so that texts are read once.
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.pmod(F.col(id_col).cast("long"), F.lit(TURNS)), F.lit(-1)).alias("turn"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        (F.monotonically_increasing_id() if row_col is None else F.col(row_col)).alias("row"),
    )
    row = [] if row_col is None else ["row"]
    sized = written(sized)
    order = ["turn", "doc_id", "text_hash", "row"]
    ranges = max(1, -(-sized.count() // range_rows))
    sized = written(sized.repartitionByRange(ranges, "source", "size", *order).withColumn("range", F.spark_partition_id()))
    counts = sized.groupBy("source", "size", "range").agg(F.count(F.lit(1)).alias("n_docs"))
    by_size = counts.groupBy("source", "size").agg(F.sum("n_docs").alias("n_docs"))
    before_size = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    before_range = Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(by_size.select("source", (F.col("size") * F.col("n_docs")).alias("size")), weights, total_share, max_copies)
    sizes = (
        by_size.select("source", "size", F.coalesce(F.sum("n_docs").over(before_size), F.lit(0)).alias("size_base"))
        .join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
        .drop("t_source")
    )
    starts = (
        counts.select("source", "size", "range", F.coalesce(F.sum("n_docs").over(before_range), F.lit(0)).alias("range_base"))
        .join(
            sizes.withColumnsRenamed({"source": "z_source", "size": "z_size"}),
            F.col("source").eqNullSafe(F.col("z_source")) & (F.col("size") == F.col("z_size")),
        )
        .select(
            F.col("source").alias("g_source"),
            F.col("size").alias("g_size"),
            F.col("range").alias("g_range"),
            (F.col("size_base") + F.col("range_base")).alias("base"),
            "source_size",
            "target",
            "copies_each",
            "offset",
        )
    )
    within = Window.partitionBy("source", "size", "range").orderBy(*order)
    ranked = sized.join(
        starts,
        F.col("source").eqNullSafe(F.col("g_source")) & (F.col("size") == F.col("g_size")) & (F.col("range") == F.col("g_range")),
    ).withColumn("rank", F.col("base") + F.row_number().over(within))
    # Whole copies apart, so that rounding can't pass one boundary too many.
    whole = F.floor("copies_each")
    part = F.col("copies_each") - whole
    copies = whole + F.floor(F.col("offset") + part * F.col("rank")) - F.floor(F.col("offset") + part * (F.col("rank") - 1))
    return ranked.withColumn("copies", copies.cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *row
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """The documents as the mix takes them: each row once per copy of its own, with all its columns.

    Rows are told apart by their place in stored files or a key written with them, also where ids are null or repeated.
    """
    row, mixed_row, copies, copy = (fresh(name, docs.columns) for name in ("row_key", "mixed_row", "mixed_copies", "mixed_copy"))
    keyed = row_keyed(docs, row)
    taken = mix(keyed, id_col, row_col=row, **columns).select(F.col("row").alias(mixed_row), F.col("copies").alias(copies)).where(F.col(copies) > 0)
    repeated = keyed.join(taken, F.col(row) == F.col(mixed_row))
    return repeated.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copy)).drop(copy)
