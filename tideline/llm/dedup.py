"""Exact deduplication by combining copies in three stages, hot groups included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import WHITE_CHARS, fresh, row_keyed, written

SALTS = 16
# A group above 1/HOT_SHARE of all rows is hot; there are at most HOT_SHARE of them.
HOT_SHARE = 1000
# One code point outweighs every difference of ids.
ID_RANGE = "10000000000000000000"


def normalised(text_col: str):
    """The text without white space; null as empty."""
    return F.translate(F.coalesce(F.col(text_col), F.lit("")), WHITE_CHARS, "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Per document the decision on it: doc_id, keep_id, group_size, kept, text_sha256.

    Copies are combined where they are read (the partial aggregate), then per
    digest and salt, then per digest; each of these groups by the normalised text
    itself beside its digest, so that texts are equal in full or apart. Rows cross
    an exchange once per task and group, so no group is gathered anywhere.

    Of equal texts the row with the most code points stays, then the smallest id.
    Defined for odd input: a null text is the empty text, empty texts are copies of
    one another, a null id is the last to stay, and rows repeated under one id
    share one decision. Columns other than the two named are not read.
    """
    marked = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        normalised(text_col).alias("norm"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("decimal(38,0)").alias("n"),
    ).select(
        "doc_id",
        "norm",
        F.sha2("norm", 256).alias("text_sha256"),
        F.length("norm").alias("norm_chars"),
        F.xxhash64("norm").alias("check"),
        # Most code points first, then the smallest id; null ids come after all others.
        (F.col("n") * F.lit(ID_RANGE).cast("decimal(20,0)") - F.coalesce(F.col("doc_id").cast("decimal(38,0)"), F.lit("9223372036854775808").cast("decimal(38,0)")))
        .cast("decimal(38,0)")
        .alias("rank"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"),
    )
    content = ["text_sha256", "check", "norm_chars", "norm"]
    salted = marked.groupBy(*content, "salt").agg(
        F.max_by("doc_id", "rank").alias("doc_id"), F.max("rank").alias("rank"), F.count(F.lit(1)).alias("copies")
    )
    groups = written(
        salted.groupBy(*content)
        .agg(F.max_by("doc_id", "rank").alias("keep_id"), F.sum("copies").alias("group_size"), F.lit(True).alias("grouped"))
        .where(F.col("group_size") > 1)
        .drop("norm")
    )
    key = ["text_sha256", "check", "norm_chars"]
    hot_size = docs.count() / HOT_SHARE
    # At most HOT_SHARE groups are this large: a list of proven size, whatever the input.
    hot = groups.where(F.col("group_size") > hot_size).withColumnsRenamed({c: f"hot_{c}" for c in ("keep_id", "group_size", "grouped")})
    rest = groups.where(F.col("group_size") <= hot_size)
    decided = marked.select(*key, "doc_id").join(F.broadcast(hot), key, "left")
    # Rows of hot groups are decided; a key of their own each spreads them over the next join.
    spread = F.when(F.col("hot_grouped"), F.xxhash64("doc_id")).otherwise(F.col("check"))
    joined = decided.withColumn("spread", spread).join(
        rest.withColumnsRenamed({c: f"rest_{c}" for c in key}),
        (F.col("spread") == F.col("rest_check"))
        & (F.col("text_sha256") == F.col("rest_text_sha256"))
        & (F.col("norm_chars") == F.col("rest_norm_chars")),
        "left",
    )
    grouped = F.coalesce(F.col("hot_grouped"), F.col("grouped"), F.lit(False))
    keep = F.when(grouped, F.coalesce(F.col("hot_keep_id"), F.col("keep_id"))).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce(F.col("hot_group_size"), F.col("group_size"), F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row of each group of equal texts, with all its columns: most code points, then the smallest id, null ids last.

    Rows are told apart by their place in stored files or a key written with them, so null and repeated ids decide nothing but that order; of rows
    that agree in it too any one stays. Copies are combined as in ``exact_groups``, by the normalised text itself at every stage.
    """
    row, kept_row = fresh("row_key", docs.columns), fresh("kept_row", docs.columns)
    keyed = row_keyed(docs, row)
    doc_id = F.col(id_col).cast("long")
    order = F.struct(
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"), doc_id.isNotNull().alias("named"), (-doc_id.cast("decimal(20,0)")).alias("id"), F.col(row).alias("row")
    )
    marked = keyed.select(normalised(text_col).alias("norm"), order.alias("order"), F.pmod(F.xxhash64(row), F.lit(salts)).alias("salt"))
    marked = marked.select("*", F.sha2("norm", 256).alias("digest"))
    salted = marked.groupBy("digest", "norm", "salt").agg(F.max("order").alias("order"))
    # Written, so that what the groups were exchanged through can go before the rows are joined.
    kept = written(salted.groupBy("digest", "norm").agg(F.max("order").alias("order")).select(F.col("order.row").alias(kept_row)))
    return keyed.join(kept, F.col(row) == F.col(kept_row), "left_semi").drop(row)
