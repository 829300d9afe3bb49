"""Last-writer-wins merge of attribute maps inside a grouped aggregation.

Maps are unfolded to key/value rows next to the row carrying the measures, so
each key is reduced with ``max_by`` and no group's maps are gathered unreduced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY_KEY = "_entry_key"
ENTRY_VALUE = "_entry_value"
_ENTRIES = "array<struct<key:string,value:string>>"


def unfold(rows: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Each row once with a NULL entry key and once per attribute."""
    nothing = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))
    entries = F.coalesce(F.map_entries(attributes), F.array().cast(_ENTRIES))
    return (
        rows.withColumn("_entry", F.explode(F.concat(F.array(nothing), entries)))
        .withColumns({ENTRY_KEY: F.col("_entry.key"), ENTRY_VALUE: F.col("_entry.value")})
        .drop("_entry", attributes)
    )


def measure_only(value: Column) -> Column:
    """The measure on the row without an entry, NULL on entry rows."""
    return F.when(F.col(ENTRY_KEY).isNull(), value)


def folded_map() -> Column:
    """Aggregate turning reduced entry rows back into one map."""
    entry = F.struct(F.col(ENTRY_KEY).alias("key"), F.col(ENTRY_VALUE).alias("value"))
    return F.map_from_entries(F.collect_list(F.when(F.col(ENTRY_KEY).isNotNull(), entry)))
