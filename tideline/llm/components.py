"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """Per node of ``edges`` (a, b: long): node and component, the smallest node that it reaches.

    Every node points to its smallest neighbour or itself, takes over where that
    one points, and edges move to what their ends point to. Edges inside a
    component vanish, so a star is done in one round and any graph in about
    log(n). Each round is written and so cut from the rounds before. Smallest
    neighbours are partial aggregates; joins on a node with very many edges are
    inner joins that adaptive execution splits. Without edges there are no rows.
    """
    left = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mapping = None
    while not left.isEmpty():
        smallest = left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        # Nodes without a smaller neighbour point to themselves and need no row.
        smallest = written(smallest)
        onward = smallest.withColumnsRenamed({"node": "mid", "to": "far"})
        jumped = written(smallest.join(onward, F.col("to") == F.col("mid"), "left").select("node", F.coalesce("far", "to").alias("to")))

        def moved(df: DataFrame, column: str) -> DataFrame:
            ends = jumped.withColumnsRenamed({"node": "old", "to": "new"})
            return df.join(ends, F.col(column) == F.col("old"), "left").withColumn(column, F.coalesce("new", column)).drop("old", "new")

        first = jumped.select("node", F.col("to").alias("component"))
        mapping = first if mapping is None else moved(mapping, "component").unionByName(first.join(mapping.select("node"), "node", "left_anti"))
        mapping = written(mapping)
        ends = moved(moved(left, "a"), "b").where("a <> b")
        left = written(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if mapping is None:
        return left.select(F.col("a").alias("node"), F.col("a").alias("component"))
    roots = mapping.select("component").distinct().join(mapping.select("node"), F.col("component") == F.col("node"), "left_anti")
    return mapping.unionByName(roots.select(F.col("component").alias("node"), "component"))
