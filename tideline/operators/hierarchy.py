"""Flatten a resource tree to catalog rows and look up display ids.

A tree is a table ``id, parent, position, attributes``: roots have a NULL
parent, ``position`` orders siblings, ``attributes`` is an array of
``struct<resource:string, metric:string>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import staged

NODE_SCHEMA = (
    "id string, parent string, position bigint, attributes array<struct<resource:string,metric:string>>"
)


def paths(nodes: DataFrame) -> DataFrame:
    """``id, attributes, path`` of every node reachable from a root; ``path`` has the positions from the root down.

    By pointer doubling: each node points to an ancestor and has the path from below it.  A round
    takes the ancestor's pointer and puts its path in front, so pointers reach twice as far: a tree of
    depth d takes log2(d) rounds, each a join of the table with itself that is written before the next.
    A node whose parent is missing is left out with all below it.  Pointers that have gone as far as
    there are nodes go round in a circle: an error that names one of its nodes.
    """
    walked = staged(
        nodes.select("id", "attributes", F.col("parent").alias("above"), F.array("position").alias("path"), F.col("parent").isNull().alias("done")), "tree"
    )
    rows, reach = walked.count(), 1
    while (left := walked.where("NOT done")).limit(1).count():
        if reach > rows:
            # All that leads nowhere else is gone by now; what points furthest up lies on a circle.
            node = left.groupBy("above").count().orderBy("above").first()["above"]
            raise ValueError(f"the tree has a cycle through {node!r}")
        ancestors = walked.select(F.col("id").alias("_id"), F.col("above").alias("_above"), F.col("path").alias("_path"), F.col("done").alias("_done"))
        further = left.join(ancestors, F.col("above") == F.col("_id")).select(
            "id", "attributes", F.col("_above").alias("above"), F.concat("_path", "path").alias("path"), F.col("_done").alias("done")
        )
        walked = staged(walked.where("done").unionByName(further), "tree")
        reach *= 2
    return walked.select("id", "attributes", "path")


def flatten_tree(nodes: DataFrame) -> DataFrame:
    """One row per attribute of every resource reachable from a root.

    ``path`` (sibling positions from the root, then the attribute's index) is the
    depth-first order of the tree.  Trees may have any number of rows and levels.
    """
    rows = paths(nodes).select("id", "path", F.posexplode("attributes").alias("index", "attribute"))
    return rows.select(
        F.url_decode("id").alias("id"),
        F.array_append("path", F.col("index").cast("bigint")).alias("path"),
        "attribute.resource",
        "attribute.metric",
        F.concat_ws(":", "attribute.resource", "attribute.metric").alias("key"),
    )


def first_candidates(catalog: DataFrame, count: int) -> DataFrame:
    """``ordinal, resource, metric`` of the first rows of a flattened tree, in its order, as a list of candidates."""
    first = catalog.orderBy("path", "key").limit(count)
    listed = first.agg(F.array_sort(F.collect_list(F.struct("path", "key", "resource", "metric"))).alias("_rows"))
    return listed.select(F.posexplode("_rows").alias("ordinal", "_row")).select(F.col("ordinal").cast("bigint").alias("ordinal"), "_row.resource", "_row.metric")


def target_metric(catalog: DataFrame, node: str, attribute: str) -> DataFrame:
    """``resource, metric`` of a resource's attribute as shown, the first of the catalog; an error if there is none."""
    found = catalog.where((F.col("id") == node) & (F.col("metric") == attribute)).agg(F.min_by(F.struct("resource", "metric"), "path").alias("_found"))
    missing = F.raise_error(F.lit(f"no attribute {attribute!r} of {node!r} in the catalog")).cast("struct<resource:string,metric:string>")
    return found.select(F.coalesce("_found", missing).alias("_found")).select("_found.*")


def display_ids(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """Results with the id of the first catalog row of the same resource, else NULL."""
    first = catalog.groupBy("resource").agg(F.min_by("id", "path").alias("id"))
    return results.join(first, "resource", "left").select(
        "id", F.col("metric").alias("attribute"), "coefficient"
    )
