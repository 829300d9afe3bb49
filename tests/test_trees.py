"""Trees by pointer doubling: depth, order, circles, and what is left out."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import hierarchy
from tideline.operators.hierarchy import NODE_SCHEMA, first_candidates, flatten_tree, paths


def counted(monkeypatch):
    calls = []
    stage = hierarchy.staged
    monkeypatch.setattr(hierarchy, "staged", lambda rows, name: calls.append(name) or stage(rows, name))
    return calls


def test_a_chain_takes_few_rounds(spark, monkeypatch):
    calls = counted(monkeypatch)
    chain = spark.range(5000).selectExpr(
        "string(id) AS id", "if(id = 0, null, string(id - 1)) AS parent", "id AS position", "CAST(array() AS array<struct<resource:string,metric:string>>) AS attributes"
    )
    found = paths(chain)
    # One of the rounds counted is the table's first writing.
    assert len(calls) - 1 == 13
    row = found.where("id = '4999'").first()
    assert list(row["path"]) == list(range(5000)) and found.count() == 5000


def test_paths_are_the_depth_first_order(spark):
    rng = random.Random(2)
    parents = {0: None} | {i: rng.randrange(i) for i in range(1, 300)} | {300: None}
    rows = [(str(i), None if p is None else str(p), rng.randrange(1000), [("r", f"m{i}")]) for i, p in parents.items()]
    children = {}
    for i, p, position, _ in rows:
        children.setdefault(p, []).append((position, i))
    order = []

    def walk(node):
        for _, child in sorted(children.get(node, [])):
            order.append(child)
            walk(child)

    walk(None)
    position = {i: p for i, _, p, _ in rows}
    flat = flatten_tree(spark.createDataFrame(rows, NODE_SCHEMA)).collect()
    parent = dict((i, p) for i, p, *_ in rows)
    for r in flat:
        path, node = [], r["id"]
        while node is not None:
            path.append(position[node])
            node = parent[node]
        assert list(r["path"])[:-1] == path[::-1]
    if len(set(position.values())) == len(position):
        assert [r["id"] for r in sorted(flat, key=lambda r: list(r["path"]))] == order
    assert len(flat) == 301


@pytest.mark.parametrize("rows", [[("a", "c"), ("b", "a"), ("c", "b"), ("d", "a"), ("r", None)], [("a", "a"), ("r", None)], [("x", None), ("x", "y"), ("y", "x")]])
def test_a_circle_is_an_error_that_names_a_node(spark, rows):
    nodes = spark.createDataFrame([(i, p, 0, []) for i, p in rows], NODE_SCHEMA)
    with pytest.raises(ValueError, match="cycle through '[abcxy]'"):
        paths(nodes)


def test_nodes_without_a_way_to_a_root_are_left_out(spark):
    rows = [("r", None, 5, [("r", "m")]), ("c", "r", 1, [("c", "m"), ("c", "n")]), ("lost", "nowhere", 0, [("l", "m")]), ("below", "lost", 0, [("b", "m")])]
    flat = flatten_tree(spark.createDataFrame(rows, NODE_SCHEMA)).collect()
    assert sorted((r["id"], tuple(r["path"])) for r in flat) == [("c", (5, 1, 0)), ("c", (5, 1, 1)), ("r", (5, 0))]
    assert flatten_tree(spark.createDataFrame([], NODE_SCHEMA)).count() == 0


def test_the_callers_settings_stay(spark):
    before = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    flatten_tree(spark.createDataFrame([("r", None, 0, [("r", "m")])], NODE_SCHEMA)).collect()
    assert {r["key"]: r["value"] for r in spark.sql("SET").collect()} == before


def test_first_candidates_follow_the_tree(spark):
    rows = [("r", None, 0, [("r", "m")]), ("b", "r", 2, [("b", "m"), ("b", "n")]), ("a", "r", 1, [("a", "m")]), ("c", "a", 0, [("c", "m")])]
    flat = flatten_tree(spark.createDataFrame(rows, NODE_SCHEMA).orderBy(F.rand(1)))
    got = [(r["ordinal"], r["resource"], r["metric"]) for r in sorted(first_candidates(flat, 4).collect(), key=lambda r: r["ordinal"])]
    assert got == [(0, "r", "m"), (1, "a", "m"), (2, "c", "m"), (3, "b", "m")]
    assert first_candidates(flat, 10).count() == 5
