"""Every registered query against its SQL on the smallest tables, and its plan."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as registry  # noqa: E402
from checks.compare import compare, connect  # noqa: E402
from checks.oracles import ORACLES  # noqa: E402
from checks.queries import QUERIES  # noqa: E402

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="tables not present")

# Queries about user functions written in Python.
USES_PYTHON = {"custom_agg", "custom_agg_ordered", "custom_agg_merged", "custom_scalar"}


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


def test_each_query_has_its_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.items() <= registry.queries().items() and ORACLES.items() <= registry.oracle_sql().items()


@pytest.mark.parametrize("name", QUERIES)
def test_same_as_sql(spark, db, name):
    assert compare(spark, db, SMALL, name) is None


@pytest.mark.parametrize("name", QUERIES)
def test_plan(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for costly in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
        # One answer is one aggregate over partial ones; the best bounds are as many as are asked for.
        assert costly not in plan or (name in ("target_lookup", "correlate_pruned") and costly == "SinglePartition")
    assert ("Python" in plan or "ArrowEval" in plan) == (name in USES_PYTHON)


def test_entry(spark):
    rows = registry.entry(spark)
    assert rows.columns == ["resource", "metric", "coefficient"]
    assert rows.count() == 10
