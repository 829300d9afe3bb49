"""Time steps and intervals as SQL functions of a session.

They are written in SQL, so queries that use them are planned as a whole: no Python runs, and
predicates pass through them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tideline.functions.grid import MILLIS_PER_SECOND, SPINE_BLOCK

# Scalar and table valued functions: signature, body.
SCALAR = {
    "step_floor(ts_ms BIGINT, step_ms BIGINT)": "ts_ms - pmod(ts_ms, step_ms)",
    "step_ceiling(ts_ms BIGINT, step_ms BIGINT)": "ts_ms + pmod(-ts_ms, step_ms)",
    "epoch_seconds(ts_ms BIGINT)": f"ts_ms div {MILLIS_PER_SECOND}L",
}

# Floor of the start to ceiling of the end; long ranges are cut in two levels, so that no array is longer than a block.
INTERVALS = f"""
SELECT explode(sequence(block, least(hi, block + step * {SPINE_BLOCK - 1}L), step))
FROM (
  SELECT explode(if(lo <= hi, sequence(lo, hi, step * {SPINE_BLOCK}L), array())) AS block, hi, step
  FROM (SELECT start_ms - pmod(start_ms, step_ms) AS lo, end_ms + pmod(-end_ms, step_ms) AS hi, step_ms AS step)
)"""

_LO, _HI = "start_ms - pmod(start_ms, step_ms)", "end_ms + pmod(-end_ms, step_ms)"
INTERVAL_LIST = f"if({_LO} <= {_HI}, sequence({_LO}, {_HI}, step_ms), array())"


def register(spark: SparkSession) -> None:
    """Defines ``step_floor``, ``step_ceiling``, ``epoch_seconds``, ``interval_list`` and ``intervals`` on the session.

    ``interval_list(start_ms, end_ms, step_ms)`` is an array, for one range of moderate length that
    all rows share, to be exploded as a column of a subquery, without a join.

    ``intervals(start_ms, end_ms, step_ms)`` is a table of one column ``ts_ms``, to be used alone or per row
    (``FROM keys, LATERAL intervals(...)``); it has no rows if the start's floor is after the end's ceiling.
    """
    for signature, body in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS BIGINT RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION interval_list(start_ms BIGINT, end_ms BIGINT, step_ms BIGINT) RETURNS ARRAY<BIGINT> RETURN {INTERVAL_LIST}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION intervals(start_ms BIGINT, end_ms BIGINT, step_ms BIGINT) "
        f"RETURNS TABLE(ts_ms BIGINT) RETURN {INTERVALS}"
    )
