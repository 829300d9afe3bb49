"""Unknown values, aggregate functions and the correlation expression.

A measurement is a DOUBLE in which NaN means "unknown".  NULL is used only
inside aggregations, to make a built-in aggregate skip a value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideline.functions.grid import INTERVAL

NAN = float("nan")


def unknown() -> Column:
    return F.lit(NAN)


def known_or_null(value: Column) -> Column:
    """NaN becomes NULL."""
    return F.nullif(value, unknown())


def known_or_nan(value: Column) -> Column:
    """NULL becomes NaN."""
    return F.coalesce(value, unknown())


def known_or_zero(value: Column) -> Column:
    """NaN and NULL become 0."""
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


State = Sequence[float]


@dataclass(frozen=True)
class Mergeable:
    """An aggregate in Python whose states merge: a few numbers stand for any number of values.

    ``update`` takes a state and an array of values; values and states come in any order and portions.
    """

    init: Callable[[], State]
    update: Callable[[State, np.ndarray], State]
    merge: Callable[[State, State], State]
    finish: Callable[[State], float]


@dataclass(frozen=True)
class Aggregation:
    """An aggregate applied to the interval values of one bucket.

    ``expression`` maps a DOUBLE column to an aggregate column that ignores
    NULL.  With ``skips_unknown`` it never sees unknown intervals; without, it
    sees one value for every interval of the bucket, NaN where unknown.  ``merged``
    takes the place of the expression in aggregations of states that merge.
    """

    name: str
    expression: Callable[[Column], Column]
    skips_unknown: bool = True
    merged: Mergeable | None = None

    def __call__(self, value: Column) -> Column:
        return self.expression(known_or_null(value) if self.skips_unknown else value)


AVERAGE = Aggregation("AVERAGE", F.avg)
MIN = Aggregation("MIN", F.min)
MAX = Aggregation("MAX", F.max)


def collection_aggregation(
    name: str, function: Callable[[list[float]], float], skips_unknown: bool = False
) -> Aggregation:
    """Aggregation from a Python function over the values of one bucket.

    The values gathered per call are the intervals of one bucket in time order, a
    count fixed by resolution and step rather than by the data.  Arrow batches
    carry them.  No values at all are unknown without a call.
    """

    @F.pandas_udf("double")
    def apply(groups: pd.Series) -> pd.Series:
        return groups.map(lambda values: float(function(list(values))) if len(values) else NAN).astype("float64")

    def gathered(value: Column) -> Column:
        pairs = F.collect_list(F.when(value.isNotNull(), F.struct(F.col(INTERVAL), value.alias("value"))))
        return F.transform(F.array_sort(pairs), lambda pair: pair["value"])

    return Aggregation(name, lambda value: apply(gathered(value)), skips_unknown)


def mergeable_aggregation(
    name: str,
    init: Callable[[], State],
    update: Callable[[State, np.ndarray], State],
    merge: Callable[[State, State], State],
    finish: Callable[[State], float],
    skips_unknown: bool = False,
) -> Aggregation:
    """Aggregation from Python functions over states, for buckets of any size.

    Tasks reduce the values they have to one state per bucket, over Arrow batches; only states are exchanged
    and merged.  No values at all are unknown without a call.
    """

    def unused(value: Column) -> Column:
        raise TypeError(f"{name} is computed from states that merge, not by an expression")

    return Aggregation(name, unused, skips_unknown, Mergeable(init, update, merge, finish))


# States that a task holds before it passes them on.
STATES_HELD = 100_000


def partial_states(rows: DataFrame, key: Sequence[str], functions: Mapping[int, Aggregation], held: int | None = None) -> DataFrame:
    """``key``, ``fn`` (the number of a function) and ``state`` of the values that each task has.

    ``rows`` have ``key`` and ``value``.  A bucket that a task meets again after passing its states on gets further ones.
    """
    most = STATES_HELD if held is None else held
    schema = T.StructType(
        [rows.schema[c] for c in key] + [T.StructField("fn", T.IntegerType()), T.StructField("state", T.ArrayType(T.DoubleType()))]
    )
    kinds = to_arrow_schema(schema)
    names = list(key)

    def passed_on(states: dict) -> pa.RecordBatch:
        columns = list(zip(*((*bucket, fn, [float(x) for x in state]) for (bucket, fn), state in states.items())))
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.field(i).type) for i, c in enumerate(columns)], schema=kinds)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}
        for batch in batches:
            grouped = pa.table(batch).group_by(names, use_threads=False).aggregate([("value", "list")])
            for *bucket, part in zip(*(grouped.column(c).to_pylist() for c in names), grouped.column("value_list")):
                bucket, values = tuple(bucket), part.values.to_numpy(zero_copy_only=False)
                known = values[~np.isnan(values)]
                for fn, function in functions.items():
                    seen = known if function.skips_unknown else values
                    if len(seen):
                        at = (bucket, fn)
                        states[at] = function.merged.update(states[at] if at in states else function.merged.init(), seen)
            if len(states) >= most:
                yield passed_on(states)
                states = {}
        if states:
            yield passed_on(states)

    return rows.select(*key, known_or_nan(F.col("value")).alias("value")).mapInArrow(reduce, schema)


def merged_states(partial: DataFrame, key: Sequence[str], functions: Mapping[int, Aggregation]) -> DataFrame:
    """``key`` and a column ``_fn<i>`` for each function: the states of a bucket, one per task at least, merged and finished."""

    def finisher(function: Aggregation):
        @F.pandas_udf("double")
        def finish(groups: pd.Series) -> pd.Series:
            def one(states) -> float:
                if not len(states):
                    return NAN
                merged = list(states[0])
                for state in states[1:]:
                    merged = function.merged.merge(merged, list(state))
                return float(function.merged.finish(merged))

            return groups.map(one).astype("float64")

        return finish

    gathered = partial.groupBy(*key).agg(*(F.collect_list(F.when(F.col("fn") == i, F.col("state"))).alias(f"_states{i}") for i in functions))
    return gathered.select(*key, *(finisher(fn)(F.col(f"_states{i}")).alias(f"_fn{i}") for i, fn in functions.items()))


def add(a: Column, b: Column) -> Column:
    """Binary calculation function: the sum of two values."""
    return a + b


def vectorized(function: Callable[..., pd.Series]) -> Callable[..., Column]:
    """Calculation function from a Python function over pandas series."""
    return F.pandas_udf(function, "double")


def pearson(x: Column, y: Column) -> Column:
    """Pearson coefficient as an aggregate; NaN if undefined or any input is NaN.

    ``corr`` raises on a constant series under ANSI mode, and rounding can leave
    a constant series a tiny variance, hence the division that yields NULL and
    the comparison of extremes.
    """
    constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    ratio = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(constant, unknown()).otherwise(known_or_nan(ratio))
