"""Calculated labels and the projection to exported labels.

Measurements are long: ``resource, ts_ms, label, value[, attributes]``.  Both
steps look at all labels of a (resource, timestamp) together, so they work on a
wide view with one value column per label, named by position.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.values import known_or_nan, unknown
from tideline.model import Calculation, ResultDescriptor, parse_literal

ROW_KEY = ["resource", "ts_ms"]
_MAP = "map<string,string>"


@dataclass(frozen=True)
class Wide:
    """Rows of one (resource, timestamp) with the column of each label."""

    rows: DataFrame
    values: Mapping[str, str]
    attributes: Mapping[str, str]


def widen(measurements: DataFrame, labels: Sequence[str]) -> Wide:
    """Values of the labels side by side; a label without a row is NULL."""
    values = {label: f"_v{i}" for i, label in enumerate(labels)}
    attributes = {label: f"_a{i}" for i, label in enumerate(labels)} if "attributes" in measurements.columns else {}
    of = F.col("label")
    columns = [F.max(F.when(of == label, F.col("value"))).alias(name) for label, name in values.items()]
    columns += [
        F.any_value(F.when(of == label, F.col("attributes")), ignoreNulls=True).alias(name)
        for label, name in attributes.items()
    ]
    if not columns:
        return Wide(measurements.select(*ROW_KEY).distinct(), values, attributes)
    return Wide(measurements.groupBy(*ROW_KEY).agg(*columns), values, attributes)


def resolve_argument(arg: str, values: Mapping[str, str]) -> Column:
    """A known label, or else a number."""
    if arg in values:
        return known_or_nan(F.col(values[arg]))
    literal = parse_literal(arg)
    if literal is None:
        raise ValueError(f"Missing measurement: {arg!r}; available: {', '.join(values)}")
    return F.lit(literal)


def calculate(wide: Wide, calculations: Sequence[Calculation]) -> Wide:
    """Evaluates calculations in order; later ones may read earlier labels."""
    rows, values = wide.rows, dict(wide.values)
    for calculation in calculations:
        args = [resolve_argument(a, values) for a in calculation.args]
        name = f"_v{len(values)}"
        rows = rows.withColumn(name, calculation.function(*args).cast("double"))
        values[calculation.label] = name
    return Wide(rows, values, wide.attributes)


def lengthen(wide: Wide, labels: Sequence[str], with_attributes: bool) -> DataFrame:
    """One row per label; a label nobody computed is NaN without attributes."""

    def measurement(label: str) -> Column:
        value = known_or_nan(F.col(wide.values[label])) if label in wide.values else unknown()
        fields = [F.lit(label).alias("label"), value.alias("value")]
        if with_attributes:
            held = F.col(wide.attributes[label]) if label in wide.attributes else F.lit(None).cast(_MAP)
            fields.append(held.alias("attributes"))
        return F.struct(*fields)

    if not labels:
        empty = F.array().cast(
            "array<struct<label:string,value:double" + (f",attributes:{_MAP}>>" if with_attributes else ">>")
        )
        return wide.rows.select(*ROW_KEY, F.inline(empty))
    return wide.rows.select(*ROW_KEY, F.inline(F.array(*(measurement(label) for label in labels))))


def compute(measurements: DataFrame, descriptor: ResultDescriptor) -> DataFrame:
    """Adds a measurement, without attributes, for each calculation."""
    sources = [d.label for d in descriptor.datasources]
    wide = calculate(widen(measurements, sources), descriptor.calculations)
    return lengthen(wide, descriptor.labels, "attributes" in measurements.columns)


def export(measurements: DataFrame, exports: Sequence[str]) -> DataFrame:
    """Exactly the exported labels for every (resource, timestamp)."""
    return lengthen(widen(measurements, exports), exports, "attributes" in measurements.columns)


def extract(measurements: DataFrame, label: str, available: Sequence[str]) -> DataFrame:
    """The values of one label as ``resource, ts_ms, value``."""
    if label not in available:
        raise ValueError(f"{label} is not available in the given rows. Available labels: {','.join(available)}")
    return measurements.where(F.col("label") == label).select(*ROW_KEY, "value")
