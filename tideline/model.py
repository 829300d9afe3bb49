"""Request objects: series, datasources, calculations, descriptors, correlation requests.

They live on the driver, are validated eagerly and never hold data.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column

from tideline.functions.grid import MILLIS_PER_DAY, is_multiple
from tideline.functions.values import AVERAGE, Aggregation

SERIES = ["resource", "metric"]

GAUGE = "GAUGE"
COUNTER_TYPES = ("COUNTER", "ABSOLUTE", "DERIVE")
METRIC_TYPES = (GAUGE, *COUNTER_TYPES)

DEFAULT_XFF = 0.5
DEFAULT_HEARTBEAT_STEPS = 2
DEFAULT_RANGE_MS = MILLIS_PER_DAY
DEFAULT_TOP_N = 10
ROLLUP_STEPS = 3


@dataclass(frozen=True)
class Metric:
    """Identity of one series."""

    resource: str
    metric: str


@dataclass(frozen=True)
class Datasource:
    """A label computed from one source metric."""

    label: str
    source: str
    function: Aggregation = AVERAGE
    heartbeat_ms: int | None = None
    xff: float = DEFAULT_XFF


@dataclass(frozen=True)
class Calculation:
    """A label computed from columns: earlier labels or numeric literals."""

    label: str
    function: Callable[..., Column]
    args: tuple[str, ...]


# Text that reads as a floating point number: optional sign, digits with an
# optional fraction and exponent, an optional type suffix, or a named value.
_NUMBER = re.compile(r"\s*([+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|NaN|Infinity))[dDfF]?\s*")


def parse_literal(text: str) -> float | None:
    match = _NUMBER.fullmatch(text)
    return float(match.group(1)) if match else None


@dataclass(frozen=True)
class ResultDescriptor:
    """What a measurement query computes: step, datasources, calculations, exports.

    The builder methods return extended copies.
    """

    step_ms: int
    datasources: tuple[Datasource, ...] = ()
    calculations: tuple[Calculation, ...] = ()
    exports: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.step_ms <= 0:
            raise ValueError(f"step must be positive, got {self.step_ms}")

    def datasource(
        self,
        label: str,
        source: str | None = None,
        function: Aggregation = AVERAGE,
        heartbeat_ms: int | None = None,
        xff: float = DEFAULT_XFF,
    ) -> "ResultDescriptor":
        self._check_new(label)
        added = Datasource(label, source or label, function, heartbeat_ms, xff)
        return replace(self, datasources=(*self.datasources, added))

    def calculate(self, label: str, function: Callable[..., Column], *args: str) -> "ResultDescriptor":
        self._check_new(label)
        added = Calculation(label, function, tuple(str(a) for a in args))
        return replace(self, calculations=(*self.calculations, added))

    def export(self, *labels: str) -> "ResultDescriptor":
        fresh = [name for name in dict.fromkeys(labels) if name not in self.exports]
        return replace(self, exports=(*self.exports, *fresh))

    def _check_new(self, label: str) -> None:
        if label in self.labels:
            raise ValueError(f"label {label!r} is already defined")

    @property
    def labels(self) -> list[str]:
        return [d.label for d in self.datasources] + [c.label for c in self.calculations]

    @property
    def source_names(self) -> list[str]:
        return list(dict.fromkeys(d.source for d in self.datasources))

    def heartbeat_of(self, datasource: Datasource) -> int:
        if datasource.heartbeat_ms is not None:
            return datasource.heartbeat_ms
        return DEFAULT_HEARTBEAT_STEPS * self.step_ms

    @property
    def source_heartbeats(self) -> list[tuple[str, int]]:
        """Distinct (source, heartbeat) pairs: each is consolidated on its own."""
        return list(dict.fromkeys((d.source, self.heartbeat_of(d)) for d in self.datasources))

    @property
    def max_heartbeat_ms(self) -> int:
        if not self.datasources:
            raise ValueError("a descriptor needs at least one datasource")
        return max(self.heartbeat_of(d) for d in self.datasources)

    def check_resolution(self, resolution_ms: int) -> None:
        if resolution_ms <= 0 or not is_multiple(resolution_ms, self.step_ms):
            raise ValueError(f"resolution {resolution_ms} must be a multiple of the step {self.step_ms}")


def now_ms() -> int:
    return int(time.time() * 1000)


def resolve_range(start_ms: int | None, end_ms: int | None, now: int | None = None) -> tuple[int, int]:
    """A missing end is now; a missing start is 24 hours before the end."""
    end = end_ms if end_ms is not None else (now if now is not None else now_ms())
    start = start_ms if start_ms is not None else end - DEFAULT_RANGE_MS
    check_range(start, end)
    return start, end


def check_range(start_ms: int, end_ms: int) -> None:
    if start_ms > end_ms:
        raise ValueError(f"start {start_ms} is after end {end_ms}")


@dataclass(frozen=True)
class CorrelationRequest:
    """Validated parameters of a correlation."""

    target: Metric
    start_ms: int
    end_ms: int
    resolution_ms: int
    top_n: int = DEFAULT_TOP_N

    @classmethod
    def of(
        cls,
        resource: str | None,
        metric: str | None,
        resolution_ms: int | None,
        top_n: int | None = DEFAULT_TOP_N,
        start_ms: int | None = None,
        end_ms: int | None = None,
        now: int | None = None,
    ) -> "CorrelationRequest":
        """Fail before any job runs when a mandatory parameter is missing."""
        given = {"resource": resource, "metric": metric, "resolution": resolution_ms, "topN": top_n}
        missing = [name for name, value in given.items() if value is None]
        if missing:
            raise ValueError(f"Missing mandatory parameter: {', '.join(missing)}")
        current = now if now is not None else now_ms()
        end = end_ms if end_ms is not None else current
        start = start_ms if start_ms is not None else current - DEFAULT_RANGE_MS
        return cls(Metric(resource, metric), start, end, int(resolution_ms), int(top_n))

    def __post_init__(self) -> None:
        if self.resolution_ms <= 0:
            raise ValueError(f"resolution must be positive, got {self.resolution_ms}")
        check_range(self.start_ms, self.end_ms)
        if self.top_n < 0:
            raise ValueError(f"topN must not be negative, got {self.top_n}")

    @property
    def rollup_ms(self) -> int:
        return ROLLUP_STEPS * self.resolution_ms


@dataclass(frozen=True)
class JobConfig:
    """Configuration of a correlation job."""

    request: CorrelationRequest
    candidates: tuple[Metric, ...]

    @classmethod
    def parse(cls, config: Mapping[str, Any]) -> "JobConfig":
        """Accepts nested or dotted keys: ``metric.resource``, ``metric.metric``,
        ``candidates``, ``from``, ``to``, ``resolution``, ``topN``."""

        def lookup(path: str) -> Any:
            if path in config:
                return config[path]
            node: Any = config
            for part in path.split("."):
                if not isinstance(node, Mapping) or part not in node:
                    raise ValueError(f"Missing configuration key: {path}")
                node = node[part]
            return node

        target = Metric(str(lookup("metric.resource")), str(lookup("metric.metric")))
        candidates = _metrics(lookup("candidates"))
        request = CorrelationRequest(
            target, int(lookup("from")), int(lookup("to")), int(lookup("resolution")), int(lookup("topN"))
        )
        return cls(request, candidates)


def _metrics(entries: Iterable[Mapping[str, str]]) -> tuple[Metric, ...]:
    return tuple(Metric(str(e["resource"]), str(e["metric"])) for e in entries)
