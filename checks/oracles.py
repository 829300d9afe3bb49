"""The same results in DuckDB SQL.

Consolidation is written by its definition here: every sample joins every
interval within heartbeat reach, and a window inside each interval finds the
preceding sample.  The engine uses a closed form instead.
"""

from __future__ import annotations

from checks import queries as q
from checks import tables as t
from tideline.functions.grid import TimeGrid, days, hours
from tideline.sources.samples import SHARD_MS

NAN = "'nan'::DOUBLE"

DERIVE = "'DERIVE'"

EVENTS = """ev AS (
  SELECT 'u' || user_id AS resource, epoch_us(ts) // 1000 AS ts_ms, event_type AS metric,
         value, props, event_id AS seq
  FROM events)"""

LINES = """li AS (
  SELECT 's' || l_suppkey AS resource, epoch_us(l_shipdate) // 1000 AS ts_ms, l_returnflag AS metric,
         l_quantity AS value, l_orderkey * 10 + l_linenumber AS seq
  FROM lineitem)"""

DAILY = LINES + """, daily AS (
  SELECT resource, metric, ts_ms, sum(value) AS value FROM li GROUP BY ALL)"""

TOTALS = LINES + """, totals AS (
  SELECT 'all' AS resource, metric, ts_ms, sum(value) AS value FROM li GROUP BY ALL)"""


def floor_(x, step):
    return f"(({x}) - ((({x}) % {step}) + {step}) % {step})"


def ceil_(x, step):
    return f"(({x}) + (((-({x})) % {step}) + {step}) % {step})"


def rounded(value, digits=q.DIGITS):
    scale = f"1e{digits}"
    return f"floor(({value}) * {scale} + 0.5) / {scale}"


def out(value, digits=q.DIGITS):
    """A value for comparison: unknown is NULL."""
    return f"CASE WHEN isnan({value}) THEN NULL ELSE {rounded(value, digits)} END"


def points(grid: TimeGrid) -> str:
    return f"unnest(range({grid.lo}, {grid.hi} + 1, {grid.step}))"


def kinds(case: dict[str, str]) -> str:
    return "CASE metric " + " ".join(f"WHEN '{m}' THEN '{k}'" for m, k in case.items()) + " END"


def rates(source: str, kind: str = "'GAUGE'", reset: str = "d", name: str = "rated") -> str:
    return f"""{name}_l AS (
  SELECT *, {kind} AS kind,
         lag(ts_ms) OVER (PARTITION BY resource, metric ORDER BY ts_ms) AS p_ts,
         lag(value) OVER (PARTITION BY resource, metric ORDER BY ts_ms) AS p_value
  FROM {source}),
{name}_d AS (SELECT *, value - p_value AS d, ts_ms // 1000 - p_ts // 1000 AS secs FROM {name}_l),
{name} AS (
  SELECT * EXCLUDE (value, d, secs),
         CASE WHEN kind = 'GAUGE' THEN value
              WHEN p_ts IS NULL OR secs = 0 THEN {NAN}
              ELSE ({reset}) / secs END AS value
  FROM {name}_d)"""


def intervals(source: str, pairs: list[tuple[str, int]], grid: TimeGrid, name: str = "pd") -> str:
    """Sparse primary data ``resource, metric, hb, t, value``."""
    longest = max(h for _, h in pairs)
    values = ", ".join(f"('{s}', {h})" for s, h in pairs)
    return f"""{name}_hb(metric, hb) AS (VALUES {values}),
{name}_m AS (
  SELECT s.resource, s.metric, h.hb, s.ts_ms, s.value, {"s.props," if source == "ev" else ""}
         unnest(range({ceil_(f"s.ts_ms - {longest}", grid.step)}, s.ts_ms + {longest} + 1, {grid.step})) AS t
  FROM {source} s JOIN {name}_hb h USING (metric)),
{name}_w AS (
  SELECT *, lag(ts_ms) OVER (PARTITION BY resource, metric, hb, t ORDER BY ts_ms) AS prev
  FROM {name}_m
  WHERE t BETWEEN {grid.lo} AND {grid.hi} AND ts_ms > t - {grid.step}),
{name}_e AS (
  SELECT *, CASE WHEN prev IS NULL THEN ts_ms - (t - {grid.step}) ELSE least(ts_ms, t) - prev END AS el
  FROM {name}_w WHERE prev IS NULL OR prev < t),
{name} AS (
  SELECT resource, metric, hb, t,
         CASE WHEN coalesce(sum(el) FILTER (el >= hb), 0) < coalesce(sum(el) FILTER (el < hb), 0)
              THEN sum(value * el) FILTER (el < hb) / sum(el) FILTER (el < hb) ELSE {NAN} END AS value
  FROM {name}_e GROUP BY resource, metric, hb, t)"""


def uniform_intervals(source: str, heartbeat: int, grid: TimeGrid) -> str:
    """As ``intervals`` for every metric of the source."""
    text = intervals(source, [("", heartbeat)], grid)
    head = f"pd_hb AS (SELECT DISTINCT metric, {heartbeat} AS hb FROM {source})"
    return head + text[text.index(",\npd_m"):]


def dense(keys: str, grid: TimeGrid, name: str = "dp") -> str:
    """Primary data with every grid point of every (resource, metric, hb) of ``keys``."""
    return f"""{name}_s AS (SELECT resource, metric, hb, {points(grid)} AS t FROM ({keys})),
{name} AS (
  SELECT resource, metric, hb, t, coalesce(value, {NAN}) AS value
  FROM {name}_s LEFT JOIN pd USING (resource, metric, hb, t))"""


def resources_by(source: str, pairs: list[tuple[str, int]]) -> str:
    names = ", ".join(f"'{s}'" for s, _ in pairs)
    return (
        f"SELECT DISTINCT s.resource, h.metric, h.hb FROM {source} s, pd_hb h WHERE s.metric IN ({names})"
    )


def grids(start: int, end: int, step: int, resolution: int, pad: bool = True) -> tuple[TimeGrid, TimeGrid]:
    return (
        TimeGrid.covering(start - (resolution if pad else 0), end, step),
        TimeGrid.covering(start, end, resolution),
    )


def rolled(labels: list[tuple[str, str, int, str, float]], buckets: TimeGrid, step: int, name: str = "ro") -> str:
    """``resource, label, b, value`` from dense primary data ``dp``.

    ``labels``: (label, source, heartbeat, aggregate over known values, xff).
    """
    res = buckets.step
    parts = " UNION ALL ".join(
        f"""SELECT resource, '{label}' AS label, b,
    CASE WHEN count(*) / {res / step} > {xff} THEN coalesce({agg}, {NAN}) ELSE {NAN} END AS value
  FROM {name}_b WHERE metric = '{source}' AND hb = {hb} GROUP BY resource, b"""
        for label, source, hb, agg, xff in labels
    )
    return f"""{name}_b AS (
  SELECT *, {ceil_("t", res)} AS b FROM dp WHERE {ceil_("t", res)} BETWEEN {buckets.lo} AND {buckets.hi}),
{name}_p AS ({parts}),
{name}_k AS (
  SELECT resource, label, {points(buckets)} AS b
  FROM (SELECT DISTINCT resource FROM dp), (SELECT DISTINCT label FROM {name}_p)),
{name} AS (
  SELECT resource, label, b, coalesce(value, {NAN}) AS value FROM {name}_k LEFT JOIN {name}_p USING (resource, label, b))"""


AVG = "avg(value) FILTER (NOT isnan(value))"
LOW = "min(value) FILTER (NOT isnan(value))"
HIGH = "max(value) FILTER (NOT isnan(value))"


def measured(ctes: str, source: str, labels, start, end, step, resolution, pad=True, digits=q.DIGITS) -> str:
    """CTEs up to ``ro`` for a measurement query over ``source``."""
    grid, buckets = grids(start, end, step, resolution, pad)
    pairs = list(dict.fromkeys((s, h) for _, s, h, _, _ in labels))
    return ",\n".join(
        [ctes, intervals(source, pairs, grid), dense(resources_by(source, pairs), grid), rolled(labels, buckets, step)]
    )


def event_labels(*names: str):
    return [(n, n, t.EVENT_HEARTBEAT, AVG, 0.5) for n in names]


def event_measured(*names: str, start=q.SINCE, end=t.EVENTS_END, pad=True) -> str:
    return measured(
        EVENTS, "ev", event_labels(*names), start, end, t.EVENT_STEP, t.EVENT_RESOLUTION, pad
    )


def listing(ctes: str, digits: int = q.DIGITS, source: str = "ro") -> str:
    return f"WITH {ctes} SELECT resource, b AS ts_ms, label, {out('value', digits)} AS value FROM {source}"


def wide(ctes: str, names: list[str]) -> str:
    columns = ", ".join(f"max(value) FILTER (label = '{n}') AS {n}" for n in names)
    return f"{ctes}, wi AS (SELECT resource, b, {columns} FROM ro GROUP BY resource, b)"


def unpivot(ctes: str, labels: dict[str, str], digits: int = q.DIGITS) -> str:
    parts = " UNION ALL ".join(
        f"SELECT resource, b AS ts_ms, '{label}' AS label, {out(f'({expr})', digits)} AS value FROM wi"
        for label, expr in labels.items()
    )
    return f"WITH {ctes} {parts}"


def aligned(ctes: str, source: str, start: int, end: int, resolution: int, lookback: int) -> str:
    """CTE ``al``: ``resource, metric, b, value`` of every series in CTE ``keys``."""
    rollup = 3 * resolution
    grid, buckets = grids(start, end, resolution, rollup)
    return ",\n".join(
        [
            ctes,
            f"used AS (SELECT * FROM {source} WHERE ts_ms BETWEEN {start - lookback} AND {end})",
            uniform_intervals("used", 2 * resolution, grid),
            dense(f"SELECT resource, metric, {2 * resolution} AS hb FROM keys", grid),
            f"""al_b AS (SELECT *, {ceil_("t", rollup)} AS b FROM dp),
al AS (
  SELECT resource, metric, b,
         CASE WHEN count(*) / 3.0 > 0.5 THEN coalesce({AVG}, {NAN}) ELSE {NAN} END AS value
  FROM al_b WHERE b BETWEEN {buckets.lo} AND {buckets.hi} GROUP BY resource, metric, b)""",
        ]
    )


def scored(ctes: str, request, zero: bool) -> str:
    """CTE ``sc``: coefficient of every candidate in CTE ``keys`` but the target."""
    clean = lambda v: f"CASE WHEN isnan({v}) THEN 0 ELSE {v} END" if zero else v
    target = f"resource = '{request.target.resource}' AND metric = '{request.target.metric}'"
    return f"""{ctes},
pr AS (
  SELECT c.resource, c.metric, {clean("x.value")} AS x, {clean("c.value")} AS y
  FROM al c JOIN (SELECT b, value FROM al WHERE {target}) x USING (b)
  WHERE NOT (c.{target.replace("AND metric", "AND c.metric")})),
sc AS (
  SELECT resource, metric,
         CASE WHEN bool_or(isnan(x) OR isnan(y)) OR min(x) = max(x) OR min(y) = max(y) THEN {NAN}
              ELSE covar_pop(CASE WHEN isnan(x) THEN 0 ELSE x END, CASE WHEN isnan(y) THEN 0 ELSE y END)
                   / (stddev_pop(CASE WHEN isnan(x) THEN 0 ELSE x END)
                      * stddev_pop(CASE WHEN isnan(y) THEN 0 ELSE y END)) END AS c
  FROM pr GROUP BY resource, metric)"""


COEFFICIENT = f"resource, metric, {out('c')} AS coefficient"
TOP = "ORDER BY isnan(c) DESC, abs(c) DESC, resource, metric LIMIT"


def line_scores(keys: str, zero: bool, request=q._line_request(), ctes: str = DAILY, source: str = "daily") -> str:
    ctes = f"{ctes}, keys AS ({keys})"
    ctes = aligned(ctes, source, request.start_ms, request.end_ms, request.resolution_ms, request.rollup_ms)
    return scored(ctes, request, zero)


def event_scores(keys: str) -> str:
    request = q._event_request()
    ctes = f"{EVENTS}, keys AS ({keys})"
    ctes = aligned(ctes, "ev", request.start_ms, request.end_ms, request.resolution_ms, request.rollup_ms)
    return scored(ctes, request, True)


ALL_LINE_SERIES = "SELECT DISTINCT resource, metric FROM li"
ALL_EVENT_SERIES = "SELECT DISTINCT resource, metric FROM ev"

KIND_OF_K = """tagged AS (
  SELECT *, CASE WHEN CAST(props ->> 'k' AS INT) < 50 THEN 'snmp' ELSE 'other' END AS protocol FROM ev)"""


def attribute_rows() -> str:
    grid = TimeGrid.covering(q.SINCE, t.EVENTS_END, t.EVENT_STEP)
    return f"{EVENTS}, {intervals('ev', [('click', t.EVENT_HEARTBEAT), ('view', t.EVENT_HEARTBEAT)], grid)}"


def padded_attribute_rows() -> str:
    grid, _ = grids(q.SINCE, t.EVENTS_END, t.EVENT_STEP, t.EVENT_RESOLUTION)
    return f"{EVENTS}, {intervals('ev', [('click', t.EVENT_HEARTBEAT), ('view', t.EVENT_HEARTBEAT)], grid)}"


def strict(source: str, kind: str, metrics: str) -> str:
    return f"""WITH {source},
row_ts AS (SELECT resource, ts_ms, lag(ts_ms) OVER (PARTITION BY resource ORDER BY ts_ms) AS before
           FROM (SELECT DISTINCT resource, ts_ms FROM src)),
{rates("src", kind)}
SELECT r.resource, r.metric, r.ts_ms, 'GAUGE' AS metric_type, {out("r.value", 9)} AS value
FROM rated r JOIN row_ts w USING (resource, ts_ms)
WHERE r.metric IN ({metrics}) AND (w.before IS NULL OR r.p_ts = w.before)"""


def rate_listing(source: str, kind: str, reset: str = "d", where: str = "true", digits: int = 9) -> str:
    return f"""WITH {source}, {rates("ev", kind, reset)}
SELECT resource, metric, ts_ms, 'GAUGE' AS metric_type, {out("value", digits)} AS value FROM rated WHERE {where}"""


def catalog_search(where: str) -> str:
    return f"""WITH {EVENTS}
SELECT DISTINCT resource, metric FROM ev WHERE resource IN (SELECT resource FROM ev WHERE {where})"""


def primary_listing(ctes: str, source: str, pairs, grid: TimeGrid, keys: str | None = None, hb: bool = False) -> str:
    keys = keys or f"SELECT DISTINCT s.resource, h.metric, h.hb FROM {source} s, pd_hb h"
    heartbeat = "hb AS heartbeat_ms, " if hb else ""
    return f"""WITH {ctes}, {intervals(source, pairs, grid)}, {dense(keys, grid)}
SELECT resource, metric, {heartbeat}t AS ts_ms, {out("value")} AS value FROM dp"""


FLAGS = ("A", "N", "R")


def line_labels():
    return [
        (f"{flag}-{name}", flag, t.LINE_HEARTBEAT, agg, 0.5)
        for flag in FLAGS
        for name, agg in (("avg", AVG), ("min", LOW), ("max", HIGH))
    ]


def orders_times() -> str:
    ts = "(epoch_us(o_orderdate) // 1000 + o_orderkey * 7919)"
    signed = f"({ts} - {t.EVENTS_START})"
    return f"""SELECT o_orderkey, {floor_(ts, hours(7))} AS floor_7h, {ceil_(ts, hours(7))} AS ceiling_7h,
  {floor_(signed, hours(5))} AS floor_before_origin, {ceil_(signed, hours(5))} AS ceiling_before_origin,
  {ts} // 1000 AS seconds, {ts} AS round_trip FROM orders"""


def lookback_query() -> str:
    start, end = t.EVENTS_START + days(9) + hours(5), t.EVENTS_START + days(16) + hours(3)
    lo = start - t.EVENT_RESOLUTION
    everyone = f"""{EVENTS},
used AS (SELECT * FROM ev WHERE ts_ms BETWEEN {lo} AND {end} AND metric IN ('click', 'view')),
{rates("used", kinds(t.EVENT_KINDS))}"""
    labels = event_labels("view", "click")
    grid, buckets = grids(start, end, t.EVENT_STEP, t.EVENT_RESOLUTION)
    pairs = [(s, h) for _, s, h, _, _ in labels]
    keys = "SELECT DISTINCT e.resource, h.metric, h.hb FROM ev e, pd_hb h"
    return listing(
        ",\n".join([everyone, intervals("rated", pairs, grid), dense(keys, grid), rolled(labels, buckets, t.EVENT_STEP)]),
        9,
    )


def xff_query() -> str:
    labels = [("half", "click", hours(24), AVG, 0.5), ("any", "click", hours(24), AVG, 0.2), ("none", "click", hours(24), AVG, 1.0)]
    return listing(measured(EVENTS, "ev", labels, q.SINCE, t.EVENTS_END - hours(18), hours(6), hours(24)))


def custom_agg_query() -> str:
    hb = t.EVENT_HEARTBEAT
    labels = [
        ("spread", "click", hb, f"{HIGH} - {LOW}", 0.5),
        ("middle", "click", hb, "median(value) FILTER (NOT isnan(value))", 0.5),
        ("seen", "click", hb, "count(*)", 0.5),
    ]
    return listing(measured(EVENTS, "ev", labels, q.SINCE, t.EVENTS_END, t.EVENT_STEP, t.EVENT_RESOLUTION))


def custom_agg_ordered_query() -> str:
    last = "arg_max(value, t) FILTER (NOT isnan(value))"
    labels = [("last", "click", t.EVENT_HEARTBEAT, last, 0.5)]
    return listing(measured(EVENTS, "ev", labels, q.SINCE, t.EVENTS_END, t.EVENT_STEP, t.EVENT_RESOLUTION))


def custom_agg_merged_query() -> str:
    deviation = "stddev_pop(value) FILTER (NOT isnan(value))"
    labels = [(n, n, t.EVENT_HEARTBEAT, deviation, 0.5) for n in ("click", "view")]
    return listing(measured(EVENTS, "ev", labels, q.SINCE, t.EVENTS_END, t.EVENT_STEP, t.EVENT_RESOLUTION))


def process_counters_query() -> str:
    ctes = f"{EVENTS}, {rates('ev', kinds(t.EVENT_KINDS))}"
    names = ["click", "error", "purchase"]
    ctes = measured(ctes, "rated", event_labels(*names), q.SINCE, t.EVENTS_END, t.EVENT_STEP, t.EVENT_RESOLUTION)
    shown = {"click": "click", "both": "click + error", "purchase": "purchase", "nothing": NAN}
    return unpivot(wide(ctes, names), shown, 9)


def rollup_incremental_query() -> str:
    ctes = f"{EVENTS}, {rates('ev', kinds(t.EVENT_KINDS))}"
    return listing(measured(ctes, "rated", event_labels("click", "view"), q.SINCE, t.EVENTS_END, t.EVENT_STEP, t.EVENT_RESOLUTION), 9)


def stream_primary_query() -> str:
    pairs = [("click", hours(24)), ("click", hours(5)), ("view", hours(24))]
    grid = TimeGrid.covering(q.SINCE, q.STREAM_END, t.EVENT_STEP)
    reached = f"s.ts_ms BETWEEN {grid.lo - grid.step + 1} AND {grid.hi + hours(24)}"
    keys = f"SELECT DISTINCT s.resource, h.metric, h.hb FROM ev s JOIN pd_hb h ON s.metric = h.metric WHERE {reached}"
    return primary_listing(EVENTS, "ev", pairs, grid, keys, True)


def catalog_incremental_query() -> str:
    return """WITH latest AS (
  SELECT 's' || l_suppkey AS resource, epoch_us(l_shipdate) // 1000 AS ts_ms, l_returnflag AS metric,
    arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS value
  FROM lineitem GROUP BY ALL
), pairs AS (
  SELECT resource, ts_ms, 'quantity' AS field, CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) AS value FROM latest
  UNION ALL SELECT resource, ts_ms, 'flag', metric FROM latest
), newest AS (
  SELECT *, row_number() OVER (PARTITION BY resource, field ORDER BY ts_ms DESC, value DESC) AS i FROM pairs
)
SELECT DISTINCT 'term' AS part, resource, field, value FROM pairs
UNION ALL SELECT 'attribute', resource, field, value FROM newest WHERE i = 1
UNION ALL SELECT DISTINCT 'metric', resource, '', metric FROM latest"""


def process_hot_query() -> str:
    ctes = f"{TOTALS}, {rates('totals', DERIVE)}"
    labels = [("A", "A", days(4), AVG, 0.5), ("N_max", "N", days(4), HIGH, 0.5)]
    ctes = measured(ctes, "rated", labels, t.LINES_START, t.LINES_END, days(2), days(10))
    return unpivot(wide(ctes, ["A", "N_max"]), {"A": "A", "sum": "A + N_max"}, 9)


def average_per_series_query() -> str:
    ctes = aligned(f"{DAILY}, keys AS ({ALL_LINE_SERIES})", "daily", t.LINES_START, t.LINES_END, days(14), days(4000))
    return f"WITH {ctes} SELECT resource, metric, b AS ts_ms, {out('value')} AS value FROM al"


def job_query() -> str:
    request = q._line_request()
    request = type(request)(q.Metric("all", "R"), request.start_ms, request.end_ms, request.resolution_ms)
    keys = "SELECT 'all' AS resource, unnest(['A', 'N', 'R', 'X']) AS metric"
    return f"WITH {line_scores(keys, False, request, TOTALS, 'totals')} SELECT {COEFFICIENT} FROM sc {TOP} 10"


def gapfill_query() -> str:
    grid = TimeGrid.covering(q.SINCE, t.EVENTS_END, hours(3))
    keys = """SELECT r.resource, h.metric, h.hb
  FROM (SELECT 'u' || c_custkey AS resource FROM customer UNION SELECT resource FROM ev) r, pd_hb h"""
    return primary_listing(EVENTS, "ev", [("click", hours(6)), ("error", hours(6))], grid, keys)


TREE = """nodes AS (
  SELECT 'region%2F' || r_regionkey AS id, NULL AS parent, r_regionkey::BIGINT AS position,
         NULL::STRUCT(resource VARCHAR, metric VARCHAR)[] AS attributes FROM region
  UNION ALL
  SELECT 'nation%2F' || n_nationkey, 'region%2F' || n_regionkey, n_nationkey,
         [{'resource': 'n' || n_nationkey, 'metric': 'load'}] FROM nation
  UNION ALL
  SELECT 'supplier%2F' || s_suppkey, 'nation%2F' || s_nationkey, s_suppkey,
         [{'resource': 's' || s_suppkey, 'metric': 'A'}, {'resource': 's' || s_suppkey, 'metric': 'R'},
          {'resource': 'n' || s_nationkey, 'metric': 'balance'}] FROM supplier),
walk AS (
  SELECT id, [position] AS path, attributes FROM nodes WHERE parent IS NULL
  UNION ALL
  SELECT n.id, list_append(w.path, n.position), n.attributes FROM walk w JOIN nodes n ON n.parent = w.id),
flat AS (
  SELECT url_decode(id) AS id, list_append(path, i) AS path, attributes[i + 1].resource AS resource,
         attributes[i + 1].metric AS metric
  FROM (SELECT id, path, attributes, unnest(range(len(attributes))) AS i FROM walk))"""


def display_query() -> str:
    return f"""WITH RECURSIVE {TREE},
results AS (
  SELECT 's' || l_suppkey AS resource, l_returnflag AS metric, avg(l_quantity) AS c FROM lineitem GROUP BY ALL
  UNION ALL SELECT 'n' || c_nationkey, 'balance', avg(c_acctbal) FROM customer GROUP BY ALL
  UNION ALL SELECT r_name, 'none', 0.0 FROM region),
firsts AS (SELECT resource, id FROM (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY path) AS i FROM flat) WHERE i = 1)
SELECT id, metric AS attribute, {rounded('c')} AS coefficient FROM results LEFT JOIN firsts USING (resource)"""


EVENT_GRID = TimeGrid.covering(q.SINCE, t.EVENTS_END, t.EVENT_STEP)
K_OF = "CAST(props ->> 'k' AS VARCHAR)"

ORACLES = {
    "scan_range": f"""WITH {EVENTS}
SELECT resource, ts_ms, metric, value FROM ev
WHERE ts_ms BETWEEN {q.SCAN_START} AND {q.SCAN_END} AND metric IN ('click', 'purchase', 'view')
  AND resource IN (SELECT resource FROM ev WHERE metric = 'error')""",
    "default_range": f"""WITH {EVENTS}
SELECT metric, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms
FROM ev WHERE ts_ms BETWEEN {q.NOW - 86_400_000} AND {q.NOW} GROUP BY metric""",
    "shard_prune": f"""WITH {EVENTS}
SELECT {floor_("ts_ms", SHARD_MS)} // 1000 AS shard, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms
FROM ev WHERE ts_ms BETWEEN {q.SCAN_START} AND {q.SCAN_END} GROUP BY 1""",
    "timestamp_rows_wide": f"""WITH {LINES},
one AS (SELECT *, row_number() OVER (PARTITION BY resource, ts_ms, metric ORDER BY seq DESC, value DESC) AS i FROM li)
SELECT resource, ts_ms, max(value) FILTER (metric = 'A') AS "A", max(value) FILTER (metric = 'N') AS "N",
       max(value) FILTER (metric = 'R') AS "R"
FROM one WHERE i = 1 GROUP BY resource, ts_ms""",
    "upsert_dedup": f"""WITH {LINES},
one AS (SELECT *, row_number() OVER (PARTITION BY resource, ts_ms, metric ORDER BY seq DESC, value DESC) AS i FROM li)
SELECT resource, ts_ms, metric, 'GAUGE' AS metric_type, value, seq FROM one WHERE i = 1""",
    "upsert_table": f"""WITH {LINES},
one AS (SELECT *, row_number() OVER (PARTITION BY resource, ts_ms, metric ORDER BY seq DESC, value DESC) AS i FROM li)
SELECT resource, ts_ms, metric, 'GAUGE' AS metric_type, value, seq, {floor_("ts_ms", SHARD_MS)} // 1000 AS shard FROM one WHERE i = 1""",
    "samples_ordered": f"""WITH {EVENTS}
SELECT resource, metric, ts_ms, value, row_number() OVER (PARTITION BY resource, metric ORDER BY ts_ms) AS position FROM ev""",
    "measurements_ordered": f"""WITH {event_measured("click", "view")}
SELECT resource, b AS ts_ms, label, {out('value')} AS value,
  row_number() OVER (PARTITION BY resource, label ORDER BY b) AS position FROM ro""",
    "empty_catalog": f"""WITH {EVENTS} SELECT resource, metric, 0.0::DOUBLE AS coefficient FROM ev WHERE false""",
    "target_lookup": f"""WITH RECURSIVE {TREE}
SELECT resource, metric FROM flat WHERE id = 'supplier/3' AND metric = 'R' ORDER BY path LIMIT 1""",
    "index_terms": f"""WITH {EVENTS}
SELECT DISTINCT 'default' AS context, 'k' AS field, {K_OF} AS value, resource FROM ev""",
    "index_attributes": f"""WITH {EVENTS},
one AS (SELECT resource, {K_OF} AS k, row_number() OVER (PARTITION BY resource ORDER BY ts_ms DESC, {K_OF} DESC) AS i FROM ev)
SELECT 'default' AS context, resource, 'k' AS attribute, k AS value FROM one WHERE i = 1""",
    "index_metrics": f"""WITH {EVENTS}
SELECT DISTINCT 'default' AS context, resource, metric AS metric_name FROM ev""",
    "catalog_incremental": catalog_incremental_query(),
    "catalog_any": catalog_search(f"{K_OF} IN ('7', '69')"),
    "catalog_term": catalog_search(f"{K_OF} = '42'"),
    "metrics_by_resource": f"""WITH {EVENTS}
SELECT resource, string_agg(metric, ',' ORDER BY metric) AS metrics
FROM (SELECT DISTINCT resource, metric FROM ev) GROUP BY resource""",
    "candidates_json": """WITH bodies AS (
  SELECT p_partkey, unnest([{'o': 0, 'r': p_brand, 'm': p_type}, {'o': 1, 'r': p_name, 'm': p_type},
                            {'o': 2, 'r': p_brand, 'm': p_name}]) AS c FROM part)
SELECT p_partkey, c.o::BIGINT AS ordinal, c.r AS resource, c.m AS metric FROM bodies
WHERE NOT (c.r = 'Brand#17' AND c.m = 'ECONOMY')""",
    "step_floor_ceil": orders_times(),
    "spine": f"""SELECT 's' || s_suppkey AS resource,
  {points(TimeGrid.covering(t.EVENTS_START + 1, t.EVENTS_END - 1, hours(5)))} AS ts_ms FROM supplier""",
    "sql_steps": orders_times(),
    "sql_spine": f"""SELECT 's' || s_suppkey AS resource,
  {points(TimeGrid.covering(t.EVENTS_START + 1, t.EVENTS_END - 1, hours(5)))} AS ts_ms FROM supplier""",
    "rate_counter": rate_listing(EVENTS, kinds(t.EVENT_KINDS)),
    "rate_reset": rate_listing(
        EVENTS, kinds(t.EVENT_KINDS), "CASE WHEN d < 0 AND kind = 'COUNTER' THEN d + 4294967296.0 ELSE d END", digits=3
    ),
    "rate_wrap64": f"""WITH {EVENTS},
wide AS (SELECT resource, ts_ms, metric, (floor(value * 100)::HUGEINT * {q.WRAP_FACTOR}) % {2**64} AS value FROM ev),
l AS (SELECT *, lag(ts_ms) OVER s AS p_ts, lag(value) OVER s AS p_value FROM wide WINDOW s AS (PARTITION BY resource, metric ORDER BY ts_ms)),
d AS (SELECT *, value - p_value AS d, ts_ms // 1000 - p_ts // 1000 AS secs FROM l)
SELECT resource, metric, ts_ms, 'GAUGE' AS metric_type,
  CASE WHEN p_ts IS NULL OR secs = 0 THEN NULL
       ELSE floor((CASE WHEN d < 0 THEN d + {2**64} ELSE d END)::DOUBLE / secs + 0.5) END AS value FROM d""",
    "rate_gauge": rate_listing(EVENTS, "'GAUGE'", where="metric IN ('click', 'view')"),
    "rate_strict": strict(EVENTS.replace("ev AS", "src AS", 1), kinds(t.EVENT_KINDS), "'click', 'purchase'"),
    "rate_strict_dense": strict(DAILY.replace("daily AS", "src AS", 1), "'GAUGE'", "'A', 'N', 'R'"),
    "primary_avg": primary_listing(
        DAILY, "daily", [(f, t.LINE_HEARTBEAT) for f in FLAGS], TimeGrid.covering(t.LINES_START, t.LINES_END, t.LINE_STEP)
    ),
    "primary_few_series": primary_listing(
        TOTALS, "totals", [(f, hours(72)) for f in FLAGS], TimeGrid.covering(t.LINES_START, t.LINES_END, hours(36))
    ),
    "primary_multi_hb": primary_listing(
        EVENTS, "ev", [("click", hours(5)), ("click", hours(60)), ("view", hours(24))], EVENT_GRID, hb=True
    ),
    "stream_primary": stream_primary_query(),
    "primary_gapfill": gapfill_query(),
    "attr_merge": f"""WITH {attribute_rows()}
SELECT resource, metric, t AS ts_ms, 'k' AS attribute, arg_max({K_OF}, ts_ms) AS attribute_value
FROM pd_e GROUP BY resource, metric, t""",
    "attr_merge_rollup": f"""WITH {padded_attribute_rows()},
per_t AS (SELECT resource, metric, t, arg_max({K_OF}, ts_ms) AS k FROM pd_e GROUP BY resource, metric, t)
SELECT resource, metric AS label, {ceil_("t", t.EVENT_RESOLUTION)} AS ts_ms, 'k' AS attribute, arg_max(k, t) AS attribute_value
FROM per_t WHERE {ceil_("t", t.EVENT_RESOLUTION)} >= {floor_(q.SINCE, t.EVENT_RESOLUTION)} GROUP BY ALL""",
    "rollup_avg_min_max": listing(
        measured(DAILY, "daily", line_labels(), t.LINES_START, t.LINES_END, t.LINE_STEP, t.LINE_RESOLUTION)
    ),
    "rollup_xff": xff_query(),
    "compute_sum": unpivot(wide(event_measured("click", "view"), ["click", "view"]), {"total": "click + view", "click": "click"}),
    "compute_literal": unpivot(
        wide(event_measured("click"), ["click"]), {"plus": "click + 2.5", "again": "(click + 2.5) + click"}
    ),
    "compute_stage": unpivot(
        wide(event_measured("click", "view"), ["click", "view"]),
        {"click": "click", "view": "view", "total": "click + view"},
    ),
    "export_missing": unpivot(wide(event_measured("click"), ["click"]), {"click": "click", "absent": NAN}),
    "measurement_values": f"""WITH {event_measured("click", "view")}
SELECT resource, b AS ts_ms, CASE WHEN isnan(value) THEN 0 ELSE {rounded('value')} END AS value
FROM ro WHERE label = 'view'""",
    "custom_agg": custom_agg_query(),
    "custom_agg_ordered": custom_agg_ordered_query(),
    "custom_agg_merged": custom_agg_merged_query(),
    "custom_scalar": unpivot(
        wide(event_measured("click", "view"), ["click", "view"]),
        {
            "ratio": "click / (view + 1.0)",
            "capped": f"CASE WHEN isnan(click / (view + 1.0)) THEN 3.0 ELSE least(click / (view + 1.0), 3.0) END",
        },
    ),
    "process_counters": process_counters_query(),
    "rollup_incremental": rollup_incremental_query(),
    "process_unpadded": listing(event_measured("click", pad=False)),
    "select_with_lookback": lookback_query(),
    "average_per_series": average_per_series_query(),
    "correlate_topn": f"WITH {line_scores(ALL_LINE_SERIES, True)} SELECT {COEFFICIENT} FROM sc WHERE NOT isnan(c) {TOP} 10",
    "correlate_pruned": f"WITH {line_scores(ALL_LINE_SERIES, True)} SELECT {COEFFICIENT} FROM sc WHERE NOT isnan(c) {TOP} 10",
    "correlate_propagate": f"WITH {line_scores(ALL_LINE_SERIES, False)} SELECT {COEFFICIENT} FROM sc {TOP} 25",
    "correlate_all": f"WITH {event_scores(ALL_EVENT_SERIES)} SELECT {COEFFICIENT} FROM sc",
    "correlate_catalog_terms": f"""WITH {event_scores(
        "SELECT DISTINCT resource, metric FROM ev WHERE resource = 'u0' AND metric = 'click' OR resource IN "
        "(SELECT resource FROM ev WHERE CAST(props ->> 'k' AS INT) < 50)"
    )} SELECT {COEFFICIENT} FROM sc WHERE NOT isnan(c) {TOP} 20""",
    "correlate_list": f"""WITH {line_scores(
        "SELECT 's' || s_suppkey AS resource, 'A' AS metric FROM supplier UNION SELECT 's0', 'R'", True
    )} SELECT {COEFFICIENT} FROM sc WHERE NOT isnan(c) {TOP} 15""",
    "correlate_job": job_query(),
    "result_json": f"WITH {line_scores(ALL_LINE_SERIES, True)} SELECT {COEFFICIENT} FROM sc WHERE NOT isnan(c)",
    "rate_hot_series": f"""WITH {TOTALS}, {rates("totals", "'COUNTER'")}
SELECT resource, metric, ts_ms, 'GAUGE' AS metric_type, {out("value", 9)} AS value FROM rated""",
    "primary_hot_series": primary_listing(
        TOTALS, "totals", [(f, hours(72)) for f in FLAGS], TimeGrid.covering(t.LINES_START, t.LINES_END, hours(36))
    ),
    "process_hot_series": process_hot_query(),
    "correlate_hot_series": f"WITH {line_scores(ALL_LINE_SERIES, True)} SELECT {COEFFICIENT} FROM sc",
    "tree_flatten": f"""WITH RECURSIVE {TREE}
SELECT id, resource, metric, resource || ':' || metric AS key, array_to_string(path, '/') AS path FROM flat""",
    "display_lookup": display_query(),
}
