"""SQL for the queries that SQL can express."""

from __future__ import annotations

from tideline.llm.queries import LISTED_NAMES, URL_RULES

OP6 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight
  FROM sized GROUP BY source
), filled AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE * 1.5 AS wanted, sum(weight) OVER () AS weights,
    coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0) AS cap_before, coalesce(sum(weight) OVER before, 0) AS weight_before
  FROM sources
  WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT max((wanted - cap_before) / (weights - weight_before)) AS level FROM filled
  WHERE (wanted - cap_before) / (weights - weight_before) <= cap / weight
), targets AS (
  SELECT source, source_size, coalesce(least(cap, level * weight), cap) AS target FROM filled, level
), ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each,
    ('0x' || md5(CASE WHEN s.source IS NULL THEN 'n' ELSE 's' || s.source END)[1:8])::BIGINT / 4294967296.0::DOUBLE AS start,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, coalesce(((s.doc_id % 1024) + 1024) % 1024, -1), s.doc_id) AS rank
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  size * (floor(each) + floor(start + (each - floor(each)) * rank) - floor(start + (each - floor(each)) * (rank - 1)))::BIGINT AS taken
FROM ranked
"""

_rules = " UNION ALL ".join(f"SELECT '{r.verdict}' AS verdict, '{r.host}' AS rule_host, '{r.path}' AS rule_path" for r in URL_RULES)
OP8 = rf"""
WITH rules AS ({_rules}), parts AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), best AS (
  SELECT host, path, arg_max(rule_host || rule_path, len(rule_host || rule_path)) AS rule, arg_max(verdict, len(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT p.page_id, p.host, p.path, b.rule,
  coalesce(b.verdict, CASE WHEN list_has_any(string_split(p.host, '.'), {LISTED_NAMES!r}) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""

OP9 = r"""
WITH marked AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents
), groups AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM marked GROUP BY norm
)
SELECT m.doc_id, g.keep_id, g.group_size, m.doc_id = g.keep_id AS kept, sha256(m.norm) AS text_sha256
FROM marked m JOIN groups g ON m.norm = g.norm
"""

# Vectors that take part, as whole numbers; ``row`` tells repeated rows apart and breaks ties as the ids do.
_numbers = """
numbers AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS row, vec_id, {label} AS label,
    list_transform(embedding, lambda x: floor({scale}::DOUBLE * x::DOUBLE)::BIGINT) AS ints
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND {label} IS NOT NULL
)"""
_product = "list_sum(list_transform(list_zip({a}.ints, {b}.ints), lambda z: coalesce(z[1] * z[2], 0)))::BIGINT"

OP12 = f"""
WITH {_numbers.format(label="0", scale=1024)}, scored AS (
  SELECT q.row AS query, q.vec_id AS query_id, c.row, c.vec_id, coalesce({_product.format(a="q", b="c")}, 0) AS score
  FROM numbers q JOIN numbers c ON q.row <> c.row WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, row)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP13 = f"""
WITH {_numbers.format(label="(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)", scale=256)}, scored AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, c.row, c.vec_id, a.label = c.label AS same, coalesce({_product.format(a="a", b="c")}, 0) AS score
  FROM numbers a JOIN numbers c ON a.row <> c.row WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, row) AS place FROM scored WHERE same) WHERE place <= 5
), mined AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.row)::INTEGER AS rank
  FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM mined WHERE rank <= 3
"""

ORACLES: dict[str, str] = {"op6_mixing": OP6, "op8_urls": OP8, "op9_dedup": OP9, "op12_topk": OP12, "op13_negatives": OP13}
