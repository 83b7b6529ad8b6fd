"""SQL of equal meaning for the pN_ queries that SQL can express over whole tables."""

from __future__ import annotations

_KEY = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g')"

_HELD = f"""
WITH pool AS (
  SELECT id, max(m) AS m, max(f) AS f, max(s) AS s FROM (
    SELECT id, {_KEY.format("mechanism")} AS m, {_KEY.format("family_domain")} AS f, {_KEY.format("subscenario")} AS s FROM miu_record
    UNION ALL SELECT id, {_KEY.format("mechanism")}, {_KEY.format("family_domain")}, {_KEY.format("subscenario")} FROM eil_record) x
  WHERE id IS NOT NULL GROUP BY id),
cells AS (
  SELECT plan_id, cell_id, share_pm, min_rows, draw_pm, {_KEY.format("mechanism")} AS m, {_KEY.format("family_domain")} AS f, {_KEY.format("subscenario")} AS s FROM category_target),
held AS (
  SELECT c.plan_id, c.cell_id, c.share_pm, c.min_rows, c.draw_pm, count(p.id) AS n
  FROM cells c LEFT JOIN pool p ON (c.m IS NULL OR c.m = p.m) AND (c.f IS NULL OR c.f = p.f) AND (c.s IS NULL OR c.s = p.s)
  GROUP BY ALL),
size AS (SELECT count(*) AS total FROM pool)
"""

_CROSS = """
WITH u AS (
  SELECT id, lower(trim(split)) AS split, 'request' AS field, [user_natural_language] AS parts FROM miu_record
  UNION ALL SELECT id, lower(trim(split)), 'cards', list_transform(clean_context, lambda c: c.content) FROM miu_record),
p AS (SELECT field, id, split, unnest(parts) AS t FROM u WHERE id IS NOT NULL AND split IN ('train', 'val', 'test')),
w AS (SELECT field, id, split, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM p WHERE t IS NOT NULL),
s AS (SELECT DISTINCT field, id, split = 'train' AS train, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS g FROM w),
n AS (SELECT field, id, count(DISTINCT g) AS n FROM s GROUP BY ALL),
c AS (SELECT a.field, a.id AS x, b.id AS y, count(*) AS c FROM s a JOIN s b ON a.field = b.field AND a.g = b.g AND a.train AND NOT b.train AND a.id <> b.id GROUP BY ALL),
pairs AS (SELECT DISTINCT least(c.x, c.y) AS id_1, greatest(c.x, c.y) AS id_2 FROM c JOIN n nx ON nx.field = c.field AND nx.id = c.x JOIN n ny ON ny.field = c.field AND ny.id = c.y WHERE 2 * c.c >= nx.n + ny.n - c.c)
"""

ORACLES: dict[str, str] = {
    "p1_found": _HELD
    + """SELECT plan_id, cell_id FROM held, size
WHERE n * 1000000 < CAST(share_pm AS BIGINT) * draw_pm * total OR n < min_rows""",
    # The cells of one plan are disjoint in these tables.
    "p1_margins": _HELD
    + """, w AS (SELECT *, greatest(CAST(share_pm AS BIGINT) * draw_pm * total / 1000000.0, min_rows) AS want FROM held, size)
SELECT plan_id, cell_id, n AS available, CAST(round(greatest(want - n, 0), 6) AS DOUBLE) AS short_rows, want > n AS cannot_meet, true AS met FROM w""",
    "p4_checks": f"""
WITH m AS (SELECT id, max({_KEY.format("family_domain")}) AS f FROM miu_record WHERE id IS NOT NULL GROUP BY id)
SELECT t.f AS family_domain, t.split, count(m.id) AS family_rows, true AS whole, true AS near FROM (SELECT {_KEY.format("family_domain")} AS f, lower(trim(split)) AS split FROM split_target) t LEFT JOIN m USING (f) GROUP BY ALL""",
    "p8_checks": "SELECT DISTINCT mix_id, source, true AS cap_kept, true AS share_kept FROM mix_target",
    "p2_found": _CROSS + "SELECT * FROM pairs",
    "p2_report": _CROSS
    + """, latest AS (SELECT record_id, max(attempt) AS a FROM audit_sidecar GROUP BY 1),
d AS (SELECT DISTINCT s.record_id, r.source_ref.dataset AS source FROM audit_sidecar s JOIN latest l ON s.record_id = l.record_id AND s.attempt IS NOT DISTINCT FROM l.a, unnest(s.source_packet.facts) f(r) WHERE r.source_ref.dataset IS NOT NULL),
e AS (SELECT id_1 AS id, id_1, id_2 FROM pairs UNION ALL SELECT id_2, id_1, id_2 FROM pairs),
x AS (SELECT DISTINCT id, lower(trim(split)) AS split FROM miu_record)
SELECT x.split, coalesce(d.source, 'none') AS source, count(DISTINCT (id_1, id_2)) AS pairs, count(DISTINCT e.id) AS records FROM e JOIN x ON e.id = x.id AND x.split IN ('val', 'test') LEFT JOIN d ON d.record_id = e.id GROUP BY 1, 2""",
    "p4_found": """
WITH ids AS (SELECT DISTINCT id FROM miu_record WHERE id IS NOT NULL),
latest AS (SELECT record_id, max(coalesce(attempt, -1)) AS a FROM audit_sidecar GROUP BY 1),
f AS (SELECT s.record_id AS id, unnest(s.source_packet.facts).source_ref AS r FROM audit_sidecar s JOIN latest l ON s.record_id = l.record_id AND coalesce(s.attempt, -1) = l.a JOIN ids ON ids.id = s.record_id),
p AS (SELECT DISTINCT id, r.dataset AS d, r.file AS f, trim(regexp_replace(lower(r.locator), '\\s+', ' ', 'g')) AS l FROM f WHERE r.dataset IS NOT NULL AND r.file IS NOT NULL),
k AS (SELECT * FROM p WHERE l IS NOT NULL AND l NOT IN ('', 'n/a', 'unknown', '-')),
m AS (SELECT d, f, l, min(id) AS hub FROM k GROUP BY ALL),
e AS (SELECT DISTINCT k.id AS x, m.hub AS y FROM k JOIN m USING (d, f, l)),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (WITH RECURSIVE r(x, y) AS (SELECT id, id FROM ids UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x) SELECT x AS id, min(y) AS group_id FROM r GROUP BY 1),
split AS (SELECT DISTINCT id, lower(trim(split)) AS split FROM miu_record WHERE split IS NOT NULL),
torn AS (SELECT group_id FROM reach JOIN split USING (id) GROUP BY 1 HAVING count(DISTINCT split) > 1)
SELECT id, group_id FROM reach WHERE group_id IN (SELECT group_id FROM torn)""",
    "p6_found": """
WITH u AS (SELECT 'user_natural_language' AS field, id, user_natural_language AS t FROM miu_record UNION SELECT 'adversary_opening', id, adversary_opening FROM eil_record),
w AS (SELECT field, id, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM u WHERE id IS NOT NULL AND t IS NOT NULL),
s AS (SELECT DISTINCT field, id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS g FROM w),
n AS (SELECT field, id, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT a.field, a.id AS id_1, b.id AS id_2, count(*) AS c FROM s a JOIN s b ON a.field = b.field AND a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT c.field, id_1, id_2 FROM c JOIN n x ON x.field = c.field AND x.id = id_1 JOIN n y ON y.field = c.field AND y.id = id_2 WHERE 2 * c >= x.n + y.n - c""",
    "p9_coverage": """
WITH w AS (SELECT DISTINCT doc_id, i, substr(text, i, 230) AS s FROM documents, unnest(range(1, length(text) - 228)) u(i) WHERE length(text) >= 230 AND doc_id IS NOT NULL),
g AS (SELECT s FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) > 1), k AS (SELECT DISTINCT doc_id, i FROM w JOIN g USING (s)),
o AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM k),
c AS (SELECT doc_id, count(*) FILTER (WHERE p IS NULL OR i > p + 230) AS spans, sum(CASE WHEN p IS NULL OR i >= p + 230 THEN 230 ELSE i - p END) AS shared FROM o GROUP BY 1),
n AS (SELECT doc_id, max(coalesce(length(text), 0)) AS n_chars FROM documents WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT doc_id, n_chars, coalesce(spans, 0) AS spans, CAST(coalesce(shared, 0) AS BIGINT) AS shared_chars, CASE WHEN n_chars > 0 THEN coalesce(shared, 0) / n_chars END AS share FROM n LEFT JOIN c USING (doc_id)""",
    "p9_found": """
WITH w AS (SELECT DISTINCT doc_id, substr(text, i, 230) AS s FROM documents, unnest(range(1, length(text) - 228)) u(i) WHERE length(text) >= 230),
g AS (SELECT s FROM w GROUP BY 1 HAVING count(*) > 1), k AS (SELECT w.* FROM w JOIN g USING (s))
SELECT DISTINCT a.doc_id AS doc_id_1, b.doc_id AS doc_id_2 FROM k a JOIN k b ON a.s = b.s AND a.doc_id < b.doc_id""",
}
