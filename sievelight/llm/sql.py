"""SQL of the corpus queries that SQL can express, over whole tables and texts."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: Sets of 5-word shingles, all pairs that share one, and what is reached by links.
OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
t AS (SELECT r, len(g) AS n, unnest(g) AS h FROM s),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS i, any_value(a.n) + any_value(b.n) AS n FROM t a JOIN t b ON a.h = b.h AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (n - i)),
e AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT r AS x, r AS y FROM s UNION SELECT c.x, e.y FROM c JOIN e ON e.x = c.y)
SELECT o.doc_id, cast(len(o.g) AS bigint) AS n_shingles, min(m.doc_id) AS component_id FROM c JOIN s o ON o.r = c.x JOIN s m ON m.r = c.y GROUP BY o.r, o.doc_id, o.g
"""

#: All 200-byte windows of all texts (as hexadecimal digits, two a byte), those that occur twice, and what they cover.
OP8_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, unnest(range(0, length(x) // 2 - 199)) AS p, x FROM d WHERE length(x) >= 400),
h AS (SELECT r, p, md5_number(substr(x, 2 * p + 1, 400)) AS k FROM w),
k AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
a AS (SELECT r, p, p - coalesce(lag(p) OVER (PARTITION BY r ORDER BY p), -1000) > 200 AS fresh FROM h WHERE k IN (SELECT k FROM k)),
b AS (SELECT r, p, sum(fresh::INT) OVER (PARTITION BY r ORDER BY p) AS run FROM a),
s AS (SELECT r, min(p) AS lo, max(p) + 200 AS hi FROM b GROUP BY r, run),
g AS (SELECT r, list(lo ORDER BY lo) AS lo, list(hi ORDER BY lo) AS hi FROM s GROUP BY r),
f AS (SELECT doc_id, x, coalesce(lo, []) AS lo, coalesce(hi, []) AS hi FROM d LEFT JOIN g USING (r))
SELECT doc_id, cast(length(x) // 2 AS bigint) AS n_bytes, cast(coalesce(list_sum(hi) - list_sum(lo), 0) AS bigint) AS n_removed, cast(len(lo) AS bigint) AS n_spans,
 sha256(unhex(array_to_string(list_transform(range(0, len(lo) + 1), lambda i: substr(x, 2 * (CASE WHEN i = 0 THEN 0 ELSE hi[i] END) + 1, greatest(0, 2 * ((CASE WHEN i = len(lo) THEN length(x) // 2 ELSE lo[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE hi[i] END))))), ''))) AS kept_sha256
FROM f
"""
