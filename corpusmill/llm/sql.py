"""SQL twins of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from corpusmill.llm.near_duplicates import RUN, THRESHOLD
from corpusmill.llm.splitting import FLOOR, LIMIT, OVERLAP

_CHUNKS = "c AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC) AS rn FROM chunks WHERE id IS NOT NULL) WHERE rn = 1)"
#: Blanks as Python's patterns know them; those of the other engine's patterns are fewer.
_BLANKS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_PAIRS = f"""WITH {_CHUNKS}, t AS (SELECT id, regexp_extract_all(content, '[A-Za-z0-9_]+|[^{_BLANKS}A-Za-z0-9_]') AS w FROM c WHERE content IS NOT NULL),
f AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - {RUN - 2}), lambda i: array_to_string(w[i:i + {RUN - 1}], chr(10)))) AS f FROM t WHERE len(w) >= {RUN}),
n AS (SELECT id, count(*) AS n FROM f GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS same FROM f a JOIN f b ON a.f = b.f AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM p JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE same >= {THRESHOLD} * (a.n + b.n - same)"""

# lines s..e have pos[e + 1] - pos[s] - 1 characters; lines count from 1 here
_PIECES = f"""WITH RECURSIVE {_CHUNKS}, l AS (SELECT id, coalesce(start_line, 1) AS first, string_split(content, chr(10)) AS l FROM c WHERE length(content) > {LIMIT}),
k AS (SELECT id, first, len(l) AS n, list_transform(l, lambda x: length(x)) AS size, list_prepend(0, list_transform(range(1, len(l) + 1), lambda i: list_sum(list_transform(l[1:i], lambda x: length(x) + 1))))::BIGINT[] AS pos,
list_filter(range(1, len(l) + 1), lambda i: NOT regexp_matches(l[i], '[^{_BLANKS}]')) AS blank FROM l),
r(id, piece_no, s, w, e) AS (
SELECT id, -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM k
UNION ALL
SELECT id, piece_no + 1, s, w, CASE WHEN size[s] > {LIMIT} THEN s WHEN fit < n THEN coalesce(list_max(list_filter(blank, lambda b: b >= s AND b <= fit AND pos[b + 1] - pos[s] - 1 >= {FLOOR})), fit) ELSE fit END FROM (
SELECT *, list_max(list_filter(range(s, n + 1), lambda j: pos[j + 1] - pos[s] - 1 <= {LIMIT})) AS fit FROM (
SELECT k.*, r.piece_no, CASE WHEN r.s = 0 THEN 1
WHEN size[r.s] > {LIMIT} THEN CASE WHEN r.w * {LIMIT - OVERLAP} + {LIMIT} >= size[r.s] THEN r.s + 1 ELSE r.s END
WHEN r.e = n THEN n + 1
ELSE coalesce(list_min(list_filter(range(r.s + 1, r.e + 1), lambda t: pos[r.e + 1] - pos[t] - 1 <= {OVERLAP} AND pos[r.e + 2] - pos[t] - 1 <= {LIMIT})), r.e + 1) END AS s,
CASE WHEN r.s > 0 AND size[r.s] > {LIMIT} AND r.w * {LIMIT - OVERLAP} + {LIMIT} < size[r.s] THEN r.w + 1 ELSE 0 END AS w FROM r JOIN k ON k.id = r.id) WHERE s <= n))
SELECT r.id, r.piece_no::INT AS piece_no, (k.first + r.s - 1)::INT AS start_line, (k.first + r.e - 1)::INT AS end_line FROM r JOIN k ON k.id = r.id WHERE r.piece_no >= 0"""

SQL: dict[str, str] = {"p2_found": _PAIRS, "p5_found": _PIECES}
