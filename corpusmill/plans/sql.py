"""SQL twins of the core's queries, for another engine over the same tables."""

from __future__ import annotations

from corpusmill.functions import text as fx
from corpusmill.operators import entities
from corpusmill.operators.rerank import WEIGHTS
from corpusmill.plans.queries import KEYWORD, PREFIX, QUERY, SEMANTIC, WORDS

FILES = "f AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC) AS rn FROM files WHERE path IS NOT NULL) WHERE rn = 1)"
CHUNKS = "c AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC) AS rn FROM chunks WHERE id IS NOT NULL) WHERE rn = 1)"
NODES = "n AS (SELECT id, min(type) AS type, min(file_path) AS file_path, min(line_number) AS line_number FROM nodes GROUP BY id)"
EDGES = "e AS (SELECT DISTINCT source_id, target_id, relationship_type FROM edges)"


def _tokens(text: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower(replace(coalesce({text}, ''), chr(304), 'i' || chr(775))), '[^\\p{{L}}\\p{{N}}_\\s.]', ' ', 'g'), '\\s+'), lambda x: length(x) > 1)"


def _bm25(source: str, key: str, text: str, queries: str, k: int = 10) -> str:
    """CTEs up to kh(query_id, id, score, rank)."""
    return f"""
d AS (SELECT {key} AS id, {_tokens(text)} AS tokens FROM {source}), dl AS (SELECT id, tokens, len(tokens) AS dl FROM d),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT id, unnest(tokens) AS token FROM dl) GROUP BY token),
raw AS (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, s),
idf AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qs AS ({queries}),
qt AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({_tokens("query")}) AS token FROM qs) GROUP BY ALL),
tf AS (SELECT id, dl, token, count(*) AS tf FROM (SELECT id, dl, unnest(tokens) AS token FROM dl) WHERE token IN (SELECT token FROM qt) GROUP BY ALL),
sc AS (SELECT query_id, id, sum(times * idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM tf JOIN qt USING (token) JOIN idf USING (token), s GROUP BY query_id, id),
kh AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc WHERE score > 0) WHERE rank <= {k})"""


_ONE = f"SELECT 0 AS query_id, '{WORDS}' AS query"
_ASKED = "SELECT doc_id AS query_id, text AS query FROM documents WHERE kind = 'search_query'"
_DOCS = lambda q: _bm25("documents", "doc_id", "text", q)


def _nearest(metric: str, where: str = "true") -> str:
    a, b = "list_transform(q.embedding, lambda x: x::DOUBLE)", "list_transform(v.embedding, lambda x: x::DOUBLE)"
    if metric == "l2":
        value, name, far = f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))", "distance", "value"
    else:
        value, name, far = f"list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a})) / sqrt(list_dot_product({b}, {b}))", "similarity", "-value"
    return f"""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, {value} AS value FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({far}, 9), vec_id) AS rank FROM p)
SELECT query_id, vec_id, round(value, 6) AS {name}, rank FROM r WHERE rank <= 10"""


_FINE = "embedding IS NOT NULL AND len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) = 128 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


def _hybrid(queries: str, seeds: int | str, nearness: str = "-distance") -> str:
    """CTEs up to fu(query_id, id, score, vector_score, bm25_score, search_types, rank)."""
    return f"""WITH {CHUNKS}, u AS (SELECT id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM c WHERE {_FINE}),
seeds AS (SELECT row_number() OVER (ORDER BY id) - 1 AS number, v AS vector FROM (SELECT * FROM u ORDER BY id LIMIT {seeds})),
{_bm25("c", "id", "content", queries)},
vd AS (SELECT qs.query_id, u.id, list_sum(list_transform(list_zip(qs.vector, u.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM qs, u),
vh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM vd) WHERE rank <= 10),
vn AS (SELECT query_id, id, CASE WHEN max(s) OVER w = min(s) OVER w THEN 0.5 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END AS v FROM (SELECT query_id, id, {nearness} AS s FROM vh) WINDOW w AS (PARTITION BY query_id)),
bn AS (SELECT query_id, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS b FROM kh WINDOW w AS (PARTITION BY query_id)),
fo AS (SELECT query_id, id, 0.6 * coalesce(v, 0) + 0.4 * coalesce(b, 0) AS score, coalesce(v, 0) AS vector_score, coalesce(b, 0) AS bm25_score, concat_ws('+', CASE WHEN v IS NOT NULL THEN 'vector' END, CASE WHEN b IS NOT NULL THEN 'bm25' END) AS search_types FROM vn FULL OUTER JOIN bn USING (query_id, id)),
fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM fo) WHERE rank <= 10)"""


_ONE_VECTOR = f"SELECT number AS query_id, '{QUERY}' AS query, vector FROM seeds"
_FUSED = " SELECT query_id, id, round(score, 6) AS score, round(vector_score, 6) AS vector_score, round(bm25_score, 6) AS bm25_score, search_types, rank FROM fu"

_COMPLEXITY = (
    "CASE WHEN length(content) > 0 THEN least((list_sum(list_transform(string_split(lower(content), chr(10)), lambda l: "
    + " + ".join(f"contains(l, '{w}')::INT" for w in fx.CONTROL_WORDS)
    + ")) + list_max(list_transform(string_split(content, chr(10)), lambda l: CASE WHEN regexp_matches(l, '\\S') THEN length(l) - length(regexp_replace(l, '^\\s+', '')) ELSE 0 END)) // 4) / (length(content) / 1000.0), 1.0) ELSE 0.0 END"
)
_ALL_LINES = "len(list_filter(string_split(content, chr(10)), lambda l: regexp_matches(l, '\\S')))"
_DOCUMENTATION = f"CASE WHEN {_ALL_LINES} > 0 THEN least(len(list_filter(string_split(content, chr(10)), lambda l: regexp_matches(l, '^\\s*(#|//|/\\*)') OR contains(l, '\"\"\"') OR contains(l, repeat(chr(39), 3)))) / {_ALL_LINES}, 1.0) ELSE 0.0 END"
_SUFFIX = "lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1))"


def _case(table: dict[str, str], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_SUFFIX} = '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


def _kinds(table: dict[str, str]) -> dict[str, str]:
    return {s: k for k, v in table.items() for s in v.split()}


def _quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


_PATTERNS = ", ".join(f"('{lang}', '{kind}', {_quoted(p)})" for kind, own in (("Function", entities.FUNCTIONS), ("Class", entities.CLASSES)) for lang, ps in own.items() for p in ps)
_ENTITIES = f"""pat(language, kind, pattern) AS (VALUES {_PATTERNS}),
li AS (SELECT id AS chunk_id, file_path, language, coalesce(start_line, 1) AS start, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS off FROM c WHERE content IS NOT NULL),
en AS (SELECT chunk_id, file_path, kind, regexp_extract(line, pattern, 1) AS name, file_path || '::' || regexp_extract(line, pattern, 1) AS id, start + off AS line_number FROM li JOIN pat USING (language) WHERE regexp_extract(line, pattern, 1) <> '')"""
_BUILT = f"""{_ENTITIES},
gn AS (SELECT file_path AS id, 'File' AS type, file_path, NULL::BIGINT AS line_number, coalesce(arg_min_null(language, (coalesce(start_line, 0), id)), 'unknown') AS language FROM c GROUP BY file_path
UNION ALL SELECT id, 'Chunk', file_path, start_line, NULL FROM c
UNION ALL SELECT id, kind, file_path, line_number, NULL FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (kind = 'Class') DESC, line_number DESC) AS rn FROM en) WHERE rn = 1),
ge AS (SELECT DISTINCT file_path AS source_id, id AS target_id, 'CONTAINS' AS relationship_type FROM c UNION ALL SELECT DISTINCT id, chunk_id, 'DEFINED_IN' FROM en)"""
#: Everything around the hits fu over the graph ge: their edges he, and near, the ends of these that are nodes.
_AROUND = f"""{_BUILT},
he AS (SELECT DISTINCT fu.id AS start, ge.* FROM fu JOIN ge ON ge.source_id = fu.id OR ge.target_id = fu.id),
near AS (SELECT DISTINCT start, id, gn.type FROM (SELECT start, source_id AS id FROM he UNION SELECT start, target_id FROM he) JOIN gn USING (id)),
nn AS (SELECT start, count(*) AS n_nodes, count(*) FILTER (type = 'Function' AND contains(lower(id), '{QUERY}')) AS fm, count(*) FILTER (type = 'Class' AND contains(lower(id), '{QUERY}')) AS cm FROM near GROUP BY start),
dg AS (SELECT start, max(k) AS max_degree FROM (SELECT start, id, count(*) AS k FROM (SELECT start, source_id AS id FROM he UNION ALL SELECT start, target_id FROM he) GROUP BY ALL) GROUP BY start),
ft AS (SELECT fu.id, fu.score, coalesce(max_degree / n_nodes, 0) AS degree_centrality, coalesce(fm, 0)::DOUBLE AS query_function_matches, coalesce(cm, 0)::DOUBLE AS query_class_matches, 0.0::DOUBLE AS function_depth, 0.0::DOUBLE AS class_hierarchy_depth, 0.0::DOUBLE AS call_frequency, 0.0::DOUBLE AS inheritance_importance,
{_COMPLEXITY}::DOUBLE AS code_complexity, {_DOCUMENTATION}::DOUBLE AS documentation_score FROM fu JOIN c USING (id) LEFT JOIN nn ON nn.start = fu.id LEFT JOIN dg ON dg.start = fu.id)"""
_SCORE = "(" + " + ".join(f"least({c}, 1.0) * {w}" for c, w in WEIGHTS.items()) + f") / {sum(WEIGHTS.values())}"
_SIGNS = lambda words: " + ".join(f"contains(lower(text), '{w}')::INT" for w in words)
_EVENTS = "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"
_H = _hybrid(_ONE_VECTOR, 1)
_CONFLICTS = """cf AS (SELECT query_id, id, CASE WHEN coalesce(v.rank <= 5, false) AND NOT coalesce(b.rank <= 5, false) THEN 'vector_high_bm25_low' WHEN coalesce(b.rank <= 5, false) AND NOT coalesce(v.rank <= 5, false) THEN 'bm25_high_vector_low' END AS conflict,
coalesce(v.rank, (SELECT count(*) FROM vh)) AS vector_rank, coalesce(b.rank, (SELECT count(*) FROM kh)) AS bm25_rank FROM vh v FULL OUTER JOIN kh b USING (query_id, id))"""



def _resolution(query: str, factor: str) -> str:
    return _hybrid(f"SELECT number AS query_id, '{query}' AS query, vector FROM seeds", 1) + f""", {_CONFLICTS}, a AS (SELECT id, avg(score) AS score FROM (SELECT id, distance AS score FROM vh UNION ALL SELECT id, score FROM kh) GROUP BY id),
z AS (SELECT a.id, a.score * CASE WHEN conflict IS NULL THEN 1 ELSE {factor} END AS score, CASE WHEN (SELECT count(conflict) FROM cf) > 0 THEN 'resolved' ELSE 'combined' END AS search_type, conflict IS NOT NULL AS resolved FROM a JOIN cf USING (id)),
r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM z) SELECT id, round(score, 6) AS score, search_type, resolved, rank FROM r WHERE rank <= 10"""


#: The features over the graph of the tables, the longest path of calls by recursion over each node's own edges.
_CALLS = f"""WITH RECURSIVE {FILES}, {NODES}, {EDGES}, w AS (SELECT * FROM e WHERE relationship_type IN ('CALLS', 'DEFINED_IN', 'CONTAINS', 'HAS_METHOD')),
he AS (SELECT source_id AS start, w.* FROM w UNION SELECT target_id, w.* FROM w), hs AS (SELECT he.* FROM he JOIN n ON n.id = he.start),
near AS (SELECT DISTINCT start, n.id, n.type FROM (SELECT start, source_id AS id FROM hs UNION SELECT start, target_id FROM hs) JOIN n USING (id)),
nn AS (SELECT start, count(*) AS n_nodes, count(*) FILTER (type = 'Function' AND contains(lower(id), '{QUERY}')) AS fm, count(*) FILTER (type = 'Class' AND contains(lower(id), '{QUERY}')) AS cm FROM near GROUP BY start),
dg AS (SELECT start, max(k) AS max_degree FROM (SELECT start, id, count(*) AS k FROM (SELECT start, source_id AS id FROM hs UNION ALL SELECT start, target_id FROM hs) GROUP BY ALL) GROUP BY start),
ca AS (SELECT * FROM hs WHERE relationship_type = 'CALLS'),
r AS (SELECT start, id AS at, 0 AS depth FROM near WHERE type = 'Function' AND id <> start UNION SELECT r.start, ca.target_id, r.depth + 1 FROM r JOIN ca ON ca.start = r.start AND ca.source_id = r.at WHERE r.depth < 11),
fd AS (SELECT start, max(depth) AS depth FROM r GROUP BY start), ci AS (SELECT start, count(*) AS k FROM ca WHERE target_id = start GROUP BY start),
ft AS (SELECT n.id, coalesce(max_degree / n_nodes, 0) AS degree_centrality, coalesce(fm, 0)::DOUBLE AS query_function_matches, coalesce(cm, 0)::DOUBLE AS query_class_matches, coalesce(fd.depth, 0)::DOUBLE AS function_depth, 0.0::DOUBLE AS class_hierarchy_depth, coalesce(ci.k / n_nodes, 0)::DOUBLE AS call_frequency, 0.0::DOUBLE AS inheritance_importance,
CASE WHEN content IS NULL THEN 0.0 ELSE {_COMPLEXITY} END::DOUBLE AS code_complexity, CASE WHEN content IS NULL THEN 0.0 ELSE {_DOCUMENTATION} END::DOUBLE AS documentation_score
FROM n LEFT JOIN f ON f.path = n.id LEFT JOIN nn ON nn.start = n.id LEFT JOIN dg ON dg.start = n.id LEFT JOIN fd ON fd.start = n.id LEFT JOIN ci ON ci.start = n.id)"""

SQL: dict[str, str] = {
    "bm25_index_stats": f"WITH {_DOCS(_ONE)} SELECT n AS documents, (SELECT count(*) FROM df) AS vocabulary, round(avgdl, 6) AS avgdl, 1.2::DOUBLE AS k1, 0.75::DOUBLE AS b FROM s",
    "bm25_incremental": f"WITH {_DOCS(_ONE)} SELECT id AS doc_id, round(score, 6) AS score FROM sc WHERE score > 0",
    "vector_ivf_exact": _nearest("l2"),
    "edge_upsert_override": """WITH p AS (SELECT source_id, target_id, relationship_type, unnest(map_entries(properties)) AS kv FROM edges),
o AS (SELECT DISTINCT source_id, target_id, relationship_type, unnest(['mark', 'line']) AS k FROM edges WHERE lower(substring(source_id, 1, 1)) <= 'm'),
m AS (SELECT source_id, target_id, relationship_type, kv.key AS k, max(kv.value) AS v FROM p GROUP BY ALL),
b AS (SELECT source_id, target_id, relationship_type, k, CASE WHEN m.k IS NOT NULL THEN m.v ELSE 'old' END AS v FROM m FULL OUTER JOIN o USING (source_id, target_id, relationship_type, k)),
s AS (SELECT source_id, target_id, relationship_type, string_agg(k || '=' || coalesce(v, ''), ';' ORDER BY k) AS properties FROM b GROUP BY ALL), e AS (SELECT DISTINCT source_id, target_id, relationship_type FROM edges)
SELECT e.*, coalesce(s.properties, '') AS properties FROM e LEFT JOIN s USING (source_id, target_id, relationship_type)""",
    "chunk_delete_prefix": f"WITH {CHUNKS}, x AS (SELECT id, CASE WHEN coalesce(start_line, 0) % 7 <> 0 THEN file_path END AS file_path FROM c) SELECT * FROM x WHERE NOT coalesce(starts_with(file_path, '{PREFIX}'), false)",
    "chunk_reindex": f"WITH {CHUNKS} SELECT id, file_path, chunk_type FROM c WHERE NOT coalesce(starts_with(file_path, '{PREFIX}'), false) OR chunk_type = 'function_definition'",
    "rerank_features_calls": _CALLS + " SELECT id, " + ", ".join(f"round({c}, 6) AS {c}" for c in WEIGHTS) + f", round({_SCORE}, 6) AS graph_score FROM ft",
    "conflict_semantic": _resolution(SEMANTIC, "CASE WHEN conflict = 'vector_high_bm25_low' THEN 1.0 ELSE 0.7 END"),
    "conflict_keyword": _resolution(KEYWORD, "CASE WHEN conflict = 'bm25_high_vector_low' THEN 1.0 ELSE 0.7 END"),
    "bm25_search": f"WITH {_DOCS(_ONE)} SELECT id AS doc_id, round(score, 6) AS score, rank FROM kh",
    "bm25_scores": f"WITH {_DOCS(_ONE)} SELECT id AS doc_id, round(score, 6) AS score FROM sc WHERE score > 0",
    "bm25_batch": f"WITH {_DOCS(_ASKED)} SELECT query_id, id AS doc_id, round(score, 6) AS score, rank FROM kh",
    "bm25_doc_freq": f"WITH {_DOCS(_ONE)} SELECT token, df FROM df",
    "bm25_idf": f"WITH {_DOCS(_ONE)} SELECT token, df, round(idf, 6) AS idf FROM idf",
    "bm25_vocab_stats": f"WITH {_DOCS(_ONE)} SELECT n AS documents, (SELECT count(*) FROM df) AS vocabulary, round(avgdl, 6) AS avgdl, 1.2::DOUBLE AS k1, 0.75::DOUBLE AS b FROM s",
    "query_type": f"SELECT doc_id, CASE WHEN {_SIGNS(fx.SEMANTIC_SIGNS)} > {_SIGNS(fx.KEYWORD_SIGNS)} THEN 'semantic' WHEN {_SIGNS(fx.KEYWORD_SIGNS)} > {_SIGNS(fx.SEMANTIC_SIGNS)} THEN 'keyword' ELSE 'mixed' END AS query_type FROM documents WHERE kind = 'search_query'",
    "vector_l2_topk": _nearest("l2"),
    "vector_l2_filtered": _nearest("l2", "v.label = 1"),
    "vector_cosine_topk": _nearest("cosine"),
    "hybrid_search": _H + _FUSED,
    "hybrid_compat": _hybrid(_ONE_VECTOR, 1, "distance") + _FUSED,
    "hybrid_batch": _hybrid(f"SELECT query_id, query, vector FROM (SELECT *, row_number() OVER (ORDER BY query_id) - 1 AS number FROM ({_ASKED})) a JOIN seeds USING (number)", f"(SELECT count(*) FROM ({_ASKED}))") + _FUSED,
    "line_chunks": f"""WITH {FILES}, l AS (SELECT path, language, string_split(content, chr(10)) AS lines FROM f WHERE content <> '' AND language IS NOT NULL),
x AS (SELECT *, unnest(range(0, len(lines), 20)) AS pos FROM l)
SELECT md5(path || ':' || (pos + 1) || '-' || least(pos + 20, len(lines))) AS id, path AS file_path, array_to_string(lines[pos + 1:pos + 20], chr(10)) AS content, (pos + 1)::INT AS start_line, least(pos + 20, len(lines))::INT AS end_line, language, (pos // 20)::INT AS chunk_index FROM x""",
    "chunk_id_md5": f"WITH {CHUNKS} SELECT id, md5(file_path || ':' || start_line || '-' || end_line) AS made_id FROM c WHERE end_line IS NOT NULL",
    "classify": f"WITH {FILES} SELECT path, {_case(fx.LANGUAGES, 'NULL')} AS language, {_case(_kinds(fx.FILE_TYPES), _quoted('unknown'))} AS file_type, {_case(_kinds(fx.GRAPH_FILE_TYPES), _quoted('other'))} AS graph_file_type, CASE WHEN contains(path, '::') THEN string_split(path, '::')[-1] ELSE string_split(path, '/')[-1] END AS label FROM f",
    "code_metrics": f"WITH {FILES} SELECT path, round({_COMPLEXITY}, 6) AS complexity, round({_DOCUMENTATION}, 6) AS documentation, CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || '...' ELSE content END AS snippet FROM f WHERE content IS NOT NULL",
    "chunk_lines": f"WITH {CHUNKS}, {FILES} SELECT c.id, CASE WHEN strpos(f.content, c.content) > 0 THEN len(string_split(substring(f.content, 1, strpos(f.content, c.content) - 1), chr(10))) ELSE 1 END::BIGINT AS line FROM c JOIN f ON f.path = c.file_path WHERE c.content <> '' AND f.content <> ''",
    "entity_list": f"WITH {CHUNKS}, {_ENTITIES} SELECT chunk_id, kind, name, id, line_number::BIGINT AS line_number FROM en",
    "text_contains": f"WITH {CHUNKS} SELECT id, CASE WHEN length(content) > 200 THEN substring(content, 1, 200) || '...' ELSE content END AS snippet FROM c WHERE contains(lower(content), '{QUERY}')",
    "text_contains_first": f"WITH {CHUNKS} SELECT id, file_path FROM c WHERE contains(lower(content), '{QUERY}') ORDER BY file_path, start_line NULLS FIRST, id LIMIT 10",
    "search_in_file": f"WITH {CHUNKS}, p AS (SELECT file_path FROM c GROUP BY 1 ORDER BY count(*) DESC, file_path LIMIT 1), h AS (SELECT *, row_number() OVER (ORDER BY coalesce(start_line, 0), id) AS rank FROM c WHERE file_path = (SELECT file_path FROM p) AND contains(lower(content), '{QUERY}')) SELECT id, CASE WHEN length(content) > 150 THEN substring(content, 1, 150) || '...' ELSE content END AS snippet, 1.0::DOUBLE AS score, 'file_query' AS search_type, rank FROM h WHERE rank <= 10",
    "file_summary": f"WITH {CHUNKS} SELECT file_path, arg_min_null(language, (coalesce(start_line, 0), id)) AS language, count(*) AS chunks, count(DISTINCT chunk_type) AS chunk_types, sum(length(content))::BIGINT AS characters FROM c GROUP BY file_path",
    "graph_nodes": f"WITH {CHUNKS}, {_BUILT} SELECT id, type, file_path, line_number, language FROM gn",
    "graph_edges": f"WITH {CHUNKS}, {_BUILT} SELECT source_id, target_id, relationship_type FROM ge",
    "graph_stats": f"WITH {EDGES}, {NODES}, x AS (SELECT 'node' AS kind, type FROM n UNION ALL SELECT 'edge', relationship_type FROM e) SELECT kind, type, count(*) AS count FROM x GROUP BY GROUPING SETS ((kind, type), (kind))",
    "graph_related": f"WITH {EDGES}, {NODES}, t AS (SELECT s.id AS start, source_id, target_id FROM n s JOIN e ON e.source_id = s.id WHERE s.type = 'Class' UNION SELECT s.id, source_id, target_id FROM n s JOIN e ON e.target_id = s.id WHERE s.type = 'Class'), x AS (SELECT start, source_id AS id FROM t UNION SELECT start, target_id FROM t) SELECT start AS id, n.type, count(*) AS n FROM x JOIN n ON n.id = x.id GROUP BY ALL",
    "graph_file_structure": f"""WITH {CHUNKS}, {_BUILT}, a AS (SELECT gn.id AS start, ge.* FROM gn JOIN ge ON ge.source_id = gn.id WHERE gn.type = 'File' UNION SELECT gn.id, ge.* FROM gn JOIN ge ON ge.target_id = gn.id WHERE gn.type = 'File'),
k AS (SELECT DISTINCT a.start, gn.id FROM a JOIN gn ON gn.id IN (a.source_id, a.target_id) WHERE gn.type = 'Chunk'),
b AS (SELECT * FROM a UNION SELECT k.start, ge.* FROM k JOIN ge ON ge.source_id = k.id UNION SELECT k.start, ge.* FROM k JOIN ge ON ge.target_id = k.id),
x AS (SELECT start, source_id AS id FROM b UNION SELECT start, target_id FROM b) SELECT start AS file_path, gn.type, count(*) AS n FROM x JOIN gn ON gn.id = x.id GROUP BY ALL""",
    "graph_file_chain": f"""WITH {CHUNKS}, {_BUILT}, {NODES}, {EDGES}, an AS (SELECT id, type FROM gn UNION SELECT id, type FROM n), ae AS (SELECT * FROM ge UNION SELECT * FROM e),
ch AS (SELECT DISTINCT source_id AS file, target_id AS chunk FROM ae JOIN an f ON f.id = source_id AND f.type = 'File' JOIN an k ON k.id = target_id AND k.type = 'Chunk' WHERE relationship_type = 'CONTAINS'),
de AS (SELECT DISTINCT file, an.type AS level, an.id FROM ch JOIN ae ON ae.target_id = chunk AND relationship_type = 'DEFINED_IN' JOIN an ON an.id = ae.source_id AND an.type IN ('Function', 'Class')),
me AS (SELECT DISTINCT file, 'Method' AS level, an.id FROM de JOIN ae ON ae.source_id = de.id AND relationship_type = 'HAS_METHOD' JOIN an ON an.id = ae.target_id AND an.type = 'Function' WHERE de.level = 'Class'),
al AS (SELECT file, 'Chunk' AS level, chunk AS id FROM ch UNION SELECT * FROM de UNION SELECT * FROM me UNION SELECT file, 'File', file FROM ch)
SELECT file, level, count(*) AS n FROM al GROUP BY ALL""",
    "graph_dependencies": f"WITH {EDGES}, {NODES} SELECT e.source_id AS id, e.target_id, n.type AS target_type FROM e LEFT JOIN n ON n.id = e.target_id WHERE relationship_type = 'CALLS'",
    "graph_hierarchy": f"WITH {EDGES}, {NODES} SELECT e.source_id AS id, e.target_id, n.type AS target_type FROM e LEFT JOIN n ON n.id = e.target_id WHERE relationship_type = 'INHERITS_FROM'",
    "graph_node_details": f"WITH {EDGES}, {NODES}, i AS (SELECT target_id AS id, count(*) AS k FROM e GROUP BY 1), o AS (SELECT source_id AS id, count(*) AS k FROM e GROUP BY 1), m AS (SELECT id, count(DISTINCT other) FILTER (other <> id) AS k FROM (SELECT source_id AS id, target_id AS other FROM e UNION ALL SELECT target_id, source_id FROM e) GROUP BY 1) SELECT n.id, n.type, coalesce(i.k, 0) AS in_degree, coalesce(o.k, 0) AS out_degree, coalesce(m.k, 0) AS neighbours FROM n LEFT JOIN i USING (id) LEFT JOIN o USING (id) LEFT JOIN m USING (id)",
    "graph_degree": f"WITH {EDGES} SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM e UNION ALL SELECT target_id FROM e) GROUP BY id",
    "graph_khop": f"""WITH RECURSIVE {EDGES}, k AS (SELECT source_id, target_id FROM e WHERE relationship_type = 'CALLS'), st AS (SELECT DISTINCT source_id AS id FROM k),
r AS (SELECT id AS start, id, 0::BIGINT AS depth FROM st UNION SELECT r.start, k.target_id, r.depth + 1 FROM r JOIN k ON k.source_id = r.id WHERE r.depth < 3) SELECT start, id, min(depth) AS depth FROM r GROUP BY ALL""",
    "graph_call_depth": f"""WITH RECURSIVE {EDGES}, k AS (SELECT source_id, target_id FROM e WHERE relationship_type = 'CALLS'),
r AS (SELECT DISTINCT source_id AS id, source_id AS at, 0::BIGINT AS depth FROM k UNION SELECT r.id, k.target_id, r.depth + 1 FROM r JOIN k ON k.source_id = r.at WHERE r.depth < 11) SELECT id, max(depth) AS depth FROM r GROUP BY id""",
    "edge_upsert_merge": """WITH p AS (SELECT source_id, target_id, relationship_type, unnest(map_entries(properties)) AS kv FROM edges), m AS (SELECT source_id, target_id, relationship_type, kv.key AS k, max(kv.value) AS v FROM p GROUP BY ALL),
s AS (SELECT source_id, target_id, relationship_type, string_agg(k || '=' || coalesce(v, ''), ';' ORDER BY k) AS properties FROM m GROUP BY ALL), e AS (SELECT DISTINCT source_id, target_id, relationship_type FROM edges)
SELECT e.*, coalesce(s.properties, '') AS properties FROM e LEFT JOIN s USING (source_id, target_id, relationship_type)""",
    "node_upsert": "SELECT id, type, file_path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (type <> 'File') DESC, type DESC, file_path DESC) AS rn FROM nodes) WHERE rn = 1",
    "prefix_delete": f"WITH {EDGES}, {NODES}, g AS (SELECT id FROM n WHERE starts_with(coalesce(file_path, id), '{PREFIX}') OR starts_with(id, '{PREFIX}')) SELECT 'node' AS kind, id FROM n WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'edge', source_id || '>' || target_id || '>' || relationship_type FROM e WHERE source_id NOT IN (SELECT id FROM g) AND target_id NOT IN (SELECT id FROM g)",
    "graph_enhance": _H + f", {_AROUND}, ec AS (SELECT start, count(*) AS k FROM he GROUP BY 1), fn AS (SELECT start, string_agg(string_split(id, '::')[-1], ',' ORDER BY string_split(id, '::')[-1], id) AS names FROM near WHERE type = 'Function' GROUP BY 1) SELECT fu.id, coalesce(n_nodes, 0) AS related_nodes, coalesce(ec.k, 0) AS related_edges, coalesce(names, '') AS related_functions FROM fu LEFT JOIN nn ON nn.start = fu.id LEFT JOIN ec ON ec.start = fu.id LEFT JOIN fn ON fn.start = fu.id",
    "rerank_features": _H + f", {_AROUND} SELECT id, " + ", ".join(f"round({c}, 6) AS {c}" for c in WEIGHTS) + " FROM ft",
    "graph_rerank": _H + f", {_AROUND}, g AS (SELECT id, score, {_SCORE} AS g FROM ft), z AS (SELECT id, CASE WHEN g > 0.5 THEN 0.6 * score + 0.4 * g ELSE 0.8 * score + 0.2 * g END AS score, g FROM g) SELECT id, round(score, 6) AS score, round(g, 6) AS graph_score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM z",
    "conflict_detection": _H + f", {_CONFLICTS} SELECT id, conflict, vector_rank, bm25_rank FROM cf WHERE conflict IS NOT NULL",
    "conflict_resolution": _H + f""", {_CONFLICTS}, a AS (SELECT id, avg(score) AS score FROM (SELECT id, distance AS score FROM vh UNION ALL SELECT id, score FROM kh) GROUP BY id),
z AS (SELECT a.id, a.score * CASE WHEN conflict IS NULL THEN 1 ELSE 0.8 END AS score, CASE WHEN (SELECT count(conflict) FROM cf) > 0 THEN 'resolved' ELSE 'combined' END AS search_type, conflict IS NOT NULL AS resolved FROM a JOIN cf USING (id)),
r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM z) SELECT id, round(score, 6) AS score, search_type, resolved, rank FROM r WHERE rank <= 10""",
    "stream_event_windows": _EVENTS,
    "batch_event_windows": _EVENTS,
    "stream_latest_chunks": f"WITH {CHUNKS} SELECT id, file_path, language, indexed_at FROM c",
}
