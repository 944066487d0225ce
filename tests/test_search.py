from __future__ import annotations

import math
import os
from collections import Counter

import numpy as np
import pytest

from corpusmill.functions.text import tokenize
from corpusmill.operators import bm25, embed, fusion, rerank, vector

DOCS = [(1, "alpha beta beta gamma"), (2, "alpha alpha delta"), (3, "alpha epsilon"), (4, None), (5, ""), (6, "alpha zeta beta")]


def plain_bm25(docs, query, k1=1.2, b=0.75):
    toks = {i: tokenize(t or "") for i, t in docs}
    n, avgdl = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    out = {}
    for i, t in toks.items():
        tf = Counter(t)
        s = sum(idf[q] * tf[q] * (k1 + 1) / (tf[q] + k1 * (1 - b + b * len(t) / avgdl)) for q in tokenize(query) if tf[q])
        if any(tf[q] for q in tokenize(query)):
            out[i] = s
    return out


@pytest.mark.parametrize("k1,b", [(None, None), (0, 0.5), (2.0, 0)])
def test_bm25_against_a_plain_form(spark, k1, b):
    docs = bm25.documents(spark.createDataFrame(DOCS, "id int, content string"))
    q = "beta beta alpha nowhere"
    got = {r.id: r.score for r in bm25.scores(docs, bm25.one_query(spark, q), k1, b).collect()}
    want = plain_bm25(DOCS, q, 1.2 if k1 is None else k1, 0.75 if b is None else b)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_bm25_of_nothing(spark):
    docs = bm25.documents(spark.createDataFrame([], "id int, content string"))
    assert bm25.search(docs, bm25.one_query(spark, "beta")).count() == 0
    some = bm25.documents(spark.createDataFrame(DOCS, "id int, content string"))
    assert bm25.search(some, bm25.one_query(spark, "")).count() == 0
    assert bm25.search(some, bm25.one_query(spark, "beta"), 0).count() == 0


def seen_by_top_k(monkeypatch, module=bm25):
    """Numbers of the rows from which the best are taken."""
    seen, real = [], module.top_k
    monkeypatch.setattr(module, "top_k", lambda scored, *a, **b: (seen.append(scored.count()), real(scored, *a, **b))[1])
    return seen


@pytest.mark.parametrize("key", ["int", "string"])
@pytest.mark.parametrize("block", [1 << 16, 2])
def test_bm25_search_keeps_the_best_where_they_are_read(spark, monkeypatch, block, key):
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"]
    # many documents of the same words and length, whose scores tie, among others; some without a word
    texts = [" ".join(sorted(rng.choice(words, size=rng.integers(0, 4)).tolist())) if i % 3 else "alpha beta" for i in range(600)]
    rows = [(i if key == "int" else f"{i:05}", t) for i, t in enumerate(rng.permutation(texts).tolist())]
    docs = bm25.documents(spark.createDataFrame(rows, f"id {key}, content string").repartition(3))
    asked = [(1, "beta beta alpha nowhere"), (2, "gamma"), (3, "nowhere"), (4, ""), (5, "zeta alpha"), (6, None), (7, "zeta eta delta")]
    monkeypatch.setattr(bm25, "BLOCK", block)
    seen = seen_by_top_k(monkeypatch)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "90")
    try:
        got = {(r.query_id, r["rank"]): (r.id, round(r.score, 6)) for r in bm25.search(docs, spark.createDataFrame(asked, "query_id int, query string"), 7).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for q, text in asked:
        best = sorted(plain_bm25(rows, text or "").items(), key=lambda x: (-round(x[1], 9), x[0]))
        want |= {(q, i + 1): (x, round(s, 6)) for i, (x, s) in enumerate([x for x in best if x[1] > 0][:7])}
    assert got == want
    # no row a pair of query and document: a task sends the best of its own, and what ties with different sums
    assert seen[0] <= 4 * 7 * 3 * 2


def test_bm25_batch_sends_no_row_a_pair(spark, monkeypatch):
    from corpusmill.plans import registry

    seen = seen_by_top_k(monkeypatch)
    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    n = registry.QUERIES["bm25_batch"](spark, d).count()
    assert n <= seen[0] <= 2 * 4 * n


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id string, embedding array<float>, language string")


def test_vector_search_orders_filters_and_leaves_out(spark):
    e = lambda *x: [float(v) for v in x] + [0.0] * (8 - len(x))
    df = vectors(spark, [("a", e(1), "python"), ("b", e(0, 1), "python"), ("c", e(0, 1), "js"), ("short", [1.0, 0.0], "python"), ("none", None, "python"), ("hole", [None] * 8, "python"), ("zero", e(), "python")])
    q = spark.createDataFrame([(7, e(1))], "query_id bigint, vector array<float>")
    got = [(r.id, r.distance) for r in vector.search(df, q, 10).orderBy("rank").collect()]
    assert got == [("a", 0.0), ("zero", 1.0), ("b", 2.0), ("c", 2.0)]
    assert [r.id for r in vector.search(df, q, 10, where="language = 'js'").collect()] == ["c"]
    cos = [(r.id, r.similarity) for r in vector.search(df, q, 10, "cosine").orderBy("rank").collect()]
    assert [c[0] for c in cos] == ["a", "b", "c"]
    assert vector.search(df, q, 2).count() == 2
    assert vector.search(df.limit(0), q, 2).count() == 0


def test_vector_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5)).round(3)
    df = vectors(spark, [(f"{i:03}", v.tolist(), "x") for i, v in enumerate(x)])
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 60, 3)], "query_id bigint, vector array<float>")
    whole = sorted((r.query_id, r.rank, r.id) for r in vector.search(df, q, 4).collect())
    monkeypatch.setattr(vector, "BLOCK", 6)
    assert sorted((r.query_id, r.rank, r.id) for r in vector.search(df, q, 4).collect()) == whole


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_vector_search_sends_the_best_of_a_task(spark, monkeypatch, metric):
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, size=(600, 3)).astype(float)  # most vectors occur many times, so distances tie
    x[0] = 1.0
    names = [f"{i:03}" for i in rng.permutation(600)]
    df = vectors(spark, [(i, v.tolist(), "x") for i, v in zip(names, x)]).repartition(3)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 600, 50)], "query_id bigint, vector array<float>")
    seen = seen_by_top_k(monkeypatch, vector)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = {(r.query_id, r["rank"]): r.id for r in vector.search(df, q, 4, metric).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, norms = {}, np.linalg.norm(x, axis=1)
    for i in range(0, 600, 50):
        if metric == "cosine" and not norms[i]:
            continue
        far = ((x - x[i]) ** 2).sum(1) if metric == "l2" else -(x @ x[i]) / np.where(norms > 0, norms, np.nan) / norms[i]
        best = sorted((round(f, 9), n) for f, n in zip(far.tolist(), names) if f == f)[:4]
        want |= {(i, k + 1): n for k, (_, n) in enumerate(best)}
    assert got == want
    assert seen[0] <= 2 * 4 * 3 * 12  # not 4 a query and batch, nor all that tie


def test_hybrid_batch_makes_no_index(spark, monkeypatch):
    from corpusmill.operators.bm25_index import Index
    from corpusmill.plans import queries

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    monkeypatch.setattr(queries, "_KEPT", {})
    monkeypatch.setattr(Index, "build", lambda *a: pytest.fail("an index was made"))
    assert queries.hybrid_batch(spark, "/root/testdata/sf0.001").count()


def test_validate(spark):
    df = vectors(spark, [("a", [1.0, 2.0], "x"), ("b", [1.0], "x"), ("c", [1.0, float("nan")], "x"), ("d", None, "x")])
    assert [r.id for r in vector.validate(df, 2).collect()] == ["a"]


def test_embedding(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, ""), (4, "alpha beta")], "id int, content string")
    got = {r.id: r.embedding for r in embed.embed(df, dimension=16).collect()}
    assert got[2] is None and set(got[3]) == {0.0} and got[1] == got[4] and abs(sum(v * v for v in got[1]) - 1) < 1e-6
    with pytest.raises(ValueError):
        embed.provider("nowhere", 3)


def hits(spark, rows, score):
    return spark.createDataFrame([(0, i, float(s), k + 1) for k, (i, s) in enumerate(rows)], f"query_id bigint, id string, {score} double, rank int")


def test_fusion(spark):
    v = hits(spark, [("a", 0.0), ("b", 1.0), ("c", 2.0)], "distance")
    b = hits(spark, [("c", 4.0), ("d", 2.0)], "score")
    got = {r.id: (round(r.score, 6), r.search_types) for r in fusion.fuse(v, b).collect()}
    assert got == {"a": (0.6, ["vector"]), "c": (0.4, ["vector", "bm25"]), "b": (0.3, ["vector"]), "d": (0.0, ["bm25"])}
    raw = {r.id: round(r.vector_score, 6) for r in fusion.fuse(v, b, compat=True).collect()}
    assert raw["a"] == 0.0 and raw["c"] == 1.0
    one = fusion.fuse(v.limit(1), b.limit(0)).first()
    assert one.vector_score == 0.5 and one.rank == 1
    assert fusion.fuse(v.limit(0), b.limit(0)).count() == 0


def test_conflicts(spark):
    v = hits(spark, [(x, 10 - i) for i, x in enumerate("abcdefg")], "score")
    b = hits(spark, [(x, 20 - i) for i, x in enumerate("abcdgxy")], "score")
    got = {r.id: (r.conflict, r.vector_rank, r.bm25_rank) for r in rerank.conflicts(v, b).collect()}
    assert got == {"e": ("vector_high_bm25_low", 5, 7), "g": ("bm25_high_vector_low", 7, 5)}
    for query, e, g in (("how to", 1.0, 0.7), ("class", 0.7, 1.0), ("foo", 0.8, 0.8)):
        q = spark.createDataFrame([(0, query)], "query_id bigint, query string")
        out = {r.id: r for r in rerank.resolve(v, b, q).collect()}
        assert abs(out["e"].score - 6 * e) < 1e-9 and abs(out["g"].score - (4 + 16) / 2 * g) < 1e-9 and out["a"].search_type == "resolved"
    same = {r.id: r for r in rerank.resolve(v, v, q).collect()}
    assert same["a"].search_type == "combined" and not same["a"].resolved


NODES = "id string, type string, file_path string, line_number int"
EDGES = "source_id string, target_id string, relationship_type string, properties map<string,string>"


def test_rerank_features(spark):
    nodes = spark.createDataFrame([("c1", "Chunk", "f", 1), ("f::foo", "Function", "f", 1), ("f::bar", "Function", "f", 2), ("f::Foo", "Class", "f", 3), ("f", "File", "f", None)], NODES)
    edges = spark.createDataFrame([("f", "c1", "CONTAINS", None), ("f::foo", "c1", "DEFINED_IN", None), ("f::Foo", "c1", "DEFINED_IN", None), ("f::bar", "c1", "CALLS", None), ("c1", "f::foo", "CALLS", None), ("f::Foo", "c1", "INHERITS_FROM", None)], EDGES)
    chunks = spark.createDataFrame([("c1", "# doc\ncode")], "id string, content string")
    q = spark.createDataFrame([(0, "FOO")], "query_id bigint, query string")
    h = spark.createDataFrame([(0, "c1", 0.5)], "query_id bigint, id string, score double")
    f = rerank.features(h, chunks, nodes, edges, q).first()
    assert f.degree_centrality == 5 / 5 and f.query_function_matches == 1 and f.query_class_matches == 1
    assert f.function_depth == 2  # bar calls the chunk, the chunk calls foo
    assert f.call_frequency == 1 / 5 and f.inheritance_importance == 0 and f.documentation_score == 0.5
    loop = edges.union(spark.createDataFrame([("f::foo", "c1", "CALLS", None)], EDGES))
    assert rerank.features(h, chunks, nodes, loop, q).first().function_depth == 11
    g = rerank.graph_score(rerank.features(h, chunks, nodes, edges, q))
    s = (0.2 * 1 + 0.3 + 0.3 + 0.1 * 1 + 0.2 / 5 + 0.1 * 0 + 0.1 * 0.5) / 1.6
    out = rerank.rerank(h, g).first()
    assert abs(out.graph_score - s) < 1e-9 and abs(out.score - (0.6 * 0.5 + 0.4 * s)) < 1e-9
    low = rerank.rerank(h, g, threshold=0.99).first()
    assert abs(low.score - (0.8 * 0.5 + 0.2 * s)) < 1e-9
    e = rerank.enhance(h, nodes, edges).first()
    assert e.related_nodes == 5 and e.related_edges == 5 and [x.name for x in e.related_functions] == ["bar", "foo"]
    assert rerank.enhance(h, nodes.limit(0), edges.limit(0)).first().related_nodes == 0


def test_kept_index(spark, tmp_path):
    from corpusmill.operators.bm25_index import Index

    docs = lambda rows: bm25.documents(spark.createDataFrame(rows, "id int, content string"))
    q = "beta beta alpha nowhere"

    def agrees(index, rows):
        got = {r.id: r.score for r in index.scores(bm25.one_query(spark, q)).collect()}
        want = plain_bm25(rows, q)
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
        fresh = {r.token: (r.df, round(r.idf, 9)) for r in bm25.idf(docs(rows)).collect()}
        assert {r.token: (r.df, round(r.idf, 9)) for r in index.terms().collect()} == fresh
        assert index.stats().first()[:3] == bm25.vocabulary_stats(docs(rows)).first()[:3]

    path = str(tmp_path / "ix")
    index = Index(spark, path, buckets=3).build(docs(DOCS))
    agrees(index, DOCS)
    more = [(7, "beta gamma"), (8, None)]
    agrees(index.add(docs(more)), DOCS + more)
    changed = [(1, "omega alpha"), (8, "beta"), (9, "gamma gamma")]
    now = [r for r in DOCS + more if r[0] not in (1, 8)] + changed
    agrees(index.add(docs(changed)), now)
    agrees(Index(spark, path), now)  # opened anew
    left = [r for r in now if r[0] not in (6, 9)]
    agrees(index.remove(spark.createDataFrame([(6,), (9,), (77,)], "id int")), left)
    agrees(index.compact(), left)
    assert [r.id for r in index.search(bm25.one_query(spark, "omega"), 3).collect()] == [1]
    assert index.search(bm25.one_query(spark, "")).count() == 0 and index.search(bm25.one_query(spark, "nowhere")).count() == 0
    assert {r.token: r.df for r in index.document_frequency(["alpha", "nowhere"]).collect()} == {"alpha": 3, "nowhere": 0}
    assert Index(spark, str(tmp_path / "none")).search(bm25.one_query(spark, "beta")).count() == 0
    assert Index(spark, str(tmp_path / "empty")).build(docs(DOCS).limit(0)).search(bm25.one_query(spark, "beta")).count() == 0


def test_kept_index_asked_for_many_tokens(spark, tmp_path, monkeypatch):
    from corpusmill.operators import bm25_index

    docs = bm25.documents(spark.createDataFrame(DOCS, "id int, content string"))
    index = bm25_index.Index(spark, str(tmp_path / "ix")).build(docs)
    q = spark.createDataFrame([(i, t) for i, t in DOCS], "query_id int, query string")
    few = sorted(tuple(r) for r in index.search(q).select("query_id", "id", "rank").collect())
    monkeypatch.setattr(bm25_index, "ASKED", 3)
    assert sorted(tuple(r) for r in index.search(q).select("query_id", "id", "rank").collect()) == few
    monkeypatch.setattr(bm25_index, "ASKED", 20_000)
    monkeypatch.setattr(bm25_index, "NAMED", 1)
    assert few and sorted(tuple(r) for r in index.search(q).select("query_id", "id", "rank").collect()) == few


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_inverted_lists(spark, tmp_path, metric):
    from corpusmill.operators.ivf import IvfIndex

    rng = np.random.default_rng(3)
    middle = rng.normal(size=(20, 8)) * 4
    x = (middle[rng.integers(0, 20, 800)] + rng.normal(size=(800, 8))).round(3)
    rows = [(f"{i:03}", v.tolist(), "x") for i, v in enumerate(x)]
    df = vectors(spark, [*rows, ("none", None, "x"), ("short", [1.0], "x"), ("zero", [0.0] * 8, "x")])
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 800, 20)], "query_id bigint, vector array<float>")
    exact = {(r.query_id, r.id): r.rank for r in vector.search(vectors(spark, rows), q, 10, metric).collect()}
    index = IvfIndex(spark, str(tmp_path / metric)).build(df, 8, metric=metric)
    assert {(r.query_id, r.id): r.rank for r in index.search(q, 10, 10_000).collect()} == exact  # all lists opened
    again = IvfIndex(spark, str(tmp_path / metric))
    found = {(r.query_id, r.id) for r in again.search(q, 10, 5).collect()}
    assert again.state["rows"] == 800 and len(found & exact.keys()) >= 0.9 * len(exact)
    assert index.search(q.limit(0)).count() == 0
    assert IvfIndex(spark, str(tmp_path / "empty")).build(df.limit(0), 8).search(q).count() == 0
