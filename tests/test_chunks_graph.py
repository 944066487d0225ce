from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.api import Engine, search_in_file
from corpusmill.config import Config
from corpusmill.operators import chunking, entities, graph
from corpusmill.schemas import CHUNKS, EDGES, FILES, NODES
from corpusmill.sources import scan, store

PY = "\ndef hello_world():\n    \"\"\"Say hello.\"\"\"\n    print('Hello')\n    return 1\n\nclass TestClass:\n    \"\"\"Doc.\"\"\"\n\n    def __init__(self):\n        self.n = 'x'\n\n    def greet(self):\n        return self.n\n\n    def calculate(self, a, b):\n        c = a + b\n        return c\n\ndef main():\n    t = TestClass()\n    t.greet()\n    return t\n"


def files(spark, *rows):
    return spark.createDataFrame([(p, "/" + p, "code", lang, len(c or ""), 0.0, c) for p, lang, c in rows], FILES)


def test_syntax_chunks(spark):
    f = files(spark, ("test_file.py", "python", PY), ("broken.py", "python", "def broken("), ("none.py", "python", None), ("empty.py", "python", ""), ("x.js", "javascript", "function f() {}"), ("null.py", None, "def f(): pass"))
    got = [(r.file_path, r.chunk_type, r.start_line, r.end_line, r.metadata.chunk_index) for r in chunking.syntax_chunks(f).collect()]
    assert got == [("test_file.py", k, a, b, i) for i, (k, a, b) in enumerate([("function_definition", 2, 5), ("class_definition", 7, 18), ("function_definition", 10, 11), ("function_definition", 13, 14), ("function_definition", 16, 18), ("function_definition", 20, 23)])]
    ids = {r.id for r in chunking.syntax_chunks(f).collect()}
    assert "785e88e41a66175d2d7101c28e911ad8" in ids and "9705f90c2efa5c1073cb27ab3eb6e223" in ids


def test_line_chunks(spark):
    f = files(spark, ("a.py", "python", "\n".join(map(str, range(45)))), ("b.py", "python", ""))
    got = sorted((r.start_line, r.end_line, r.content.split("\n")[0]) for r in chunking.line_chunks(f).collect())
    assert got == [(1, 20, "0"), (21, 40, "20"), (41, 45, "40")]


@pytest.mark.parametrize("text", ["", "word " * 900, "x" * 2500, "\n\n".join("para %d " % i * 30 for i in range(30)), "a,b.c\td" * 400])
def test_split_text(text):
    parts = chunking.split_text(text, 300, 60)
    assert all(0 < len(p) <= 300 for p in parts)
    assert "".join(text.split()) == "" or set("".join(parts)) >= set("".join(text.split()))
    assert all(p in text for p in parts)


def test_entities(spark):
    rows = [("1", "a.py", "def f(x):\nclass A(B):\n  async def g(self):\nx = 1", 10, "python"), ("2", "a.js", "function h() {\nconst q = 1\nk: function (a) {\nm => m\nclass C {", 1, "javascript"), ("3", "a.go", "func run() {\ntype T struct {\nfunc (r *T) m() {", 1, "go"), ("4", "a.rb", "def nope(", 1, "ruby"), ("5", "a.py", None, 1, "python"), ("6", "a.java", "public static int size() {\nclass D {", 1, "java"), ("7", "a.cpp", "int add(int a) {\nclass E {", None, "cpp")]
    df = spark.createDataFrame(rows, "id string, file_path string, content string, start_line int, language string")
    got = sorted((r.chunk_id, r.kind, r.name, r.line_number) for r in entities.entities(df).collect())
    assert got == sorted([("1", "Function", "f", 10), ("1", "Class", "A", 11), ("1", "Function", "g", 12), ("2", "Function", "h", 1), ("2", "Function", "k", 3), ("2", "Function", "m", 4), ("2", "Class", "C", 5), ("3", "Function", "run", 1), ("3", "Class", "T", 2), ("6", "Function", "size", 1), ("6", "Class", "D", 2), ("7", "Function", "add", 1), ("7", "Class", "E", 2)])


def nodes(spark, *rows):
    return spark.createDataFrame([(i, t, {"k": i}, "f", 1) for i, t in rows], NODES)


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, t, p) for a, b, t, p in rows], EDGES)


def test_upserts(spark):
    old = nodes(spark, ("a", "File"), ("b", "Class"))
    new = spark.createDataFrame([("b", "Function", {"z": "1"}, "g", 2)], NODES)
    got = {r.id: (r.type, r.properties) for r in graph.upsert_nodes(old, new).collect()}
    assert got == {"a": ("File", {"k": "a"}), "b": ("Function", {"z": "1"})}
    twice = graph.upsert_nodes(graph.upsert_nodes(old, new), new)
    assert {r.id: (r.type, r.properties) for r in twice.collect()} == got
    e = graph.upsert_edges(edges(spark, ("a", "b", "CALLS", {"x": "1", "y": "1"})), edges(spark, ("a", "b", "CALLS", {"y": "2", "z": "3"}), ("a", "b", "CONTAINS", None), ("q", "nowhere", "CALLS", {})))
    assert {(r.source_id, r.relationship_type): r.properties for r in e.collect()} == {("a", "CALLS"): {"x": "1", "y": "2", "z": "3"}, ("a", "CONTAINS"): {}, ("q", "CALLS"): {}}
    with pytest.raises(ValueError):
        graph.edge(old, "id", "id", "LIKES")


def test_traversals(spark):
    n = nodes(spark, ("f", "File"), ("c", "Chunk"), ("g", "Function"), ("h", "Function"), ("K", "Class"), ("P", "Class"), ("lonely", "Function"))
    e = edges(spark, ("f", "c", "CONTAINS", None), ("g", "c", "DEFINED_IN", None), ("g", "h", "CALLS", None), ("h", "g", "CALLS", None), ("g", "h", "CALLS", {"again": "1"}), ("K", "P", "INHERITS_FROM", None), ("P", "outside", "INHERITS_FROM", None))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert {r.id for r in graph.related(n, e, ids("c")).collect()} == {"c", "f", "g"}
    assert graph.related(n, e, ids("lonely")).count() == 0
    assert [(r.id, r.target_id, r.target_type) for r in graph.dependencies(n, e, ids("g")).collect()] == [("g", "h", "Function")]
    assert {(r.id, r.target_type) for r in graph.hierarchy(n, e).collect()} == {("K", "Class"), ("P", None)}
    found, own = graph.file_structure(n, e)
    assert {r.id for r in found.collect()} == {"f", "c", "g"} and own.count() == 2
    methods = edges(spark, ("K", "c", "DEFINED_IN", None), ("K", "h", "HAS_METHOD", None), ("K", "gone", "HAS_METHOD", None))
    assert {(r.file, r.level, r.id) for r in graph.file_chain(n, e.union(methods)).collect()} == {("f", "File", "f"), ("f", "Chunk", "c"), ("f", "Function", "g"), ("f", "Class", "K"), ("f", "Method", "h")}
    assert graph.file_chain(n, e, ids("nowhere")).count() == 0
    d = {r.id: (r.in_degree, r.out_degree, r.neighbours) for r in graph.details(n, e).collect()}
    assert d["g"] == (1, 2, 2) and d["lonely"] == (0, 0, 0) and d["P"] == (1, 1, 2)
    hop = {r.id: r.depth for r in graph.k_hop(e, ids("g"), 9, ("CALLS",)).collect()}
    assert hop == {"g": 0, "h": 1}
    assert {r.id: r.depth for r in graph.longest_path(e, "CALLS").collect()} == {"g": 11, "h": 11}
    assert {r.id: r.depth for r in graph.longest_path(e, "INHERITS_FROM").collect()} == {"K": 2, "P": 1}
    s = {(r.kind, r.type): r["count"] for r in graph.stats(n, e).collect()}
    assert s[("node", None)] == 7 and s[("edge", "CALLS")] == 2 and s[("edge", None)] == 6
    assert graph.tree_lines(e, "P") == ["P", "  K"]
    kept, left = graph.without_prefix(n.withColumn("file_path", F.col("id")), e, "g")
    assert kept.count() == 6 and left.count() == 3
    empty = n.limit(0), e.limit(0)
    assert graph.details(*empty).count() == 0 and graph.stats(*empty).count() == 0


def test_text_search(spark):
    c = spark.createDataFrame([("1", "f", "Hello World", 1), ("2", "f", "Goodbye", 2), ("3", "f", None, 3)], "id string, file_path string, content string, start_line int")
    assert [r.id for r in graph.text_contains(c, "hello").collect()] == ["1"]
    assert graph.text_contains(c, "hello", case_sensitive=True).count() == 0 and graph.text_contains(c, "o", 0).count() == 0
    assert [(r.id, r.search_type) for r in search_in_file(c, "f").orderBy("rank").collect()] == [("1", "file"), ("2", "file"), ("3", "file")]
    assert [(r.id, r.search_type) for r in search_in_file(c, "f", "GOOD").collect()] == [("2", "file_query")]


def test_scan_and_engine(spark, tmp_path):
    root = tmp_path / "code"
    for name, body in (("__init__.py", b""), ("pkg/test_file.py", PY.encode()), ("pkg/_x/b.py", b"def b():\n    return 'a\xff'\n"), ("node_modules/x.js", b"x"), ("data.xyz", b"x"), ("README.md", b"# hi"), ("big.py", b"#" * 600)):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    found = scan.scan(spark, str(root), Config(max_file_size=599))
    assert {r.path for r in found.collect()} == {"__init__.py", "pkg/test_file.py", "pkg/_x/b.py", "README.md"}
    loaded = {r.path: r.content for r in scan.load_content(found).collect()}
    assert set(loaded) == {"pkg/test_file.py", "pkg/_x/b.py", "README.md"} and "'a'" in loaded["pkg/_x/b.py"]

    e = Engine(spark, str(tmp_path / "store"), Config(embedding_dimension=32, chunk_fallback="none", store_buckets=3))
    assert e.index_codebase(str(root))["chunks"] == 7
    e.index_codebase(str(root))  # again: nothing doubles
    assert e.chunks.count() == 7
    hits = e.search("greet hello", 5).collect()
    assert hits and [h.rank for h in hits] == list(range(1, len(hits) + 1)) and all(h.content for h in hits)
    assert e.search("greet", 3, use_graph=False).count() == 3
    s = e.stats()
    assert s["vectors"] == 7 and s["bm25"]["documents"] == 7
    assert e.file_structure("pkg/test_file.py")[0].count() > 6
    assert e.files().count() == 2
    assert e.chunks.by_file("pkg/_x/b.py").count() == 1 and e.chunks.by_id("nope").count() == 0
    before = e.clear_index("pkg/_x/")
    assert before["vectors_before"] == 7 and before["vectors_after"] == 6 and before["nodes_after"] < before["nodes_before"]
    e.clear()
    assert e.chunks.count() == 0 and e.graph.nodes().count() == 0


def test_store_rejects_and_exports(spark, tmp_path):
    st = store.ChunkStore(spark, str(tmp_path / "c"), 2)
    assert st.count() == 0 and st.insert(spark.createDataFrame([], CHUNKS)) == 0
    bad = spark.createDataFrame([("1", "f", "x", 1, 2, "py", "k", None, [1.0])], CHUNKS)
    with pytest.raises(ValueError):
        st.insert(bad)
    n, e = nodes(spark, ("a", "File")), edges(spark, ("a", "b", "CALLS", {"x": "1"}))
    store.write_graph_json(n, e, str(tmp_path / "g.json"))
    first = json.loads((tmp_path / "g.json").read_text())["metadata"]["created_at"]
    store.write_graph_json(n, e, str(tmp_path / "g.json"))
    assert json.loads((tmp_path / "g.json").read_text())["metadata"]["created_at"] == first
    n2, e2 = store.read_graph_json(spark, str(tmp_path / "g.json"))
    assert n2.collect() == n.collect() and e2.collect() == e.collect()
    assert store.read_graph_json(spark, str(tmp_path / "none.json"))[0].count() == 0


def test_config(monkeypatch):
    monkeypatch.setenv("BM25_K1", "2.5")
    assert Config.from_env().bm25_k1 == 2.5 and Config.from_env(bm25_k1=0).bm25_k1 == 0 and Config.from_env(top_k=3).top_k == 3


JS = """import {x} from "y";
class A extends B {
  constructor(a, {b, c} = {}) {
    if (a) { this.b = b; }
  }
  async get(id) { return `}${id}`; }
}
function plain(a) { return /[}]/.test(a); }
const o = {
  go(a, b) {
    use(a);
  },
};
"""
C = """#define M(a) do { a; } while (0)
static int add(int a, int b)
{
    if (a) { return b; } /* } */
    return a + b;
}
struct P { int x; };
int table[] = {1, 2};
int main(void) { char *s = "}{"; return 0; }
"""


def test_outline_of_brace_languages(spark):
    from corpusmill.operators import outline

    assert outline.blocks(JS, "javascript") == [("method_definition", 3, 5), ("method_definition", 6, 6), ("method_definition", 10, 12)]
    assert outline.blocks(C, "c") == [("function_definition", 2, 6), ("function_definition", 9, 9)]
    assert outline.blocks("namespace n {\nclass K {\npublic:\n  K(int a) : x(a) { }\n  int get() const { return x; }\n};\n}\n", "cpp") == [("function_definition", 4, 4), ("function_definition", 5, 5)]
    assert outline.blocks("class A { m() {", "javascript") == [] and outline.blocks("", "c") == []
    made = spark.createDataFrame([("a.js", JS, "javascript", 1, "code"), ("b.c", C, "c", 1, "code"), ("c.go", "package x\n", "go", 1, "code"), ("d.js", None, "javascript", 1, "code")], "path string, content string, language string, size bigint, file_type string")
    got = {(r.file_path, r.start_line, r.end_line, r.chunk_type) for r in chunking.syntax_chunks(made).collect()}
    assert got == {("a.js", 3, 5, "method_definition"), ("a.js", 6, 6, "method_definition"), ("a.js", 10, 12, "method_definition"), ("b.c", 2, 6, "function_definition"), ("b.c", 9, 9, "function_definition")}
    every = {(r.file_path, r.chunk_type) for r in chunking.chunks(made).collect()}
    assert ("c.go", "text_chunk") in every and ("a.js", "method_definition") in every and not any(p == "d.js" for p, _ in every)
    assert {r.chunk_type for r in chunking.chunks(made, "line").where("file_path = 'c.go'").collect()} == {"line_chunk"}
    with pytest.raises(ValueError):
        chunking.chunks(made, "page")


def chunk_rows(spark, *rows):
    return spark.createDataFrame([(i, p, "x", 1, 2, "python", kind, None, None) for i, p, kind in rows], CHUNKS)


def test_chunk_store_changes_in_part(spark, tmp_path, monkeypatch):
    st = store.ChunkStore(spark, str(tmp_path / "c"), buckets=8)
    st.insert(chunk_rows(spark, ("1", "a.py", "f"), ("2", "a.py", "f"), ("3", "b.py", "f"), ("4", None, "f"), ("5", "a/x.py", "f")))
    first = st.table.versions.current()["where"]
    st.insert(chunk_rows(spark, ("1", "a.py", "g"), ("6", "a.py", "g")))
    now = st.table.versions.current()["where"]
    assert sum(first[k] != now[k] for k in first) == 1  # only the bucket of a.py was written again
    assert {r.id: r.chunk_type for r in st.read().collect()} == {"1": "g", "2": "f", "3": "f", "4": "f", "5": "f", "6": "g"}
    st.replace_files(spark.createDataFrame([("a.py",)], "path string"), chunk_rows(spark, ("1", "a.py", "h"), ("7", "a.py", "h")))
    assert {r.id: r.chunk_type for r in st.read().collect()} == {"1": "h", "3": "f", "4": "f", "5": "f", "7": "h"}
    st.delete_file("b.py")
    assert st.delete_prefix("a/") == (4, 3)
    assert {r.id for r in st.read().collect()} == {"1", "4", "7"}  # a chunk without a path stays

    # a failure before the manifest leaves the old state, one that another change overtakes is an error
    monkeypatch.setattr(st.table.versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        st.insert(chunk_rows(spark, ("8", "a.py", "f")))
    again = store.ChunkStore(spark, str(tmp_path / "c"))
    assert {r.id for r in again.read().collect()} == {"1", "4", "7"} and again.table.buckets == 8
    stale = again.table.versions.current()
    again.insert(chunk_rows(spark, ("9", "a.py", "f")))
    with pytest.raises(RuntimeError):
        again.table.versions.commit({"where": {}}, stale)
    assert again.count() == 4


def test_reindexing_drops_what_a_file_no_longer_holds(spark, tmp_path):
    one = lambda *rows: spark.createDataFrame([(p, c, "python", len(c), "code") for p, c in rows], "path string, content string, language string, size bigint, file_type string")
    e = Engine(spark, str(tmp_path / "s"), Config(embedding_dimension=16, store_buckets=2, ivf_lists=2, log_file=str(tmp_path / "log" / "x.log")))
    e.index_files(one(("a.py", "def old():\n    pass\n\n\ndef kept():\n    pass\n"), ("b.py", "def other():\n    old()\n")))
    e.index_files(one(("a.py", "x = 1\n\n\ndef kept():\n    pass\n")))
    assert {r.file_path: r.n for r in e.chunks.read().groupBy("file_path").agg(F.count("*").alias("n")).collect()} == {"a.py": 1, "b.py": 1}
    assert not e.graph.nodes().where("id = 'a.py::old'").count() and e.graph.nodes().where("id = 'b.py::other'").count() == 1
    assert e.graph.edges().where("source_id = 'a.py'").count() == 1
    assert e.stats()["bm25"]["documents"] == 2 and e.stats()["vectors"] == 2
    own, at, near = e.node("b.py")
    assert own.count() == 1 and at.count() == 1 and near.count() == 1 and e.node("nowhere")[0].count() == 0
    chunk = e.chunks.by_file("b.py").first().id
    assert {r.id for r in e.related_chunks(chunk).collect()} == {chunk, "b.py", "b.py::other"} == {r.id for r in e.related_chunks("b.py", hops=2).collect()}
    assert e.graph_data()[0].count() == 6
    e.build_lists()
    assert [h.file_path for h in e.search("other", 1).collect()] == ["b.py"]
    assert (tmp_path / "log" / "x.log").read_text().count("indexed") == 2
    e.delete_file("b.py")
    assert e.chunks.count() == 1 and e.graph.nodes().where("file_path = 'b.py'").count() == 0 and e.stats()["bm25"]["documents"] == 1


def test_embedding_providers(spark):
    from corpusmill.operators import embed

    class Letters:
        def __init__(self, dimension, **settings):
            self.dimension = dimension

        def embed(self, texts):
            return [[float(len(t))] * self.dimension for t in texts]

    embed.register("letters", Letters, needs_key=True)
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, content string")
    with pytest.raises(ValueError):
        embed.embed(df, name="letters", dimension=2)
    assert {r.id: r.embedding for r in embed.embed(df, name="letters", dimension=2, api_key="k").collect()} == {1: [3.0, 3.0], 2: None}
    del embed.PROVIDERS["letters"]


def test_one_node_with_a_third_of_all_edges(spark, monkeypatch):
    from corpusmill import runtime

    n = nodes(spark, ("hub", "Class"), *[(f"x{i:03}", "Function") for i in range(90)])
    e = edges(spark, *[(f"x{i:03}", "hub", "CALLS", None) for i in range(45)], *[(f"x{i:03}", f"x{i + 1:03}", "CALLS", None) for i in range(89)], ("x000", "gone", "CALLS", None))
    ask = lambda: [
        sorted(map(tuple, df.collect()), key=repr)
        for df in (graph.related(n, e, n.select("id")), graph.dependencies(n, e), graph.dependencies(n, e, n.select("id").limit(40)), graph.k_hop(e, n.select("id"), 3), graph.touching(graph.of_types(e), n.select("id")))
    ]
    plain = ask()
    monkeypatch.setattr(runtime, "HOT_BYTES", 0)
    monkeypatch.setattr(runtime, "HOT_ROWS", 20)
    assert ask() == plain
    assert len(runtime.join_hot(e, n.select(F.col("id").alias("target_id")), "target_id", "left_anti").collect()) == 1
