"""Property graph over DataFrames: building, upserts and traversals.

Edges are never collected: traversals are semi joins of edges with the ids asked for, degrees and merges are
aggregates that combine on the map side. A node that a third of all edges touch meets them by broadcast, see
:func:`corpusmill.runtime.join_hot`. The step of `k_hop` joins all starts that reach a node with all its edges, which
is what it has to give; Spark's skew join splits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as fx
from corpusmill.operators.entities import entities
from corpusmill.runtime import cut, join_hot
from corpusmill.schemas import EDGE_TYPES

NODE_COLUMNS = ("id", "type", "properties", "file_path", "line_number")
EDGE_KEY = ("source_id", "target_id", "relationship_type")


# ---------------------------------------------------------------- building


def _map(**columns) -> Column:
    return F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))])


def build(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an indexed corpus: File, Chunk, Function and Class nodes, CONTAINS and DEFINED_IN edges.

    The first chunk of a file (by line, then id) speaks for its language and size. Of entities with one
    id the last stands: classes after functions, later lines after earlier ones.
    """
    order = F.struct(F.coalesce("start_line", F.lit(0)).alias("s"), F.col("id").alias("i"))
    files = chunks.groupBy("file_path").agg(F.min_by(F.struct("language", F.col("metadata.file_size").alias("size")), order).alias("f"))
    empty = F.lit("")
    file_nodes = files.select(
        F.col("file_path").alias("id"), F.lit("File").alias("type"),
        _map(language=F.coalesce("f.language", F.lit("unknown")), file_type=fx.graph_file_type(F.col("file_path")), file_size=F.coalesce("f.size", F.lit(0)), created_at=empty, updated_at=empty).alias("properties"),
        "file_path", F.lit(None).cast("int").alias("line_number"),
    )
    m = F.col("metadata")
    chunk_nodes = chunks.select(
        "id", F.lit("Chunk").alias("type"),
        _map(content=F.col("content"), start_line=F.col("start_line"), end_line=F.col("end_line"), language=F.col("language"), chunk_type=F.col("chunk_type"), file_size=F.coalesce(m["file_size"], F.lit(0)), chunk_index=F.coalesce(m["chunk_index"], F.lit(0)), ast_node_type=m["ast_node_type"]).alias("properties"),
        "file_path", F.col("start_line").alias("line_number"),
    )
    found = entities(chunks)
    last = found.groupBy("id").agg(F.max(F.struct(F.when(F.col("kind") == "Class", 1).otherwise(0).alias("c"), "line_number", "kind", "name", "file_path")).alias("e"))
    entity_nodes = last.select(
        "id", F.col("e.kind").alias("type"),
        _map(name=F.col("e.name"), qualified_name=F.col("id"), file_path=F.col("e.file_path"), line_number=F.col("e.line_number"), created_at=empty, updated_at=empty).alias("properties"),
        F.col("e.file_path").alias("file_path"), F.col("e.line_number").alias("line_number"),
    )
    nodes = file_nodes.unionByName(chunk_nodes).unionByName(entity_nodes)
    none = F.create_map().cast("map<string,string>").alias("properties")
    contains = chunks.select(F.col("file_path").alias("source_id"), F.col("id").alias("target_id"), F.lit("CONTAINS").alias("relationship_type"))
    defined = found.select(F.col("id").alias("source_id"), F.col("chunk_id").alias("target_id"), F.lit("DEFINED_IN").alias("relationship_type"))
    edges = contains.unionByName(defined).distinct().select("*", none)
    return nodes, edges


def edge(df: DataFrame, source: str, target: str, kind: str) -> DataFrame:
    """Edges of one type from two columns."""
    if kind not in EDGE_TYPES:
        raise ValueError(f"unknown relationship type: {kind}")
    none = F.create_map().cast("map<string,string>").alias("properties")
    return df.select(F.col(source).alias("source_id"), F.col(target).alias("target_id"), F.lit(kind).alias("relationship_type"), none).dropDuplicates(list(EDGE_KEY))


# ---------------------------------------------------------------- upserts


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes by id; a new node replaces the whole old one, of several new ones with one id the greatest stands."""
    both = old.select(*NODE_COLUMNS, F.lit(0).alias("turn")).unionByName(new.select(*NODE_COLUMNS, F.lit(1).alias("turn")))
    packed = both.select("id", F.struct("turn", "type", "file_path", "line_number", F.array_sort(F.map_entries("properties")).alias("p")).alias("row"))
    last = packed.groupBy("id").agg(F.max("row").alias("row"))
    return last.select("id", "row.type", F.map_from_entries("row.p").alias("properties"), "row.file_path", "row.line_number")


def upsert_edges(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Edges by source, target and type; properties are merged, a later value overriding an earlier one.

    Later means new over old, then ``order`` (a column of ``new``), then the greater value. Merging goes key by
    key, so an edge written a million times costs one row a property. Dangling ends are allowed.
    """
    rank = F.col(order) if order else F.lit(0)
    both = old.select(*EDGE_KEY, "properties", F.lit(0).alias("turn"), F.lit(0).cast("bigint").alias("at")).unionByName(new.select(*EDGE_KEY, "properties", F.lit(1).alias("turn"), rank.cast("bigint").alias("at")))
    pairs = both.select(*EDGE_KEY, "turn", "at", F.explode_outer("properties").alias("k", "v"))
    last = pairs.groupBy(*EDGE_KEY, "k").agg(F.max(F.struct("turn", "at", "v")).alias("w"))
    entries = F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", F.col("w.v").alias("v"))))
    return last.groupBy(*EDGE_KEY).agg(F.map_from_entries(F.array_sort(entries)).alias("properties"))


# ---------------------------------------------------------------- traversals


def of_types(edges: DataFrame, types: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """Distinct edges, of the given types."""
    e = edges if types is None else edges.where(F.col("relationship_type").isin(*types))
    return e.select(*EDGE_KEY).distinct()


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(start, source_id, target_id, relationship_type): edges with an end among ``ids`` (id), one row a start."""
    ids = ids.select("id").distinct()
    out = join_hot(edges.withColumn("id", F.col("source_id")), ids, "id")
    into = join_hot(edges.withColumn("id", F.col("target_id")), ids, "id")
    return out.unionByName(into).select(F.col("id").alias("start"), *EDGE_KEY).distinct()


def ends(edges: DataFrame, *keep: str) -> DataFrame:
    """(keep, id): both ends of edges, distinct."""
    return edges.select(*keep, F.explode(F.array("source_id", "target_id")).alias("id")).distinct()


def related(nodes: DataFrame, edges: DataFrame, ids: DataFrame, types=EDGE_TYPES) -> DataFrame:
    """(start, id, type): nodes one undirected hop from each start, the start included if any edge touches it.

    Ends without a node are left out; node types are not filtered.
    """
    near = ends(touching(of_types(edges, types), ids), "start")
    return join_hot(near, nodes.select("id", "type").distinct(), "id").select("start", "id", "type")


def out_edges(nodes: DataFrame, edges: DataFrame, kind: str, ids: DataFrame | None = None) -> DataFrame:
    """(id, target_id, target_type): where the edges of one type lead, one hop; targets without a node have a null type."""
    e = of_types(edges, (kind,))
    if ids is not None:
        e = join_hot(e, ids.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    n = nodes.select(F.col("id").alias("target_id"), F.col("type").alias("target_type"))
    return join_hot(e, n, "target_id", "left").select(F.col("source_id").alias("id"), "target_id", "target_type")


def dependencies(nodes: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """What functions call."""
    return out_edges(nodes, edges, "CALLS", ids)


def hierarchy(nodes: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """What classes inherit from."""
    return out_edges(nodes, edges, "INHERITS_FROM", ids)


def file_structure(nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files: edges that touch a file, and those that touch the chunks found there."""
    own = nodes.where(F.col("type") == "File").select("id") if files is None else files.select("id")
    e = of_types(edges)
    first = touching(e, own)
    chunks = ends(first, "start").join(nodes.where(F.col("type") == "Chunk").select("id"), "id", "left_semi")
    second = touching(e, chunks).select(F.col("start").alias("id"), *EDGE_KEY).join(chunks, "id").select("start", *EDGE_KEY)
    all_edges = first.union(second).distinct()
    return join_hot(ends(all_edges, "start"), nodes.select("id", "type").distinct(), "id"), all_edges


def file_chain(nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(file, level, id): what a file holds along CONTAINS, DEFINED_IN and HAS_METHOD, each once.

    Levels are File, Chunk, Function, Class and Method. A file without chunks gives nothing; a chunk without functions, or
    a class without methods, ends its branch.
    """
    e = of_types(edges, ("CONTAINS", "DEFINED_IN", "HAS_METHOD"))
    n = nodes.select("id", "type").distinct()
    of = lambda *types: n.where(F.col("type").isin(*types))
    own = of("File").select(F.col("id").alias("source_id"))
    if files is not None:
        own = own.join(files.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    kind = lambda k: e.where(F.col("relationship_type") == k).select("source_id", "target_id")
    chunks = join_hot(kind("CONTAINS"), own, "source_id", "left_semi").join(of("Chunk").select(F.col("id").alias("target_id")), "target_id", "left_semi")
    chunks = chunks.select(F.col("source_id").alias("file"), F.col("target_id").alias("chunk"))
    inside = join_hot(kind("DEFINED_IN").withColumn("id", F.col("source_id")), of("Function", "Class"), "id").select(F.col("target_id").alias("chunk"), "id", "type")
    found = chunks.join(inside, "chunk").select("file", F.col("type").alias("level"), "id").distinct()
    methods = join_hot(kind("HAS_METHOD").withColumn("id", F.col("target_id")), of("Function"), "id").select(F.col("source_id").alias("class"), F.col("id").alias("method"))
    below = found.where("level = 'Class'").join(methods, F.col("id") == F.col("class")).select("file", F.lit("Method").alias("level"), F.col("method").alias("id"))
    every = chunks.select("file", F.lit("Chunk").alias("level"), F.col("chunk").alias("id")).union(found).union(below)
    return every.union(chunks.select("file", F.lit("File").alias("level"), F.col("file").alias("id"))).distinct()


def details(nodes: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, type, in_degree, out_degree, neighbours): distinct neighbours without the node itself."""
    e = of_types(edges)
    n = nodes if ids is None else nodes.join(ids.select("id"), "id", "left_semi")
    both = e.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("target_id", "source_id", F.lit(0), F.lit(1)))
    degree = both.groupBy("id", "other").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    degree = degree.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.count(F.when(F.col("id") != F.col("other"), 1)).alias("n"))
    zero = F.lit(0)
    return n.select("id", "type").distinct().join(degree, "id", "left").select("id", "type", F.coalesce("i", zero).cast("bigint").alias("in_degree"), F.coalesce("o", zero).cast("bigint").alias("out_degree"), F.coalesce("n", zero).cast("bigint").alias("neighbours"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): ends of distinct edges at each node, a loop counting twice."""
    return of_types(edges).select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def k_hop(edges: DataFrame, ids: DataFrame, hops: int, types=None, directed: bool = True) -> DataFrame:
    """(start, id, depth): everything within ``hops`` of each start, with the least depth.

    Breadth first; a node once reached is not expanded again, so cycles end. Each round is cut.
    """
    e = of_types(edges, types).select("source_id", "target_id")
    if not directed:
        e = e.union(e.select("target_id", "source_id")).distinct()
    e = cut(e.select(F.col("source_id").alias("id"), F.col("target_id").alias("next")))
    front = cut(ids.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct())
    fronts = [front]
    for depth in range(1, hops + 1):
        step = front.select("start", "id").join(e, "id").select("start", F.col("next").alias("id")).distinct()
        for seen in fronts:
            step = step.join(seen.select("start", "id"), ["start", "id"], "left_anti")
        front = cut(step.withColumn("depth", F.lit(depth)))
        if not front.limit(1).count():
            break
        fronts.append(front)
    out = fronts[0]
    for f in fronts[1:]:
        out = out.unionByName(f)
    return out


def longest_path(edges: DataFrame, kind: str, most: int = 10) -> DataFrame:
    """(id, depth): length of the longest path along one type from each node with such an edge, ``most`` + 1 on a cycle.

    Bounded relaxation: after round d a node has min(d, longest path); nothing but (id, depth) is carried.
    """
    e = cut(of_types(edges, (kind,)).select("source_id", "target_id"))
    depth = e.select(F.col("source_id").alias("id")).distinct().withColumn("depth", F.lit(1))
    for _ in range(most):
        below = e.join(depth.select(F.col("id").alias("target_id"), "depth"), "target_id", "left")
        new = cut(below.groupBy("source_id").agg((F.max(F.coalesce("depth", F.lit(0))) + 1).alias("depth")).select(F.col("source_id").alias("id"), "depth"))
        if not new.exceptAll(depth).limit(1).count():
            return new
        depth = new
    return depth


def text_contains(chunks: DataFrame, text: str, limit: int | None = 10, case_sensitive: bool = False, order: tuple[str, ...] = ("file_path", "start_line", "id")) -> DataFrame:
    """Chunks whose content holds a text, in a fixed order; no limit if None, none at a limit below 1."""
    c = F.col("content") if case_sensitive else F.lower("content")
    hit = chunks.where(c.contains(text if case_sensitive else text.lower()))
    return hit if limit is None else hit.orderBy(*order).limit(max(limit, 0))


# ---------------------------------------------------------------- statistics, deletion


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, type, count): nodes and edges by type, with totals in rows of a null type."""
    n = nodes.select(F.lit("node").alias("kind"), F.col("type"), F.col("id")).distinct().select("kind", "type")
    e = of_types(edges).select(F.lit("edge").alias("kind"), F.col("relationship_type").alias("type"))
    both = n.union(e)
    return both.rollup("kind", "type").agg(F.count("*").alias("count"), F.grouping_id().alias("g")).where("g <= 1").select("kind", "type", "count")


def below_prefix(nodes: DataFrame, prefix: str) -> DataFrame:
    """(id): the nodes of paths that begin with ``prefix``."""
    return nodes.where(F.coalesce(F.coalesce("file_path", "id").startswith(prefix) | F.col("id").startswith(prefix), F.lit(False))).select("id").distinct()


def without_prefix(nodes: DataFrame, edges: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes of paths that begin with ``prefix`` and without their edges."""
    gone = below_prefix(nodes, prefix)
    kept = nodes.join(gone, "id", "left_anti")
    left = edges.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    return kept, left.join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti")


def tree_lines(edges: DataFrame, root: str, kind: str = "INHERITS_FROM", most: int = 11) -> list[str]:
    """A hierarchy below ``root`` as indented lines, children first by name; at most ``most`` levels deep."""
    ids = edges.sparkSession.createDataFrame([(root,)], "id string")
    turned = edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "relationship_type")
    near = k_hop(turned, ids, most, (kind,)).select("id")
    pairs = of_types(turned, (kind,)).join(near.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    below: dict[str, list[str]] = {}
    for r in pairs.collect():
        below.setdefault(r.source_id, []).append(r.target_id)
    out: list[str] = []

    def walk(at: str, level: int, path: tuple[str, ...]) -> None:
        out.append("  " * level + at)
        if level < most:
            for child in sorted(below.get(at, [])):
                if child not in path:
                    walk(child, level + 1, (*path, child))

    walk(root, 0, (root,))
    return out
