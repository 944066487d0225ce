"""Reranking of hits: by features of the graph around them and of their content, and between two rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import text as fx
from corpusmill.operators import bm25, graph
from corpusmill.runtime import keep

#: Weights of the features.
WEIGHTS = {
    "degree_centrality": 0.2, "query_function_matches": 0.3, "query_class_matches": 0.3, "function_depth": 0.1, "class_hierarchy_depth": 0.1,
    "call_frequency": 0.2, "inheritance_importance": 0.2, "code_complexity": 0.1, "documentation_score": 0.1,
}
THRESHOLD = 0.5
#: The edges around a hit that are shown, and those that are weighed.
ASKED_TYPES = ("CALLS", "DEFINED_IN", "CONTAINS")
WEIGHED_TYPES = (*ASKED_TYPES, "HAS_METHOD")
TOP = 5


def enhance(hits: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Hits (query_id, id, ...) with related_nodes, related_edges and related_functions, from one hop around each.

    One pass over the edges for all hits. The hit itself counts among its related nodes if an edge touches it.
    """
    ids = hits.select("id").distinct()
    e = keep(graph.touching(graph.of_types(edges, ASKED_TYPES), ids))
    near = graph.ends(e, "start").join(nodes.select("id", "type", "file_path").distinct(), "id")
    name = fx.base_name(F.col("id"))
    by_node = near.groupBy("start").agg(F.count("*").alias("related_nodes"), F.sort_array(F.collect_set(F.when(F.col("type") == "Function", F.struct(name.alias("name"), "file_path")))).alias("related_functions"))
    by_edge = e.groupBy("start").agg(F.count("*").alias("related_edges"))
    context = by_edge.join(by_node, "start", "full_outer").withColumnRenamed("start", "id")
    none = F.array().cast("array<struct<name:string,file_path:string>>")
    return hits.join(context, "id", "left").withColumns({"related_nodes": F.coalesce("related_nodes", F.lit(0)), "related_edges": F.coalesce("related_edges", F.lit(0)), "related_functions": F.coalesce("related_functions", none)})


def features(hits: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, one column a feature) of hits (query_id, id).

    The graph of a hit is what one hop over CALLS, DEFINED_IN, CONTAINS and HAS_METHOD reaches. That is a star around the hit, so
    the longest chain of calls in it is known without recursion: 1 for a caller of the hit, 2 if the hit
    calls on, and 11, the bound of the recursion, if one of its callers is also called by it or it calls itself.
    """
    ids = hits.select("id").distinct()
    e = keep(graph.touching(graph.of_types(edges, WEIGHED_TYPES), ids))
    n = nodes.select("id", "type").distinct()
    near = keep(graph.ends(e, "start").join(n, "id"))
    n_nodes = near.groupBy("start").agg(F.count("*").alias("n_nodes"))
    degree = e.select("start", F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("start", "id").agg(F.count("*").alias("d")).groupBy("start").agg(F.max("d").alias("max_degree"))
    calls = e.where(F.col("relationship_type") == "CALLS")
    other = F.when(F.col("source_id") == F.col("start"), F.col("target_id")).otherwise(F.col("source_id"))
    arms = calls.withColumn("other", other).groupBy("start", "other").agg(F.max((F.col("source_id") == F.col("start")).cast("int")).alias("out"), F.max((F.col("target_id") == F.col("start")).cast("int")).alias("into"))
    arms = arms.join(n.select(F.col("id").alias("other"), "type"), "other", "left")
    shape = arms.groupBy("start").agg(
        F.max(F.when((F.col("other") != F.col("start")) & (F.col("type") == "Function"), F.col("into")).otherwise(0)).alias("called_by_function"),
        F.max("out").alias("calls_on"), F.max(F.col("out") * F.col("into")).alias("loops"), F.sum("into").alias("incoming"),
    )
    depth = F.when(F.col("called_by_function") == 1, F.when(F.col("loops") == 1, 11).otherwise(1 + F.col("calls_on"))).otherwise(0)
    by_graph = n_nodes.join(degree, "start", "left").join(shape, "start", "left").select(
        F.col("start").alias("id"), "n_nodes", F.try_divide(F.col("max_degree"), F.col("n_nodes")).alias("degree_centrality"),
        F.coalesce(depth, F.lit(0)).alias("function_depth"), F.try_divide(F.coalesce("incoming", F.lit(0)), F.col("n_nodes")).alias("call_frequency"),
    )
    asked = hits.join(queries.select("query_id", F.lower("query").alias("q")), "query_id")
    match = asked.join(near.select(F.col("start").alias("id"), F.col("id").alias("node"), "type"), "id").where(F.lower("node").contains(F.col("q")))
    counts = match.groupBy("query_id", "id").agg(F.count(F.when(F.col("type") == "Function", 1)).alias("query_function_matches"), F.count(F.when(F.col("type") == "Class", 1)).alias("query_class_matches"))
    content = chunks.join(ids, "id", "left_semi").select("id", fx.complexity(F.col("content")).alias("code_complexity"), fx.documentation(F.col("content")).alias("documentation_score"))
    out = hits.select("query_id", "id").join(by_graph, "id", "left").join(counts, ["query_id", "id"], "left").join(content, "id", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("double") for c in WEIGHTS if c not in ("class_hierarchy_depth", "inheritance_importance")}
    # inheritance is not among the edges asked for, so these two are 0 by construction
    return out.withColumns(zero).withColumns({"class_hierarchy_depth": F.lit(0.0), "inheritance_importance": F.lit(0.0)}).select("query_id", "id", *WEIGHTS)


def graph_score(f: DataFrame) -> DataFrame:
    """(query_id, id, graph_score): weighted mean of the features, each at most 1."""
    total = sum(WEIGHTS.values())
    score = sum((F.least(F.col(c), F.lit(1.0)) * w for c, w in WEIGHTS.items()), F.lit(0.0)) / total
    return f.select("query_id", "id", score.alias("graph_score"))


def rerank(hits: DataFrame, scores: DataFrame, k: int = 10, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, id, score, graph_score, rank): the graph weighs 0.4 where its score is above the threshold, else 0.2."""
    s, g = F.col("score"), F.coalesce("graph_score", F.lit(0.0))
    final = F.when(g > threshold, 0.6 * s + 0.4 * g).otherwise(0.8 * s + 0.2 * g)
    both = hits.select("query_id", "id", "score").join(scores, ["query_id", "id"], "left")
    return bm25.top_k(both.select("query_id", "id", final.alias("score"), g.alias("graph_score")), k)


# ---------------------------------------------------------------- conflicts


def conflicts(vector_hits: DataFrame, bm25_hits: DataFrame) -> DataFrame:
    """(query_id, id, conflict, vector_rank, bm25_rank): ids among the first five of one ranking but not of the other.

    Both inputs have (query_id, id, rank); a rank that is missing is the length of that ranking.
    """
    v, b = (h.select("query_id", "id", F.col("rank").alias(r)) for h, r in ((vector_hits, "vector_rank"), (bm25_hits, "bm25_rank")))
    both = v.join(b, ["query_id", "id"], "full_outer")
    w = Window.partitionBy("query_id")
    vn, bn = F.count("vector_rank").over(w), F.count("bm25_rank").over(w)
    in_v, in_b = F.coalesce(F.col("vector_rank") <= TOP, F.lit(False)), F.coalesce(F.col("bm25_rank") <= TOP, F.lit(False))
    kind = F.when(in_v & ~in_b, "vector_high_bm25_low").when(in_b & ~in_v, "bm25_high_vector_low")
    out = both.select("query_id", "id", kind.alias("conflict"), F.coalesce("vector_rank", vn).cast("bigint").alias("vector_rank"), F.coalesce("bm25_rank", bn).cast("bigint").alias("bm25_rank"))
    return out.where(F.col("conflict").isNotNull())


def resolve(vector_hits: DataFrame, bm25_hits: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, search_type, resolved, rank): mean of raw scores, times a factor where rankings conflict.

    The factor follows the type of the query: a semantic one trusts the vectors, a keyword one the words. Inputs have
    (query_id, id, score, rank). A query without any conflict gives plain means.
    """
    found = conflicts(vector_hits, bm25_hits).select("query_id", "id", "conflict")
    kind = queries.select("query_id", fx.query_type(F.col("query")).alias("query_type"))
    right = F.when(F.col("query_type") == "semantic", "vector_high_bm25_low").when(F.col("query_type") == "keyword", "bm25_high_vector_low")
    factor = F.when(F.col("query_type") == "mixed", 0.8).when(F.col("conflict") == right, 1.0).otherwise(0.7)
    weighed = found.join(kind, "query_id").select("query_id", "id", factor.alias("factor"))
    both = vector_hits.select("query_id", "id", "score").unionByName(bm25_hits.select("query_id", "id", "score"))
    mean = both.groupBy("query_id", "id").agg(F.avg("score").alias("mean")).join(weighed, ["query_id", "id"], "left")
    any_ = F.max(F.col("factor").isNotNull()).over(Window.partitionBy("query_id"))
    out = mean.select(
        "query_id", "id", (F.col("mean") * F.coalesce("factor", F.lit(1.0))).alias("score"),
        F.when(any_, "resolved").otherwise("combined").alias("search_type"), F.col("factor").isNotNull().alias("resolved"),
    )
    return bm25.top_k(out, k)
