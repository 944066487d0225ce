"""Weighted fusion of vector and keyword hits into one ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.operators import bm25, vector

VECTOR_WEIGHT, BM25_WEIGHT = 0.6, 0.4


def normalised(score: Column) -> Column:
    """Min-max over the hits of a query; 0.5 each where all scores are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, F.lit(0.5)).otherwise((score - low) / F.nullif(high - low, F.lit(0.0)))


def fuse(vector_hits: DataFrame, bm25_hits: DataFrame, k: int = 10, vector_weight: float = VECTOR_WEIGHT, bm25_weight: float = BM25_WEIGHT, compat: bool = False) -> DataFrame:
    """(query_id, id, score, vector_score, bm25_score, search_types, rank) of the k best by weighted sum.

    ``vector_hits`` has (query_id, id, distance), ``bm25_hits`` (query_id, id, score). A side that has no hit for an
    id counts 0. Nearer is better: distances are normalised with their sign turned; ``compat`` keeps the raw
    distance as a score, by which the nearest hit gets 0. Each side holds at most its own k rows a query.
    """
    nearness = F.col("distance") if compat else -F.col("distance")
    v = vector_hits.select("query_id", "id", normalised(nearness).alias("v"))
    b = bm25_hits.select("query_id", "id", normalised(F.col("score")).alias("b"))
    both = v.join(b, ["query_id", "id"], "full_outer")
    types = F.filter(F.array(F.when(F.col("v").isNotNull(), F.lit("vector")), F.when(F.col("b").isNotNull(), F.lit("bm25"))), lambda x: x.isNotNull())
    v0, b0 = F.coalesce("v", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    out = both.select("query_id", "id", (vector_weight * v0 + bm25_weight * b0).alias("score"), v0.alias("vector_score"), b0.alias("bm25_score"), types.alias("search_types"))
    return bm25.top_k(out, k)


def hybrid(chunks: DataFrame, queries: DataFrame, k: int = 10, vector_weight: float = VECTOR_WEIGHT, bm25_weight: float = BM25_WEIGHT, where=None, compat: bool = False, k1: float | None = None, b: float | None = None) -> DataFrame:
    """Fused hits of queries (query_id, query, vector) over chunks (id, content, embedding).

    A query without tokens, or without a vector, is answered by its other side alone. ``where`` restricts the
    vector side before scoring.
    """
    by_vector = vector.search(chunks, queries.select("query_id", "vector"), k, where=where)
    by_words = bm25.search(bm25.documents(chunks), queries.select("query_id", "query"), k, k1, b)
    return fuse(by_vector, by_words, k, vector_weight, bm25_weight, compat)


def with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the columns of their chunks; content is read for the hits only, after the limit."""
    return hits.join(chunks, "id", "left")
