"""The engine as one object: index a corpus, search it, ask its graph, keep it clean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import log
from corpusmill.config import Config
from corpusmill.functions import text as fx
from corpusmill.operators import bm25, chunking, embed, fusion, graph, rerank, vector
from corpusmill.operators.bm25_index import Index
from corpusmill.operators.ivf import IvfIndex
from corpusmill.runtime import keep
from corpusmill.schemas import EDGE_TYPES
from corpusmill.sources import scan, store


class Engine:
    """Chunks, keyword index, vector lists and graph of one corpus below a folder."""

    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None):
        self.spark, self.config, self.folder = spark, config or Config(), folder.rstrip("/")
        c = self.config
        log.setup(c.log_level, c.log_file)
        self.chunks = store.ChunkStore(spark, f"{self.folder}/{c.collection_name}", c.embedding_dimension, c.store_buckets)
        self.graph = store.GraphStore(spark, f"{self.folder}/graph", c.store_buckets)
        self._settings = {"model": c.embedding_model, "host": c.embedding_host, "api_key": c.embedding_api_key}

    # ---- indexing

    def index_files(self, files: DataFrame) -> dict[str, int]:
        """Chunk, embed and store files (path, language, size, file_type, content); a file indexed again is replaced.

        Files that are not among these stay as they are. Contents are read once, chunks cut and embedded once.
        """
        c = self.config
        files = keep(files)
        cut = chunking.chunks(files, c.chunk_fallback, c.chunk_size, c.chunk_overlap)
        cut = keep(embed.embed(cut, name=c.embedding_provider, dimension=c.embedding_dimension, **self._settings))
        paths = files.select("path").distinct()
        old = keep(self.chunks.read().join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select("id"))
        n = self.chunks.replace_files(paths, cut)
        self.graph.replace_files(paths, *graph.build(cut))
        words = self.words()
        if words.state.get("segments"):
            words.remove(old.join(cut.select("id"), "id", "left_anti"))
        words.add(bm25.documents(cut))
        out = {"files": files.count(), "chunks": n}
        log.logger.info("indexed %(files)d files as %(chunks)d chunks", out)
        return out

    def index_codebase(self, root: str | None = None) -> dict[str, int]:
        return self.index_files(scan.load_content(scan.scan(self.spark, root or self.config.codebase_root, self.config)))

    def words(self) -> Index:
        """The kept keyword index."""
        return Index(self.spark, f"{self.folder}/words", self.config.store_buckets)

    def lists(self) -> IvfIndex:
        """The inverted vector lists, as :meth:`build_lists` last made them."""
        return IvfIndex(self.spark, f"{self.folder}/lists")

    def build_lists(self) -> None:
        """Make the inverted lists of all vectors anew; searches use them where ``ivf_lists`` is set."""
        self.lists().build(self.chunks.read(), self.config.embedding_dimension, self.config.ivf_lists)

    # ---- search

    def _queries(self, query: str) -> DataFrame:
        p = embed.provider(self.config.embedding_provider, self.config.embedding_dimension, **self._settings)
        return self.spark.createDataFrame([(0, query, p.embed([query])[0])], "query_id bigint, query string, vector array<float>")

    def search(self, query: str, top_k: int | None = None, use_graph: bool = True, use_reranking: bool = True) -> DataFrame:
        """Hits with their chunk, score and rank, and with the graph around them."""
        c = self.config
        k = c.top_k if top_k is None else top_k
        chunks, queries = self.chunks.read(), self._queries(query)
        lists = self.lists() if c.ivf_lists else None
        if lists is not None and lists.state:
            by_vector = lists.search(queries.select("query_id", "vector"), k, c.ivf_probes)
        else:
            by_vector = vector.search(chunks, queries.select("query_id", "vector"), k)
        by_words = self.words().search(queries.select("query_id", "query"), k, c.bm25_k1, c.bm25_b)
        hits = keep(fusion.fuse(by_vector, by_words, k, c.vector_weight, c.bm25_weight))
        nodes, edges = self.graph.nodes(), self.graph.edges()
        if use_graph and use_reranking:
            f = rerank.features(hits, chunks, nodes, edges, queries)
            hits = hits.drop("score", "rank").join(rerank.rerank(hits, rerank.graph_score(f), k, c.rerank_threshold), ["query_id", "id"])
        if use_graph:
            hits = rerank.enhance(hits, nodes, edges)
        return fusion.with_chunks(hits, chunks.drop("embedding")).orderBy("rank")

    def search_in_file(self, file_path: str, query: str = "", top_k: int = 10) -> DataFrame:
        return search_in_file(self.chunks.by_file(file_path), file_path, query, top_k)

    # ---- graph

    def function_dependencies(self, function_id: str) -> DataFrame:
        return graph.dependencies(self.graph.nodes(), self.graph.edges(), self._id(function_id))

    def class_hierarchy(self, class_id: str) -> DataFrame:
        return graph.hierarchy(self.graph.nodes(), self.graph.edges(), self._id(class_id))

    def file_structure(self, file_path: str) -> tuple[DataFrame, DataFrame]:
        return graph.file_structure(self.graph.nodes(), self.graph.edges(), self._id(file_path))

    def node_details(self, node_id: str) -> DataFrame:
        return graph.details(self.graph.nodes(), self.graph.edges(), self._id(node_id))

    def graph_data(self) -> tuple[DataFrame, DataFrame]:
        """All nodes and all edges."""
        return self.graph.nodes(), self.graph.edges()

    def node(self, node_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(the node, its edges, its neighbours without itself), each empty for an unknown id."""
        nodes, edges = self.graph_data()
        own = nodes.where(F.col("id") == node_id)
        at = graph.touching(graph.of_types(edges), own.select("id"))
        near = graph.ends(at).where(F.col("id") != node_id)
        return own, at.drop("start"), nodes.join(near, "id", "left_semi")

    def related_chunks(self, chunk_id: str, types: tuple[str, ...] = EDGE_TYPES, hops: int = 1) -> DataFrame:
        """(start, id, type) of the nodes within ``hops`` undirected steps, the start included if any edge touches it."""
        if hops == 1:
            return graph.related(self.graph.nodes(), self.graph.edges(), self._id(chunk_id), types)
        near = graph.k_hop(self.graph.edges(), self._id(chunk_id), hops, types, directed=False)
        return near.join(self.graph.nodes().select("id", "type"), "id").select("start", "id", "type")

    def files(self) -> DataFrame:
        return self.graph.nodes().where(F.col("type") == "File")

    def _id(self, key: str) -> DataFrame:
        return self.spark.createDataFrame([(key,)], "id string")

    # ---- maintenance

    def stats(self) -> dict:
        """Counts of the graph by type, of vectors, and the parameters and vocabulary of the keyword side."""
        words = self.words().stats(self.config.bm25_k1, self.config.bm25_b).first().asDict()
        return {"graph": [r.asDict() for r in self.graph.stats().collect()], "vectors": self.chunks.count(), "bm25": words, "rerank": {"threshold": self.config.rerank_threshold, "weights": rerank.WEIGHTS}}

    def clear(self) -> None:
        self.words().remove(self.chunks.read().select("id"))
        self.chunks.clear()
        self.graph.clear()

    def delete_file(self, path: str) -> None:
        """Drop a file's chunks, its words, and its part of the graph."""
        gone = keep(self.chunks.by_file(path).select("id"))
        self.words().remove(gone)
        self.chunks.delete_file(path)
        self.graph.replace_files(self.spark.createDataFrame([(path,)], "path string"), self.graph.nodes().limit(0), self.graph.edges().limit(0))

    def clear_index(self, prefix: str) -> dict[str, int]:
        self.words().remove(self.chunks.read().where(F.col("file_path").startswith(prefix)).select("id"))
        before, after = self.chunks.delete_prefix(prefix)
        return self.graph.delete_prefix(prefix) | {"vectors_before": before, "vectors_after": after}


def search_in_file(chunks: DataFrame, file_path: str, query: str = "", k: int = 10) -> DataFrame:
    """(id, start_line, snippet, score, search_type, rank) of a file's chunks that hold the query, all of them without one."""
    own = chunks.where(F.col("file_path") == file_path)
    own = graph.text_contains(own, query, None) if query else own
    kind = F.lit("file_query" if query else "file")
    out = own.select(F.lit(0).cast("bigint").alias("query_id"), "id", "start_line", fx.snippet(F.col("content"), 150).alias("snippet"), F.lit(1.0).alias("score"), kind.alias("search_type"))
    return bm25.top_k(out.withColumn("line", F.coalesce("start_line", F.lit(0))), k, "line", descending=False).drop("query_id", "line")
