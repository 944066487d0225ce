"""Keeping chunks and graphs: tables in Parquet, graphs also as one JSON document."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import graph
from corpusmill.runtime import keep
from corpusmill.schemas import CHUNKS, EDGES, NODES
from corpusmill.sources.versions import Buckets


class ChunkStore:
    """A table of chunks by id, in buckets by file. Inserting is an upsert: of rows with one id the last inserted stands.

    A chunk id names one file (it is made of the path and the lines), so rows of one id share a bucket. A change
    rewrites the buckets of the files it touches; see :mod:`corpusmill.sources.versions` for what a failure leaves behind.
    """

    def __init__(self, spark: SparkSession, path: str, dimension: int | None = None, buckets: int = 64):
        self.spark, self.dimension = spark, dimension
        self.table = Buckets(spark, path, CHUNKS, F.col("file_path"), buckets)

    def read(self) -> DataFrame:
        return self.table.read()

    def _ready(self, chunks: DataFrame) -> DataFrame:
        """The rows to insert, evaluated once; a vector of another length than the store's is an error."""
        if "embedding" not in chunks.columns:
            chunks = chunks.withColumn("embedding", F.lit(None))
        new = keep(chunks.select([F.col(f.name).cast(f.dataType) for f in CHUNKS]))
        if self.dimension is not None and new.where(F.col("embedding").isNotNull() & (F.size("embedding") != self.dimension)).limit(1).count():
            raise ValueError(f"a vector does not have {self.dimension} values")
        return new

    @staticmethod
    def _last(old: DataFrame, new: DataFrame) -> DataFrame:
        names = [f.name for f in CHUNKS if f.name != "id"]
        both = old.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
        last = both.groupBy("id").agg(F.max(F.struct("turn", *names)).alias("r"))
        return last.select("id", *[f"r.{c}" for c in names])

    def insert(self, chunks: DataFrame) -> int:
        """Number of rows inserted."""
        new = self._ready(chunks)
        self.table.change(self.table.touched(new), lambda old: self._last(old, new))
        return new.count()

    def replace_files(self, paths: DataFrame, chunks: DataFrame) -> int:
        """Insert the chunks of files (path), and drop every other chunk of these files."""
        new, paths = self._ready(chunks), paths.select(F.col("path").alias("file_path")).distinct()
        touched = sorted({*self.table.touched(paths), *self.table.touched(new)})
        none = new.limit(0)
        self.table.change(touched, lambda old: self._last(none, new).unionByName(old.join(paths, "file_path", "left_anti").join(new.select("id"), "id", "left_anti").select(new.columns)))
        return new.count()

    def by_id(self, key: str) -> DataFrame:
        return self.read().where(F.col("id") == key).limit(1)

    def by_file(self, path: str) -> DataFrame:
        """The chunks of a file, from its bucket only."""
        at = self.table.touched(self.spark.createDataFrame([(path,)], "file_path string"))
        return self.table.read(at).where(F.col("file_path") == path)

    def _delete(self, gone) -> None:
        """Drop the rows for which a condition is true; where it is null, as for a null path, they stay."""
        hit = F.coalesce(gone, F.lit(False))
        self.table.change(self.table.touched(self.read().where(hit)), lambda old: old.where(~hit))

    def delete_file(self, path: str) -> None:
        self._delete(F.col("file_path") == path)

    def delete_prefix(self, prefix: str) -> tuple[int, int]:
        """(rows before, rows after)."""
        before = self.count()
        self._delete(F.col("file_path").startswith(prefix))
        return before, self.count()

    def clear(self) -> None:
        self.table.clear()

    def count(self) -> int:
        return self.read().count()


class GraphStore:
    """Tables of nodes and edges below a folder, nodes in buckets by id, edges by source."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.node_table = Buckets(spark, f"{self.path}/nodes", NODES, F.col("id"), buckets)
        self.edge_table = Buckets(spark, f"{self.path}/edges", EDGES, F.col("source_id"), buckets)

    def nodes(self) -> DataFrame:
        return self.node_table.read()

    def edges(self) -> DataFrame:
        return self.edge_table.read()

    def upsert(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        if nodes is not None:
            new_n = keep(nodes)
            self.node_table.change(self.node_table.touched(new_n), lambda old: graph.upsert_nodes(old, new_n))
        if edges is not None:
            new_e = keep(edges)
            self.edge_table.change(self.edge_table.touched(new_e), lambda old: graph.upsert_edges(old, new_e))

    def replace_files(self, paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> None:
        """Upsert the graph of files (path); nodes of theirs that it does not hold any more go, with their edges."""
        nodes, edges = keep(nodes), keep(edges)
        old = self.nodes().join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")
        self._remove(old.select("id").join(nodes.select("id"), "id", "left_anti"))
        self.upsert(nodes, edges)

    def _remove(self, gone: DataFrame) -> None:
        """Drop nodes by id, and the edges at them, the edges first."""
        gone = keep(gone.distinct())
        sources, targets = gone.select(F.col("id").alias("source_id")), gone.select(F.col("id").alias("target_id"))
        e = self.edges()
        hit = e.join(sources, "source_id", "left_semi").select("source_id").union(e.join(targets, "target_id", "left_semi").select("source_id"))
        self.edge_table.change(self.edge_table.touched(hit), lambda old: old.join(sources, "source_id", "left_anti").join(targets, "target_id", "left_anti"))
        self.node_table.change(self.node_table.touched(self.nodes().join(gone, "id", "left_semi")), lambda old: old.join(gone, "id", "left_anti"))

    def delete_prefix(self, prefix: str) -> dict[str, int]:
        """Counts before and after."""
        out = {"nodes_before": self.nodes().count(), "edges_before": self.edges().count()}
        self._remove(graph.below_prefix(self.nodes(), prefix))
        return out | {"nodes_after": self.nodes().count(), "edges_after": self.edges().count()}

    def clear(self) -> None:
        self.node_table.clear()
        self.edge_table.clear()

    def stats(self) -> DataFrame:
        return graph.stats(self.nodes(), self.edges())


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a document {nodes: {id: node}, edges: [edge]}; an unreadable or missing one is an empty graph."""
    try:
        with open(path, encoding="utf-8") as file:
            doc = json.load(file)
    except (OSError, ValueError):
        doc = {}
    text = lambda p: {k: None if v is None else str(v) for k, v in (p or {}).items()}
    nodes = [(i, n.get("type"), text(n.get("properties")), n.get("file_path"), n.get("line_number")) for i, n in (doc.get("nodes") or {}).items()]
    edges = [(e.get("source_id"), e.get("target_id"), e.get("relationship_type"), text(e.get("properties"))) for e in doc.get("edges") or []]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as one document for exchange; created_at is kept from an earlier one. Rows stream through the driver."""
    created = None
    if os.path.exists(path):
        try:
            with open(path, encoding="utf-8") as file:
                created = json.load(file).get("metadata", {}).get("created_at")
        except (OSError, ValueError):
            pass
    now = str(nodes.sparkSession.sql("select cast(current_timestamp() as string)").first()[0])
    with open(path, "w", encoding="utf-8") as out:
        out.write('{"nodes": {')
        for k, r in enumerate(nodes.toLocalIterator()):
            node = {"id": r.id, "type": r.type, "properties": r.properties, "file_path": r.file_path, "line_number": r.line_number}
            out.write((", " if k else "") + json.dumps(r.id) + ": " + json.dumps(node))
        out.write('}, "edges": [')
        for k, r in enumerate(edges.toLocalIterator()):
            out.write((", " if k else "") + json.dumps(r.asDict()))
        out.write('], "metadata": ' + json.dumps({"created_at": created or now, "updated_at": now}) + "}")
