"""Approximate vector search over inverted lists: rows lie in folders by their nearest centre, a query opens the nearest few.

Centres come from k-means over a bounded sample; every row is indexed. With as many probes as lists the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.bm25 import top_k
from corpusmill.operators.vector import BLOCK, nearest_rows, usable
from corpusmill.operators.vector import _matrix as matrix
from corpusmill.runtime import keep, ship
from corpusmill.sources.versions import Versions

#: Lists and probes, the rows the centres are fitted on, and the rows a list should hold at least.
LISTS, PROBES, SAMPLE_MOST, LIST_LEAST = 1024, 10, 65_536, 40


def centres_of(x: np.ndarray, lists: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """k-means centres; a centre that loses all its rows stays where it was."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest_centre(x, c)
        order = np.argsort(near, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
        c[near[order][first]] = np.add.reduceat(x[order], first) / np.diff(np.r_[first, len(x)])[:, None]
    return c


def nearest_centre(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c**2).sum(1), axis=1)


class IvfIndex:
    """Lists in one folder: (id, vector) by cell, and the centres."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)
        self.state = self.versions.current()

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.versions.path}/{name}")

    def build(self, df: DataFrame, dims: int, lists: int = 0, key: str = "id", vector: str = "embedding", metric: str = "l2") -> IvfIndex:
        """Index all rows with ``dims`` finite values, in place of what was there; ``lists`` = 0 chooses by the number of rows."""
        ship(self.spark)
        kind = df.schema[key].dataType.simpleString()
        rows = keep(df.where(usable(vector, dims)).select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("vector")))
        n = rows.count()
        lists = max(1, min(lists or LISTS, max(1, n // LIST_LEAST)))
        bound = 1 << 30
        sample = rows if n <= SAMPLE_MOST else rows.where(F.pmod(F.xxhash64("id"), F.lit(bound)) < int(bound * SAMPLE_MOST / n))
        unit = metric == "cosine"
        x = np.asarray([r[0] for r in sample.select("vector").collect()], np.float64).reshape(-1, dims)
        x = x / np.linalg.norm(x, axis=1, keepdims=True) if unit and len(x) else x
        c = centres_of(x, lists) if len(x) else np.zeros((1, dims))
        held = self.spark.sparkContext.broadcast(c)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, m = matrix(b.column(1), dims)
                m = m / np.linalg.norm(m, axis=1, keepdims=True) if unit and len(m) else m
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nearest_centre(m, held.value).astype(np.int32), pa.int32())], ["id", "vector", "cell"])

        # a crowded cell is written by several tasks
        placed = rows.mapInArrow(assign, f"id {kind}, vector array<float>, cell int").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(max(1, n // 2_000_000))))
        name, centres = self.versions.folder("lists"), self.versions.folder("centres")
        placed.repartition("cell", "salt").drop("salt").write.partitionBy("cell").parquet(f"{self.versions.path}/{name}")
        self.spark.createDataFrame([(i, v) for i, v in enumerate(c.tolist())], "cell int, centre array<double>").coalesce(1).write.parquet(f"{self.versions.path}/{centres}")
        self.versions.commit({"lists": name, "centres": centres, "dims": dims, "metric": metric, "id_type": kind, "rows": n}, self.state)
        self.state = self.versions.current()
        return self

    def search(self, queries: DataFrame, k: int = 10, probes: int = PROBES) -> DataFrame:
        """(query_id, id, distance or similarity, rank): the nearest rows of the ``probes`` nearest lists of every query.

        ``queries`` has (query_id, vector), at most ``vector.BLOCK`` of them; more are an error, for callers to ask in parts.
        """
        s, metric = self.state, self.state["metric"]
        dims = s["dims"]
        q_kind = queries.schema["query_id"].dataType.simpleString()
        asked = queries.where(usable("vector", dims)).select("query_id", F.col("vector").cast("array<double>").alias("vector")).limit(BLOCK + 1).collect()
        if len(asked) > BLOCK:
            raise ValueError(f"more than {BLOCK} queries at once")
        c = np.asarray([r.centre for r in self._table(s["centres"], "cell int, centre array<double>").orderBy("cell").collect()])
        q = np.asarray([r.vector for r in asked], np.float64).reshape(-1, dims)
        u = q / np.linalg.norm(q, axis=1, keepdims=True) if metric == "cosine" and len(q) else q
        opened = np.argsort((c**2).sum(1)[None, :] - 2 * (u @ c.T), axis=1, kind="stable")[:, : max(1, probes)]
        by_cell = {int(cell): np.flatnonzero((opened == cell).any(1)) for cell in np.unique(opened)}
        held = self.spark.sparkContext.broadcast(([r.query_id for r in asked], q, by_cell))
        rows = self._table(s["lists"], f"id {s['id_type']}, vector array<float>, cell int").where(F.col("cell").isin(list(by_cell)) if by_cell else F.lit(False))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, by_cell = held.value
            for b in batches:
                cells = b.column(2).to_numpy()
                _, m = matrix(b.column(1), dims)
                ids = b.column(0)
                for cell in np.unique(cells).tolist():
                    own, at = by_cell[cell], np.flatnonzero(cells == cell)
                    keys, hits, far = [], [], []
                    for i, (good, row) in zip(own.tolist(), nearest_rows(q[own], m[at], k, metric)):
                        keys += [names[i]] * len(good)
                        hits += at[good].tolist()
                        far += row.tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64() if q_kind == "bigint" else None), ids.take(pa.array(hits, pa.int64())), pa.array(far, pa.float64())], ["query_id", "id", "far"])

        best = top_k(rows.mapInArrow(run, f"query_id {q_kind}, id {s['id_type']}, far double"), k, "far", descending=False)
        if metric == "l2":
            return best.withColumnRenamed("far", "distance")
        return best.withColumn("similarity", -F.col("far")).drop("far")
