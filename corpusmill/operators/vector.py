"""Exact vector search, in blocks of queries against all rows.

A block of queries of checked size goes to every task; a task keeps the k best of its rows for each query,
so what is shuffled is k rows a query and task, whatever the number of rows. More queries than a block
holds are answered block after block, one scan a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.bm25 import foremost, merged, top_k
from corpusmill.runtime import ship

#: Values of query vectors that go to the tasks at once (128 MB), and the most queries.
BLOCK_VALUES, BLOCK = 1 << 24, 1 << 17


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix) of the vectors of the right length without nulls."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    ok = np.flatnonzero((np.diff(offsets) == dims) & np.asarray(column.is_valid()))
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    return ok, values[offsets[ok][:, None] + np.arange(dims)] if len(ok) else np.zeros((0, dims))


#: Queries that a task compares with its rows in one matrix product.
AT_ONCE = 256
#: Values that differ by less are told apart only by the exact distance, or tie.
TIE = 1e-9


def distances(q: np.ndarray, m: np.ndarray, metric: str) -> np.ndarray:
    """Smaller is nearer: squared Euclidean distance, or minus the cosine (NaN where a norm is zero)."""
    if metric == "l2":
        return np.stack([((m - x) ** 2).sum(1) for x in q]) if len(q) else np.zeros((0, len(m)))
    with np.errstate(invalid="ignore", divide="ignore"):
        return -(q @ m.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None, :])


def nearest_rows(q: np.ndarray, m: np.ndarray, k: int, metric: str, skip: np.ndarray | None = None, within: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of ``m``, distances) of the k nearest of each query and of all that may tie with the k-th.

    One matrix product finds the candidates; the Euclidean distance of these is then taken without its cancellation.
    skip[i, j] tells that row j is no candidate of query i, within[i] the distance beyond which none is.
    """
    squares = (m**2).sum(1)
    for at in range(0, len(q), AT_ONCE):
        part = q[at : at + AT_ONCE]
        own = (part**2).sum(1)
        if metric == "l2":
            rough = own[:, None] + squares[None, :] - 2 * (part @ m.T)
            slack = TIE + 1e-12 * (own + squares[np.isfinite(squares)].max(initial=0.0))
        else:
            rough, slack = distances(part, m, metric), np.full(len(part), TIE)
        rough = np.where(np.isnan(rough), np.inf, rough)
        if skip is not None:
            rough[skip[at : at + AT_ONCE]] = np.inf
        edge = np.full(len(part), np.inf) if within is None else within[at : at + AT_ONCE].copy()
        open_ = np.flatnonzero(np.isinf(edge))
        if 0 < k < m.shape[0] and len(open_):
            edge[open_] = np.partition(rough[open_], k - 1, axis=1)[:, k - 1]
        for i, row in enumerate(rough):
            good = np.flatnonzero((row <= edge[i] + slack[i]) & (row < np.inf))
            yield good, ((m[good] - part[i]) ** 2).sum(1) if metric == "l2" else row[good]


def search(df: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", key: str = "id", vector: str = "embedding", where=None, without_self: bool = False) -> DataFrame:
    """(query_id, id, distance or similarity, rank): the k nearest rows of every query.

    ``queries`` has (query_id, vector). ``where`` filters rows before scoring. Vectors of another length than
    the query's and vectors with nulls or infinite values are no candidates; under the cosine nor are those of norm zero. Ties
    go to the smaller id.
    """
    ship(df.sparkSession)
    if where is not None:
        df = df.where(where)
    kind = df.schema[key].dataType.simpleString()
    q_kind = queries.schema["query_id"].dataType.simpleString()
    # as many tasks as run at once, since each sends k rows a query
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).coalesce(df.sparkSession.sparkContext.defaultParallelism)
    queries = queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    n, values = queries.agg(F.count("*"), F.sum(F.size("vector").cast("bigint"))).first()
    blocks = max(1, -(-n // BLOCK), -(-(values or 0) // BLOCK_VALUES))
    out = None
    for i in range(blocks):
        part = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).toArrow()
        names, asked = (part[c].combine_chunks() for c in ("query_id", "vector"))
        sizes = pc.unique(pc.list_value_length(asked)).to_pylist()
        held = df.sparkSession.sparkContext.broadcast([(names.filter(pc.equal(pc.list_value_length(asked), x)), _matrix(asked, x)[1]) for x in sizes])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            blocks = held.value
            found: list[list[list[tuple]]] = [[[] for _ in names] for names, _ in blocks]
            # distances beyond these can't come in any more
            most = [np.full(len(names), np.inf) for names, _ in blocks]
            id_type = None
            for b in batches:
                id_type = b.schema.field(0).type
                b = b.take(pc.sort_indices(b.column(0)))
                for (names, q), best, within in zip(blocks, found, most):
                    at, m = _matrix(b.column(1), q.shape[1])
                    if not len(at) or k < 1:
                        continue
                    ids = b.column(0).take(pa.array(at))
                    same = np.asarray(names.to_pylist(), object)[:, None] == np.asarray(ids.to_pylist(), object)[None, :] if without_self else None
                    for j, (good, far) in enumerate(nearest_rows(q, m, k, metric, same, within.copy())):
                        if len(good):
                            first = foremost(far, k)
                            hits = best[j] = merged(best[j], list(zip(far[first].tolist(), ids.take(pa.array(good[first])).to_pylist())), k)
                            if len(hits) >= k:
                                within[j] = hits[k - 1][0] + 2 * TIE
            for (names, _), best in zip(blocks, found):
                flat = [(j, x, far) for j, hits in enumerate(best) for far, x in hits]
                if flat:
                    yield pa.RecordBatch.from_arrays([names.take(pa.array([x[0] for x in flat], pa.int64())), pa.array([x[1] for x in flat], id_type), pa.array([x[2] for x in flat], pa.float64())], ["query_id", "id", "far"])

        found = rows.mapInArrow(run, f"query_id {q_kind}, id {kind}, far double")
        out = found if out is None else out.unionByName(found)
    best = top_k(out, k, "far", descending=False)
    if metric == "l2":
        return best.withColumnRenamed("far", "distance")
    return best.withColumn("similarity", -F.col("far")).drop("far")


def validate(df: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has ``dims`` values, none of them null or not finite."""
    ok = (F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vector).isNotNull() & ok)


def usable(vector: str = "embedding", dims: int = 128):
    """Condition: a vector of ``dims`` finite values that are not all zero."""
    c = F.col(vector)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.isNotNull() & (F.size(c) == dims) & finite & F.exists(c, lambda x: x != 0)
