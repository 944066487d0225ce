"""The k most similar vectors of every vector (problem 1).

Hierarchical k-means trees over unit vectors are fitted on bounded samples and then index every row; two
trees of different samples miss different neighbours, so together they need far fewer leaves than one.
A query walks each tree best bin first: nodes wait in a priority queue by how much farther their centre
is than the nearest centre of their level, and leaves are opened in that order while this margin is
within a bound. The queries of a block pop their queues together, a round a pop, and a query whose next node is
beyond the bound leaves. The bound is the widening: it is read off a calibration that compares the margins at which
true neighbours of some queries (brute force over all rows) lie in the tree with the recall asked for.

The trees fitted on the driver stop at LEAVES_MOST leaves, so leaves grow with the collection; a leaf that
grows large gets a tree of its own below it, fitted and calibrated by the task that searches the leaf.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.compact_keys import compact, plain, plain_list
from corpusmill.runtime import cut, ship
from corpusmill.sources.tables import latest

#: Rows a leaf is meant to hold, rows of the sample for each leaf, and the bound of the sample.
LEAF_ROWS, SAMPLE_PER_LEAF, SAMPLE_MOST = 500, 64, 131_072
TREES = 2
#: Leaves of a tree fitted on the driver; a leaf with more members than LOCAL_ROWS is searched through a tree of its own.
LEAVES_MOST, LOCAL_ROWS = SAMPLE_MOST // SAMPLE_PER_LEAF, 8_192
#: Members whose true neighbours calibrate a leaf's own tree, and the recall asked for there.
LOCAL_QUERIES, LOCAL_RECALL = 200, 0.995
#: Queries of the calibration and the share of their true neighbours that the opened leaves must hold.
CALIBRATION_QUERIES, TARGET_RECALL = 600, 0.985
#: A leaf with more members, or more visitors, than these is searched in blocks by several tasks.
MEMBERS_AT_ONCE, VISITORS_AT_ONCE = 131_072, 131_072


# ---------------------------------------------------------------- vectors as bytes


def to_bytes(vectors: pa.Array, dims: int) -> list[bytes | None]:
    """Each usable vector as bytes, half precision where that loses nothing; else None.

    Usable: not null, ``dims`` values, none null, all finite, not all zero.
    """
    out: list[bytes | None] = [None] * len(vectors)
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    size = np.diff(offsets)
    ok = np.flatnonzero((size == dims) & np.asarray(vectors.is_valid()))
    if not ok.size:
        return out
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float32)  # a null is NaN here
    x = values[offsets[ok][:, None] + np.arange(dims)]
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    ok, x = ok[fine], x[fine]
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    exact = (half.astype(np.float32) == x).all(1)
    for i, row, h, e in zip(ok.tolist(), x, half, exact.tolist()):
        out[i] = h.tobytes() if e else row.tobytes()
    return out


def from_bytes(blobs: list[bytes], dims: int) -> np.ndarray:
    """Unit vectors of :func:`to_bytes`, one per row."""
    x = np.empty((len(blobs), dims), np.float32)
    short = np.fromiter((len(b) == 2 * dims for b in blobs), bool, len(blobs))
    for mask, kind in ((short, np.float16), (~short, np.float32)):
        if mask.any():
            at = np.flatnonzero(mask)
            x[at] = np.frombuffer(b"".join([blobs[i] for i in at.tolist()]), kind).reshape(len(at), dims)
    x /= np.abs(x).max(1, keepdims=True, initial=1e-38)  # so that squares neither overflow nor vanish
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


# ---------------------------------------------------------------- the tree


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        order = np.argsort(near, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
        centres[near[order][starts]] = np.add.reduceat(x[order], starts) / np.diff(np.r_[starts, len(x)])[:, None]
    return centres


class Tree:
    """Two levels of centres: ``top`` nodes, and the ``leaf`` centres below node i at first[i]..first[i+1]."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.top = _kmeans(sample, round(leaves**0.5), rng)
        near = self._far(sample, self.top).argmin(1)
        parts, first = [], [0]
        for i in range(len(self.top)):
            own = sample[near == i]
            share = round(leaves * len(own) / max(1, len(sample)))
            parts.append(_kmeans(own, share, rng) if len(own) else self.top[i : i + 1])
            first.append(first[-1] + len(parts[-1]))
        self.leaf, self.first = np.concatenate(parts), np.asarray(first)
        self.parent = np.repeat(np.arange(len(self.top)), np.diff(self.first))

    @staticmethod
    def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * (x @ centres.T), 0))

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf that indexes each vector: the nearest below the nearest node."""
        near = self._far(x, self.top).argmin(1)
        out = np.empty(len(x), np.int64)
        for i in np.unique(near):
            rows = np.flatnonzero(near == i)
            a, b = self.first[i], self.first[i + 1]
            out[rows] = a + self._far(x[rows], self.leaf[a:b]).argmin(1)
        return out

    def margins(self, x: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """The widening at which row i of ``x`` opens ``leaves[i]``."""
        top, home = self._far(x, self.top), self.home(x)
        there = np.sqrt(((x - self.leaf[leaves]) ** 2).sum(1)) - np.sqrt(((x - self.leaf[home]) ** 2).sum(1))
        above = top[np.arange(len(x)), self.parent[leaves]] - top.min(1)
        return np.maximum(np.maximum(there, above), 0)

    def visit(self, x: np.ndarray, widen: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that the rows open, best bin first; each row's first leaf is its home.

        The queue of a row is its nodes in the order of their margins. In every round each row pops its next node, the
        leaves below it join the queue, and rows whose next node is beyond the widening are done.
        """
        top = self._far(x, self.top)
        over = top - top.min(1)[:, None]
        home = self.home(x)
        base = np.sqrt(((x - self.leaf[home]) ** 2).sum(1))
        rows, leaves, rank = [np.arange(len(x))], [home], [np.full(len(x), -1.0)]
        queue = np.argsort(over, axis=1, kind="stable")
        live = np.arange(len(x))
        for pops in range(len(self.top)):
            node = queue[live, pops]
            live = live[over[live, node] <= widen]
            if not live.size:
                break
            node = queue[live, pops]
            order = np.argsort(node, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(node[order]) > 0])
            for own, i in zip(np.split(live[order], starts[1:]), node[order][starts].tolist()):
                a, b = self.first[i], self.first[i + 1]
                far = np.maximum(self._far(x[own], self.leaf[a:b]) - base[own][:, None], over[own, i][:, None])
                r, c = np.nonzero(far <= widen)
                keep = a + c != home[own[r]]
                rows.append(own[r][keep])
                leaves.append((a + c)[keep])
                rank.append(far[r, c][keep])
        row, leaf = np.concatenate(rows), np.concatenate(leaves)
        order = np.lexsort((np.concatenate(rank), row))
        return row[order], leaf[order]

    def visit_one(self, v: np.ndarray, widen: float) -> list[int]:
        """The traversal of one vector with an explicit priority queue; :meth:`visit` does it for many at once."""
        top = self._far(v[None], self.top)[0]
        home = int(self.home(v[None])[0])
        base = float(np.linalg.norm(v - self.leaf[home]))
        queue = [(-1.0, 1, home)] + [(float(d - top.min()), 0, i) for i, d in enumerate(top)]
        heapq.heapify(queue)
        out: list[int] = []
        while queue and queue[0][0] <= widen:
            far, is_leaf, i = heapq.heappop(queue)
            if is_leaf:
                if i not in out:
                    out.append(i)
                continue
            a, b = self.first[i], self.first[i + 1]
            for c, d in enumerate(self._far(v[None], self.leaf[a:b])[0]):
                heapq.heappush(queue, (max(far, float(d) - base), 1, int(a + c)))
        return out


class Forest:
    """Trees side by side, their leaves numbered through."""

    def __init__(self, samples: list[np.ndarray], leaves: int):
        self.trees = [Tree(x, leaves, seed=17 + i) for i, x in enumerate(samples)]
        self.offset = np.cumsum([0] + [len(t.leaf) for t in self.trees])
        self.size = int(self.offset[-1])

    def widening(self, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The widening at which some tree opens for row i of ``x`` the leaf of row i of ``near``."""
        return np.min([t.margins(x, t.home(near)) for t in self.trees], axis=0)

    def homes(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([t.home(x) + o for t, o in zip(self.trees, self.offset)])

    def visit(self, x: np.ndarray, widen: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, whether it indexes the row there) of every leaf that the rows open."""
        rows, leaves, home = [], [], []
        for t, o in zip(self.trees, self.offset):
            r, leaf = t.visit(x, widen)
            rows.append(r)
            leaves.append(leaf + o)
            home.append(np.r_[True, np.diff(r) > 0])
        return np.concatenate(rows), np.concatenate(leaves), np.concatenate(home)


#: Decimals of a cosine that count.
TIE = 6


def top_k(q: np.ndarray, m: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions in ``m``, cosines) of the best of each row of ``q``, unordered; own[i] is never a hit of row i.

    Cosines are rounded to ``TIE``, which takes in the noise of single precision; ties go to the smaller position.
    """
    s = q @ m.T
    if own is not None:
        rows = np.flatnonzero(own >= 0)
        s[rows, own[rows]] = -3
    k = min(k, m.shape[0])
    if k == m.shape[0]:
        return np.broadcast_to(np.arange(k), s.shape), np.round(s, TIE)
    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    # where more tie with the k-th than fit, the partition chose among them at random: choose the smaller positions
    least = np.round(np.take_along_axis(s, at, 1).min(1), TIE)
    tied = np.flatnonzero((s >= (least - 0.6 * 10.0**-TIE).astype(np.float32)[:, None]).sum(1) > k)
    for i in tied.tolist():
        near = np.flatnonzero(s[i] >= least[i] - 10.0**-TIE)
        at[i] = near[np.argsort(-np.round(s[i, near], TIE), kind="stable")[:k]]
    return at, np.round(np.take_along_axis(s, at, 1), TIE)


def local_top_k(q: np.ndarray, m: np.ndarray, k: int, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, positions in ``m``, cosines) of :func:`top_k`, through a tree of the members of one large leaf.

    The tree is fitted on a bounded sample of them; its widening is the margin at which it holds the neighbours of
    some members, found by brute force within the leaf, with LOCAL_RECALL.
    """
    rng = np.random.default_rng(11)
    leaves = max(2, min(len(m) // LEAF_ROWS, LEAVES_MOST))
    tree = Tree(m[np.sort(rng.choice(len(m), min(len(m), leaves * SAMPLE_PER_LEAF), replace=False))], leaves)
    home = tree.home(m)
    order = np.argsort(home, kind="stable")
    begin = np.searchsorted(home[order], np.arange(len(tree.leaf) + 1))
    some = np.sort(rng.choice(len(m), min(len(m), LOCAL_QUERIES), replace=False))
    near, _ = top_k(m[some], m, k, some)
    widen = float(np.quantile(tree.margins(np.repeat(m[some], near.shape[1], 0), home[near.ravel()]), LOCAL_RECALL)) + 1e-6
    for at in range(0, len(q), 4096):
        part = np.arange(at, min(len(q), at + 4096))
        row, leaf = tree.visit(q[part], widen)
        by_leaf = np.argsort(leaf, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(leaf[by_leaf]) > 0]) if len(leaf) else np.zeros(0, int)
        for rows, le in zip(np.split(row[by_leaf], starts[1:]), leaf[by_leaf][starts].tolist()):
            inside = np.sort(order[begin[le] : begin[le + 1]])  # positions in the order of keys, for ties
            if inside.size:
                at_own = np.searchsorted(inside, own[part[rows]])
                mine = np.where((own[part[rows]] >= 0) & (at_own < len(inside)) & (inside[np.minimum(at_own, len(inside) - 1)] == own[part[rows]]), at_own, -1)
                found, cosine = top_k(q[part[rows]], m[inside], k, mine)
                yield part[rows], inside[found], cosine


# ---------------------------------------------------------------- the operator


def _usable(df: DataFrame, key: str, version: str | None, vector: str, dims: int) -> DataFrame:
    """(key, vec): compact key and bytes of the vector of every record that has a usable one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(to_bytes(b.column(2), dims), pa.binary())], ["key", "version", "vec"])

    when = F.col(version) if version else F.lit(0)
    rows = df.select(F.col(key).cast("string").alias("key"), when.alias("version"), F.col(vector).cast("array<float>").alias("v"))
    rows = rows.where(F.col("key").isNotNull()).withColumn("key", compact("key"))
    kind = rows.schema["version"].dataType.simpleString()
    return latest(rows.mapInArrow(run, f"key binary, version {kind}, vec binary"), "key", "version").where(F.col("vec").isNotNull()).select("key", "vec")


def _sample(vecs: DataFrame, n: int, of: int, seed: int, dims: int) -> tuple[list[bytes], np.ndarray]:
    """About ``n`` rows of ``of`` by a hash of the key, so that a rerun takes the same."""
    bound = 1 << 30
    part = vecs if n >= of else vecs.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(bound)) < int(bound * n / of))
    rows = part.collect()
    return [bytes(r.key) for r in rows], from_bytes([bytes(r.vec) for r in rows], dims)


def _true_neighbours(vecs: DataFrame, keys: list[bytes], q: np.ndarray, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(query number, unit vector) of the k true neighbours of each query, by brute force over all rows."""
    held = vecs.sparkSession.sparkContext.broadcast(({x: i for i, x in enumerate(keys)}, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, q = held.value
        best = np.full((len(q), k), -3, np.float32)
        blobs = np.full((len(q), k), b"", object)
        for b in batches:
            if not b.num_rows:
                continue
            raw = b.column(1).to_pylist()
            s = q @ from_bytes(raw, dims).T
            for j, x in enumerate(b.column(0).to_pylist()):
                if x in numbers:
                    s[numbers[x], j] = -3
            at = np.argpartition(-s, min(k, len(raw)) - 1, axis=1)[:, :k]
            s = np.concatenate([best, np.take_along_axis(s, at, 1)], 1)
            blobs = np.concatenate([blobs, np.array([*raw, b""], object)[at]], 1)
            top = np.argsort(-s, axis=1)[:, :k]
            best, blobs = np.take_along_axis(s, top, 1), np.take_along_axis(blobs, top, 1)
        i, j = np.nonzero(best > -2)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(best[i, j]), pa.array(blobs[i, j].tolist(), pa.binary())], ["q", "s", "vec"])

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "vec"))
    rows = vecs.mapInArrow(run, "q bigint, s float, vec binary").withColumn("r", rank).where(F.col("r") <= k).select("q", "vec").collect()
    return np.asarray([r.q for r in rows], np.int64), from_bytes([bytes(r.vec) for r in rows], dims)


def directions(blobs: list[bytes], dims: int) -> list[bytes]:
    """A name of each vector's direction, to the fifth decimal of the unit vector: the same for vectors of different lengths.

    Within that the cosine differs from 1 by less than single precision shows.
    """
    unit = np.round(from_bytes(blobs, dims).astype(np.float64), 5) + 0.0
    return [blake2b(row.tobytes(), digest_size=16).digest() for row in unit]


def _copies(vecs: DataFrame, k: int, dims: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows to index and search, neighbours of the rest or None).

    Of vectors of one direction only the k + 1 smallest keys can be among anyone's neighbours, and one beyond
    them has the k smallest as its own: it needs no search. So a direction that a third of all rows
    share costs a handful of rows in the tree.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(directions(b.column(1).to_pylist(), dims) if b.num_rows else [], pa.binary())], ["key", "vec", "h"])

    hashed = vecs.mapInArrow(name, "key binary, vec binary, h binary")
    many = cut(hashed.groupBy("h").count().where(F.col("count") > k + 1).select("h"))
    n = many.count()
    if not n:
        return vecs, None
    side = F.broadcast(many) if n <= 20_000 else many
    hot = cut(hashed.join(side, "h", "left_semi").select("key", "h"))
    # the window is limited in every task before anything is shuffled
    rank = F.row_number().over(Window.partitionBy("h").orderBy("key"))
    first = cut(hot.withColumn("r", rank).where(F.col("r") <= k + 1))
    rest = hot.join(first.select("key"), "key", "left_anti")
    salts = 64
    near = first.where(F.col("r") <= k).groupBy("h").agg(F.sort_array(F.collect_list("key")).alias("near"))
    near = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rest.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    found = salted.join(near, ["h", "salt"]).select("key", "near")
    return vecs.join(rest.select("key"), "key", "left_anti"), found


def nearest(df: DataFrame, key: str = "id", vector: str = "embedding", version: str | None = "indexed_at", k: int = 5, dims: int = 128, recall: float = TARGET_RECALL) -> DataFrame:
    """(key, near): of every record with a usable vector, the keys of its k most similar others, best first.

    Similarity is the cosine; ties go to the smaller key. Unusable vectors (null, of another length, with
    a null, NaN or infinite value, all zero) neither ask nor answer; a null key is dropped; the record of
    a key is its row of the latest ``version``. Fewer than k others give shorter lists, an only vector none.
    """
    spark = df.sparkSession
    ship(spark)
    vecs, copies = _copies(cut(_usable(df, key, version, vector, dims)), k, dims)
    if copies is not None:
        vecs = cut(vecs)
    n = vecs.count()
    leaves = max(1, min(n // LEAF_ROWS, LEAVES_MOST))
    samples = [_sample(vecs, max(4096, leaves * SAMPLE_PER_LEAF), n, 1 + i, dims)[1] for i in range(TREES if leaves > 1 else 1)]
    if leaves == 1:
        samples = [x[:1] if len(x) else np.ones((1, dims), np.float32) for x in samples]
    forest = Forest(samples, leaves)
    widen = 0.0
    if leaves > 1:
        keys, q = _sample(vecs, CALIBRATION_QUERIES, n, 0, dims)
        number, near = _true_neighbours(vecs, keys, q, k, dims)
        widen = float(np.quantile(forest.widening(q[number], near), recall)) + 1e-6
    held = spark.sparkContext.broadcast((forest, widen))

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, widen = held.value
        members, visitors = np.zeros(forest.size, np.int64), np.zeros(forest.size, np.int64)
        for b in batches:
            if b.num_rows:
                _, leaf, home = forest.visit(from_bytes(b.column(1).to_pylist(), dims), widen)
                members += np.bincount(leaf[home], minlength=forest.size)
                visitors += np.bincount(leaf, minlength=forest.size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(forest.size)), pa.array(members), pa.array(visitors)], ["leaf", "m", "v"])

    # as many rows as the trees have leaves, which SAMPLE_MOST bounds
    load = vecs.mapInArrow(counting, "leaf bigint, m bigint, v bigint").groupBy("leaf").agg(F.sum("m").alias("m"), F.sum("v").alias("v")).toPandas()
    m_blocks, v_blocks = np.ones(forest.size, np.int64), np.ones(forest.size, np.int64)
    m_blocks[load["leaf"]] = np.maximum(1, -(-load["m"] // MEMBERS_AT_ONCE))
    v_blocks[load["leaf"]] = np.maximum(1, -(-load["v"] // VISITORS_AT_ONCE))
    blocks = spark.sparkContext.broadcast((m_blocks, v_blocks))

    def routing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (forest, widen), (m_blocks, v_blocks) = held.value, blocks.value
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_pylist()
            x = from_bytes(b.column(1).to_pylist(), dims)
            spread = np.fromiter((hash_of(i) for i in keys), np.int64, len(keys))
            row, leaf, home = forest.visit(x, widen)
            simple = (m_blocks[leaf] == 1) & (v_blocks[leaf] == 1)
            cells, rows, kinds = [leaf[simple] << 32], [row[simple]], [np.where(home[simple], 3, 1)]
            for r, at, h in zip(row[~simple].tolist(), leaf[~simple].tolist(), home[~simple].tolist()):
                mb, vb = spread[r] % m_blocks[at], (spread[r] >> 20) % v_blocks[at]
                asks = [((at << 32) + (i << 16) + vb, 1) for i in range(m_blocks[at])]
                answers = [((at << 32) + (mb << 16) + j, 2) for j in range(v_blocks[at])] if h else []
                cells.append(np.asarray([c for c, _ in asks + answers], np.int64))
                rows.append(np.full(len(asks) + len(answers), r))
                kinds.append(np.asarray([z for _, z in asks + answers], np.int64))
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.concatenate(kinds).astype(np.int8)), b.column(0).take(take), b.column(1).take(take)], ["cell", "kind", "key", "vec"])

    def searching(t: pa.Table) -> pa.Table:
        kind = t.column("kind").to_numpy()
        keys = t.column("key").to_pylist()
        x = from_bytes(t.column("vec").to_pylist(), dims)
        member = np.flatnonzero(kind & 2)
        asking = np.flatnonzero(kind & 1)
        out_keys, out_near = [], []
        if member.size:
            member = np.asarray(sorted(member.tolist(), key=keys.__getitem__))  # positions in the order of keys, for ties
            names = [keys[i] for i in member]
            where = {name: j for j, name in enumerate(names)}
            m = x[member]
            own = np.fromiter((where.get(keys[i], -1) for i in asking), np.int64, len(asking))
            if len(member) > LOCAL_ROWS:
                parts = local_top_k(x[asking], m, k + 8, own)
            else:
                blocks_ = [np.arange(at, min(len(asking), at + 1024)) for at in range(0, len(asking), 1024)]
                parts = ((part, *top_k(x[asking[part]], m, k + 8, own[part])) for part in blocks_)
            for part, found, cosine in parts:
                for i, f, c in zip(asking[part].tolist(), found.tolist(), cosine.tolist()):
                    best = sorted((-s, names[j]) for j, s in zip(f, c) if s > -2)[:k]
                    out_keys.append(keys[i])
                    out_near.append([{"far": s, "key": name} for s, name in best])
        near = pa.list_(pa.struct([("far", pa.float32()), ("key", pa.binary())]))
        return pa.table([pa.array(out_keys, pa.binary()), pa.array(out_near, near)], ["key", "near"])

    routed = vecs.mapInArrow(routing, "cell bigint, kind tinyint, key binary, vec binary")
    found = routed.groupBy("cell").applyInArrow(searching, "key binary, near array<struct<far:float,key:binary>>")

    def merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for hits in b.column(1).to_pylist():
                best: dict[bytes, float] = {}
                for h in (h for part in hits for h in part):
                    best[h["key"]] = min(h["far"], best.get(h["key"], 9.0))
                out.append([x for _, x in sorted((far, x) for x, far in best.items())[:k]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.binary()))], ["key", "near"])

    merged = found.groupBy("key").agg(F.collect_list("near").alias("near")).mapInArrow(merging, "key binary, near array<binary>")
    if copies is not None:
        merged = merged.unionByName(copies)
    return merged.select(plain("key").alias(key), plain_list("near").alias("near"))


def hash_of(key: bytes) -> int:
    """A fixed number of 40 bits for a key."""
    n = 1469598103934665603
    for c in key[-8:]:
        n = ((n ^ c) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return (n ^ (n >> 29)) & 0xFFFFFFFFFF


def neighbour_pairs(near: DataFrame, key: str = "id") -> DataFrame:
    """(id_a, id_b), id_a < id_b: unordered pairs of which at least one is a neighbour of the other, each once."""
    other = near.select(F.col(key).alias("a"), F.explode("near").alias("b"))
    return other.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
