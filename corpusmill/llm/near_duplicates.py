"""Near-duplicate records with small edits (problem 2).

BagMinHash signatures: every feature of a record runs a Poisson process whose points fall on the m
registers of the signature, and a register keeps its earliest point. The weight of a feature (how often it
occurs, or 1 when features form a set) is discretised into unit levels grouped in dyadic rings; the process
of a ring runs at the rate of its width and carries a level with each point, so a weight inside a ring
takes the points below it. Two registers are equal with exactly the probability of the weighted Jaccard
similarity. Points are drawn in order of time and only up to the time at which the registers are expected
to be full, so a long record costs hardly more than a short one.

Bands of registers propose pairs; the overlap of the full feature lists decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.compact_keys import compact, plain
from corpusmill.runtime import cut, ship
from corpusmill.sources.tables import latest

RUN, THRESHOLD = 4, 0.7
#: 22 bands of 3 registers: at a similarity of 0.7 a pair is missed with probability 0.657 ** 22 = 0.0001.
BANDS, ROWS = 22, 3
#: Low bytes of a band's hash that are kept; two different bands agree in them once in 2 ** 48, and the overlap decides.
BAND_BYTES = 6
#: A band value that more different texts share than this proposes no pairs; their features do, by an exact prefix filter.
HOT_BAND = 256
#: Members of a class of copies that one task pairs with all of the class.
CLASS_AT_ONCE = 1_000

TOKEN = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


class _TokenHashes(dict):
    """64-bit hash of a token, the same in every process."""

    def __missing__(self, token: str) -> int:
        n = 0xCBF29CE484222325
        for c in token.encode("utf-8", "surrogatepass"):
            n = ((n ^ c) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        if len(self) > 2_000_000:
            self.clear()
        self[token] = n
        return n


_hashes = _TokenHashes()


def features(texts: list[str | None], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, feature, count), ordered by record and feature: the distinct runs of ``run`` tokens and how often each occurs."""
    flat: list[int] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for k, t in enumerate(texts):
        if t:
            flat += [_hashes[x] for x in TOKEN.findall(t)]
        ends[k + 1] = len(flat)
    h = np.asarray(flat, np.uint64)
    n = np.maximum(np.diff(ends) - run + 1, 0)
    record = np.repeat(np.arange(len(texts)), n)
    if not record.size:
        return record, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(len(record)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[:-1], n)
    f = mix(h[at])
    for j in range(1, run):
        f = mix(f * _C1 + h[at + j])
    order = np.lexsort((f, record))
    record, f = record[order], f[order]
    new = np.r_[True, (np.diff(record) > 0) | (f[1:] != f[:-1])]
    first = np.flatnonzero(new)
    return record[first], f[first], np.diff(np.r_[first, len(f)])


def signatures(record: np.ndarray, feature: np.ndarray, weight: np.ndarray, n_records: int, m: int) -> np.ndarray:
    """BagMinHash signatures, one row of ``m`` 64-bit registers per record; a record without features has a row of infinite times."""
    out = np.full((n_records, m), np.inf)
    # rings: levels 0..1, 1..2, 2..4, 4..8 ...; the last ring of a weight is taken in part
    rows, keys, rates, shares = [], [], [], []
    ring, low, width = 0, 0, 1
    at = np.arange(len(record))
    while at.size:
        rows.append(record[at])
        keys.append(mix(feature[at] + np.uint64((ring + 1) * int(_C1) & 0xFFFFFFFFFFFFFFFF)))
        rates.append(np.full(at.size, float(width)))
        shares.append(np.minimum(1.0, (weight[at] - low) / width))
        low, width, ring = low + width, max(1, low + width), ring + 1
        at = at[weight[at] > low]
    if not rows:
        return out.view(np.uint64)
    row, key, rate, share = map(np.concatenate, (rows, keys, rates, shares))
    total = np.bincount(row, rate * share, n_records)
    todo, slack = total > 0, 4.0
    while todo.any():
        own = todo[row]
        r, k, v, keep = row[own], key[own], rate[own], share[own]
        with np.errstate(divide="ignore"):
            bound = m * (np.log(m) + slack) / total
        time = np.zeros(len(r))
        reg = np.full(n_records * m, np.inf)
        step = 0
        while r.size:
            step += 1
            a = mix(k + np.uint64(step * int(_C3) & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / v
            live = time < bound[r]
            r, k, v, keep, time, a = r[live], k[live], v[live], keep[live], time[live], a[live]
            b = mix(a ^ _C1)
            place = r * m + ((b >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
            if keep.size and keep.min() < 1:
                below = (b & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < keep
                np.minimum.at(reg, place[below], time[below])
            else:
                np.minimum.at(reg, place, time)
        reg = reg.reshape(n_records, m)
        full = todo & np.isfinite(reg).all(1)
        out[full] = reg[full]
        todo, slack = todo & ~full, slack * 2
    return out.view(np.uint64)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band and record."""
    s = signature.reshape(len(signature), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), s.shape[:2]) * _C1
    for j in range(rows):
        h = mix(h * _C2 + s[:, :, j])
    return h.view(np.int64)


def _occurrences(record: np.ndarray, feature: np.ndarray, count: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """(record, element): the multiset as a set, its k-th occurrence of a feature being an element of its own."""
    if not weighted:
        return record, feature
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(record, count), mix(np.repeat(feature, count) + nth.astype(np.uint64) * _C1)


class NearDuplicates:
    """Links between different feature lists and membership of every record; both are cut, so reuse is free.

    ``members``: (key, rep): the record with the smallest key of those with the same features stands for
    all. ``links``: (a, b, similarity), a < b: pairs of representatives at or above the threshold. Keys are compact.
    A record with fewer than ``run`` tokens, or null content, has no features and is in neither. Null keys are dropped.
    """

    def __init__(self, df: DataFrame, key: str = "id", content: str = "content", version: str | None = "indexed_at", run: int = RUN, threshold: float = THRESHOLD, weighted: bool = False, bands: int = BANDS, rows: int = ROWS):
        spark = df.sparkSession
        ship(spark)
        m = bands * rows

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    b = batch.slice(at, 2000)
                    record, feature, count = features(b.column(2).to_pylist(), run)
                    sig = signatures(record, feature, count if weighted else np.ones_like(count), b.num_rows, m)
                    hashes = band_hashes(sig, bands, rows)
                    r, e = _occurrences(record, feature, count, weighted)
                    has = np.bincount(r, minlength=b.num_rows)
                    # 128 bits that name the set of elements, whatever their order
                    one, two = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
                    np.add.at(one, r, mix(e ^ _C2))
                    np.add.at(two, r, mix(e + _C3))
                    name = np.stack([one, two], 1).view(np.uint8)
                    names = [x.tobytes() if n else None for x, n in zip(name, has.tolist())]
                    six = np.ascontiguousarray(hashes.view(np.uint8).reshape(b.num_rows, bands, 8)[:, :, :BAND_BYTES])
                    packed = [x.tobytes() if n else None for x, n in zip(six, has.tolist())]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.binary()), pa.array(packed, pa.binary())], ["key", "version", "name", "bands"])

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = np.zeros((b.num_rows * bands, 8), np.uint8)
                h[:, :BAND_BYTES] = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, BAND_BYTES)
                take = pa.array(np.repeat(np.arange(b.num_rows), bands))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(h.view(np.int64).ravel())], ["key", "h"])

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                record, feature, count = features(b.column(1).to_pylist(), run)
                r, e = _occurrences(record, feature, count, weighted)
                ends = np.r_[0, np.cumsum(np.bincount(r, minlength=b.num_rows))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(e.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], ["key", "f"])

        when = F.col(version) if version else F.lit(0)
        rows_ = df.where(F.col(key).isNotNull()).select(compact(key).alias("key"), when.alias("version"), F.col(content).alias("content"))
        kind = rows_.schema["version"].dataType.simpleString()
        signed = cut(latest(rows_.mapInArrow(sign, f"key binary, version {kind}, name binary, bands binary"), "key", "version").where(F.col("name").isNotNull()))
        named = signed.groupBy("name").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
        self.members = signed.select("key", "name").join(named.select("name", "rep"), "name").select("key", "rep")
        reps = signed.join(named.select(F.col("rep").alias("key")), "key", "left_semi")
        hashed = reps.select("key", "bands").mapInArrow(unpack, "key binary, h bigint")
        order = Window.partitionBy("h").orderBy("key")
        shared = hashed.withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("key").over(order))
        shared = cut(shared.where((F.col("n") > 1) | F.col("next").isNotNull()).select("h", "key", (F.col("n") == HOT_BAND + 1).alias("hot")))

        def lists_of(keys: DataFrame) -> DataFrame:
            """(key, f): the feature lists of the records of some keys, from the row that is their record."""
            asked = keys.join(signed.select("key", "version"), "key").select(F.col("key").alias("k"), F.col("version").alias("v"))
            # null-safe: the latest row of a key that never had a version has none either
            texts = rows_.join(asked, (F.col("key") == F.col("k")) & F.col("version").eqNullSafe(F.col("v")), "left_semi")
            return cut(latest(texts, "key", "version", ["content"]).select("key", "content").mapInArrow(listed, "key binary, f array<bigint>"))

        hot = shared.where("hot").select("h")
        n_hot = hot.count()
        found = None
        if n_hot:
            hot = F.broadcast(hot) if n_hot <= 20_000 else hot
            found = prefix_pairs(lists_of(cut(shared.join(hot, "h", "left_semi").select("key").distinct())), threshold)
            shared = shared.join(hot, "h", "left_anti")
        a, b = shared.select("h", F.col("key").alias("a")), shared.select("h", F.col("key").alias("b"))
        proposed = a.join(b, "h").where("a < b").select("a", "b")
        pairs = cut((proposed if found is None else proposed.unionByName(found)).distinct())
        # features are listed only for the records of some proposed pair
        lists = lists_of(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct())
        both = pairs.join(lists.select(F.col("key").alias("a"), F.col("f").alias("fa")), "a").join(lists.select(F.col("key").alias("b"), F.col("f").alias("fb")), "b")
        same = F.size(F.array_intersect("fa", "fb")).cast("double")
        self.links = cut(both.withColumn("same", same).withColumn("similarity", F.col("same") / (F.size("fa") + F.size("fb") - F.col("same"))).where(F.col("similarity") >= threshold).select("a", "b", "similarity"))

    def pairs(self) -> DataFrame:
        """(id_a, id_b): every pair of records at or above the threshold, copies included, each once."""
        m = self.members
        linked = self.links.join(m.select(F.col("rep").alias("a"), F.col("key").alias("x")), "a").join(m.select(F.col("rep").alias("b"), F.col("key").alias("y")), "b")
        many = m.groupBy("rep").count().where(F.col("count") > 1)
        # the pairs of a large class are made by as many tasks as it has thousands of members
        own = cut(m.join(many, "rep").select("rep", "key", F.least(F.ceil(F.col("count") / CLASS_AT_ONCE), F.lit(4096)).cast("int").alias("parts")))
        left = own.select("rep", F.col("key").alias("x"), F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"))
        right = own.select("rep", F.col("key").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        within = left.join(right, ["rep", "part"]).where("x < y")
        both = linked.select("x", "y").unionByName(within.select("x", "y"))
        named = both.select(plain("x").alias("x"), plain("y").alias("y"))
        return named.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """(id, group_id, copies, links): a row per record with features, without expanding copies into pairs.

        group_id is the smallest id that can be reached over links; copies counts the records with the same
        features, itself included; links the different feature lists that its own is linked to.
        """
        label = components(self.links.select("a", "b"))
        degree = self.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
        copies = self.members.groupBy("rep").agg(F.count("*").alias("copies"))
        reps = copies.join(label, "rep", "left").join(degree, "rep", "left")
        out = self.members.join(reps, "rep")
        return out.select(plain("key").alias("id"), plain("coalesce(label, rep)").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def prefix_pairs(lists: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: every pair of feature lists (key, f) that may reach the threshold, exactly, in any number of alike lists.

    In an order of all features from rare to frequent, two lists of a similarity t or more share one of the first
    n - ceil(t n) + 1 features of either. What all have in common, such as a licence, comes last and proposes nothing.
    """
    rows = lists.select("key", F.size("f").alias("n"), F.explode("f").alias("f"))
    seen = rows.groupBy("f").agg(F.count("*").alias("df"))
    ordered = rows.join(seen, "f").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "f"))).alias("fs"))
    # the least overlap is taken a hair lower, so that rounding never shortens a prefix
    length = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    first = cut(ordered.select("key", "n", F.explode(F.slice("fs", F.lit(1), length.cast("int"))).alias("e")).where(F.col("e.df") > 1).select("key", "n", F.col("e.f").alias("f")))
    a, b = first.select("f", F.col("key").alias("a"), F.col("n").alias("na")), first.select("f", F.col("key").alias("b"), F.col("n").alias("nb"))
    near = (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9) & (F.col("a") < F.col("b"))
    return a.join(b, "f").where(near).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(rep, label): the smallest node of each node's connected component, from links (a, b).

    Every round links each node's larger neighbours, and then its smaller ones, to the least of them;
    the edge list shrinks to stars in a number of rounds logarithmic in the longest path. Hot nodes are safe:
    least neighbours come from combinable minima, never from collected lists.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:  # until a round changes nothing: labels only fall, so it ends
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = cut(small.where("u <> v").distinct())
        changed = new.exceptAll(edges).limit(1).count() + edges.exceptAll(new).limit(1).count()
        edges = new
        if not changed:
            break
    return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("rep"), "label").union(edges.select(F.col("v").alias("rep"), F.col("v").alias("label")).distinct())
