"""Laying items out in containers of fixed capacity (problem 8).

Bounded-space online best-fit: a fixed number of containers is open at a time. A bitset has a bit for
every amount of free space that some open container has, so the tightest container that still takes
an item is one shift and one lowest-bit lookup away; when too many are open, the fullest closes first.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import cut, ship

CAPACITY = 2048
OPEN_BINS = 128
#: Tokens that one task lays out: about this many by hash of the key, whatever the corpus holds.
TOKENS_PER_GROUP = 1 << 21
#: First-round groups whose unfinished containers are laid out again together.
GROUPS_TOGETHER = 16


class BestFit:
    """The open containers, by free space."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.n_made = 0

    def put(self, size: int) -> int:
        """Number of the container that takes an item of ``size`` (1..capacity)."""
        if size == self.capacity:
            self.n_made += 1
            return self.n_made - 1
        fitting = self.bits >> size
        if fitting:
            free = (fitting & -fitting).bit_length() - 1 + size
            at = self._take(free)
        else:
            if self.n_open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            at, free = self.n_made, self.capacity
            self.n_made += 1
        if free > size:
            self.by_free[free - size].append(at)
            self.bits |= 1 << (free - size)
            self.n_open += 1
        return at

    def _take(self, free: int) -> int:
        at = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return at

    def open(self) -> set[int]:
        return {b for bins in self.by_free for b in bins}


def split_sizes(df: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece_no, start, n): an item as it is, or, beyond the capacity, cut into full pieces and a rest."""
    n = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    last = F.greatest(F.ceil(n / F.lit(capacity)).cast("bigint") - 1, F.lit(0).cast("bigint"))
    return (
        df.select(F.col(key).alias("key"), n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece_no"))
        .withColumn("start", F.col("piece_no") * capacity)
        .select("key", "piece_no", "start", F.least(F.lit(capacity).cast("bigint"), F.col("_n") - F.col("start")).alias("n"))
    )


def pack(df: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """(key, piece_no, start, n, bin_id): a container for every item.

    Items of a group arrive ordered by key, so a rerun of a lost task gives the same containers. The
    containers still open at a group's end are emptied and laid out once more, together with those of
    15 other groups and largest first, with as many containers open as can have come together. An item of size 0 (also null) has a null bin_id, since it takes no
    space. Items beyond the capacity are cut as :func:`split_sizes` says; repeated keys are separate items.
    """
    spark = df.sparkSession
    ship(spark)
    items = split_sizes(cut(df.select(key, size)), key, size, capacity)
    total = items.agg(F.sum("n")).first()[0] or 0
    groups = max(1, round(total / TOKENS_PER_GROUP))
    kind = df.schema[key].dataType.simpleString()

    def first(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("piece_no", "ascending"), ("n", "ascending")])
        bins = BestFit(capacity, open_bins)
        at = [bins.put(n) for n in t.column("n").to_pylist()]
        left = bins.open()
        group = t.column("grp")[0].as_py() << 32
        done = pa.array([b not in left for b in at], pa.bool_())
        return t.select(names[:4]).append_column("bin_id", pa.array([group + b for b in at], pa.int64())).append_column("done", done).append_column("grp", t.column("grp"))

    def second(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n", "descending"), ("key", "ascending"), ("piece_no", "ascending")])
        bins = BestFit(capacity, GROUPS_TOGETHER * open_bins)  # as many as can have come here
        group = (1 << 62) + (t.column("grp")[0].as_py() << 32)
        return t.select(names[:4]).append_column("bin_id", pa.array([group + bins.put(n) for n in t.column("n").to_pylist()], pa.int64()))

    names = ["key", "piece_no", "start", "n", "bin_id"]
    plain = f"key {kind}, piece_no bigint, start bigint, n bigint, bin_id bigint"
    some = items.where(F.col("n") > 0).withColumn("grp", F.pmod(F.xxhash64("key", "piece_no"), F.lit(groups)))
    laid = cut(some.groupBy("grp").applyInArrow(first, plain + ", done boolean, grp bigint"))
    again = (
        laid.where(~F.col("done"))
        .withColumn("grp", F.floor(F.col("grp") / GROUPS_TOGETHER).cast("bigint"))
        .groupBy("grp")
        .applyInArrow(second, plain)
    )
    none = items.where(F.col("n") == 0).withColumn("bin_id", F.lit(None).cast("bigint")).select(names)
    out = laid.where(F.col("done")).select(names).unionByName(again).unionByName(none)
    return out.withColumnRenamed("key", key)
