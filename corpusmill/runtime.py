"""Session-level helpers: where shared files go, how lineage is cut, how workers find this package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on every Python worker, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="corpusmill-")) / "corpusmill.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session names none (tests on one machine) a local folder is made and set.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="corpusmill-shared-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder as a table, so that several reads prune columns and survive lost executors."""
    at = f"{kept_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def kept_dir(spark: SparkSession) -> str:
    """The application's own folder for kept tables and indexes, in the shared folder."""
    return f"{shared_dir(spark)}/kept-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Remove all that :func:`keep` wrote in this application; results that still read it must be stored before.

    What :func:`cut` writes goes with ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept_dir(spark))
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder, so that later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A side of an estimated size up to HOT_BYTES is joined as it is; beyond, a key with more than HOT_ROWS rows is hot,
#: and up to HOT_KEYS hot keys meet their rows of the other side by broadcast.
HOT_BYTES, HOT_ROWS, HOT_KEYS = 256 << 20, 1_000_000, 10_000


def size_of(df: DataFrame) -> int:
    """The optimizer's estimate of a result's bytes; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_hot(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` for a ``right`` with about one row a key, where one key may hold a third of ``left``.

    The rows of hot keys are not shuffled: what ``right`` has for them, a row a key and at most HOT_KEYS keys, is
    broadcast. ``how`` is inner, left, left_semi or left_anti.
    """
    if size_of(left) <= HOT_BYTES:
        return left.join(right, on, how)
    keys = cut(left.groupBy(on).count().where(F.col("count") > HOT_ROWS).select(on).where(F.col(on).isNotNull()).limit(HOT_KEYS + 1))
    if not 0 < keys.count() <= HOT_KEYS:
        return left.join(right, on, how)
    small = F.broadcast(keys.withColumn("_hot", F.lit(True)))
    marked = left.join(small, on, "left")
    hot = marked.where("_hot").drop("_hot").join(F.broadcast(right.join(F.broadcast(keys), on, "left_semi")), on, how)
    return marked.where("_hot is null").drop("_hot").join(right, on, how).unionByName(hot)
