"""Streams: windowed counts with late data, and chunks kept at their latest version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.runtime import shared_dir
from corpusmill.sources.tables import latest


def _stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of a folder as a stream; a single file is read through its folder."""
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        reader, path = reader.option("pathGlobFilter", p.getName()), p.getParent().toString()
    return reader.parquet(path)


def window_counts(events: DataFrame, time: str = "ts", by: str = "event_type", length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, by, n, total) per tumbling window; works on a batch and on a stream, where ``late`` bounds the state."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark(time, late)
    g = e.groupBy(F.window(time, length).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), by, "n", "total")


def run_window_counts(spark: SparkSession, path: str, **options) -> DataFrame:
    """Drain a folder of events through the stream; every micro-batch replaces the windows it touched."""
    out = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    q = window_counts(_stream(spark, path), **options).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    by = options.get("by", "event_type")
    last = spark.read.parquet(out).groupBy("start", by).agg(F.max(F.struct("batch", "n", "total")).alias("r"))
    return last.select("start", by, "r.n", "r.total")


def run_latest(spark: SparkSession, path: str, key: str, version: str, columns: list[str]) -> DataFrame:
    """Drain a folder of rows that come repeatedly and late; the record of a key is its latest row.

    Each micro-batch is reduced to its latest rows and appended, so replays change nothing; the last reduction is
    done when reading.
    """
    out = f"{shared_dir(spark)}/latest-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        latest(batch, key, version, columns).write.mode("append").parquet(out)

    q = _stream(spark, path).writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return latest(spark.read.parquet(out), key, version, columns)
