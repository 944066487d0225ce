"""Reading tables, and the record behind an at-least-once delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, version: str, columns: list[str] | None = None) -> DataFrame:
    """One row per ``key``: the row with the greatest ``version``; ties are ordered by the columns.

    An aggregate rather than a window: repeated rows of a hot key meet in the map-side combine, so
    a key that holds a third of all rows costs one partial row per input task. Null keys are dropped,
    a null version loses against any other.
    """
    columns = [c for c in (columns or df.columns) if c not in (key, version)]
    packed = F.struct(F.col(version), *[F.col(c) for c in columns])
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(packed).alias("_row"))
        .select(key, *[F.col(f"_row.{c}").alias(c) for c in columns], F.col(f"_row.{version}").alias(version))
    )
