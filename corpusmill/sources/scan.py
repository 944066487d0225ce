"""Reading a directory of source files.

Spark's own listing drops names that begin with '_' or '.', and empty files. Here the tree is walked once, pruned
directories are never entered, and the content is read by the tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.config import Config
from corpusmill.functions import text as fx
from corpusmill.runtime import ship

_PATHS = "path string, absolute_path string, size bigint, last_modified double"


def walk(root: str, config: Config | None = None) -> Iterator[tuple[str, str, int, float]]:
    """(path below root, absolute path, size, time of change) of every supported file that is not too large."""
    config = config or Config()
    root = os.path.abspath(root)
    for at, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in config.pruned_directories)
        for name in sorted(files):
            if os.path.splitext(name)[1].lower() not in config.supported_suffixes:
                continue
            full = os.path.join(at, name)
            try:
                s = os.stat(full)
            except OSError:
                continue
            if s.st_size <= config.max_file_size:
                yield os.path.relpath(full, root).replace(os.sep, "/"), full, s.st_size, s.st_mtime


def scan(spark: SparkSession, root: str, config: Config | None = None, files_per_task: int = 200) -> DataFrame:
    """Files without content: (path, absolute_path, file_type, language, size, last_modified)."""
    rows = list(walk(root, config))
    df = spark.createDataFrame(rows, _PATHS) if rows else spark.createDataFrame([], _PATHS)
    df = df.repartition(max(1, len(rows) // files_per_task)) if len(rows) > files_per_task else df
    return df.select("path", "absolute_path", fx.file_type(F.col("path")).alias("file_type"), fx.language(F.col("path")).alias("language"), "size", "last_modified")


def load_content(files: DataFrame) -> DataFrame:
    """Files with content as UTF-8, bytes that are none left out. Empty and unreadable files are dropped."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p in f["absolute_path"]:
                try:
                    with open(p, "rb") as file:
                        out.append(file.read().decode("utf-8", "ignore"))
                except OSError:
                    out.append(None)
            yield f.assign(content=out)

    schema = ", ".join(f"{c} {t}" for c, t in files.dtypes) + ", content string"
    return files.mapInPandas(run, schema).where(F.col("content") != "")
