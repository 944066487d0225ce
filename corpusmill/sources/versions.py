"""Tables that are replaced in parts, safely: data folders are only ever added, and a manifest names the valid ones.

A change writes new folders beside the old ones and then a manifest of the next number, by a rename that fails
if the number is taken. Until that moment readers see the old state, after it the new one; a failure in between leaves
folders that nobody names. Folders that neither of the last two manifests names are removed after a change.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PREFIX = "manifest-"


class Versions:
    """The manifests of one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at())) if self._fs.exists(self._at()) else []

    def _manifests(self) -> list[str]:
        return [n for n in self._names() if n.startswith(_PREFIX)]

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> dict:
        """The newest manifest, {} where there is none."""
        have = self._manifests()
        return self._load(have[-1]) if have else {}

    def folder(self, kind: str) -> str:
        """Name of a new data folder."""
        return f"{kind}-{uuid.uuid4().hex}"

    def commit(self, manifest: dict, based_on: dict) -> None:
        """Make a manifest the current one; an error if another change came first."""
        manifest = manifest | {"number": based_on.get("number", 0) + 1}
        new, temporary = self._at(f"{_PREFIX}{manifest['number']:09d}"), self._at(f"_new-{uuid.uuid4().hex}")
        self._fs.mkdirs(self._at())
        out = self._fs.create(temporary)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(new) or not self._fs.rename(temporary, new):
            self._fs.delete(temporary, False)
            raise RuntimeError(f"{self.path} was changed meanwhile")
        self._tidy()

    def _tidy(self) -> None:
        names = self._names()
        manifests = [n for n in names if n.startswith(_PREFIX)]
        used = "".join(json.dumps(self._load(n)) for n in manifests[-2:])
        for n in manifests[:-2]:
            self._fs.delete(self._at(n), False)
        for n in names:
            if not n.startswith((_PREFIX, "_new-")) and n not in used:
                self._fs.delete(self._at(n), True)


class Buckets:
    """A table in buckets by a hash; a change rewrites the buckets it touches and no others."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, by: Column, buckets: int = 64):
        self.spark, self.schema, self.by = spark, schema, by
        self.versions = Versions(spark, path)
        self.buckets = self.versions.current().get("buckets", buckets)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.by), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        where = (self.versions.current() if manifest is None else manifest).get("where", {})
        paths = [f"{self.versions.path}/{folder}/bucket={k}" for k, folder in where.items() if only is None or int(k) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of rows, of which there are no more than ``buckets``."""
        return sorted(r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect())

    def change(self, only: list[int], make) -> None:
        """Replace the rows of some buckets by ``make(rows of these buckets)``."""
        if not only:
            return
        now = self.versions.current()
        folder = self.versions.folder("data")
        names = [f.name for f in self.schema]
        # one task a bucket, so that a bucket is one file
        new = make(self.read(only, now)).select(*names, self._bucket().alias("bucket")).repartition(min(len(only), 200), "bucket")
        new.write.partitionBy("bucket").parquet(f"{self.versions.path}/{folder}")
        where = {k: f for k, f in now.get("where", {}).items() if int(k) not in only}
        at = self.versions._at(folder)
        made = [s.getPath().getName() for s in self.versions._fs.listStatus(at)]
        where |= {n.split("=")[1]: folder for n in made if n.startswith("bucket=")}
        self.versions.commit({"buckets": self.buckets, "where": where}, now)

    def clear(self) -> None:
        now = self.versions.current()
        self.versions.commit({"buckets": self.buckets, "where": {}}, now)
