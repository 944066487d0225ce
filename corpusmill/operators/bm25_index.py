"""A kept keyword index: the corpus is tokenised once, searches read the postings of their own tokens.

A segment holds (bucket, token, id, tf, dl), in folders by a hash of the token, so that a search opens the folders of
its tokens only; the rows of a token spread over SALTS files, so that a token which every document holds is
no single task. Bucket -1 has one row per document with its length. Added documents form a segment of their own; where
they replace others, the ids they replace are kept beside the segment and no longer count in older ones.
Document frequencies and the mean idf are exact after every change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import bm25
from corpusmill.runtime import keep
from corpusmill.sources.versions import Versions

BUCKETS, SALTS = 16, 2
#: Tokens up to this number are named in the scan; more are joined. Up to ASKED terms of queries are held by the driver.
NAMED, ASKED = 2_000, 20_000


class Index:
    """The index in one folder; all its state is in the folder's newest manifest."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, salts: int = SALTS):
        self.spark, self.versions = spark, Versions(spark, path)
        self.state = self.versions.current()
        self.buckets, self.salts = self.state.get("buckets", buckets), self.state.get("salts", salts)
        self.id_type = self.state.get("id_type", "string")

    # ---- building

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, kind: str, *partition: str) -> str:
        name = self.versions.folder(kind)
        df.write.partitionBy(*partition).parquet(f"{self.versions.path}/{name}")
        return name

    def _table(self, name: str) -> DataFrame:
        columns = {"segment": f"token string, id {self.id_type}, dl int, tf int, bucket int", "terms": "token string, df bigint, raw double, bucket int", "gone": f"id {self.id_type}"}
        return self.spark.read.schema(columns[name.split("-")[0]]).parquet(f"{self.versions.path}/{name}")

    def _segment(self, docs: DataFrame) -> str:
        """Write the postings of documents (id, tokens, dl); the empty token stands for the document itself."""
        rows = docs.select("id", F.col("dl").cast("int").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("token"))
        rows = rows.withColumns({"bucket": F.when(F.col("token") == "", -1).otherwise(self._bucket()), "salt": F.pmod(F.xxhash64("id"), F.lit(self.salts)).cast("int")})
        # a row's tokens are counted where they are read, and once more where the buckets meet
        spread = rows.repartition((self.buckets + 1) * self.salts, "bucket", "salt")
        counted = spread.groupBy("bucket", "salt", "token", "id", "dl").agg(F.count("*").cast("int").alias("tf"))
        return self._write(counted.drop("salt").sortWithinPartitions("bucket", "token"), "segment", "bucket")

    def _rows(self, where: Column | None = None, state: dict | None = None) -> DataFrame:
        """Rows of all segments that still count."""
        state = self.state if state is None else state
        out = None
        for i, s in enumerate(state["segments"]):
            part = self._table(s["name"])
            part = part if where is None else part.where(where)
            for later in state["segments"][i + 1 :]:
                if later["gone"]:
                    part = part.join(self._table(later["gone"]), "id", "left_anti")
            out = part if out is None else out.unionByName(part)
        return out

    def _finish(self, segments: list[dict], terms: DataFrame) -> None:
        """Write terms (token, df) and what follows for the whole vocabulary, then make the change valid."""
        state = {"segments": segments}
        n, total = self._rows(F.col("bucket") == -1, state).agg(F.count("*"), F.sum(F.col("dl").cast("bigint"))).first()
        raw = F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        named = self._write(terms.select("token", "df", raw.alias("raw"), self._bucket().alias("bucket")).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "token"), "terms", "bucket")
        words, mean = (self._table(named).agg(F.count("*"), F.avg("raw")).first()) if n and total else (0, None)
        new = {"buckets": self.buckets, "salts": self.salts, "id_type": self.id_type, "segments": segments, "terms": named, "documents": n, "avgdl": (total or 0) / n if n else None, "vocabulary": words, "mean": mean}
        self.versions.commit(new, self.state)
        self.state = self.versions.current()

    @staticmethod
    def _df(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("bucket") >= 0).groupBy("token").agg(F.count("*").alias("df"))

    def build(self, docs: DataFrame) -> Index:
        """Index documents of :func:`bm25.documents`, in place of all that was there. Ids must be distinct."""
        self.id_type = docs.schema["id"].dataType.simpleString()
        s = {"name": self._segment(docs), "gone": None}
        self._finish([s], self._df(self._table(s["name"])))
        return self

    def add(self, docs: DataFrame) -> Index:
        """Documents with new ids are added, those with known ids replace what these stood for; old text is not read again."""
        if not self.state.get("segments"):
            return self.build(docs)
        name = self._segment(docs)
        fresh = self._table(name)
        ids = fresh.where("bucket = -1").select("id")
        replaced = keep(self._rows(F.col("bucket") == -1).select("id").join(ids, "id", "left_semi"))
        inc = self._df(fresh).withColumn("sign", F.lit(1))
        gone = None
        if replaced.limit(1).count():
            gone = self._write(replaced, "gone")
            inc = inc.unionByName(self._df(self._rows(F.col("bucket") >= 0).join(replaced, "id", "left_semi")).withColumn("sign", F.lit(-1)))
        change = inc.unionByName(self._table(self.state["terms"]).select("token", "df").withColumn("sign", F.lit(1)))
        terms = change.groupBy("token").agg(F.sum(F.col("df") * F.col("sign")).alias("df")).where("df > 0")
        self._finish([*self.state["segments"], {"name": name, "gone": gone}], terms)
        return self

    def remove(self, ids: DataFrame) -> Index:
        """Documents (id) leave the index."""
        if self.state.get("segments"):
            known = self._rows(F.col("bucket") == -1).select("id").join(ids.select("id"), "id", "left_semi")
            empty = known.select("id", F.array().cast("array<string>").alias("tokens"), F.lit(0).alias("dl")).limit(0)
            gone = keep(known)
            dec = self._df(self._rows(F.col("bucket") >= 0).join(gone, "id", "left_semi")).withColumn("sign", F.lit(-1))
            change = dec.unionByName(self._table(self.state["terms"]).select("token", "df").withColumn("sign", F.lit(1)))
            terms = change.groupBy("token").agg(F.sum(F.col("df") * F.col("sign")).alias("df")).where("df > 0")
            self._finish([*self.state["segments"], {"name": self._segment(empty), "gone": self._write(gone, "gone")}], terms)
        return self

    def compact(self) -> Index:
        """Write the segments as one."""
        rows = self._rows().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(self.salts)).cast("int"))
        rows = rows.repartition((self.buckets + 1) * self.salts, "bucket", "salt").drop("salt")
        s = {"name": self._write(rows.sortWithinPartitions("bucket", "token"), "segment", "bucket"), "gone": None}
        self._finish([s], self._table(self.state["terms"]).select("token", "df"))
        return self

    # ---- asking

    def stats(self, k1: float = bm25.K1, b: float = bm25.B) -> DataFrame:
        """One row: documents, vocabulary, mean length and parameters."""
        s = self.state
        row = [(int(s.get("documents") or 0), int(s.get("vocabulary") or 0), s.get("avgdl"), float(k1), float(b))]
        return self.spark.createDataFrame(row, "documents bigint, vocabulary bigint, avgdl double, k1 double, b double")

    def _idf(self) -> Column:
        return F.when(F.col("raw") < 0, F.lit(bm25.FLOOR) * F.lit(self.state["mean"])).otherwise(F.col("raw"))

    def terms(self) -> DataFrame:
        """(token, df, idf) of the whole vocabulary."""
        return self._table(self.state["terms"]).select("token", "df", self._idf().alias("idf"))

    def document_frequency(self, tokens: list[str]) -> DataFrame:
        """(token, df) of exact tokens, 0 where no document has one."""
        asked = self.spark.createDataFrame([(t,) for t in dict.fromkeys(tokens)], "token string")
        return asked.join(self.terms().where(F.col("token").isin(list(tokens))).select("token", "df"), "token", "left").fillna(0, ["df"])

    def scores(self, queries: DataFrame, k1: float | None = None, b: float | None = None) -> DataFrame:
        """(query_id, id, score) of every document that shares a token with a query."""
        k1, b = (bm25.K1 if k1 is None else float(k1)), (bm25.B if b is None else float(b))
        terms = bm25.query_terms(queries).withColumn("bucket", self._bucket())
        first = terms.limit(ASKED + 1).collect()
        kept = self.spark.createDataFrame(first, terms.schema) if len(first) <= ASKED else keep(terms)
        wanted = {(r.token, r.bucket) for r in first}
        if not self.state.get("vocabulary") or not wanted:
            return kept.select("query_id", F.lit(None).cast(self.id_type).alias("id"), F.lit(0.0).alias("score")).limit(0)
        few = len(first) <= ASKED and len(wanted) <= NAMED
        where = F.col("bucket").isin(sorted({b for _, b in wanted})) & F.col("token").isin(sorted(t for t, _ in wanted)) if few else F.col("bucket") >= 0
        vocabulary = self._table(self.state["terms"])
        weights = (vocabulary.where(where) if few else vocabulary).select("token", self._idf().alias("idf"))
        terms = kept.drop("bucket").join(weights, "token")
        terms = F.broadcast(terms) if few or kept.count() <= bm25.SMALL else terms
        part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(self.state["avgdl"])))
        return self._rows(where).join(terms, "token").groupBy("query_id", "id").agg(F.sum(part).alias("score"))

    def search(self, queries: DataFrame, k: int = 10, k1: float | None = None, b: float | None = None) -> DataFrame:
        """(query_id, id, score, rank): hits with a positive score."""
        return bm25.top_k(self.scores(queries, k1, b).where(F.col("score") > 0), k)
