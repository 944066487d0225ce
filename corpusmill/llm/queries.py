"""The registered queries of this subpackage. Each reads its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import abuse, credentials, foreign_files, near_duplicates, packing, similar_vectors, splitting, syntax, tokens
from corpusmill.llm.sql import SQL as SQL
from corpusmill.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors.neighbour_pairs(similar_vectors.nearest(table(spark, sf_dir, "chunks")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.NearDuplicates(table(spark, sf_dir, "chunks")).pairs()


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.NearDuplicates(table(spark, sf_dir, "chunks")).groups()


def p2_groups_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.NearDuplicates(table(spark, sf_dir, "chunks"), weighted=True).groups()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foreign_files.foreign(table(spark, sf_dir, "files")).select("path")


def p3_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foreign_files.foreign(table(spark, sf_dir, "files"))


def p3_hand_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foreign_files.hand_written(table(spark, sf_dir, "files"))


def _credentials(spark: SparkSession, sf_dir: str) -> tuple[credentials.Model, DataFrame, DataFrame]:
    files, chunks = table(spark, sf_dir, "files"), table(spark, sf_dir, "chunks")
    return credentials.fit_model([(files, "path", "path"), (chunks, "id", "file_path")]), files, chunks


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, files, chunks = _credentials(spark, sf_dir)
    of_files = credentials.find(files, model, "path", "scanned_at", "path")
    of_chunks = credentials.find(chunks, model, "id", "indexed_at", "file_path")
    both = of_files.withColumn("table_name", F.lit("files")).unionByName(of_chunks.withColumn("table_name", F.lit("chunks")))
    return both.select("table_name", "record_key", "line_no")


def p4_redacted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, files, _ = _credentials(spark, sf_dir)
    return credentials.redacted(files, model, "path", "scanned_at", "path")


def p4_redacted_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _, chunks = _credentials(spark, sf_dir)
    return credentials.redacted(chunks, model, "id", "indexed_at", "file_path")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_records(table(spark, sf_dir, "chunks"))
    return pieces.select("id", "piece_no", "start_line", "end_line")


def p5_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.natural_pieces(table(spark, sf_dir, "chunks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.judged(table(spark, sf_dir, "files")).where("invalid").select("path")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.rates(table(spark, sf_dir, "files"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_texts(table(spark, sf_dir, "documents"))


def p8_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokens.count_tokens(table(spark, sf_dir, "documents")))


def _abuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return abuse.score_documents(documents, abuse.fit_model(documents, table(spark, sf_dir, "abuse_labels")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse(spark, sf_dir).where("flagged").select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse(spark, sf_dir)


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "abuse_labels"), by="source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p2_groups_weighted": p2_groups_weighted,
    "p3_found": p3_found,
    "p3_kinds": p3_kinds,
    "p3_hand_written": p3_hand_written,
    "p4_found": p4_found,
    "p4_redacted_files": p4_redacted_files,
    "p4_redacted_chunks": p4_redacted_chunks,
    "p5_found": p5_found,
    "p5_natural": p5_natural,
    "p6_found": p6_found,
    "p6_rates": p6_rates,
    "p7_ids": p7_ids,
    "p8_bins": p8_bins,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_rates": p9_rates,
}
