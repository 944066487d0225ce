"""Encoding every text with a public vocabulary (problem 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import byte_bpe
from corpusmill.runtime import ship

#: Texts handed to the encoder at once; bounds a worker's memory, not the result.
_AT_ONCE = 256


def _sent(spark: SparkSession, vocabulary: str):
    """The vocabulary as a broadcast (some 50,000 short entries), so that only the driver needs the file."""
    ship(spark)
    return spark.sparkContext.broadcast((vocabulary, byte_bpe.read_ranks(vocabulary)))


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = byte_bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids): the ids of each text, without special tokens, one row per input row, no shuffle.

    A null and an empty text both have the empty list. Blank texts are encoded as they stand; text that
    spells a special token is ordinary text; repeated rows give repeated rows; other columns are ignored.
    """
    held = _sent(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.built(*held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(at, _AT_ONCE)
                offsets, ids = bpe.encode_batch(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = byte_bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """(key, n_tokens): the number of ids of each text; 0 for a null or empty text."""
    held = _sent(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.built(*held.value)
        for batch in batches:
            n = bpe.count_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64))], ["key", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens bigint")
    return out.withColumnRenamed("key", key)


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = byte_bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """(key, text): the texts of lists of ids; the exact inverse of :func:`encode_texts` for valid text, '' for no ids."""
    held = _sent(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.built(*held.value)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string")
    return out.withColumnRenamed("key", key)
