"""Schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

METADATA = T.StructType(
    [
        T.StructField("file_size", T.LongType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("ast_node_type", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
    ]
)
FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("absolute_path", T.StringType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("last_modified", T.DoubleType()),
        T.StructField("content", T.StringType()),
    ]
)
CHUNKS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("language", T.StringType()),
        T.StructField("chunk_type", T.StringType()),
        T.StructField("metadata", METADATA),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
NODES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("file_path", T.StringType()),
        T.StructField("line_number", T.IntegerType()),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("target_id", T.StringType()),
        T.StructField("relationship_type", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    ]
)
EDGE_TYPES = ("CONTAINS", "DEFINED_IN", "CALLS", "INHERITS_FROM", "HAS_METHOD")
NODE_TYPES = ("File", "Chunk", "Function", "Class")
