"""Functions and classes of chunks, by one anchored pattern a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as fx

_ID = "([a-zA-Z_][a-zA-Z0-9_]*)"
#: Patterns by language and kind of entity, each with the name as its group.
FUNCTIONS = {
    "python": [rf"^\s*def\s+{_ID}\s*\(", rf"^\s*async\s+def\s+{_ID}\s*\("],
    "javascript": [rf"^\s*function\s+{_ID}\s*\(", rf"^\s*{_ID}\s*:\s*function\s*\(", rf"^\s*{_ID}\s*=>\s*"],
    "java": [rf"^\s*(?:public|private|protected)?\s*(?:static)?\s*\w+\s+{_ID}\s*\("],
    "cpp": [rf"^\s*\w+\s+{_ID}\s*\("],
    "go": [rf"^\s*func\s+{_ID}\s*\("],
}
FUNCTIONS["typescript"] = FUNCTIONS["javascript"]
CLASSES = {
    "python": [rf"^\s*class\s+{_ID}\s*[:\(]"],
    "javascript": [rf"^\s*class\s+{_ID}\s*[{{(]"],
    "java": [rf"^\s*(?:public|private|protected)?\s*class\s+{_ID}\s*[{{(]"],
    "cpp": [rf"^\s*class\s+{_ID}\s*[{{:]"],
    "go": [rf"^\s*type\s+{_ID}\s+struct\s*\{{"],
}
CLASSES["typescript"] = CLASSES["javascript"]


def _names(line: Column, language: Column, patterns: dict[str, list[str]]) -> Column:
    """Names that the patterns of the row's language find in a line."""
    hit = None
    for lang, own in patterns.items():
        found = F.filter(F.array(*[F.regexp_extract(line, p, 1) for p in own]), lambda x: x != "")
        hit = F.when(language == lang, found) if hit is None else hit.when(language == lang, found)
    return hit.otherwise(F.array().cast("array<string>"))


def entities(chunks: DataFrame) -> DataFrame:
    """(chunk_id, file_path, kind, name, id, line_number, offset): kind is Function or Class, id 'path::name'.

    Lines stay in their row until names are found; chunks in other languages, or without content, have none.
    """
    known = chunks.where(F.col("content").isNotNull() & F.col("language").isin(*FUNCTIONS))
    line = known.select("id", "file_path", "language", F.coalesce("start_line", F.lit(1)).alias("start"), F.posexplode(fx.lines(F.col("content"))).alias("offset", "line"))
    line = line.where(F.col("line").rlike("[(:{]|=>"))
    kinds = F.array(
        F.struct(F.lit("Function").alias("kind"), _names(F.col("line"), F.col("language"), FUNCTIONS).alias("names")),
        F.struct(F.lit("Class").alias("kind"), _names(F.col("line"), F.col("language"), CLASSES).alias("names")),
    )
    found = line.select("*", F.explode(kinds).alias("k")).select("*", F.explode("k.names").alias("name"))
    return found.select(
        F.col("id").alias("chunk_id"), "file_path", F.col("k.kind").alias("kind"), "name", F.concat("file_path", F.lit("::"), "name").alias("id"), (F.col("start") + F.col("offset")).alias("line_number"), "offset"
    )
