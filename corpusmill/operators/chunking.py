"""Cutting files into chunks: by lines, by syntax, and by a hierarchy of separators."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as fx
from corpusmill.operators import outline
from corpusmill.runtime import keep, ship

LINES_PER_CHUNK = 20
#: Separators, coarse to fine, by language.
_PLAIN = ["\n\n", "\n", " ", ".", ",", "\t"]
SEPARATORS = {
    "python": ["\n\n\n", "\n\n", "\ndef ", "\nclass ", "\n    ", "\n", " ", ".", ",", "\t"],
    "javascript": ["\n\n\n", "\n\n", "\nfunction ", "\nclass ", "\nconst ", "\nlet ", "\nvar ", "\n    ", "\n", " ", ".", ",", "\t"],
}
SEPARATORS["typescript"] = SEPARATORS["javascript"]

CHUNK_SCHEMA = "id string, file_path string, content string, start_line int, end_line int, language string, chunk_type string, metadata struct<file_size:bigint,file_type:string,ast_node_type:string,chunk_index:int>"


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    """md5 of 'path:start-end'."""
    return F.md5(F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))


def _ready(files: DataFrame) -> DataFrame:
    return files.where(F.col("content").isNotNull() & (F.col("content") != "") & F.col("language").isNotNull())


def line_chunks(files: DataFrame, lines_per_chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """Chunks of a fixed number of lines without overlap. Files without content or language give none.

    A file is cut inside its row, so no line crosses the network.
    """
    n = F.size("lines")
    starts = F.sequence(F.lit(0), n - 1, F.lit(lines_per_chunk))
    cut = _ready(files).withColumn("lines", fx.lines(F.col("content"))).select("*", F.posexplode(starts).alias("index", "at"))
    part = F.slice("lines", F.col("at") + 1, F.lit(lines_per_chunk))
    start, end = F.col("at") + 1, F.least(F.col("at") + lines_per_chunk, n)
    meta = F.struct(F.col("size").alias("file_size"), F.col("file_type"), F.lit(None).cast("string").alias("ast_node_type"), F.col("index").alias("chunk_index"))
    return cut.select(
        chunk_id(F.col("path"), start, end).alias("id"), F.col("path").alias("file_path"), F.array_join(part, "\n").alias("content"),
        start.alias("start_line"), end.alias("end_line"), "language", F.lit("line_chunk").alias("chunk_type"), meta.alias("metadata"),
    )


def python_spans(source: str) -> list[tuple[str, int, int]]:
    """(kind, first line, last line) of every function and class, outer before inner; none for broken source."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[tuple[str, int, int]] = []

    def walk(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(("function_definition", child.lineno, child.end_lineno))
            elif isinstance(child, ast.ClassDef):
                out.append(("class_definition", child.lineno, child.end_lineno))
            walk(child)

    walk(tree)
    return out


#: Languages with syntax chunks: Python by its parser, the others by :mod:`corpusmill.operators.outline`.
SYNTAX_LANGUAGES = ("python", "javascript", "typescript", "c", "cpp")


def syntax_spans(source: str, language: str) -> list[tuple[str, int, int]]:
    """(kind, first line, last line) of the functions, classes and methods of a file; none for broken source."""
    return python_spans(source) if language == "python" else outline.blocks(source, language)


def syntax_chunks(files: DataFrame) -> DataFrame:
    """Functions, classes and methods of files as chunks of whole lines; nested ones overlap their parents.

    Python gives functions and classes, JavaScript and TypeScript methods, C and C++ functions. Files in other
    languages, without content, or that do not parse give none.
    """
    ship(files.sparkSession)
    rows = _ready(files).where(F.col("language").isin(*SYNTAX_LANGUAGES)).select("path", "content", "size", "file_type", "language")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, content, size, kind, language in f.itertuples(index=False):
                lines = content.split("\n")
                for i, (node, a, b) in enumerate(syntax_spans(content, language)):
                    out.append((path, "\n".join(lines[a - 1 : b]), a, b, node, i, size, kind, language))
            yield pd.DataFrame(out, columns=["path", "content", "a", "b", "node", "i", "size", "kind", "language"])

    cut = rows.mapInPandas(run, "path string, content string, a int, b int, node string, i int, size bigint, kind string, language string")
    return _records(cut, F.col("node"), F.col("node"))


def _records(cut: DataFrame, chunk_type: Column, node: Column) -> DataFrame:
    """Chunk records of (path, content, a, b, i, size, kind, language)."""
    meta = F.struct(F.col("size").alias("file_size"), F.col("kind").alias("file_type"), node.alias("ast_node_type"), F.col("i").alias("chunk_index"))
    return cut.select(
        chunk_id(F.col("path"), F.col("a"), F.col("b")).alias("id"), F.col("path").alias("file_path"), "content", F.col("a").alias("start_line"), F.col("b").alias("end_line"),
        "language", chunk_type.alias("chunk_type"), meta.alias("metadata"),
    )


def split_text(text: str, size: int = 1000, overlap: int = 200, separators: list[str] | None = None) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that serves, with trailing overlap.

    A separator stays at the beginning of the piece it opens. Pieces are stripped, empty ones dropped; text
    without any separator is cut by characters.
    """
    separators = _PLAIN if separators is None else separators
    at = next((i for i, s in enumerate(separators) if s in text), None)
    if at is None:
        parts, finer = list(text), []
    else:
        first, *rest = text.split(separators[at])
        parts, finer = [x for x in [first, *(separators[at] + r for r in rest)] if x], separators[at + 1 :]
    out: list[str] = []
    window: list[str] = []
    held = 0

    def flush() -> None:
        piece = "".join(window).strip()
        if piece:
            out.append(piece)

    for p in parts:
        if len(p) >= size and at is not None and len(p) > size:
            if window:
                flush()
                window, held = [], 0
            out += split_text(p, size, overlap, finer)
            continue
        if held + len(p) > size and window:
            flush()
            while window and (held > overlap or held + len(p) > size):
                held -= len(window.pop(0))
        window.append(p)
        held += len(p)
    if window:
        flush()
    return out


def text_chunks(files: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Files cut by the separators of their language, as chunk records of the type text_chunk.

    start_line is that of the first place at which the piece occurs, as in the line rule of chunks; end_line follows
    from the lines of the piece. Of pieces with the same lines, and so the same id, the one of least chunk_index stands
    in a store; here every piece is a row.
    """
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, content, size_, kind, language in f.itertuples(index=False):
                for i, piece in enumerate(split_text(content, size, overlap, SEPARATORS.get(language))):
                    a = content.count("\n", 0, max(content.find(piece), 0)) + 1
                    out.append((path, piece, a, a + piece.count("\n"), i, size_, kind, language))
            yield pd.DataFrame(out, columns=["path", "content", "a", "b", "i", "size", "kind", "language"])

    rows = _ready(files).select("path", "content", "size", "file_type", "language")
    cut = rows.mapInPandas(run, "path string, content string, a int, b int, i int, size bigint, kind string, language string")
    return _records(cut, F.lit("text_chunk"), F.lit(None).cast("string"))


def chunks(files: DataFrame, fallback: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """Syntax chunks of files; files that have none are cut as text or by lines, or give nothing, by ``fallback``.

    ``files`` must be kept: they are read once for syntax and once for the rest.
    """
    if fallback not in ("text", "line", "none"):
        raise ValueError(f"unknown way of cutting: {fallback}")
    own = syntax_chunks(files)
    if fallback == "none":
        return own
    own = keep(own)
    rest = files.join(own.select(F.col("file_path").alias("path")).distinct(), "path", "left_anti")
    cut = text_chunks(rest, size, overlap) if fallback == "text" else line_chunks(rest)
    first = cut.groupBy("id").agg(F.min(F.struct("metadata.chunk_index", *[c for c in cut.columns if c != "id"])).alias("r"))
    return own.unionByName(first.select("id", *[f"r.{c}" for c in cut.columns if c != "id"]))
