"""Cutting oversized records at natural boundaries (problem 5).

The separators form a hierarchy: section, paragraph, line, sentence, word, character. A text over the limit is cut by the
coarsest that it holds, what is still over the limit by the next, and so on; the parts are packed
greedily up to the limit, and a piece begins with a stated overlap of the piece before: :func:`natural_points`.

:func:`cut_points` is the rule of whole lines: a blank line is preferred, then a line end, and only inside a line
that is over the limit by itself, characters.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import ship
from corpusmill.sources.tables import latest

LIMIT, FLOOR, OVERLAP = 1000, 500, 200


def cut_points(content: str, limit: int = LIMIT, floor: int = FLOOR, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(first line, last line, first character, character after the last) of each piece, all from 0.

    A piece holds at most ``limit`` characters; it ends at the last blank line that leaves it ``floor``
    characters or more, else at the last line that fits. The next piece repeats the whole lines at its end
    that have at most ``overlap`` characters together. A line over the limit is cut into windows of ``limit``
    characters, each ``limit - overlap`` after the one before. Content within the limit is one piece.
    """
    lines = content.split("\n")
    begin = [0, *accumulate(len(x) + 1 for x in lines)]  # character at which each line begins
    blank = [i for i, x in enumerate(lines) if not x.strip()]
    out: list[tuple[int, int, int, int]] = []
    s, n = 0, len(lines)
    while s < n:
        size = len(lines[s])
        if size > limit:
            at = begin[s]
            while True:
                stop = min(at + limit, begin[s] + size)
                out.append((s, s, at, stop))
                if stop == begin[s] + size:
                    break
                at += limit - overlap
            s += 1
            continue
        e = bisect_right(begin, begin[s] + limit + 1) - 2
        if e < n - 1:
            k = bisect_right(blank, e) - 1
            if k >= 0 and blank[k] >= s and begin[blank[k] + 1] - begin[s] - 1 >= floor:
                e = blank[k]
        out.append((s, e, begin[s], begin[e + 1] - 1))
        if e == n - 1:
            break
        t = bisect_right(begin, max(begin[e + 1] - overlap - 2, begin[e + 2] - limit - 2, begin[s]))
        s = min(t, e + 1)
    return out


#: Where a text may be cut, coarse to fine: after a match. Headings and outermost definitions begin sections.
SEPARATORS = (
    re.compile(r"\n(?=#{1,6} |(?:def|class|function|func|fn|impl|public|export|interface|struct|namespace|module)\b)|\n[^\S\n]*\n(?:[^\S\n]*\n)+"),
    re.compile(r"\n[^\S\n]*\n"),
    re.compile(r"\n"),
    re.compile(r"[.!?;]['\")\]]*\s+|[\u3002\uff01\uff1f]"),
    re.compile(r"\s+|[,:)\]}]"),
)


def natural_points(content: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(first character, character after the last) of each piece, in order; every character is in some piece.

    A piece has at most ``limit`` characters. The next one begins at the earliest line, sentence or word that leaves it
    at most ``overlap`` characters of the piece before and room for what follows; else where that piece ends.
    """
    cuts = [[m.end() for m in p.finditer(content)] for p in SEPARATORS]

    def parts(a: int, b: int, level: int) -> list[tuple[int, int]]:
        if b - a <= limit:
            return [(a, b)]
        if level == len(cuts):
            return [(x, min(x + limit, b)) for x in range(a, b, limit)]
        own = cuts[level][bisect_right(cuts[level], a) : bisect_right(cuts[level], b - 1)]
        ends = [a, *own, b]
        return [q for x, y in zip(ends, ends[1:]) for q in parts(x, y, level + 1)]

    fine = sorted({c for level in cuts[2:] for c in level})
    out: list[tuple[int, int]] = []
    todo = parts(0, len(content), 0) if content else []
    i = 0
    while i < len(todo):
        start = todo[i][0]
        if out:
            end, least = out[-1][1], max(out[-1][1] - overlap, todo[i][1] - limit, out[-1][0] + 1)
            k = bisect_right(fine, least - 1)
            start = fine[k] if k < len(fine) and fine[k] <= end else end
        while i < len(todo) and todo[i][1] - start <= limit:
            i += 1
        out.append((start, todo[i - 1][1]))
    return out


def natural_pieces(df: DataFrame, key: str = "id", version: str = "indexed_at", content: str = "content", first_line: str = "start_line", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, start_line, end_line, from_char, to_char) of each record over the limit, cut by the whole hierarchy.

    Records, nulls and what is shuffled are as in :func:`split_records`.
    """

    def points(text: str) -> list[tuple[int, int, int, int]]:
        ends = [m.start() for m in re.finditer("\n", text)]
        line = lambda at: bisect_right(ends, at - 1)
        return [(line(a), line(max(a, b - 1)), a, b) for a, b in natural_points(text, limit, overlap)]

    return _pieces(df, key, version, content, first_line, limit, points)


def split_records(df: DataFrame, key: str = "id", version: str = "indexed_at", content: str = "content", first_line: str = "start_line", limit: int = LIMIT, floor: int = FLOOR, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, start_line, end_line, from_char, to_char) of each record whose content is over the limit.

    The record of a key is its row of the latest ``version``. Rows are cut before that is settled, so
    content never crosses the network: only line numbers are shuffled, combined on the map side.
    Null content is no case; a null first line counts as 1; a null key is dropped; other columns are ignored.
    """
    return _pieces(df, key, version, content, first_line, limit, lambda x: cut_points(x, limit, floor, overlap))


def _pieces(df: DataFrame, key: str, version: str, content: str, first_line: str, limit: int, points: Callable[[str], list[tuple[int, int, int, int]]]) -> DataFrame:
    ship(df.sparkSession)
    pieces = pa.list_(pa.struct([(x, pa.int32()) for x in ("s", "e", "f", "t")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [None if x is None else [dict(zip("seft", p)) for p in points(x)] for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cuts, pieces)], ["key", "version", "first", "cuts"])

    kinds = {x: df.schema[x].dataType.simpleString() for x in (key, version)}
    over = F.when(F.char_length(content) > limit, F.col(content))
    rows = df.select(F.col(key).alias("key"), F.col(version).alias("version"), F.coalesce(F.col(first_line), F.lit(1)).cast("int").alias("first"), over.alias("over"))
    cuts = rows.mapInArrow(run, f"key {kinds[key]}, version {kinds[version]}, first int, cuts array<struct<s:int,e:int,f:int,t:int>>")
    return (
        latest(cuts, "key", "version")
        .select(F.col("key").alias(key), "first", F.posexplode("cuts").alias("piece_no", "p"))
        .select(key, "piece_no", (F.col("first") + F.col("p.s")).alias("start_line"), (F.col("first") + F.col("p.e")).alias("end_line"), F.col("p.f").alias("from_char"), F.col("p.t").alias("to_char"))
    )
