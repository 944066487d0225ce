"""Scalar functions over text and paths, as Column expressions that stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- tokens

_SEPARATORS = r"[^\p{L}\p{N}_\s.]"


def tokens(text: Column) -> Column:
    """Lower-cased words of two characters or more; letters, digits, '_' and '.' survive. Null text: null."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), _SEPARATORS, " "), r"\s+"), lambda x: F.char_length(x) > 1)


def tokenize(text: str) -> list[str]:
    """The same for one string on the driver, such as a query."""
    return [x for x in re.sub(r"[^\w\s.]", " ", text.lower()).split() if len(x) > 1]


# ---------------------------------------------------------------- paths

#: Language, kind of file, and kind of file in the graph, by suffix.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".cpp": "cpp", ".c": "c", ".go": "go", ".rs": "rust", ".sh": "shell", ".rb": "ruby",
    ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".dart": "dart", ".html": "html", ".css": "css", ".scss": "scss", ".sass": "sass", ".less": "less",
    ".vue": "vue", ".jsx": "jsx", ".tsx": "tsx", ".md": "markdown", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".xml": "xml", ".sql": "sql",
}
FILE_TYPES = {
    "code": ".py .js .ts .java .cpp .c .go .rs .sh .rb .php .swift .kt .scala .dart",
    "documentation": ".md .txt .rst .doc .docx",
    "configuration": ".json .yaml .yml .xml .ini .cfg .toml .conf .properties",
    "markup": ".html .css .scss .sass .less .vue .jsx .tsx",
}
GRAPH_FILE_TYPES = {
    "source": ".py .js .ts .jsx .tsx .java .cpp .c .h .go .rs .rb .php .swift .kt .scala .dart",
    "documentation": ".md .txt .rst",
    "config": ".json .yaml .yml .xml",
    "web": ".html .css .scss .sass",
    "database": ".sql",
    "script": ".sh .bat .ps1",
}


def suffix(path: Column) -> Column:
    """Last suffix of the file name, lower case, with its dot; '' if there is none. A leading dot begins no suffix."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def _by_suffix(path: Column, table: dict[str, str], default: str | None) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), suffix(path)), F.lit(default))


def language(path: Column) -> Column:
    """Language by suffix, null for an unknown one."""
    return _by_suffix(path, LANGUAGES, None)


def file_type(path: Column) -> Column:
    return _by_suffix(path, {s: k for k, v in FILE_TYPES.items() for s in v.split()}, "unknown")


def graph_file_type(path: Column) -> Column:
    return _by_suffix(path, {s: k for k, v in GRAPH_FILE_TYPES.items() for s in v.split()}, "other")


def base_name(path: Column) -> Column:
    """Label of a node: what follows the last '::', else the last part of the path."""
    return F.when(path.contains("::"), F.element_at(F.split(path, "::"), -1)).otherwise(F.element_at(F.split(path, "/"), -1))


# ---------------------------------------------------------------- content


def lines(content: Column) -> Column:
    return F.split(content, "\n", -1)


def snippet(content: Column, length: int = 200) -> Column:
    """The first characters, with '...' where something was left out."""
    return F.when(F.char_length(content) > length, F.concat(F.left(content, F.lit(length)), F.lit("..."))).otherwise(content)


def line_of(content: Column, part: Column) -> Column:
    """1-based line on which ``part`` first occurs, 1 if it does not occur."""
    at = F.instr(content, part)
    before = F.substring(content, F.lit(1), at - 1)
    return F.when(at > 0, F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).otherwise(1)


#: Words that count as control structures.
CONTROL_WORDS = ("if", "else", "elif", "for", "while", "try", "except", "catch", "switch")


def complexity(content: Column) -> Column:
    """Control words per line, each word once a line wherever it stands, plus a quarter of the deepest indent, per 1000 characters, at most 1."""
    words = F.aggregate(lines(F.lower(content)), F.lit(0), lambda n, x: n + sum((x.contains(w).cast("int") for w in CONTROL_WORDS), F.lit(0)))
    indent = F.array_max(F.transform(lines(content), lambda x: F.when(x.rlike(r"\S"), F.char_length(x) - F.char_length(F.regexp_replace(x, r"^\s+", ""))).otherwise(0)))
    score = words + F.floor(indent / 4)
    return F.when(F.char_length(content) > 0, F.least(score / (F.char_length(content) / F.lit(1000.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def documentation(content: Column) -> Column:
    """Lines that begin a comment or hold a triple quote, per line that is not blank, at most 1."""
    doc = F.size(F.filter(lines(content), lambda x: x.rlike(r"^\s*(#|//|/\*)") | x.contains('"""') | x.contains("'''")))
    all_ = F.size(F.filter(lines(content), lambda x: x.rlike(r"\S")))
    return F.when(all_ > 0, F.least(doc / all_, F.lit(1.0))).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- queries

#: What a query says about itself; 'class' counts twice.
KEYWORD_SIGNS = ("function", "class", "method", "variable", "import", "def", "class")
SEMANTIC_SIGNS = ("how to", "what is", "explain", "implement", "algorithm", "pattern")


def query_type(query: Column) -> Column:
    """'semantic', 'keyword' or 'mixed', by which signs occur more."""
    low = F.lower(query)
    k = sum((low.contains(x).cast("int") for x in KEYWORD_SIGNS), F.lit(0))
    s = sum((low.contains(x).cast("int") for x in SEMANTIC_SIGNS), F.lit(0))
    return F.when(s > k, "semantic").when(k > s, "keyword").otherwise("mixed")
