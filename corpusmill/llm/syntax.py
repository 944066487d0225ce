"""Source files that do not parse (problem 6): flags per file, rates per repository and language."""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import syntax_grammar, syntax_lex
from corpusmill.runtime import ship
from corpusmill.sources.tables import latest

#: Languages whose files are never cases, beside those without a grammar here.
NEVER = {"markdown", "css", "sql", "html", "text"}

# ---------------------------------------------------------------- Python and JSON

_GOES_ON = re.compile(r"(?:else|elif|except|finally)\b|[)\]}]|#")


def python_statements(text: str) -> list[str]:
    """A module cut into its top-level statements; a cut is taken back while strings or brackets stay open."""
    lines = text.split("\n")
    out: list[str] = []
    start = 0
    held = False  # a decorator or a backslash waits for the next line
    for i, line in enumerate(lines):
        if i and line[:1] not in ("", " ", "\t", "\r", "\f") and not _GOES_ON.match(line) and not held:
            part = "\n".join(lines[start:i])
            if syntax_lex.sound(part, "python"):
                out.append(part)
                start = i
        held = line.startswith("@") or line.rstrip("\r").endswith("\\") or held and (not line.strip() or line.lstrip().startswith("#"))
    out.append("\n".join(lines[start:]))
    return out


def _parses(text: str) -> bool | None:
    """None where the parser gives up on the depth of a text, which says nothing of its validity."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError):
        return False
    except (MemoryError, RecursionError):
        return None


def _all(verdicts: Iterable[bool | None]) -> bool | None:
    """False if one is False, else None if one is None."""
    known = True
    for v in verdicts:
        if v is False:
            return False
        known = known and v
    return known


def python_valid(text: str) -> bool | None:
    if text.startswith("\ufeff"):
        text = text[1:]
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\0" in text:
        return False
    if syntax_lex.sound(text, "python"):
        return _all(_parses(x) for x in python_statements(text) if x.strip())
    return _parses(text)  # the exact check of what the lexer doubts


def json_valid(text: str) -> bool:
    def no(x: str) -> None:
        raise ValueError(x)

    if not syntax_lex.sound(text, "json"):
        return False
    try:
        json.loads(text, parse_constant=no)
        return True
    except ValueError:
        return False
    except RecursionError:
        return _deep_json(text)


_JSON_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\]:,])|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)')


def _deep_json(text: str) -> bool:
    """Strict JSON of any depth, by a stack of its own."""
    stack: list[str] = []
    wants = "value"  # what may come: value, first (value or ']'), key, first key (key or '}'), ':', next (',' or a closer), end
    at, n = 0, len(text.rstrip(" \t\n\r"))
    while at < n:
        m = _JSON_TOKEN.match(text, at)
        if not m or m.end() == at:
            return False
        at, mark, token = m.end(), m[1], m[0].lstrip(" \t\n\r")
        if wants in ("value", "first") and mark in (None, "{", "["):
            if mark:
                stack.append(mark)
                wants = "first key" if mark == "{" else "first"
            else:
                wants = "next" if stack else "end"
        elif wants in ("key", "first key") and token[0] == '"':
            wants = ":"
        elif wants == ":" and mark == ":":
            wants = "value"
        elif wants == "next" and mark == ",":
            wants = "key" if stack[-1] == "{" else "value"
        elif mark and stack and (wants in ("next", "first") and mark == "]" and stack[-1] == "[" or wants in ("next", "first key") and mark == "}" and stack[-1] == "{"):
            stack.pop()
            wants = "next" if stack else "end"
        else:
            return False
    return wants == "end"


# ---------------------------------------------------------------- shell

_HEREDOC = re.compile(r"<<(-?)[ \t]*(?:\\?([A-Za-z_]\w*)|'([^'\n]+)'|\"([^\"\n]+)\")")
_SHELL_QUOTE = re.compile(r"\\.|'[^']*'|\$'(?:[^'\\]|\\.)*'|(?:(?<=[\s;&|(])|^)#[^\n]*|\"|'|\$\(\(|\$\(|`|\$\{[^}]*\}", re.S | re.M)
_SHELL_TOKEN = re.compile(r"\n|;;&|;;|;&|;|&&|\|\||\|&|\||&|\(|\)|[<>]+[&|]?|[^\s;&|()<>]+")
_OPENS = {"if": "fi", "case": "esac", "for": "done", "while": "done", "until": "done", "select": "done", "{": "}"}


def _shell_plain(text: str) -> str | None:
    """Text with here-documents, comments and quoted strings taken out; None if a quote stays open."""
    out: list[str] = []
    lines = text.replace("\r\n", "\n").split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        out.append(line)
        if "<<" in line and "<<<" not in line and (m := _HEREDOC.search(line)):
            word = m[2] or m[3] or m[4]
            while i < len(lines) and (lines[i].lstrip("\t") if m[1] else lines[i]) != word:
                i += 1
            i += 1
            out[-1] = line[: m.start()] + " " + line[m.end() :]
    text, at, done = "\n".join(out), 0, []
    while m := _SHELL_QUOTE.search(text, at):
        done.append(text[at : m.start()])
        at = m.end()
        q = m[0]
        if q == '"':
            depth, k = 0, at
            while k < len(text):
                if text[k] == "\\":
                    k += 1
                elif text.startswith("$(", k):
                    depth += 1
                    k += 1
                elif text[k] == ")" and depth:
                    depth -= 1
                elif text[k] == '"' and not depth:
                    break
                k += 1
            if k >= len(text):
                return None
            at = k + 1
            done.append("Q")
        elif q == "'":
            return None
        elif q == "`":
            k = text.find("`", at)
            if k < 0:
                return None
            at = k + 1
            done.append("Q")
        elif q == "$((":
            k = text.find("))", at)
            if k < 0:
                return None
            at = k + 2
            done.append("Q")
        elif q == "$(":
            done.append(" Q(")
        elif q[0] == "#":
            pass
        else:
            done.append("Q")
    done.append(text[at:])
    return "".join(done)


def shell_valid(text: str) -> bool:
    if syntax_grammar.MERGE.search(text) or "\0" in text:
        return False
    plain = _shell_plain(text)
    if plain is None:
        return False
    plain = re.sub(r"\\\n", " ", plain)
    plain = re.sub(r"\[\[.*?\]\]", "Q", plain, flags=re.S)
    stack: list[str] = []
    command, prev = True, "\n"
    tokens = _SHELL_TOKEN.findall(plain)
    for i, t in enumerate(tokens):
        after = tokens[i + 1] if i + 1 < len(tokens) else "\n"
        top = stack[-1] if stack else ""
        if t == "(":
            word = prev not in ("\n", ";", "&&", "||", "|", "&", "(", "do", "then", "else", "{", "!", "if", "while", ";;", "in")
            if word and not (after == ")" or prev.endswith("=") or prev == "Q" or prev[0] in "<>" or prev.endswith("Q") or top in ("esac", "esac-in")):
                return False
            stack.append(")")
            command = True
        elif t == ")":
            if top == ")":
                stack.pop()
            elif top != "esac":
                return False
            command = True
        elif t in (";;", ";&", ";;&"):
            if top != "esac":
                return False
            command = True
        elif t in ("\n", ";", "&&", "||", "|", "&", "|&"):
            if t in ("&&", "||", "|", ";", "|&") and prev in ("&&", "||", "|", "(", "|&") or t == ";" and prev in (";", "do", "then", "else", "{"):
                return False
            command = True
        elif t[0] in "<>":
            if after == "\n" or after in (";", "&&", "||", ")", "|") or after[0] in "<>" and len(t) < 3:
                return False
            command = False
        elif command and t in _OPENS:
            stack.append(_OPENS[t])
            command = t in ("if", "while", "until", "{")
        elif command and t in ("fi", "done", "esac", "}"):
            if top != t:
                return False
            stack.pop()
            command = False
        elif command and t in ("then", "else", "elif"):
            if top != "fi" or t == "then" and prev not in (";", "\n"):
                return False
            command = True
        elif command and t == "do":
            if top != "done":
                return False
            command = True
        elif t == "!" and command or command and re.match(r"\w+\+?=", t):
            command = True
        else:
            command = False
        prev = t
    return not stack


# ---------------------------------------------------------------- YAML

_YAML_KEY = re.compile(r"(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s#\[\]{}&*!|>'\"%@`,?:\-][^#\n]*?|[?:\-][^\s#][^#\n]*?|<<)[ \t]*:(?=[ \t]|$)")


def yaml_valid(text: str) -> bool:
    """Whether block mappings, sequences, scalars and flow collections line up; anchors and tags are let pass."""
    text = text.replace("\r\n", "\n").lstrip("\ufeff")
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", text) or re.search(r"^(?:<{7}|>{7})", text, re.M):
        return False
    lines = text.split("\n")
    levels: list[tuple[int, str]] = []  # (indent, kind)
    wants: int | None = None  # indent of a key whose value may follow below
    plain_at: int | None = None  # indent of the node whose plain scalar may go on
    i = 0

    def flow_end(s: str, i: int) -> tuple[str, int] | None:
        """Rest after a quoted scalar or flow collection that begins ``s``, and the line it ends on."""
        stack, k = [], 0
        while True:
            while k < len(s):
                c = s[k]
                if c == '"':
                    m = re.compile(r'"(?:[^"\\]|\\.)*"', re.S).match(s, k)
                    if not m:
                        break
                    k = m.end()
                    if not stack:
                        return s[k:], i
                    continue
                if c == "'" and (not k or s[k - 1] in " \t\n[{,:"):
                    m = re.compile(r"'(?:[^']|'')*'", re.S).match(s, k)
                    if not m:
                        break
                    k = m.end()
                    if not stack:
                        return s[k:], i
                    continue
                if c in "[{":
                    stack.append(c)
                elif c in "]}":
                    if not stack or stack.pop() != ("[" if c == "]" else "{"):
                        return None
                    if not stack:
                        return s[k + 1 :], i
                elif c == "#" and k and s[k - 1] in " \t\n":
                    e = s.find("\n", k)
                    k = len(s) if e < 0 else e
                    continue
                k += 1
            i += 1
            if i >= len(lines):
                return None
            s += "\n" + lines[i]

    while i < len(lines):
        line = lines[i]
        body = line.strip()
        if not body or body[0] == "#":
            i += 1
            continue
        if line.startswith(("---", "...")) and (len(body) == 3 or line[3] in " \t"):
            levels, wants, plain_at = [], None, None
            i += 1
            continue
        if body[0] == "%" and not levels:
            i += 1
            continue
        indent = len(line) - len(line.lstrip(" "))
        rest = line[indent:]
        if rest[0] == "\t" and not plain_at:
            return False
        if plain_at is not None and indent > plain_at:
            if not _YAML_KEY.match(rest):
                i += 1
                continue
            return False  # a mapping inside a scalar
        plain_at = None
        while levels and levels[-1][0] > indent:
            levels.pop()
        if levels and levels[-1][0] < indent and (wants is None or indent <= wants):
            return False
        if not levels or levels[-1][0] < indent:
            if levels and wants is None:
                return False
            levels.append((indent, ""))
        wants = None
        at = indent
        while True:  # along "- - key: value"
            if rest[:1] == "-" and (len(rest) == 1 or rest[1] in " \t"):
                if levels[-1][1] == "map" and levels[-1][0] == at:
                    levels.append((at, "seq"))  # a sequence may stand at its key's indent
                elif not levels[-1][1]:
                    levels[-1] = (at, "seq")
                after = rest[1:].lstrip(" ")
                wants = at
                if not after or after[0] == "#":
                    break
                at += len(rest) - len(after)
                rest = after
                if rest[0] == "-" and (len(rest) == 1 or rest[1] == " ") or _YAML_KEY.match(rest):
                    levels.append((at, ""))
                    continue
            m = _YAML_KEY.match(rest)
            if m:
                while len(levels) > 1 and levels[-1][0] == at and levels[-1][1] == "seq":
                    levels.pop()
                if not levels[-1][1]:
                    levels[-1] = (at, "map")
                elif levels[-1][1] != "map":
                    return False
                rest = rest[m.end() :].strip()
                wants = at
                if not rest or rest[0] == "#":
                    break
            elif levels[-1][1] == "map" and levels[-1][0] == at:
                return False
            value = re.sub(r"^(?:[&!][^\s]*\s*)+", "", rest).strip()
            if not value or value[0] == "#":
                break
            wants = None
            if value[0] in "|>":
                if not re.match(r"[|>][+\-0-9]{0,2}\s*(?:#.*)?$", value):
                    return False
                base = levels[-1][0] if m else at - 1
                while i + 1 < len(lines) and (not lines[i + 1].strip() or len(lines[i + 1]) - len(lines[i + 1].lstrip(" ")) > (base if m else levels[-1][0])):
                    i += 1
            elif value[0] in "\"'[{":
                e = flow_end(value, i)
                if e is None:
                    return False
                tail, i = e
                tail = tail.strip()
                if tail and tail[0] != "#":
                    return False
            elif value[0] in "@`%" or value[0] in ",]}":
                return False
            else:
                plain = re.split(r"\s#", value)[0]
                if re.search(r":(?:\s|$)", plain) and value[0] != "*":
                    return False
                plain_at = levels[-1][0] if m or levels[-1][1] == "seq" else at - 1
            break
        i += 1
    return True


# ---------------------------------------------------------------- all languages


def valid(text: str, language: str) -> bool | None:
    """Whether a whole content is valid in a language; None where no grammar is known."""
    if language == "python":
        return python_valid(text)
    if language == "json":
        return json_valid(text)
    if language == "shell":
        return shell_valid(text)
    if language == "yaml":
        return yaml_valid(text)
    if language in syntax_grammar.GRAMMARS:
        if _brace_valid(text, language):
            return True
        # what seems broken is judged again without what the lexer does not know
        if language in ("javascript", "typescript"):
            # quotes and brackets inside regular expressions are none; templates hold expressions, and these templates
            plain = _REGEX.sub(r'\1""', text)
            if plain != text and _brace_valid(plain, language):
                return True
            if "`" in text:
                flat = syntax_lex.without_templates(text)
                flat = None if flat is None else _REGEX.sub(r'\1""', flat)
                return flat is not None and _brace_valid(flat, language)
        elif language == "rust" and 'r##' in text:
            return _brace_valid(syntax_lex.without_raw_strings(text), language)
        elif language in ("c", "cpp") and re.search(r"^\s*#\s*(?:else|elif)\b", text, re.M):
            return _brace_valid(syntax_lex.one_branch(text, True), language) and _brace_valid(syntax_lex.one_branch(text, False), language)
        return False
    return None


_REGEX = re.compile(r"([=(,:\[!&|?{};]\s*|\breturn\s+)/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


def _brace_valid(text: str, language: str) -> bool:
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("#!"):
        text = "//" + text
    text = text.lstrip("\ufeff")
    sound, code = syntax_lex.read(text, language)
    return sound and syntax_grammar.fault(code, language) is None


def judged(df: DataFrame, key: str = "path", version: str = "scanned_at", language: str = "language", content: str = "content") -> DataFrame:
    """(path, language, invalid) of every record with content and language; invalid is null where no verdict is possible:
    in languages without a grammar here, and where a parser gives up on the depth of a text.

    The record of a path is its row of the latest ``version``; rows are judged before that is settled, so content is
    never shuffled. Null or empty content and null language are left out.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen, bad = [], []
            for lang, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                ok = valid(text, lang) if text and lang and lang not in NEVER else None
                seen.append(bool(text and lang))
                bad.append(None if ok is None else not ok)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(seen, pa.bool_()), pa.array(bad, pa.bool_())], ["path", "version", "language", "seen", "invalid"])

    rows = df.select(F.col(key).alias("path"), F.col(version).alias("version"), F.col(language).alias("language"), F.col(content).alias("content"))
    kind = rows.schema["version"].dataType.simpleString()
    out = rows.mapInArrow(run, f"path string, version {kind}, language string, seen boolean, invalid boolean")
    return latest(out, "path", "version").where("seen").select(F.col("path").alias(key), "language", "invalid")


def rates(df: DataFrame, **columns: str) -> DataFrame:
    """(repository, language, files, judged, invalid, rate); the repository is the first segment of the path.

    rate is the share of the files judged, null where none could be.
    """
    j = judged(df, **columns)
    key = columns.get("key", "path")
    return (
        j.groupBy(F.split_part(F.col(key), F.lit("/"), F.lit(1)).alias("repository"), "language")
        .agg(F.count("*").alias("files"), F.count("invalid").alias("judged"), F.count(F.when(F.col("invalid"), 1)).alias("invalid"))
        .withColumn("rate", F.try_divide("invalid", "judged"))
    )
