"""Lexing of source text in pieces, for problem 6.

A piece of a file is described without its left context: for every state in which it might begin (code, inside
a block comment, inside some kind of string) the state in which it ends, what is wrong on the way, and
its brackets reduced to the closers and openers that find no partner in it. Descriptions compose
associatively, so the pieces of a file can be described anywhere and reduced in any grouping.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

PIECE = 1 << 16
_CLOSES = {")": "(", "]": "[", "}": "{"}


@dataclass(frozen=True)
class Lexicon:
    """How comments and strings of a language look. ``long``: delimiters that run over lines, by state name."""

    line: tuple[str, ...] = ()
    block: tuple[str, str] | None = None
    short: str = ""
    long: tuple[tuple[str, str], ...] = ()
    nested: bool = False
    chars: str = ""

    @property
    def states(self) -> tuple[str, ...]:
        return ("code", *(["comment"] if self.block else []), *(a for a, _ in self.long))


#: Comment and string delimiters.
LEXICONS = {
    "javascript": Lexicon(("//",), ("/*", "*/"), "\"'", (("`", "`"),)),
    "typescript": Lexicon(("//",), ("/*", "*/"), "\"'", (("`", "`"),)),
    "java": Lexicon(("//",), ("/*", "*/"), "\"'", (('"""', '"""'),)),
    "go": Lexicon(("//",), ("/*", "*/"), "\"'", (("`", "`"),)),
    "rust": Lexicon(("//",), ("/*", "*/"), "", (('r#"', '"#'), ('"', '"')), True, "'"),
    "c": Lexicon(("//",), ("/*", "*/"), "\"'"),
    "cpp": Lexicon(("//",), ("/*", "*/"), "\"'", (('R"(', ')"'),)),
    "python": Lexicon(("#",), None, "\"'", (('"""', '"""'), ("'''", "'''"))),
    "json": Lexicon((), None, '"'),
}


@lru_cache(maxsize=None)
def _scanner(lexicon: Lexicon) -> re.Pattern:
    e = re.escape
    parts = [f"(?P<line>(?:{'|'.join(e(x) for x in lexicon.line)})[^\\n]*)"] if lexicon.line else []
    if lexicon.block:
        parts.append(f"(?P<block>{e(lexicon.block[0])})")
    for i, (a, _) in enumerate(lexicon.long):
        parts.append(f"(?P<long{i}>{e(a)})")
    for i, q in enumerate(lexicon.short):
        parts.append(f"(?P<short{i}>{q}(?:[^{q}\\\\\\n]|\\\\(?:\\r?\\n|.))*(?P<end{i}>{q})?)")
    if lexicon.chars:
        parts.append(r"(?P<char>b?'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F]+\}|x[0-9a-fA-F]{2}|.))')")
    return re.compile("|".join(parts), re.S)


@lru_cache(maxsize=None)
def _end_of(delimiter: str) -> re.Pattern:
    return re.compile(r"\\.|" + re.escape(delimiter), re.S)


@dataclass
class Described:
    """A piece for one state of beginning: how it ends, its code, and whether a short string was left open."""

    state: str
    code: str
    broken: bool


def describe(text: str, state: str, lexicon: Lexicon) -> Described:
    """Code of a piece with comments as a space (or line end) and strings as an empty string in quotes."""
    out: list[str] = []
    at, n, broken = 0, len(text), False
    scan = _scanner(lexicon)
    ends = dict(lexicon.long)
    depth = 1
    while True:
        if state != "code":
            if state == "comment":
                a, b = lexicon.block
                if lexicon.nested:
                    m = None
                    for m in re.compile(re.escape(a) + "|" + re.escape(b)).finditer(text, at):
                        depth += 1 if m[0] == a else -1
                        if not depth:
                            break
                    stop = m.end() if m and not depth else -1
                    depth = 1
                else:
                    k = text.find(b, at)
                    stop = k + len(b) if k >= 0 else -1
                body = text[at : stop if stop >= 0 else n]
                out.append("\n" if "\n" in body else " ")
            else:
                raw = state in ('R"(', 'r#"') or state == "`" and lexicon is LEXICONS["go"]
                if raw:
                    k = text.find(ends[state], at)
                    stop = k + len(ends[state]) if k >= 0 else -1
                else:
                    stop = -1
                    for m in _end_of(ends[state]).finditer(text, at):
                        if m[0][0] != "\\":
                            stop = m.end()
                            break
                out.append('""')
            if stop < 0:
                return Described(state, "".join(out), broken)
            at, state = stop, "code"
        start = at
        m = None
        for m in scan.finditer(text, at):
            kind = m.lastgroup
            out.append(text[start : m.start()])
            start = m.end()
            if kind == "line":
                continue
            if kind == "block":
                state = "comment"
                break
            if kind.startswith("long"):
                state = lexicon.long[int(kind[4:])][0]
                break
            out.append('""')
            if kind.startswith("short") and m["end" + kind[5:]] is None:
                broken = True
        if state == "code":
            out.append(text[start:])
            return Described("code", "".join(out), broken)
        at = start


def brackets(code: str) -> tuple[str, str] | None:
    """(closers, openers) without partner, None if two brackets of different kind meet."""
    closers: list[str] = []
    stack: list[str] = []
    for b in re.findall(r"[()\[\]{}]", code):
        if b in "([{":
            stack.append(b)
        elif stack:
            if stack.pop() != _CLOSES[b]:
                return None
        else:
            closers.append(b)
    return "".join(closers), "".join(stack)


@dataclass
class Summary:
    """Of a run of pieces: for every state of beginning, (state of ending, sound so far, closers, openers)."""

    by_state: dict[str, tuple[str, bool, str, str]]

    @staticmethod
    def of(text: str, lexicon: Lexicon, states: tuple[str, ...] | None = None) -> Summary:
        out = {}
        for s in states or lexicon.states:
            d = describe(text, s, lexicon)
            b = brackets(d.code)
            ok = not d.broken and b is not None
            out[s] = (d.state, ok, *(b if ok else ("", "")))  # once broken, brackets no longer matter
        return Summary(out)

    def then(self, other: Summary) -> Summary:
        """The summary of this run and the next; associative."""
        out = {}
        for s, (mid, ok, closers, openers) in self.by_state.items():
            end, ok2, closers2, openers2 = other.by_state[mid]
            ok = ok and ok2
            stack = list(openers)
            rest = []
            for c in closers2:
                if stack:
                    ok = ok and stack.pop() == _CLOSES[c]
                else:
                    rest.append(c)
            out[s] = (end, ok, closers + "".join(rest), "".join(stack) + openers2) if ok else (end, False, "", "")
        return Summary(out)


def pieces(text: str) -> list[str]:
    """A text cut at line ends into pieces of about ``PIECE`` characters."""
    out, at = [], 0
    while len(text) - at > PIECE:
        k = text.rfind("\n", at, at + PIECE) + 1 or text.find("\n", at + PIECE) + 1 or len(text)
        out.append(text[at:k])
        at = k
    out.append(text[at:])
    return out


def sound(text: str, language: str) -> bool:
    """Whether the whole text ends in code with every string closed and every bracket matched."""
    lexicon = LEXICONS[language]
    parts = pieces(text)
    if len(parts) == 1:
        total = Summary.of(text, lexicon, ("code",))
    else:
        total = Summary.of(parts[0], lexicon)
        for p in parts[1:]:
            total = total.then(Summary.of(p, lexicon))
    end, ok, closers, openers = total.by_state["code"]
    good = end == "code" and ok and not closers and not openers
    if len(parts) > 1 and (not good or language == "rust" and "/*" in text):
        # the states carry neither a string continued over a line end nor the depth of nested comments: read it at one go
        end, ok, closers, openers = Summary.of(text, lexicon, ("code",)).by_state["code"]
        good = end == "code" and ok and not closers and not openers
    return good


def read(text: str, language: str) -> tuple[bool, str]:
    """(:func:`sound`, the code of the text), lexed once where the text is one piece."""
    if len(text) > PIECE:
        return sound(text, language), describe(text, "code", LEXICONS[language]).code
    d = describe(text, "code", LEXICONS[language])
    return d.state == "code" and not d.broken and brackets(d.code) == ("", ""), d.code


_TEMPLATE_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[`{}]", re.S)
_TEMPLATE_TEXT = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)


def without_templates(text: str) -> str | None:
    """JavaScript with each template literal as a list of a string and its expressions, nested ones too; None if one stays open."""
    out: list[str] = []
    stack: list[str] = []  # '{' of code, '$' of an expression inside a template
    at = 0

    def template(at: int) -> int:
        """Read template text up to its end or its next expression; the position after, -1 if there is none."""
        m = _TEMPLATE_TEXT.match(text, at)
        out.append("\n" * m[0].count("\n"))
        if text.startswith("`", m.end()):
            out.append("]")
            return m.end() + 1
        if text.startswith("${", m.end()):
            out.append(",(")
            stack.append("$")
            return m.end() + 2
        return -1

    while m := _TEMPLATE_TOKEN.search(text, at):
        out.append(text[at : m.start()])
        at, c = m.end(), m[0]
        if c == "`":
            out.append('[""')
            at = template(at)
        elif c == "}" and stack and stack[-1] == "$":
            stack.pop()
            out.append(")")
            at = template(at)
        else:
            if c == "{":
                stack.append(c)
            elif c == "}" and stack:
                stack.pop()
            out.append(c)
        if at < 0:
            return None
    out.append(text[at:])
    return "".join(out)


_RAW_STRING = re.compile(r'\bb?r(#{2,})".*?"\1', re.S)


def without_raw_strings(text: str) -> str:
    """Rust with the raw strings of two or more marks as empty strings; those of one are read as they stand."""
    return _RAW_STRING.sub('""', text)


def one_branch(text: str, first: bool) -> str:
    """C with only the first, or only the last, branch of each conditional of the preprocessor, lines kept."""
    out, stack = [], []  # of [whether this branch counts]
    lines = text.split("\n")
    for i, line in enumerate(lines):
        word = re.match(r"\s*#\s*(if|ifdef|ifndef|elif|else|endif)\b", line)
        if not word:
            out.append(line if all(stack) else "")
            continue
        if word[1].startswith("if"):
            stack.append(first or not _has_else(lines, i))
        elif word[1] in ("elif", "else") and stack:
            stack[-1] = not first and word[1] == "else"
        elif stack:
            stack.pop()
        out.append("")
    return "\n".join(out)


def _has_else(lines: list[str], at: int) -> bool:
    """Whether the conditional that begins on a line has an else of its own."""
    depth = 0
    for line in lines[at:]:
        m = re.match(r"\s*#\s*(if|ifdef|ifndef|else|endif)\b", line)
        if m and m[1].startswith("if"):
            depth += 1
        elif m and m[1] == "endif":
            depth -= 1
            if not depth:
                return False
        elif m and depth == 1:
            return True
    return False
