"""Local grammars of statements, for problem 6.

Once strings, comments and brackets are settled, a statement is judged by what may stand beside what: which
tokens end an operand and which begin one, what an operator or a keyword must be followed by, and what kind
of bracket is around. Each language says how its rules differ. Nothing here needs names or types.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r'""|[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*|\.?\d(?:[\w.]|(?<=[eE])[+-])*|'
    r">>>=|<<=|>>=|\.\.\.|===|!==|\*\*=|&&=|\|\|=|\?\?=|->|=>|::|:=|<-|\+\+|--|&&|\|\||\?\?|\?\.|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|\.\.=|\.\.|\n|[^\s]"
)
MERGE = re.compile(r"^(?:<{7}|={7}|>{7}|\|{7})(?: |\r?$)", re.M)
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")

_BINARY = frozenset("* / % == === != !== <= >= && || ?? = += -= *= /= %= &= |= ^= <<= >>= >>>= ** **= &&= ||= ??= := ^".split())
_CLOSING = frozenset(") ] } ; ,".split())


@dataclass(frozen=True)
class Grammar:
    """What differs between languages; all sets are of words or tokens."""

    keywords: frozenset
    #: Words after which, and before which, another operand may follow on a line.
    leads: frozenset = frozenset()
    links: frozenset = frozenset()
    #: Keywords that begin a statement, so that an operand right before them is unfinished.
    begins: frozenset = frozenset()
    #: Keyword: what must follow it.
    after: dict = field(default_factory=dict)
    #: What a file may begin with; empty if anything.
    first: frozenset = frozenset()
    controls: frozenset = frozenset("if while for switch catch with synchronized".split())
    line_ends: bool = False
    types_first: bool = False
    angles: bool = False
    literals: frozenset = frozenset("true false null this super nil self None undefined nullptr NULL".split())
    illegal: str = "#`@\\"
    call_blocks: bool = True
    joins_strings: bool = False
    #: Keywords that stand only inside a body.
    inner: frozenset = frozenset()


def _set(words: str) -> frozenset:
    return frozenset(words.split())


_JS = _set(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return switch throw try typeof var void while with let yield await"
)
_NAME = "name"
_JS_AFTER = {
    "if": _set("("), "while": _set("("), "switch": _set("("), "with": _set("("), "for": _set("( await"), "catch": _set("( {"), "finally": _set("{"), "try": _set("{"),
    "function": _set("name * ("), "class": _set("name { extends"), "import": _set('name { * "" ( .'), "const": _set("name { [ enum"), "var": _set("name { ["),
    "export": _set("default function class const let var { * name import = enum"), "extends": _set("name ( class this"), "do": _set("{ name ( ; if for while"),
}
_JAVA = _set(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while"
)
_C = _set(
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while"
)
_CPP = _C | _set(
    "alignas alignof bool catch class consteval constexpr constinit const_cast co_await co_return co_yield decltype delete dynamic_cast explicit export false friend mutable namespace new noexcept nullptr operator override private protected public reinterpret_cast requires static_assert static_cast template this thread_local throw true try typeid typename using virtual wchar_t final concept"
)
_GO = _set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")
_RUST = _set(
    "as async await box break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct super trait type unsafe use where while yield macro_rules union"
)
_INNER = _set("return if for while switch break continue else")
_PAREN = {x: _set("(") for x in "if while for switch".split()}

GRAMMARS = {
    "javascript": Grammar(
        _JS, _set("of as from async get set static"), _set("of as from"), _set("const var class import export return throw break continue switch try"), _JS_AFTER, line_ends=True, call_blocks=False,
        illegal="#\\" ,
    ),
    "typescript": Grammar(
        _JS | _set("enum"),
        _set("of as from async get set static type interface declare readonly abstract public private protected namespace module is keyof infer unique asserts override accessor satisfies implements out global any"),
        _set("of as from is satisfies implements keyof readonly extends"),
        _set("const var import export return throw break continue switch try"),
        _JS_AFTER | {"class": _set("name { extends implements"), "enum": _set("name")},
        line_ends=True, call_blocks=True, angles=True, illegal="\\",
    ),
    "java": Grammar(
        _JAVA, _set("sealed non-sealed record permits yield var module"), _set("permits when"), _set("if for while do switch return break continue throw try import package case"),
        _PAREN | {"catch": _set("("), "try": _set("{ ("), "finally": _set("{"), "class": _set("name"), "interface": _set("name"), "enum": _set("name"), "package": _set("name"), "import": _set("name static"), "extends": _set("name @"), "implements": _set("name @"), "throws": _set("name @"), "new": _set("name int long double float byte char short boolean @ <")},
        first=_set("package import public class abstract final interface enum record @ ; sealed strictfp static private protected non"), inner=_INNER, types_first=True, angles=True, illegal="#`\\$",
    ),
    "c": Grammar(
        _C, frozenset(), frozenset(), _set("if for while do switch return break continue goto case typedef"), _PAREN | {"goto": _set("name"), "struct": _set("name {"), "union": _set("name {"), "enum": _set("name {")},
        types_first=True, illegal="`@$", joins_strings=True, inner=_INNER,
    ),
    "cpp": Grammar(
        _CPP, frozenset(), frozenset(), _set("if for while do switch return break continue goto case typedef using namespace"), {"while": _set("("), "for": _set("("), "switch": _set("("), "if": _set("( constexpr consteval !"), "catch": _set("("), "namespace": _set("name { ::"), "goto": _set("name")},
        types_first=True, angles=True, illegal="`@$", joins_strings=True, inner=_INNER,
    ),
    "go": Grammar(
        _GO, frozenset(), frozenset(), _set("if for switch return break continue import package var type defer go func select"),
        {"package": _set("name"), "func": _set("name ("), "import": _set('"" ( name . _'), "type": _set("name ("), "else": _set("{ if"), "defer": _set("name func ("), "go": _set("name func (")},
        first=_set("package"), inner=_INNER, controls=frozenset(), line_ends=True, types_first=True, illegal="#@$?\\",
    ),
    "rust": Grammar(
        _RUST, _set("dyn default auto raw safe"), frozenset(), _set("let fn use mod struct enum impl trait static return while loop pub"),
        {"fn": _set("name ("), "struct": _set("name"), "enum": _set("name"), "trait": _set("name"), "mod": _set("name"), "use": _set("name crate super self :: {"), "let": _set("name mut ref ( [ & _ Some"), "loop": _set("{"), "impl": _set("name < ! const dyn unsafe & ( ["), "else": _set("{ if")},
        first=_set("use fn pub mod struct enum impl trait const static type extern # unsafe async union crate macro_rules name"), controls=frozenset(), angles=True, illegal="`@\\", call_blocks=True,
    ),
}


def tokens_of(code: str, language: str) -> list[str]:
    if language in ("c", "cpp"):  # directives are lines of their own kind
        code = re.sub(r"^[ \t]*#[ \t]*(?:include|define|undef|if|ifdef|ifndef|elif|else|endif|pragma|error|warning|line|elifdef|embed)?\b(?:[^\n]*\\\r?\n)*[^\n]*", "", code, flags=re.M)
    if language == "rust":
        code = re.sub(r"#!?\[[^\]]*\]", " ", code)
        code = re.sub(r"'[a-z_]\w*\b(?!')", " ", code)
    if language == "java":
        code = re.sub(r"@interface\b", "interface", code)
    return TOKEN.findall(code)


def fault(code: str, language: str) -> str | None:
    """The first offence against the local grammar, as the tokens around it; None if there is none.

    ``code`` has its comments taken out and its strings emptied, and its brackets match.
    """
    if MERGE.search(code) or CONTROL.search(code):
        return "marker or control character"
    g = GRAMMARS[language]
    keywords, literals = g.keywords, g.literals
    stack: list[tuple[str, str]] = []  # of (bracket, what stood before it)
    prev, kind, raw = "", "start", ""  # last token, its class, and the word itself
    before = ""  # class of the token before
    classes: list[int] = []  # depths at which the body of a class is awaited
    control = "if"
    broke = False
    function = False
    seen = False
    for t in tokens_of(code, language):
        if t == "\n":
            broke = True
            continue
        c = t[0]
        if t == '""':
            k = "text"
        elif c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
            k = "number"
        elif c.isalpha() or c in "_$" or c > "\x7f":
            k = "name" if t not in keywords or raw in (".", "?.", "->") and kind == "op" else "key"
            if t in literals and not (raw in (".", "?.") and kind == "op"):
                k = "value"
        else:
            k = "op"
            if c in g.illegal and len(t) == 1:
                return f"{prev} {t}"
        word = t if k in ("op", "key") else k
        if not seen:
            seen = True
            if g.first and not (t in g.first or word in g.first):
                return f"begins with {t}"
        inside = stack[-1][0] if stack else ""
        apart = broke and g.line_ends and inside not in ("(", "[")
        # operands side by side
        ends = kind in ("name", "value", "number", "text") or kind == "op" and raw in ("]", ")")
        if ends and k in ("name", "value", "number", "text"):
            ok = apart or raw in g.leads or t in g.links
            if not ok:
                if kind == "op" and raw == "]":
                    ok = k == "name" and (g.types_first or language == "typescript")
                elif kind == "op":
                    ok = prev != ")call" or (g.types_first or g.angles) and (len(stack) == 0 or language in ("go", "typescript")) or t in ("throws", "default")
                elif kind == "text" or k == "text":
                    ok = g.joins_strings or language == "go" and kind == "name" and inside in ("(", "{")
                elif kind == "number" or k == "number":
                    ok = False
                else:
                    ok = g.types_first and k == "name" and before not in ("name",)
            if not ok:
                return f"{raw} {t}"
        elif k == "key" and ends and not apart and t in g.begins:
            if not (kind == "op" and prev == ")control") and raw not in g.leads and not (language == "go" and t == "func"):
                return f"{raw} {t}"
        elif k == "op":
            if kind == "op" and raw in _BINARY and (t in _CLOSING or t in _BINARY and t not in ("*", "**", "^") and not (raw == "*" and t in ("=", ","))):
                if not (raw == "*" and (language in ("c", "cpp", "rust", "go") or t in (",", ")", ";", ">") and g.angles) or raw == "=" and t == ";" and language == "cpp" or raw in ("&&", "/") and language == "cpp" or raw in ("||", "|=") and language == "rust" or raw == "^" and t == "="):
                    return f"{raw} {t}"
            if kind == "op" and raw in ("+", "-") and t in _CLOSING and language not in ("rust", "cpp"):
                return f"{raw} {t}"
            if t == "," and kind == "op" and (raw in ("(", "{") or raw == "," and (inside != "[" or language not in ("javascript", "typescript"))):
                if not (raw == "," and language == "go"):
                    return f"{raw} {t}"
            if raw in (".", "?.") and kind == "op" and not (t in ("#", "*") or raw == "?." and t in ("(", "[") or t in ("(", "<", "{") and language in ("go", "java", "rust")):
                return f"{raw} {t}"
            if t == "{" and kind == "op" and prev == ")call" and not g.call_blocks and not function and inside != "{class" and not any(s[1] == "object" for s in stack[-1:]):
                return f"{raw} {t}"
        if raw in (".",) and kind == "op" and k in ("number", "text"):
            return f"{raw} {t}"
        if k == "key" and not stack and t in g.inner and not (kind == "op" and raw in (".", "::")):
            return f"{t} outside a body"
        # what must follow a keyword
        if kind == "key":
            need = g.after.get(raw)
            if need is not None and word not in need and t not in need:
                return f"{raw} {t}"
        if t == "else" and k == "key" and not (kind == "op" and raw in ("}", ";") or apart):
            return f"{raw} else"
        if t == "else" and k == "key" and kind == "op" and prev in ("}class", "}function", "}loop"):
            return f"{prev} else"
        if t in ("catch", "finally") and k == "key" and not (kind == "op" and raw == "}"):
            return f"{raw} {t}"
        if t == "function" and k == "key" or t == "=>":
            function = t == "function"
        now = t
        if k == "op":
            if t in "([{" and len(t) == 1:
                head = ""
                if t == "(":
                    if kind == "key" and raw in g.controls or raw in ("await",) and before == "for":
                        head = "control"
                    elif kind in ("name", "text") or kind == "op" and raw in (")", "]", ">"):
                        head = "call"
                    elif kind == "value" and raw in ("super", "this"):
                        head = "call"
                elif t == "{":
                    if classes and classes[-1] == len(stack):
                        head = "class"
                    elif kind == "op" and raw in ("=", "(", ",", ":", "[", "?", "&&", "||", "??") or kind == "key" and raw in ("return", "default", "typeof"):
                        head = "object"
                    elif prev == ")control":
                        head = "loop" if control == "loop" else "if"
                    elif function or prev == ")call":
                        head = "function"
                    if function and head in ("", "function", "if"):
                        function = False
                stack.append(("{class" if head == "class" else t, head))
                if head == "control":
                    control = "loop" if raw in ("for", "while", "switch") else "if"
            elif t in ")]}" and len(t) == 1:
                if not stack:
                    return f"{raw} {t}"
                opened, head = stack.pop()
                now = t + head if head in ("call", "control", "class", "function", "loop") else t
                if classes and classes[-1] == len(stack) and t == "}":
                    classes.pop()
        elif k == "key" and t == "class" and not (kind == "op" and raw == "."):
            classes.append(len(stack))
        if not stack and k == "op" and t == ";":
            function = False
        before = kind if kind != "key" else raw
        prev, kind, raw, broke = now, k, t, False
    return None
