"""Where functions and methods of brace languages begin and end, from brackets alone.

Comments, strings and regular expressions are blanked out, line ends kept; one pass over the brackets then knows for each
'{' the text in front of it and the block around it. JavaScript and TypeScript give methods (of classes and of
object literals), C and C++ functions, as the grammars of these languages name such nodes.
"""

from __future__ import annotations

import re
from bisect import bisect_left

_CLOSES = {")": "(", "]": "[", "}": "{"}
_COMMENTS_STRINGS = r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
_SCRIPT = re.compile(_COMMENTS_STRINGS + r"|`(?:[^`\\]|\\.)*`|(?:(?<=[=(,:\[!&|?{};\n])|(?<=\breturn))[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*", re.S)
_C = re.compile(_COMMENTS_STRINGS + r"|R\"(?P<d>[^\s()\\]{0,16})\(.*?\)(?P=d)\"|^[ \t]*#(?:[^\n\\]|\\.)*", re.S | re.M)
_NO_NAMES = "if for while switch catch function with return do else try new typeof await sizeof case throw synchronized".split()
_CLASS = re.compile(r"\bclass\b[^(){};]*$|^\s*(?:export\s+)?(?:abstract\s+)?class\b[^{};]*$")
_METHOD = re.compile(
    r"\s*(?:@[\w.]+(?:\([^()]*\))?\s*)*(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract|declare)\s+)*\*?\s*"
    r"(?P<name>#?[\w$]+|\[[^\[\]]*\]|\"\"|'')\s*(?:<[^{}]*>)?\s*\([^{}]*\)\s*(?::[^;{}=]+)?$"
)
_OBJECT = re.compile(r"(?:[=(,:\[?]|\breturn|\bdefault|=>\s*\()\s*$")
_FUNCTION = re.compile(r"(?P<name>~?\w+|operator\s*\S{1,3})\s*\([^{};]*\)\s*(?:(?:const|noexcept|override|final|volatile|try|&&?|->\s*[\w:<>,\s*&]+|:[^;{}]*)\s*)*$")
_C_SCOPE = re.compile(r"\b(?:namespace|class|struct|union|extern)\b[^()=;]*$")


def _blank(m: re.Match) -> str:
    own = re.sub(r"[^\n]", " ", m[0])
    # a string stays one, so that a quoted name still is a name
    return '""' + own[2:] if m[0][0] in "\"'" and len(m[0]) >= 2 else own


def _method(head: str) -> int:
    """Where the head of a method begins in the text in front of its '{', -1 if it is none; fields without ';' may stand above."""
    while (flat := re.sub(r"\{[^{}]*\}", lambda x: " " * len(x[0]), head)) != head:
        head = flat
    for at in [0, *(m.end() for m in re.finditer("\n", head))]:
        m = _METHOD.match(head, at)
        if m and m["name"] not in _NO_NAMES:
            return at
    return -1


def blocks(text: str, language: str) -> list[tuple[str, int, int]]:
    """(kind, first line, last line), 1-based, outer before inner; none where brackets do not match."""
    script = language in ("javascript", "typescript")
    code = (_SCRIPT if script else _C).sub(_blank, text)
    stack: list[tuple[str, int, str, int]] = []  # (bracket, position, what it opens, begin of the text in front)
    front = 0  # where the text in front of the next bracket of this level begins
    found: list[tuple[int, int]] = []
    for m in re.finditer(r"[()\[\]{};,]", code):
        c, at = m[0], m.start()
        inside = stack[-1][2] if stack else "top"
        if c in "([":
            stack.append((c, at, "list", front))
        elif c == "{":
            head = code[front:at]
            kind, begin = "block", front
            if script:
                begin = _method(head) + front if inside in ("class", "object") and _method(head) >= 0 else -1
                if begin >= 0:
                    kind = "found"
                elif _CLASS.search(head):
                    kind = "class"
                elif _OBJECT.search(code[max(0, at - 40) : at].rstrip() if head.strip() or inside != "list" else code[max(0, at - 40) : at]):
                    kind = "object"
            elif inside in ("top", "scope"):
                plain = re.sub(r"\b(?:public|private|protected)\s*:", lambda x: " " * len(x[0]), head)
                f = _FUNCTION.search(plain)
                if _C_SCOPE.search(plain):
                    kind = "scope"
                elif f and f["name"] not in _NO_NAMES and "=" not in re.sub(r"\([^{}]*\)|operator\s*\S+", "", plain):
                    kind, begin = "found", front + len(plain) - len(plain.lstrip())
            stack.append((c, at - len(code[begin:at].lstrip()) if kind == "found" else at, kind, front))
            front = m.end()
        elif c in ")]}":
            if not stack or stack[-1][0] != _CLOSES[c]:
                return []
            _, begin, kind, front_then = stack.pop()
            if c == "}":
                if kind == "found":
                    found.append((begin, at))
                front = m.end()
            else:
                front = front_then
        elif c == ";" or c == "," and inside == "object":
            front = m.end()
    if stack:
        return []
    ends = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_left(ends, at) + 1
    kind = "method_definition" if script else "function_definition"
    return [(kind, line(a), line(z)) for a, z in sorted(found)]
