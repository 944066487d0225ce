"""Credentials embedded in source code and configuration (problem 4).

Places that can hold one are found by shape: values given to names that speak of secrets, log-in data
of addresses and commands, private key blocks, authorization headers, tagged tokens, words of comments about log-ins,
and, whatever they are called, quoted words, arguments after a user name and bare words of assignments. A logistic
regression then weighs how unlike ordinary text the characters of the value are (a Markov model of the
characters of the whole corpus), what the identifiers around it say, and where the file lies. It is
fitted on a bounded sample of places whose pattern leaves little doubt, and its scores are calibrated
on places held out of the fit. Places without a telling name have a regression of their own, which learns from the
values of the others how credentials look and from the sampled words how often they are none. Redaction replaces only the characters of the value.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import ship
from corpusmill.sources.tables import latest

#: At most about this many records give places to fit on, and the least score of a credential.
SAMPLE_RECORDS, LEAST = 12_000, 0.5
#: At most this many different places of them are used, those of the smallest hash.
PLACES_MOST = 400_000

# ---------------------------------------------------------------- where a credential can be

_SPEAKS = re.compile(
    r"passw|pwd|secret|token|api_?-?key|credential|auth|bearer|kennwort|passphrase|mot_?de_?passe|contrase|"
    r"(?:access|private|signing|client|encryption|master|account|shared|service|storage)_?-?key|(?<![a-z])pass(?![a-z])|(?<![a-z])pw(?![a-z])|creds(?![a-z])|login|senha|wachtwoord"
)
#: Short endings of names whose beginning shows only in the original case or not at all: adminPw, TABLEPASS, dbpass.
_ENDING = re.compile(r"(?<=[a-z0-9])(?:Pw|PW|Pass|PASS)(?![a-z])|(?<=[A-Z])(?<!COM)(?<!BY)(?<!TRES)(?<!SUR)(?:PW|PASS)(?![A-Za-z])|(?<=[a-z])(?<![Cc]om)(?<![Bb]y)(?<![Tt]res)(?<![Ss]ur)(?:pw|pass)(?![A-Za-z])")
#: One of these stands in whatever `_SPEAKS` and `_ENDING` match; a text without any is passed over at the speed of a byte search.
_ANCHORS = ("pass", "pw", "secret", "token", "key", "cred", "auth", "bearer", "kennwort", "contrase", "login", "senha", "wachtwoord")
_REST_OF_NAME = re.compile(r"[\w\-]*[\"'\]]*\s*(?::\s*[&\w<>'\[\] ]{1,24}?)?\s*(?::=|=>|(?<![=!<>])=(?!=)|:(?!:))[ \t]*")
_WRAPPED = re.compile(r"(?:[\w.!:]*[(\[]\s*){0,2}")
_LITERAL = re.compile(r'[rbfuRBFU]{0,2}(?:"""(?P<a>.*?)"""|\'\'\'(?P<b>.*?)\'\'\'|"(?P<c>(?:[^"\\\n]|\\.)*)"|\'(?P<d>(?:[^\'\\\n]|\\.)*)\'|`(?P<e>[^`]*)`)', re.S)
_JOINT = re.compile(r"\s*(?:\+|\.\.?|\\)?\s*")
_LIST_JOINT = re.compile(r"\s*[,+]?\s*")
_BARE = re.compile(r"[^\s\"'`,;&<>(){}\[\]]{4,}")
_CALL = re.compile(r"\w*\(\s*")
_ADDRESS = re.compile(r"://[^\s/:@\"'`<>]+:([^\s/@\"'`<>]{2,})@")
_HEADER = re.compile(r"\b(?:basic|bearer|token)[ \t]+([A-Za-z0-9+/=._~\-]{8,})", re.I)
_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_KEY_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
#: What follows the BEGIN of a block without END: lines of base64, the last of which may be short.
_KEY_LINES = re.compile(
    r"(?:[\s\"'`+,.;)]|\\[nr]?)*(?:(?:Proc-Type|DEK-Info|Version|Comment): [^\n\"'\\]*(?:[\s\"'`+,.;)]|\\[nr]?)*)*"
    r"(?:[A-Za-z0-9+/=]{16,}+(?:[\s\"'`+,.;)]|\\[nr]?)*+)?(?:[A-Za-z0-9+/=]{40,}+(?:[\s\"'`+,.;)]|\\[nr]?)*+)*+(?:(?=[A-Za-z]*[0-9+/=])[A-Za-z0-9+/]{4,}={0,2}(?=[\s\"'`\\]|$))?"
)
_LONG = re.compile(r"(?:[\"'`=]|:[ \t]+)([A-Za-z0-9][A-Za-z0-9_\-.~+/=]{14,})")
_USER = re.compile(r"(?<![\w\-])(?:-u|-U|--user|--proxy-user)(?:[ \t]+|=)?[\"']?[\w.@\\\-]+:([^\s\"'`<>]{4,})")
_QUOTED = re.compile(r"\"((?:[^\"\\\s]|\\\S){6,})\"|'((?:[^'\\\s]|\\\S){6,})'|`([^`\s]{6,})`")
_AFTER_USER = re.compile(r"\w[ \t]*\((?:[^()\n]*,)?[ \t]*[rbfuRBFU]?[\"'`][\w.@\-]{2,}[\"'`][ \t]*,[ \t]*[rbfuRBFU]?$")
_GIVEN = re.compile(r"^[ \t]*(?:export[ \t]+|set[ \t]+|-[ \t]+)?[\w.\-]+[ \t]*(?:=|:[ \t])[ \t]*([^\s\"'`,;&|<>(){}\[\]$]{6,})[ \t]*\r?$", re.M)
#: Words of code that are no credentials: addresses, paths, patterns, formats, digests, versions, dates, types, colours, own keys.
_DATA = re.compile(
    r"^[a-z][\w+.\-]*://|^\.{0,2}/|^(?:[a-z0-9_.\-]+|[A-Z][a-z]+)(?:/(?:[a-z0-9_.\-]+|[A-Z][a-z]+))+(?:;|$)|%[-\d.]*[a-zA-Z]\b|^[%^$.#&?]\S*[\\\[\](){}]|^[\[(]|^[~^]?v?\d+(?:\.[\w*]+)+(?:[\-+][\w.]+)*$|"
    r"^\d{4}-\d\d|^#[0-9a-fA-F]{3,8}$|^[\w.\-]+@[\w.\-]+\.\w+$|^[A-Za-z]?[a-z]*(?:[A-Z][a-z]+|[._:\-][A-Za-z]?[a-z]+)*\d{0,3}$|^[A-Z][A-Z_]*\d{0,3}$|^[a-z]{1,6}[\-_:][0-9a-f]{4,}$|;\w+=|^&\w+;|^[\d.,:+\-_/%]+\w{0,3}$"
)
_KEY = re.compile(r"[ \t]*:(?!:)")
_ID = re.compile(r"(?:^|[\W_])id\W*$|[a-z]I[dD]\W*$|(?:^|[\W_])ID\W*$")
_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|--|<!--|;|%)")
#: Beginnings by which services mark their tokens, in general form and the public well-known ones.
_TAGGED = re.compile(r"^(?:gh[a-z]_[A-Za-z0-9]{16,}|github_pat_\w{16,}|glpat-[\w\-]{12,}|xox[a-z]-[\w\-]{12,}|[a-z]{2,12}_[a-z]{2,8}_(?=[A-Za-z]*\d)(?=[a-z0-9]*[A-Z])[A-Za-z0-9]{12,}|A[KS]IA[A-Z0-9]{12,}|AIza[\w\-]{20,}|SG\.[\w\-]{8,}\.[\w\-]{8,}|eyJ[\w\-]{6,}\.[\w\-]{6,}\.[\w\-]*|npm_[A-Za-z0-9]{16,}|pypi-[\w\-]{16,}|sk-[\w\-]{16,}|[sw]k_[a-z]+_[A-Za-z0-9]{8,}|ya29\.[\w\-]{16,}|dop_v1_[a-f0-9]{16,})")
_PLACEHOLDER = re.compile(
    r"^\s*$|^[x*.\-_#?0]+$|^<.*>?$|^\$?\{.*|^\$[A-Za-z_(]|^%\w+%$|^your|^n/?a$|^none$|^null$|^nil$|^true$|^false$|^undefined$|^test$|^vault:|^env[:.]|^secret:|^ssm:|^arn:|^file:|^op://|^ref:|^keychain",
    re.I,
)
#: Words that mark a placeholder, and those that stand beside them.
_FILLS = re.compile(r"change|replace|placeholder|your|example|dummy|redacted|set|insert|todo", re.I)
_FILLER = re.compile(
    r"(?:change|replaced?|placeholder|your|our|my|example|dummy|redacted|set|insert|todo|me|it|this|that|with|before|after|here|key|token|secret|pass(?:word|phrase)?|pwd|api|auth|access|private|value|the|an?|real|user|"
    r"name|login|client|service|account|string|for|only|not|in|is|at|to|of|by|use|used|own|use|text|data|some|any|new|old|com|org|net|id|on|do|deploy|prod|dev|local|testing?|s)+",
    re.I,
)


def is_placeholder(value: str) -> bool:
    """Whether a value only stands for another: by its form, or by a run of letters that is made of such words alone.

    A run of letters that merely holds such a word, as one of a scrambled key may, is none.
    """
    if _PLACEHOLDER.search(value):
        return True
    return bool(_FILLS.search(value)) and any(_FILLS.search(run) and not re.fullmatch("set", run, re.I) and _FILLER.fullmatch(run) for run in re.findall("[A-Za-z]+", value))


_IDENTIFIER = re.compile(r"^[A-Za-z][a-z]*(?:[_\-.: ][A-Za-z][a-z]*|[A-Z][a-z]+)*$")
_HEX = re.compile(r"^(?:sha\d*-)?(?:0x)?[0-9a-f]+$|^[0-9A-F]+$|^sha\d+-")
_UUID = re.compile(r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", re.I)
_HARMLESS_NAME = re.compile(r"check_?sum|digest|sha_?\d|md5|hash|commit|revision|etag|integrity|public|cert|fingerprint|uuid|guid|nonce|trace|build|version", re.I)
_ABOUT_NAME = re.compile(r"field|label|name|hint|policy|prompt|title|column|header|param|attr|placeholder|path|file|url|uri|endpoint|length|count|type|kind|ttl|expir|_id\b", re.I)
_FROM_STORE = re.compile(r"environ|getenv|env[.\[(]|process\.|vault|secretsmanager|keyring|config\.get|settings\.|os\.get|lookup|fetch|read", re.I)
_CONFIG_PATH = re.compile(r"\.(?:ya?ml|json|toml|ini|cfg|conf|properties|env|sh|tf|md|txt)$", re.I)
_TEST_PATH = re.compile(r"(?:^|/)(?:tests?|spec|examples?|docs?|fixtures?|samples?)/", re.I)

KINDS = ("literal", "bare", "call", "address", "header", "block", "tagged", "words", "user", "argument", "value", "given")
#: Kinds whose place says nothing of secrets.
UNNAMED = KINDS[9:]


@dataclass
class Place:
    """A possible credential: its value, the parts of the content that hold it, and what surrounds it."""

    kind: str
    value: str
    parts: list[tuple[int, int]]
    name: str
    before: str


def speaks(name: str) -> bool:
    return bool(_SPEAKS.search(name.lower()) or _ENDING.search(name))


def _literals(text: str, at: int, joint: re.Pattern) -> list[tuple[int, int]]:
    """Spans inside the quotes of the literal at ``at`` and of those joined to it."""
    out: list[tuple[int, int]] = []
    while m := _LITERAL.match(text, at):
        out.append(m.span(m.lastgroup))
        at = joint.match(text, m.end()).end()
    return out


def places(text: str) -> list[Place]:
    """Every place of a content that can hold a credential, in order, one per beginning."""
    found: dict[int, Place] = {}
    low = text.lower()

    def add(kind: str, parts: list[tuple[int, int]], name: str, before: str) -> None:
        value = "".join(text[a:b] for a, b in parts)
        if value and parts[0][0] not in found:
            found[parts[0][0]] = Place(kind, value, parts, name, before)

    if "private key" in low:
        blocks = list(_KEY_BLOCK.finditer(text))
        for m, following in zip(blocks, [b.start() for b in blocks[1:]] + [len(text)]):
            end = _KEY_END.search(text, m.end(), following)
            stop = end.start() if end else _KEY_LINES.match(text, m.end(), following).end()
            body = text[m.end() : stop]
            solid = re.sub(r"\\[nr]|[\s\"'+,.;)\\]", "", body)
            if len(solid) >= 16 and not is_placeholder(solid[:40]) and re.match(r"[A-Za-z0-9+/=:\-]{16}", solid):
                found[m.start()] = Place("block", solid, [(m.end(), stop)], "private key", "")
    if "://" in low:
        for m in _ADDRESS.finditer(text):
            add("address", [m.span(1)], "password", "")
    closed = [(p.parts[0][0], p.parts[-1][1]) for p in found.values() if p.kind == "block"]
    for m in _USER.finditer(text) if "-u" in low else ():
        add("user", [m.span(1)], "password", "")
    named = chain(_SPEAKS.finditer(low) if any(a in low for a in _ANCHORS) else (), _ENDING.finditer(text) if "pw" in low or "pass" in low else ())
    for m in named:
        start = m.start()
        while start and (text[start - 1].isalnum() or text[start - 1] in "_-"):
            start -= 1
        rest = _REST_OF_NAME.match(text, m.end())
        line_start = text.rfind("\n", 0, start) + 1
        line_end = text.find("\n", m.end())
        line_end = len(text) if line_end < 0 else line_end
        if rest and rest.end() <= line_end + 1:
            name = text[start : rest.end()]
            wrap = _WRAPPED.match(text, rest.end())
            joint = _LIST_JOINT if wrap.group() else _JOINT
            if text[wrap.end() : wrap.end() + 3].lstrip("rbfuRBFU")[:1] in "\"'`" and (parts := _literals(text, wrap.end(), joint)):
                add("literal", parts, name, wrap.group())
            elif not wrap.group() and (b := _BARE.match(text, rest.end())):
                a, z = b.span()
                while z > a and text[z - 1] in "\\":
                    z -= 1
                if text[z : z + 1] not in "([{" or z == len(text):
                    add("bare", [(a, z)], name, text[line_start:start][-30:])
        elif call := _CALL.match(text, m.end()):
            args = _literals(text, call.end(), _LIST_JOINT)
            if args and text[args[-1][1] + 1 : args[-1][1] + 12].lstrip()[:1] == ")":
                add("call", args[-1:], text[start : m.end()], "")
        if _COMMENT.match(text[line_start : line_start + 60]):
            for w in re.finditer(r"[^\s\"'`,;]+", text[m.end() : line_end]):
                a, z = m.end() + w.start(), m.end() + w.end()
                colon = text.rfind(":", a, z)
                if colon > a and "://" not in text[a:z]:
                    a = colon + 1
                if z - a >= 6:
                    add("words", [(a, z)], text[line_start : m.end()][-40:], "")
    for m in _HEADER.finditer(text) if "token" in low or "basic" in low or "bearer" in low else ():
        add("header", [m.span(1)], text[m.start() : m.start(1)], "")
    joined_to = 0
    for m in _LONG.finditer(text):
        value = m[1]
        after = text[m.end() : m.end() + 1]
        if after and after not in "\"'`;,)<" and not after.isspace():
            continue
        if _TAGGED.match(value):
            a = m.start(1)
            parts = [m.span(1)]
            quote = text[a - 1]
            if quote in "\"'`":
                parts = _literals(text, a - 1, _JOINT) or parts
            line_start = text.rfind("\n", 0, a) + 1
            add("tagged", parts, text[line_start:a][-60:], "")
        elif m.start() >= joined_to and text[m.start()] != "=" and (b := text[m.end() : m.end() + 2]) and b[0] in "\"'`":
            # a tagged token written in parts shows its tag only in the first
            joined = _literals(text, m.start(), _JOINT)
            joined_to = joined[-1][1] if joined else 0
            if len(joined) > 1 and _TAGGED.match("".join(text[x:y] for x, y in joined)):
                line_start = text.rfind("\n", 0, m.start()) + 1
                add("tagged", joined, text[line_start : m.start()][-60:], "")
    # whatever its name: every quoted word and every bare word of an assignment that is no part of a place above
    covered = sorted(ab for p in found.values() for ab in p.parts)
    starts = [a for a, _ in covered]
    joined_to = 0
    for m in chain(_QUOTED.finditer(text), _GIVEN.finditer(text)):
        a, z = m.span(m.lastindex)
        i = bisect_right(starts, z - 1)
        if i and covered[i - 1][1] > a or m.re is _QUOTED and a < joined_to:
            continue
        line_start = max(text.rfind("\n", 0, a) + 1, a - 200)
        before = text[line_start : m.start()]
        if m.re is _GIVEN:
            add("given", [(a, z)], text[m.start() : a][-60:], "")
        elif _AFTER_USER.search(before):
            add("argument", [(a, z)], before[-60:], "")
        elif (before.strip() or text[m.end() : m.end() + 1] != ",") and not _KEY.match(text, m.end()):  # a line of a list of literals is data
            parts = _literals(text, m.start(), _JOINT)
            joined_to = parts[-1][1] if parts else 0
            add("value", parts if len(parts) > 1 else [(a, z)], before[-60:], before[-60:])
    out = []
    for at in sorted(found):
        p = found[at]
        if p.kind == "block" or not any(a <= at < b for a, b in closed):
            out.append(p)
    return out


# ---------------------------------------------------------------- features

N_FEATURES = 33
#: Where the kinds stand among the features: those of the first eight in front, the others at the end.
_KIND_AT = {k: i if i < 8 else 20 + i for i, k in enumerate(KINDS)}


def surprise(value: bytes, table: np.ndarray) -> float:
    """Mean surprise, in nats, of the characters of a value given the one before."""
    b = np.frombuffer(value, np.uint8)
    return float(-table[b[:-1], b[1:]].mean()) if len(b) > 1 else 0.0


def bare_value(p: Place) -> str:
    """The credential inside a value: the password of encoded log-in data, what an address in a value carries."""
    v = p.value
    if p.kind == "header" or re.match(r"basic ", v, re.I):
        raw = re.sub(r"^basic ", "", v, flags=re.I)
        try:
            plain = base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True).decode()
            if ":" in plain and plain.isprintable():
                return plain.split(":", 1)[1]
        except (ValueError, UnicodeDecodeError):
            pass
    m = re.match(r"(?:bearer|basic|token) +(.*)", v, re.I)
    if m:
        v = m[1]
    m = re.match(r"\w[\w+.\-]*" + _ADDRESS.pattern, v)
    return m[1] if m else v


def features(p: Place, path: str, table: np.ndarray) -> np.ndarray:
    v = bare_value(p)
    n = max(1, len(v))
    kinds = [(c.islower(), c.isupper(), c.isdigit()) for c in v]
    digits, uppers = sum(k[2] for k in kinds) / n, sum(k[1] for k in kinds) / n
    lowers = sum(k[0] for k in kinds) / n
    turns = sum(a != b for a, b in zip(kinds, kinds[1:])) / n
    x = np.zeros(N_FEATURES)
    x[_KIND_AT[p.kind]] = 1
    name = p.name
    s = surprise(v.encode("utf-8", "replace"), table)
    x[8:28] = [
        1.0,
        s / 5,
        min(np.log(n), 6) / 4,
        min(digits, 0.5) * 2,
        float(digits > 0),
        uppers,
        1 - digits - uppers - lowers,
        turns,
        float(speaks(name)),
        float(bool(_ABOUT_NAME.search(name))),
        float(bool(_HARMLESS_NAME.search(name))),
        float(bool(_FROM_STORE.search(p.before))),
        float(is_placeholder(v)),
        float(bool(_IDENTIFIER.match(v))),
        float(bool(_HEX.match(v)) and p.kind != "address"),
        float(bool(_UUID.match(v)) or v.startswith("data:") or "BEGIN" in v and "PRIVATE" not in v),
        float(" " in v.strip() or "${" in v or "{" in v or "(" in v),
        float(bool(_TAGGED.match(v))),
        float(bool(_CONFIG_PATH.search(path))),
        float(bool(_TEST_PATH.search(path))),
    ]
    x[32] = float(p.kind in UNNAMED and bool(_DATA.search(v) or _ID.search(name)))
    return x


def weak_label(p: Place, x: np.ndarray) -> int:
    """1 or 0 where the pattern leaves little doubt, else -1."""
    v = bare_value(p)
    if x[20] or x[21] or x[23] or x[19]:
        return 0
    if p.kind in ("block", "tagged"):
        return 1
    if x[24]:
        return 0
    mixed = bool(re.search(r"[A-Za-z]", v) and re.search(r"\d", v))
    scrambled = len(v) >= 10 and x[15] > 0.35 and v.isalnum() and x[13] > 0.15
    if p.kind in ("address", "user"):
        return 1 if mixed or scrambled else -1
    if x[25]:
        return 1
    if x[16] and not x[17] and not x[18] and (len(v) >= 8 and mixed or scrambled) and p.kind in ("literal", "call", "header"):
        return 1
    if x[18] and x[22]:
        return 0
    if p.kind == "argument":
        return 0 if x[32] or not mixed else 1 if len(v) >= 8 and re.search(r"[^\w.]", v) or scrambled else -1
    if p.kind in UNNAMED:
        return 0
    if p.kind == "words":
        symbols = bool(re.search(r"[^\w\s]", v[:-1])) and not re.search(r"[/()]", v)
        return 1 if len(v) >= 8 and mixed and symbols or scrambled else 0 if not re.search(r"\d", v) else -1
    if p.kind == "bare":
        return (-1 if scrambled else 0) if not mixed else 1 if re.search(r"[A-Z]", v) and re.search(r"[a-z]", v) and len(v) >= 10 and not re.search(r"[./(]", v) else -1
    return -1


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 300, even: bool = True) -> np.ndarray:
    """Weights of a logistic regression, both classes weighing the same if ``even``."""
    if not len(y) or y.min() == y.max():
        w = np.zeros(N_FEATURES)
        w[8] = -1.0
        w[[5, 6, 3, 25]] = 4.0
        w[[20, 21]] = -6.0
        return w
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) if even else np.ones(len(y))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton steps with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (p - y)) + 1.0 * w
        h = (x.T * (share * p * (1 - p))) @ x + 1.0 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) by which a held-out score becomes a probability."""
    a, b = 1.0, 0.0
    if not len(y) or y.min() == y.max():
        return a, b
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        a -= 0.05 * float(((p - y) * score).mean())
        b -= 0.05 * float((p - y).mean())
    return a, b


def example(p: Place, path: str, table: np.ndarray) -> tuple[str, int, list[float], list[float]] | None:
    """(kind, label, features, features as a plain word) of a place of little doubt, the last for credentials under a name only."""
    x = features(p, path, table)
    y = weak_label(p, x)
    if y < 0:
        return None
    known = y and p.kind in ("literal", "call", "address", "user", "bare")
    return p.kind, y, x.tolist(), features(Place("value", bare_value(p), [], "", ""), path, table).tolist() if known else []


@dataclass
class Model:
    table: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    #: The same of the places without a telling name; none are found without weights.
    unnamed: np.ndarray | None = None
    unnamed_slope: float = 1.0
    unnamed_shift: float = 0.0

    @classmethod
    def of(cls, table: np.ndarray, rows: list[tuple[str, int, list[float], list[float]]]) -> Model:
        """Fitted on (kind, label, features, features as a plain word or none) of sampled places."""
        named = [r for r in rows if r[0] not in UNNAMED]
        plain = [(r[1], r[2]) for r in rows if r[0] in UNNAMED] + [(1, r[3]) for r in named if r[3]]
        parts = []
        for rows_, even in (([(r[1], r[2]) for r in named], True), (plain, False)):
            x, y = np.asarray([r[1] for r in rows_]).reshape(-1, N_FEATURES), np.asarray([r[0] for r in rows_])
            held = np.arange(len(y)) % 5 == 0
            w = fit(x[~held], y[~held], even=even)
            parts += [w, *calibrate(x[held] @ w, y[held])]
        return cls(table, *parts)

    def found(self, text: str, path: str, least: float = LEAST) -> list[tuple[Place, float]]:
        """The places of a content at or above the least score."""
        out = []
        for p in places(text):
            if p.kind in UNNAMED and (_DATA.search(bare_value(p)) or _ID.search(p.name)):
                continue  # as below, without a look at the rest
            x = features(p, path, self.table)
            if x[20] or x[23] and p.kind != "block" or p.kind in UNNAMED and (x[22] or x[32]):
                continue  # placeholders, and digests, ids and the like of no telling name
            w, slope, shift = (self.unnamed, self.unnamed_slope, self.unnamed_shift) if p.kind in UNNAMED else (self.weights, self.slope, self.shift)
            if w is None:
                continue
            s = 1 / (1 + np.exp(-np.clip(slope * float(x @ w) + shift, -30, 30)))
            if s >= least:
                out.append((p, float(s)))
        return out


def lines_of(text: str, at: list[int]) -> list[int]:
    """1-based numbers, each once, of the lines on which the positions lie."""
    ends = [m.start() for m in re.finditer("\n", text)]
    return sorted({bisect_right(ends, a - 1) + 1 for a in at})


#: An escape inside a literal; what follows stands for an x in each of its forms.
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|([0-7]{3})|(.))", re.S)


def _masked(value: str, block: bool) -> str:
    """A value with x for its characters: as long, lines, quotes and escapes kept, a bare number still a number."""
    if re.fullmatch(r"[0-9][0-9._]*", value):
        return re.sub("[0-9]", "1", value)

    def escape(m: re.Match) -> str:
        for digits in m.groups()[:4]:
            if digits:
                return m[0][: m.start(m.lastindex) - m.start()] + "78".rjust(len(digits), "0")[-len(digits) :] + m[0][m.end(m.lastindex) - m.start() :]
        return "\\170" if m[5] else m[0]

    # in a key block, kept are also what joins its lines
    kept = "\n\r\"'`" + ("+ \t.,;()" if block else "")
    out, at = [], 0
    for m in [*_ESCAPE.finditer(value), None]:
        end = m.start() if m else len(value)
        out.append("".join(c if c in kept or c == "\\" else "x" for c in value[at:end]))
        if m:
            out.append(escape(m))
            at = m.end()
    return "".join(out)


def redact(text: str, model: Model, path: str, least: float = LEAST) -> str:
    """The content with every credential masked; it is as long as before and has the same lines."""
    out, at = [], 0
    spans = sorted((a, b, p.kind == "block") for p, _ in model.found(text, path, least) for a, b in p.parts)
    for a, b, block in spans:
        if b <= at:
            continue
        a = max(a, at)
        out += [text[at:a], _masked(text[a:b], block)]
        at = b
    return "".join(out) + text[at:]


# ---------------------------------------------------------------- the operator


def fit_model(tables: list[tuple[DataFrame, str, str]], content: str = "content") -> Model:
    """A model from (rows, key, path column) of several tables: characters of all, places of a bounded sample."""
    spark = tables[0][0].sparkSession
    ship(spark)

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(65536, np.int64)
        for b in batches:
            raw = "\n".join(x for x in b.column(0).to_pylist() if x).encode("utf-8", "replace")
            c = np.frombuffer(raw, np.uint8).astype(np.int32)
            if len(c) > 1:
                n += np.bincount((c[:-1] << 8) | c[1:], minlength=65536)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[k])], ["k", "n"])

    def sampling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = []
            for text, where in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for p in places(text or ""):
                    if p.kind in ("value", "given") and crc32(p.value.encode("utf-8", "replace")) % 4:
                        continue  # a fourth of the plain words is enough to learn from
                    if e := example(p, where, held.value):
                        seen.append((blake2b("\0".join((p.kind, p.value, p.name, p.before, where)).encode("utf-8", "replace"), digest_size=16).digest(), *e))
            columns = [list(c) for c in zip(*seen)] or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.string(), pa.int32(), numbers, numbers))], ["of", "kind", "label", "x", "plain"])

    numbers = pa.list_(pa.float64())
    counts, parts = None, []
    for df, key, path in tables:
        n = df.count()
        own = df.select(F.col(content)).mapInArrow(counting, "k bigint, n bigint")
        share = min(1.0, SAMPLE_RECORDS / max(1, n * len(tables)))
        part = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20))).select(content, F.coalesce(F.col(path), F.lit("")).alias("path"))
        counts = own if counts is None else counts.union(own)
        parts.append(part)
    n = np.full(65536, 0.1)
    for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect():
        n[r.k] += r.n
    n = n.reshape(256, 256)
    table = np.log(n / n.sum(1, keepdims=True))
    held = spark.sparkContext.broadcast(table)
    sampled = None
    for part in parts:
        rows = part.mapInArrow(sampling, "of binary, kind string, label int, x array<double>, plain array<double>")
        sampled = rows if sampled is None else sampled.union(rows)
    return Model.of(table, [tuple(r)[1:] for r in sorted(sampled.dropDuplicates(["of"]).orderBy("of").limit(PLACES_MOST).collect())])


def find(df: DataFrame, model: Model, key: str, version: str, path: str, content: str = "content") -> DataFrame:
    """(record_key, line_no): the lines on which a credential of a record begins, each once.

    The record of a key is its row of the latest ``version``; only keys and line numbers are shuffled. Null or empty
    content has none; a null path counts as empty; a null key is dropped.
    """
    spark = df.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            lines = []
            for text, where in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                hits = m.found(text, where or "") if text else []
                lines.append(lines_of(text, [p.parts[0][0] if p.kind != "block" else p.parts[0][0] - 1 for p, _ in hits]) if hits else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lines, pa.list_(pa.int32()))], ["key", "version", "lines"])

    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, version)}
    rows = df.select(F.col(key).alias("key"), F.col(version).alias("version"), F.col(content).alias("content"), F.col(path).alias("path"))
    lines = rows.mapInArrow(run, f"key {kinds[key]}, version {kinds[version]}, lines array<int>")
    return latest(lines, "key", "version").select(F.col("key").alias("record_key"), F.explode("lines").alias("line_no"))


def redacted(df: DataFrame, model: Model, key: str, version: str, path: str, content: str = "content") -> DataFrame:
    """(key, content): every record with its credentials replaced character by character; null content stays null."""
    spark = df.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            out = [redact(t, m, w or "") if t else t for t, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["key", "content"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(version).alias("version"), F.col(content).alias("content"), F.col(path).alias("path"))
    out = latest(rows, "key", "version").select("key", "content", "path").mapInArrow(run, f"key {kind}, content string")
    return out.toDF(key, content)
