"""Generated, minified, vendored and data files among source files (problem 3).

Character trigram models of identifiers, one per language, are counted over all rows. Every file is described by numbers:
how improbable its names are under the model of its language (mangled names), how few stems its names have and how few
shapes its lines (templates), how much of it is names, blanks, punctuation (literal data, text without line ends), and how
far its naming style lies from that of its language. Each number is measured in spreads of its language
over all records. One logistic regression a kind, fitted on a bounded sample with weak labels, turns them into log-odds.
Weak labels are what tools leave behind: their statements, directories and file names. These also add to the
log-odds of a file, since a statement about the whole file is evidence where the shape of a short file says little.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import cut, ship
from corpusmill.sources.tables import latest

#: Records whose numbers and weak labels are used for fitting, by a hash of the path; all other statistics are over all records.
SAMPLE_RECORDS = 12_000
#: Languages with a model of their own, the most frequent ones; the rest share one over everything.
LANGUAGES_MOST = 200
#: Rounds of fitting; after each, files without a trace are left out whose log-odds reach this.
ROUNDS, DOUBT = 3, -2.0
#: What is usual in a language with fewer records than this is taken from all records.
LANGUAGE_LEAST = 30
#: What a statement about the file, or lying in a vendor's directory, and a tool's directory or file name add to the log-odds.
STATEMENT, PLACE = 18.0, 4.0

# letters are 1..26 in either case, a digit 27, an underscore 28, all else 0 (ends a name)
_CODES = np.zeros(256, np.int64)
_CODES[97:123] = _CODES[65:91] = np.arange(1, 27)
_CODES[48:58] = 27
_CODES[95] = 28
_N = 29

#: What tools and vendors write, mostly at the head or end of a file, anchored to the beginning of a comment.
_TOOL = re.compile(
    r"^\W*(?:code generated by\b.*do not edit|@generated\b|<auto-?generated|auto-?generated (?:file|by)\b|machine-written by\b|automatically generated by\b|generated by\b|"
    r"this file (?:was|is|has been) (?:automatically|auto-?|machine)[ -]?(?:created|generated|written)|automatisch (?:erzeugt|generiert)\b|fichier (?:produit|généré|genere) par\b|"
    r"archivo generado\b|produced by the \S+ compiler|do not (?:modify|edit)\b.*(?:output of|generated)|このファイルは自動生成|自动生成)",
    re.I,
)
_VENDOR = re.compile(
    r"^\W*(?:third-?party (?:copy|code|library)\b|vendored (?:from|copy)\b|bundled dependency\b|copied from upstream\b|imported from upstream\b|[\w.\-@/]+ v?\d+\.\d+(?:\.\d+)*\S* \| \(c\))",
    re.I,
)
#: A bare name and version speaks of the file only above its code.
_BANNER = re.compile(r"^\W*[\w.\-@/]+ v\d+\.\d+\.\d+\S*\W*$", re.I)
_COMMENT = re.compile(r"^\s*(?:#(?!!|include|define|if|pragma)|//|/\*|\*|--|<!--|;|\"\"\"|''')")
_VENDOR_DIR = re.compile(r"(?:^|/)(?:vendor|vendors|vendored|third[_-]?party|external|externals|extern|deps|godeps|node_modules|bower_components|site-packages|pods)/", re.I)
_TOOL_DIR = re.compile(r"(?:^|/)(?:generated|__generated__|autogen|auto_generated|gen|codegen_out)/", re.I)
_TOOL_NAME = re.compile(r"(?:\.pb\.\w+|_pb2(?:_grpc)?\.py|\.g\.\w+|[._](?:generated|gen|autogen)\.\w+)$", re.I)
_SMALL_NAME = re.compile(r"[.\-](?:min|bundle|prod)\.\w+$", re.I)
_PROSE = re.compile(r"\.(?:md|rst|txt|json|ya?ml|toml|ini|cfg|conf|xml|properties)$", re.I)
_DATA = re.compile(r"(?:(?:0[xX][0-9a-fA-F]{1,16}|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)[uUlLfF]*\s*,\s*){12,}|[\"'][A-Za-z0-9+/=]{40,}[\"']|(?:\\x[0-9a-fA-F]{2}){16,}|(?:[\"'][0-9a-fA-F]{16,}[\"']\s*,\s*){4,}")
_LETTERS = re.compile(r"[A-Za-z_]{3}")
_STRINGS = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`"
#: Strings and comments, by how the language begins a comment.
_HASHED = re.compile(rf"{_STRINGS}|#[^\n]*")
_SLASHED = re.compile(rf"{_STRINGS}|/\*.*?\*/|//[^\n]*", re.S)
_STARRED = re.compile(rf"{_STRINGS}|/\*.*?\*/", re.S)
_NAME = re.compile(r"[A-Za-z_$]\w*")
_WORD = re.compile(r"\w+")
_NINES = str.maketrans("012345678", "999999999")
_RUN = re.compile("9+")
_CAMEL = re.compile(r"[a-z]+\d*[A-Z]\w*")
_SNAKE = re.compile(r"[a-z]+\d*_[a-z]\w*")
_PROSE_LANGUAGES = {"json", "yaml", "markdown", "xml", "toml", "text"}
_HASH_LANGUAGES = {"python", "shell", "ruby", "perl", "r"}
#: Languages in which a plain list of like lines is how people write.
_LISTING_LANGUAGES = {"css", "scss", "sql", "shell", "html"}

#: What is measured of a file, the least spread of each number, and the kinds with their numbers' weights before any data is seen.
NUMBERS = ("entropy", "stems", "shapes", "blanks", "names", "marks", "length", "size", "bare", "digits", "vocabulary", "camel")
_LEAST_SPREAD = np.asarray([0.05, 0.1, 0.2, 0.15, 0.15, 0.3, 1.0, 0.5, 0.1, 0.3, 0.3, 0.1])
FEATURES = ("one", *NUMBERS[:-1], "long", "style")
KINDS = ("data", "minified", "vendored", "generated")
_BEFORE = {
    "data": {"one": -7, "names": -2, "marks": -2, "digits": 2, "vocabulary": -3, "shapes": -2},
    "minified": {"one": -7, "entropy": 4, "long": 4, "blanks": -3},
    "vendored": {"one": -9, "style": 6},
    "generated": {"one": -7, "stems": -5, "shapes": -2},
}


def codes(text: str) -> np.ndarray:
    return _CODES[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]


def trigrams(c: np.ndarray) -> np.ndarray:
    """Numbers of the trigrams that end in a name; the first characters of a name follow its boundary."""
    if len(c) < 3:
        return np.zeros(0, np.int64)
    return ((c[:-2] * _N + c[1:-1]) * _N + c[2:])[c[1:-1] > 0]


def bare(text: str, language: str | None) -> str:
    """A text without its comments, strings as a quote."""
    kind = _HASHED if language in _HASH_LANGUAGES else _STARRED if language in ("css", "html", "sql") else _SLASHED
    return kind.sub('"', text)


def judgeable(path: str, language: str | None, text: str | None) -> bool:
    return bool(text) and not (language in _PROSE_LANGUAGES or _PROSE.search(path) or not text.strip())


def measure(text: str, language: str | None, table: np.ndarray | None) -> tuple[list[float], float]:
    """(the NUMBERS of a text, share of its characters in long lines)."""
    code = bare(text, language)
    names = _NAME.findall(code)
    distinct = set(names)
    g = trigrams(codes(" " + " ".join(distinct) + " "))
    entropy = float(-table[g].mean()) if table is not None and len(g) else 0.0
    stems = {_RUN.sub("9", x.translate(_NINES)) for x in distinct}
    lines = [x.strip() for x in code.split("\n")]
    lines = [x for x in lines if x]
    shapes = {_WORD.sub("w", x) for x in lines}
    camel, snake = len([x for x in distinct if _CAMEL.match(x)]), len([x for x in distinct if _SNAKE.match(x)])
    share = lambda n, of, least: float(np.log(max(n / max(1, of), least)))
    numbers = [
        entropy,
        share(len(stems), len(distinct), 0.02) if len(distinct) >= 5 else 0.0,
        share(len(shapes), len(lines), 0.01) if lines else 0.0,
        share(sum(map(text.count, " \t\n\r")), len(text), 0.002),
        share(sum(map(len, names)), len(text), 0.005),
        share(sum(map(code.count, "();{}:")), len(code), 0.001),
        sum(map(len, distinct)) / max(1, len(distinct)),
        float(np.log(len(text))),
        share(len(code), len(text), 0.05),
        share(sum(map(text.count, "0123456789,")), len(text), 0.01),
        float(np.log(1 + len(distinct))),
        (camel + 1) / (camel + snake + 2),
    ]
    return numbers, sum(len(x) for x in text.split("\n") if len(x) > 200) / len(text)


#: Bits of what tools and vendors leave behind.
TOOL_SAYS, TOOL_PLACE, VENDOR_SAYS, VENDOR_PLACE, SMALL_PLACE, ALL_DATA = 1, 2, 4, 8, 16, 32


def traces(path: str, language: str | None, text: str) -> int:
    """Bits: statements in comments, directories, names, and whether the text is literal data to the eye."""
    lines = [x for x in text.split("\n") if x.strip()]
    first = next((i for i, x in enumerate(lines) if not _COMMENT.match(x)), len(lines))
    head = [x for x in lines[: max(12, first)] if _COMMENT.match(x)]
    # below the head a statement about the file stands at the margin; an indented one is about the code around it
    said = head + [x for x in lines[max(12, first) :] if not x[:2].isspace() and _COMMENT.match(x)]
    bits = TOOL_SAYS * any(_TOOL.match(x) for x in said) | TOOL_PLACE * bool(_TOOL_DIR.search(path) or _TOOL_NAME.search(path))
    bits |= VENDOR_SAYS * (any(_VENDOR.match(x) for x in said) or any(_BANNER.match(x) for x in head)) | VENDOR_PLACE * bool(_VENDOR_DIR.search(path))
    bits |= SMALL_PLACE * bool(_SMALL_NAME.search(path))
    if sum(map(text.count, "();{}:")) < 0.02 * len(text) and sum(m.end() - m.start() for m in _DATA.finditer(text)) > 0.85 * len(text):
        # a few endless lines in a file of code do not make it a blob
        bits |= ALL_DATA * (sum(bool(_LETTERS.search(x)) for x in _DATA.sub("", text).split("\n")) <= max(8, 0.15 * len(lines)))
    return bits


def weak_labels(bits: np.ndarray) -> dict[str, np.ndarray]:
    """Of every kind, 1 where a trace speaks for it, else 0."""
    has = lambda b: (bits & b) > 0
    return {
        "data": has(ALL_DATA),
        "minified": has(SMALL_PLACE) & ~has(ALL_DATA),
        "vendored": has(VENDOR_SAYS | VENDOR_PLACE) & ~has(SMALL_PLACE | ALL_DATA),
        "generated": has(TOOL_SAYS | TOOL_PLACE) & ~has(SMALL_PLACE | ALL_DATA),
    }


def fit(x: np.ndarray, y: np.ndarray, before: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weights of a logistic regression, drawn towards those of before; Newton steps, halved while they lead upwards."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ((w - before) ** 2).sum() / 2)

    w, now = before.copy(), loss(before)
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x.T * (p * (1 - p))) @ x + np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + (w - before))
        while (new := loss(w - step)) > now and np.abs(step).max() > 1e-6:
            step /= 2
        w, now = w - step, new
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    """Log-probabilities of trigrams by language, what is usual of each number there, and the weights by kind."""

    tables: dict[str, np.ndarray] = field(default_factory=dict)
    usual: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def table(self, language: str | None) -> np.ndarray | None:
        return self.tables.get(language or "", self.tables.get(""))

    def features(self, languages: list[str | None], numbers: np.ndarray, long: np.ndarray) -> np.ndarray:
        """Numbers in spreads of their language, a fourth each, with the share of long lines and the distance of the naming style."""
        z = np.zeros_like(numbers)
        for la in set(languages):
            own = np.fromiter((x == la for x in languages), bool, len(languages))
            if (u := self.usual.get(la or "", self.usual.get(""))) is not None:
                z[own] = np.clip((numbers[own] - u[0]) / u[1], -8, 8) / 4
        return np.c_[np.ones(len(z)), z[:, :-1], long, np.maximum(np.abs(z[:, -1]) - 1, 0)]

    def log_odds(self, languages: list[str | None], numbers: np.ndarray, long: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """(file, kind) log-odds of every kind."""
        x = self.features(languages, numbers, long)
        out = np.stack([x @ self.weights[k] if k in self.weights else np.full(len(x), -9.0) for k in KINDS], 1)
        has = lambda b: ((bits & b) > 0).astype(float)
        out[:, 1] += PLACE * has(SMALL_PLACE)
        out[:, 2] += STATEMENT * np.maximum(has(VENDOR_SAYS), has(VENDOR_PLACE))
        out[:, 3] += STATEMENT * has(TOOL_SAYS) + PLACE * has(TOOL_PLACE)
        # people write lists of like lines in these languages, and nobody is told apart by style there
        listing = np.fromiter((x in _LISTING_LANGUAGES for x in languages), bool, len(languages))
        out[listing & (has(TOOL_SAYS) == 0), 3] = -9.0
        return out

    def kinds(self, languages: list[str | None], numbers: np.ndarray, long: np.ndarray, bits: np.ndarray) -> list[str | None]:
        odds = self.log_odds(languages, numbers, long, bits) if len(languages) else np.zeros((0, len(KINDS)))
        first = (odds > 0).argmax(1)
        return [KINDS[i] if odds[r, i] > 0 else None for r, i in enumerate(first.tolist())]


def classify(path: str, language: str | None, text: str | None, model: Model) -> str | None:
    """What one file is if nobody wrote it by hand here, else None."""
    if not judgeable(path, language, text):
        return None
    numbers, long = measure(text, language, model.table(language))
    return model.kinds([language], np.asarray([numbers]), np.asarray([long]), np.asarray([traces(path, language, text)]))[0]


# ---------------------------------------------------------------- the operator


def fit_tables(rows: DataFrame) -> dict[str, np.ndarray]:
    """Trigram models of the distinct names of every row (language, content): nothing but counts is shuffled."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for b in batches:
            for language, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    g = trigrams(codes(" " + " ".join(set(_NAME.findall(bare(text, language)))) + " "))
                    n = grams.setdefault(language or "", np.zeros(_N**3, np.int64))
                    n += np.bincount(g, minlength=_N**3)
        for language, n in grams.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(k), pa.string()), pa.array(k), pa.array(n[k])], ["language", "k", "n"])

    counts = cut(rows.select("language", "content").mapInArrow(run, "language string, k bigint, n bigint").groupBy("language", "k").agg(F.sum("n").alias("n")))
    most = [r[0] for r in counts.where("language <> ''").groupBy("language").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "language").limit(LANGUAGES_MOST).collect()]
    own = counts.where(F.col("language").isin(most)).toPandas()
    every = counts.groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    tables = {}
    for language, part in [*own.groupby("language"), ("", every)]:
        n = np.full(_N**3, 0.05)
        n[part["k"].to_numpy()] += part["n"].to_numpy()
        n = n.reshape(_N * _N, _N)
        tables[language] = np.log(n / n.sum(1, keepdims=True)).ravel().astype(np.float32)
    return tables


def measured(df: DataFrame, key: str = "path", version: str = "scanned_at", language: str = "language", content: str = "content") -> tuple[DataFrame, Model]:
    """((path, language, numbers, long, bits) of every judgeable record, the fitted model); the rows are cut."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(key).alias("path"), F.col(version).alias("version"), F.col(language).alias("language"), F.col(content).alias("content")).where(F.col("path").isNotNull())
    model = Model(fit_tables(rows))
    held = spark.sparkContext.broadcast(model)
    list_ = pa.list_(pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            numbers, long, bits = [], [], []
            for p, la, t in zip(*(b.column(i).to_pylist() for i in (0, 2, 3))):
                n, x, c = (*measure(t, la, m.table(la)), traces(p, la, t)) if judgeable(p, la, t) else (None, None, None)
                numbers.append(n)
                long.append(x)
                bits.append(c)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(numbers, list_), pa.array(long, pa.float32()), pa.array(bits, pa.int32())], ["path", "version", "language", "numbers", "long", "bits"])

    # measured before the latest row is settled, so that content is not shuffled
    kind = rows.schema["version"].dataType.simpleString()
    out = rows.mapInArrow(run, f"path string, version {kind}, language string, numbers array<float>, long float, bits int")
    records = cut(latest(out, "path", "version").where(F.col("numbers").isNotNull()).drop("version"))
    # what is usual: median and spread of every number, by language and over everything
    quantiles = [F.percentile_approx(F.col("numbers")[i], F.array(F.lit(0.16), F.lit(0.5), F.lit(0.84)), 1000).alias(f"q{i}") for i in range(len(NUMBERS))]
    named = F.when(F.col("language").isin(list(model.tables)), F.col("language")).otherwise("")
    own = records.groupBy(named.alias("language")).agg(F.count("*").alias("n"), *quantiles).where(F.col("n") >= LANGUAGE_LEAST).collect()
    for r in own + records.agg(F.lit("").alias("language"), F.count("*").alias("n"), *quantiles).collect():
        if r.n:
            q = np.asarray(r[2:], float)
            # the narrower side: files that nobody wrote stretch the other
            model.usual[r[0]] = (q[:, 1], np.maximum(np.minimum(q[:, 2] - q[:, 1], q[:, 1] - q[:, 0]), _LEAST_SPREAD))
    n = records.count()
    bound = 1 << 20
    sample = records.where(F.pmod(F.xxhash64("path"), F.lit(bound)) < int(bound * min(1.0, SAMPLE_RECORDS / max(n, 1)))).collect()
    sample.sort(key=lambda r: r.path)
    before = {k: np.asarray([float(w.get(f, 0)) for f in FEATURES]) for k, w in _BEFORE.items()}
    x, labels = np.zeros((0, len(FEATURES))), {k: np.zeros(0) for k in KINDS}
    if sample:
        x = model.features([r.language for r in sample], np.asarray([r.numbers for r in sample], float), np.asarray([r.long for r in sample], float))
        labels = weak_labels(np.asarray([r.bits for r in sample]))
    for k in KINDS:
        y, w = labels[k].astype(float), before[k]
        use = np.ones(len(y), bool)
        for _ in range(ROUNDS if k != "data" else 1):  # what is data shows without a trace
            w = fit(x[use], y[use], before[k])
            if y.any() and np.median((x @ w)[y > 0]) < DOUBT:
                break  # where files with a trace are written like any other, likeness to them says nothing
            # a file without a trace that looks like those with one is no example of the others
            use = (y > 0) | (x @ w < DOUBT)
        model.weights[k] = w
    return records, model


def foreign(df: DataFrame, key: str = "path", version: str = "scanned_at", language: str = "language", content: str = "content") -> DataFrame:
    """(path, kind): every record that nobody wrote by hand here, with what it is.

    The record of a path is its row of the latest ``version``. Null or empty content and null paths are no
    case, nor are configuration and documentation files; a null language is judged by what is usual over everything.
    """
    records, model = measured(df, key, version, language, content)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            if b.num_rows:
                numbers = np.asarray(b.column(2).to_pylist(), float).reshape(-1, len(NUMBERS))
                kinds = m.kinds(b.column(1).to_pylist(), numbers, b.column(3).to_numpy(), b.column(4).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.string())], ["path", "kind"])

    return records.mapInArrow(run, "path string, kind string").where(F.col("kind").isNotNull()).select(F.col("path").alias(key), "kind")


def hand_written(df: DataFrame, key: str = "path", version: str = "scanned_at") -> DataFrame:
    """The records left for indexing: those that :func:`foreign` does not name, all columns."""
    return latest(df, key, version).join(foreign(df, key, version).select(key), key, "left_anti")
