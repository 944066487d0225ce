"""Abusive, hateful or sexual content (problem 9).

Every token has a log-odds score between abusive passages and all other text, with a Dirichlet prior from
the counts of the whole corpus. A linear scan finds the segments of maximal score of a text; their scores
are calibrated by the extreme-value distribution that such maxima follow in ordinary text, so a
long text is not suspicious just because it is long. The scores come from documents judged as a whole: in
turns, the best segments of abusive documents are taken as the abusive passages, and the scores
are fitted again, so that the innocent rest of those documents counts as ordinary text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import ship

#: At most this many judged documents are used for fitting (those with the smallest hash of their id).
JUDGED_MOST = 20_000
#: Strength of the prior in tokens, what a token costs that says nothing, and the bounds of a score.
PRIOR, DRIFT, LOWEST, HIGHEST = 300.0, 1.0, -2.0, 5.0
ROUNDS, PASSAGE = 4, 4.0
#: Parts of the judged documents that are scored by a model of the others.
FOLDS = 5
#: A text is flagged only if ordinary text has so bad a passage with a chance of at most 10 to the minus this; of
#: a corpus of which some hundredths are abusive, such ordinary texts are then a few hundredths of what is flagged.
SIGNIFICANT = 3.0
#: From this chance on a text judged innocent is taken for a wrong judgement.
WRONG = 8.0

# ---------------------------------------------------------------- reading disguised spelling

#: Letters of other scripts that look like Latin ones, and the reverse.
_LOOKALIKES = dict(zip("аеорсухіјѕԁһкмтвнαορνικτ", "aeopcyxijsdhkmtbhaopvikt"))
_LOOKALIKE = re.compile(f"[{''.join(_LOOKALIKES)}]")
_HIDDEN = re.compile("[­​-‏⁠﻿]|[̀-ͯ]")
_DIGITS = str.maketrans("013457@$!|", "oieastasii")
_SPACED = re.compile(r"(?<![\w'])[^\W\d_](?:[ .\-_*][^\W\d_]){3,}(?![\w'])")
# the next two begin with rare characters, so that most of a text is skipped at the speed of a byte search
_MAY_BE_SPACED = re.compile(r"[ .\-_*][^\W\d_][ .\-_*][^\W\d_][ .\-_*][^\W\d_](?![^\W_])")
_STARRED = re.compile(r"[*@$!#](?<=[^\W_].)(?:[*@$!#]*(?=[^\W_])|(?<=\$)\$+)")
_MIXED = re.compile(r"(?=[a-z]*[0-9])[a-z0-9]*[a-z][a-z0-9]*$")
_WORD = re.compile(r"[^\W_]+")
_PLAIN_WORD = re.compile(r"[a-z0-9ø]+")
_WIDE = re.compile("[぀-ヿ㐀-鿿가-힯]")
_VOWELS = str.maketrans("", "", "aeiou")


def words(text: str) -> list[str]:
    """Tokens of a text in plain spelling: folded case, look-alike letters, letters set apart, digits for letters.

    A run of letters of a script without spaces gives its pairs of letters.
    """
    plain = text.isascii()
    if not plain:
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    text = text.lower()
    if not plain:
        text = _LOOKALIKE.sub(lambda m: _LOOKALIKES[m[0]], text)
    if _MAY_BE_SPACED.search(text):
        text = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), text)
    text = _STARRED.sub("ø", text)
    if plain:
        return _PLAIN_WORD.findall(text)
    out = _WORD.findall(text)
    if _WIDE.search(text):
        split: list[str] = []
        for w in out:
            if _WIDE.search(w):
                split += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
            else:
                split.append(w)
        out = split
    return out


def folded(word: str) -> str:
    """A word with digits or stars among its letters as its consonants, marked; any other as it is."""
    if word.isalpha() and "ø" not in word:
        return word
    if "ø" in word:
        return "~" + re.sub("ø+", "*", word.translate(_DIGITS))
    if _MIXED.match(word):
        return word.translate(_DIGITS)
    return "0" if word.isdigit() else word


class _Folded(dict):
    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = folded(word)
        return out


_folded = _Folded()


# ---------------------------------------------------------------- segments


def best_segments(score: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Greatest sum of a run of scores of each text, 0 if none is positive; text k is ends[k]..ends[k+1]."""
    n = np.diff(ends)
    out = np.zeros(len(n))
    has = np.flatnonzero(n > 0)
    if not has.size:
        return out
    step = score.astype(np.float64)
    low = np.abs(step).sum() + 1.0
    # each text starts lower than any prefix of the one before ever was, so minima never carry over
    sums = np.cumsum(step)
    start = ends[:-1][has]
    shift = np.repeat(np.arange(len(has)) * 2 * low, n[has])
    sums = sums - shift
    before = np.r_[0.0, sums[:-1]]
    before[start] = np.where(start > 0, np.r_[0.0, np.cumsum(step)][start], 0.0) - np.arange(len(has)) * 2 * low
    gain = sums - np.minimum.accumulate(before)
    out[has] = np.maximum(np.maximum.reduceat(gain, start), 0)
    return out


def maximal_segments(score: np.ndarray | list[float]) -> list[tuple[float, int, int]]:
    """(sum, first, after) of all maximal scoring segments of a text, in linear time (Ruzzo and Tompa).

    Only positive tokens are visited. A candidate keeps a link to the last one before it of smaller left sum, so the
    search for that one skips all that an earlier search has passed.
    """
    step = np.asarray(score, np.float64)
    at = np.flatnonzero(step > 0)
    through = np.cumsum(step)[at]
    lefts, rights = (through - step[at]).tolist(), through.tolist()
    stack: list[tuple[float, float, int, int, int]] = []  # (sum before, sum through, first, after, link)
    for i, left, right in zip(at.tolist(), lefts, rights):
        first, k = i, len(stack) - 1
        while True:
            while k >= 0 and stack[k][0] >= left:
                k = stack[k][4]
            if k < 0 or stack[k][1] >= right:
                stack.append((left, right, first, i + 1, k))
                break
            left, _, first, _, link = stack[k]
            del stack[k:]
            k = link
    return [(r - le, a, b) for le, r, a, b, _ in stack]


# ---------------------------------------------------------------- the model


class _Numbers(dict):
    """Number of each raw word: that of its folded form, 0 for those that are not in the lexicon."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self._known = known

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = self._known.get(folded(word), 0)
        return out


class Lexicon:
    """Known words, numbered from 1, and known pairs of them, as sorted arrays."""

    def __init__(self, ones: list[str], twos: list[tuple[str, str]]):
        self.ones = ones
        known = {w: i + 1 for i, w in enumerate(ones)}
        self.numbers = _Numbers(known)
        self.base = len(ones) + 1
        keys = np.asarray([known[a] * self.base + known[b] for a, b in twos], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word numbers, positions in ``keys`` of the pair that each word ends, or -1; ends of the texts)."""
        numbers = self.numbers
        flat: list[int] = []
        ends = [0]
        for t in texts:
            if t:
                flat += [numbers[w] for w in words(t)]
            ends.append(len(flat))
        a, at = np.asarray(flat, np.int64), np.asarray(ends)
        pair = np.full(len(a), -1)
        if len(a) > 1 and len(self.keys):
            left = a[:-1].copy()
            left[at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(a))] - 1] = 0  # no pair across texts
            both = np.flatnonzero((left > 0) & (a[1:] > 0))
            key = left[both] * self.base + a[both + 1]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            pair[both[hit] + 1] = k[hit]
        return a, pair, at


@dataclass
class Model:
    """Scores of words and of pairs of words, the parameters of the calibration, and the threshold."""

    one: dict[str, float] = field(default_factory=dict)
    two: dict[tuple[str, str], float] = field(default_factory=dict)
    rest: float = -DRIFT
    rate: float = 1.0
    scale: float = 1.0
    least: float = 3.0
    folds: list[float] = field(default_factory=list)

    def prepare(self) -> None:
        """Arrays for :meth:`score`; made where the model is used."""
        twos = [p for p in self.two if p[0] in self.one and p[1] in self.one]
        self.lexicon = Lexicon(list(self.one), twos)
        self.w1 = np.r_[self.rest, [self.one[w] for w in self.lexicon.ones]]
        self.w2 = np.r_[np.asarray([self.two[p] for p in twos], float)[self.lexicon.order], 0.0]

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(score of every token of all texts, ends of the texts)."""
        a, pair, ends = self.lexicon.read(texts)
        return self.w1[a] + self.w2[pair], ends

    def surprise(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        return surprises(best, n, self.rate, self.scale)


def surprises(best: np.ndarray, n: np.ndarray, rate: float, scale: float) -> np.ndarray:
    """-log10 of the chance that an ordinary text of ``n`` tokens has a segment as good as ``best``."""
    expected = scale * n * np.exp(-rate * best)
    return np.where((best > 0) & (n > 0), -np.log10(np.maximum(-np.expm1(-expected), 1e-300)), 0.0)


def _shrunk(d: np.ndarray, error: np.ndarray) -> np.ndarray:
    """Log-odds drawn towards 0 where their standard error is large."""
    return d * np.minimum(1, np.abs(d) / error / 2.5)


def _log_odds(bad: np.ndarray, good: np.ndarray, prior: np.ndarray, tokens: float) -> np.ndarray:
    """Difference of log-odds with a Dirichlet prior."""
    a, b = bad + prior, good + prior
    n_bad, n_good = bad.sum() + PRIOR, tokens - bad.sum() + PRIOR
    d = np.log(a / np.maximum(n_bad - a, 1e-9)) - np.log(b / np.maximum(n_good - b, 1e-9))
    return _shrunk(d, np.sqrt(1 / a + 1 / b))


def _judged_odds(bad: np.ndarray, good: np.ndarray, n_bad: float, n_good: float) -> np.ndarray:
    """Log-odds of being in an abusive passage against being in a text judged innocent."""
    a, b = bad + 0.5, good + 0.5
    return _shrunk(np.log(a / (n_bad + 1)) - np.log(b / (n_good + 1)), np.sqrt(1 / a + 1 / b))


class Judged:
    """The judged texts as numbers: words and pairs of the abusive ones are known, all others are word 0."""

    def __init__(self, texts: list[list[str]], abusive: np.ndarray, ones_seen: dict[str, int], twos_seen: dict[tuple[str, str], int], tokens: int):
        self.abusive, self.n = np.asarray(abusive) == 1, np.asarray([len(t) for t in texts], np.int64)
        one: dict[str, int] = {}
        two: dict[tuple[str, str], int] = {}
        folds = [[_folded[w] for w in t] for t in texts]
        for f, y in zip(folds, self.abusive):
            if y:
                for w in f:
                    one.setdefault(w, len(one) + 1)
                for p in zip(f, f[1:]):
                    two.setdefault(p, len(two) + 1)
        a: list[int] = []
        b: list[int] = []
        for f in folds:
            a += [one.get(w, 0) for w in f]
            if f:
                b.append(0)
                b += [two.get(p, 0) for p in zip(f, f[1:])]
        self.a, self.b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        self.ends = np.r_[0, np.cumsum(self.n)]
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        self.ones, self.twos = list(one), list(two)
        # a text that repeats itself counts once
        self.in1, self.in2 = (np.unique(self.doc * (size + 1) + ids) for ids, size in ((self.a, len(one)), (self.b, len(two))))
        all1, all2 = (np.bincount(k % (size + 1), minlength=size + 1).astype(float) for k, size in ((self.in1, len(one)), (self.in2, len(two))))
        self.all1 = np.maximum(np.r_[0.0, [ones_seen.get(w, 0) for w in self.ones]], all1)
        self.all2 = np.maximum(np.r_[0.0, [twos_seen.get(p, 0) for p in self.twos]], all2)
        self.tokens = max(tokens, all1.sum())

    def _innocent(self, keys: np.ndarray, size: int, use: np.ndarray) -> np.ndarray:
        return np.bincount(keys[(use & ~self.abusive)[keys // size]] % size, minlength=size).astype(float)

    def _passages(self, ids: np.ndarray, size: int, inside: np.ndarray) -> np.ndarray:
        """In the passages of how many texts each id occurs, without the one that suggested it.

        A word that a single judged text holds is thus no evidence: that judgement may be wrong, or the word be there by chance.
        """
        seen = np.unique(self.doc[inside] * size + ids[inside])
        return np.maximum(np.bincount(seen % size, minlength=size) - 1.0, 0.0)

    def weights(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words and pairs, fitted in turns on the documents ``use`` (mask); those of number 0 say nothing."""
        s1, s2 = len(self.ones) + 1, len(self.twos) + 1
        neg1, neg2 = self._innocent(self.in1, s1, use), self._innocent(self.in2, s2, use)
        prior1, prior2 = (PRIOR * (n + 0.5) / self.tokens for n in (self.all1, self.all2))
        bad = np.flatnonzero(use & self.abusive)
        n_bad, n_good = float(len(bad)), float((use & ~self.abusive).sum())
        own = (use & self.abusive)[self.doc]
        inside = own
        w1, w2 = np.zeros(s1), np.zeros(s2)
        for _ in range(ROUNDS):
            in1, in2 = self._passages(self.a, s1, inside), self._passages(self.b, s2, inside)
            # a word must be rare in the corpus and rare in texts judged innocent
            w1 = np.clip(np.minimum(_log_odds(in1, self.all1 - in1, prior1, self.tokens), _judged_odds(in1, neg1, n_bad, n_good)), LOWEST, HIGHEST)
            w2 = np.clip(np.minimum(_log_odds(in2, self.all2 - in2, prior2, self.tokens), _judged_odds(in2, neg2, n_bad, n_good)), LOWEST, HIGHEST) / 2
            w1[0] = w2[0] = 0.0
            score = self.score(w1, w2)
            inside = np.zeros(len(self.a), bool)
            for k in bad[best_segments(score, self.ends)[bad] > PASSAGE]:
                for s, i, j in maximal_segments(score[self.ends[k] : self.ends[k + 1]]):
                    if s > PASSAGE:
                        inside[self.ends[k] + i : self.ends[k] + j] = True
            if not inside.any():
                break
        return w1, w2

    def score(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        return w1[self.a] - DRIFT + w2[self.b]

    def calibrated(self, score: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, float, float]:
        """(best segment of every text, rate, scale) of the extreme-value law of the innocent texts of ``use``.

        The rate is the positive root of E[exp(rate * score)] = 1 over their tokens, the scale follows from their mean.
        """
        best = best_segments(score, self.ends)
        ordinary = use & ~self.abusive
        value, times = np.unique(np.round(score[ordinary[self.doc]], 3), return_counts=True)
        lo, hi = 1e-3, 5.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (np.exp(np.minimum(mid * value, 50)) * times).sum() < times.sum() else (lo, mid)
        calm = ordinary & (best <= np.quantile(best[ordinary], 0.97))  # a few judgements are wrong
        return best, lo, float(calm.sum() / max(1e-9, (self.n[calm] * np.exp(-lo * best[calm])).sum()))


def cut_of(surprise: np.ndarray, abusive: np.ndarray) -> float:
    """The middle of all cuts whose F1 is within one standard error of the best."""
    order = np.argsort(-surprise, kind="stable")
    value, hits, n = surprise[order], np.cumsum(abusive[order]), int(abusive.sum())
    last = np.r_[np.diff(value) < 0, True]  # a cut does not part equal values
    value, f1 = value[last], (2 * hits / (np.arange(1, len(order) + 1) + n))[last]
    good = np.flatnonzero(f1 >= f1.max() - np.sqrt(f1.max() * (1 - f1.max()) / n))
    below = value[good[-1] + 1] if good[-1] + 1 < len(value) else 0.0
    return float((value[good[0]] + below) / 2)


def fit(texts: list[list[str]], abusive: np.ndarray, ones_seen: dict[str, int], twos_seen: dict[tuple[str, str], int], tokens: int) -> Model:
    """A model from judged texts (as words), and in how many texts of the whole corpus words and pairs of words occur.

    Ordinary text is the corpus; what the judged texts say in passing weighs as little as it is common there. The
    threshold is read off texts that the fit has not seen: each of FOLDS parts is scored by a model of the others.
    Texts judged innocent that such a model finds beyond doubt abusive are taken for wrong judgements and left out of the last fit.
    """
    abusive = np.asarray(abusive)
    if not sum(map(len, texts)) or not (abusive == 1).any() or (abusive == 1).all():
        return Model(least=np.inf)
    j = Judged(texts, abusive, ones_seen, twos_seen, tokens)
    # folds of like shares of abusive texts
    part = np.empty(len(texts), np.int64)
    for y in (False, True):
        own = np.flatnonzero(j.abusive == y)
        part[own] = np.arange(len(own)) % FOLDS
    models = []
    for f in range(FOLDS):
        use = part != f
        if (use & j.abusive).any() and (use & ~j.abusive).any():
            models.append((f, j.score(*j.weights(use))))

    def held_out(right: np.ndarray) -> np.ndarray:
        out = np.zeros(len(texts))
        for f, score in models:
            best, rate, scale = j.calibrated(score, (part != f) & right)
            out[part == f] = surprises(best, j.n, rate, scale)[part == f]
        return out

    use = j.abusive | (held_out(np.ones(len(texts), bool)) < WRONG)
    unseen = held_out(use)
    cuts = [cut_of(unseen[k], j.abusive[k]) for k in (use & (part == f) for f in range(FOLDS)) if j.abusive[k].any()]
    w1, w2 = j.weights(use)
    model = Model({w: float(s) - DRIFT for w, s in zip(j.ones, w1[1:])}, {p: float(s) for p, s in zip(j.twos, w2[1:]) if s})
    score = j.score(w1, w2)
    if not (score > 0).any():
        return Model(least=np.inf)
    _, model.rate, model.scale = j.calibrated(score, use)
    # judged samples hold more abuse than the corpus, so the best cut there may be too low for it
    model.least = max(cut_of(unseen[use], j.abusive[use]), SIGNIFICANT)
    model.folds = cuts
    return model


# ---------------------------------------------------------------- the operator


def judged_sample(df: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[list[list[str]], np.ndarray]:
    """Words and judgement of at most JUDGED_MOST judged documents. A document judged both ways is left out."""
    clear = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi")).where("_lo = _hi")
    clear = clear.orderBy(F.xxhash64(key), key).limit(JUDGED_MOST)
    rows = df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_text")).join(F.broadcast(clear), key).select(key, "_text", "_lo").collect()
    rows.sort(key=lambda r: str(r[0]))
    return [words(r[1]) for r in rows], np.asarray([int(r[2]) for r in rows], np.int64)


def corpus_counts(df: DataFrame, text: str, ones: list[str], twos: list[tuple[str, str]]) -> tuple[dict[str, int], dict[tuple[str, str], int], int]:
    """In how many of all texts each wanted word and pair occurs, and the sum over all words; every task sends one row for each that it saw."""
    held = df.sparkSession.sparkContext.broadcast((ones, twos))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*held.value)
        n1, n2 = np.zeros(lexicon.base, np.int64), np.zeros(len(lexicon.keys) + 1, np.int64)
        for b in batches:
            a, pair, ends = lexicon.read(b.column(0).to_pylist())
            doc = np.repeat(np.arange(b.num_rows), np.diff(ends))
            n1 += np.bincount(np.unique(doc * lexicon.base + a) % lexicon.base, minlength=lexicon.base)
            n2 += np.bincount(np.unique(doc * len(n2) + pair + 1) % len(n2), minlength=len(n2))
        by_pair = np.zeros(len(n2) - 1, np.int64)
        by_pair[lexicon.order] = n2[1:]
        n = np.concatenate([n1, by_pair])
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[k])], ["k", "n"])

    rows = df.select(F.col(text).alias("t")).mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(len(ones) + 1 + len(twos), np.int64)
    n[rows["k"]] = rows["n"]
    return dict(zip(ones, n[1:].tolist())), dict(zip(twos, n[len(ones) + 1 :].tolist())), int(n[: len(ones) + 1].sum())


def fit_model(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "abusive") -> Model:
    """A model for the documents, from their judged sample and the word counts of all of them."""
    ship(df.sparkSession)
    texts, abusive = judged_sample(df, labels, key, text, label)
    # counted are the words of the abusive documents, of which JUDGED_MOST bounds the number
    ones: set[str] = set()
    twos: set[tuple[str, str]] = set()
    for t, y in zip(texts, abusive):
        if y:
            f = [_folded[w] for w in t]
            ones.update(f)
            twos.update(zip(f, f[1:]))
    return fit(texts, abusive, *corpus_counts(df, text, sorted(ones), sorted(twos)))


def rates(df: DataFrame, labels: DataFrame, by: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(by, documents, flagged, rate): the share of flagged documents of every source, of a null source too."""
    model = fit_model(df, labels, key, text)
    scored = score_documents(df, model, key, text, keep=[by])
    n = F.count("*").alias("documents")
    return scored.groupBy(by).agg(n, F.sum(F.col("flagged").cast("bigint")).alias("flagged")).withColumn("rate", F.col("flagged") / F.col("documents"))


def score_documents(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(key, *keep, score, best, passages, flagged), one row per input row, no shuffle.

    score is -log10 of the chance that ordinary text of that length has a passage as bad as the worst here,
    passages counts the segments that are significant by themselves. Null, empty and blank texts score 0.
    """
    ship(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        m.prepare()
        for b in batches:
            score, at = m.score(b.column(1).to_pylist())
            best = best_segments(score, at)
            n = np.diff(at)
            surprise = m.surprise(best, n)
            found = np.zeros(len(n), np.int32)
            for k in np.flatnonzero(surprise >= m.least):
                sums = np.asarray([s for s, _, _ in maximal_segments(score[at[k] : at[k + 1]])])
                found[k] = (m.surprise(sums, n[k]) >= m.least).sum()
            new = [pa.array(surprise), pa.array(best), pa.array(found), pa.array(surprise >= m.least)]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], *new], ["key", *kept, "score", "best", "passages", "flagged"])

    names = [c for c in keep or [] if c != key]
    kept = [f"k{i}" for i in range(len(names))]
    kinds = ", ".join(f"{k} {df.schema[c].dataType.simpleString()}" for k, c in zip(["key", *kept], [key, *names]))
    picked = df.select(F.col(key).alias("key"), F.col(text).alias("text"), *[F.col(c).alias(k) for k, c in zip(kept, names)])
    out = picked.mapInArrow(run, kinds + ", score double, best double, passages int, flagged boolean")
    return out.toDF(key, *names, "score", "best", "passages", "flagged")
