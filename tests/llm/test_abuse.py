from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import abuse

scores = st.lists(st.sampled_from([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]), max_size=25)


def brute_best(s):
    return max([0.0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])


@settings(max_examples=100, deadline=None)
@given(st.lists(scores, max_size=8))
def test_best_segments(texts):
    ends = np.cumsum([0, *map(len, texts)])
    got = abuse.best_segments(np.asarray([x for t in texts for x in t], float), ends)
    assert np.allclose(got, [brute_best(t) for t in texts])


@settings(max_examples=100, deadline=None)
@given(scores)
def test_maximal_segments(s):
    found = abuse.maximal_segments(s)
    assert all(abs(sum(s[a:b]) - v) < 1e-9 and v > 0 for v, a, b in found)
    spans = sorted((a, b) for _, a, b in found)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    assert abs(max([0.0, *(v for v, _, _ in found)]) - brute_best(s)) < 1e-9


def test_words_see_through_disguise():
    assert abuse.words("you i d i o t !") == ["you", "idiot"]
    assert abuse.words("аsshоlе") == ["asshole"] and abuse.words("id\u200biot") == ["idiot"] and abuse.words("ＩＤＩＯＴ") == ["idiot"]
    assert abuse.folded("1d10t") == "idiot" and abuse.folded("42") == "0"
    assert abuse.words("**bold** text") == ["bold", "text"]
    assert abuse.words("你好吗") == ["你好", "好吗"]
    assert abuse.words("") == []


def corpus():
    rng = np.random.default_rng(0)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = " ".join(rng.choice(plain, int(rng.integers(5, 120))))
        bad = i % 6 == 0
        if bad:
            a = ["you are a worthless moron and everyone hates you", "shut your filthy mouth you pathetic clown", "y o u are a w0rthless m o r o n and everyone hates you"][i // 6 % 3]
            text = text[: len(text) // 2] + " " + a + " " + text[len(text) // 2 :]
        elif i % 6 == 1:
            text += " this stupid bug, damn it"
        rows.append((i, text, f"s{i % 3}" if i % 9 else None))
        if i % 2 == 0 or i % 6 == 1:
            labels.append((i, int(bad) if i % 50 else 1 - int(bad)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    extra = [(5000, None, "s0"), (5001, "", "s0"), (5002, "   ", "s1"), (None, "hi there", "s1"), (5003, "word1 " * 20_000, "s1"), (5003, "word1 " * 20_000, "s1")]
    df = spark.createDataFrame(rows + extra, "doc_id bigint, text string, source string").selectExpr("*", "1 as key", "2 as score", "3 as best")
    lab = spark.createDataFrame(labels, "doc_id bigint, abusive int")
    model = abuse.fit_model(df, lab)
    got = {r.doc_id: r for r in abuse.score_documents(df, model).collect()}
    assert len(got) == len(rows) + 5
    held = [i for i, _, _ in rows if i not in dict(labels)]
    bad = {i for i in range(900) if i % 6 == 0}
    flagged = {i for i in got if i is not None and got[i].flagged}
    assert not flagged & set(range(5000, 5004)) and got[5000].score == 0 and got[5001].passages == 0
    assert len(flagged & set(held) - bad) <= 0.02 * len(held)
    assert len(flagged & bad) >= 0.9 * len(bad) and len(flagged - bad) <= 0.05 * len(bad)
    rates = {r.source: (r.documents, r.flagged) for r in abuse.rates(df, lab).collect()}
    assert sum(n for n, _ in rates.values()) == len(rows) + len(extra) and None in rates
    assert abuse.score_documents(df.limit(0), model).count() == 0
    none = abuse.fit_model(df, lab.limit(0))
    assert not any(r.flagged for r in abuse.score_documents(df.limit(50), none).collect())


def test_maximal_segments_in_linear_time():
    import time

    def seconds(n):
        s = np.tile([1.0, -2.0], n // 2)
        t = time.perf_counter()
        assert len(abuse.maximal_segments(s)) == n // 2
        return time.perf_counter() - t

    seconds(1000)
    assert seconds(160_000) < 2  # a quadratic search took 4 s for 16,000


def test_a_word_of_one_judged_text_is_no_evidence():
    texts = [["you", "are", "a", "moron", "lonely" if i == 0 else "plain"] if i % 5 == 0 else ["plain", "words", "here"] for i in range(200)]
    bad = np.asarray([i % 5 == 0 for i in range(200)], int)
    model = abuse.fit(texts, bad, {"a": 9000, "are": 9000, "you": 9000}, {}, 60_000)
    assert model.one["moron"] > 1 and model.one["lonely"] < 0
    assert model.least >= abuse.SIGNIFICANT and len(model.folds) == abuse.FOLDS
