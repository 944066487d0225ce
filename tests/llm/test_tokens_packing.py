from __future__ import annotations

import os

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import byte_bpe, packing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(byte_bpe.DEFAULT_VOCABULARY), reason="no vocabulary files")
MULTI = byte_bpe.DEFAULT_VOCABULARY.replace("byte_bpe_50k", "byte_bpe_multi_50k")


def other(path):
    words = byte_bpe.read_ranks(path)
    return tiktoken.Encoding("t", pat_str=byte_bpe.PATTERN, mergeable_ranks={w: i for i, w in enumerate(words)}, special_tokens={})


CASES = ["", " ", "a", "Hello  world\n\n\tx", "it's I'LL 've", "a\x1cb \x1d", "\n\n\x1e1a\x1d", "日本語" * 50, "\u0301é ﷽ 👩‍👩‍👧", "<|endoftext|>", "x" * 3000, "ab" * 4000, "1234567890" * 30, "\r\n \r\n  y", "\x85 y  z\u2028"]


@pytest.mark.parametrize("path", [byte_bpe.DEFAULT_VOCABULARY, MULTI])
def test_encoder_agrees_and_decodes(path):
    bpe, ref = byte_bpe.load(path), other(path)
    for t in CASES:
        assert bpe.encode(t) == ref.encode_ordinary(t), t
        assert bpe.decode(bpe.encode(t)) == t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_encoder_on_any_text(text):
    bpe = byte_bpe.load()
    ids = bpe.encode(text)
    assert ids == other(byte_bpe.DEFAULT_VOCABULARY).encode_ordinary(text) and bpe.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=127), max_size=30))
def test_ascii_splits_as_published(text):
    bpe = byte_bpe.load()
    assert bpe._plain.findall(text) == bpe._wide.findall(text)
    assert bpe.encode(text) == other(byte_bpe.DEFAULT_VOCABULARY).encode_ordinary(text)


def test_batches_and_a_full_memo():
    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(byte_bpe.DEFAULT_VOCABULARY), memo=3)
    want = [bpe.encode(t) for t in CASES]
    for _ in range(2):
        off, ids = bpe.encode_batch([*CASES, None])
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [*want, []]
        assert bpe.count_batch([*CASES, None]).tolist() == [*map(len, want), 0]


def test_operator(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(CASES)] + [(90, None, None, 1), (90, None, None, 1), (None, "hi", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, key int")
    got = tokens.encode_texts(df).collect()
    assert len(got) == len(rows) and [r.ids for r in got if r.doc_id == 90] == [[], []]
    bpe = byte_bpe.load()
    assert all(r.ids == bpe.encode(CASES[r.doc_id]) for r in got if r.doc_id is not None and r.doc_id < 90)
    back = {r.doc_id: r.text for r in tokens.decode_ids(tokens.encode_texts(df)).collect()}
    assert all(back[i] == t for i, t in enumerate(CASES))
    n = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()}
    assert n[90] == 0 and n[9] == len(bpe.encode(CASES[9]))
    assert tokens.encode_texts(df.limit(0)).count() == 0


def brute_put(bins, size, capacity, most):
    """(bin) by a plain scan; bins: list of [number, free] in the order opened."""
    fit = [b for b in bins if b[1] >= size]
    if fit:
        low = min(b[1] for b in fit)
        b = [x for x in fit if x[1] == low][-1]
    else:
        return None, bins
    return b, bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 5))
def test_best_fit_keeps_its_rules(sizes, most):
    bins, used = packing.BestFit(20, most), {}
    for s in sizes:
        before = {f: list(v) for f, v in enumerate(bins.by_free) if v}
        at = bins.put(s)
        used[at] = used.get(at, 0) + s
        assert used[at] <= 20 and bins.n_open <= most
        fitting = [f for f in before if f >= s]
        if s < 20 and fitting:  # it went into the tightest that fits
            assert at in before[min(fitting)]
    assert sum(used.values()) == sum(sizes)
    assert all(20 - f == used[b] for f, v in enumerate(bins.by_free) for b in v)


def test_packing(spark, monkeypatch):
    import random

    random.seed(1)
    sizes = [random.choice([1, 30, 300, 900, 2047, 2048, 2049, 6000]) for _ in range(3000)]
    rows = [(i, n, "x") for i, n in enumerate(sizes)] + [(5000, 0, None), (5001, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, bin_id string")
    monkeypatch.setattr(packing, "TOKENS_PER_GROUP", 200_000)
    got = packing.pack(df).collect()
    load, parts = {}, {}
    for r in got:
        parts.setdefault(r.doc_id, []).append((r.piece_no, r.start, r.n))
        if r.n:
            load[r.bin_id] = load.get(r.bin_id, 0) + r.n
        else:
            assert r.bin_id is None
    assert max(load.values()) <= 2048
    for i, n, _ in rows:
        own = sorted(parts[i])
        assert sum(p[2] for p in own) == (n or 0) and [p[1] for p in own] == [2048 * k for k in range(len(own))]
        assert len(own) == max(1, -(-(n or 0) // 2048))
    assert sum(load.values()) / (2048 * len(load)) > 0.97
    again = {(r.doc_id, r.piece_no): r.bin_id for r in packing.pack(df).collect()}
    assert again == {(r.doc_id, r.piece_no): r.bin_id for r in got}
    assert packing.pack(df.limit(0)).count() == 0
    repeated = packing.pack(df.limit(1).union(df.limit(1)).union(df.limit(1))).collect()
    assert len(repeated) == 3
