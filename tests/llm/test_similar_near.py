from __future__ import annotations

import datetime as dt
from itertools import combinations

import numpy as np
import pytest

from corpusmill.llm import near_duplicates as nd
from corpusmill.llm import similar_vectors as sv

T = dt.datetime(2024, 1, 1)
SCHEMA = "id string, embedding array<float>, indexed_at timestamp_ntz, key int, vec string, version int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, t, 1, "x", 2) for i, v, t in rows], SCHEMA)


def brute(names, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = {}
    for i, n in enumerate(names):
        order = sorted((-round(float(s[i, j]), 6), names[j]) for j in range(len(names)) if j != i)
        out[n] = [m for _, m in order[:k]]
    return out


def test_recall_over_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(sv, "LEAF_ROWS", 100)
    monkeypatch.setattr(sv, "MEMBERS_AT_ONCE", 60)  # forces blocks
    monkeypatch.setattr(sv, "VISITORS_AT_ONCE", 90)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(150, 16))
    x = (centres[rng.integers(0, 150, 1500)] + 0.2 * rng.normal(size=(1500, 16))).astype(np.float16).astype(np.float32)
    names = [f"{i:032x}" for i in range(1500)]
    got = {r.id: r.near for r in sv.nearest(frame(spark, [(n, v.tolist(), T) for n, v in zip(names, x)]), dims=16).collect()}
    want = brute(names, x.astype(float), 5)
    hit = np.mean([len(set(got[n]) & set(want[n])) / 5 for n in names])
    assert hit >= 0.95 and all(len(v) == 5 and len(set(v)) == 5 and n not in v for n, v in got.items())


def test_queue_and_block_traversals_agree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 8))
    tree = sv.Tree(x.astype(np.float32), 30)
    for widen in (0.0, 0.1, 0.4):
        rows, leaves = tree.visit(x[:60], widen)
        for i in range(60):
            own = leaves[rows == i].tolist()
            assert set(own) == set(tree.visit_one(x[i], widen)) and own[0] == tree.home(x[i : i + 1])[0]


def test_trees_below_large_leaves(spark, monkeypatch):
    monkeypatch.setattr(sv, "LEAVES_MOST", 3)
    monkeypatch.setattr(sv, "LEAF_ROWS", 60)
    monkeypatch.setattr(sv, "LOCAL_ROWS", 200)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(120, 16))
    x = (centres[rng.integers(0, 120, 2400)] + 0.2 * rng.normal(size=(2400, 16))).astype(np.float16).astype(np.float32)
    names = [f"{i:032x}" for i in range(2400)]
    got = {r.id: r.near for r in sv.nearest(frame(spark, [(n, v.tolist(), T) for n, v in zip(names, x)]), dims=16).collect()}
    want = brute(names, x.astype(float), 5)
    assert np.mean([len(set(got[n]) & set(want[n])) / 5 for n in names]) >= 0.95 and all(len(v) == 5 and n not in v for n, v in got.items())


def test_rows_compared_do_not_grow_with_the_collection(monkeypatch):
    monkeypatch.setattr(sv, "LEAF_ROWS", 50)

    def compared(n):
        rng = np.random.default_rng(4)
        x = (rng.uniform(-1, 1, size=(n, 4)) @ rng.normal(size=(4, 16))).astype(np.float32)  # of one shape, only denser
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        forest = sv.Forest([x[rng.choice(n, min(n, n // 50 * 64), replace=False)]], n // 50)
        some = rng.choice(n, 200, replace=False)
        near, _ = sv.top_k(x[some], x, 5, some)
        widen = float(np.quantile(forest.widening(np.repeat(x[some], 5, 0), x[near.ravel()]), 0.985))
        size = np.bincount(forest.homes(x), minlength=forest.size)
        row, leaf, _ = forest.visit(x[some], widen)
        return size[leaf].sum() / len(some)

    assert compared(20_000) < 2.5 * compared(2_000)


def test_unusable_ties_copies_versions(spark):
    one = [1.0, 0.0, 0.0, 0.0]
    rows = [(f"c{i:02}", one, T) for i in range(20)] + [("z1", [0.0, 1.0, 0.0, 0.0], T), ("z2", [0.0, 2.0, 1e-3, 0.0], T)]
    bad = [("n1", None, T), ("n2", [0.0] * 4, T), ("n3", [1.0] * 3, T), ("n4", [float("nan"), 1.0, 1.0, 1.0], T), ("n5", [float("inf"), 1.0, 1.0, 1.0], T), ("n6", [None, 1.0, 1.0, 1.0], T), (None, one, T)]
    old = [("z1", one, dt.datetime(2023, 1, 1)), ("z1", [0.0, 1.0, 0.0, 0.0], T)]
    got = {r.id: r.near for r in sv.nearest(frame(spark, rows + bad + old), dims=4).collect()}
    assert set(got) == {r[0] for r in rows}
    assert got["c00"] == [f"c{i:02}" for i in range(1, 6)] and got["c03"] == ["c00", "c01", "c02", "c04", "c05"] and got["c19"] == [f"c{i:02}" for i in range(5)]
    assert got["z1"][0] == "z2" and got["z1"][1:] == ["c00", "c01", "c02", "c03"]
    pairs = {(r.id_a, r.id_b) for r in sv.neighbour_pairs(sv.nearest(frame(spark, rows), dims=4)).collect()}
    assert ("z1", "z2") in pairs and all(a < b for a, b in pairs)
    assert sv.nearest(frame(spark, []), dims=4).count() == 0
    assert [r.near for r in sv.nearest(frame(spark, rows[:1]), dims=4).collect()] in ([], [[]])


def test_parallel_vectors_tie_by_key(spark):
    v = np.random.default_rng(5).normal(size=4)
    rows = [(f"p{i:02}", [float(x) for x in v * (1 + 0.37 * ((i * 17) % 60))], T) for i in range(60)]
    got = {r.id: r.near for r in sv.nearest(frame(spark, rows), dims=4).collect()}
    assert all(got[i] == [j for j, _, _ in rows if j != i][:5] for i, _, _ in rows)


def jaccard(a, b, weighted=False):
    from collections import Counter

    a, b = Counter(a), Counter(b)
    if not weighted:
        a, b = Counter(set(a)), Counter(set(b))
    return sum((a & b).values()) / sum((a | b).values())


def shingles(text):
    t = nd.TOKEN.findall(text)
    return [tuple(t[i : i + 4]) for i in range(len(t) - 3)]


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_are_unbiased(weighted):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words[: 4 + 8 * i], 120)) for i in range(1, 7)]
    texts += [t + " " + t[:200] for t in texts]
    rec, f, c = nd.features(texts, 1)
    sig = nd.signatures(rec, f, c if weighted else np.ones_like(c), len(texts), 1024)
    for i, j in combinations(range(len(texts)), 2):
        want = jaccard(nd.TOKEN.findall(texts[i]), nd.TOKEN.findall(texts[j]), weighted)
        assert abs((sig[i] == sig[j]).mean() - want) < 0.07
    assert not np.isfinite(nd.signatures(*nd.features(["", None, "a"], 4), 3, 8).view(float)).any()


def corpus():
    rng = np.random.default_rng(3)
    words = [f"t{i}" for i in range(400)]
    out = {}
    for g in range(30):
        base = rng.choice(words, 80).tolist()
        for v in range(4):
            own = list(base)
            for _ in range(3 * v):
                own[int(rng.integers(80))] = "e%d" % rng.integers(1000)
            out[f"g{g}v{v}"] = " ".join(own)
        out[f"g{g}copy"] = out[f"g{g}v0"]
    return out | {"short": "a b", "short2": "a b", "empty": "", "long": " ".join(rng.choice(words, 30_000))}


def test_pairs_and_groups_against_brute_force(spark):
    texts = corpus()
    rows = [(i, t, T, 1, "x", 2, 3) for i, t in texts.items()] + [("g0v0", "an older and different text here", dt.datetime(2023, 1, 1), 1, "x", 2, 3), ("null", None, T, 1, "x", 2, 3), (None, "a b c d e", T, 1, "x", 2, 3), ("g1v0", texts["g1v0"], T, 1, "x", 2, 3)]
    df = spark.createDataFrame(rows, "id string, content string, indexed_at timestamp_ntz, key int, name string, version int, rep int")
    s = {i: set(shingles(t)) for i, t in texts.items()}
    want = {tuple(sorted((a, b))) for a, b in combinations([i for i in s if s[i]], 2) if len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.7}
    found = nd.NearDuplicates(df)
    got = [(r.id_a, r.id_b) for r in found.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    parent = {i: i for i in s if s[i]}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in sorted(want):
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    groups = {r.id: r.group_id for r in found.groups().collect()}
    assert groups == {i: top(i) for i in parent}
    copies = {r.id: r.copies for r in found.groups().collect()}
    assert copies["g3copy"] == 2 and copies["g3v1"] == 1
    none = nd.NearDuplicates(df.limit(0))
    assert none.pairs().count() == 0 and none.groups().count() == 0


def test_hot_bands_are_answered_exactly(spark, monkeypatch):
    rng = np.random.default_rng(6)
    licence = [f"licence{i}" for i in range(60)]
    words = [f"t{i}" for i in range(3000)]
    texts = {f"r{i:03}": licence + rng.choice(words, 55).tolist() for i in range(150)}
    texts |= {f"{k}v": [w if j != 70 else "edited" for j, w in enumerate(t)] for k, t in list(texts.items())[:30]}
    other = {f"o{i:03}": rng.choice(words, 80).tolist() for i in range(40)}
    rows = [(i, " ".join(t), T) for i, t in (texts | other).items()]
    monkeypatch.setattr(nd, "HOT_BAND", 5)
    s = {i: set(shingles(t)) for i, t, _ in rows}
    want = {tuple(sorted(p)) for p in combinations(s, 2) if len(s[p[0]] & s[p[1]]) / len(s[p[0]] | s[p[1]]) >= 0.7}
    found = nd.NearDuplicates(spark.createDataFrame(rows, "id string, content string, indexed_at timestamp_ntz"))
    assert len(want) >= 30 and {(r.id_a, r.id_b) for r in found.pairs().collect()} == want
    lists = spark.createDataFrame([(i.encode(), [hash(x) for x in f]) for i, f in s.items()], "key binary, f array<bigint>")
    proposed = nd.prefix_pairs(lists, 0.7).count()
    assert len(want) <= proposed < 0.05 * len(texts) ** 2  # what all have in common proposes nothing


def test_pairs_of_a_large_class(spark, monkeypatch):
    monkeypatch.setattr(nd, "CLASS_AT_ONCE", 7)
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(f"{i:03}", text, T) for i in range(40)] + [(f"x{i}", text + f" more {i}", T) for i in range(3)]
    found = nd.NearDuplicates(spark.createDataFrame(rows, "id string, content string, indexed_at timestamp_ntz"))
    got = [(r.id_a, r.id_b) for r in found.pairs().collect()]
    assert len(got) == len(set(got)) == 43 * 42 // 2


def test_links_of_records_without_a_version(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [("a", text, None), ("b", text + " more", None), ("c", text + " other", T), ("c", "an outdated row of no version", None), ("d", text, None)]
    found = nd.NearDuplicates(spark.createDataFrame(rows, "id string, content string, indexed_at timestamp_ntz"))
    assert {(r.id_a, r.id_b) for r in found.pairs().collect()} == set(combinations("abcd", 2))
    assert {r.group_id for r in found.groups().collect()} == {"a"}
    assert nd.BANDS == 22


def test_weighted_groups(spark):
    rows = [("a", "x y z w " * 10, T), ("b", "x y z w " * 4, T), ("c", "x y z w " * 9, T)]
    df = spark.createDataFrame(rows, "id string, content string, indexed_at timestamp_ntz")
    want = {(a[0], b[0]) for a, b in combinations(rows, 2) if jaccard(shingles(a[1]), shingles(b[1]), True) >= 0.7}
    assert {(r.id_a, r.id_b) for r in nd.NearDuplicates(df, weighted=True).pairs().collect()} == want == {("a", "c")}
    assert nd.NearDuplicates(df).pairs().count() == 3


def test_components_of_a_long_path_and_a_star(spark):
    path = [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)]
    star = [("s", f"x{i}") for i in range(200)]
    links = spark.createDataFrame(path + star, "a string, b string")
    got = {r.rep: r.label for r in nd.components(links).collect()}
    assert all(got[f"p{i:03}"] == "p000" for i in range(61)) and all(got[f"x{i}"] == "s" for i in range(200))
    assert nd.components(links.limit(0)).count() == 0
