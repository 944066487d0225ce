from __future__ import annotations

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import splitting


def brute(c, limit=1000, floor=500, ov=200):
    lines = c.split("\n")
    n, out, s = len(lines), [], 0
    size = lambda a, b: sum(map(len, lines[a : b + 1])) + (b - a)
    while s < n:
        if len(lines[s]) > limit:
            a = 0
            while True:
                out.append((s, s))
                if a + limit >= len(lines[s]):
                    break
                a += limit - ov
            s += 1
            continue
        e = max(x for x in range(s, n) if size(s, x) <= limit)
        if e != n - 1:
            e = next((b for b in range(e, s - 1, -1) if not lines[b].strip() and size(s, b) >= floor), e)
        out.append((s, e))
        if e == n - 1:
            break
        s = next((t for t in range(s + 1, e + 1) if size(t, e) <= ov and size(t, e + 1) <= limit), e + 1)
    return out


line = st.one_of(st.sampled_from(["", " ", "\r", "\t"]), st.integers(0, 60).map(lambda n: "x" * n), st.sampled_from([199, 200, 201, 499, 500, 999, 1000, 1001, 1800, 1801, 2600]).map(lambda n: "é" * n))


@settings(max_examples=300, deadline=None)
@given(st.lists(line, max_size=40))
def test_cut_points_against_a_plain_form(lines):
    c = "\n".join(lines)
    got = splitting.cut_points(c)
    assert [g[:2] for g in got] == brute(c)
    assert all(t - f <= 1000 for _, _, f, t in got)
    covered = set()
    for _, _, f, t in got:
        covered.update(range(f, t))
    assert all(i in covered for i, x in enumerate(c) if x != "\n")  # nothing is lost


def test_operator(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2)]
    long = "\n".join("a" * 90 for _ in range(30))
    rows = [("a", long, 11, t[0]), ("a", "short now", 11, t[1]), ("b", long, 11, t[1]), ("b", long, 11, t[1]), ("c", None, 1, t[0]), ("d", "", 1, t[0]), ("e", "x" * 2500, None, t[0]), (None, long, 1, t[0])]
    df = spark.createDataFrame(rows, "id string, content string, start_line int, indexed_at timestamp_ntz").selectExpr("*", "1 as key", "2 as version", "3 as piece_no")
    got = {}
    for r in splitting.split_records(df).collect():
        got.setdefault(r.id, []).append((r.piece_no, r.start_line, r.end_line, r.from_char, r.to_char))
    assert set(got) == {"b", "e"}
    assert [x[:3] for x in sorted(got["b"])] == [(i, 11 + a, 11 + b) for i, (a, b) in enumerate(brute(long))]
    assert sorted(got["e"]) == [(0, 1, 1, 0, 1000), (1, 1, 1, 800, 1800), (2, 1, 1, 1600, 2500)]
    assert splitting.split_records(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab ,.\n#c\t"), max_size=400), st.integers(5, 60), st.integers(0, 20))
def test_natural_pieces_cover_all_and_keep_the_limit(text, limit, overlap):
    overlap = min(overlap, limit // 2)
    got = splitting.natural_points(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b in got)
    at = 0
    for i, (a, b) in enumerate(got):
        assert a <= at and (i == 0 or at - a <= overlap) and b > at and (i == 0 or a > got[i - 1][0])
        at = b
    assert at == len(text)


def test_natural_pieces_cut_where_the_hierarchy_says():
    cut = lambda t, n: [t[a:b] for a, b in splitting.natural_points(t, n, 0)]
    assert cut("# One\ntext a\n# Two\ntext b\n", 18) == ["# One\ntext a\n", "# Two\ntext b\n"]
    assert cut("para one\n\npara two\n\nthree", 12) == ["para one\n\n", "para two\n\n", "three"]
    assert cut("First here. Second one. Third", 14) == ["First here. ", "Second one. ", "Third"]
    assert cut("alpha beta gamma", 7) == ["alpha ", "beta ", "gamma"] and cut("abcdefgh", 3) == ["abc", "def", "gh"]
    t = "one two three four five six seven"
    got = splitting.natural_points(t, 15, 6)
    assert [t[a:b] for a, b in got] == ["one two three ", "three four ", "four five six ", "six seven"]


def test_natural_pieces_of_records(spark):
    long = "def a():\n    pass\n\n\n" * 80
    df = spark.createDataFrame([("x", long, 5, None), ("y", "short", 1, None), ("z", None, 1, None), (None, long, 1, None)], "id string, content string, start_line int, indexed_at timestamp_ntz")
    rows = sorted(splitting.natural_pieces(df).collect(), key=lambda r: r.piece_no)
    assert {r.id for r in rows} == {"x"} and rows[0].start_line == 5 and rows[-1].to_char == len(long)
    assert all(long[r.from_char :].startswith("def") and r.to_char - r.from_char <= 1000 for r in rows)
    assert splitting.natural_pieces(df.limit(0)).count() == 0
