from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import text as fx


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()[0]


def test_tokens_agree_with_the_driver_side_form(spark):
    texts = ["Hello, World_1 a.b!", "Ünïcode Straße 日本 語", "", "  ", "x y zz\u3000aa", "tab\tnl\ncr\rvt\x0bfs\x1c end", "a" * 5000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fx.tokens(F.col("t")).alias("x")).collect()
    assert {r.i: r.x for r in rows} == {i: fx.tokenize(t) for i, t in enumerate(texts)}
    assert one(spark, fx.tokens(F.col("t")), t=None) is None


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=60))
def test_tokenize_keeps_words_of_two_or_more(text):
    assert all(len(x) > 1 for x in fx.tokenize(text))


def test_paths(spark):
    cases = {"a/b.py": ("python", "code", "source"), "x.YML": ("yaml", "configuration", "config"), "README": (None, "unknown", "other"), "q.sql": ("sql", "unknown", "database"), "v.vue": ("vue", "markup", "other"), "n.txt": (None, "documentation", "documentation"), "d/.py": (None, "unknown", "other")}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    p = F.col("p")
    got = {r.p: (r.a, r.b, r.c) for r in df.select("p", fx.language(p).alias("a"), fx.file_type(p).alias("b"), fx.graph_file_type(p).alias("c")).collect()}
    assert got == cases


def test_snippet_and_line_of(spark):
    assert one(spark, fx.snippet(F.col("t"), 3), t="abcd") == "abc..."
    assert one(spark, fx.snippet(F.col("t"), 4), t="abcd") == "abcd"
    assert one(spark, fx.line_of(F.col("t"), F.col("u")), t="a\nb\nc", u="c") == 3
    assert one(spark, fx.line_of(F.col("t"), F.col("u")), t="a\nb", u="zz") == 1


def test_metrics(spark):
    code = "def f(x):\n    if x:\n        for y in x:\n            pass\n"
    # if and for once each; deepest indent 12 // 4 = 3; 5 / (len / 1000) is above 1
    assert one(spark, fx.complexity(F.col("t")), t=code) == 1.0
    assert one(spark, fx.complexity(F.col("t")), t="") == 0.0
    assert abs(one(spark, fx.complexity(F.col("t")), t="elif" + "x" * 9996) - 0.2) < 1e-9  # 'elif' holds 'if'
    assert one(spark, fx.documentation(F.col("t")), t="# a\nb\n\n// c\nd") == 0.5
    assert one(spark, fx.documentation(F.col("t")), t="\n\n") == 0.0


def test_query_type(spark):
    for q, want in (("how to explain", "semantic"), ("class Foo", "keyword"), ("foo", "mixed"), ("explain algorithm of a class", "mixed")):
        assert one(spark, fx.query_type(F.col("t")), t=q) == want
