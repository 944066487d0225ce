from __future__ import annotations

import datetime as dt
import os

from corpusmill import runtime
from corpusmill.sources.tables import latest
from corpusmill.streaming import ingest

T = [dt.datetime(2024, 1, d) for d in range(1, 6)]


def rows(spark, *r):
    return spark.createDataFrame(list(r), "k string, at timestamp_ntz, v string, key string, _row string")


def test_latest(spark):
    df = rows(spark, ("a", T[0], "old", "x", "y"), ("a", T[2], "new", None, "y"), ("a", T[2], "new", None, "y"), ("b", None, "only", "x", None), (None, T[1], "lost", "x", "y"), ("c", T[1], None, "x", "y"), ("c", None, "late", "x", "y"))
    got = {r.k: r.v for r in latest(df, "k", "at").collect()}
    assert got == {"a": "new", "b": "only", "c": None}
    assert latest(df.limit(0), "k", "at").count() == 0
    assert set(latest(df, "k", "at").columns) == set(df.columns)


def test_keep_and_cut(spark):
    df = spark.range(10)
    assert runtime.keep(df).count() == 10 and runtime.cut(df).count() == 10
    folder = runtime.kept_dir(spark).removeprefix("file:")
    assert os.listdir(folder)
    runtime.clean(spark)
    assert not os.path.exists(folder) and runtime.keep(df).count() == 10


def test_streams(spark, tmp_path):
    ev = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, i % 5, i), "ab"[i % 2], float(i)) for i in range(40)], "event_id int, ts timestamp_ntz, event_type string, value double")
    ev.repartition(3).write.parquet(str(tmp_path / "ev"))
    batch = {(r.start, r.event_type): (r.n, r.total) for r in ingest.window_counts(ev).collect()}
    stream = {(r.start, r.event_type): (r.n, r.total) for r in ingest.run_window_counts(spark, str(tmp_path / "ev")).collect()}
    assert batch == stream and sum(n for n, _ in batch.values()) == 40
    df = rows(spark, ("a", T[0], "old", "x", "y"), ("a", T[2], "new", "x", "y"), ("b", T[1], "b", "x", "y"))
    df.repartition(3).write.parquet(str(tmp_path / "ch"))
    got = {r.k: r.v for r in ingest.run_latest(spark, str(tmp_path / "ch"), "k", "at", ["v"]).collect()}
    assert got == {"a": "new", "b": "b"}
