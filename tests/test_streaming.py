"""Sinks and streams survive replays and restarts, and drop late rows."""

import datetime as dt

from pyspark.sql import functions as F

from vocspark.streaming import feed

DAY = dt.datetime(2001, 5, 1)


def events(spark, rows):
    return spark.createDataFrame([(i, c, DAY + dt.timedelta(days=d), float(s), "t") for i, c, d, s in rows], feed.EVENT_SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_epochs_can_be_replayed(spark, tmp_path):
    out = str(tmp_path / "u")
    write = feed.upsert_sink(out, ["k"], merge_every=3)
    batches = [spark.createDataFrame([(e % 2, e), (9, 0)], "k int, v int") for e in range(9)]
    for e, b in enumerate(batches):
        write(b, e)
        write(b, e)  # again, as after a failure
        want = {9: 0} | {x % 2: x for x in range(e + 1)}
        assert dict(rows(feed.read_upserts(spark, out, ["k"]))) == want
    assert len(list((tmp_path / "u").iterdir())) < 12  # merged epochs are dropped


def test_topn_epochs_can_be_replayed(spark, tmp_path):
    out = str(tmp_path / "t")
    write = feed.topn_sink(out, 3, [F.col("v").desc()])
    for e in range(4):
        for _ in range(2):
            write(spark.createDataFrame([(e,), (e + 10,)], "v int"), e)
        assert rows(spark.read.parquet(feed.latest(spark, out)))[-1] == (e + 10,)
    assert rows(spark.read.parquet(feed.latest(spark, out))) == [(11,), (12,), (13,)]
    assert len(list((tmp_path / "t").glob("v*"))) == 2


def test_stream_resumes_and_drops_late_rows(spark, tmp_path):
    landing = str(tmp_path / "landing")
    events(spark, [("a", "x", 0, 1.5), ("b", "x", 0, 1.0), ("a", "x", 0, 1.5)]).coalesce(1).write.mode("append").parquet(landing)
    first = rows(feed.stream_table(spark, landing, "daily").select("category", "reviews"))
    assert first == [("x", 2)]  # the repeated id counts once
    events(spark, [("c", "x", 40, 1.0)]).coalesce(1).write.mode("append").parquet(landing)
    assert rows(feed.stream_table(spark, landing, "daily").select("reviews")) == [(1,), (2,)]
    events(spark, [("d", "x", 1, 1.0), ("e", "y", 41, 1.0)]).coalesce(1).write.mode("append").parquet(landing)
    got = rows(feed.stream_table(spark, landing, "daily").select("category", "reviews"))
    assert got == [("x", 1), ("x", 2), ("y", 1)]  # d is two months late
