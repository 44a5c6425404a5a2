"""Ingest in several landings, with a replay and a re-delivery, equals one batch run, table by table."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocspark.operators.vectors import centroids
from vocspark.plans.scoring import score_reviews, tables_of_scored
from vocspark.sources import tables as S
from vocspark.streaming.ingest import Ingest, review_stream

SCHEMA = "reviewId string, content string, lang string, sentiment string, at timestamp, user_tier string, clv double, embedding array<double>"


def reviews(n, seed):
    rng = random.Random(seed)
    words = "the app will not open after update please fix login button crash slow screen refund price".split()
    out = []
    for i in range(n):
        base = [1.0, 0.1, 0.0] if i % 3 else [0.0, 1.0, 0.2]
        out.append((f"r{i}", " ".join(rng.choice(words) for _ in range(14)), "en", "negative" if i % 4 else "positive",
                    dt.datetime(2001, 1 + i % 4, 1 + i % 27), "pro", 100.0, [v + rng.random() / 5 for v in base]))
    return out


@pytest.fixture(scope="module")
def parts(spark):
    cents = centroids(spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0])], "category string, embedding array<double>"),
                      "category", "embedding")
    return (lambda r: score_reviews(r, cents)), (lambda s: tables_of_scored(s, cents, emerging=False))


def digest(df):
    def plain(v):
        return round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    return sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())


def test_landings_and_replay_equal_one_batch(spark, parts, tmp_path):
    score, build = parts
    first, second = reviews(120, 1)[:70], reviews(120, 1)[60:]  # ten are delivered twice
    late = [(i, t.replace("not", "never"), *rest) for i, t, *rest in reviews(120, 1)[:5]]  # five change their text
    gone = [(i, t, la, "positive", *rest) for i, t, la, _, *rest in reviews(120, 1)[5:9]]  # four are no complaints any more
    landing = str(tmp_path / "landing")
    ingest = Ingest(str(tmp_path / "out"), score, build)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(ValueError):
        ingest.table(spark, "topic_timeseries")
    for rows in (first, second, late + gone):
        frame(rows).coalesce(1).write.mode("append").parquet(landing)
        ingest.run(review_stream(spark, landing, frame(rows).schema))
    ingest.write(frame(late + gone), 2)  # the last epoch again, as after a failure
    whole = {r[0]: r for r in first + second}
    whole |= {r[0]: r for r in late + gone}
    scored = score(frame(list(whole.values())))
    assert digest(ingest.reviews(spark)) == digest(frame(list(whole.values())))
    assert digest(ingest.table(spark, "scored")) == digest(scored)
    want = build(scored)
    assert len(want) == 7
    for name, table in want.items():
        assert digest(ingest.table(spark, name)) == digest(table), name
    assert len(list((tmp_path / "out").glob("version-*"))) == 2
    log = S.read_sync_log(spark, str(tmp_path / "out" / "log"))
    assert sorted(r.run for r in log.collect()) == ["000000000", "000000001", "000000002"]


def test_rows_without_key_and_empty_landings(spark, parts, tmp_path):
    score, build = parts
    ingest = Ingest(str(tmp_path / "out"), score, build)
    rows = reviews(30, 2)
    odd = [(None, *rows[0][1:]), ("x", None, None, None, None, None, None, None)]
    ingest.write(spark.createDataFrame(rows + odd + rows[:3], SCHEMA), 0)
    assert digest(ingest.table(spark, "scored")) == digest(score(spark.createDataFrame(rows, SCHEMA)))
    ingest.write(spark.createDataFrame([], SCHEMA), 1)
    assert digest(ingest.table(spark, "scored")) == digest(score(spark.createDataFrame(rows, SCHEMA)))


def test_sync_log(spark, tmp_path):
    base = str(tmp_path / "log")
    assert S.read_sync_log(spark, base).count() == 0
    assert S.needs_sync(S.read_sync_log(spark, base), "2001-08-01").first().due
    S.append_sync(spark, base, "1", "2001-08-01 10:00:00", dataset="a")
    S.append_sync(spark, base, "2", "2001-08-02 09:00:00", "error: gone", "a")
    S.append_sync(spark, base, "2", "2001-08-02 09:00:00", "error: gone", "a")  # the write is repeated
    S.append_sync(spark, base, "3", "2001-07-30 10:00:00", dataset="b")
    log = S.read_sync_log(spark, base)
    assert log.count() == 3
    assert {r.dataset: (r.run, r.status) for r in S.last_sync(log).collect()} == {"a": ("2", "error: gone"), "b": ("3", "success")}
    assert not S.needs_sync(S.read_sync_log(spark, base, "a"), "2001-08-02").first().due
    assert S.needs_sync(S.read_sync_log(spark, base, "b"), "2001-08-02").first().due


def test_soft_clusters_count_memberships(spark):
    from vocspark.operators import ml
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        v = np.zeros(6)
        v[i % 3] = 1.0
        if i % 10 == 0:
            v[(i + 1) % 3] = 1.0  # in two clusters
        rows.append((f"text {i} signal{i % 3} word", f"2001-0{1 + i % 2}", [float(x) for x in v + rng.random(6) / 50], 1.0 if i % 2 else 0.0))
    pool = spark.createDataFrame(rows, "text string, month string, embedding array<double>, act double")
    soft = ml.soft_clusters(pool, "embedding", ("text",), k=3).collect()
    counts = [sum(r.memberships[j] > 0.1 for r in soft) for j in range(3)]
    assert sum(counts) > 120 and max(sum(w > 0.1 for w in r.memberships) for r in soft) >= 2
    out = {r.cluster_id: r for r in ml.emerging_clusters(pool, "embedding", "text", "month", k=3).collect()}
    assert {j: r.estimated_volume for j, r in out.items()} == {j: c for j, c in enumerate(counts) if c >= 20}
    assert all(r.label == f"Cluster #{j + 1}" and "signal" in r.keywords for j, r in out.items())
    named = ml.emerging_clusters(pool, "embedding", "text", "month", lambda df: df.withColumn("label", F.lit("L")), k=3, actionable="act")
    assert {r.label for r in named.collect()} == {"L"} and all(r.estimated_volume <= 120 for r in named.collect())
    assert ml.emerging_clusters(pool.limit(5), "embedding", "text", "month").count() == 0  # fewer than two clusters
    assert ml.emerging_clusters(pool.limit(0), "embedding", "text", "month").count() == 0
