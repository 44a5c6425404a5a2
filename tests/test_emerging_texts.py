"""Emerging issues of scored reviews: whole texts stay out of the clusters' rows, and the words of a text are taken apart once."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from vocspark.functions import text as T
from vocspark.operators import ml
from vocspark.plans import scoring as S

F_LN = math.log(6 / 3)  # five texts, the term in two
WORDS = ["slow", "crash", "login", "price", "screen", "please", "update", "never", "works", "again"]


def test_clusters_bring_the_texts_they_show_only(spark, monkeypatch):
    rnd = random.Random(11)
    vecs = [[rnd.gauss(0, 1) + 3 * (j == i % 3) for j in range(5)] for i in range(20)]
    docs = [(i % 50, f"text {i:02d} " + " ".join(rnd.choices(WORDS, k=6)), vecs[i % 20]) for i in range(60)]  # keys and vectors repeat
    docs += [(70, None, vecs[0]), (71, "", vecs[1])]
    docs = spark.createDataFrame(docs, "doc_id long, content string, embedding array<double>")
    whole = docs.withColumn(S.TEXT_ID, F.xxhash64("doc_id", "content")).withColumn("actionability", F.lit(0.5)).localCheckpoint()
    texts = whole.select("doc_id", S.TEXT_ID, S.text_hash("content"), "embedding", "actionability")
    ids = whole.select(S.TEXT_ID).collect()
    scored = spark.createDataFrame([(ids[i * i % len(ids)][0], f"2024-0{1 + i % 3}", 0.1) for i in range(400)], "text_id long, date string, confidence double")
    kept = []
    soft = ml.soft_clusters
    monkeypatch.setattr(ml, "soft_clusters", lambda pool, *a, **k: kept.append(pool.columns) or soft(pool, *a, **k))
    was = S.emerging_of_scored(scored, texts=whole)
    now = S.emerging_of_scored(scored, texts=texts, contents=S.contents_of(docs))
    assert "_text" in kept[0] and "_text" not in kept[1]
    assert was.count() > 1 and sorted(map(tuple, was.collect())) == sorted(map(tuple, now.collect()))


def test_contents_by_id(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, None), (3, "c"), (None, "d")], "doc_id long, content string")
    texts = docs.select("doc_id", S.text_hash("content")).withColumn(S.TEXT_ID, F.monotonically_increasing_id()).localCheckpoint()
    ids = texts.where("doc_id < 3").select(S.TEXT_ID)
    got = S.contents_by_id(ids.union(ids), texts, S.contents_of(docs))
    assert sorted((r.content or "") for r in got.collect()) == ["", "a", "b", "b"] and got.columns == [S.TEXT_ID, "content"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [doc_id") < plan.index("LeftSemi")  # below the aggregate that shuffles texts


def test_words_of_a_text_are_taken_apart_once(spark):
    odd = ["", "   ", None, "a b", "\tslow slow Slow crash\n login ", "WWW!!! crash Crash CRASH crash now please update", "aaaaaa bbb ccc ddd eee",
           "x y z and some more words here", "  Iİ i i i i other words of a review  ", "never works again, please update the login screen!"]
    rows = [(i, t, lang) for i, t in enumerate(odd) for lang in ("en", "de", None)]
    df = spark.createDataFrame(rows, "doc_id long, content string, lang string")
    lx = {"sev5": ["crash"], "sev4": ["slow"], "sev3": ["update"], "signal": ["login", "crash"], "vent": ["never"]}
    for own in (df, df.drop("lang")):
        got = S.score_texts(own, "doc_id", lexicons=lx)
        lang = F.col("lang") if "lang" in own.columns else None
        want = own.select("doc_id", T.is_valid_review(F.col("content"), lang), T.severity("content", ["crash"], ["slow"], ["update"]),
                          T.actionability("content", ["login", "crash"], ["never"]))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_term_counts_build_no_row_objects(spark, monkeypatch):
    from vocspark.operators.factor import vocabulary
    plans = []
    frame = type(spark.range(1))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or collect(df))
    df = spark.createDataFrame([("crash crash login",), ("crash price",), ("login login login login",), ("once",), ("",)], "t string")
    prep = ml.fit_tfidf(df, "t", 10, ngram=1, min_df=2.0)
    assert vocabulary(prep) == ["login", "crash"]  # 5 and 3 times, in two texts each
    weights = [s.getScalingVec() for s in prep.stages if s.__class__.__name__ == "ElementwiseProduct"][0]
    assert [round(w, 9) for w in weights] == [round(1 + F_LN, 9)] * 2
    assert any("posexplode" in p for p in plans) and not any("inline" in p for p in plans)
