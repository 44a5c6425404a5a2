"""Reviews that share texts: each text is scored once, and the tables are those of the reviews one by one."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vocspark.operators import factor, ml
from vocspark.operators.vectors import centroids
from vocspark.plans import scoring as S

WORDS = ["slow", "crash", "login", "price", "screen", "please", "update", "never", "works", "again"]


@pytest.fixture(scope="module")
def parts(spark):
    rnd = random.Random(7)
    docs, vecs = [], {}
    for i in range(24):
        text = f"text {i} " + " ".join(rnd.choices(WORDS, k=12))
        vecs[i] = [rnd.random() - 0.4 for _ in range(6)]
        docs.append((i, text if i % 7 else "short", "en", vecs[i]))
    docs.append((3, "another text under the same key " + " ".join(WORDS), "en", vecs[4]))  # keys may repeat
    texts = spark.createDataFrame(docs, "doc_id long, content string, lang string, embedding array<double>")
    reviews = spark.createDataFrame(
        [(str(i), int(i * i % 26), "negative" if i % 3 else "positive", dt.datetime(2024, 1 + i % 4, 3), "pro", float(i), i % 5) for i in range(400)],
        "reviewId string, doc_id long, sentiment string, at timestamp, user_tier string, clv double, thumbsUpCount int")
    cents = centroids(texts.where("doc_id < 5").withColumn("category", F.concat(F.lit("c"), F.col("doc_id") % 3)), "category", "embedding")
    return texts, reviews, cents


def _rows(df):
    plain = lambda v: round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v
    return sorted(map(repr, (tuple(plain(v) for v in r) for r in df.collect())))


def test_tables_equal_those_of_the_reviews_one_by_one(spark, parts):
    texts, reviews, cents = parts
    texts = texts.where("content NOT LIKE 'another%'")
    keywords = {"A": ["crash"], "B": ["price", "login"]}
    one_by_one = S.score_reviews(reviews.join(texts, "doc_id"), cents).localCheckpoint()
    scores = S.score_texts(texts, "doc_id")
    once = S.scored_texts(texts.drop("lang"), scores, cents).localCheckpoint()
    scored = S.score_reviews(reviews, cents, texts=once).localCheckpoint()
    assert not {"content", "embedding"} & set(scored.columns)
    was = S.tables_of_scored(one_by_one, cents, keywords, emerging=False)
    now = S.tables_of_scored(scored, cents, keywords, emerging=False, texts=once)
    assert was.keys() == now.keys()
    for name in was:
        assert was[name].columns == now[name].columns, name
        assert _rows(was[name]) == _rows(now[name]), name
    assert now["review_classifications"].count() > once.count()


def test_repeated_keys_meet_every_text(spark, parts):
    texts, reviews, cents = parts
    once = S.scored_texts(texts.drop("lang"), S.score_texts(texts, "doc_id").dropDuplicates(["doc_id"]), cents).localCheckpoint()
    scored = S.score_reviews(reviews, cents, texts=once)
    assert once.where("doc_id = 3").count() == 2
    n = reviews.where("doc_id = 3 AND sentiment = 'negative'").count()
    assert n > 0 and scored.where("doc_id = 3").count() == 2 * n
    assert S.weighed_texts(scored, once).where("doc_id = 3").select("n_reviews").collect() == [(n,), (n,)]


def test_weighed_factorisation_equals_repeated_rows(spark):
    rnd = random.Random(3)
    rows = [([abs(rnd.gauss(0, 1)) * ((i + j) % 3 > 0) for j in range(8)], 1 + i % 4) for i in range(30)]
    weighed = spark.createDataFrame(rows, "x array<double>, n long")
    each = weighed.select(F.explode(F.array_repeat("x", F.col("n").cast("int"))).alias("x"))
    a, b = factor.fit_nmf(weighed, 8, 3, max_iter=5), factor.fit_nmf(each, 8, 3, max_iter=5)
    assert abs(a.components - b.components).max() < 1e-8
    assert a.errors == pytest.approx(b.errors)


def test_emerging_clusters_count_reviews_of_shared_texts(spark):
    rnd = random.Random(5)
    docs = [(i, f"text {i:02d} " + " ".join(rnd.choices(WORDS, k=6)), [rnd.gauss(0, 1) + 3 * (j == i % 3) for j in range(5)], 0.5) for i in range(30)]
    texts = spark.createDataFrame(docs, "text_id long, text string, embedding array<double>, act double")
    reviews = spark.createDataFrame([(i * i % 30, f"2024-0{1 + i % 3}") for i in range(300)], "text_id long, month string")
    months = reviews.groupBy("text_id", "month").agg(F.count(F.lit(1)).alias("n"))
    pool = texts.join(reviews.groupBy("text_id").agg(F.count(F.lit(1)).alias("n")), "text_id")
    was = ml.emerging_clusters(reviews.join(texts, "text_id"), "embedding", "text", "month", k=3, actionable="act")
    now = ml.emerging_clusters(pool, "embedding", "text", "month", k=3, actionable="act", months=months, key="text_id", weight="n")
    assert was.count() > 0 and _rows(was) == _rows(now)


def test_passes_of_a_fit_read_no_texts(spark, monkeypatch):
    seen = []
    fit = ml.fit_nmf
    monkeypatch.setattr(ml, "fit_nmf", lambda x, *a, **k: seen.append(x.columns) or fit(x, *a, **k))
    written = []
    cut = ml.cut_lineage
    monkeypatch.setattr(ml, "cut_lineage", lambda df, *a: written.append(df.columns) or cut(df, *a))
    pool = spark.createDataFrame([(f"t{i}", [float(i % 3), float(i % 5), 1.0]) for i in range(40)], "text string, v array<double>")
    assert ml.soft_clusters(pool, "v", ("text",), k=2).count() == 40
    assert seen == [["_features", "_rows"]] and ["_features", "_rows"] in written  # the fit's own written table
