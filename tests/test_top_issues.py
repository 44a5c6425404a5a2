"""E31 reads its models' verdicts once: a filter on a predicted column must not run the model again and again."""

import re

from pyspark.sql import functions as F

from vocspark.functions import text as T
from vocspark.operators import ml as ML
from vocspark.plans import registry
from vocspark.plans.scoring import top_issues_from_reviews


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sentiment_is_read_not_predicted_again(spark, monkeypatch, tmp_path):
    rows = [(i, f"{'bad slow' if i % 2 else 'good quick'} thing{i % 5}") for i in range(40)] + [(3, "bad thing"), (None, "good"), (51, "")]
    cleaned = spark.createDataFrame(rows, "doc_id long, cleaned_content string")
    label = F.when(F.col("cleaned_content").contains("bad"), "negative").otherwise("positive").alias("label")
    model = ML.fit_sentiment(cleaned.where("doc_id < 40").select("cleaned_content", label), "cleaned_content", "label", max_iter=20)
    monkeypatch.setattr(registry, "_sentiment", lambda spark, sf: model)
    monkeypatch.setattr(registry.FX, "cleaned_table", lambda spark, sf: cleaned)
    judged = registry._judged(spark, str(tmp_path))
    assert judged.columns == ["doc_id", "cleaned_content", "sentiment"]
    negative = judged.filter(F.col("sentiment") == "negative")
    assert "UDF" not in plan(negative)
    found = lambda df: sorted(map(str, df.collect()))
    assert found(judged) == found(ML.predict_sentiment(cleaned, model, "sentiment"))
    assert {r.doc_id for r in negative.collect() if r.doc_id is not None and r.doc_id < 40} == set(range(1, 40, 2))


def test_known_sentiment_and_topics_once(spark, monkeypatch):
    monkeypatch.setattr(ML, "predict_sentiment", None)  # not called: the column holds the verdict
    monkeypatch.setattr(ML, "predict_topic", lambda df, model, text: df.withColumn("topic_keywords", F.reverse(F.col(text))))
    rows = [("a text", "ba", "negative", True), ("b text", "ba", "negative", True), ("c text", "dc", "negative", True),
            ("d text", "dc", "positive", True), ("e text", "dc", "negative", False), (None, "dc", "negative", True), ("f text", "dc", None, True)]
    reviews = spark.createDataFrame(rows, "content string, cleaned string, mood string, ok boolean")
    got = top_issues_from_reviews(reviews, None, None, valid="ok", cleaned="cleaned", sentiment="mood")
    assert "reverse" not in plan(got)  # the topics are written, for counts and examples alike
    assert [tuple(r) for r in got.orderBy("rank").select("issue", "mentions", "pct", "rank").collect()] == [("ab", 2, 50.0, 1), ("cd", 2, 50.0, 2)]
    assert {r.issue: r.examples for r in got.collect()} == {"ab": ["a text"], "cd": [None]}


def test_clean_text_keeps_letters_and_white_space(spark):
    texts = ["It's 5€—Ünïx\x0bKK TABS\tand\x0clines\r\nend", "İstanbul  x y {[z]}", "A-B_c^d\\e"]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.clean_text("t", ["zzzz"], False).alias("x")).collect()]
    assert got == [re.sub(r"\s+", " ", re.sub(r"[^a-zA-Z\s]", "", t.lower(), flags=re.A), flags=re.A).strip(" ") for t in texts]
