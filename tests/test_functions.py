"""Literal expectations for functions and sinks that no registered query shows alone."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vocspark import config as C
from vocspark.functions import text as T
from vocspark.functions import vectors as V
from vocspark.operators.series import month_start, monthly_rates
from vocspark.operators.windows import period_split
from vocspark.plans import evidence, summary
from vocspark.sources import tables


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("text, cleaned", [
    ("analysis of a crisis", "analysis crisis"), ("The bugs and the classes!", "bug classe"), ("Buses, bus: stories", "buse bus story"),
    ("See http://x.y/z now", "see now"), (None, ""), ("AND the of", "")])
def test_clean_text(spark, text, cleaned):
    assert one(spark, T.clean_text(F.lit(text).cast("string"))) == cleaned


def test_text_helpers(spark):
    assert one(spark, T.ascii_normalise(F.lit("‘a’ “b” – — … 漢é"))) == "'a' \"b\" - - ... é"
    assert one(spark, T.parse_list_literal(F.lit("['a', 'b']"))) == ["a", "b"]
    assert one(spark, T.parse_list_literal(F.lit("[]"))) == []
    assert one(spark, T.snippet(F.lit("a\nb" * 100), 10)) == "a ba ba..."
    assert one(spark, T.dominant_word_ratio(F.lit("x X y z"))) == 0.5
    assert one(spark, summary.highlight(F.lit("Slow app is slow"), ["slow", "is"])) == "<mark>Slow</mark> app is <mark>slow</mark>"
    assert one(spark, summary.humanise_alert(F.lit("MoM spike of +12.5%"))) == "Mentions changed by +12.5% versus the previous period"
    assert one(spark, summary.humanise_alert(F.lit("Statistically out-of-control (Limit: 3.5)"))) == "Running above its normal range (limit 3.5)"
    assert one(spark, summary.humanise_alert(F.lit("plain"))) == "plain"


def test_bands(spark):
    assert [one(spark, summary.aspect_priority(F.lit(s), F.lit(m))) for s, m in ((25, 0), (3, 20), (14, 0), (1, 1), (1, 0))] == [
        "Critical", "Critical", "Active", "Active", "Watch"]
    assert tuple(one(spark, summary.drift_state(F.lit(0.2)))) == (84.0, "Shifting")
    assert tuple(one(spark, summary.drift_state(F.lit(0.15)))) == (63.0, "Evolving")
    assert tuple(one(spark, summary.drift_state(F.lit(0.5)))) == (100.0, "Shifting")
    assert [tuple(one(spark, summary.stability_index(F.lit(k)))) for k in (0, 1, 2, 9)] == [
        (100, "Stable"), (80, "Watch"), (60, "Volatile"), (0, "Volatile")]
    df = spark.createDataFrame([("a", 100.0), ("b", 2.0), ("c", 1.9)], "k string, v double")
    assert [(r.k, r["rank"]) for r in summary.relative_cutoff(df, "v", "k").orderBy("rank").collect()] == [("a", 1), ("b", 2)]


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert one(spark, V.cosine(a, b)) == pytest.approx(0.96)
    assert one(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, V.scale(a, F.lit(2.0))) == [6.0, 8.0]


def test_bad_dates_and_ids_are_tolerated(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    Path(path).write_text('reviewId,review,at\ngp:AOq,"good, really",2001-07-30 10:00:00\n2,bad,not a date\n10,fine,2001-04-01\n')
    r = tables.read_reviews(spark, path)
    assert dict(r.dtypes)["at"] == "timestamp"
    assert [x.reviewId for x in r.where("at is null").collect()] == ["2"]
    split = {x.reviewId: x.period for x in period_split(r, "2001-08-01 00:00:00", 3).collect()}
    assert split == {"gp:AOq": "cur", "10": "prev"}
    assert [x.reviewId for x in evidence.reviews_head(r, 3).collect()] == ["2", "10", "gp:AOq"]
    assert one(spark, month_start(F.lit("junk"))) is None and str(one(spark, month_start(F.lit("2001-02")))) == "2001-02-01"


def test_severity_covers_every_dated_row(spark):
    rows = [("a", "2001-01", "x" * n, 3.0, 1.25) for n in (1, 50)] + [("a", None, "x", 9.0, 9.0)]
    df = spark.createDataFrame(rows, "category string, date string, text string, severity double, financial_impact double")
    r = monthly_rates(df).first()
    assert (r.mentions, r.severity_weighted_rate, r.revenue_risk_score) == (2, 3000.0, 1250.0)
    quirk = monthly_rates(df, min_text_len=20).first()
    assert (quirk.mentions, quirk.severity_weighted_rate) == (2, 1500.0)


def test_label_and_metric_sinks(spark, tmp_path):
    labels = spark.createDataFrame([("a, b", "x", 1)], "review string, category string, n int")
    path = tables.write_labels_csv(labels, str(tmp_path / "l"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(path).collect()] == [("a, b", "x")]
    path = tables.write_metrics_json(spark.createDataFrame([("accuracy", 0.5)], "label string, f1 double"), str(tmp_path / "m"))
    lines = [json.loads(x) for f in Path(path).glob("part-*") for x in f.read_text().splitlines()]
    assert lines == [{"label": "accuracy", "f1": 0.5}]


def test_fixed_values_are_pinned():
    assert len(C.TAXONOMY_LABELS) == 12 and C.FALLBACK_LABEL == "General App Feedback"
    assert C.TIER_WEIGHTS["enterprise"] == 5.0 and C.TIER_WEIGHTS["free"] == 0.8
    assert C.ASPECT_MAP["UI/UX Experience"] == ["UI & Navigation", "Notifications & Spam"]
    assert "refund" in C.SEVERITY_4_WORDS and "fraud" in C.SEVERITY_5_WORDS
