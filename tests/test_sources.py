import os
import tempfile

import pytest
from pyspark.sql import functions as F

from vocspark.sources import tables as TB


def _tmp():
    return tempfile.mkdtemp(prefix="vocspark-test-", dir="/tmp")


def test_read_reviews_alias(spark):
    d = _tmp()
    p = os.path.join(d, "r.csv")
    with open(p, "w") as f:
        f.write('reviewId,comment,score\n1,"great, really ""good""\nsecond line",5\n2,bad,1\n')
    df = TB.read_reviews(spark, p)
    rows = sorted(df.select("reviewId", "content").collect())
    assert rows[0].content.startswith('great, really "good"') and "second line" in rows[0].content
    assert rows[1].content == "bad"


def test_read_reviews_no_text_column(spark):
    d = _tmp()
    p = os.path.join(d, "r.csv")
    with open(p, "w") as f:
        f.write("a,b\n1,2\n")
    with pytest.raises(ValueError):
        TB.read_reviews(spark, p)


def test_load_table_missing_and_reviews_empty(spark):
    d = _tmp()
    assert TB.load_table(spark, d, "nope") is None
    df = TB.load_reviews(spark, d)
    assert df.count() == 0 and "content" in df.columns


def test_write_and_load_table(spark):
    d = _tmp()
    df = spark.createDataFrame([("2024-01", 1), ("2024-02", 2)], "month string, n int")
    TB.write_table(df, d, "t", partition_by="month")
    back = TB.load_table(spark, d, "t")
    assert back.count() == 2


def test_load_labeled(spark):
    df = spark.createDataFrame([(" a ", "X"), ("b", "X"), ("c", "Y"), ("d", "Y"), ("e", "Z"), ("", "Y")],
                               "Text string, Label string")
    out = TB.load_labeled(df, min_per_class=2)
    assert sorted(r.category for r in out.collect()) == ["X", "X", "Y", "Y"]
    with pytest.raises(ValueError):
        TB.load_labeled(df, min_per_class=3)


def test_load_training_refuses_outputs(spark):
    with pytest.raises(ValueError):
        TB.load_training(spark, "/tmp/x/review_classifications.csv")


def test_needs_sync(spark):
    log = TB.sync_log(spark, "2024-05-01 10:00:00")
    assert TB.needs_sync(log, "2024-05-01").first().due is False
    assert TB.needs_sync(log, "2024-05-02").first().due is True
    assert TB.needs_sync(TB.sync_log(spark, None), "2024-05-02").first().due is True


def test_alert_registry_roundtrip(spark):
    d = os.path.join(_tmp(), "alerts")
    a = spark.createDataFrame([("id1", "aspect_spike", "Pricing", "m", "high", "2024-01-01 00:00:00")],
                              "id string, type string, category string, message string, severity string, ts string")
    a = a.withColumn("timestamp", F.to_timestamp("ts")).drop("ts")
    TB.write_alerts(a, d, "2024-01-02 00:00:00")
    back = TB.read_alerts(spark, d).collect()
    assert len(back) == 1 and back[0].category == "Pricing"
    assert TB.read_alerts(spark, d + "-missing").count() == 0


def test_labelled_rows_are_checked(spark):
    rows = [("a text", "x")] * 3 + [("b text", "y")] * 2 + [("c text", "z")]
    df = spark.createDataFrame(rows, "text string, label string")
    assert TB.load_labeled(df, min_rows=5).count() == 5
    with pytest.raises(ValueError, match="6 labelled rows, got 5"):
        TB.load_labeled(df, min_rows=6)
    with pytest.raises(ValueError, match="3 classes"):
        TB.load_labeled(df, min_classes=3)


def test_empty_first_table_is_skipped_by_the_report(spark, tmp_path):
    base = str(tmp_path)
    TB.write_table(spark.createDataFrame([], "content string"), base, "uploaded_reviews")
    TB.write_table(spark.createDataFrame([("t",)], "content string"), base, "cleaned_reviews")
    assert TB.load_reviews(spark, base).count() == 0
    assert TB.load_reviews(spark, base, skip_empty=True).count() == 1
