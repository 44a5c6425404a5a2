"""Explicit schemas of the derived tables (no inference on read)."""

from pyspark.sql import types as T

REVIEWS = T.StructType([
    T.StructField("reviewId", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("at", T.TimestampType()),
    T.StructField("app", T.StringType()),
    T.StructField("appVersion", T.StringType()),
    T.StructField("thumbsUpCount", T.IntegerType()),
    T.StructField("sentiment", T.StringType()),
])

REVIEW_CLASSIFICATIONS = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("severity", T.DoubleType()),
    T.StructField("value_weight", T.DoubleType()),
    T.StructField("financial_impact", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("app_version", T.StringType()),
    T.StructField("upvotes", T.LongType()),
])

TOPIC_TIMESERIES = T.StructType([
    T.StructField("topic_id", T.StringType()),
    T.StructField("issue_label", T.StringType()),
    T.StructField("month", T.StringType()),
    T.StructField("mentions", T.LongType()),
    T.StructField("normalized_rate", T.DoubleType()),
    T.StructField("severity_weighted_rate", T.DoubleType()),
    T.StructField("revenue_risk_score", T.DoubleType()),
    T.StructField("total_reviews_in_month", T.LongType()),
])

ALERTS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])

SYNC_LOG = T.StructType([
    T.StructField("last_sync", T.TimestampType()),
    T.StructField("last_sync_date", T.DateType()),
    T.StructField("status", T.StringType()),
    T.StructField("dataset", T.StringType()),
])
