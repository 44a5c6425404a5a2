"""Fixture views: the reference's input tables derived from the driver tables.

Every view is a lazy DataFrame over the *whole* driver tables (no id subsets,
no row caps), so its work grows with the scale factor. Formulas use integer
arithmetic for keys, dates and categories so an SQL oracle picks the same rows.
See FIXTURES.md §3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspark import config as C
from vocspark.functions.value import clv_factor, financial_impact, rating_sentiment, tier_weight
from vocspark.sources.tables import read_table

AS_OF = C.DEFAULT_AS_OF

# FIXED VALUES — market segment -> customer tier used by the fixtures.
SEGMENT_TIER = {
    "AUTOMOBILE": "enterprise",
    "BUILDING": "premium",
    "FURNITURE": "pro",
    "HOUSEHOLD": "standard",
    "MACHINERY": "free",
}


def _segment_tier(seg):
    expr = F.lit(None).cast("string")
    for s, t in reversed(list(SEGMENT_TIER.items())):
        expr = F.when(seg == F.lit(s), F.lit(t)).otherwise(expr)
    return expr


def fx_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews: one per order, text from documents[o_orderkey mod n_docs].

    Columns: reviewId, content, lang, score, sentiment, at, user_tier, clv,
    appVersion, thumbsUpCount, app, doc_id.
    """
    r = fx_review_rows(spark, sf_dir)
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), "lang")
    return r.join(d, "doc_id").select("reviewId", "content", "lang", *[c for c in r.columns if c not in ("reviewId", "doc_id")], "doc_id")


def fx_review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_reviews without what the documents bring (content, lang): a row for each order of a customer, whether
    its document exists or not."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    n_docs = read_table(spark, sf_dir, "documents").select(F.count(F.lit(1))).scalar()
    r = o.join(c, o.o_custkey == c.c_custkey, "inner")
    score = (F.lit(1) + F.pmod(F.lit(7) * F.col("o_orderkey") + F.col("o_custkey"), F.lit(5))).cast("int")
    return r.select(
        F.col("o_orderkey").cast("string").alias("reviewId"),
        score.alias("score"),
        rating_sentiment(score).alias("sentiment"),
        F.col("o_orderdate").alias("at"),
        _segment_tier(F.col("c_mktsegment")).alias("user_tier"),
        F.col("c_acctbal").alias("clv"),
        F.concat(F.lit("v"), F.pmod(F.col("o_custkey"), F.lit(9)).cast("string")).alias("appVersion"),
        F.pmod(F.col("o_custkey"), F.lit(20)).cast("int").alias("thumbsUpCount"),
        F.lit("fixture").alias("app"),
        F.pmod(F.col("o_orderkey"), n_docs).alias("doc_id"),
    )


def fx_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """review_classifications: negative line-item reviews routed to a category.

    A line is a negative review when
    (l_partkey + 7*l_suppkey + l_linenumber) mod 24 < 4 + (k*mi) mod 13, with
    k = l_partkey mod 13 (the category index) and mi = 12*year + month of the
    ship date — so each category's negative rate moves month to month.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    k = F.pmod(F.col("l_partkey"), F.lit(13))
    mi = F.lit(12) * F.year("l_shipdate") + F.month("l_shipdate")
    negative = F.pmod(F.col("l_partkey") + F.lit(7) * F.col("l_suppkey") + F.col("l_linenumber"), F.lit(24)) \
        < F.lit(4) + F.pmod(k * mi, F.lit(13))
    j = li.filter(negative).join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey)
    severity = F.lit(2.0) + F.lit(0.5) * F.pmod(F.col("l_quantity"), F.lit(7.0))
    weight = F.round(tier_weight(_segment_tier(F.col("c_mktsegment"))) * clv_factor(F.col("c_acctbal")), 2)
    # fixed width: no rule on text length depends on the scale of the keys
    text = F.concat(F.lit("review of order "), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"),
                    F.lit(", line "), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"),
                    F.lit(", part "), F.lpad(F.col("l_partkey").cast("string"), 10, "0"),
                    F.lit(", supplier "), F.lpad(F.col("l_suppkey").cast("string"), 10, "0"))
    return (j.select(
        text.alias("text"),
        F.element_at(C.label_array(), (k + 1).cast("int")).alias("category"),
        F.date_format("l_shipdate", "yyyy-MM").alias("date"),
        severity.alias("severity"),
        weight.alias("value_weight"),
        F.round(F.lit(10.0) * F.col("l_discount"), 4).alias("confidence"),
        F.concat(F.lit("v"), F.pmod(F.col("o_custkey"), F.lit(9)).cast("string")).alias("app_version"),
        F.pmod(F.col("o_custkey"), F.lit(20)).alias("upvotes"),
        F.col("l_shipdate").alias("at"),
        F.col("l_quantity"),
        F.col("l_linenumber"),
        _segment_tier(F.col("c_mktsegment")).alias("user_tier"),
    ).withColumn("financial_impact", financial_impact(F.col("severity"), F.col("value_weight"))))


def fx_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic_timeseries built by the monthly-rates operator from fx_classified."""
    from vocspark.operators.series import monthly_rates
    return monthly_rates(fx_classified(spark, sf_dir))


def fx_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic_analysis built by the topic-stats operator from fx_classified."""
    from vocspark.operators.series import topic_stats
    return topic_stats(fx_classified(spark, sf_dir))


def fx_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with a category ('c' || label) and a month ('2024-0' || 1 + vec_id mod 6)."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"),
        F.concat(F.lit("2024-0"), (F.lit(1) + F.pmod(F.col("vec_id"), F.lit(6))).cast("string")).alias("month"),
    )


def fx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a feedback stream: category = event_type, at = ts, severity = value."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("reviewId"),
        F.col("event_type").alias("category"),
        F.col("ts").alias("at"),
        F.col("value").alias("severity"),
        F.col("user_id"),
        F.col("props"),
    )


# FIXTURE LEXICONS — tokens that occur in the driver's invented prose. The
# reference lexicons (vocspark.config) do not occur there, so text operators
# are exercised with these (they are parameters of every text operator).
FX_ASPECT_KEYWORDS = {
    "Performance/Technical": ["thnt", "thble"],
    "Content/Library": ["attion", "onnd"],
    "UI/UX Experience": ["thou", "anon"],
    "Pricing/Subscription": ["thwh", "thsh"],
}
FX_SEVERITY_5 = ["than"]
FX_SEVERITY_4 = ["thing", "then"]
FX_SEVERITY_3 = ["only", "thor"]
FX_SIGNAL = ["than", "then", "thing", "thin", "thor", "only", "this", "that"]
FX_VENT = ["the", "and", "of"]


# FIXTURE PHRASES — the taxonomy's labels described in words of the driver's prose, as
# vocspark.config describes them in English.
FX_ISSUE_PHRASES = {
    "Subscription & Billing": ["thwh thsh", "thwh erwh ersh"],
    "App Crash & Launch Failure": ["thnt onnt", "thnt ernt onnt"],
    "Video & Streaming Playback": ["attion ertion", "thtion attion"],
    "Account & Login": ["thst erst", "onst thst erst"],
    "Customer Support": ["thon eron", "anon thon onon"],
    "Performance & Speed": ["thble erble", "thanedble thble"],
    "Content & Features": ["onnd thnd", "ernd onnd"],
    "Notifications & Spam": ["thing ering", "oning thing ering"],
    "UI & Navigation": ["thou onou", "erou thou"],
    "Bugs & Technical Errors": ["thre erre", "onre erre"],
    "Privacy & Security": ["thly erly", "erly oned"],
    "Download & Offline": ["thes eres", "erth onth"],
}


# FIXTURE LABELS — topics (named by their category) whose issue label is another one: a label with
# statistics of its own, and one that has none.
FX_TOPIC_LABELS = {
    "Download & Offline": "Content & Features",
    "Bugs & Technical Errors": "Technical",
    "Notifications & Spam": "Technical",
}


def cleaned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, cleaned_content): every document cleaned once (F1), read by all that vectorises text."""
    from vocspark.functions.text import clean_text
    from vocspark.session import spread
    from vocspark.sources.derived import derived
    return derived(spark, sf_dir, "cleaned_documents", lambda: spread(read_table(spark, sf_dir, "documents")).select(
        "doc_id", clean_text("text").alias("cleaned_content")))


def fx_lexicons() -> dict[str, list[str]]:
    return {"sev5": FX_SEVERITY_5, "sev4": FX_SEVERITY_4, "sev3": FX_SEVERITY_3, "signal": FX_SIGNAL, "vent": FX_VENT}


def text_scores_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, is_valid, severity, actionability): each document looked at once, for all its reviews."""
    from vocspark.plans.scoring import score_texts
    from vocspark.session import spread
    from vocspark.sources.derived import derived
    return derived(spark, sf_dir, "text_scores", lambda: score_texts(
        spread(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "lang"), "doc_id", "text", fx_lexicons()))


def fx_negative_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 + P4: negative reviews passing the quality gate (language from the `lang` column), counted by text:
    (doc_id, content, n_reviews)."""
    r = fx_review_rows(spark, sf_dir).filter(F.col("sentiment") == "negative").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_reviews"))
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    return d.join(text_scores_table(spark, sf_dir).filter("is_valid").select("doc_id"), "doc_id").join(r, "doc_id")


def fx_aspect_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """aspect_analysis over the negative, valid fixture reviews (fixture aspect lexicon); each text is looked at once."""
    from vocspark.plans.dashboard import aspect_counts
    return aspect_counts(fx_negative_valid(spark, sf_dir), "content", FX_ASPECT_KEYWORDS, "n_reviews")


def fx_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an embedding: every document gets embeddings[doc_id mod n_vecs].

    Columns: doc_id, text, lang, embedding, category ('c' || label), month ('2024-0' || 1 + doc_id mod 6).
    """
    return with_vectors(spark, sf_dir, read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def with_vectors(spark: SparkSession, sf_dir: str, d: DataFrame) -> DataFrame:
    """Rows with a doc_id and their document's embedding, category and month (see fx_semantic)."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    n_vecs = e.select(F.count(F.lit(1))).scalar()
    own = d.columns
    d = d.withColumn("_vec", F.pmod(F.col("doc_id"), n_vecs))
    j = d.join(e, d._vec == e.vec_id)
    return j.select(
        *own,
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"),
        F.concat(F.lit("2024-0"), (F.lit(1) + F.pmod(F.col("doc_id"), F.lit(6))).cast("string")).alias("month"),
    )


# ---------------------------------------------------------------------------
# Materialised derived tables (built once per input folder, then read back)
# ---------------------------------------------------------------------------

def classified_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vocspark.sources.derived import derived
    return derived(spark, sf_dir, "review_classifications", lambda: fx_classified(spark, sf_dir))


def timeseries_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vocspark.operators.series import monthly_rates
    from vocspark.sources.derived import derived
    return derived(spark, sf_dir, "topic_timeseries", lambda: monthly_rates(classified_table(spark, sf_dir)))


def topics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vocspark.operators.series import topic_stats
    from vocspark.sources.derived import derived
    return derived(spark, sf_dir, "topic_analysis", lambda: topic_stats(classified_table(spark, sf_dir)))


def aspect_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vocspark.sources.derived import derived
    return derived(spark, sf_dir, "aspect_analysis", lambda: fx_aspect_analysis(spark, sf_dir))


def fx_reviews_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_reviews plus the review text's embedding (embeddings[doc_id mod n_vecs])."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n_vecs = e.select(F.count(F.lit(1))).scalar()
    r = fx_reviews(spark, sf_dir).withColumn("_vec", F.pmod(F.col("doc_id"), n_vecs))
    return r.join(e, r._vec == e.vec_id).drop("_vec", "vec_id") \
            .withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
