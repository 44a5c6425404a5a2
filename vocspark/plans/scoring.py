"""Batch scoring (E20–E22, E31, E32): reviews in, derived tables out.

`score_batch` is the reference's upload pipeline as one lazy lineage:
negative + quality-gated reviews -> nearest-centroid category (>= 0.30, else
the fallback bucket) -> severity, customer value, financial impact -> the
derived tables. Callers persist `scored` once (write or checkpoint) and build
every table from it; each table is an aggregation with partial aggregation, so
the fallback bucket — often a third of all rows — never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark import config as C
from vocspark.functions import text as T
from vocspark.functions.value import financial_impact, value_weight
from vocspark.operators.series import monthly_rates, topic_stats
from vocspark.operators.vectors import classify
from vocspark.session import written

#: Number of a text among the scored texts.
TEXT_ID = "text_id"
#: SHA-256 of a text: tells the texts of one key apart where the text itself is left out.
TEXT_HASH = "text_hash"


def text_hash(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text), 256)).alias(TEXT_HASH)


def contents_of(texts: DataFrame, text: str = "content", key: str = "doc_id") -> DataFrame:
    """(key, TEXT_HASH, text): each text once under its key, for scored texts that hold TEXT_HASH only."""
    return texts.select(key, text_hash(text), text).dropDuplicates([key, TEXT_HASH])


def with_contents(texts: DataFrame | None, contents: DataFrame | None, key: str = "doc_id") -> DataFrame | None:
    """Scored texts with their text, if they do not hold it already; a null text stays null."""
    return texts if contents is None or texts is None else texts.join(contents, [key, TEXT_HASH], "left")


def score_texts(texts: DataFrame, key: str, text: str = "content", lexicons=None, lang: str | None = "lang") -> DataFrame:
    """P4 + F11 + F12 of each text: (key, is_valid, severity, actionability). What depends on the text
    alone is worked out once, however many reviews share it; its words are taken apart once for all three."""
    lx = lexicons or {}
    own = [key, text, *([lang] if lang and lang in texts.columns else [])]
    w = texts.select(*own, T.words(text).alias("_words"))
    w = w.select(*own, "_words", F.array_distinct("_words").alias("_set"))
    return w.select(
        key, T.is_valid_review(F.col(text), F.col(lang) if lang in own else None, found="_words").alias("is_valid"),
        T.severity(F.col(text), lx.get("sev5"), lx.get("sev4"), lx.get("sev3"), "_set").alias("severity"),
        T.actionability(F.col(text), lx.get("signal"), lx.get("vent"), "_set").alias("actionability"))


def scored_texts(texts: DataFrame, text_scores: DataFrame, centroids: DataFrame, key: str = "doc_id", vec: str = "embedding",
                 threshold: float = C.CONFIDENCE_THRESHOLD) -> DataFrame:
    """P4 + M10 of each text that reviews share: the valid ones with their columns, severity and actionability
    (from `score_texts`, by `key`), category, confidence and TEXT_ID, which tells them apart where keys repeat.

    Callers write the result once: the numbers belong to the written rows."""
    t = texts.join(text_scores.filter("is_valid").select(key, "severity", "actionability"), key)
    t = classify(t, vec, centroids, threshold=threshold).withColumnRenamed("predicted", "category").drop("best_label")
    return t.withColumn(TEXT_ID, F.monotonically_increasing_id())


def score_reviews(reviews: DataFrame, centroids: DataFrame, lexicons=None, text: str = "content",
                  vec: str = "embedding", lang: str | None = "lang", threshold: float = C.CONFIDENCE_THRESHOLD,
                  negative_only: bool = True, texts: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """P3 + P4 + M10 + F11 + F13 + F17 per review. Output keeps the review columns plus
    category, confidence, date, severity, actionability, value_weight, financial_impact.

    Where reviews share texts, `texts` (written `scored_texts`, by `key`) brings what the texts give. Reviews
    then carry neither text nor vector, only the TEXT_ID that `tables_of_scored` finds them by."""
    r = reviews
    if negative_only and "sentiment" in r.columns:
        r = r.filter(F.col("sentiment") == "negative")
    r = r.withColumn("date", F.date_format(F.col("at"), "yyyy-MM"))
    if texts is not None:
        r = r.join(texts.select(key, TEXT_ID, "severity", "actionability", "category", "confidence"), key)
    else:
        lx = lexicons or {}
        r = r.filter(T.is_valid_review(F.col(text), F.col(lang) if lang and lang in r.columns else None))
        r = classify(r, vec, centroids, threshold=threshold).withColumnRenamed("predicted", "category") \
            .drop("best_label")
        r = r.withColumn("severity", T.severity(F.col(text), lx.get("sev5"), lx.get("sev4"), lx.get("sev3")))
        r = r.withColumn("actionability", T.actionability(F.col(text), lx.get("signal"), lx.get("vent")))
    r = value_weight(r)
    return r.withColumn("financial_impact", financial_impact(F.col("severity"), F.col("value_weight")))


def valid_reviews(reviews: DataFrame, text: str = "content", lang: str = "lang", profiles: DataFrame | None = None) -> DataFrame:
    """F4 + F10: reviews with `is_valid`. Without a language column the profiles tell the language, and
    a text in which they find none is not valid; without either the language rule is off."""
    from vocspark.operators.language import with_language
    if lang in reviews.columns:
        return reviews.withColumn("is_valid", T.is_valid_review(F.col(text), F.col(lang)))
    if profiles is None:
        return reviews.withColumn("is_valid", T.is_valid_review(F.col(text)))
    found = with_language(reviews, text, profiles, "_lang")
    return found.withColumn("is_valid", T.is_valid_review(F.col(text), F.col("_lang"))).drop("_lang")


def classifications(scored: DataFrame, text: str = "content", min_len: int | None = None) -> DataFrame:
    """review_classifications. `min_len` (off by default) is the reference's rule: only texts longer than
    20 characters."""
    return (scored if min_len is None else scored.filter(F.length(F.col(text)) > min_len)).select(
        F.col(text).alias("text"), "category", "date", "severity", "value_weight", "financial_impact",
        F.round("confidence", 4).alias("confidence"),
        F.col("appVersion").alias("app_version") if "appVersion" in scored.columns else F.lit("Build N/A").alias("app_version"),
        F.coalesce(F.col("thumbsUpCount").cast("long"), F.lit(0).cast("long")).alias("upvotes")
        if "thumbsUpCount" in scored.columns else F.lit(0).cast("long").alias("upvotes"))


def score_batch(reviews: DataFrame, centroids: DataFrame, lexicons=None, aspect_keywords=None,
                text: str = "content") -> dict[str, DataFrame]:
    """The derived tables of one upload (lazy; write `scored` before building many)."""
    scored = score_reviews(reviews, centroids, lexicons, text)
    return {"uploaded_reviews": uploaded_reviews(reviews, text), "scored": scored,
            **tables_of_scored(scored, centroids, aspect_keywords, text)}


def uploaded_reviews(reviews: DataFrame, text: str = "content") -> DataFrame:
    """the upload keeps a lower-case copy of the text."""
    return reviews.drop("embedding").withColumn("cleaned_content", F.lower(F.col(text)))


def tables_of_scored(scored: DataFrame, centroids: DataFrame, aspect_keywords=None, text: str = "content",
                     vec: str = "embedding", as_of: str = C.DEFAULT_AS_OF, min_confidence: float = C.CONFIDENCE_THRESHOLD,
                     emerging: bool = True, labeler=None, texts: DataFrame | None = None,
                     contents: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables that the scored reviews give. `emerging` fits the clusters of the reviews
    below `min_confidence` (M14) at once, and `labeler` names them (F22); without it that table is left out.

    With `texts` (written `scored_texts`) the scored reviews hold TEXT_ID in place of text and vector: what
    follows from them is worked out once for each text, weighed by its reviews (in a month, where months
    count), and only the classifications bring the text back to every review. Where `texts` holds `aspects`
    and TEXT_HASH in place of the text, `contents` (`contents_of`) has it for the tables that need it."""
    from vocspark.operators.vectors import drift_pairs, silhouette
    from vocspark.plans.dashboard import aspect_counts, threshold_alerts
    if texts is None:
        used = monthly = scored
        weight = None
        aspects = aspect_counts(scored, text, aspect_keywords)
    else:
        used, monthly, weight = weighed_texts(scored, texts), weighed_texts(scored, texts, "date"), WEIGHT
        found = texts.select(TEXT_ID, "aspects") if "aspects" in texts.columns else \
            texts.select(TEXT_ID, T.aspects(F.col(text), aspect_keywords).alias("aspects"))  # before the join: no text in it
        aspects = aspect_counts(weighed_texts(scored, found), text, aspect_keywords, weight, "aspects")
    out = {
        "review_classifications": classifications(with_text(scored, with_contents(texts, contents), text), text),
        "topic_timeseries": monthly_rates(scored),
        "topic_analysis": topic_stats(scored, text=text, vec=vec, anchors=centroids, texts=None if texts is None else with_contents(used, contents), weight=weight),
        "aspect_analysis": aspects,
        "semantic_drift": drift_pairs(with_contents(monthly, contents), "category", "date", vec, text, weight=weight),
        "classification_quality": silhouette(used, "category", vec, weight),
        "alerts": threshold_alerts(aspects, as_of),
    }
    if emerging:
        out["emerging_issues"] = emerging_of_scored(scored, text, vec, min_confidence, labeler, texts, contents)
    return out


def with_text(scored: DataFrame, texts: DataFrame | None, text: str = "content") -> DataFrame:
    """The scored reviews with their texts, if they do not hold them already."""
    return scored if texts is None else scored.join(texts.select(TEXT_ID, text), TEXT_ID)


def emerging_of_scored(scored: DataFrame, text: str = "content", vec: str = "embedding", min_confidence: float = C.CONFIDENCE_THRESHOLD,
                       labeler=None, texts: DataFrame | None = None, contents: DataFrame | None = None) -> DataFrame:
    """M14 over the scored reviews below `min_confidence`; with `texts`, each of their texts is clustered once,
    and `contents` are read for the texts that a cluster shows only."""
    from vocspark.operators.ml import emerging_clusters
    pool = scored.filter(F.col("confidence") < min_confidence)
    if texts is None:
        return emerging_clusters(pool, vec, text, "date", labeler, actionable="actionability")
    months = pool.groupBy(TEXT_ID, "date").agg(F.count(F.lit(1)).alias(WEIGHT))
    bodies = None if contents is None else lambda ids: contents_by_id(ids, texts, contents)
    return emerging_clusters(weighed_texts(pool, texts), vec, text, "date", labeler, actionable="actionability",
                             months=months, key=TEXT_ID, weight=WEIGHT, bodies=bodies)


def contents_by_id(ids: DataFrame, texts: DataFrame, contents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(TEXT_ID, text) of some scored texts (`ids`: TEXT_ID). Their keys are written: where they turn out few, the
    other texts are left out before `contents` are shuffled."""
    some = written(texts.select(TEXT_ID, key, TEXT_HASH).join(ids.select(TEXT_ID).distinct(), TEXT_ID))
    own = contents.join(some.select(key, TEXT_HASH).distinct(), [key, TEXT_HASH], "left_semi")
    return with_contents(some, own, key).drop(key, TEXT_HASH)


#: Number of scored reviews that a text stands for.
WEIGHT = "n_reviews"


def weighed_texts(scored: DataFrame, texts: DataFrame, *by: str) -> DataFrame:
    """The scored texts that reviews have, with their number of reviews (WEIGHT), for each value of the review columns `by`."""
    return texts.join(scored.groupBy(TEXT_ID, *by).agg(F.count(F.lit(1)).alias(WEIGHT)), TEXT_ID)


def preprocess_training(df: DataFrame, text: str = "content", score: str = "score", texts: DataFrame | None = None,
                        key: str = "doc_id") -> DataFrame:
    """Drop null / blank text, clean it (F1), drop rows whose cleaned text is blank.

    Where many rows share a text, `texts` holds each once (`key`, `text`): it is cleaned before
    the rows of `df` (`key`, `score`) meet it."""
    d = df if texts is None else texts.select(key, text)
    d = d.filter(F.col(text).isNotNull() & (F.trim(F.col(text)) != ""))
    d = d.withColumn("cleaned_content", T.clean_text(F.col(text)))
    d = d.filter(F.trim(F.col("cleaned_content")) != "")
    if texts is not None:
        d = df.select(key, score).join(d, key)
    return d.select(text, score, "cleaned_content")


def analyze(reviews: DataFrame, sentiment_model, topic_model, aspect_keywords=None, text: str = "content",
            keep: tuple[str, ...] = (), cleaned: str | None = None) -> DataFrame:
    """Per review — sentiment, topic of greatest weight and its keywords, aspects (after the `keep` columns).

    The models read the cleaned text (F1): the column `cleaned` where it is at hand, else made here."""
    from vocspark.operators.ml import predict_sentiment, predict_topic
    d = reviews.select(*keep, F.col(text).alias("review"),
                       (T.clean_text(F.col(text)) if cleaned is None else F.col(cleaned)).alias("cleaned_content"))
    d = predict_sentiment(d, sentiment_model, "sentiment")
    d = predict_topic(d, topic_model, "cleaned_content")
    return d.select(*keep, "review", "sentiment", "topic_id", "topic_keywords",
                    T.aspects(F.col("review"), aspect_keywords).alias("aspects"))


def detect_issues(analyzed: DataFrame, top: int = 10) -> DataFrame:
    """Reviews per topic keyword string, top `top` (ties by keywords)."""
    from pyspark.sql import Window as W
    c = analyzed.groupBy(F.col("topic_keywords").alias("issue")).agg(F.count(F.lit(1)).alias("mentions"))
    c = c.withColumn("rank", F.row_number().over(W.orderBy(F.col("mentions").desc(), F.col("issue"))).cast("long"))
    return c.filter(F.col("rank") <= top)


def top_issues_from_reviews(reviews: DataFrame, sentiment_model, topic_model, top: int = 10, examples: int = 1,
                            text: str = "content", lang: str | None = "lang", labels: DataFrame | None = None,
                            valid: str | None = None, cleaned: str | None = None, sentiment: str | None = None) -> DataFrame:
    """Valid reviews -> sentiment -> negatives -> topic -> mentions, share of negatives, examples.

    `labels` (keywords, label) names the issue of a topic's keywords (F22): topics with one label are one
    issue. Without it the keywords are the issue. `valid`, `cleaned` and `sentiment` name columns that already hold
    the quality gate's verdict, the cleaned text and what `sentiment_model` makes of it."""
    from pyspark.sql import Window as W
    from vocspark.operators.ml import predict_sentiment, predict_topic
    from vocspark.operators.series import top_per_group
    from vocspark.session import written
    gate = T.is_valid_review(F.col(text), F.col(lang) if lang and lang in reviews.columns else None) if valid is None else F.col(valid)
    known = () if sentiment is None else (F.col(sentiment).alias("predicted_sentiment"),)
    d = reviews.filter(gate).select(F.col(text).alias("text"), (T.clean_text(F.col(text)) if cleaned is None else F.col(cleaned)).alias("cleaned_content"), *known)
    if sentiment is None:
        d = predict_sentiment(d, sentiment_model, "predicted_sentiment")
    d = d.filter(F.col("predicted_sentiment") == "negative")
    d = predict_topic(d, topic_model, "cleaned_content").withColumn("issue", F.col("topic_keywords"))
    if labels is not None:
        names = labels.select(F.col("keywords").alias("topic_keywords"), F.col("label").alias("_name"))
        d = d.join(F.broadcast(names), "topic_keywords", "left").withColumn("issue", F.coalesce("_name", F.lit(C.FALLBACK_LABEL)))  # a row for each topic
    d = written(d.select("issue", T.snippet(F.col("text")).alias("example")))  # read twice: the models run once
    c = d.groupBy("issue").agg(F.count(F.lit(1)).alias("mentions"))
    c = c.withColumn("pct", F.round(F.col("mentions") / F.sum("mentions").over(W.partitionBy()) * 100, 1))
    ex = top_per_group(d, "issue", [F.col("example").asc()], examples, "_r")
    ex = ex.groupBy("issue").agg(F.array_sort(F.collect_list(F.struct("_r", "example"))).alias("_e"))
    c = c.join(ex, "issue", "left").withColumn("examples", F.transform("_e", lambda s: s["example"])).drop("_e")
    c = c.withColumn("rank", F.row_number().over(W.orderBy(F.col("mentions").desc(), F.col("issue"))).cast("long"))
    return c.filter(F.col("rank") <= top)
