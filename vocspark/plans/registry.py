"""Named queries: (spark, sf_dir) -> DataFrame, one per implemented operator.

Each reads the driver tables through the fixture views, so its work grows
with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspark.plans import dashboard as D
from vocspark.plans import report as R
from vocspark.plans import evidence as EV
from vocspark.sources import fixtures as FX


def _q_monthly_rates(spark: SparkSession, sf: str) -> DataFrame:
    return FX.fx_timeseries(spark, sf)


def _q_topic_stats(spark: SparkSession, sf: str) -> DataFrame:
    return FX.fx_topics(spark, sf)


def _q_top_issues_3m(spark: SparkSession, sf: str) -> DataFrame:
    return D.top_issues(_topics(spark, sf), _ts(spark, sf), 3)


def _q_top_issues_all(spark: SparkSession, sf: str) -> DataFrame:
    return D.top_issues(_topics(spark, sf), _ts(spark, sf), 0)


AS_OF = FX.AS_OF


def _ts(spark, sf):
    return FX.timeseries_table(spark, sf)


def _topics(spark, sf):
    return FX.topics_table(spark, sf)


def _aspects(spark, sf):
    return FX.aspect_table(spark, sf)


def _docs(spark, sf):
    from vocspark.session import spread
    from vocspark.sources.tables import read_table
    return spread(read_table(spark, sf, "documents"))


def _text_scores(spark, sf):
    from vocspark.functions import text as T
    d = _docs(spark, sf)
    return d.select("doc_id",
                    T.severity("text", FX.FX_SEVERITY_5, FX.FX_SEVERITY_4, FX.FX_SEVERITY_3).alias("severity"),
                    T.actionability("text", FX.FX_SIGNAL, FX.FX_VENT).alias("actionability"))


def _valid_reviews(spark, sf):
    from vocspark.functions import text as T
    d = _docs(spark, sf)
    return d.select("doc_id", T.is_valid_review(F.col("text"), F.col("lang")).alias("is_valid"),
                    T.is_valid_review(F.col("text")).alias("is_valid_any_lang"))


def _clean_text(spark, sf):
    from vocspark.functions import text as T
    return _docs(spark, sf).select("doc_id", T.clean_text("text").alias("cleaned_content"))


def _value_weight(spark, sf):
    from vocspark.functions.value import value_weight
    r = FX.fx_reviews(spark, sf).select("reviewId", "user_tier", "clv")
    return value_weight(r).select("reviewId", "value_weight")


def _hash_tier(spark, sf):
    from vocspark.functions.value import hash_bucket, hash_tier
    d = _docs(spark, sf).select("doc_id")
    return d.select("doc_id", hash_bucket(F.col("doc_id")).alias("bucket"), hash_tier(F.col("doc_id")).alias("value_weight"))


def _cluster_keywords(spark, sf):
    from vocspark.operators.textops import cluster_keywords
    return cluster_keywords(_docs(spark, sf), "doc_id", "text")


def _keyword_titles(spark, sf):
    from vocspark.operators.textops import keyword_titles
    k = _cluster_keywords(spark, sf)
    return k.select("doc_id", "keywords", keyword_titles(F.col("keywords")).alias("t")).select("doc_id", "keywords", "t.*")


def _vec_centroids(spark, sf):
    from vocspark.operators.vectors import centroids
    return centroids(FX.fx_vectors(spark, sf), "category", "embedding")


def _semantic_classify(spark, sf):
    from vocspark.operators.vectors import classify
    v = FX.fx_vectors(spark, sf)
    c = _vec_centroids(spark, sf)
    out = classify(v, "embedding", c, "category", threshold=0.30, fallback="General App Feedback")
    return out.select("vec_id", "category", "best_label", F.round("confidence", 4).alias("confidence"), "predicted")


def _semantic_search(spark, sf):
    from vocspark.operators.vectors import semantic_search
    v = FX.fx_vectors(spark, sf)
    q = v.filter(F.col("vec_id") == 0).select("embedding").scalar()
    s = semantic_search(v, "embedding", q, "vec_id", 15)
    return s.select("rank", "vec_id", F.round("score", 6).alias("score"))


def _silhouette(spark, sf):
    from vocspark.operators.vectors import silhouette
    return silhouette(FX.fx_vectors(spark, sf), "category", "embedding")


def _drift(spark, sf):
    """Written once; the summary, the watch list and the bands read it."""
    from vocspark.operators.vectors import drift_pairs
    from vocspark.sources.derived import derived
    return derived(spark, sf, "semantic_drift", lambda: drift_pairs(FX.fx_semantic(spark, sf), "category", "month", "embedding", "text"))


def _drift_summary(spark, sf):
    from vocspark.operators.vectors import drift_summary
    return drift_summary(_drift(spark, sf), 0, cut=0.0)


def _shifting_terms(spark, sf):
    from vocspark.operators.textops import shifting_terms
    return shifting_terms(FX.fx_semantic(spark, sf), "category", "month", "text")


def _near_dup(spark, sf):
    from vocspark.operators.vectors import greedy_dedup
    from vocspark.functions import vectors as V
    v = FX.fx_vectors(spark, sf)
    c = _vec_centroids(spark, sf)
    j = v.join(F.broadcast(c.select("category", "centroid")), "category")
    j = j.withColumn("align", V.dot(V.normalize("embedding"), F.col("centroid")))
    return greedy_dedup(j, "category", [F.col("align").desc(), F.col("vec_id").asc()], "embedding", "vec_id",
                        keep=15, threshold=0.85, candidates=20)


def _classifier_metrics(spark, sf):
    from vocspark.operators.ml import classification_metrics
    return classification_metrics(_semantic_classify(spark, sf), "category", "predicted")


def _labeled_docs(spark, sf):
    """The labelled documents, cleaned; poor quality stands for negative."""
    from vocspark.sources.tables import read_table
    lab = read_table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "positive").otherwise("negative")
                                                 .alias("label"))
    return FX.cleaned_table(spark, sf).join(lab, "doc_id")


def _sentiment_data(spark, sf):
    """M4: split by a hash of the id, exactly 20 % of each class held out."""
    from vocspark.operators import ml as ML
    return ML.stratified_split(_labeled_docs(spark, sf), "doc_id", "label", 20, 42)


def _stratified_split(spark, sf):
    return _sentiment_data(spark, sf).select("doc_id", "label", "split")


def _sentiment_model(spark, sf):
    """M1-M4 + A25: held-out metrics of the shared TF-IDF + balanced logistic regression."""
    from vocspark.operators import ml as ML
    test = _sentiment_data(spark, sf).filter(F.col("split") == "test").select("cleaned_content", "label")
    pred = ML.predict_sentiment(test, _models(spark, sf)[0], "predicted")
    return ML.classification_metrics(pred, "label", "predicted")


def _topic_model(spark, sf):
    """M5-M7: the shared topic model, topic of greatest weight of every document."""
    from vocspark.operators import ml as ML
    return ML.predict_topic(FX.cleaned_table(spark, sf), _models(spark, sf)[1], "cleaned_content") \
        .select("doc_id", "topic_id", "topic_keywords")


def _topic_fit(spark, sf):
    """M6: the reconstruction error of the shared topic model, pass by pass."""
    errors = _models(spark, sf)[1].nmf.errors
    return spark.createDataFrame([(i, float(e)) for i, e in enumerate(errors)], "pass int, error double")


def _issue_centroids(spark, sf):
    """M9: the fixture taxonomy's centroids, from phrases."""
    from vocspark.operators.factor import phrase_centroids
    return phrase_centroids(_encoder(spark, sf), FX.FX_ISSUE_PHRASES)


def _topic_labels(spark, sf):
    """F22 + F24: each topic's keywords and the issue label nearest to them."""
    from vocspark.operators.factor import label_keywords
    from vocspark.operators.ml import topic_keywords
    return label_keywords(topic_keywords(_models(spark, sf)[1]), "keywords", _encoder(spark, sf), _issue_centroids(spark, sf))


def _encode_text(spark, sf):
    """M8: a unit vector of every document's text."""
    return _encoder(spark, sf).encode(_docs(spark, sf).select("doc_id", "text"), "text").select("doc_id", "embedding")


def _semantic_classify_text(spark, sf):
    """Every document's text against the phrase centroids."""
    from vocspark.operators.factor import classify_text
    out = classify_text(_docs(spark, sf).select("doc_id", "text"), "text", _encoder(spark, sf), _issue_centroids(spark, sf))
    return out.select("doc_id", "best_label", F.round("confidence", 4).alias("confidence"), "predicted")


def _text_centroid_metrics(spark, sf):
    """M8 + M9 + A25: nearest-centroid language of held-out documents, from their encoded text."""
    from vocspark.operators import ml as ML
    from vocspark.operators.vectors import centroids, classify
    from vocspark.session import cut_lineage
    docs = _docs(spark, sf).where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    split = ML.stratified_split(docs.select("doc_id", "lang"), "doc_id", "lang", 20, 42)
    x = cut_lineage(_encoder(spark, sf).encode(docs.drop("lang"), "text").drop("text").join(split, "doc_id"))
    c = centroids(x.filter(F.col("split") == "train"), "lang", "embedding")
    pred = classify(x.filter(F.col("split") == "test"), "embedding", c, "lang", threshold=-2.0)
    return ML.classification_metrics(pred, "lang", "predicted")


def _language_profiles(spark, sf):
    """the language profiles learned from the labelled documents."""
    from vocspark.operators.language import learn_profiles
    from vocspark.sources.derived import derived
    return derived(spark, sf, "language_profiles", lambda: learn_profiles(_docs(spark, sf)))


def _language_gate(spark, sf):
    """detected language of every document."""
    from vocspark.operators.language import detect_language
    docs = _docs(spark, sf)
    found = detect_language(docs, "doc_id", "text", _language_profiles(spark, sf))
    return docs.select("doc_id", "lang").join(found, "doc_id", "left").select(
        "doc_id", "lang", "detected", F.coalesce("score", F.lit(0)).cast("long").alias("score"))


def _valid_reviews_detected(spark, sf):
    """F4 + F10: the quality gate over documents that carry no language column."""
    from vocspark.plans.scoring import valid_reviews
    docs = _docs(spark, sf).select("doc_id", "text")
    return valid_reviews(docs, "text", profiles=_language_profiles(spark, sf)).select("doc_id", "is_valid")


def _lemma_map(spark, sf):
    """forms and their lemmas, learned from all documents."""
    from vocspark.operators.lemmas import learn_lemmas
    return learn_lemmas(_docs(spark, sf), "text")


def _lemmatised_text(spark, sf):
    """F1 + F2: cleaned documents, each form replaced by its learned lemma."""
    from vocspark.functions.text import clean_text
    from vocspark.operators.lemmas import lemmatise
    from vocspark.sources.derived import derived
    lemmas = derived(spark, sf, "lemmas", lambda: _lemma_map(spark, sf))
    docs = _docs(spark, sf).select("doc_id", clean_text("text", suffix_rules=False).alias("cleaned_content"))
    return lemmatise(docs, "doc_id", "cleaned_content", lemmas).select("doc_id", "lemmatised")


def _bootstrap(spark, sf):
    from vocspark.operators.ml import bootstrap_labels
    return bootstrap_labels(FX.classified_table(spark, sf), cap=300).select("review", "category")


def _label_coverage(spark, sf):
    from vocspark.operators.ml import bootstrap_labels, label_coverage
    from vocspark import config as C
    return label_coverage(bootstrap_labels(FX.classified_table(spark, sf), cap=None), C.TAXONOMY_LABELS)


def _triplets(spark, sf):
    from vocspark.operators.ml import bootstrap_labels, triplets
    lab = bootstrap_labels(FX.classified_table(spark, sf), cap=300)
    return triplets(lab, cap=500, seed=42)


def _eval_centroids(spark, sf):
    """Nearest-centroid classifier trained on an 80 % hash split, scored on the rest."""
    from vocspark.operators import ml as ML
    from vocspark.operators.vectors import centroids, classify
    v = ML.hash_split(FX.fx_vectors(spark, sf), "vec_id", 20, 42)
    c = centroids(v.filter(F.col("split") == "train"), "category", "embedding")
    pred = classify(v.filter(F.col("split") == "test"), "embedding", c, threshold=-2.0)
    return ML.classification_metrics(pred, "category", "predicted")


def _model_comparison(spark, sf):
    """Centroids of a class's plain mean vector (candidate) against its first training vector
    (baseline), on the held-out fifth."""
    from vocspark.operators import ml as ML
    from vocspark.operators.vectors import centroids, classify
    v = ML.hash_split(FX.fx_vectors(spark, sf), "vec_id", 20, 42)
    train, test = v.filter(F.col("split") == "train"), v.filter(F.col("split") == "test")
    first = train.groupBy("category").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    base = classify(test, "embedding", centroids(first, "category", "embedding"), threshold=-2.0)
    cand = classify(test, "embedding", centroids(train, "category", "embedding"), threshold=-2.0)
    both = base.select("vec_id", "category", F.col("predicted").alias("baseline")).join(
        cand.select("vec_id", F.col("predicted").alias("candidate")), "vec_id")
    return ML.compare_models(both, "vec_id", "category", "baseline", "candidate")


def _emerging(spark, sf):
    """Soft clusters of the low-confidence pool (documents whose best centroid cosine < 0.30),
    fitted once and written; the summary and the watch list read them."""
    from vocspark.operators import ml as ML
    from vocspark.operators.vectors import centroids, classify
    from vocspark.sources.derived import derived

    def build():
        cents = centroids(FX.fx_vectors(spark, sf), "category", "embedding")
        pool = classify(FX.fx_semantic(spark, sf), "embedding", cents).filter(F.col("confidence") < 0.30) \
            .join(FX.text_scores_table(spark, sf).select("doc_id", "actionability"), "doc_id")
        return ML.emerging_clusters(pool, "embedding", "text", "month", _labeler(spark, sf), actionable="actionability")

    return derived(spark, sf, "emerging_clusters", build)


def _labeler(spark, sf):
    """names a keyword string by the fixture taxonomy."""
    from vocspark.operators.factor import label_keywords
    return lambda df: label_keywords(df, "keywords", _encoder(spark, sf), _issue_centroids(spark, sf))


def _landing(spark, sf):
    """fx_events landed as files in the shared folder (once per input folder)."""
    from vocspark.session import checkpoint_dir
    from vocspark.sources.derived import _fingerprint
    from vocspark.streaming.feed import land_events
    ev = FX.fx_events(spark, sf).select("reviewId", "category", "at", "severity",
                                        F.col("props").alias("content"))
    base = f"{checkpoint_dir(spark).rstrip('/')}/vocspark-derived/{_fingerprint(spark, sf)}/landing_events"
    return land_events(spark, ev, base)


def _stream(kind):
    def q(spark, sf):
        from vocspark.streaming.feed import stream_table
        return stream_table(spark, _landing(spark, sf), kind)
    return q


def _stream_velocity(spark, sf):
    from vocspark.streaming.feed import stream_table, weekly_velocity
    return weekly_velocity(stream_table(spark, _landing(spark, sf), "weekly"))


def _stream_monthly(spark, sf):
    from vocspark.streaming.feed import monthly_rollup, stream_table
    return monthly_rollup(stream_table(spark, _landing(spark, sf), "monthly"))


def _score_parts(spark, sf):
    """E22 on the fixture reviews; the scored reviews are materialised once (like the
    reference's upload step) and every derived table is built from that file."""
    from vocspark.plans.scoring import score_reviews, tables_of_scored
    from vocspark.sources.derived import derived
    cents, texts = _vec_centroids(spark, sf), _scored_texts(spark, sf)
    scored = derived(spark, sf, "scored_reviews", lambda: score_reviews(FX.fx_review_rows(spark, sf), cents, texts=texts))
    return {"scored": scored, **tables_of_scored(scored, cents, FX.FX_ASPECT_KEYWORDS, as_of=AS_OF, emerging=False,
                                                 texts=texts, contents=_contents(spark, sf))}


def _scored_texts(spark, sf):
    """What the scores of reviews take from their texts, worked out and written once for each valid document.
    The texts themselves are read for their hash and aspects only: they are neither joined nor written."""
    from vocspark.functions import text as T
    from vocspark.plans.scoring import scored_texts, text_hash
    from vocspark.session import cut_lineage
    from vocspark.sources.derived import CONF_ENABLED, derived
    docs = _docs(spark, sf).select("doc_id", text_hash("text"), T.aspects(F.col("text"), FX.FX_ASPECT_KEYWORDS).alias("aspects"))
    texts = FX.with_vectors(spark, sf, docs).drop("category", "month")
    made = derived(spark, sf, "scored_texts", lambda: scored_texts(texts, FX.text_scores_table(spark, sf), _vec_centroids(spark, sf)))
    return made if spark.conf.get(CONF_ENABLED, "true").lower() == "true" else cut_lineage(made)  # its numbers must stay


def _contents(spark, sf):
    from vocspark.plans.scoring import contents_of
    return contents_of(_docs(spark, sf).select("doc_id", F.col("text").alias("content")))


def _score_emerging(spark, sf):
    """E22 + M14: emerging issues of the scored reviews; fitted once and written."""
    from vocspark.plans.scoring import emerging_of_scored
    from vocspark.sources.derived import derived
    return derived(spark, sf, "score_batch_emerging", lambda: emerging_of_scored(
        _score_parts(spark, sf)["scored"], labeler=_labeler(spark, sf), texts=_scored_texts(spark, sf), contents=_contents(spark, sf)))


def _ingested(spark, sf):
    """The fixture reviews land as files (without their texts and vectors, which the documents and
    embeddings bring) and are ingested in several epochs; a further call finds nothing new."""
    from vocspark.plans.scoring import classifications, score_reviews, tables_of_scored, with_contents, with_text
    from vocspark.session import checkpoint_dir
    from vocspark.sources.derived import _fingerprint, derived
    from vocspark.streaming.ingest import Ingest, review_stream
    rows = FX.fx_reviews(spark, sf).drop("content", "lang")
    derived(spark, sf, "landing_reviews", lambda: rows.repartition(4, "reviewId"))
    base = f"{checkpoint_dir(spark).rstrip('/')}/vocspark-derived/{_fingerprint(spark, sf)}"
    cents, texts, contents = _vec_centroids(spark, sf), _scored_texts(spark, sf), _contents(spark, sf)

    def score(reviews):
        return score_reviews(reviews, cents, texts=texts)

    def tables(scored):
        made = tables_of_scored(scored, cents, FX.FX_ASPECT_KEYWORDS, as_of=AS_OF, emerging=False, texts=texts, contents=contents)
        return {k: made[k] for k in ("topic_timeseries", "topic_analysis", "aspect_analysis", "classification_quality", "alerts")}

    ingest = Ingest(f"{base}/ingest", score, tables, views={
        "review_classifications": lambda scored: classifications(with_text(scored, with_contents(texts, contents)))})
    ingest.run(review_stream(spark, f"{base}/landing_reviews", rows.schema, max_files_per_trigger=2))
    return ingest


def _ingest_table(name):
    return lambda spark, sf: _ingested(spark, sf).table(spark, name)


def _sync_log(spark, sf):
    """The stored log of the ingest's runs, newest first, and whether a sync is due on the day after."""
    from vocspark.sources.tables import read_sync_log
    log = read_sync_log(spark, f"{_ingested(spark, sf).out}/log")
    return log.select("run", "last_sync", "last_sync_date", "status", "dataset")


def _score_uploaded(spark, sf):
    from vocspark.plans.scoring import uploaded_reviews
    return uploaded_reviews(FX.fx_reviews(spark, sf))


def _preprocess(spark, sf):
    from vocspark.plans.scoring import preprocess_training
    texts = _docs(spark, sf).select("doc_id", F.col("text").alias("content"))
    return preprocess_training(FX.fx_reviews(spark, sf).select("doc_id", "score"), texts=texts)


def _summary(n):
    def q(spark, sf):
        from vocspark.plans.summary import executive_summary
        return executive_summary(_topics(spark, sf), _aspects(spark, sf), _ts(spark, sf), n)
    return q


def _topic_rates_by_label(spark, sf):
    """Topics under shared labels; statistics of the severe reviews by label, else by topic."""
    from vocspark.operators.series import keyed_rates
    c = FX.classified_table(spark, sf).filter(F.col("date").isNotNull() & (F.col("date") != ""))
    label = F.col("category")
    for topic, name in FX.FX_TOPIC_LABELS.items():
        label = F.when(F.col("category") == topic, F.lit(name)).otherwise(label)
    mentions = c.groupBy(F.col("category").alias("topic_id"), label.alias("issue_label"), F.col("date").alias("month")).agg(
        F.count(F.lit(1)).alias("mentions"))
    stats = c.filter(F.col("severity") >= 4.5).groupBy("category", F.col("date").alias("month")).agg(
        F.sum("severity").alias("sev_sum"), F.sum(F.col("financial_impact").cast("decimal(18,2)")).alias("impact_sum"))
    return keyed_rates(mentions, stats)


def _summary_fields(spark, sf):
    """F32: the executive summary's text read back into fields."""
    from vocspark.plans.summary import summary_fields
    return summary_fields(_summary(0)(spark, sf))


def _display_texts(spark, sf):
    """F31 + F33 + F41: every document's text in the report's character set, and as a snippet with marks."""
    from vocspark.functions import text as T
    from vocspark.plans.summary import highlight
    return _docs(spark, sf).select("doc_id", T.ascii_normalise("text").alias("report_text"),
                                   highlight(T.snippet("text", 180), ["thou", "thing", "an"]).alias("marked"))


def _source_lists(spark, sf):
    """lists that arrive as text, here written from the documents' columns, read back."""
    from vocspark.functions import text as T
    written = F.concat(F.lit("['"), F.col("lang"), F.lit("', \""), F.col("source"), F.lit("\", '']"))
    return _docs(spark, sf).select("doc_id", T.parse_list_literal(written).alias("items"))


def _alert_texts(spark, sf):
    """the report's alerts in short sentences."""
    from vocspark.plans.summary import humanise_alert
    return R.report_alerts(_ts(spark, sf), 0).select("category", "rank", humanise_alert(F.col("message")).alias("text"))


def _significant_issues(spark, sf):
    """Issues of at least 2 % of the largest one's mentions, at most ten."""
    from vocspark.plans.summary import relative_cutoff
    return relative_cutoff(_topics(spark, sf).select("label", "mentions"), "mentions", "label")


def _drift_bands(spark, sf):
    """intensity and state of each category on the drift watch list."""
    from vocspark.plans.summary import drift_state
    d = _drift_watchlist(spark, sf).withColumn("b", drift_state(F.col("score")))
    return d.select("category", "score", F.round("b.intensity", 4).alias("intensity"), "b.state", "rank")


def _stability_band(spark, sf):
    """the stability index and its band, from the report's volatile months."""
    from vocspark.plans.summary import stability_index
    s = R.report_stability(_topics(spark, sf), _ts(spark, sf), 0).withColumn("b", stability_index(F.col("volatility_count")))
    return s.select("latest_month", "volatility_count", F.col("b.index").cast("long").alias("index"), "b.band")


def _drift_watchlist(spark, sf):
    from vocspark.plans.summary import drift_watchlist
    return drift_watchlist(_drift(spark, sf), 0)


def _emerging_watchlist(spark, sf):
    from vocspark.plans.summary import emerging_watchlist
    return emerging_watchlist(_emerging(spark, sf))


def _emerging_summary(spark, sf):
    from vocspark.operators.ml import emerging_summary
    return emerging_summary(_emerging(spark, sf))


def _trend_tags(spark, sf):
    from vocspark.plans.summary import trend_tags
    return trend_tags(D.trending(_ts(spark, sf), 0))


def _fitted(spark, sf, name, fit, load):
    """A model fitted once per input folder and persisted (M20) next to the derived tables; later
    queries load it, as the reference's service loads its trained models."""
    from vocspark.session import checkpoint_dir
    from vocspark.sources.derived import _done, _fingerprint
    path = f"{checkpoint_dir(spark).rstrip('/')}/vocspark-derived/{_fingerprint(spark, sf)}/models/{name}"
    if not _done(spark, path + "-complete"):
        fit(path)
        spark.range(1).write.mode("overwrite").parquet(path + "-complete")  # written last: a half-written model has no marker
    return load(path)


def _sentiment(spark, sf):
    """The sentiment model, fitted on the training split of the labelled documents."""
    from vocspark.operators import ml as ML

    def fit(path):
        train = _sentiment_data(spark, sf).filter(F.col("split") == "train")
        ML.save_model(ML.fit_sentiment(train, "cleaned_content", "label"), path)

    return _fitted(spark, sf, "sentiment", fit, ML.load_model)


def _judged(spark, sf):
    """(doc_id, cleaned_content, sentiment): the cleaned documents as the sentiment model sees them, written once. Of a
    predicted column that is not, Spark moves a filter below the prediction, where the model runs several times a row."""
    from vocspark.operators import ml as ML
    from vocspark.sources.derived import derived
    return derived(spark, sf, "judged_documents", lambda: ML.predict_sentiment(
        FX.cleaned_table(spark, sf).select("doc_id", "cleaned_content"), _sentiment(spark, sf), "sentiment"))


def _topic_nmf(spark, sf):
    """The topic model, fitted (as the reference does) on the documents taken for negative."""
    from vocspark.functions.text import STOP_WORDS
    from vocspark.operators import ml as ML

    def fit(path):
        negative = _judged(spark, sf).filter(F.col("sentiment") == "negative").select("cleaned_content")
        ML.fit_topics(negative, "cleaned_content", k=30, seed=42, stop_words=STOP_WORDS).save(path)

    return _fitted(spark, sf, "topics", fit, lambda path: ML.TopicModel.load(spark, path))


def _models(spark, sf):
    return _sentiment(spark, sf), _topic_nmf(spark, sf)


def _encoder(spark, sf):
    """M8: the text encoder, fitted on all documents."""
    from vocspark.operators.factor import Encoder, fit_encoder
    return _fitted(spark, sf, "encoder", lambda path: fit_encoder(_docs(spark, sf), "text").save(path),
                   lambda path: Encoder.load(spark, path))


def _detect_issues(spark, sf):
    from vocspark.plans.scoring import analyze, detect_issues
    sm, tm = _models(spark, sf)
    texts = _docs(spark, sf).select("doc_id", F.col("text").alias("content")).join(FX.cleaned_table(spark, sf), "doc_id")
    per_text = analyze(texts, sm, tm, FX.FX_ASPECT_KEYWORDS, keep=("doc_id",), cleaned="cleaned_content")  # each text once, then its reviews
    return detect_issues(FX.fx_reviews(spark, sf).select("doc_id").join(per_text.select("doc_id", "topic_keywords"), "doc_id"))


def _top_from_reviews(spark, sf):
    from vocspark.plans.scoring import top_issues_from_reviews
    sm, tm = _models(spark, sf)
    docs = _docs(spark, sf).select("doc_id", F.col("text").alias("content")).join(_judged(spark, sf), "doc_id") \
        .join(FX.text_scores_table(spark, sf).select("doc_id", "is_valid"), "doc_id")
    return top_issues_from_reviews(docs, sm, tm, labels=_topic_labels(spark, sf), valid="is_valid", cleaned="cleaned_content", sentiment="sentiment")


def _search_recent(spark, sf):
    """Semantic search over the reviews of the last 3 months (P1 + M11)."""
    from vocspark.operators.vectors import semantic_search
    from vocspark.operators.windows import period_split
    r = FX.fx_reviews_embedded(spark, sf)
    r = period_split(r, AS_OF, 3).filter(F.col("period") == "cur")
    q = FX.fx_vectors(spark, sf).filter(F.col("vec_id") == 0).select("embedding").scalar()
    s = semantic_search(r, "embedding", q, "reviewId", 15)
    return s.select("rank", "reviewId", F.col("content"), F.round("score", 6).alias("confidence"))


QUERIES = {
    "monthly_rates": _q_monthly_rates,
    "topic_stats": _q_topic_stats,
    "top_issues_3m": _q_top_issues_3m,
    "top_issues_all": _q_top_issues_all,
    "sentiment_distribution": lambda sp, sf: D.sentiment_distribution(FX.fx_reviews(sp, sf), AS_OF, 3),
    "kpis": lambda sp, sf: D.kpis(FX.fx_reviews(sp, sf), _ts(sp, sf), AS_OF, 3),
    "kpis_all": lambda sp, sf: D.kpis(FX.fx_reviews(sp, sf), _ts(sp, sf), AS_OF, 0),
    "aspects_3m": lambda sp, sf: D.aspects_map(_ts(sp, sf), _topics(sp, sf), 3),
    "aspect_mentions": lambda sp, sf: _aspects(sp, sf),
    "threshold_alerts": lambda sp, sf: D.threshold_alerts(_aspects(sp, sf), AS_OF),
    "trending_long": lambda sp, sf: D.trending(_ts(sp, sf), 0),
    "trending_3m": lambda sp, sf: D.trending(_ts(sp, sf), 3),
    "trending_6m_revenue": lambda sp, sf: D.trending(_ts(sp, sf), 6, "revenue"),
    "issue_correlation": lambda sp, sf: D.issue_correlation(_ts(sp, sf), 0, threshold=-1.0),
    "velocity_alerts": lambda sp, sf: D.velocity_alerts(_ts(sp, sf), 3),
    "intelligence_alerts": lambda sp, sf: D.intelligence_alerts(_ts(sp, sf), _aspects(sp, sf), 3),
    "sentiment_stability": lambda sp, sf: D.sentiment_stability(_ts(sp, sf), _topics(sp, sf), 0),
    "sentiment_stability_6m": lambda sp, sf: D.sentiment_stability(_ts(sp, sf), _topics(sp, sf), 6),
    "report_alerts": lambda sp, sf: R.report_alerts(_ts(sp, sf), 3),
    "report_alerts_all": lambda sp, sf: R.report_alerts(_ts(sp, sf), 0),
    "report_aspects": lambda sp, sf: R.report_aspects(_aspects(sp, sf), _ts(sp, sf), 3),
    "report_stability": lambda sp, sf: R.report_stability(_topics(sp, sf), _ts(sp, sf), 0),
    "report_movers": lambda sp, sf: R.report_movers(_ts(sp, sf), 12),
    "report_sentiment": lambda sp, sf: R.report_sentiment(FX.fx_reviews(sp, sf), AS_OF, 3),
    "report_kpis": lambda sp, sf: R.report_kpis(FX.fx_reviews(sp, sf), _ts(sp, sf), AS_OF, 3),
    "report_top_issues": lambda sp, sf: R.report_top_issues(_topics(sp, sf), _ts(sp, sf), 3),
    "text_scores": _text_scores,
    "valid_reviews": _valid_reviews,
    "clean_text": _clean_text,
    "value_weight": _value_weight,
    "hash_tier": _hash_tier,
    "cluster_keywords": _cluster_keywords,
    "keyword_titles": _keyword_titles,
    "category_centroids": lambda sp, sf: _vec_centroids(sp, sf).select(
        "category", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"), "n"),
    "semantic_classify": _semantic_classify,
    "semantic_search": _semantic_search,
    "semantic_search_recent": _search_recent,
    "silhouette": _silhouette,
    "semantic_drift": _drift,
    "semantic_drift_summary": _drift_summary,
    "shifting_terms": _shifting_terms,
    "near_dup_evidence": _near_dup,
    "issue_reviews_3m": lambda sp, sf: EV.issue_reviews(FX.classified_table(sp, sf), "UI & Navigation", 3,
                                                        topics=_topics(sp, sf)),
    "issue_reviews_all": lambda sp, sf: EV.issue_reviews(FX.classified_table(sp, sf), "Customer Support", 0),
    "diagnostic_evidence": lambda sp, sf: EV.diagnostic_evidence(FX.classified_table(sp, sf), month="2000",
                                                                 topic="login|billing"),
    "diagnostic_evidence_aspect": lambda sp, sf: EV.diagnostic_evidence(FX.classified_table(sp, sf), month="2001-0",
                                                                        aspect="Performance/Technical"),
    "live_ticker": lambda sp, sf: EV.live_ticker(FX.fx_reviews(sp, sf)),
    "reviews_head": lambda sp, sf: EV.reviews_head(FX.fx_reviews(sp, sf)),
    "export_projection": lambda sp, sf: EV.export_projection(FX.fx_reviews(sp, sf), AS_OF, 3),
    "classifier_metrics": _classifier_metrics,
    "sentiment_model": _sentiment_model,
    "stratified_split": _stratified_split,
    "topic_model": _topic_model,
    "topic_fit": _topic_fit,
    "topic_labels": _topic_labels,
    "encode_text": _encode_text,
    "taxonomy_centroids": _issue_centroids,
    "semantic_classify_text": _semantic_classify_text,
    "text_centroid_metrics": _text_centroid_metrics,
    "language_profiles": _language_profiles,
    "language_gate": _language_gate,
    "valid_reviews_detected": _valid_reviews_detected,
    "lemma_map": _lemma_map,
    "lemmatised_text": _lemmatised_text,
    "bootstrap_labels": _bootstrap,
    "label_coverage": _label_coverage,
    "triplets": _triplets,
    "eval_centroids": _eval_centroids,
    "model_comparison": _model_comparison,
    "emerging_clusters": _emerging,
    "stream_daily_counts": _stream("daily"),
    "stream_weekly_counts": _stream("weekly"),
    "stream_ticker": _stream("ticker"),
    "stream_monthly_rollup": _stream_monthly,
    "stream_weekly_velocity": _stream_velocity,
    "score_batch_timeseries": lambda sp, sf: _score_parts(sp, sf)["topic_timeseries"],
    "score_batch_classifications": lambda sp, sf: _score_parts(sp, sf)["review_classifications"],
    "score_batch_topics": lambda sp, sf: _score_parts(sp, sf)["topic_analysis"],
    "score_batch_aspects": lambda sp, sf: _score_parts(sp, sf)["aspect_analysis"],
    "score_batch_drift": lambda sp, sf: _score_parts(sp, sf)["semantic_drift"],
    "score_batch_quality": lambda sp, sf: _score_parts(sp, sf)["classification_quality"],
    "score_batch_alerts": lambda sp, sf: _score_parts(sp, sf)["alerts"],
    "score_batch_uploaded": _score_uploaded,
    "score_batch_emerging": _score_emerging,
    "ingest_timeseries": _ingest_table("topic_timeseries"),
    "ingest_classifications": _ingest_table("review_classifications"),
    "ingest_topics": _ingest_table("topic_analysis"),
    "ingest_aspects": _ingest_table("aspect_analysis"),
    "ingest_quality": _ingest_table("classification_quality"),
    "ingest_alerts": _ingest_table("alerts"),
    "ingest_sync_log": _sync_log,
    "preprocess_training": _preprocess,
    "executive_summary": _summary(0),
    "executive_summary_6m": _summary(6),
    "topic_rates_by_label": _topic_rates_by_label,
    "summary_fields": _summary_fields,
    "display_texts": _display_texts,
    "source_lists": _source_lists,
    "alert_texts": _alert_texts,
    "significant_issues": _significant_issues,
    "drift_bands": _drift_bands,
    "stability_band": _stability_band,
    "drift_watchlist": _drift_watchlist,
    "emerging_watchlist": _emerging_watchlist,
    "emerging_issues": _emerging_summary,
    "trend_tags": _trend_tags,
    "detect_issues": _detect_issues,
    "top_issues_from_reviews": _top_from_reviews,
}
