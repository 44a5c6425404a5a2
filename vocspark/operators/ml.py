"""Model operators on MLlib.

Fitting runs as distributed MLlib jobs; the only driver-side values are model
parameters (coefficients, vocabulary, k centroids), whose size is bounded by
the feature / vocabulary / cluster counts, never by the number of rows.

Topics and emerging clusters are non-negative matrix factorisations
(`operators.factor`), whose row side stays distributed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, IndexToString, NGram, Normalizer, RegexTokenizer,
                                SQLTransformer, StopWordsRemover, StringIndexer)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocspark import config as C
from vocspark.operators.factor import Nmf, fit_nmf, load_matrix, save_matrix, vocabulary
from vocspark.session import cut_and_spread, cut_lineage, spread, written

# scikit-learn's default token pattern: words of two or more word characters
TOKEN_PATTERN = r"\b\w\w+\b"


def hash_split(df: DataFrame, key: str, test_pct: int = 20, seed: int = 42, col: str = "split") -> DataFrame:
    """M4: deterministic train/test split by md5(seed || key) — independent of partitioning."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.withColumn(col, F.when(F.pmod(h, F.lit(100)) < test_pct, F.lit("test")).otherwise(F.lit("train")))


def _hash32(key: Column, seed: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long")


def stratified_split(df: DataFrame, key: str, label: str, test_pct: int = 20, seed: int = 42, col: str = "split",
                     buckets: int = 4096) -> DataFrame:
    """M4: a split that takes exactly round(test_pct %) of each class into the test set: its rows with
    the smallest md5(seed || key), ties by key.

    No class is sorted: counts of (class, hash bucket) tell in which bucket a class's cut falls, the
    buckets below are test rows, and only the rows of that one bucket are ranked (1 / buckets of a class)."""
    h = _hash32(F.col(key), seed)
    width = (1 << 32) // buckets
    rows = df.withColumn("_h", h).withColumn("_b", F.floor(h / width).cast("long"))
    counts = rows.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))  # classes x buckets rows at most
    w = W.partitionBy(label).orderBy("_b")
    counts = counts.withColumn("_upto", F.sum("_n").over(w)) \
        .withColumn("_want", F.round(F.sum("_n").over(W.partitionBy(label)) * test_pct / 100).cast("long"))
    cut = counts.where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")) | (F.col("_want") == 0)) \
        .groupBy(F.col(label).alias("_label")) \
        .agg(F.min("_b").alias("_cut"), F.min_by(F.col("_want") - (F.col("_upto") - F.col("_n")), "_b").alias("_rest"))
    placed = rows.join(cut, F.col(label).eqNullSafe(F.col("_label")))  # a row for each class
    off = placed.where(F.col("_b") != F.col("_cut")).withColumn("_test", F.col("_b") < F.col("_cut"))
    rank = F.row_number().over(W.partitionBy(label).orderBy("_h", key))
    edge = placed.where(F.col("_b") == F.col("_cut")).withColumn("_test", rank <= F.col("_rest"))
    return off.unionByName(edge).select(*df.columns, F.when(F.col("_test"), F.lit("test")).otherwise(F.lit("train")).alias(col))


def fit_tfidf(df: DataFrame, text: str, max_features: int = 10000, ngram: int = 2, min_df: float = 1.0,
              max_df: float = 1.0, stop_words=None, out: str = "features") -> PipelineModel:
    """M1 / M5: word 1..n-grams -> top `max_features` terms -> smoothed IDF + 1 -> L2 normalise.

    Terms in fewer than min_df texts (a count, or a share below 1) or in more than max_df of them are left
    out; of the rest the most frequent are kept, ties by term. The vocabulary and the weights
    (1 + ln((1 + n) / (1 + df))) come from two aggregations; the driver gets max_features rows."""
    stages = [RegexTokenizer(inputCol=text, outputCol="_tok", pattern=TOKEN_PATTERN, gaps=False, toLowercase=True)]
    src = "_tok"
    if stop_words:
        stages.append(StopWordsRemover(inputCol="_tok", outputCol="_tok_sw", stopWords=list(stop_words)))
        src = "_tok_sw"
    cols = [src]
    for n in range(2, ngram + 1):
        stages.append(NGram(n=n, inputCol=src, outputCol=f"_ng{n}"))
        cols.append(f"_ng{n}")
    stages.append(SQLTransformer(statement=f"SELECT *, concat({', '.join(cols)}) AS _terms FROM __THIS__"))
    terms = PipelineModel(stages=stages).transform(df).select("_terms")
    n = df.count()
    least, most = (min_df if min_df >= 1 else min_df * n), max_df * n
    # one aggregate: the texts are taken apart once, and a term is shuffled once a task; places after a text's terms hold its distinct ones
    met = terms.select(F.size("_terms").alias("n"), F.posexplode(F.concat("_terms", F.array_distinct("_terms"))).alias("at", "term"))
    counts = met.groupBy("term").agg(F.count_if(F.col("at") < F.col("n")).alias("times"), F.count_if(F.col("at") >= F.col("n")).alias("texts"))
    kept = (counts.where((F.col("texts") >= least) & (F.col("texts") <= most))
            .orderBy(F.col("times").desc(), "term").limit(max_features).select("term", "texts").collect())
    if not kept:
        raise ValueError("no term is in enough texts")
    weights = Vectors.dense([math.log((1 + n) / (1 + r["texts"])) + 1.0 for r in kept])
    return PipelineModel(stages=stages + [
        CountVectorizerModel.from_vocabulary([r["term"] for r in kept], inputCol="_terms", outputCol="_tf"),
        ElementwiseProduct(scalingVec=weights, inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol=out, p=2.0)])


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (k * n_class) per row; the class-count table is bounded by #classes."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    k = counts.select(F.count(F.lit(1))).scalar()
    n = counts.select(F.sum("_nc")).scalar()
    return df.join(F.broadcast(counts), label).withColumn(out, (n / (k * F.col("_nc"))).cast("double")).drop("_nc")


def fit_sentiment(train: DataFrame, text: str = "text", label: str = "label", max_features: int = 10000,
                  max_iter: int = 1000, tol: float = 1e-4) -> PipelineModel:
    """M2: TF-IDF + logistic regression with balanced class weights.

    regParam = 1 / n matches an inverse-regularisation C = 1 on the summed loss;
    features are already L2-normalised so standardization is off.
    """
    labelled = cut_and_spread(train.select(F.col(text).alias(text), F.col(label).cast("string").alias(label)))
    prep = fit_tfidf(labelled, text, max_features)
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(labelled)
    # written once: the fit iterates over the features, not over the texts
    x = written(index.transform(prep.transform(balanced_weights(labelled, label))).select("_y", "weight", "features"))
    n = x.count()
    fitted = LogisticRegression(featuresCol="features", labelCol="_y", weightCol="weight", regParam=1.0 / max(n, 1),
                                elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol).fit(x)
    return PipelineModel(stages=prep.stages + [fitted, IndexToString(
        inputCol="prediction", outputCol="predicted_label", labels=index.labels)])


def predict_sentiment(df: DataFrame, model: PipelineModel, out: str = "sentiment") -> DataFrame:
    """M3: apply the fitted pipeline; keep the input columns plus the predicted label."""
    cols = df.columns
    return model.transform(df).select(*cols, F.col("predicted_label").alias(out))


def classification_metrics(df: DataFrame, y_true: str, y_pred: str, digits: int = 4) -> DataFrame:
    """Per-class precision / recall / f1 / support plus accuracy, macro and weighted averages.

    Classes are the union of true and predicted labels; everything after the
    first group-by runs on #classes^2 rows.
    """
    conf = df.groupBy(F.col(y_true).cast("string").alias("t"), F.col(y_pred).cast("string").alias("p")) \
             .agg(F.count(F.lit(1)).alias("c"))
    per_t = conf.groupBy(F.col("t").alias("label")).agg(F.sum("c").alias("support"),
                                                         F.sum(F.when(F.col("t") == F.col("p"), F.col("c"))).alias("tp"))
    per_p = conf.groupBy(F.col("p").alias("label")).agg(F.sum("c").alias("predicted"))
    j = per_t.join(per_p, "label", "full").select(
        "label", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("predicted", F.lit(0)).alias("predicted"))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    j = j.withColumn("precision", prec).withColumn("recall", rec)
    j = j.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                  2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                     .otherwise(F.lit(0.0)))
    tot = j.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("k"),
                F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    r = F.lit(None).cast("double")
    summary = tot.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), r.alias("precision"), r.alias("recall"),
                 (F.col("tp") / F.col("n")).alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1"), F.col("n").alias("support")))).alias("s")).select("s.*")
    per = j.select("label", "precision", "recall", "f1", "support")
    out = per.unionByName(summary)
    return out.select("label", F.round("precision", digits).alias("precision"), F.round("recall", digits).alias("recall"),
                      F.round("f1", digits).alias("f1"), F.col("support").cast("long").alias("support"))


#: Cumulative probabilities of a Poisson(1) draw of 0, 1, ... (the weight of a row in a bootstrap round).
POISSON_1 = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]


def compare_models(df: DataFrame, key: str, y_true: str, baseline: str, candidate: str, rounds: int = 100,
                   seed: int = 42, digits: int = 4) -> DataFrame:
    """Accuracy of two models on the same rows, their difference, and its bootstrap interval (2.5 and
    97.5 %). Output: one row (n, baseline, candidate, delta, delta_low, delta_high, better, worse).

    Rows that both models get right or both get wrong add only to the denominator. A round weighs each
    row by a Poisson(1) draw from a hash of seed, round and key, the same on any layout; rounds x rows
    draws are added up inside the tasks, and `rounds` rows leave them."""
    right = [(F.col(y_true) == F.col(c)).cast("int") for c in (baseline, candidate)]
    rows = df.select(F.col(key).cast("string").alias("k"), F.coalesce(right[0], F.lit(0)).alias("a"), F.coalesce(right[1], F.lit(0)).alias("b"))
    draws = rows.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    u = _hash32(F.concat_ws(":", F.col("round").cast("string"), "k"), seed) / F.lit(2.0 ** 32)
    weight = sum((F.when(u >= F.lit(p), 1).otherwise(0) for p in POISSON_1), F.lit(0))
    draws = draws.withColumn("w", weight)
    per = draws.groupBy("round").agg(F.sum(F.col("w") * (F.col("b") - F.col("a"))).alias("s"), F.sum("w").alias("n"))
    deltas = per.where("n > 0").select((F.col("s") / F.col("n")).alias("d"))  # a row for each round
    spread_ = deltas.agg(F.sort_array(F.collect_list("d")).alias("d"))
    at = lambda share: F.element_at("d", F.greatest(F.ceil(F.size("d") * share), F.lit(1)).cast("int"))
    bounds = spread_.select(F.round(at(0.025), digits).alias("delta_low"), F.round(at(0.975), digits).alias("delta_high"))
    n, a, b = F.count(F.lit(1)), F.sum("a"), F.sum("b")
    whole = rows.agg(n.alias("n"), F.round(a / F.greatest(n, F.lit(1)), digits).alias("baseline"), F.round(b / F.greatest(n, F.lit(1)), digits).alias("candidate"),
                     F.round((b - a) / F.greatest(n, F.lit(1)), digits).alias("delta"),
                     F.count_if(F.col("b") > F.col("a")).alias("better"), F.count_if(F.col("b") < F.col("a")).alias("worse"))
    return whole.withColumn("delta_low", bounds.select("delta_low").scalar()).withColumn("delta_high", bounds.select("delta_high").scalar())


# ---------------------------------------------------------------------------
# Topics (M5–M7)
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class TopicModel:
    """M5 + M6: the fitted TF-IDF and the non-negative components (k x vocabulary)."""

    prep: PipelineModel
    nmf: Nmf

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.prep.write().overwrite().save(f"{path}/prep")
        save_matrix(spark, self.nmf.components, f"{path}/components")
        spark.createDataFrame([(i, e) for i, e in enumerate(self.nmf.errors)], "pass int, error double") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/errors")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TopicModel":
        errors = tuple(r["error"] for r in spark.read.parquet(f"{path}/errors").orderBy("pass").collect())
        return TopicModel(PipelineModel.load(f"{path}/prep"), Nmf(load_matrix(spark, f"{path}/components"), errors))


def fit_topics(df: DataFrame, text: str = "text", k: int = 30, max_iter: int = 30, seed: int = 42,
               max_features: int = 1 << 18, stop_words=None) -> TopicModel:
    """M5 + M6: TF-IDF of the words (min_df 2, max_df 0.95), then an NMF with k components.

    The reference bounds its vocabulary by min_df alone; here `max_features` (MLlib's default) also
    bounds what the driver and every task hold: max_features x k numbers."""
    texts = written(spread(df.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))))
    prep = fit_tfidf(texts, "_text", max_features, ngram=1, min_df=2.0, max_df=0.95, stop_words=stop_words)
    x = written(prep.transform(texts).select("features"))  # every pass reads it
    return TopicModel(prep, fit_nmf(x, len(vocabulary(prep)), k, max_iter, seed=seed))


def topic_keywords(model: TopicModel, n_words: int = 5) -> DataFrame:
    """topic_id, keywords ('w1, w2, ...': the heaviest terms of each topic). Bounded by k x n_words."""
    words = vocabulary(model.prep)
    rows = [(i, ", ".join(words[j] for j in (-h).argsort(kind="stable")[:n_words])) for i, h in enumerate(model.nmf.components)]
    return SparkSession.active().createDataFrame(rows, "topic_id int, keywords string")


def predict_topic(df: DataFrame, model: TopicModel, text: str = "text") -> DataFrame:
    """M7: the topic of greatest weight of each row (ties and texts without known words: the first)
    -> topic_id, topic_keywords."""
    from vocspark.functions import vectors as V
    cols = df.columns
    x = model.prep.transform(df.select(*cols, F.coalesce(F.col(text), F.lit("")).alias("_text")))
    w = model.nmf.weights(x.select(*cols, "features"), "features", "_w")
    t = w.withColumn("_best", V.argmax(F.col("_w"))).select(*cols, (-F.col("_best.ni")).cast("int").alias("topic_id"))
    return t.join(F.broadcast(topic_keywords(model)), "topic_id", "left").withColumnRenamed("keywords", "topic_keywords")  # k rows


# ---------------------------------------------------------------------------
# Labels for encoder tuning
# ---------------------------------------------------------------------------

def bootstrap_labels(classified: DataFrame, text: str = "text", label: str = "category", conf: str = "confidence",
                     min_conf: float = 0.0, cap: int | None = 300, fallback: str = C.FALLBACK_LABEL,
                     seed: int = 42) -> DataFrame:
    """M17 (P19 + W13): confident, non-fallback rows; top `cap` per class by confidence
    (a documented training bound; None keeps all), shuffled by a seeded hash. Output: review, category, shuffle_key."""
    c = F.col(conf).try_cast("double")
    d = classified.filter(c.isNotNull() & (c >= min_conf) & (F.col(label) != fallback) &
                          F.col(text).isNotNull() & (F.trim(F.col(text)) != ""))
    if cap is not None:
        w = W.partitionBy(label).orderBy(c.desc(), F.col(text).asc())
        d = d.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= cap)
    key = F.md5(F.concat(F.lit(str(seed)), F.col(text)))
    return d.select(F.col(text).alias("review"), F.col(label).alias("category"), key.alias("shuffle_key"))


def label_coverage(labels: DataFrame, taxonomy, label: str = "category") -> DataFrame:
    """Rows per taxonomy class, zeros included (taxonomy is config, a few dozen rows)."""
    spark = labels.sparkSession
    tax = spark.createDataFrame([(t,) for t in taxonomy], f"{label} string")
    cnt = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(tax).join(cnt, label, "left").select(label, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ranked_places(df: DataFrame, group: str, order_hash: str, tie: str, blocks_hex: int = 3, seed: int = 42) -> DataFrame:
    """df with rk (0, 1, ... within the group, by a hex hash and a tie-breaker), sz (the group's rows), start
    (rows of the groups before, in the order of the groups' hashes) and total.

    Gapless, without a whole group in one window: rows are ranked within (group, first hex digits of the
    hash) only, and counts of these blocks (groups x 16 ** blocks_hex rows at most) give the offsets."""
    rows = df.withColumn("_block", F.substring(order_hash, 1, blocks_hex))
    counts = rows.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(group).orderBy("_block")
    counts = counts.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).withColumn("sz", F.sum("_n").over(W.partitionBy(group)))
    groups = counts.select(group, "sz").distinct()  # a row for each group
    groups = groups.withColumn("start", F.sum("sz").over(W.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(group))), group)) - F.col("sz")) \
        .withColumn("total", F.sum("sz").over(W.partitionBy()))
    offsets = counts.drop("_n", "sz").join(groups, group)
    inside = F.row_number().over(W.partitionBy(group, "_block").orderBy(order_hash, tie)) - 1
    return rows.withColumn("_inside", inside).join(offsets, [group, "_block"]) \
        .withColumn("rk", F.col("_before") + F.col("_inside")).drop("_block", "_before", "_inside")


def triplets(labels: DataFrame, text: str = "review", label: str = "category", cap: int = 500, seed: int = 42,
             eval_pct: int = 10) -> DataFrame:
    """(anchor, positive, negative, category, split) by seeded hash ranks — equi-joins only.

    Rows have a rank within their class by md5(seed || text), and a place among all rows, class after
    class. The positive of rank r is rank r + 1 of the same class (cyclic). The negative is drawn, by a
    hash of the anchor, evenly from all rows of all other classes: a number below total - size, moved
    past the anchor's own class. Classes with one row give no positive. The first `cap` anchors of each
    class by hash are kept (the reference's training bound) and split eval / train by another hash."""
    rows = labels.select(F.col(text).alias("t"), F.col(label).alias("c"), F.md5(F.concat(F.lit(str(seed)), F.col(text))).alias("h"))
    r = cut_lineage(ranked_places(rows, "c", "h", "t", seed=seed).drop("h"))  # read three times below
    a = r.filter((F.col("sz") > 1) & (F.col("rk") < cap) & (F.col("total") > F.col("sz")))
    draw = F.pmod(_hash32(F.col("t"), seed + 2), F.col("total") - F.col("sz"))
    a = a.withColumn("_d", draw).select(
        F.col("t").alias("anchor"), F.col("c").alias("category"),
        (F.col("start") + F.pmod(F.col("rk") + 1, F.col("sz"))).alias("_pos"),
        F.when(F.col("_d") < F.col("start"), F.col("_d")).otherwise(F.col("_d") + F.col("sz")).alias("_neg"))
    places = r.select((F.col("start") + F.col("rk")).alias("_place"), "t")
    x = a.join(places.withColumnRenamed("t", "positive"), F.col("_pos") == F.col("_place")).drop("_place")
    x = x.join(places.withColumnRenamed("t", "negative"), F.col("_neg") == F.col("_place"))
    eval_ = F.pmod(_hash32(F.col("anchor"), seed + 1), F.lit(100)) < eval_pct
    return x.select("anchor", "positive", "negative", "category", F.when(eval_, "eval").otherwise("train").alias("split"))


# ---------------------------------------------------------------------------
# Emerging clusters
# ---------------------------------------------------------------------------

EMERGING_SCHEMA = ("cluster_id int, label string, keywords string, estimated_volume long, is_flagged boolean, "
                   "momentum_pct double, sample_review_1 string, sample_review_2 string, sample_review_3 string")


def soft_clusters(pool: DataFrame, vec: str, keep: tuple[str, ...], k: int = 8, max_iter: int = 100, seed: int = 42,
                  weight: str | None = None) -> DataFrame | None:
    """The columns `keep` and `memberships` (ARRAY<DOUBLE>, one for each cluster) of each row: its
    weights in an NMF of the unit vectors, shifted to be non-negative. A row may belong to several
    clusters, and stands for `weight` rows (default 1). At most k clusters, one for ten rows; None if
    that makes fewer than two."""
    from vocspark.functions import vectors as V
    n_rows = (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("_rows")
    rows = spread(written(pool.select(*keep, n_rows, V.normalize(vec).alias("_unit"))))  # the plan of the pool runs once
    low, n, dims = rows.agg(F.min(F.array_min("_unit")), F.coalesce(F.sum("_rows"), F.lit(0)), F.max(F.size("_unit"))).first()
    k = min(k, n // 10)
    if k < 2:
        return None
    features = F.transform("_unit", lambda v: v - F.lit(low)).alias("_features")
    model = fit_nmf(cut_lineage(rows.select(features, "_rows")), dims, k, max_iter, seed=seed)  # every pass reads it: no texts in it
    return written(model.weights(rows.select(*keep, features), "_features", "memberships"))


def emerging_clusters(pool: DataFrame, vec: str, text: str, month: str, labeler=None,
                      k: int = 8, min_size: int = 20, flag_size: int = 15, membership: float = 0.10,
                      seed: int = 42, actionable: str | None = None, min_actionable: float = 0.3,
                      min_pool: int = 15, months: DataFrame | None = None, key: str | None = None,
                      weight: str | None = None, bodies: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Soft clusters of the low-confidence pool, those of >= min_size members.

    A row is a member of every cluster in which it weighs more than `membership`. Momentum compares the
    last two months present in the pool; keywords are the top words of the 10 heaviest rows of a cluster
    (A21); samples are the 3 heaviest texts, cut to 120 for display. `labeler` maps a frame with
    `keywords` to one with `label` (F22). `actionable` names an actionability column: if at least
    `min_pool` rows reach `min_actionable`, only those are clustered (P18). Output: emerging_issues schema.

    Where many reviews share a text, the pool holds each text once (`key`, `weight`: its number of reviews)
    and `months` (key, month, weight) says when they came; all counts are of reviews. With `bodies` the pool
    holds no texts: from a frame with `key` it makes one of (key, text), and is asked for the rows alone that weigh
    as much as a cluster's tenth or more."""
    from vocspark.operators.series import top_per_group
    from vocspark.operators.textops import cluster_keywords
    if k < 2:
        raise ValueError("k must be at least 2")
    if actionable is not None:
        strong = pool.filter(F.col(actionable) >= min_actionable)
        if strong.agg(F.coalesce(F.count(F.lit(1)) if weight is None else F.sum(weight), F.lit(0))).first()[0] >= min_pool:
            pool = strong
    own = (F.col(month).alias("_month"),) if months is None else (F.col(key).alias("_key"),)
    n_rows = (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("_n")
    body = (F.col(text).alias("_text"),) if bodies is None else ()
    soft = soft_clusters(pool.select(vec, *body, n_rows, *own), vec,
                         (*(("_text",) if body else ()), "_n", "_month" if months is None else "_key"), k, seed=seed, weight="_n")
    if soft is None:
        return pool.sparkSession.createDataFrame([], EMERGING_SCHEMA)
    # (cluster, month) counts of members
    member = F.explode(F.filter(F.transform("memberships", lambda w, i: F.when(w > membership, i)), lambda i: i.isNotNull()))
    if months is None:
        dated = soft.select("_month", "_n", "memberships")
    else:
        dated = soft.select("_key", "memberships").join(months.select(F.col(key).alias("_key"), F.col(month).alias("_month"), F.col(weight).alias("_n")), "_key")
    present = dated.select("_month").distinct().withColumn("_mr", F.row_number().over(W.orderBy(F.col("_month").desc())))
    counts = dated.select("_month", "_n", member.alias("cluster_id")).groupBy("cluster_id", "_month").agg(F.sum("_n").alias("_n"))
    nth = lambda r: F.coalesce(F.sum(F.when(F.col("_mr") == r, F.col("_n"))), F.lit(0))
    sizes = counts.join(present.where(F.col("_mr") <= 2), "_month", "left").groupBy("cluster_id").agg(
        F.sum("_n").alias("estimated_volume"), nth(1).alias("cv"), nth(2).alias("pv"))
    n_months = present.select(F.count(F.lit(1))).scalar()
    mom = F.when(n_months > 1, F.round((F.col("cv") - F.col("pv")) / F.greatest(F.col("pv"), F.lit(1)) * 100, 1)).otherwise(F.lit(0.0))
    sizes = sizes.withColumn("momentum_pct", mom.cast("double")).filter(F.col("estimated_volume") >= min_size)
    each = soft.select("_text" if bodies is None else "_key", "_n", F.posexplode("memberships").alias("cluster_id", "_w"))
    if bodies is not None:
        first = F.rank().over(W.partitionBy("cluster_id").orderBy(F.col("_w").desc()))  # rows of one weight are told apart by their texts
        each = written(each.withColumn("_r", first).where(F.col("_r") <= 10).drop("_r"))
        each = each.join(bodies(each.select(F.col("_key").alias(key))).select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_key").drop("_key")
    heaviest = [F.col("_w").desc(), F.col("_text").asc()]
    near = top_per_group(each, "cluster_id", heaviest, 10, "_r")  # the 10 heaviest rows have the 10 heaviest texts
    near = near.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(10)).cast("int"))))
    near = top_per_group(near.drop("_r", "_copy", "_n"), "cluster_id", heaviest, 10, "_r")
    kw = cluster_keywords(near, "cluster_id", "_text")
    samp = near.filter(F.col("_r") <= 3).groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("_r", F.substring("_text", 1, 120).alias("s")))).alias("_s"))
    out = sizes.join(kw, "cluster_id", "left").join(samp, "cluster_id", "left").withColumn("keywords", F.coalesce("keywords", F.lit("")))
    out = labeler(out) if labeler else out.withColumn("label", F.concat(F.lit("Cluster #"), (F.col("cluster_id") + 1).cast("string")))
    s = F.col("_s")
    return out.select(
        F.col("cluster_id").cast("int"), "label", "keywords", F.col("estimated_volume").cast("long"),
        ((F.col("estimated_volume") >= flag_size) | (F.col("momentum_pct") > 50)).alias("is_flagged"),
        "momentum_pct",
        F.coalesce(F.try_element_at(s, F.lit(1))["s"], F.lit("")).alias("sample_review_1"),
        F.coalesce(F.try_element_at(s, F.lit(2))["s"], F.lit("")).alias("sample_review_2"),
        F.coalesce(F.try_element_at(s, F.lit(3))["s"], F.lit("")).alias("sample_review_3"))


def emerging_summary(em: DataFrame, top: int | None = None) -> DataFrame:
    """Flagged clusters by volume; ' (Proto)' stripped; samples > 10 chars cut to 180."""
    f = em.filter(F.col("is_flagged"))
    samples = F.filter(F.array(*[F.substring(F.col(f"sample_review_{i}"), 1, 180) for i in (1, 2, 3)]),
                       lambda x: x.isNotNull() & (F.length(x) > 10) & (x != "nan"))
    out = f.select("cluster_id", F.regexp_replace("label", r" \(Proto\)", "").alias("label"),
                   F.coalesce("keywords", F.lit("")).alias("keywords"), "estimated_volume",
                   F.coalesce("momentum_pct", F.lit(0.0)).alias("momentum_pct"), samples.alias("sample_reviews"))
    out = out.withColumn("rank", F.row_number().over(W.orderBy(F.col("estimated_volume").desc(), "cluster_id")).cast("long"))
    return out if top is None else out.filter(F.col("rank") <= top)



def save_model(model: PipelineModel, path: str) -> str:
    """Persist a fitted pipeline (overwrites)."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """Load a persisted pipeline."""
    return PipelineModel.load(path)
