"""Vector operators: centroids, classification, search, evidence de-duplication,
silhouette and semantic drift (A23, A24, J9, J10, M9–M16).

Scale notes
-----------
* Centroids are a group-by with map-side partial sums of whole vectors (MLlib's
  Summarizer), so a task sends one partial sum per key and a hot group costs no more.
* The centroid table is bounded by #categories x dim; it is attached to every
  row as one packed scalar-subquery value (Spark broadcasts the single row),
  so classification / silhouette need no join and no pair explosion.
* Silhouette is exact without pairwise distances: for unit vectors the mean
  cosine distance from x to cluster C is 1 - x.S_C / |C| (S_C = sum of C).
* Search is a top-k (`orderBy().limit()` -> TakeOrderedAndProject, a partial
  top-k per partition).
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocspark import config as C
from vocspark.functions import vectors as V
from vocspark.operators.series import top_per_group


def vector_sum(df: DataFrame, keys, vec: str, out: str = "vsum", count: str = "n", weight: str | None = None) -> DataFrame:
    """Per-key element-wise sum of an ARRAY<DOUBLE> column, plus the row count (null vectors left out).
    A row stands for `weight` rows (default 1).

    One aggregate over whole vectors: a task keeps one partial sum for each key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    n = F.lit(1) if weight is None else F.col(weight)
    v = df.filter(F.col(vec).isNotNull()).select(*keys, array_to_vector(vec).alias("_v"), n.cast("long").alias("_n"))
    s = v.groupBy(*keys).agg(Summarizer.sum(F.col("_v"), F.col("_n").cast("double")).alias("_s"), F.sum("_n").alias(count))
    return s.select(*keys, vector_to_array("_s").alias(out), count)


def centroids(df: DataFrame, key: str, vec: str, eps: float = 0.0, normalize_rows: bool = False,
              weight: str | None = None) -> DataFrame:
    """Mean vector per key, L2-normalised (zero norm -> /1, or + eps for drift)."""
    src = df.select(key, (V.normalize(vec) if normalize_rows else F.col(vec)).alias("_v"), *([weight] if weight else []))
    s = vector_sum(src, key, "_v", weight=weight)
    mean = F.transform("vsum", lambda x: x / F.col("n"))
    return s.select(key, V.normalize(mean, eps).alias("centroid"), F.col("n").cast("long").alias("n"))


def pack(df: DataFrame, key: str, vec: str) -> Column:
    """One scalar value: array<struct<key, vec>> sorted by key (bounded by #keys)."""
    return df.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vec).alias("v"))))).scalar()


def classify(df: DataFrame, vec: str, cents: DataFrame, key: str = "category", centroid: str = "centroid",
             threshold: float = C.CONFIDENCE_THRESHOLD, fallback: str = C.FALLBACK_LABEL) -> DataFrame:
    """M10 (J9 + F21): nearest centroid by cosine; below `threshold` -> fallback label.

    Adds `best_label`, `confidence` (raw cosine) and `predicted`.
    """
    # argmax of raw dot products = argmax of cosines (positive row norm); divide once after
    raw = F.transform("_packed", lambda c: V.dot(F.col(vec), c["v"]))
    n = V.norm(vec)
    out = df.withColumn("_packed", pack(cents, key, centroid)).withColumn("_best", V.argmax(raw))
    out = out.withColumn("best_label", F.element_at(F.col("_packed"), (F.lit(1) - F.col("_best.ni")).cast("int"))["k"]) \
             .withColumn("confidence", F.col("_best.s") / F.when(n == 0, F.lit(1.0)).otherwise(n))
    return out.withColumn("predicted", F.when(F.col("confidence") >= threshold, F.col("best_label"))
                          .otherwise(F.lit(fallback))).drop("_best", "_packed")


def semantic_search(df: DataFrame, vec: str, query: Column, id_col: str, top_n: int = 15) -> DataFrame:
    """Exact cosine top-n against one query vector (a scalar Column)."""
    s = df.withColumn("_q", query).withColumn("score", V.dot(V.normalize(vec), V.normalize("_q"))).drop("_q")
    top = s.orderBy(F.col("score").desc(), F.col(id_col).asc()).limit(top_n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), F.col(id_col).asc())).cast("long"))


def silhouette(df: DataFrame, label: str, vec: str, weight: str | None = None) -> DataFrame:
    """Exact mean cosine silhouette over *all* rows, without pairs. A row stands for `weight`
    rows (default 1).

    For unit x in cluster A: a = (|A| - 1 - (x.S_A - x.x)) / (|A| - 1),
    b = min over B != A of 1 - x.S_B / |B|, s = (b - a) / max(a, b), s = 0 for |A| = 1.
    Output (classification_quality schema): metric, value, n_categories, n_samples,
    threshold_confidence, dedup_threshold.
    """
    u = df.select(F.col(label).alias("_l"), V.normalize(vec).alias("_u"), (F.lit(1) if weight is None else F.col(weight)).alias("_n"))
    sums = vector_sum(u, "_l", "_u", "S", "n", "_n")
    packed = sums.agg(F.array_sort(F.collect_list(F.struct(F.col("_l").alias("k"), "S", "n")))).scalar()
    per = u.withColumn("_packed", packed).select("_l", "_n", F.transform("_packed", lambda c: F.struct(
        c["k"].alias("k"), c["n"].alias("n"), V.dot(F.col("_u"), c["S"]).alias("d"))).alias("_cs"),
        V.dot("_u", "_u").alias("_xx"))
    # staged projections: each non-trivial value is computed once per row
    per = per.withColumn("_own", F.filter("_cs", lambda c: c["k"] == F.col("_l"))[0]) \
             .withColumn("_b", F.array_min(F.transform(F.filter("_cs", lambda c: c["k"] != F.col("_l")),
                                                        lambda c: F.lit(1.0) - c["d"] / c["n"])))
    per = per.withColumn("_a", (F.col("_own.n") - F.lit(1) - (F.col("_own.d") - F.col("_xx"))) / F.greatest(F.col("_own.n") - F.lit(1), F.lit(1)))
    # a class of one row, or a row as far from all (both distances zero), scores 0
    s = F.when(F.col("_own.n") <= 1, F.lit(0.0)).otherwise(F.coalesce(
        (F.col("_b") - F.col("_a")) / F.nullif(F.greatest("_a", "_b"), F.lit(0.0)), F.lit(0.0)))
    r = per.select(s.alias("s"), "_n")
    nk = sums.select(F.count(F.lit(1))).scalar()
    scored = F.when(F.col("s").isNotNull(), F.col("_n"))
    return r.agg((F.sum(F.col("s") * F.col("_n")) / F.sum(scored)).alias("v"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).select(
        F.lit("silhouette_score").alias("metric"), F.round("v", 4).alias("value"),
        nk.cast("int").alias("n_categories"), F.col("n").cast("int").alias("n_samples"),
        F.lit(C.CONFIDENCE_THRESHOLD).alias("threshold_confidence"), F.lit(C.DEDUP_THRESHOLD).alias("dedup_threshold"),
    ).filter(nk >= 2)


def greedy_dedup(df: DataFrame, group: str, order, vec: str, item: str, keep: int = 15,
                 threshold: float = C.DEDUP_THRESHOLD, candidates: int | None = 20) -> DataFrame:
    """Walk candidates in `order`, keep one unless its cosine to an
    already kept item is >= threshold; stop at `keep` items.

    `candidates` bounds the walk per group (the reference walks its top-20
    evidence heap); the fold over that bounded array is an `aggregate` with
    `exists`, no UDF. Output: group, kept (array of items in walk order).
    """
    x = df.withColumn("_i", F.col(item)).withColumn("_u", V.normalize(vec))
    okeys = list(order)
    if candidates is not None:
        x = top_per_group(x, group, okeys, candidates, "_rk")
    else:
        x = x.withColumn("_rk", F.row_number().over(W.partitionBy(group).orderBy(*okeys)))
    g = x.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_rk", "_i", "_u"))).alias("_c"))
    init = F.array().cast("array<struct<_i:string,_u:array<double>>>")

    def step(acc, c):
        dup = F.exists(acc, lambda k: V.dot(k["_u"], c["_u"]) >= threshold)
        add = (F.size(acc) < keep) & ~dup
        return F.when(add, F.concat(acc, F.array(F.struct(c["_i"].cast("string").alias("_i"), c["_u"].alias("_u"))))) \
                .otherwise(acc)

    kept = F.aggregate("_c", init, step, lambda acc: F.transform(acc, lambda k: k["_i"]))
    return g.select(group, kept.alias("kept"))


def drift_pairs(df: DataFrame, category: str, month: str, vec: str, text: str | None = None,
                cut: float = C.DRIFT_EVOLVING_PAIR, per_month: int | None = None, order=None,
                min_len: int = 4, top_terms: int = 3, weight: str | None = None) -> DataFrame:
    """1 - cos(centroid(prev month), centroid(month)) for consecutive months per category. A row stands
    for `weight` rows (default 1).

    Centroids use eps = 1e-8 as the reference does; `per_month` optionally caps
    rows per (category, month) by an explicit `order` (default: all rows).
    Output (semantic_drift schema): category, month_from, month_to, drift_score,
    is_evolving, shifting_terms.
    """
    src = df
    if per_month is not None:
        if weight is not None:
            raise ValueError("per_month counts rows: give them unweighed")
        src = top_per_group(df, [category, month], order or [F.col(text).asc()], per_month, "_rk")
    cents = centroids(src.select(F.struct(category, month).alias("_k"), F.col(vec), *([weight] if weight else [])), "_k", vec, eps=1e-8, weight=weight)
    cents = cents.select(F.col("_k").getField(category).alias(category), F.col("_k").getField(month).alias(month),
                         "centroid")
    w = W.partitionBy(category).orderBy(month)
    p = cents.select(category, F.lag(month).over(w).alias("month_from"), F.col(month).alias("month_to"),
                     F.lag("centroid").over(w).alias("_prev"), "centroid")
    p = p.filter(F.col("month_from").isNotNull())
    p = p.select(category, "month_from", "month_to",
                 F.round(F.lit(1.0) - V.dot("_prev", "centroid"), 4).alias("drift_score"))
    p = p.withColumn("is_evolving", F.col("drift_score") > cut)
    if text is None:
        return p.withColumn("shifting_terms", F.lit(""))
    from vocspark.operators.textops import shifting_terms
    st = shifting_terms(src, category, month, text, min_len=min_len, top=top_terms, weight=weight)
    return p.join(st, [category, "month_from", "month_to"], "left") \
            .withColumn("shifting_terms", F.coalesce(F.col("shifting_terms"), F.lit("")))


def drift_summary(drift: DataFrame, limit_months: int = 0, cut: float = C.DRIFT_EVOLVING_AVG) -> DataFrame:
    """Last n `month_from` values; per category mean / max / count / latest terms; avg > cut."""
    d = drift
    if limit_months > 0:
        m = drift.select("month_from").distinct()
        m = m.withColumn("_rk", F.row_number().over(W.orderBy(F.col("month_from").desc()))) \
             .filter(F.col("_rk") <= limit_months).select("month_from")
        d = drift.join(F.broadcast(m), "month_from")
    g = d.groupBy("category").agg(F.avg("drift_score").alias("avg"), F.max("drift_score").alias("mx"),
                                  # 4-dp scores: average whole 1e-4 units so ties round half-up exactly
                                  (F.round(F.avg(F.round(F.col("drift_score") * 10000).cast("long")), 0)
                                   / F.lit(10000.0)).alias("avg4"),
                                  F.count(F.lit(1)).alias("n"),
                                  F.max_by("shifting_terms", F.struct("month_from", "month_to")).alias("terms"))
    g = g.filter(F.col("avg") > cut)
    out = g.select("category", F.col("avg4").alias("avg_drift"), F.round("mx", 4).alias("max_drift"),
                   F.col("n").cast("long").alias("n_months"),
                   F.coalesce(F.col("terms"), F.lit("stable")).alias("shifting_terms"),
                   F.least(F.bround(F.col("avg") * 50, 0), F.lit(5.0)).cast("long").alias("trend_bar"),
                   F.col("avg").alias("_a"))
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.col("_a").desc(), F.col("category"))).cast("long")).drop("_a")
