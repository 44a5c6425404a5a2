"""Evidence queries (E6, E7, E8, E15, E16): reviews behind an issue, a month,
a topic or the live feed.

Top-k everywhere has a complete tie-breaker; prefix de-duplication is an
aggregation (min_by per prefix) so a prefix shared by a third of all rows is
pre-combined per map task instead of landing in one window partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocspark import config as C
from vocspark.operators.windows import period_split

EVIDENCE_COLS = ["text", "at", "score", "user_tier", "value_weight", "app_version", "upvotes"]


def _evidence_select(df: DataFrame) -> list:
    cols = df.columns
    return [
        F.col("text").cast("string").alias("text"),
        (F.col("date") if "date" in cols else F.lit("Recent")).cast("string").alias("at"),
        (F.col("severity").cast("int") if "severity" in cols else F.lit(0)).alias("score"),
        (F.col("user_tier") if "user_tier" in cols else F.lit("Standard")).cast("string").alias("user_tier"),
        (F.col("value_weight") if "value_weight" in cols else F.lit(1.0)).cast("double").alias("value_weight"),
        (F.col("app_version") if "app_version" in cols else F.lit("N/A")).cast("string").alias("app_version"),
        (F.col("upvotes").cast("long") if "upvotes" in cols else F.lit(0).cast("long")).alias("upvotes"),
    ]


def dedup_prefix(df: DataFrame, text: str = "text", order_desc: str = "confidence", prefix: int | None = None) -> DataFrame:
    """First row per text in (order_desc desc, text asc) order. `prefix` (the reference's 200)
    compares only so many leading characters; by default whole texts are compared."""
    key = F.col(text) if prefix is None else F.substring(F.col(text), 1, prefix)
    packed = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(key.alias("_pfx")).agg(
        F.min_by(packed, F.struct((-F.col(order_desc)).alias("o"), F.col(text).alias("t"))).alias("_r"))
    return best.select("_r.*")


def issue_reviews(classified: DataFrame, issue: str, limit_months: int = 0, top: int | None = 100,
                  topics: DataFrame | None = None) -> DataFrame:
    """Evidence for one category: last n months *of that category*, text > 20 chars,
    de-duplicated by text, top 100 by confidence (top=None: all). Falls back to the
    topic's stored sample reviews (> 20 chars, first 20) when no row matches."""
    m = classified.filter(F.trim(F.col("category")) == F.lit(issue.strip()))
    if limit_months > 0:
        m = m.filter(F.col("date").isNotNull() & (F.col("date") != ""))
        months = m.select("date").distinct()
        months = months.withColumn("_rk", F.row_number().over(W.orderBy(F.col("date").desc()))) \
                       .filter(F.col("_rk") <= limit_months).select("date")
        m = m.join(F.broadcast(months), "date", "left_semi")
    total = m.select(F.count(F.lit(1))).scalar()
    d = dedup_prefix(m.filter(F.length("text") > 20))
    d = d.withColumn("_rk", F.row_number().over(W.orderBy(F.col("confidence").desc(), F.col("text").asc())))
    out = (d if top is None else d.filter(F.col("_rk") <= top)).select(F.col("_rk").cast("long").alias("rank"), *_evidence_select(d),
                                               total.cast("long").alias("total_in_window"))
    win = f"Last {limit_months}M" if limit_months > 0 else "All Time"
    out = out.withColumn("window", F.lit(win))
    if topics is None:
        return out
    fb = topics.filter(F.trim(F.col("label")) == F.lit(issue.strip())).limit(1)
    fb = fb.select(F.posexplode(F.filter("sample_reviews", lambda x: F.length(x) > 20)).alias("_p", "text"))
    fb = fb.filter(F.col("_p") < 20).select(
        (F.col("_p") + 1).cast("long").alias("rank"), F.col("text"), F.lit("Recent").alias("at"), F.lit(0).alias("score"),
        F.lit("Standard").alias("user_tier"), F.lit(1.0).alias("value_weight"), F.lit("N/A").alias("app_version"),
        F.lit(0).cast("long").alias("upvotes"), F.lit(0).cast("long").alias("total_in_window"),
        F.lit("All Time (pre-computed)").alias("window"))
    return out.unionByName(fb.filter(total == 0))


def diagnostic_evidence(classified: DataFrame, month: str | None = None, topic: str | None = None,
                        aspect: str | None = None, top: int = 100, mapping=None) -> DataFrame:
    """Cross-section evidence: date contains `month`; category or text matches the
    `topic` regex (case-insensitive); category in the `aspect`'s labels; top 100 by confidence."""
    d = classified
    if month:
        d = d.filter(F.col("date").contains(month))
    if topic:
        pat = "(?i)" + topic
        d = d.filter(F.coalesce(F.col("category").rlike(pat), F.lit(False)) |
                     F.coalesce(F.col("text").rlike(pat), F.lit(False)))
    if aspect:
        labels = (mapping or C.ASPECT_MAP).get(aspect, [])
        d = d.filter(F.col("category").isin(labels))
    top_rows = d.orderBy(F.col("confidence").desc(), F.col("text").asc()).limit(top)
    r = top_rows.withColumn("_rk", F.row_number().over(W.orderBy(F.col("confidence").desc(), F.col("text").asc())))
    return r.select(F.col("_rk").cast("long").alias("rank"),
                    F.concat(F.lit("enriched-"), F.substring(F.md5(F.col("text")), 1, 12)).alias("id"),
                    *_evidence_select(r))


def live_ticker(reviews: DataFrame, n: int = 15, min_len: int = 30, cut: int = 200) -> DataFrame:
    """E15 + F38: newest n reviews, *then* drop texts shorter than 30 chars; text cut to 200."""
    top = reviews.orderBy(F.col("at").desc_nulls_last(), F.col("reviewId").asc()).limit(n)
    top = top.withColumn("_rk", F.row_number().over(W.orderBy(F.col("at").desc_nulls_last(), F.col("reviewId").asc())))
    top = top.filter(F.length("content") >= min_len)
    return top.select(F.col("_rk").cast("long").alias("rank"), F.col("reviewId").alias("id"),
                      F.substring("content", 1, cut).alias("text"),
                      F.coalesce(F.col("sentiment"), F.lit("neutral")).alias("sentiment"), F.col("at"))


def reviews_head(reviews: DataFrame, n: int = 50, order=None) -> DataFrame:
    """The first n reviews by an explicit order (default: numeric review id, then
    ids that are no numbers, by text)."""
    order = order or [F.col("reviewId").try_cast("long").asc_nulls_last(), F.col("reviewId").asc()]
    return reviews.orderBy(*order).limit(n)


EXPORT_COLUMNS = ["reviewId", "content", "score", "sentiment", "at", "app", "appVersion"]


def export_projection(reviews: DataFrame, as_of: str = C.DEFAULT_AS_OF, limit_months: int = 0) -> DataFrame:
    """Reviews of the last n months, known columns in a fixed order."""
    r = reviews
    if limit_months > 0:
        r = period_split(r, as_of, limit_months).filter(F.col("period") == "cur")
    return r.select(*[c for c in EXPORT_COLUMNS if c in reviews.columns])


def export_csv(reviews: DataFrame, path: str, as_of: str = C.DEFAULT_AS_OF, limit_months: int = 0) -> str:
    """S10 sink: header CSV of the export projection (one folder of part files)."""
    export_projection(reviews, as_of, limit_months).write.mode("overwrite").option("header", True).csv(path)
    return path
