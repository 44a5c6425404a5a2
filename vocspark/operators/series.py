"""Monthly series operators: rate tables, month windows, bands, anomalies,
forecasts and correlation (A9–A16, P2, P5, W1–W10, J4–J6).

Scale notes
-----------
* `monthly_rates` and `topic_stats` are the only operators that touch review
  rows; both are hash aggregations with map-side partial aggregation, so a hot
  category (the fallback bucket can hold a third of all rows) costs one partial
  row per map task, not a skewed reducer.
* Everything downstream runs on (label, month) rows: bounded by
  #labels x #months (a few thousand rows even for decades of data). Global
  windows over *distinct months* are therefore safe and are used only there.
* Month sets are joined back with `broadcast()`; their size is bounded by the
  calendar (12 per year), not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


METRIC_PREFERENCE = ["revenue_risk_score", "severity_weighted_rate", "normalized_rate", "mentions"]


def pick_metric(columns, prefer=None) -> str:
    """First available metric column (driver-side, schema only)."""
    for c in (prefer or METRIC_PREFERENCE):
        if c in columns:
            return c
    return "mentions"


def rate_per_1000(x: Column, total: Column) -> Column:
    return F.round(x / F.greatest(total, F.lit(1)) * F.lit(1000), 2)


# ---------------------------------------------------------------------------
# Rate tables built from per-review classifications
# ---------------------------------------------------------------------------

def monthly_rates(classified: DataFrame, category: str = "category", month: str = "date",
                  text: str = "text", min_text_len: int | None = None) -> DataFrame:
    """topic_timeseries from review_classifications.

    mentions, severity and impact cover every dated review. `min_text_len` (off by
    default) is the reference's quirk Q16: severity / impact sums then use only rows
    whose text is longer, and 2.0 per mention where a (label, month) has none.
    """
    base = classified.filter(F.col(month).isNotNull() & (F.col(month) != F.lit("")))
    long_ = F.lit(True) if min_text_len is None else F.length(F.col(text)) > F.lit(min_text_len)
    g = base.groupBy(F.col(category).alias("issue_label"), F.col(month).alias("month")).agg(
        F.count(F.lit(1)).alias("mentions"),
        F.count_if(long_).alias("n_long"),
        F.sum(F.when(long_, F.col("severity"))).alias("sev_sum"),
        # exact cents: impact values are 2-dp numbers, sum them as decimals
        F.sum(F.when(long_, F.col("financial_impact").cast("decimal(18,2)"))).alias("impact_sum"),
    )
    total = F.sum("mentions").over(W.partitionBy("month"))
    sev = F.when(F.col("n_long") > 0, F.col("sev_sum")).otherwise(F.col("mentions") * F.lit(2.0))
    imp = F.when(F.col("n_long") > 0, F.col("impact_sum").cast("double")).otherwise(F.col("mentions") * F.lit(2.0))
    return g.withColumn("total_reviews_in_month", total).select(
        F.col("issue_label").alias("topic_id"),
        F.col("issue_label"),
        F.col("month"),
        F.col("mentions").cast("long").alias("mentions"),
        rate_per_1000(F.col("mentions"), F.col("total_reviews_in_month")).alias("normalized_rate"),
        rate_per_1000(sev, F.col("total_reviews_in_month")).alias("severity_weighted_rate"),
        rate_per_1000(imp, F.col("total_reviews_in_month")).alias("revenue_risk_score"),
        F.col("total_reviews_in_month").cast("long").alias("total_reviews_in_month"),
    )


def keyed_rates(mentions: DataFrame, stats: DataFrame, default: float = 2.0) -> DataFrame:
    """topic_timeseries where a topic's id and its issue label differ, and several topics may share a label.

    mentions: (topic_id, issue_label, month, mentions); stats: (category, month, sev_sum, impact_sum). A
    row takes the sums under its label, else those under its topic id, else `default` for each mention.
    Both are equi-joins of tables with a row for each (topic, month)."""
    by_label = stats.select(F.col("category").alias("issue_label"), "month", F.struct("sev_sum", "impact_sum").alias("_l"))
    by_topic = stats.select(F.col("category").alias("topic_id"), "month", F.struct("sev_sum", "impact_sum").alias("_t"))
    j = mentions.join(by_label, ["issue_label", "month"], "left").join(by_topic, ["topic_id", "month"], "left")
    flat = F.struct((F.col("mentions") * F.lit(default)).alias("sev_sum"), (F.col("mentions") * F.lit(default)).alias("impact_sum"))
    j = j.withColumn("total_reviews_in_month", F.sum("mentions").over(W.partitionBy("month")))
    pick = lambda c: F.coalesce(F.col("_l")[c].cast("double"), F.col("_t")[c].cast("double"), flat[c])
    return j.select(
        "topic_id", "issue_label", "month", F.col("mentions").cast("long").alias("mentions"),
        rate_per_1000(F.col("mentions"), F.col("total_reviews_in_month")).alias("normalized_rate"),
        rate_per_1000(pick("sev_sum"), F.col("total_reviews_in_month")).alias("severity_weighted_rate"),
        rate_per_1000(pick("impact_sum"), F.col("total_reviews_in_month")).alias("revenue_risk_score"),
        F.col("total_reviews_in_month").cast("long").alias("total_reviews_in_month"))


def top_per_group(df: DataFrame, by, order, n: int, rank_col: str = "rk") -> DataFrame:
    """First n rows per group by an explicit total order.

    `row_number() <= n` lets Spark plan a WindowGroupLimit: each map task keeps
    only its local top n per group before the shuffle, so a hot group does not
    ship all of its rows to one reducer.
    """
    by = [by] if isinstance(by, (str, Column)) else list(by)
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def topic_stats(classified: DataFrame, category: str = "category", text: str = "text",
                samples: int = 15, sample_min_len: int = 40, vec: str | None = None, anchors: DataFrame | None = None,
                candidates: int = 20, threshold: float = 0.85, texts: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """A7 + evidence: topic_analysis (topic_id, keywords, label, mentions, avg_severity, sample_reviews).

    sample_reviews is a display column: texts longer than `sample_min_len` characters (0 turns the length
    rule off). Without vectors the `samples` most confident ones. With `vec` and `anchors` (category,
    centroid) the evidence chain: the `candidates` most confident ones (W11), walked from the one nearest
    to the label's anchor on (M12), leaving out those within `threshold` of one already taken (M13), up to
    `samples`; a label without an anchor is walked by confidence.

    Where rows share texts, `texts` holds the evidence columns of each once and `weight`, its number of rows."""
    stats = classified.groupBy(F.col(category).alias("label")).agg(
        F.count(F.lit(1)).alias("mentions"),
        F.round(F.avg("severity"), 2).alias("avg_severity"),
    )
    rows = (classified if texts is None else texts).filter(F.length(F.col(text)) > F.lit(sample_min_len))
    rows = rows.select(F.col(category).alias("label"), F.col(text).alias("t"), F.col("confidence"), *([vec] if vec else []),
                       *([F.col(weight).alias("_n")] if weight else []))
    order = [F.col("confidence").desc(), F.col("t").asc()]
    if weight:  # the first rows have the first texts: those few come back as rows
        most = max(samples, candidates)
        first = top_per_group(rows, "label", order, most).drop("rk")
        rows = first.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(most)).cast("int")))).drop("_copy", "_n")
    if vec is None or anchors is None:
        ev = top_per_group(rows, "label", order, samples).groupBy("label").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rk", "t"))), lambda s: s["t"]).alias("sample_reviews"))
    else:
        from vocspark.functions import vectors as V
        from vocspark.operators.vectors import greedy_dedup
        best = top_per_group(rows, "label", order, candidates).drop("rk")  # candidates rows a label
        best = best.join(anchors.select(F.col(category).alias("label"), F.col("centroid").alias("_anchor")), "label", "left")
        best = best.withColumn("_align", V.dot(V.normalize(vec), F.col("_anchor")))
        ev = greedy_dedup(best, "label", [F.col("_align").desc_nulls_last(), *order], vec, "t", samples, threshold, candidates)
        ev = ev.withColumnRenamed("kept", "sample_reviews")
    return stats.join(ev, "label", "left").select(
        F.col("label").alias("topic_id"), F.col("label").alias("keywords"), "label",
        F.col("mentions").cast("long").alias("mentions"), "avg_severity",
        F.coalesce(F.col("sample_reviews"), F.array().cast("array<string>")).alias("sample_reviews"))


# ---------------------------------------------------------------------------
# Month windows
# ---------------------------------------------------------------------------

def month_window(ts: DataFrame, limit_months: int, short_history: str = "none",
                 month: str = "month") -> DataFrame:
    """(month, period) with period in {'cur','prev'} over the distinct months present.

    short_history decides the previous window when fewer than 2n months exist:
      'none'       -> no previous window
      'rest'       -> every month before the current window
      'last_month' -> report rules: n=0 means cur = last month, prev = the one before
    """
    n = int(limit_months)
    m = ts.select(F.col(month).alias("month")).filter(F.col("month").isNotNull()).distinct()
    m = m.withColumn("rk", F.row_number().over(W.orderBy(F.col("month").desc()))) \
         .withColumn("n_months", F.count(F.lit(1)).over(W.partitionBy()))
    rk, nm = F.col("rk"), F.col("n_months")
    if n <= 0:
        if short_history == "last_month":
            period = F.when(rk == 1, "cur").when(rk == 2, "prev")
        else:
            period = F.lit("cur")
    else:
        cur = rk <= n
        full_prev = (rk > n) & (rk <= 2 * n) & (nm >= 2 * n)
        if short_history == "rest":
            prev = F.when(nm >= 2 * n, (rk > n) & (rk <= 2 * n)).otherwise(rk > n)
        elif short_history == "last_month":
            prev = F.when(nm >= 2 * n, (rk > n) & (rk <= 2 * n)).otherwise(rk == 2)
        else:
            prev = full_prev
        period = F.when(cur, "cur").when(prev, "prev")
    return m.select("month", period.alias("period")).filter(F.col("period").isNotNull())


def with_period(ts: DataFrame, limit_months: int, short_history: str = "none", month: str = "month") -> DataFrame:
    """ts rows inside the current/previous windows, tagged with `period`.

    The month table is bounded by the calendar, so it is broadcast.
    """
    mw = month_window(ts, limit_months, short_history, month)
    if month != "month":
        mw = mw.withColumnRenamed("month", month)
    return ts.join(F.broadcast(mw), month, "inner")


def noise_floor_threshold(total: Column, limit_months: int, fixed: int | None = None, share: float = 0.05,
                          least: int = 2, all_time: int = 15) -> Column:
    """P5, the reference's noise floor: max(`least`, int(`share` of window mentions)) for n > 0,
    else `all_time`. `fixed` replaces all three; fixed=0 turns the floor off."""
    if fixed is not None:
        return F.lit(fixed)
    if limit_months > 0:
        return F.greatest(F.lit(least), F.floor(total * F.lit(share)).cast("long"))
    return F.lit(all_time)


def window_totals(ts_period: DataFrame, key: str = "issue_label", value: str = "mentions") -> DataFrame:
    """One pass, conditional sums per key: key, cur, prev, cur_max, prev_max, n_cur, n_prev."""
    cur = F.col("period") == "cur"
    prev = F.col("period") == "prev"
    return ts_period.groupBy(key).agg(
        F.sum(F.when(cur, F.col(value))).alias("cur"),
        F.sum(F.when(prev, F.col(value))).alias("prev"),
        F.max(F.when(cur, F.col(value))).alias("cur_max"),
        F.max(F.when(prev, F.col(value))).alias("prev_max"),
        F.count_if(cur).alias("n_cur"),
        F.count_if(prev).alias("n_prev"),
    )


def pct_text(pct: Column) -> Column:
    """Render a 1-dp percentage the way Python prints a rounded float ("12.5", "-3.0")."""
    return pct.cast("decimal(20,1)").cast("string")


def velocity(cur: Column, prev: Column) -> tuple[Column, Column, Column]:
    """(velocity_pct, velocity_dir, velocity_label); prev 0 -> NEW."""
    pct = F.round((cur - prev) / prev * F.lit(100), 1)
    has = prev > 0
    v = F.when(has, pct)
    d = F.when(has, F.when(pct > 5, "up").when(pct < -5, "down").otherwise("same")) \
         .when(cur > 0, "new").otherwise("same")
    lab = F.when(has, F.concat(F.when(pct > 0, F.lit("+")).otherwise(F.lit("")), pct_text(pct), F.lit("%"))) \
           .when(cur > 0, F.lit("NEW")).otherwise(F.lit(""))
    return v, d, lab


# ---------------------------------------------------------------------------
# Calendar completion, bands, momentum, forecast
# ---------------------------------------------------------------------------

def month_start(month: Column) -> Column:
    """First day of a 'yyyy-MM' month; null for text that is no month."""
    return F.concat(month, F.lit("-01")).try_cast("date")


def complete_months(ts: DataFrame, key: str, value: str, month: str = "month",
                    keys: DataFrame | None = None) -> DataFrame:
    """Every (key, month) between the first and last month present; missing -> null.

    Calendar bounds are scalar subqueries; the month sequence per key is
    generated with `sequence` + `explode` (no join, no driver-side list).
    """
    m0 = ts.select(F.min(month)).scalar()
    m1 = ts.select(F.max(month)).scalar()
    ks = keys if keys is not None else ts.select(key).distinct()
    grid = ks.select(key, F.explode(F.sequence(month_start(m0), month_start(m1),
                                               F.expr("interval 1 month"))).alias("d"))
    grid = grid.select(key, F.date_format("d", "yyyy-MM").alias(month))
    vals = ts.groupBy(key, month).agg(F.avg(value).alias(value))
    return grid.join(vals, [key, month], "left")


def control_bands(long: DataFrame, key: str, value: str, month: str = "month", width: int = 3,
                  min_periods: int = 2, k: float = 1.5) -> DataFrame:
    """Centred rolling mean / sample std (min 2 non-null), upper band, MoM %."""
    half = width // 2
    w = W.partitionBy(key).orderBy(month).rowsBetween(-half, half)
    cnt = F.count(F.col(value)).over(w)
    mean = F.when(cnt >= min_periods, F.avg(value).over(w))
    std = F.when(cnt >= min_periods, F.stddev_samp(value).over(w))
    # the series holds 2-dp values: average whole cents so the half-cent means of
    # two points ((a + b) / 2) round half-up exactly instead of on a binary approximation
    cents = F.round(F.col(value) * F.lit(100)).cast("long")
    mean_2dp = F.when(cnt >= min_periods, F.round(F.avg(cents).over(w), 0) / F.lit(100.0))
    prev = F.lag(value).over(W.partitionBy(key).orderBy(month))
    mom = F.coalesce(F.round(F.try_divide(F.col(value) - prev, prev) * F.lit(100), 1), F.lit(0.0))
    return long.select(
        key, month, F.col(value).alias("raw"),
        F.coalesce(mean_2dp, F.lit(0.0)).alias("value"),
        F.coalesce(F.round(mean + F.lit(k) * std, 2), F.lit(0.0)).alias("upper_bound"),
        mom.alias("mom_pct"),
    )


def anomaly_last(ts: DataFrame, key: str, value: str, month: str = "month", k: float = 1.5,
                 floor: float = 0.5, min_rows: int = 3, fill_null: bool = False) -> DataFrame:
    """Is the last point above mean + k * population std of the earlier points?

    Needs >= `min_rows` points; a zero std makes the threshold the mean.
    Output: key, last, threshold, is_anomaly, n_points.
    """
    v = F.coalesce(F.col(value), F.lit(0.0)) if fill_null else F.col(value)
    base = ts.select(key, month, v.cast("double").alias("_v"))
    w_all = W.partitionBy(key)
    w_ord = W.partitionBy(key).orderBy(month)
    w_hist = w_ord.rowsBetween(W.unboundedPreceding, -1)
    x = base.select(
        key, month, "_v",
        F.row_number().over(W.partitionBy(key).orderBy(F.col(month).desc())).alias("_rd"),
        F.count(F.lit(1)).over(w_all).alias("n_points"),
        F.avg("_v").over(w_hist).alias("_mean"),
        F.stddev_pop("_v").over(w_hist).alias("_std"),
    ).filter(F.col("_rd") == 1)
    thr = F.when(F.col("_std") > 0, F.col("_mean") + F.lit(k) * F.col("_std")).otherwise(F.col("_mean"))
    enough = F.col("n_points") >= min_rows
    return x.select(
        key, F.col("_v").alias("last"),
        F.when(enough, thr).otherwise(F.lit(0.0)).alias("threshold"),
        F.coalesce(enough & (F.col("_v") > thr) & (F.col("_v") > F.lit(floor)), F.lit(False)).alias("is_anomaly"),
        F.col("n_points"),
    )


def weighted_severity(ts: DataFrame, topics: DataFrame, by: str = "month", default: float = 2.0,
                      label: str = "issue_label") -> DataFrame:
    """J5 + A14: sum(mentions * severity(label)) / sum(mentions) per `by`; unknown label -> 2.0.

    Products are summed as DECIMAL (mentions x 2-dp severity) so the sum is exact.
    topics is bounded by #labels, hence broadcast.
    """
    sev = topics.select(F.col("label").alias(label), F.col("avg_severity").alias("_sev"))
    j = ts.join(F.broadcast(sev), label, "left")
    s = F.coalesce(F.col("_sev"), F.lit(default)).cast("decimal(10,2)")
    return j.groupBy(by).agg(
        F.sum(F.col("mentions").cast("decimal(20,0)") * s).cast("double").alias("_wsum"),
        F.sum("mentions").alias("_vol"),
    ).filter(F.col("_vol") > 0).select(by, (F.col("_wsum") / F.col("_vol")).alias("score"), F.col("_vol").alias("volume"))


def stability_bands(scores: DataFrame, month: str = "month", score: str = "score", k: float = 1.5,
                    exclude_current: bool = False) -> DataFrame:
    """Trailing-3 rolling mean (min 1) and sample std (null -> 0), +-k sigma, volatility flag.

    One series ordered by month: the frame is bounded by #months.
    """
    w = W.orderBy(month).rowsBetween(-3, -1) if exclude_current else W.orderBy(month).rowsBetween(-2, 0)
    mean = F.avg(score).over(w)
    std = F.coalesce(F.stddev_samp(score).over(w), F.lit(0.0))
    x = scores.withColumn("rolling_mean", mean).withColumn("rolling_std", std)
    x = x.withColumn("upper_band", F.col("rolling_mean") + F.lit(k) * F.col("rolling_std")) \
         .withColumn("lower_band", F.col("rolling_mean") - F.lit(k) * F.col("rolling_std"))
    return x.withColumn("is_volatile", F.coalesce((F.col(score) > F.col("upper_band")) |
                                                  (F.col(score) < F.col("lower_band")), F.lit(False)))


def correlate(long: DataFrame, key: str, month: str, value: str, threshold: float,
              fill: float | None = 0.0) -> DataFrame:
    """Pearson correlation of every pair of series over common months; best partner above threshold.

    The self join is on month among a handful of series (top-5 callers), so
    pairs are bounded by 5 x 4 x #months. Constant series give NULL (guarded
    division), never an error. Output: key, linked_to, score.
    """
    x = long.select(F.col(key).alias("_a"), F.col(month).alias("_m"),
                    (F.coalesce(F.col(value), F.lit(fill)) if fill is not None else F.col(value)).alias("_x"))
    y = x.select(F.col("_a").alias("_b"), "_m", F.col("_x").alias("_y"))
    p = x.join(y, "_m").filter(F.col("_a") != F.col("_b"))
    c = p.groupBy("_a", "_b").agg(
        F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y")).alias("_r"))
    c = c.filter(F.col("_r").isNotNull() & ~F.isnan("_r"))
    best = top_per_group(c, "_a", [F.col("_r").desc(), F.col("_b").asc()], 1)
    return best.filter(F.col("_r") > F.lit(threshold)).select(
        F.col("_a").alias(key), F.col("_b").alias("linked_to"), F.col("_r").alias("score"))
