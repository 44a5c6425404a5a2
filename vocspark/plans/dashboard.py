"""Dashboard queries (E1–E19): one DataFrame-returning function each.

Inputs are the derived tables (topic_timeseries `ts`, topic_analysis `topics`,
reviews, review_classifications). No function collects data; `as_of` replaces
the reference's wall clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocspark import config as C
from vocspark.operators import series as S


def _rank(df: DataFrame, order, name: str = "rank") -> DataFrame:
    """Dense 1..n ordering column for small result tables (bounded by #labels)."""
    return df.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("long"))


def top_issues(topics: DataFrame, ts: DataFrame, limit_months: int = 0, top: int = 10) -> DataFrame:
    """Top issues with windowed mentions, peak metric, velocity.

    n > 0: mentions = window sum per label; sort metric = peak of the best
    metric column within the window among labels above the noise floor;
    velocity vs the previous n months. n = 0: sort by all-time mentions and
    report the all-time revenue-risk sum.
    Output: rank, issue, mentions, sort_metric, avg_severity, revenue_risk,
    velocity, velocity_dir, velocity_label.
    """
    t = topics.select(F.col("label").alias("issue"), F.col("mentions").alias("all_mentions"), "avg_severity")
    if limit_months > 0:
        metric = S.pick_metric(ts.columns)
        tp = S.with_period(ts, limit_months, "none")
        tot = S.window_totals(tp, "issue_label", "mentions")
        peak = S.window_totals(tp, "issue_label", metric).select("issue_label", F.col("cur_max").alias("peak"))
        tot = tot.join(peak, "issue_label", "left")
        total_cur = F.sum("cur").over(W.partitionBy())
        thr = S.noise_floor_threshold(total_cur, limit_months)
        tot = tot.withColumn("valid", F.col("cur").isNotNull() & (F.col("cur") >= thr)) \
                 .withColumn("has_prev", F.max(F.col("prev").isNotNull()).over(W.partitionBy()))
        j = t.join(tot, t.issue == tot.issue_label, "left")
        mentions = F.coalesce(F.col("cur"), F.lit(0)).cast("long")
        sort_metric = F.coalesce(F.when(F.col("valid"), F.col("peak")), F.lit(0.0)).cast("double")
        prev = F.coalesce(F.col("prev"), F.lit(0))
        v, d, lab = S.velocity(mentions, prev)
        hp = F.coalesce(F.col("has_prev"), F.lit(False))
        # has_prev is a property of the whole window, not of the label
        hp = F.max(hp).over(W.partitionBy())
        out = j.select(
            "issue", mentions.alias("mentions"), sort_metric.alias("sort_metric"),
            F.round("avg_severity", 2).alias("avg_severity"),
            (F.round(sort_metric, 2) if metric == "revenue_risk_score" else F.lit(None).cast("double")).alias("revenue_risk"),
            F.when(hp, v).alias("velocity"),
            F.when(hp, d).otherwise(F.lit("same")).alias("velocity_dir"),
            F.when(hp, lab).otherwise(F.lit("")).alias("velocity_label"),
        )
    else:
        risk = ts.groupBy(F.col("issue_label").alias("issue")).agg(
            F.sum(F.col("revenue_risk_score").cast("decimal(20,2)")).cast("double").alias("risk"))
        j = t.join(risk, "issue", "left")
        out = j.select(
            "issue", F.col("all_mentions").cast("long").alias("mentions"),
            F.col("all_mentions").cast("double").alias("sort_metric"),
            F.round("avg_severity", 2).alias("avg_severity"),
            F.round(F.coalesce(F.col("risk"), F.lit(0.0)), 2).alias("revenue_risk"),
            F.lit(None).cast("double").alias("velocity"),
            F.lit("same").alias("velocity_dir"),
            F.lit("").alias("velocity_label"),
        )
    out = out.filter(F.col("mentions") != 0)
    out = _rank(out, [F.col("sort_metric").desc(), F.col("issue").asc()])
    return out.filter(F.col("rank") <= top)


# ---------------------------------------------------------------------------
# Review-level KPIs
# ---------------------------------------------------------------------------

def _review_period_stats(reviews: DataFrame, as_of: str, limit_months: int) -> DataFrame:
    """One row: per-period count, rating sum, positives, negatives (single pass, partial agg)."""
    from vocspark.operators.windows import period_split
    p = period_split(reviews.select("at", "score", "sentiment"), as_of, limit_months)
    cur, prev = F.col("period") == "cur", F.col("period") == "prev"
    return p.agg(
        F.count_if(cur).alias("n_cur"), F.count_if(prev).alias("n_prev"),
        F.avg(F.when(cur, F.col("score"))).alias("avg_cur"), F.avg(F.when(prev, F.col("score"))).alias("avg_prev"),
        F.count_if(cur & (F.col("sentiment") == "positive")).alias("pos_cur"),
        F.count_if(cur & (F.col("sentiment") == "negative")).alias("neg_cur"),
        F.count_if(prev & (F.col("sentiment") == "positive")).alias("pos_prev"),
        F.count_if(prev & (F.col("sentiment") == "negative")).alias("neg_prev"),
    )


def sentiment_distribution(reviews: DataFrame, as_of: str = C.DEFAULT_AS_OF, limit_months: int = 0) -> DataFrame:
    """Positive, negative, momentum (= change of positive share among pos+neg, 1 dp)."""
    s = _review_period_stats(reviews, as_of, limit_months)
    tot_c = F.col("pos_cur") + F.col("neg_cur")
    tot_p = F.col("pos_prev") + F.col("neg_prev")
    pct_c = F.when(tot_c > 0, F.col("pos_cur") / tot_c * 100).otherwise(F.lit(0.0))
    pct_p = F.when(tot_p > 0, F.col("pos_prev") / tot_p * 100).otherwise(F.lit(0.0))
    mom = F.when(F.col("n_prev") > 0, F.round(pct_c - pct_p, 1)).otherwise(F.lit(0.0))
    return s.select(F.col("pos_cur").cast("long").alias("positive"), F.col("neg_cur").cast("long").alias("negative"),
                    mom.alias("momentum"))


def active_issues(ts: DataFrame, limit_months: int) -> DataFrame:
    """One row (active_cur, active_prev): labels whose window mention sum > 0."""
    tp = S.with_period(ts, limit_months, "none")
    t = S.window_totals(tp, "issue_label", "mentions")
    return t.agg(F.count_if(F.col("cur") > 0).alias("active_cur"),
                 F.when(F.count_if(F.col("n_prev") > 0) > 0, F.count_if(F.col("prev") > 0)).alias("active_prev"))


def kpis(reviews: DataFrame, ts: DataFrame, as_of: str = C.DEFAULT_AS_OF, limit_months: int = 0) -> DataFrame:
    """total_reviews, avg_rating, positive_pct, active_issues, window + deltas (null for All Time)."""
    from vocspark.operators.windows import window_label
    s = _review_period_stats(reviews, as_of, limit_months)
    a = active_issues(ts, limit_months)
    act_c = a.select("active_cur").scalar()
    act_p = a.select("active_prev").scalar()
    avg_c = F.round(F.col("avg_cur"), 2)
    avg_p = F.round(F.col("avg_prev"), 2)
    pp_c = F.when(F.col("n_cur") > 0, F.round(F.col("pos_cur") / F.col("n_cur") * 100, 1)).otherwise(F.lit(0.0))
    pp_p = F.when(F.col("n_prev") > 0, F.round(F.col("pos_prev") / F.col("n_prev") * 100, 1)).otherwise(F.lit(0.0))
    has_prev = F.col("n_prev") > 0
    dated = limit_months > 0
    d_rev = F.when(has_prev, F.round((F.col("n_cur") - F.col("n_prev")) / F.col("n_prev") * 100, 1))
    d_rat = F.when(has_prev & (avg_c != 0) & (avg_p != 0), F.round(avg_c - avg_p, 2))
    d_pos = F.when(has_prev & (pp_p != 0), F.round(pp_c - pp_p, 2))
    d_act = F.when(act_p.isNotNull() & (act_p != 0), act_c - act_p)
    nul = F.lit(None)
    return s.select(
        F.col("n_cur").cast("long").alias("total_reviews"), avg_c.alias("avg_rating"), pp_c.alias("positive_pct"),
        act_c.cast("long").alias("active_issues"), window_label(limit_months).alias("window"),
        (d_rev if dated else nul).cast("double").alias("delta_reviews"),
        (d_rat if dated else nul).cast("double").alias("delta_rating"),
        (d_pos if dated else nul).cast("double").alias("delta_positive_pct"),
        (d_act if dated else nul).cast("long").alias("delta_active_issues"),
    )


# ---------------------------------------------------------------------------
# Aspects (E3) and aspect share alerts
# ---------------------------------------------------------------------------

def aspects_map(ts: DataFrame, topics: DataFrame, limit_months: int = 3, mapping=None) -> DataFrame:
    """Per aspect (General excluded): window mentions, mention-weighted severity,
    momentum vs previous window (prev 0 -> 100) and top contributing label."""
    spark = ts.sparkSession
    amap = C.aspect_map_df(spark, mapping).filter(F.col("aspect") != C.GENERAL_ASPECT)
    order = {a: i for i, a in enumerate((mapping or C.ASPECT_MAP).keys())}
    ordc = F.lit(None).cast("int")
    for a, i in reversed(list(order.items())):
        ordc = F.when(F.col("aspect") == a, F.lit(i)).otherwise(ordc)
    tp = S.with_period(ts, limit_months, "rest")
    tot = S.window_totals(tp, "issue_label", "mentions")
    sev = topics.select(F.col("label").alias("issue_label"), F.col("avg_severity"))
    j = F.broadcast(amap).join(tot, "issue_label", "left").join(F.broadcast(sev), "issue_label", "left")
    vol = F.coalesce(F.col("cur"), F.lit(0))
    s = F.coalesce(F.col("avg_severity"), F.lit(2.0)).cast("decimal(10,2)")
    g = j.groupBy("aspect").agg(
        F.sum(vol).alias("mentions"),
        F.sum(vol.cast("decimal(20,0)") * s).cast("double").alias("wsum"),
        F.sum(F.coalesce(F.col("prev"), F.lit(0))).alias("prev_vol"),
    )
    # top contributor: label with the largest window sum, ties -> first label in sorted order
    top = top_per_group_small(j.filter(F.col("cur").isNotNull()), "aspect",
                              [F.col("cur").desc(), F.col("issue_label").asc()])
    g = g.join(top.select("aspect", F.col("issue_label").alias("top_topic")), "aspect", "left")
    mom = F.when(F.col("prev_vol") > 0,
                 F.round((F.col("mentions") - F.col("prev_vol")) / F.greatest(F.col("prev_vol"), F.lit(1)) * 100, 1)) \
        .otherwise(F.lit(100.0))
    out = g.select(
        "aspect", F.col("mentions").cast("long").alias("mentions"),
        F.round(F.col("wsum") / F.greatest(F.col("mentions"), F.lit(1)), 2).alias("sentiment_score"),
        mom.alias("momentum_pct"),
        F.coalesce(F.col("top_topic"), F.lit("None")).alias("top_topic"),
        ordc.alias("_ord"),
    )
    return _rank(out, [F.col("mentions").desc(), F.col("_ord").asc()]).drop("_ord")


def top_per_group_small(df: DataFrame, by: str, order) -> DataFrame:
    return S.top_per_group(df, by, order, 1).drop("rk")


def aspect_counts(reviews: DataFrame, text: str = "content", keywords=None, weight: str | None = None,
                  found: str | None = None) -> DataFrame:
    """aspect_analysis — reviews per aspect (a review can hit several; no-hit -> General,
    which is counted but left out of the table, Q2). A row stands for `weight` reviews (default 1).
    `found` names a column that already holds a text's aspects."""
    from vocspark.functions.text import aspects as aspect_expr
    kw = keywords or C.ASPECT_KEYWORDS
    a = reviews.select(F.explode(aspect_expr(F.col(text), kw) if found is None else F.col(found)).alias("aspect"), (F.lit(1) if weight is None else F.col(weight)).alias("_n"))
    counts = a.groupBy("aspect").agg(F.sum("_n").alias("mentions"))
    spark = reviews.sparkSession
    names = spark.createDataFrame([(k,) for k in kw.keys()], "aspect string")
    return F.broadcast(names).join(counts, "aspect", "left").select(
        "aspect", F.coalesce(F.col("mentions"), F.lit(0)).cast("long").alias("mentions"))


def threshold_alerts(aspect_analysis: DataFrame, as_of: str = C.DEFAULT_AS_OF, cut: float = C.SHARE_ALERT_PCT) -> DataFrame:
    """Aspects holding >= cut % of all aspect mentions -> alert rows (alerts schema)."""
    share = F.col("mentions") / F.sum("mentions").over(W.partitionBy()) * 100
    x = aspect_analysis.withColumn("pct", share).filter(F.col("pct").isNotNull() & (F.col("pct") >= cut))
    ts = F.lit(as_of).cast("timestamp")
    return x.select(
        F.concat(F.lit("alert_"), F.unix_timestamp(ts).cast("string"), F.lit("_"), F.col("aspect")).alias("id"),
        F.lit("aspect_spike").alias("type"),
        F.col("aspect").alias("category"),
        F.format_string("Critical spike detected in %s (%.1f%% of complaints).", F.col("aspect"), F.col("pct")).alias("message"),
        F.lit("high").alias("severity"),
        ts.alias("timestamp"),
    )


# ---------------------------------------------------------------------------
# Trending (E5): top-5 series, control bands, correlation, T+1 forecast
# ---------------------------------------------------------------------------

def _trend_metric(columns, metric: str) -> str:
    if metric == "revenue" and "revenue_risk_score" in columns:
        return "revenue_risk_score"
    return S.pick_metric(columns, ["severity_weighted_rate", "normalized_rate", "mentions"])


def trending_top(ts: DataFrame, limit_months: int = 0, metric: str = "severity", top: int = 5) -> DataFrame:
    """O2 + P5: labels above the noise floor with the highest peak metric in the window."""
    mcol = _trend_metric(ts.columns, metric)
    cur = S.month_window(ts, limit_months, "none").filter(F.col("period") == "cur").select("month")
    win = ts.join(F.broadcast(cur), "month")
    sums = win.groupBy("issue_label").agg(F.sum("mentions").alias("m"), F.max(mcol).alias("peak"))
    thr = S.noise_floor_threshold(F.sum("m").over(W.partitionBy()), limit_months)
    valid = sums.withColumn("_thr", thr).filter(F.col("m") >= F.col("_thr")).drop("_thr")
    return _rank(valid, [F.col("peak").desc(), F.col("issue_label").asc()], "trend_rank") \
        .filter(F.col("trend_rank") <= top).select("issue_label", "trend_rank")


def trending(ts: DataFrame, limit_months: int = 0, metric: str = "severity", top: int = 5,
             corr_threshold: float = C.CORR_TRENDING) -> DataFrame:
    """E5 (long form): month, issue_label, value, upper_bound, mom_pct, correlated_with, is_forecast.

    Whole-history series of the window's top labels on a complete calendar,
    centred bands, MoM %, best Pearson partner (> threshold) on the smoothed
    zero-filled series, and a T+1 forecast row per label when the window holds
    at least three months. Everything after `trending_top` runs on
    <= top x #months rows.
    """
    mcol = _trend_metric(ts.columns, metric)
    top5 = trending_top(ts, limit_months, metric, top)
    grid = S.complete_months(ts.select("issue_label", "month", mcol), "issue_label", mcol,
                             keys=top5.select("issue_label"))
    bands = S.control_bands(grid, "issue_label", mcol)
    corr = S.correlate(bands, "issue_label", "month", "value", corr_threshold, fill=0.0)
    corr_txt = corr.select("issue_label", F.concat(F.col("linked_to"), F.lit(" ("),
                                                   (F.col("score") * 100).cast("int").cast("string"),
                                                   F.lit("% match)")).alias("correlated_with"))
    bands = bands.join(corr_txt, "issue_label", "left") \
                 .withColumn("correlated_with", F.coalesce(F.col("correlated_with"), F.lit("")))
    cur = S.month_window(ts, limit_months, "none").filter(F.col("period") == "cur").select("month")
    tgt = bands.join(F.broadcast(cur), "month", "left_semi") if limit_months > 0 else bands
    actual = tgt.select("month", "issue_label", "value", "upper_bound", "mom_pct", "correlated_with",
                        F.lit(False).alias("is_forecast"))
    # forecast: last three target months of the smoothed series
    wd = W.partitionBy("issue_label").orderBy(F.col("month").desc())
    r = tgt.select("issue_label", "month", "value", "upper_bound", "correlated_with",
                   F.row_number().over(wd).alias("rd"),
                   F.count(F.lit(1)).over(W.partitionBy("issue_label")).alias("nt"))
    first = r.filter(F.col("rd") == 3).select("issue_label", F.col("value").alias("v1"))
    last = r.filter((F.col("rd") == 1) & (F.col("nt") >= 3))
    f = last.join(first, "issue_label")
    # 2-dp inputs: the half-cent slope is exact in DECIMAL, so ties round half-up everywhere
    dv, dv1 = F.col("value").cast("decimal(20,2)"), F.col("v1").cast("decimal(20,2)")
    slope = (dv - dv1) * F.lit(0.5).cast("decimal(2,1)")
    zero = F.lit(0).cast("decimal(20,2)")
    fv = F.round(F.greatest(dv + slope, zero), 2).cast("double")
    fb = F.round(F.greatest(F.col("upper_bound").cast("decimal(20,2)") + slope, zero), 2).cast("double")
    denom = F.when(F.col("value") == 0, F.lit(1.0)).otherwise(F.col("value"))
    fm = F.coalesce(F.round((fv - F.col("value")) / denom * 100, 1), F.lit(0.0))
    nxt = F.concat(F.date_format(F.add_months(S.month_start(F.col("month")), 1), "yyyy-MM"), F.lit(" (Forecast)"))
    fc = f.select(nxt.alias("month"), "issue_label", fv.alias("value"), fb.alias("upper_bound"),
                  fm.alias("mom_pct"), "correlated_with", F.lit(True).alias("is_forecast"))
    return actual.unionByName(fc)


def issue_correlation(ts: DataFrame, limit_months: int = 0, metric: str = "severity",
                      threshold: float = C.CORR_TRENDING) -> DataFrame:
    """A16 on the trending series: issue_label, linked_to, score (rounded to 4 dp)."""
    mcol = _trend_metric(ts.columns, metric)
    top5 = trending_top(ts, limit_months, metric)
    grid = S.complete_months(ts.select("issue_label", "month", mcol), "issue_label", mcol,
                             keys=top5.select("issue_label"))
    bands = S.control_bands(grid, "issue_label", mcol)
    c = S.correlate(bands, "issue_label", "month", "value", threshold, fill=0.0)
    return c.select("issue_label", "linked_to", F.round("score", 4).alias("score"))


# ---------------------------------------------------------------------------
# Alerts (E9, E10)
# ---------------------------------------------------------------------------

def _slug(col, n: int) -> F.Column:
    return F.substring(F.regexp_replace(F.lower(col), " ", "-"), 1, n)


def velocity_alerts(ts: DataFrame, limit_months: int = 3) -> DataFrame:
    """Categories whose mentions rose >= 10 / 20 / 40 % vs the previous n months."""
    n = int(limit_months)
    tp = S.with_period(ts, n, "none")
    t = S.window_totals(tp, "topic_id", "mentions")
    c = F.coalesce(F.col("cur"), F.lit(0)).cast("long")
    p = F.coalesce(F.col("prev"), F.lit(0)).cast("long")
    t = t.select("topic_id", c.alias("c"), p.alias("p")).filter(F.col("p") != 0)
    pct = F.round((F.col("c") - F.col("p")) / F.col("p") * 100, 1)
    t = t.withColumn("velocity_pct", pct)
    sev = F.when(F.col("velocity_pct") >= 40, "CRITICAL").when(F.col("velocity_pct") >= 20, "HIGH") \
           .when(F.col("velocity_pct") >= 10, "WATCH")
    t = t.withColumn("severity", sev).filter(F.col("severity").isNotNull())
    sign = F.when(F.col("velocity_pct") > 0, F.lit("+")).otherwise(F.lit(""))
    msg = F.concat(F.lit("\U0001F534 "), F.col("topic_id"), F.lit(": "), sign, S.pct_text(F.col("velocity_pct")),
                   F.lit(C.TEXT_VERSUS.format(n=n)), F.col("p").cast("string"), F.lit(" → "),
                   F.col("c").cast("string"), F.lit(")"))
    out = t.select(
        F.concat(F.lit("vel-"), _slug(F.col("topic_id"), 20)).alias("id"),
        F.col("topic_id").alias("category"), "velocity_pct",
        F.col("c").alias("curr_mentions"), F.col("p").alias("prev_mentions"), "severity",
        F.lit(f"Last {n}M").alias("window"), msg.alias("message"))
    return _rank(out, [F.col("velocity_pct").desc(), F.col("category").asc()])


def _aspect_dominance(aspect_analysis: DataFrame, cut: float = C.SHARE_ALERT_PCT) -> DataFrame:
    order = {a: i for i, a in enumerate(C.ASPECT_KEYWORDS.keys())}
    ordc = F.lit(len(order)).cast("int")
    for a, i in reversed(list(order.items())):
        ordc = F.when(F.col("aspect") == a, F.lit(i)).otherwise(ordc)
    tot = F.sum("mentions").over(W.partitionBy())
    x = aspect_analysis.withColumn("_tot", tot).withColumn("pct", F.col("mentions") / F.col("_tot") * 100) \
        .filter((F.col("_tot") > 0) & (F.col("pct") >= cut))
    return x.select(
        F.concat(F.lit("asp-"), F.substring(F.lower(F.col("aspect")), 1, 15)).alias("id"),
        F.col("aspect").alias("category"), F.lit("ASPECT_DOMINANCE").alias("type"), F.lit("HIGH").alias("severity"),
        F.format_string(C.TEXT_DOMINANCE, F.col("pct")).alias("message"),
        F.lit(0.0).alias("velocity_pct"), F.lit(False).alias("is_anomaly"),
        F.lit(None).cast("string").alias("linked_to"), F.lit(None).cast("double").alias("link_score"),
        F.lit(0).alias("_src"), ordc.alias("_ord"), F.lit(None).cast("string").alias("_key"))


def _severity_rank(sev) -> F.Column:
    return F.when(sev == "CRITICAL", 0).when(sev == "HIGH", 1).when(sev == "WATCH", 2).otherwise(3)


def intelligence_alerts(ts: DataFrame, aspect_analysis: DataFrame | None, limit_months: int = 3,
                        top: int = 6, link_threshold: float = C.CORR_ALERTS, min_volume: float = 5) -> DataFrame:
    """Unified anomaly / velocity / correlation alerts plus aspect dominance.

    Velocity is on the window *sum of the metric* (Q8); volume < `min_volume` skipped (0: none);
    previous 0 -> 100 %; anomaly = W6 on the whole history of the metric;
    links = best Pearson partner > 0.85 among the window's top-5 topics.
    """
    mcol = S.pick_metric(ts.columns, ["severity_weighted_rate", "normalized_rate", "mentions"])
    n_months = ts.select(F.countDistinct("month")).scalar()
    tp = S.with_period(ts, limit_months, "rest")
    st = S.window_totals(tp, "topic_id", mcol).filter(F.col("n_cur") > 0)
    top5 = _rank(st, [F.col("cur_max").desc(), F.col("topic_id").asc()], "r5").filter(F.col("r5") <= 5)
    # correlation among the top 5 over the months where any of them has a row (missing -> 0)
    ts5 = ts.join(F.broadcast(top5.select("topic_id")), "topic_id", "left_semi")
    g = ts5.groupBy("topic_id", "month").agg(F.max(mcol).alias("v"))
    months5 = g.agg(F.array_sort(F.collect_set("month"))).scalar()  # bounded by #months
    grid = top5.select("topic_id", F.explode(months5).alias("month"))
    full = grid.join(g, ["topic_id", "month"], "left")
    links = S.correlate(full, "topic_id", "month", "v", link_threshold, fill=0.0)
    n_top = top5.select(F.count(F.lit(1))).scalar()
    links = links.filter((n_months >= 3) & (n_top > 1))
    an = S.anomaly_last(ts, "topic_id", mcol)
    a = st.join(an, "topic_id", "left").join(links, "topic_id", "left")
    p = F.coalesce(F.col("prev"), F.lit(0.0))
    vel = F.when(p > 0, F.round((F.col("cur") - p) / p * 100, 1)).otherwise(F.lit(100.0))
    vel_txt = F.when(p > 0, S.pct_text(vel)).otherwise(F.lit("100"))
    is_an = F.coalesce(F.col("is_anomaly"), F.lit(False))
    a = a.filter(F.col("cur") >= min_volume).withColumn("velocity_pct", vel).withColumn("is_anomaly", is_an) \
         .filter(F.col("is_anomaly") | (F.col("velocity_pct") > 10))
    sev = F.when(F.col("is_anomaly") & (F.col("velocity_pct") > 40), "CRITICAL") \
           .when(F.col("is_anomaly") | (F.col("velocity_pct") > 25), "HIGH").otherwise("WATCH")
    msg = F.concat_ws(" | ",
                      F.when(F.col("is_anomaly"), F.format_string(C.TEXT_ANOMALY_LIMIT,
                                                                   F.col("threshold"))),
                      F.when(F.col("velocity_pct") > 10, F.concat(F.lit(C.TEXT_SPIKE), vel_txt, F.lit("%"))))
    topics_out = a.select(
        F.concat(F.lit("int-"), _slug(F.col("topic_id"), 15)).alias("id"),
        F.col("topic_id").alias("category"),
        F.when(F.col("is_anomaly"), "ANOMALY").otherwise("VELOCITY").alias("type"),
        sev.alias("severity"), msg.alias("message"), F.col("velocity_pct").cast("double").alias("velocity_pct"),
        "is_anomaly", "linked_to", F.round("score", 2).alias("link_score"),
        F.lit(1).alias("_src"), F.lit(0).alias("_ord"), F.col("topic_id").alias("_key"))
    out = topics_out
    if aspect_analysis is not None:
        out = _aspect_dominance(aspect_analysis).unionByName(topics_out)
    out = out.filter(n_months >= 2)
    out = _rank(out, [_severity_rank(F.col("severity")), F.col("velocity_pct").desc(), F.col("_src"),
                      F.col("_ord"), F.col("_key")])
    return out.filter(F.col("rank") <= top).drop("_src", "_ord", "_key")


# ---------------------------------------------------------------------------
# Sentiment stability
# ---------------------------------------------------------------------------

def sentiment_stability(ts: DataFrame, topics: DataFrame, limit_months: int = 0, exclude_current: bool = False) -> DataFrame:
    """Mention-weighted severity per month (3 dp), trailing bands, volatility; last n months."""
    sc = S.weighted_severity(ts, topics, "month").select("month", F.round("score", 3).alias("score"))
    b = S.stability_bands(sc, exclude_current=exclude_current)
    # band statistics to 6 dp: stable output across engines / summation orders
    b = b.select("month", "score", *[F.round(c, 6).alias(c) for c in ("rolling_mean", "rolling_std", "upper_band",
                                                                      "lower_band")], "is_volatile")
    if limit_months > 0:
        b = b.withColumn("_rd", F.row_number().over(W.orderBy(F.col("month").desc()))) \
             .filter(F.col("_rd") <= limit_months).drop("_rd")
    return b
