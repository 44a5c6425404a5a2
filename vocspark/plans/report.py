"""Executive-report queries (E23–E30): the data behind each report section.

Same inputs as the dashboard (ts = topic_timeseries, topics = topic_analysis,
reviews, aspect_analysis); every table here is bounded by #labels x #months
except the review-level aggregates, which are single-pass partial aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocspark import config as C
from vocspark.operators import series as S
from vocspark.plans.dashboard import _rank, _review_period_stats, _severity_rank, active_issues

METRIC = ["severity_weighted_rate", "normalized_rate", "mentions"]


def _month_flags(ts: DataFrame, limit_months: int) -> DataFrame:
    """Report window rules: cur = last n months (n = 0: last month); prev = the n before
    when 2n months exist, else the second-to-last month (which may overlap cur)."""
    n = int(limit_months)
    m = ts.select("month").filter(F.col("month").isNotNull()).distinct()
    m = m.withColumn("rk", F.row_number().over(W.orderBy(F.col("month").desc()))) \
         .withColumn("nm", F.count(F.lit(1)).over(W.partitionBy()))
    rk, nm = F.col("rk"), F.col("nm")
    if n > 0:
        is_cur = rk <= n
        is_prev = F.when(nm >= 2 * n, (rk > n) & (rk <= 2 * n)).otherwise(rk == 2)
    else:
        is_cur, is_prev = rk == 1, rk == 2
    return m.select("month", is_cur.alias("is_cur"), is_prev.alias("is_prev"), "nm")


def report_alerts(ts: DataFrame, limit_months: int = 3, top: int = 4) -> DataFrame:
    """Velocity on mentions + anomaly on the metric's whole history; no volume floor."""
    mcol = S.pick_metric(ts.columns, METRIC)
    fl = _month_flags(ts, limit_months)
    j = ts.join(F.broadcast(fl), "month")
    t = j.groupBy("issue_label").agg(
        F.sum(F.when(F.col("is_cur"), F.col("mentions"))).cast("double").alias("c"),
        F.coalesce(F.sum(F.when(F.col("is_prev"), F.col("mentions"))), F.lit(0)).cast("double").alias("p"),
        F.max("nm").alias("nm"))
    t = t.filter(F.col("c") > 0)
    an = S.anomaly_last(ts, "issue_label", mcol, fill_null=True)
    a = t.join(an, "issue_label", "left")
    vel = F.when(F.col("p") == 0, F.lit(100.0)).otherwise(F.round((F.col("c") - F.col("p")) / F.col("p") * 100, 1))
    a = a.withColumn("velocity_pct", vel).withColumn("is_anomaly", F.coalesce(F.col("is_anomaly"), F.lit(False)))
    a = a.filter(F.col("is_anomaly") | (F.col("velocity_pct") > 10)).filter(F.col("nm") >= 2)
    sev = F.when(F.col("is_anomaly") & (F.col("velocity_pct") > 40), "CRITICAL") \
           .when(F.col("is_anomaly") | (F.col("velocity_pct") > 25), "HIGH").otherwise("WATCH")
    r = F.bround(F.col("velocity_pct"), 0).cast("long").cast("string")
    msg = F.when(F.col("is_anomaly") & (F.col("velocity_pct") > 10),
                 F.concat(F.lit(C.TEXT_REPORT_ANOMALY_SPIKE[0]), r, F.lit(C.TEXT_REPORT_ANOMALY_SPIKE[1]))) \
           .when(F.col("is_anomaly"), F.lit(C.TEXT_REPORT_ANOMALY)) \
           .otherwise(F.concat(F.lit(C.TEXT_REPORT_INCREASE[0]), r, F.lit(C.TEXT_REPORT_INCREASE[1])))
    out = a.select(F.col("issue_label").alias("category"), sev.alias("severity"), msg.alias("message"), "velocity_pct")
    out = _rank(out, [_severity_rank(F.col("severity")), F.col("velocity_pct").desc(), F.col("category").asc()])
    return out.filter(F.col("rank") <= top)


def report_aspects(aspect_analysis: DataFrame, ts: DataFrame, limit_months: int = 3, top: int = 4,
                   mapping=None) -> DataFrame:
    """Top aspects by mentions with momentum and a priority tag."""
    spark = ts.sparkSession
    n = int(limit_months)
    totals = aspect_analysis.groupBy("aspect").agg(F.sum("mentions").alias("mentions"))
    totals = totals.withColumn("share", F.col("mentions") /
                               F.greatest(F.sum("mentions").over(W.partitionBy()), F.lit(1)) * 100)
    totals = _rank(totals, [F.col("mentions").desc(), F.col("aspect").asc()]).filter(F.col("rank") <= top)
    m = ts.select("month").distinct()
    m = m.withColumn("rk", F.row_number().over(W.orderBy(F.col("month").desc()))) \
         .withColumn("nm", F.count(F.lit(1)).over(W.partitionBy()))
    rk, nm = F.col("rk"), F.col("nm")
    is_cur = (rk <= n) if n > 0 else (rk == 1)
    is_prev = ((rk > n) & (rk <= 2 * n) & (nm >= 2 * n)) if n > 0 else F.lit(False)
    fl = m.select("month", is_cur.alias("is_cur"), is_prev.alias("is_prev"))
    amap = C.aspect_map_df(spark, mapping)
    vols = ts.join(F.broadcast(fl), "month").join(F.broadcast(amap), "issue_label") \
             .groupBy("aspect").agg(F.sum(F.when(F.col("is_cur"), F.col("mentions"))).alias("cv"),
                                    F.sum(F.when(F.col("is_prev"), F.col("mentions"))).alias("pv"))
    j = totals.join(vols, "aspect", "left")
    pv = F.coalesce(F.col("pv"), F.lit(0)).cast("double")
    cv = F.coalesce(F.col("cv"), F.lit(0)).cast("double")
    mom = F.when(pv > 0, F.round((cv - pv) / pv * 100, 1)).otherwise(F.lit(0.0))
    j = j.withColumn("momentum", mom)
    pri = F.when((F.col("share") >= 25) | (F.col("momentum") >= 20), "Critical") \
           .when((F.col("share") >= 14) | (F.col("momentum") > 0), "Active").otherwise("Watch")
    return j.select("aspect", F.col("mentions").cast("long").alias("mentions"), "momentum", pri.alias("priority"), "rank")


def report_stability(topics: DataFrame, ts: DataFrame, limit_months: int = 0) -> DataFrame:
    """One row — baseline (latest score, 2 dp), volatility count, status, latest month, volatile months."""
    if limit_months > 0:
        cur = S.month_window(ts, limit_months, "none").filter(F.col("period") == "cur").select("month")
        ts = ts.join(F.broadcast(cur), "month")
    sc = S.weighted_severity(ts, topics, "month").select("month", "score")
    b = S.stability_bands(sc)
    return b.agg(
        F.round(F.max_by("score", "month"), 2).alias("baseline"),
        F.count_if("is_volatile").cast("long").alias("volatility_count"),
        F.when(F.max_by("is_volatile", "month"), F.lit(C.TEXT_VOLATILE))
         .otherwise(F.lit(C.TEXT_STABLE)).alias("status"),
        F.max("month").alias("latest_month"),
        F.array_sort(F.collect_list(F.when(F.col("is_volatile"), F.col("month")))).alias("volatile_months"),
    )


def report_movers(ts: DataFrame, limit_months: int = 3, top: int = 4, min_mentions: int = 15) -> DataFrame:
    """Biggest risers/fallers between the window's first month and the last month.

    `min_mentions` is the reference's noise floor on the window's mentions (0 turns it off)."""
    mcol = S.pick_metric(ts.columns, METRIC)
    n = int(limit_months)
    m = ts.select("month").distinct()
    m = m.withColumn("rk", F.row_number().over(W.orderBy(F.col("month").desc()))) \
         .withColumn("nm", F.count(F.lit(1)).over(W.partitionBy()))
    first = F.when((F.lit(n) > 0) & (F.col("nm") >= n), F.col("rk") == n).otherwise(F.col("rk") == F.col("nm")) \
        if n > 0 else (F.col("rk") == F.col("nm"))
    fl = m.select("month", first.alias("is_first"), (F.col("rk") == 1).alias("is_last"), "nm")
    j = ts.join(F.broadcast(fl), "month")
    t = j.groupBy("issue_label").agg(
        F.sum("mentions").alias("tot"),
        F.coalesce(F.max(F.when(F.col("is_first"), F.col(mcol))), F.lit(0.0)).cast("double").alias("s"),
        F.coalesce(F.max(F.when(F.col("is_last"), F.col(mcol))), F.lit(0.0)).cast("double").alias("e"),
        F.max("nm").alias("nm"))
    t = t.filter((F.col("tot") >= min_mentions) & ~((F.col("s") == 0) & (F.col("e") == 0)) & (F.col("nm") >= 2))
    pct = F.when(F.col("s") == 0, F.lit(100.0)).otherwise(F.round((F.col("e") - F.col("s")) / F.col("s") * 100, 1))
    t = t.withColumn("change_pct", pct)
    out = t.select(F.col("issue_label").alias("label"), "change_pct",
                   F.when(F.col("change_pct") > 0, "Rising").otherwise("Cooling").alias("direction"))
    out = _rank(out, [F.abs(F.col("change_pct")).desc(), F.col("label").asc()])
    return out.filter(F.col("rank") <= top)


def report_sentiment(reviews: DataFrame, as_of: str = C.DEFAULT_AS_OF, limit_months: int = 0) -> DataFrame:
    """Positive / negative counts and shares (1 dp) with momentum of the positive share."""
    s = _review_period_stats(reviews, as_of, limit_months)
    tc = F.col("pos_cur") + F.col("neg_cur")
    tp = F.col("pos_prev") + F.col("neg_prev")
    pc = F.when(tc > 0, F.round(F.col("pos_cur") / tc * 100, 1)).otherwise(F.lit(0.0))
    nc = F.when(tc > 0, F.round(F.col("neg_cur") / tc * 100, 1)).otherwise(F.lit(0.0))
    pp = F.when(tp > 0, F.round(F.col("pos_prev") / tp * 100, 1)).otherwise(F.lit(0.0))
    mom = F.when(F.col("n_prev") > 0, F.round(pc - pp, 1)).otherwise(F.lit(0.0))
    return s.filter(F.col("n_cur") > 0).select(
        F.col("pos_cur").cast("long").alias("positive"), F.col("neg_cur").cast("long").alias("negative"),
        pc.alias("positive_pct"), nc.alias("negative_pct"), mom.alias("momentum"))


def report_kpis(reviews: DataFrame, ts: DataFrame, as_of: str = C.DEFAULT_AS_OF, limit_months: int = 0) -> DataFrame:
    """Four KPI cards as rows: label, value, sub, delta, delta_suffix, card."""
    s = _review_period_stats(reviews, as_of, limit_months)
    a = active_issues(ts, limit_months)
    act_c = a.select("active_cur").scalar()
    act_p = a.select("active_prev").scalar()
    has_prev = F.col("n_prev") > 0
    avg_c = F.round(F.col("avg_cur"), 2)
    avg_p = F.round(F.col("avg_prev"), 2)
    pp_c = F.when(F.col("n_cur") > 0, F.round(F.col("pos_cur") / F.col("n_cur") * 100, 1)).otherwise(F.lit(0.0))
    pp_p = F.when(F.col("n_prev") > 0, F.round(F.col("pos_prev") / F.col("n_prev") * 100, 1)).otherwise(F.lit(0.0))
    win = f"Last {limit_months} Months" if limit_months > 0 else "All Time"
    cards = F.array(
        F.struct(F.lit(1).alias("card"), F.lit("Total Feedback").alias("label"),
                 F.format_number(F.col("n_cur"), 0).alias("value"), F.lit(win).alias("sub"),
                 F.when(has_prev, F.round((F.col("n_cur") - F.col("n_prev")) / F.col("n_prev") * 100, 1))
                  .cast("double").alias("delta"), F.lit("%").alias("delta_suffix")),
        F.struct(F.lit(2).alias("card"), F.lit("Avg Rating").alias("label"),
                 F.when(avg_c.isNotNull(), F.concat(avg_c.cast("string"), F.lit("/5.0"))).otherwise(F.lit("N/A")).alias("value"),
                 F.lit("Average score").alias("sub"),
                 F.when(has_prev & avg_c.isNotNull() & avg_p.isNotNull(), F.round(avg_c - avg_p, 1)).cast("double").alias("delta"),
                 F.lit("").alias("delta_suffix")),
        F.struct(F.lit(3).alias("card"), F.lit("Customer Happiness").alias("label"),
                 F.concat(pp_c.cast("string"), F.lit("%")).alias("value"), F.lit("Positive sentiment share").alias("sub"),
                 F.when(has_prev, F.round(pp_c - pp_p, 1)).cast("double").alias("delta"), F.lit(" pts").alias("delta_suffix")),
        F.struct(F.lit(4).alias("card"), F.lit("Total Issues Found").alias("label"),
                 act_c.cast("string").alias("value"), F.lit("Distinct active issue clusters").alias("sub"),
                 F.when(act_p.isNotNull(), (act_c - act_p)).cast("double").alias("delta"), F.lit("").alias("delta_suffix")),
    )
    return s.select(F.explode(cards).alias("c")).select("c.*")


def report_top_issues(topics: DataFrame, ts: DataFrame, limit_months: int = 0, top: int = 10) -> DataFrame:
    """Labels by window mentions (> 0), then severity; first evidence sample."""
    t = topics.select("label", "mentions", "avg_severity", "sample_reviews")
    if limit_months > 0:
        cur = S.month_window(ts, limit_months, "none").filter(F.col("period") == "cur").select("month")
        w = ts.join(F.broadcast(cur), "month").groupBy(F.col("issue_label").alias("label")) \
              .agg(F.sum("mentions").alias("wm"))
        t = t.join(w, "label", "left").withColumn("mentions", F.coalesce(F.col("wm"), F.lit(0))).drop("wm")
    t = t.filter(F.col("mentions") > 0)
    ev = F.filter(F.transform("sample_reviews", lambda x: F.regexp_replace(x, r"^[ '\"\n\t]+|[ '\"\n\t]+$", "")),
                  lambda x: x != F.lit(""))
    out = t.select("label", F.col("mentions").cast("long").alias("mentions"),
                   F.round("avg_severity", 1).alias("severity"),
                   F.coalesce(F.try_element_at(ev, F.lit(1)), F.lit("No evidence snippet available.")).alias("evidence"),
                   F.col("avg_severity").alias("_sev"))
    out = _rank(out, [F.col("mentions").desc(), F.col("_sev").desc(), F.col("label").asc()]).drop("_sev")
    return out.filter(F.col("rank") <= top)
