"""Word-count operators over text columns.

All are explode + group-by pipelines: the word table is pre-aggregated per map
task (partial aggregation) before the shuffle, so a hot group costs one
partial row per distinct word per task, and top-k per group uses
`row_number() <= k` (WindowGroupLimit: local top-k before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vocspark import config as C
from vocspark.functions.text import words
from vocspark.operators.series import top_per_group


def word_counts(df: DataFrame, keys, text: str, weight: str | None = None) -> DataFrame:
    """(keys..., word, cnt): whitespace tokens of the lower-cased text, each counted `weight` times (default 1)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    n = F.lit(1) if weight is None else F.col(weight)
    e = df.select(*keys, n.alias("_n"), F.explode(words(F.col(text))).alias("word"))
    return e.groupBy(*keys, "word").agg(F.sum("_n").alias("cnt"))


def cluster_keywords(df: DataFrame, group: str, text: str, k: int = 5, stop_words=None, min_len: int = 4) -> DataFrame:
    """The k most frequent words per group, *then* stop-word / length filter, joined ', '.

    Ties in frequency break on the word (ascending).
    """
    stop = C.str_array(stop_words or C.CLUSTER_STOP_WORDS)
    wc = word_counts(df, group, text)
    top = top_per_group(wc, group, [F.col("cnt").desc(), F.col("word").asc()], k, "_rk")
    top = top.filter(~F.array_contains(stop, F.col("word")) & (F.length("word") >= min_len))
    g = top.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_rk", "word"))).alias("_w"))
    g = g.select(group, F.array_join(F.transform("_w", lambda s: s["word"]), ", ").alias("keywords"))
    groups = df.select(group).distinct()
    return groups.join(g, group, "left").select(group, F.coalesce(F.col("keywords"), F.lit("")).alias("keywords"))


def shifting_terms(df: DataFrame, category: str, month: str, text: str, min_len: int = 4, top: int = 3,
                   weight: str | None = None) -> DataFrame:
    """Per category and consecutive months (prev -> cur): words of cur with length >= min_len,
    score = count(cur) - count(prev); top `top` with score > 0, joined ', '.

    Output: category, month_from, month_to, shifting_terms.
    """
    wc = word_counts(df, [category, month], text, weight).filter(F.length("word") >= min_len)
    w = W.partitionBy(category).orderBy(month)
    near = df.select(category, month).distinct() \
        .select(category, month, F.lag(month).over(w).alias("month_from"))
    # a word's own months are few: its count in the month before is found by sorting, where sums by pair need a map of twice the counts
    own = W.partitionBy(category, "word").orderBy(month)
    wc = wc.select(category, month, "word", "cnt", F.lag(month).over(own).alias("_m"), F.lag("cnt").over(own).alias("_n"))
    before = F.when(F.col("_m") == F.col("month_from"), F.col("_n")).otherwise(F.lit(0))
    j = wc.join(near.filter(F.col("month_from").isNotNull()), [category, month]) \
        .select(category, "month_from", F.col(month).alias("month_to"), "word", (F.col("cnt") - before).alias("score")).filter(F.col("score") > 0)
    t = top_per_group(j, [category, "month_from", "month_to"], [F.col("score").desc(), F.col("word").asc()], top, "_rk")
    g = t.groupBy(category, "month_from", "month_to").agg(F.array_sort(F.collect_list(F.struct("_rk", "word"))).alias("_w"))
    return g.select(category, "month_from", "month_to",
                    F.array_join(F.transform("_w", lambda s: s["word"]), ", ").alias("shifting_terms"))


def keyword_titles(keywords: Column, stop_words=None) -> Column:
    """(old_label, new_label) for a comma-separated keyword string.

    old: '<W1> <W2> Issues' (or '<W1> Issues'); new: drop generic words, then
    '<A> <B> Task' / '<A> Related Problems' / '<W1> System Feedback'; blank -> 'General Issue'.
    """
    stop = C.str_array(stop_words or C.TITLE_STOP_WORDS)
    raw = F.split(keywords, ",")
    old_ws = F.transform(raw, lambda w: F.trim(w))
    ws = F.transform(raw, lambda w: F.lower(F.trim(w)))
    kept = F.filter(ws, lambda w: ~F.array_contains(stop, w))

    def cap(w):
        return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))

    old = F.when(F.size(old_ws) >= 2, F.concat_ws(" ", cap(old_ws[0]), cap(old_ws[1]), F.lit("Issues"))) \
           .otherwise(F.concat_ws(" ", cap(old_ws[0]), F.lit("Issues")))
    new = F.when(F.size(kept) >= 2, F.concat_ws(" ", cap(kept[0]), cap(kept[1]), F.lit("Task"))) \
           .when(F.size(kept) == 1, F.concat_ws(" ", cap(kept[0]), F.lit("Related Problems"))) \
           .otherwise(F.concat_ws(" ", cap(ws[0]), F.lit("System Feedback")))
    blank = keywords.isNull() | (F.trim(keywords) == F.lit(""))
    return F.struct(old.alias("old_label"), F.when(blank, F.lit("General Issue")).otherwise(new).alias("new_label"))
