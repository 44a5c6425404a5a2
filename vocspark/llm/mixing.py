"""Operator 4 — mixing sources to target weights (DataFrame functions only).

Sizes (words) are summed per source. A source's target is its share of the budget by weight, at
most `max_repeat` times its own size; what a source cannot take goes to the others by weight, until
none is above its bound. That is the level at which min(bound, level * weight) adds up to the
budget; sources that reach their bound first have the smallest bound per weight, so the level comes
from running sums over the sources in that order. rate = target / size, and each document is
emitted floor(rate) times plus once more with probability rate - floor(rate), drawn from a hash of
its id, so that reruns agree.

Only the table of sources, one row each, is ever ordered as a whole; documents are aggregated in
their own tasks first and meet that table in a join by source.

Cases: a null text has size 0; a null source is a source of its own, sorted last; a null doc_id
draws like the text "null"; equal ids draw alike; an empty table gives an empty table; a source of
size 0 has target 0 and emits nothing. `mix` returns just the columns of docs, whatever their
names; `with_copies` replaces columns that have the names of its results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import unit_hash, word_count

SEED = 23
WEIGHT_CYCLE = 3
MAX_REPEAT = 3
BUDGET_SHARE = 1.0


def source_rates(sized: DataFrame, cycle: int = WEIGHT_CYCLE, max_repeat: int = MAX_REPEAT,
                 share: float = BUDGET_SHARE) -> DataFrame:
    """source, source_size, weight, target, rate: one row for each source.

    `sized` has source and size. Sources by code point, null last, weigh 1 .. cycle, repeating."""
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", (F.row_number().over(by_name) - 1) % cycle + 1)
    per = per.withColumn("bound", F.col("source_size") * F.lit(max_repeat))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    from_here = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(every) * F.lit(float(share))
    per = (per.withColumn("budget", budget)
           .withColumn("level", (F.col("budget") - F.coalesce(F.sum("bound").over(before), F.lit(0)))
                       / F.sum("weight").over(from_here)))
    # the first source, in that order, whose bound is not below the level sets it for itself and all after
    per = per.withColumn("set_level", F.when(F.col("bound") >= F.col("level") * F.col("weight"), F.col("level")))
    per = per.withColumn("final", F.first("set_level", ignorenulls=True).over(
        fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("bound").cast("double"),
                     F.coalesce(F.col("final") * F.col("weight"), F.col("bound").cast("double")))
    per = per.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", F.col("weight").cast("long").alias("weight"), "target",
                      rate.alias("rate"))


def with_copies(docs: DataFrame, seed: int = SEED, cycle: int = WEIGHT_CYCLE,
                max_repeat: int = MAX_REPEAT, share: float = BUDGET_SHARE) -> DataFrame:
    """docs with size, source_size, target and copies (long): how often the mix takes each document."""
    sized = docs.drop("size", "source_size", "target", "copies").withColumn("size", word_count(F.col("text")))
    rates = source_rates(sized.select("source", "size"), cycle, max_repeat, share)
    rates = rates.select(F.col("source").alias("__s"), "source_size", "target", "rate")
    joined = sized.join(rates, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    draw = unit_hash(F.lit(seed), F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    whole = F.floor("rate")
    copies = F.least(whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0), F.lit(max_repeat))
    return joined.withColumn("copies", copies.cast("long")).drop("rate")


def mix(docs: DataFrame, seed: int = SEED, cycle: int = WEIGHT_CYCLE,
        max_repeat: int = MAX_REPEAT, share: float = BUDGET_SHARE) -> DataFrame:
    """The mixed corpus: the columns of docs, each document as many times as the mix takes it."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "source", "text")
    taken = with_copies(rows, seed, cycle, max_repeat, share).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("__row.*")
