"""Customer-value scalar functions (F13–F18) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark import config as C
from vocspark.sources.tables import resolve_alias


def tier_weight(tier: Column, weights: dict[str, float] | None = None) -> Column:
    """lower-cased tier -> weight; unknown or null tier -> 1.0."""
    weights = weights or C.TIER_WEIGHTS
    t = F.lower(tier.cast("string"))
    expr = F.lit(1.0)
    for name, w in reversed(list(weights.items())):
        expr = F.when(t == F.lit(name), F.lit(float(w))).otherwise(expr)
    return expr


def clv_factor(clv: Column) -> Column:
    """1 + ln(1 + clv/100) when clv parses and is > 0, else 1 (bad text ignored)."""
    x = clv.try_cast("double")
    return F.when(x.isNotNull() & (x > 0), F.lit(1.0) + F.log1p(x / F.lit(100.0))).otherwise(F.lit(1.0))


def hash_bucket(key: Column) -> Column:
    """F16 helper: int(md5(key), 16) % 100 without big integers.

    md5 hex is folded in four 8-hex-digit chunks: acc = (acc * 16^8 + chunk) % 100,
    and 16^8 % 100 = 96.
    """
    h = F.md5(key.cast("string"))
    acc = F.lit(0).cast("long")
    for i in range(4):
        chunk = F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")
        acc = (acc * F.lit(96) + chunk) % F.lit(100)
    return acc


def hash_tier(key: Column, buckets=None) -> Column:
    """F16: simulated tier weight from md5(key) mod 100 (3/12/25/45/15 % buckets)."""
    buckets = buckets or C.HASH_TIER_BUCKETS
    b = hash_bucket(key)
    expr = None
    for upper, w in reversed(buckets):
        expr = F.lit(float(w)) if expr is None else F.when(b < F.lit(upper), F.lit(float(w))).otherwise(expr)
    return expr


def value_weight(df: DataFrame, tier_aliases=None, clv_aliases=None, out: str = "value_weight") -> DataFrame:
    """tier weight x CLV factor, 2 dp; hash tier when neither column exists.

    Column names are resolved case-insensitively on the driver (schema only).
    """
    tier_col = resolve_alias(df.columns, tier_aliases or C.TIER_ALIASES, case_insensitive=True)
    clv_col = resolve_alias(df.columns, clv_aliases or C.CLV_ALIASES, case_insensitive=True)
    if tier_col is None and clv_col is None:
        w = hash_tier(F.col(df.columns[0]))
    else:
        w = tier_weight(F.col(tier_col)) if tier_col else F.lit(1.0)
        if clv_col:
            w = w * clv_factor(F.col(clv_col))
    return df.withColumn(out, F.round(w, 2))


def financial_impact(severity: Column, weight: Column) -> Column:
    """severity x value weight, 2 dp.

    Computed in DECIMAL so that exact half-cent ties (2.5 x 27.99 = 69.975)
    round half-up identically in every engine, then returned as DOUBLE.
    """
    prod = severity.cast("decimal(12,2)") * weight.cast("decimal(12,2)")
    return F.round(prod, 2).cast("double")


def rating_sentiment(score: Column) -> Column:
    """rating <= 2 -> negative, else positive."""
    return F.when(score <= 2, F.lit("negative")).otherwise(F.lit("positive"))
