"""Time-window predicates over review timestamps (P1) and window labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark import config as C


def cutoff(as_of: str, months: int) -> Column:
    """as_of - n months, keeping the time of day and clipping month ends."""
    return F.expr(f"timestamp'{as_of}' - make_ym_interval(0, {int(months)})")


def period_split(df: DataFrame, as_of: str = C.DEFAULT_AS_OF, limit_months: int = 0, ts: str = "at") -> DataFrame:
    """Tag rows with period 'cur' (at >= as_of - n) or 'prev' ([as_of - 2n, as_of - n)).

    n = 0 -> every row is current, no previous window. Rows outside both
    windows, or without a valid timestamp, are dropped; the timestamp predicate is
    pushed into the scan.
    """
    n = int(limit_months)
    if n <= 0:
        return df.withColumn("period", F.lit("cur"))
    c1, c2 = cutoff(as_of, n), cutoff(as_of, 2 * n)
    t = F.col(ts) if dict(df.dtypes).get(ts) == "timestamp" else F.col(ts).try_cast("timestamp")  # F34
    x = df.filter(t >= c2)
    return x.withColumn("period", F.when(t >= c1, F.lit("cur")).otherwise(F.lit("prev")))


def window_label(limit_months: int, compact: bool = False) -> Column:
    """'Last nM' / 'All Time' (compact: 'LastnM' / 'AllTime')."""
    if limit_months > 0:
        return F.lit(f"Last{limit_months}M" if compact else f"Last {limit_months}M")
    return F.lit("AllTime" if compact else "All Time")
