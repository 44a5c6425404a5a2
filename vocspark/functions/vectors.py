"""Dense-vector scalar functions (F20–F22) over ARRAY<DOUBLE> columns.

Native higher-order functions (zip_with / aggregate / transform) keep the math
inside the JVM; no UDF. `vector_cosine_similarity` does not exist in this
Spark, so dot products are folds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x * x), F.lit(0.0), lambda acc, v: acc + v))


def scale_by(a, d: Column) -> Column:
    """Element-wise a / d with d evaluated once per row.

    A lambda that referenced `d` directly would re-evaluate it for every
    element (lambdas get no common-subexpression elimination), so d is
    repeated into an array first and zipped in.
    """
    a = _c(a)
    return F.zip_with(a, F.array_repeat(d, F.size(a)), lambda x, y: x / y)


def normalize(a, eps: float = 0.0) -> Column:
    """L2-normalise; a zero vector is divided by 1 (eps = 0) or kept finite by eps > 0."""
    n = norm(a)
    d = (n + F.lit(eps)) if eps > 0 else F.when(n == 0, F.lit(1.0)).otherwise(n)
    return scale_by(a, d)


def cosine(a, b) -> Column:
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / d)


def scale(a, k) -> Column:
    return F.transform(_c(a), lambda x: x * _c(k))


def argmax(scores: Column) -> Column:
    """Index-stable argmax as struct(s, ni) with ni = -index (ties go to the first element).
    Materialise it in its own column before reading both fields."""
    return F.array_max(F.transform(scores, lambda s, i: F.struct(s.alias("s"), (-i).alias("ni"))))
