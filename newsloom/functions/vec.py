"""Vector column expressions over ``array<double>``: all JVM-side, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def asum(c: Column) -> Column:
    """Sum of a numeric array."""
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return asum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(asum(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector gives 0 (as the reference's library does)."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def scale_by(a: Column, n: Column) -> Column:
    """Divide every element by a scalar column (a zero divisor gives 0)."""
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)))


def normalise_df(df, col: str, out: str):
    """Unit vectors in ``out``; the norm is projected once per row, not once per element."""
    return df.withColumn("_norm", norm(F.col(col))).withColumn(out, scale_by(F.col(col), F.col("_norm"))).drop("_norm")


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(asum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return asum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def _bound(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once per row: a lambda evaluates an expression from outside again for every element."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def softmax(a: Column) -> Column:
    """class probabilities from logits, stable form exp(x - max)."""
    def shares(e: Column) -> Column:
        return _bound(asum(e), lambda s: F.transform(e, lambda x: x / s))

    def of(v: Column) -> Column:
        return _bound(_bound(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m))), shares)

    return _bound(a, of)
