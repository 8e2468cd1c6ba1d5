"""Hilbert curve as column expressions: no UDF, bit operations only.

``decode_cols`` follows Skilling's transform (first axis = x) for any number of
dimensions; ``encode_2d`` is its inverse for two dimensions. Both are single higher-order
expressions (``aggregate`` over the bit levels with an array or struct accumulator), so the
expression size does not grow with the number of bits and the optimiser can move filters
through them freely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pow2(k: Column) -> Column:
    return F.pow(F.lit(2.0), k).cast("long")


def _bit_at(h: Column, k: Column) -> Column:
    """Bit k of a non-negative long (exact: powers of two and values below 2^53)."""
    return F.floor(h / _pow2(k)).cast("long") % 2


def decode_cols(h: Column, bits: int, dims: int = 2) -> Column:
    """Array of ``dims`` coordinates of Hilbert index ``h``."""
    n = dims
    h = h.cast("long")
    zero = F.lit(0).cast("long")
    # transpose: bit j of X[i] is bit (j*n + n-1-i) of h
    X0 = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.aggregate(
            F.sequence(F.lit(0), F.lit(bits - 1)), zero,
            lambda acc, j: acc + _bit_at(h, j * n + (n - 1) - i) * _pow2(j),
        ),
    )
    # Gray decode: X[i] ^= X[i-1] (old values), X[0] ^= X[n-1] >> 1
    t = F.shiftright(F.get(X0, n - 1), 1)
    X1 = F.transform(X0, lambda v, i: F.when(i == 0, v.bitwiseXOR(t)).otherwise(v.bitwiseXOR(F.get(X0, i - 1))))
    steps = [(q, i) for q in [1 << k for k in range(1, bits)] for i in range(n - 1, -1, -1)]
    if not steps:
        return X1
    st = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q, i in steps])

    def undo(X, s):
        xi = F.get(X, s["i"])
        x0 = F.get(X, 0)
        p = s["q"] - 1
        has = xi.bitwiseAND(s["q"]) != 0
        tt = x0.bitwiseXOR(xi).bitwiseAND(p)
        return F.transform(X, lambda v, k: F.when(has, F.when(k == 0, v.bitwiseXOR(p)).otherwise(v)).otherwise(
            F.when((k == 0) | (k == s["i"]), v.bitwiseXOR(tt)).otherwise(v)))

    return F.aggregate(st, X1, undo)


def decode(df: DataFrame, index: str, bits: int, dims: int = 2, out=("x", "y", "z")) -> DataFrame:
    """Adds the cell coordinates of the Hilbert index column ``index`` as columns ``out``."""
    tmp = f"_hc_{out[0].strip('_')}"
    d = df.withColumn(tmp, decode_cols(F.col(index), bits, dims))
    for i in range(dims):
        d = d.withColumn(out[i], F.get(F.col(tmp), i))
    return d.drop(tmp)


def encode_cols(x: Column, y: Column, bits: int) -> Column:
    """Hilbert index of cell (x, y) on a 2-D curve (classic rotate form, top bit down)."""
    n = 1 << bits
    init = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    levels = F.array(*[F.lit(1 << k).cast("long") for k in range(bits - 1, -1, -1)])

    def level(acc, s):
        rx = F.when(acc["x"].bitwiseAND(s) > 0, 1).otherwise(0)
        ry = F.when(acc["y"].bitwiseAND(s) > 0, 1).otherwise(0)
        flip = (ry == 0) & (rx == 1)
        x1 = F.when(flip, F.lit(n - 1) - acc["x"]).otherwise(acc["x"])
        y1 = F.when(flip, F.lit(n - 1) - acc["y"]).otherwise(acc["y"])
        return F.struct(F.when(ry == 0, y1).otherwise(x1).alias("x"), F.when(ry == 0, x1).otherwise(y1).alias("y"),
                        (acc["d"] + s * s * (F.lit(3) * rx).bitwiseXOR(ry)).alias("d"))

    return F.aggregate(levels, init, level)["d"]


def encode_2d(df: DataFrame, x: str, y: str, bits: int, out: str = "d") -> DataFrame:
    """Adds the Hilbert index of cell (x, y) as column ``out`` (inverse of ``decode``)."""
    return df.withColumn(out, encode_cols(F.col(x), F.col(y), bits))


def points(spark, bits: int, dims: int = 2) -> DataFrame:
    """H1: every cell in curve order: d, x, y[, z] (2^(bits*dims) rows from ``spark.range``)."""
    return decode(spark.range(1 << (bits * dims)).withColumnRenamed("id", "d"), "d", bits, dims)
