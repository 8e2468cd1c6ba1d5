"""Scalar column functions of the plotting and labelling steps."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def marker_size(x: Column, keys=(), lo: float = 6.0, hi: float = 16.0) -> Column:
    """linear rescale of x to [lo, hi] within ``keys`` (window min/max); all equal -> lo."""
    w = Window.partitionBy(*keys)
    mn, mx = F.min(x).over(w), F.max(x).over(w)
    return F.lit(lo) + F.coalesce(F.try_divide(x - mn, mx - mn), F.lit(0.0)) * (hi - lo)


def marker_size_inv(x: Column, tam: float) -> Column:
    """(1 - 1/x) * tam + 1."""
    return (F.lit(1.0) - F.lit(1.0) / x) * tam + 1


def topic_label(topic: Column, words: Column, n: int = 5, width: int = 40) -> Column:
    """``Topic i: w1_w2_..._wn`` cut to ``width`` characters plus ``...`` when longer."""
    full = F.concat(F.lit("Topic "), topic.cast("string"), F.lit(": "), F.array_join(F.slice(words, 1, n), "_"))
    return F.when(F.length(full) > width, F.concat(F.substring(full, 1, width), F.lit("..."))).otherwise(full)


def edge_width(w: Column) -> Column:
    """F8: 0.3 * w^1.75 for w > 0 (NULL otherwise)."""
    return F.when(w > 0, F.lit(0.3) * F.pow(w, 1.75))


def month_prefix(y: Column, m: Column) -> Column:
    """``'2016_9_'``."""
    return F.concat(y.cast("string"), F.lit("_"), m.cast("string"), F.lit("_"))


def polarity(id1: Column, id2: Column) -> Column:
    """+1 when id1 + id2 is odd, else -1."""
    return F.when(F.pmod(id1 + id2, F.lit(2)) == 1, F.lit(1)).otherwise(F.lit(-1))


def valid_date(d: Column, m: Column, y: Column) -> Column:
    """whether (d, m, y) is a calendar date (no ANSI error on invalid input)."""
    s = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.try_to_date(s, "yyyy-MM-dd").isNotNull()
