"""Curve layout of the document graph.

Positions are closed forms of the reference's walk: the running spacing S of a document
(a window sum per month) picks the cell floor(S) and the fraction towards the next cell;
cells are decoded from their index with column bit operations, never looked up in a list.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import hilbert

MONTH = ["year", "month"]


def spacing_uniform(df: DataFrame, keys: Sequence[str], boundary: str, cells: int, mul: float = 1) -> DataFrame:
    """H3: mul = 1: (H-1)/n everywhere; else s = (H-1)/(n + mul(T-1)) and topic starts
    (boundary != 0) get ((H-1) - n*s)/(T-1) + s. Adds ``spacing``."""
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    t = F.sum(F.when(F.col(boundary) != 0, 1).otherwise(0)).over(w) + 1
    h1 = F.lit(float(cells - 1))
    if mul == 1:
        return df.withColumn("spacing", h1 / n)
    s = h1 / (n + F.lit(mul) * (t - 1))
    start = F.coalesce(F.try_divide(h1 - n * s, (t - 1).cast("double")), F.lit(0.0)) + s
    return df.withColumn("spacing", F.when(F.col(boundary) != 0, start).otherwise(s))


def spacing_similarity(df: DataFrame, keys: Sequence[str], order: Sequence[str], topic: str, cells: int,
                       mul: float = 100, doc_sim: str = "similarity_previous_document",
                       topic_sim: str = "similarity_previous_topic") -> DataFrame:
    """H4: inside a topic the spacing is proportional to the similarity to the previous
    document (topic total (m-1)*s); topic starts share the rest of the curve in proportion
    to their similarity to the previous topic; the first row is 0. 0/0 -> 0. Negative
    similarities count as 0 (a negative spacing would walk the curve backwards). Adds ``spacing``."""
    k = list(keys)
    w_all = Window.partitionBy(*k)
    w_topic = Window.partitionBy(*k, topic)
    first_in_topic = F.row_number().over(Window.partitionBy(*k, topic).orderBy(*order)) == 1
    d = df.withColumn("_first", first_in_topic)
    n = F.count(F.lit(1)).over(w_all)
    t = F.sum(F.col("_first").cast("int")).over(w_all)
    h1 = F.lit(float(cells - 1))
    d = d.withColumn("_s", h1 / (n + F.lit(mul) * (t - 1)))
    sim = F.when(F.col("_first"), F.lit(0.0)).otherwise(F.greatest(F.col(doc_sim), F.lit(0.0)))
    d = d.withColumn("_sim", sim)
    value = F.sum("_sim").over(w_topic)
    total = (F.count(F.lit(1)).over(w_topic) - 1) * F.col("_s")
    d = d.withColumn("_in", F.coalesce(F.try_divide(F.col("_sim") * total, value), F.lit(0.0)))
    first_topic = F.min(F.struct(*[F.col(o) for o in order])).over(w_all)
    d = d.withColumn("_tstart", F.col("_first") & (F.struct(*[F.col(o) for o in order]) != first_topic))
    dif = h1 - F.sum("_in").over(w_all)
    tsim = F.greatest(F.col(topic_sim), F.lit(0.0))
    tsum = F.sum(F.when(F.col("_tstart"), tsim).otherwise(0.0)).over(w_all)
    share = F.coalesce(F.try_divide(tsim * dif, tsum), F.lit(0.0))
    d = d.withColumn("spacing", F.when(F.col("_tstart"), share).otherwise(F.col("_in")))
    return d.drop("_first", "_s", "_sim", "_in", "_tstart")


def place_on_curve(df: DataFrame, keys: Sequence[str], order: Sequence[str], cells_bits: int,
                   spacing: str = "spacing") -> DataFrame:
    """H5 + H6 (2-D): S = running spacing per key in order (rounded to 9 places), cell
    i = floor(S), f = S - i, point = P[i] + f (P[i+1] - P[i]); past the end -> last cell.
    Adds ``run``, ``x``, ``y``."""
    cells = 1 << (2 * cells_bits)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("run", F.round(F.sum(spacing).over(w), 9))
    i = F.floor("run")
    past = i >= cells - 1
    d = d.withColumn("_i", F.when(past, F.lit(cells - 1)).otherwise(i)).withColumn(
        "_f", F.when(past, F.lit(0.0)).otherwise(F.col("run") - i)).withColumn(
        "_j", F.least(F.col("_i") + 1, F.lit(cells - 1)))
    d = hilbert.decode(d, "_i", cells_bits, 2, ("_x0", "_y0"))
    d = hilbert.decode(d, "_j", cells_bits, 2, ("_x1", "_y1"))
    d = d.withColumn("x", F.col("_x0") + F.col("_f") * (F.col("_x1") - F.col("_x0"))).withColumn(
        "y", F.col("_y0") + F.col("_f") * (F.col("_y1") - F.col("_y0")))
    return d.drop("_i", "_f", "_j", "_x0", "_y0", "_x1", "_y1")


def equal_walk(df: DataFrame, keys: Sequence[str], order: Sequence[str], cells_bits: int) -> DataFrame:
    """H7: n points at equal path distance along the whole curve (first cell to last)."""
    cells = 1 << (2 * cells_bits)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    d = df.withColumn("spacing", F.when(first, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.lit(float(cells - 1)), (n - 1).cast("double")), F.lit(0.0))))
    return place_on_curve(d, keys, order, cells_bits)


def bezier_edges(edges: DataFrame, pos: DataFrame, keys: Sequence[str] = (), ratio: float = 0.2,
                 steps: int = 20, node: str = "doc_id") -> DataFrame:
    """H8: a cubic curve per edge: ends ordered by x; control points at ratio * length along
    the edge and the same distance along the perpendicular, on the side given by F11.

    The perpendicular is built as a vector (no slope), so vertical, horizontal and
    zero-length edges are defined. Output: keys..., id1, id2, step, x, y.
    """
    k = list(keys)
    p1 = pos.select(*k, F.col(node).alias("id1"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    p2 = pos.select(*k, F.col(node).alias("id2"), F.col("x").alias("bx"), F.col("y").alias("by"))
    e = edges.select(*k, "id1", "id2").join(p1, k + ["id1"]).join(p2, k + ["id2"])
    swap = F.col("ax") > F.col("bx")
    e = e.select(*k, "id1", "id2",
                 F.when(swap, F.col("bx")).otherwise(F.col("ax")).alias("x0"), F.when(swap, F.col("by")).otherwise(F.col("ay")).alias("y0"),
                 F.when(swap, F.col("ax")).otherwise(F.col("bx")).alias("x3"), F.when(swap, F.col("ay")).otherwise(F.col("by")).alias("y3"))
    dx, dy = F.col("x3") - F.col("x0"), F.col("y3") - F.col("y0")
    length = F.sqrt(dx * dx + dy * dy)
    e = e.withColumn("_ux", F.coalesce(F.try_divide(dx, length), F.lit(0.0))).withColumn(
        "_uy", F.coalesce(F.try_divide(dy, length), F.lit(0.0))).withColumn("_dist", F.lit(ratio) * length)
    # perpendicular: (uy, -ux) when dy >= 0, else (-uy, ux)
    up = F.col("y3") >= F.col("y0")
    e = e.withColumn("_px", F.when(up, F.col("_uy")).otherwise(-F.col("_uy"))).withColumn(
        "_py", F.when(up, -F.col("_ux")).otherwise(F.col("_ux")))
    pol = F.when(F.pmod(F.col("id1") + F.col("id2"), F.lit(2)) == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    off_x = pol * F.col("_dist") * F.col("_px")
    off_y = pol * F.col("_dist") * F.col("_py")
    e = e.withColumn("x1", F.col("x0") + F.col("_dist") * F.col("_ux") + off_x).withColumn(
        "y1", F.col("y0") + F.col("_dist") * F.col("_uy") + off_y).withColumn(
        "x2", F.col("x3") - F.col("_dist") * F.col("_ux") + off_x).withColumn(
        "y2", F.col("y3") - F.col("_dist") * F.col("_uy") + off_y)
    e = e.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    t = F.col("step") / F.lit(float(steps - 1))
    u = F.lit(1.0) - t

    def bern(a, b, c, d):
        return u * u * u * F.col(a) + 3 * u * u * t * F.col(b) + 3 * u * t * t * F.col(c) + t * t * t * F.col(d)

    return e.select(*k, "id1", "id2", F.col("step").cast("long").alias("step"),
                    bern("x0", "x1", "x2", "x3").alias("x"), bern("y0", "y1", "y2", "y3").alias("y"))


def topic_bbox(pos: DataFrame, keys: Sequence[str], topic: str = "topic") -> DataFrame:
    """Closed 5-point rectangle per topic: x = [min, max, max, min, min], y = [min, min, max, max, min]."""
    b = pos.groupBy(*keys, topic).agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"),
                                      F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    return b.select(*keys, topic, "x_min", "x_max", "y_min", "y_max",
                    F.array("x_min", "x_max", "x_max", "x_min", "x_min").alias("xs"),
                    F.array("y_min", "y_min", "y_max", "y_max", "y_min").alias("ys"))


def edge_segments(edges: DataFrame, pos: DataFrame, keys: Sequence[str] = (), node: str = "doc_id") -> DataFrame:
    """H9: x0, y0, x1, y1 and width 0.3 * w^1.75 per edge."""
    k = list(keys)
    p1 = pos.select(*k, F.col(node).alias("id1"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    p2 = pos.select(*k, F.col(node).alias("id2"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    e = edges.join(p1, k + ["id1"]).join(p2, k + ["id2"])
    return e.select(*k, "id1", "id2", "x0", "y0", "x1", "y1",
                    F.when(F.col("weight") > 0, F.lit(0.3) * F.pow("weight", 1.75)).alias("width"))
