"""Window / ordered operators and top-k."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def centre_out_key(rank: Column) -> Column:
    """W5 sort key: rank 0 in the middle, odd ranks descending before it, even ranks ascending after."""
    return F.when(rank % 2 == 1, -rank).otherwise(rank)


def centre_out(info: DataFrame, keys: Sequence[str] = ("year", "month"), topic: str = "topic",
               keep_outlier: bool = False, out: str = "topic_pos") -> DataFrame:
    """Display position of topics (ids are ranks by size); -1 last when kept, else dropped."""
    k = list(keys)
    real = F.col(topic) != -1
    src = info if keep_outlier else info.filter(real)
    sort_key = F.when(real, centre_out_key(F.col(topic))).otherwise(F.lit(None))
    w = Window.partitionBy(*k).orderBy(sort_key.asc_nulls_last())
    return src.withColumn(out, F.row_number().over(w).cast("long"))


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Rows range-partitioned by keys and order, with the partition's number as ``_pid``.

    A key with very many rows spans several partitions, so windows over (key, ``_pid``) hold no more than a
    partition, whatever the key's size. Checkpointed, so that the numbers stay fixed for all uses.
    """
    from newsloom.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(*keys, *order).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)


def _per_part(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """``keys..., _pid, _before``: ``value`` (an aggregate) of the key's earlier partitions, summed; a row per key and partition."""
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*keys, "_pid").agg(value.alias("_t"))
    return parts.select(*keys, "_pid", F.sum("_t").over(w).alias("_before"))


def _with_parts(rows: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on keys (null-safe) and partition number."""
    on = F.col("_pid") == F.col("_p__pid")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_p_{k}"))
    named = parts.select(*[F.col(c).alias(f"_p_{c}") for c in [*keys, "_pid"]], *[c for c in parts.columns if c not in (*keys, "_pid")])
    return rows.join(named, on).drop("_p__pid", *[f"_p_{k}" for k in keys])


def topic_boundary(df: DataFrame, keys: Sequence[str], order: Sequence[str], topic: str = "topic",
                   out: str = "topic_change") -> DataFrame:
    """Topic minus the previous row's topic in display order; first row 0."""
    rows = _ranged(df, keys, order)
    last = rows.groupBy(*keys, "_pid").agg(F.max_by(topic, F.struct(*order)).alias("_last"))
    prev = last.withColumn("_prev", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_pid"))).drop("_last")
    w = Window.partitionBy(*keys, "_pid").orderBy(*order)
    own = _with_parts(rows.withColumn("_lag", F.lag(topic).over(w)), prev, keys)
    return own.withColumn(out, F.coalesce(F.col(topic) - F.coalesce("_lag", "_prev"), F.lit(0))).drop("_pid", "_lag", "_prev")


def row_position(df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "row_pos") -> DataFrame:
    """Dense row number (from 0) after a sort, per key."""
    rows = _ranged(df, keys, order)
    w = Window.partitionBy(*keys, "_pid").orderBy(*order)
    own = _with_parts(rows.withColumn("_rn", F.row_number().over(w)), _per_part(rows, keys, F.count(F.lit(1))), keys)
    return own.withColumn(out, (F.col("_rn") - 1 + F.coalesce("_before", F.lit(0))).cast("long")).drop("_pid", "_rn", "_before")


def prob_centre(df: DataFrame, keys: Sequence[str], prob: str = "probabilities", doc: str = "doc_id",
                out: str = "doc_pos") -> DataFrame:
    """Documents with probability 1 in the middle (by doc); the others split by their
    position in doc order: even positions ascending by probability before, odd positions
    descending after. Unchanged (doc order) when none or all have probability 1."""
    k = list(keys)
    is1 = F.col(prob) == 1
    d = row_position(df.withColumn("_one", is1), [*k, "_one"], [doc], "_rp")
    total = df.groupBy(*k).agg(F.sum(F.when(is1, 1).otherwise(0)).alias("_ones"), F.count(F.lit(1)).alias("_n"))
    d = d.join(total, k)
    keep = (F.col("_ones") == 0) | (F.col("_ones") == F.col("_n"))
    grp = F.when(keep, 0).when(F.col("_one"), 1).when(F.col("_rp") % 2 == 0, 0).otherwise(2)
    p = F.col(prob)
    inner = F.when(keep, F.lit(0.0)).when(F.col("_one"), F.lit(0.0)).when(F.col("_rp") % 2 == 0, p).otherwise(-p)
    d = d.withColumn("_g", grp).withColumn("_in", inner).withColumn("_tie", F.when(F.col("_one") | keep, F.col(doc)).otherwise(F.col("_rp")))
    placed = row_position(d, k, ["_g", "_in", "_tie"], out)
    return placed.withColumn(out, F.col(out) + 1).drop("_ones", "_n", "_one", "_rp", "_g", "_in", "_tie")


def half_flip(info: DataFrame, keys: Sequence[str], topic: str = "topic", out: str = "topic_pos") -> DataFrame:
    """The top topic in the middle: ranks 1..h descending before it, the rest ascending after
    (h = number of non-top topics // 2); -1 dropped."""
    k = list(keys)
    real = info.filter(F.col(topic) != -1)
    n = F.count(F.lit(1)).over(Window.partitionBy(*k))
    r = F.col(topic)
    h = F.floor((F.col("_n") - 1) / 2)
    key = F.when(r == 0, F.lit(0)).when(r <= h, -r).otherwise(r)
    return real.withColumn("_n", n).withColumn(
        out, F.row_number().over(Window.partitionBy(*k).orderBy(key)).cast("long")).drop("_n")


def order_by_size(df: DataFrame, keys: Sequence[str], topic: str = "topic", doc: str = "doc_id",
                  outlier_last: bool = True, out: str = "order_pos") -> DataFrame:
    """Topics by size (largest first, ties by id), members in doc order; -1 at the end."""
    k = list(keys)
    sizes = df.groupBy(*k, topic).agg(F.count(F.lit(1)).alias("_sz"))
    d = df.join(sizes, [*k, topic])
    last = (F.col(topic) == -1) if outlier_last else F.lit(False)
    if not k:
        # whole-table order: a distributed sort with partition offsets, not a one-task window
        d = d.withColumn("_last", last).withColumn("_nsz", -F.col("_sz"))
        r = global_position(d, ["_last", "_nsz", topic, doc], "_p")
        return r.withColumn(out, F.col("_p") + 1).drop("_sz", "_last", "_nsz", "_p")
    d = d.withColumn("_last", last).withColumn("_nsz", -F.col("_sz"))
    placed = row_position(d, k, ["_last", "_nsz", topic, doc], out)
    return placed.withColumn(out, F.col(out) + 1).drop("_sz", "_last", "_nsz")


def order_centre(df: DataFrame, keys: Sequence[str], topic: str = "topic", doc: str = "doc_id",
                 out: str = "order_pos") -> DataFrame:
    """Topics by size, rank 0 = largest. Even ranks ascending by size, then odd ranks
    descending by size, -1 like any other topic unless it is the largest: then it is taken out and goes
    to the lighter side: more odd than even ranks -> front; fewer -> end; equal -> end when the
    first odd topic is at least as big as the last even one, else front."""
    k = list(keys)
    sizes = df.groupBy(*k, topic).agg(F.count(F.lit(1)).alias("_sz"))
    ranked = sizes.withColumn(
        "_r", F.row_number().over(Window.partitionBy(*k).orderBy(F.col("_sz").desc(), F.col(topic))) - 1)
    w_all = Window.partitionBy(*k)
    real = ~((F.col(topic) == -1) & (F.col("_r") == 0))
    even = real & (F.col("_r") % 2 == 0)
    odd = real & (F.col("_r") % 2 == 1)
    n_even = F.count_if(even).over(w_all)
    n_odd = F.count_if(odd).over(w_all)
    # first odd = smallest odd rank (largest odd size); last even = largest even rank (smallest even size)
    first_odd_size = F.min_by(F.when(odd, F.col("_sz")), F.when(odd, F.col("_r"))).over(w_all)
    last_even_size = F.max_by(F.when(even, F.col("_sz")), F.when(even, F.col("_r"))).over(w_all)
    has_out = F.max(F.when(~real, 1).otherwise(0)).over(w_all) == 1
    r = ranked.withColumn("_ne", n_even).withColumn("_no", n_odd).withColumn("_fo", first_odd_size).withColumn(
        "_le", last_even_size).withColumn("_ho", has_out)
    front = (F.col("_no") > F.col("_ne")) | ((F.col("_no") == F.col("_ne")) & ~(F.col("_fo") >= F.col("_le")))
    # sort key: (segment, position) ; segment 0 front outlier, 1 evens, 2 odds, 3 end outlier
    seg = F.when(~real, F.when(front, 0).otherwise(3)).when(F.col("_r") % 2 == 0, 1).otherwise(2)
    within = F.when(F.col("_r") % 2 == 0, F.col("_sz")).otherwise(-F.col("_sz"))
    t = r.select(*k, topic, seg.alias("_seg"), within.alias("_within"), F.col("_r"))
    d = df.join(t, k + [topic])
    placed = row_position(d, k, ["_seg", "_within", "_r", doc], out)
    return placed.withColumn(out, F.col(out) + 1).drop("_seg", "_within", "_r")


def global_position(df: DataFrame, order: Sequence[str], out: str = "row_pos") -> DataFrame:
    """0-based position of every row in a total order, computed without a single-task window.

    Rows are range-partitioned and sorted by ``order``; ``monotonically_increasing_id`` holds the partition and
    the place in it. Partition sizes (one row per partition) give the offsets by a running sum.
    """
    from newsloom.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    s = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    pid = F.shiftright("_mid", 33)
    sizes = s.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = sizes.withColumn(
        "_off", F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    ).select("_pid", F.coalesce("_off", F.lit(0)).alias("_off"))
    # offsets has one row per partition: a proven bound, broadcast
    return s.withColumn("_pid", pid).join(F.broadcast(offsets), "_pid").withColumn(
        out, (F.col("_off") + F.col("_mid") - F.shiftleft(F.col("_pid"), 33)).cast("long")).drop("_pid", "_mid", "_off")


def overlap_batches(df: DataFrame, order: Sequence[str], size: int = 3000, back: int = 1500,
                    out: str = "batch") -> DataFrame:
    """N div size batches (at least one); batch b holds rows [b*size - back, (b+1)*size),
    the last one runs to the end. A row in the back-overlap of the next batch is in both."""
    d = global_position(df, order, "row_pos")
    n = d.agg(F.count(F.lit(1))).scalar()
    last = F.greatest(F.floor(n / F.lit(size)) - 1, F.lit(0))
    own = F.least(F.floor(F.col("row_pos") / size), last)
    nxt = own + 1
    in_next = (nxt <= last) & (F.col("row_pos") >= nxt * size - back)
    batches = F.when(in_next, F.array(own, nxt)).otherwise(F.array(own))
    return d.withColumn(out, F.explode(batches)).withColumn(out, F.col(out).cast("long"))


def chunk_ranges(df: DataFrame, parts: int = 10) -> DataFrame:
    """``parts`` equal ranges of the row numbers 0..n-1 of ``df`` and one more with the
    rest (when there is one); n is a scalar subquery."""
    n = df.agg(F.count(F.lit(1))).scalar()
    step = F.floor(n / parts)
    r = df.sparkSession.range(parts + 1).select(
        F.col("id").alias("chunk"), (F.col("id") * step).alias("start"),
        F.when(F.col("id") == parts, F.lit(n)).otherwise((F.col("id") + 1) * step).alias("end"))
    return r.filter(F.col("start") < F.col("end"))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Cumulative sum per key in order (rows frame)."""
    rows = _ranged(df, keys, order)
    w = Window.partitionBy(*keys, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = _with_parts(rows.withColumn("_run", F.sum(value).over(w)), _per_part(rows, keys, F.sum(value)), keys)
    return own.withColumn(out, F.coalesce(F.col("_run") + F.col("_before"), F.col("_run"), F.col("_before"))).drop("_pid", "_run", "_before")


# ------------------------------------------------------------------------ top-k
def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """K3/K12 core: first k rows per key (row_number pushed below the sort by Spark's
    window-group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w).cast("long")).filter(F.col(out) <= k)


def dominant_topic(probs: Column) -> Column:
    """K6: struct(topic, prob) of the largest probability, first wins ties; nothing above 0 -> (-1, 0)."""
    m = F.array_max(probs)
    idx = (F.array_position(probs, m) - 1).cast("int")
    return F.when(m > 0, F.struct(idx.alias("topic"), m.alias("prob"))).otherwise(
        F.struct(F.lit(-1).alias("topic"), F.lit(0.0).alias("prob")))


def topics_above(probs: Column, t: float) -> Column:
    """K7: array of struct(topic, prob) with prob >= t; none -> [(-1, 0)]."""
    z = F.transform(probs, lambda p, i: F.struct(i.cast("int").alias("topic"), p.alias("prob")))
    f = F.filter(z, lambda s: s["prob"] >= t)
    return F.when(F.size(f) > 0, f).otherwise(
        F.array(F.struct(F.lit(-1).alias("topic"), F.lit(0.0).alias("prob"))))


def order_by_community(df: DataFrame, communities: DataFrame, keys: Sequence[str], node: str = "doc_id",
                       out: str = "order_pos") -> DataFrame:
    """Communities by size (largest first), members in id order: G5 then W8."""
    d = df.join(communities.withColumnRenamed("community", "_c"), list(keys) + [node])
    r = order_by_size(d, keys, "_c", node, outlier_last=False, out=out)
    return r.drop("_c")


def order_strategies():
    """Order strategies by name (the reference's ``calculate_order`` switch), each
    ``(df, keys) -> df`` with an ``order_pos`` column."""
    return {
        "important_topic": lambda df, keys: order_by_size(df, keys),
        "topic_center": lambda df, keys: order_centre(df, keys),
        "topic_similarity": lambda df, keys: row_position(df, keys, ["topic_pos", "doc_id"], "order_pos"),
    }
