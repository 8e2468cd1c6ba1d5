"""Vector and similarity operators.

All-pairs work never goes through a nested-loop join: rows get a block id from a hash of
their id, every row is copied to the block pairs it takes part in, and each block pair is
one task that multiplies two bounded matrices with numpy (Arrow batches in and out).
The block count of a group grows with the group's size, so a hot group (one month holding
a third of all rows) is split into as many tasks as it needs. Above ``FEW_BLOCKS`` blocks the
blocks grow first, up to ``FEW_BLOCKS`` times, since a row is copied once per block; a task
holds a stripe of a block pair's product at a time.
"""

from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import vec

DEFAULT_BLOCK_ROWS = 2048
#: Blocks of a group before its blocks grow, and how many times larger they get.
FEW_BLOCKS = 8
#: Similarities that a task holds at a time.
STRIPE_CELLS = 1 << 21


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def block_pairs(
    vectors: DataFrame,
    id_col: str,
    vec_col: str,
    keys: Sequence[str] = (),
    block_rows: int = DEFAULT_BLOCK_ROWS,
    few: int = FEW_BLOCKS,
) -> DataFrame:
    """Copy every row to the block pairs ``(b1 <= b2)`` of its group it belongs to.

    Output: keys..., ``_b1, _b2, _side`` (0 = block b1, 1 = block b2), ``id``, ``u``.
    Blocks per group = ceil(group rows / block_rows), read from a per-group count
    (one row per group) joined back on the group key; above ``few`` blocks, blocks of up to
    ``few * block_rows`` rows, so that a row has ``few`` copies until they are full.
    """
    k = list(keys)
    base = vectors.select(*k, F.col(id_col).alias("id"), F.col(vec_col).alias("u"))
    gk = k if k else ["_g"]

    def blocks(n):
        return F.greatest(F.lit(1), F.least(F.lit(few), F.ceil(n / F.lit(block_rows))), F.ceil(n / F.lit(few * block_rows))).cast("int")

    nb = blocks(F.count(F.lit(1)))
    if k:
        # one row per group: the block count grows with the group's own size
        sized = base.join(base.groupBy(*k).agg(nb.alias("_nb")), k)
    else:
        # a single group: the block count is a scalar subquery (no join); at least enough
        # blocks that the B(B+1)/2 block pairs give every core two tasks
        par = vectors.sparkSession.sparkContext.defaultParallelism
        b_min = 1
        while b_min * (b_min + 1) // 2 < 2 * par:
            b_min += 1
        n_rows = base.agg(F.count(F.lit(1))).scalar()
        b_expr = F.greatest(F.least(F.lit(b_min), n_rows.cast("int")), blocks(n_rows))
        sized = base.withColumn("_g", F.lit(0)).withColumn("_nb", b_expr.cast("int"))
    b = F.pmod(F.xxhash64("id"), F.col("_nb")).cast("int")
    rep = (
        sized
        .withColumn("_b", b)
        .withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
        .select(
            *gk,
            F.least("_b", "_c").alias("_b1"),
            F.greatest("_b", "_c").alias("_b2"),
            F.when(F.col("_b") <= F.col("_c"), 0).otherwise(1).alias("_side"),
            "id",
            "u",
        )
    )
    return rep


def per_block_pair(rep: DataFrame, keys: Sequence[str], fields: Sequence[tuple[str, T.DataType]], fn) -> DataFrame:
    """``fn(ids, vectors, other_ids, other_vectors, same)`` for every block pair, both sides in id order, a block against
    itself with ``same``. It yields lists of columns for ``fields``, so a task never holds a whole product or its result."""
    k = list(keys)
    schema = T.StructType(_key_fields(rep, k) + [T.StructField(n, t) for n, t in fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        group = [table.column(c)[0] for c in k]
        pdf = table.select(["_b1", "_b2", "_side", "id", "u"]).to_pandas().sort_values("id", kind="stable")
        del table
        same = bool(pdf["_b1"].iloc[0] == pdf["_b2"].iloc[0])
        sides = [pdf] if same else [pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]]
        if not all(len(x) for x in sides):
            return
        (li, L), (ri, R) = ([(x["id"].to_numpy(np.int64), np.stack(x["u"].to_numpy()).astype(np.float64)) for x in sides] * 2)[:2]
        del pdf, sides
        for cols in fn(li, L, ri, R, same):
            if n := len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.repeat(g, n) for g in group] + [pa.array(c) for c in cols], names=names)

    return rep.groupBy(*k, "_b1", "_b2").applyInArrow(run, schema)


def stripes(L: np.ndarray, R: np.ndarray):
    """(first row, product of some rows of L with all of R), at most about ``STRIPE_CELLS`` cells each."""
    step = max(1, STRIPE_CELLS // max(1, len(R)))
    for s in range(0, len(L), step):
        yield s, L[s:s + step] @ R.T


def cosine_pairs(
    vectors: DataFrame,
    id_col: str = "doc_id",
    vec_col: str = "v",
    threshold: float | None = None,
    keys: Sequence[str] = (),
    include_self: bool = False,
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """V8: all-pairs cosine ``keys..., id1 < id2, weight`` (weight >= threshold when given).

    Vectors are normalised once (a zero vector gives cosine 0). ``include_self`` adds
    ``(i, i, 1.0)`` rows for non-zero vectors (0 for zero vectors).
    """
    k = list(keys)
    unit = vec.normalise_df(vectors.select(*k, F.col(id_col), F.col(vec_col).alias("_v")), "_v", "_u").drop("_v")
    rep = block_pairs(unit, id_col, "_u", k, block_rows)
    gk = k if k else ["_g"]
    t = threshold

    def fn(li, L, ri, R, same):
        for s, S in stripes(L, R):
            at = li[s:s + len(S)]
            mask = np.ones(S.shape, dtype=bool) if t is None else S >= t
            if same:
                mask &= at[:, None] <= ri[None, :] if include_self else at[:, None] < ri[None, :]
            ii, jj = np.nonzero(mask)
            a, b = at[ii], ri[jj]
            yield np.minimum(a, b), np.maximum(a, b), np.clip(S[ii, jj], -1.0, 1.0)

    pairs = per_block_pair(rep, gk, [("id1", T.LongType()), ("id2", T.LongType()), ("weight", T.DoubleType())], fn)
    pairs = pairs.withColumn("weight", F.when(F.col("id1") == F.col("id2"), F.lit(1.0)).otherwise(F.col("weight"))) if include_self else pairs
    if not k:
        pairs = pairs.drop("_g")
    return pairs


def both_directions(pairs: DataFrame) -> DataFrame:
    """Pairs ``id1, id2, weight`` in either direction, a self pair once; the product that makes them runs once."""
    one, other = F.struct("id1", "id2"), F.struct(F.col("id2").alias("id1"), F.col("id1").alias("id2"))
    each = F.explode(F.when(F.col("id1") == F.col("id2"), F.array(one)).otherwise(F.array(one, other)))
    return pairs.select(each.alias("_p"), "weight").select("_p.id1", "_p.id2", "weight")


def component_edges(vectors: DataFrame, threshold: float, id_col: str = "doc_id", vec_col: str = "v",
                    keys: Sequence[str] = (), block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Edges ``keys..., id1, id2`` with the connected components of the pairs with cosine >= threshold: a block pair's
    links are joined in its task, which leaves one edge per row at most, however many pairs there are."""
    k = list(keys)
    unit = vec.normalise_df(vectors.select(*k, F.col(id_col), F.col(vec_col).alias("_v")), "_v", "_u").drop("_v")
    rep = block_pairs(unit, id_col, "_u", k, block_rows)

    def fn(li, L, ri, R, same):
        ids, shift = (li, 0) if same else (np.r_[li, ri], len(li))
        root = np.arange(len(ids))
        for s, S in stripes(L, R):
            a, b = np.nonzero(S >= threshold)
            a, b = a + s, b + shift
            while len(a):
                low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
                open_ = low < high
                a, b = a[open_], b[open_]
                np.minimum.at(root, high[open_], low[open_])
                while not np.array_equal(root, up := root[root]):
                    root = up
        child = np.flatnonzero(root != np.arange(len(ids)))
        a, b = ids[root[child]], ids[child]
        yield a[a != b], b[a != b]

    edges = per_block_pair(rep, k or ["_g"], [("id1", T.LongType()), ("id2", T.LongType())], fn)
    return edges if k else edges.drop("_g")


def neighbour_count(vectors: DataFrame, threshold: float, id_col: str = "doc_id", vec_col: str = "v",
                    keys: Sequence[str] = (), block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Documents with similarity >= t, itself included: ``keys..., id_col, size``."""
    k = list(keys)
    unit = vec.normalise_df(vectors.select(*k, F.col(id_col), F.col(vec_col).alias("_v")), "_v", "_u").drop("_v")
    rep = block_pairs(unit, id_col, "_u", k, block_rows)

    def fn(li, L, ri, R, same):
        right = np.zeros(len(ri), np.int64)
        for s, S in stripes(L, R):
            at = li[s:s + len(S)]
            mask = S >= threshold
            if same:
                mask &= at[:, None] != ri[None, :]
            right += mask.sum(axis=0)
            if not same:
                yield at, mask.sum(axis=1)
        yield ri, right

    # counted in the tasks: a row per row and block, not one per pair
    parts = per_block_pair(rep, k or ["_g"], [("id", T.LongType()), ("m", T.LongType())], fn).filter("m > 0")
    cnt = parts.groupBy(*k, F.col("id").alias(id_col)).agg(F.sum("m").alias("_m"))
    return (
        vectors.select(*k, id_col)
        .join(cnt, k + [id_col], "left")
        .select(*k, id_col, (F.lit(1) + F.coalesce(F.col("_m"), F.lit(0))).cast("long").alias("size"))
    )


def vector_mean(df: DataFrame, keys: Sequence[str], vec_col: str = "v", out: str = "centroid") -> DataFrame:
    """Element-wise mean vector per key (partial aggregation map-side, no vector collect).

    Vectors are exploded to (position, value), averaged per (key, position) and packed back
    in position order; the packed array holds one vector per key, never a group's rows.
    """
    k = list(keys)
    long = df.select(*k, F.posexplode(vec_col).alias("_p", "_x"))
    per = long.groupBy(*k, "_p").agg(F.avg("_x").alias("_m"))
    return per.groupBy(*k).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias(out),
        F.count(F.lit(1)).alias("_dims"),
    ).drop("_dims")


def best_partner(
    vectors: DataFrame,
    id_col: str = "doc_id",
    vec_col: str = "v",
    keys: Sequence[str] = (),
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """Most similar other row per row: ``keys..., id, best_id, best_sim`` (ties -> smallest id).

    Each block-pair task keeps only the best partner of each of its rows, so the shuffle
    after the product carries (rows x blocks), not all pairs. Rows without any partner
    (a group of one) get best_id -1 and best_sim NULL.
    """
    k = list(keys)
    unit = vec.normalise_df(vectors.select(*k, F.col(id_col), F.col(vec_col).alias("_v")), "_v", "_u").drop("_v")
    rep = block_pairs(unit, id_col, "_u", k, block_rows)
    gk = k if k else ["_g"]

    def fn(li, L, ri, R, same):
        right, right_id = np.full(len(ri), -np.inf), np.zeros(len(ri), np.int64)
        for s, S in stripes(L, R):
            at = li[s:s + len(S)]
            if same:
                S[at[:, None] == ri[None, :]] = -np.inf
            # ids are in order, so the first maximum has the smallest one
            j = np.argmax(S, axis=1)
            best = S[np.arange(len(S)), j]
            ok = np.isfinite(best)
            yield at[ok], ri[j][ok], best[ok]
            if not same:
                i = np.argmax(S, axis=0)
                best = S[i, np.arange(len(ri))]
                better = (best > right) | np.isnan(best)
                right, right_id = np.where(better, best, right), np.where(better, at[i], right_id)
        ok = np.isfinite(right)
        yield ri[ok], right_id[ok], right[ok]

    cands = per_block_pair(rep, gk, [("id", T.LongType()), ("best_id", T.LongType()), ("best_sim", T.DoubleType())], fn)
    best = cands.groupBy(*gk, "id").agg(
        F.max(F.struct(F.col("best_sim"), (-F.col("best_id")).alias("_nid"))).alias("_b"))
    best = best.select(*gk, F.col("id"), (-F.col("_b._nid")).alias("best_id"), F.col("_b.best_sim").alias("best_sim"))
    allids = unit.select(*k, F.col(id_col).alias("id"))
    if not k:
        best = best.drop("_g")
    return allids.join(best, k + ["id"], "left").select(
        *k, "id", F.coalesce("best_id", F.lit(-1).cast("long")).alias("best_id"), "best_sim")


def one_vs_all(vectors: DataFrame, query_id, id_col: str = "doc_id", vec_col: str = "v") -> DataFrame:
    """K9: cosine of one row's vector with every row (the one vector is a scalar subquery)."""
    q = vectors.filter(F.col(id_col) == query_id).select(vec_col).scalar()
    # the scalar subquery is projected into a column first: lambdas cannot hold subqueries
    with_q = vectors.select(id_col, vec_col, q.alias("_q"))
    return with_q.select(id_col, vec.cosine(F.col(vec_col), F.col("_q")).alias("cosine"))


METRICS = ("pearson_corr", "spearman_corr", "kendalltau_corr", "cosine_similarity", "euclidean_distance",
           "manhattan_distance")


#: Rows of either side whose six metrics a task holds at a time.
METRIC_ROWS = 512
#: Sign columns of element pairs that a block holds at a time.
SIGN_COLUMNS = 4096


def _avg_ranks(X: np.ndarray) -> np.ndarray:
    """Average ranks (1-based, ties share their mean rank) of every row."""
    order = np.argsort(X, axis=1, kind="stable")
    xs = np.take_along_axis(X, order, axis=1)
    at = np.broadcast_to(np.arange(X.shape[1]), X.shape)
    step = xs[:, 1:] != xs[:, :-1]
    edge = np.ones((X.shape[0], 1), dtype=bool)
    first = np.maximum.accumulate(np.where(np.hstack([edge, step]), at, 0), axis=1)
    last = np.minimum.accumulate(np.where(np.hstack([step, edge]), at, X.shape[1])[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(X.shape, dtype=np.float64)
    np.put_along_axis(out, order, (first + last) / 2.0 + 1.0, axis=1)
    return out


def _kendall(A: np.ndarray, B: np.ndarray) -> np.ndarray:
    """Kendall tau-b of all rows of A with all rows of B: products of element-pair signs, ``SIGN_COLUMNS`` pairs at a
    time, so memory doesn't grow with the square of the vectors' length. Constant rows give NaN."""
    d = A.shape[1]
    total, na, nb = np.zeros((len(A), len(B))), np.zeros(len(A)), np.zeros(len(B))
    ends = np.cumsum(np.arange(d - 1, 0, -1))
    for s in range(0, d * (d - 1) // 2, SIGN_COLUMNS):
        pair = np.arange(s, min(s + SIGN_COLUMNS, d * (d - 1) // 2))
        i = np.searchsorted(ends, pair, "right")
        j = pair - (ends[i] - (d - 1 - i)) + i + 1
        # sums of at most SIGN_COLUMNS signs are exact in single precision
        sa, sb = (np.sign(X[:, j] - X[:, i]).astype(np.float32) for X in (A, B))
        total += sa @ sb.T
        na += np.abs(sa).sum(axis=1, dtype=np.float64)
        nb += np.abs(sb).sum(axis=1, dtype=np.float64)
    size = np.sqrt(na)[:, None] * np.sqrt(nb)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(size > 0, total / size, np.nan)


def _unit_rows(X: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(X, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, X / np.where(n > 0, n, 1.0), np.nan)


def _features(X: np.ndarray) -> dict:
    """Per-vector forms prepared once: centred-unit (Pearson), rank-centred-unit (Spearman),
    unit vector (cosine), squared norm."""
    C = X - X.mean(axis=1, keepdims=True)
    Rk = _avg_ranks(X)
    Rc = Rk - Rk.mean(axis=1, keepdims=True)
    n = np.linalg.norm(X, axis=1, keepdims=True)
    U = np.where(n > 0, X / np.where(n > 0, n, 1.0), 0.0)
    return {"P": _unit_rows(C), "S": _unit_rows(Rc), "U": U, "sq": (X * X).sum(axis=1), "X": X}


def _metric_block(A: dict, B: dict) -> dict:
    out = {
        "pearson_corr": A["P"] @ B["P"].T,
        "spearman_corr": A["S"] @ B["S"].T,
        "kendalltau_corr": _kendall(A["X"], B["X"]),
        "cosine_similarity": A["U"] @ B["U"].T,
    }
    g = A["X"] @ B["X"].T
    out["euclidean_distance"] = np.sqrt(np.maximum(A["sq"][:, None] + B["sq"][None, :] - 2 * g, 0.0))
    man = np.empty(g.shape)
    step = max(1, 4_000_000 // max(1, B["X"].shape[0] * B["X"].shape[1]))
    for s in range(0, A["X"].shape[0], step):
        man[s:s + step] = np.abs(A["X"][s:s + step, None, :] - B["X"][None, :, :]).sum(axis=2)
    out["manhattan_distance"] = man
    return out


def pair_metrics(
    vectors: DataFrame,
    id_col: str = "doc_id",
    vec_col: str = "v",
    keys: Sequence[str] = (),
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """V7 (V1-V6): the six metrics for every ordered pair (i, j) of a key group, i = j included.

    Output: keys..., ``document_1, document_2`` and the six metric columns. Constant vectors
    give NULL correlations; a zero vector gives cosine 0. A task meets ``METRIC_ROWS`` rows with as many
    at a time and yields their pairs, so it never holds a block pair's result. Every metric is a matrix
    product, Kendall's over bounded groups of element pairs, except Manhattan (chunked broadcasting).
    """
    k = list(keys)
    rep = block_pairs(vectors.select(*k, F.col(id_col), F.col(vec_col)), id_col, vec_col, k, block_rows)
    gk = k if k else ["_g"]

    def fn(li, L, ri, R, same):
        for s in range(0, len(L), METRIC_ROWS):
            a, A = li[s:s + METRIC_ROWS], _features(L[s:s + METRIC_ROWS])
            for t in range(s if same else 0, len(R), METRIC_ROWS):
                itself = same and s == t
                b, B = ri[t:t + METRIC_ROWS], A if itself else _features(R[t:t + METRIC_ROWS])
                M = _metric_block(A, B)
                np.clip(M["pearson_corr"], -1, 1, out=M["pearson_corr"])
                one, two, values = np.repeat(a, len(b)), np.tile(b, len(a)), [M[m].ravel() for m in METRICS]
                yield one, two, *values
                if not itself:  # the mirrored direction
                    yield two, one, *values

    fields = [("document_1", T.LongType()), ("document_2", T.LongType()), *((m, T.DoubleType()) for m in METRICS)]
    res = per_block_pair(rep, gk, fields, fn)
    # NaN (constant vector) -> NULL, as the SQL aggregate gives
    res = res.select(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in METRICS else F.col(c)
                       for c in res.columns])
    return res.drop("_g") if not k else res


def jaccard(a, b):
    """|a intersect b| / |a union b| of two arrays taken as sets; both empty -> NULL."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def approx_cosine_pairs(vectors: DataFrame, threshold: float, id_col: str = "doc_id", vec_col: str = "v",
                        bucket_length: float = 0.5, tables: int = 4, seed: int = 7) -> DataFrame:
    """V9: near-neighbour pairs by random-projection LSH on unit vectors (d^2 = 2 - 2 cos).

    Approximate: recall below 1 is possible; every emitted pair is exact and >= threshold. The buckets are wide (a unit
    vector's projection has about 2 / bucket_length of them), so pairs that share one aren't shuffled: a block pair's
    product finds the near ones, and those stay that share a bucket of any table.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    unit = vec.normalise_df(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("_v")), "_v", "_u")
    feats = unit.select("id", "_u", array_to_vector("_u").alias("features"))
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket_length,
                                      numHashTables=tables, seed=seed).fit(feats)
    buckets = F.array(*[vector_to_array(F.col("hashes")[i])[0] for i in range(tables)])
    rows = lsh.transform(feats).select("id", F.concat("_u", buckets).alias("u")).distinct()
    dist = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def fn(li, L, ri, R, same):
        (A, hash_a), (B, hash_b) = ((x[:, :-tables], x[:, -tables:]) for x in (L, R))
        sq_a, sq_b = (A * A).sum(axis=1), (B * B).sum(axis=1)
        for s, S in stripes(A, B):
            at = li[s:s + len(S)]
            near = 1.0 - (sq_a[s:s + len(S), None] + sq_b[None, :] - 2 * S) / 2 >= threshold - 1e-9
            if same:
                near &= at[:, None] < ri[None, :]
            ii, jj = np.nonzero(near)
            shared = (hash_a[ii + s] == hash_b[jj]).any(axis=1)
            ii, jj = ii[shared], jj[shared]
            d = np.sqrt(((A[ii + s] - B[jj]) ** 2).sum(axis=1))
            weight = 1.0 - d * d / 2
            ok = (d < dist) & (weight >= threshold)
            a, b = at[ii[ok]], ri[jj[ok]]
            yield np.minimum(a, b), np.maximum(a, b), weight[ok]

    rep = block_pairs(rows, "id", "u")
    return per_block_pair(rep, ["_g"], [("id1", T.LongType()), ("id2", T.LongType()), ("weight", T.DoubleType())], fn).drop("_g")


def top_partners(
    vectors: DataFrame,
    k: int,
    id_col: str = "doc_id",
    vec_col: str = "v",
    keys: Sequence[str] = (),
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """The k most similar other rows per row: ``keys..., id, other, sim, rank`` (ties by id).

    Each block-pair task keeps the best k per row; a window per row merges the blocks' lists.
    """
    kk = list(keys)
    unit = vec.normalise_df(vectors.select(*kk, F.col(id_col), F.col(vec_col).alias("_v")), "_v", "_u").drop("_v")
    rep = block_pairs(unit, id_col, "_u", kk, block_rows)
    gk = kk if kk else ["_g"]

    def fn(li, L, ri, R, same):
        for a, A, b, B in [(li, L, ri, R)] if same else [(li, L, ri, R), (ri, R, li, L)]:
            for s, S in stripes(A, B):
                at = a[s:s + len(S)]
                if same:
                    S[at[:, None] == b[None, :]] = -np.inf
                S[~np.isfinite(S)] = -np.inf
                least = np.partition(S, len(b) - k, axis=1)[:, len(b) - k, None] if k < len(b) else -np.inf
                i, j = np.nonzero((S >= least) & (S > -np.inf))
                # of equal similarities the smaller ids first
                order = np.lexsort((b[j], -S[i, j], i))
                i, j = i[order], j[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[keep], j[keep]
                yield at[i], b[j], S[i, j]

    cands = per_block_pair(rep, gk, [("id", T.LongType()), ("other", T.LongType()), ("sim", T.DoubleType())], fn)
    w = Window.partitionBy(*gk, "id").orderBy(F.col("sim").desc(), F.col("other"))
    top = cands.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    return top.drop("_g") if not kk else top


def greedy_most_similar(vectors: DataFrame, id_col: str = "doc_id", vec_col: str = "v", k0: int = 2) -> DataFrame:
    """Most similar document in id order, where j is not allowed for i when j < i already
    chose i; ties -> smallest j; none left -> (-1, -1). Output: id, best_id, best_sim.

    Fixpoint: i's choice depends only on choices of smaller ids, so rounds of
    "choose the best allowed candidate" converge. Candidates come from ``top_partners``;
    with m_i excluded partners the answer is among the best m_i + 1, so k is doubled
    whenever some document needs more (exact, no cap). Each round is checkpointed.
    """
    from newsloom.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(vectors.sparkSession)
    base = vectors.select(F.col(id_col).alias("id")).checkpoint(eager=True)
    k = k0
    top = top_partners(vectors, k, id_col, vec_col).checkpoint(eager=True)
    choice = base.withColumn("best_id", F.lit(None).cast("long"))
    # after round r the choices of the r smallest ids are final, so the loop ends
    while True:
        excl = choice.filter(F.col("best_id").isNotNull() & (F.col("id") < F.col("best_id"))).select(
            F.col("best_id").alias("id"), F.col("id").alias("other"))
        need = excl.groupBy("id").agg(F.count(F.lit(1)).alias("_m")).agg(F.max("_m")).first()[0] or 0
        if need + 1 > k:
            while k < need + 1:
                k *= 2
            top = top_partners(vectors, k, id_col, vec_col).checkpoint(eager=True)
        allowed = top.join(excl, ["id", "other"], "left_anti")
        first = allowed.groupBy("id").agg(F.min(F.struct("rank", "other", "sim")).alias("_b"))
        new = base.join(first, "id", "left").select(
            "id", F.col("_b.other").alias("best_id"), F.col("_b.sim").alias("best_sim"))
        joined = new.join(choice.select("id", F.col("best_id").alias("_old")), "id")
        changed = joined.filter(~F.col("best_id").eqNullSafe(F.col("_old"))).limit(1).count()
        choice = new.checkpoint(eager=True)
        if changed == 0:
            break
    return choice.select("id", F.coalesce("best_id", F.lit(-1).cast("long")).alias("best_id"),
                         F.coalesce("best_sim", F.lit(-1.0)).alias("best_sim"))
