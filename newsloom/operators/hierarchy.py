"""Density hierarchy of documents (M12, M22, M23): spanning tree, merge tree, condensed tree, stable clusters.

Documents are joined by mutual reachability: the larger of both core distances (to the k-th neighbour) and the cosine distance. A minimum spanning tree
over it comes from Boruvka rounds; its edges in order of weight make a merge tree. Branches below ``min_size`` documents fall out of their cluster, two
larger ones split it, and the clusters that hold most excess of mass are the topics, so that dense and sparse topics of one group are told apart.
"""

from __future__ import annotations

from typing import NamedTuple, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import vec
from newsloom.operators import vectors as V
from newsloom.operators.ordering import global_position
from newsloom.operators.topics import connected_components, relabel_by_size
from newsloom.session import table_of

#: Distances are rounded, so that all kernels agree on their order; ties go by id.
PLACES = 9
#: Edges of a merge tree that one task orders by itself.
LOCAL_EDGES = 50_000
#: Clusters of a tree that one task walks by itself; a larger tree is walked by levels.
LOCAL_CLUSTERS = 1 << 20
_KEEP = 16


def _kept(df: DataFrame) -> DataFrame:
    return table_of(df, "hierarchy")


def _linked(df: DataFrame, table: DataFrame, on: dict[str, str], add: dict[str, str], how: str = "inner") -> DataFrame:
    """``df`` with columns of ``table`` under new names; ``on`` maps columns of ``df`` to those of ``table``."""
    names = {c: f"_k{i}" for i, c in enumerate(on.values())}
    side = table.select(*(F.col(c).alias(n) for c, n in names.items()), *(F.col(c).alias(n) for c, n in add.items()))
    cond = [F.col(c) == F.col(names[t]) for c, t in on.items()]
    return df.join(side, cond, how).drop(*names.values())


def _nearest_outside(rows: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """``keys..., comp, w, a, b``: the least edge from each asking row's component to another one, per block pair."""
    rep = V.block_pairs(rows.withColumn("_s", F.struct("u", "comp", "core", "ask")), "id", "_s", keys, block_rows)
    gk = keys or ["_g"]
    schema = T.StructType([rep.schema[c] for c in gk] + [T.StructField("comp", T.LongType()), T.StructField("w", T.DoubleType()),
                                                        T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def side(pdf):
        cells = pdf["u"].tolist()
        get = (lambda c, f: c[f]) if cells and isinstance(cells[0], dict) else getattr
        return (pdf["id"].to_numpy(np.int64), np.array([get(c, "comp") for c in cells], np.int64), np.array([get(c, "core") for c in cells], float),
                np.array([get(c, "ask") for c in cells], bool), np.array([get(c, "u") for c in cells], float))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["_b1"].iloc[0] == pdf["_b2"].iloc[0]
        left = side(pdf if same else pdf[pdf["_side"] == 0])
        right = left if same else side(pdf[pdf["_side"] == 1])
        found = []
        for (i, c, core, ask, u), (j, d, core_j, _, v) in ((left, right),) if same else ((left, right), (right, left)):
            # in id order the first of a row's least edges is the one whose (smaller, larger) ends come first
            order = np.argsort(j, kind="stable")
            j, d, core_j, v = j[order], d[order], core_j[order], v[order]
            step = max(1, V.STRIPE_CELLS // max(1, len(j)))
            for at in range(0, len(i), step):
                q = np.flatnonzero(ask[at:at + step]) + at
                if not len(q) or not len(j):
                    continue
                w = np.maximum(np.maximum(core[q, None], core_j[None, :]), np.round(1 - u[q] @ v.T, PLACES))
                w[c[q][:, None] == d[None, :]] = np.inf
                first = w.argmin(axis=1)
                low = w[np.arange(len(q)), first]
                ok = np.isfinite(low)
                ends, own = j[first[ok]], i[q[ok]]
                found.append(pd.DataFrame({"comp": c[q[ok]], "w": low[ok], "a": np.minimum(ends, own), "b": np.maximum(ends, own)}))
                found = [pd.concat(found).sort_values(["comp", "w", "a", "b"]).drop_duplicates("comp")]
        out = (pd.concat(found) if found else pd.DataFrame(columns=["comp", "w", "a", "b"])).astype({"comp": "int64", "w": "float64", "a": "int64", "b": "int64"})
        out = out.sort_values(["comp", "w", "a", "b"]).drop_duplicates("comp")
        for c in gk:
            out[c] = pdf[c].iloc[0]
        return out[[f.name for f in schema.fields]]

    out = rep.groupBy(*gk, "_b1", "_b2").applyInPandas(fn, schema)
    return out if keys else out.drop("_g")


def spanning_forest(vectors: DataFrame, k: int = 5, keys: Sequence[str] = (), id_col: str = "doc_id", vec_col: str = "v",
                    block_rows: int = V.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Minimum spanning tree of each group's mutual reachability: ``keys..., id1 < id2, w``; edges of equal weight go by their ids.

    Every Boruvka round takes each component's least edge outwards and joins the components, so the number of rounds grows with the logarithm of the
    rows. Lists of near neighbours answer for rows whose list still reaches out of the component below any unlisted row; only the others take part in a
    blocked product. A group with fewer than k + 1 rows uses its last neighbour as the k-th.
    """
    kk = list(keys)
    unit = vec.normalise_df(vectors.select(*kk, F.col(id_col).alias("id"), F.col(vec_col).alias("_v")), "_v", "u").drop("_v")
    size = max(k, _KEEP)
    top = _kept(V.top_partners(unit, size, "id", "u", kk, block_rows).select(*kk, "id", "other", F.round(1 - F.col("sim"), PLACES).alias("d"), "rank"))
    core = top.groupBy(*kk, "id").agg(F.max(F.when(F.col("rank") <= k, F.col("d"))).alias("core"), F.when(F.max("rank") == size, F.max("d")).alias("far"))
    rows = _kept(unit.join(core, kk + ["id"]))
    on = {c: c for c in kk}
    list_ = _linked(_linked(top, core, {**on, "id": "id"}, {"core": "ca"}), core, {**on, "other": "id"}, {"core": "cb"})
    list_ = list_.select(*kk, "id", "other", F.greatest("ca", "cb", "d").alias("w"))
    comp = _kept(rows.select(*kk, "id", F.col("id").alias("comp")))
    forest = None
    while True:
        list_ = _linked(_linked(list_.select(*kk, "id", "other", "w"), comp, {**on, "id": "id"}, {"comp": "comp"}), comp, {**on, "other": "id"}, {"comp": "to"})
        list_ = _kept(list_.filter("comp <> to"))
        edge = F.min(F.struct("w", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))).alias("e")
        listed = list_.groupBy(*kk, "comp").agg(edge)
        # unlisted rows are at least `far` away; a full list without one has none
        asked = rows.join(comp, kk + ["id"]).join(listed.select(*kk, "comp", F.col("e.w").alias("best")), kk + ["comp"], "left")
        ask = F.col("far").isNotNull() & (F.col("best").isNull() | (F.greatest("far", "core") <= F.col("best")))
        asked = _kept(asked.select(*kk, "id", "u", "comp", "core", ask.alias("ask")))
        best = listed
        if not asked.filter("ask").isEmpty():
            full = _nearest_outside(asked, kk, block_rows)
            best = listed.unionByName(full.select(*kk, "comp", F.struct("w", "a", "b").alias("e")))
        best = _kept(best.groupBy(*kk, "comp").agg(F.min("e").alias("e")).select(*kk, "comp", "e.w", "e.a", "e.b"))
        if best.isEmpty():
            break
        new = best.select(*kk, F.col("a").alias("id1"), F.col("b").alias("id2"), "w").distinct()
        forest = _kept(new if forest is None else forest.unionByName(new))
        ends = _linked(_linked(best, comp, {**on, "a": "id"}, {"comp": "ca"}), comp, {**on, "b": "id"}, {"comp": "cb"})
        to = ends.select(*kk, "comp", F.when(F.col("ca") == F.col("comp"), F.col("cb")).otherwise(F.col("ca")).alias("to"))
        # two components that chose each other: the smaller one is the root
        back = _linked(to, to, {**on, "to": "comp"}, {"to": "back"})
        to = _kept(back.select(*kk, "comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("to")))
        while True:
            jump = _kept(_linked(to, to, {**on, "to": "comp"}, {"to": "next"}))
            to = jump.select(*kk, "comp", F.col("next").alias("to"))
            if jump.filter("next <> to").isEmpty():
                break
        comp = _kept(_linked(comp, to, {**on, "comp": "comp"}, {"to": "root"}).select(*kk, "id", F.col("root").alias("comp")))
    if forest is None:
        forest = comp.select(*kk, F.col("id").alias("id1"), F.col("id").alias("id2"), F.lit(0.0).alias("w")).limit(0)
    return forest


def _merged(pdf: pd.DataFrame, least: int) -> pd.DataFrame:
    """The merge tree of one bounded part: a row for each of its nodes (merges, and what they merge).

    ``up``: the highest merge of the same cluster in this part; ``fall``: the first merge above a node that holds ``least`` documents.
    """
    pdf = pdf.sort_values("e")
    sub = int(pdf["sub"].iloc[0])
    root: dict[int, int] = {}
    size: dict[int, int] = {}

    def find(x):
        path = []
        while x in root:
            path.append(x)
            x = root[x]
        for p in path:
            root[p] = x
        return x

    parent: dict[int, int] = {}
    split: dict[int, bool] = {}
    for e, a, b, sa, sb in zip(*(pdf[c].tolist() for c in ("e", "a", "b", "sa", "sb"))):
        size.setdefault(a, sa)
        size.setdefault(b, sb)
        x, y, m = find(a), find(b), -e - 1
        size[m] = size[x] + size[y]
        split[m] = min(size[x], size[y]) >= least
        root[x] = root[y] = parent[x] = parent[y] = m
    up: dict[int, int] = {}
    fall: dict[int, int | None] = {}
    rows = []
    for x in sorted(size, key=lambda n: (n >= 0 or n not in split, n)):  # merges from the last one on, then what they merge
        p = parent.get(x)
        if x in split:
            up[x] = x if p is None or split[p] else up[p]
            fall[x] = x if size[x] >= least else (None if p is None else fall[p])
        else:
            fall[x] = fall[p]
        rows.append((sub, x, x in split, size[x], p, split.get(x, False), up.get(x), fall[x]))
    return pd.DataFrame(rows, columns=["sub", "node", "merge", "size", "parent", "split", "up", "fall"]).astype({"parent": "Int64", "up": "Int64", "fall": "Int64"})


class Hierarchy(NamedTuple):
    """Tables of the condensed tree, all with the groups' keys in front."""

    points: DataFrame  #: id, cluster, lam: the cluster that a document falls out of, and at which 1 / distance (null in groups below the least size)
    clusters: DataFrame  #: cluster, parent, size, birth, stability, chosen, topic_cluster (the chosen cluster at or above it)


def merge_parts(forest: DataFrame, keys: Sequence[str], local_edges: int = LOCAL_EDGES) -> tuple[DataFrame, DataFrame]:
    """Edges of each group's tree in order (``keys..., e, w``), and dealt to parts of at most ``local_edges``: ``sub, e, a, b, sa, sb``.

    A larger part is cut at its median edge: the components of the lighter half become parts of their own, and single nodes, named by their last merge,
    in the heavier half. Both halves are about half as large, so the number of rounds grows with the logarithm of the edges. A part is named by its last merge.
    """
    kk = list(keys)
    order = global_position(forest, [*kk, "w", "id1", "id2"], "e").withColumn("e", F.col("e").cast("long"))
    order = _kept(order)
    last = order.groupBy(*kk).agg(F.max("e").alias("_last")) if kk else None
    edges = order.join(last, kk) if kk else order.withColumn("_last", order.agg(F.max("e")).scalar())
    one = F.lit(1).cast("long")
    edges = _kept(edges.select((-F.col("_last") - 1).alias("sub"), "e", F.col("id1").alias("a"), F.col("id2").alias("b"), one.alias("sa"), one.alias("sb")))
    done = edges.limit(0)
    while True:
        big = _kept(edges.groupBy("sub").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("e", 0.5).alias("cut")).filter(F.col("n") > local_edges).select("sub", "cut"))
        done = done.unionByName(edges.join(big, "sub", "left_anti"))
        if big.isEmpty():
            return order.select(*kk, "e", "w"), _kept(done)
        work = _kept(edges.join(big, "sub"))
        nodes = work.select("sub", F.col("a").alias("node"), F.col("sa").alias("size")).union(work.select("sub", "b", "sb")).distinct()
        light = work.filter("e <= cut")
        comp = connected_components(nodes.select("sub", "node"), light.select("sub", F.col("a").alias("id1"), F.col("b").alias("id2")), ["sub"], "node")
        sized = nodes.join(comp, ["sub", "node"]).groupBy("sub", "comp").agg(F.sum("size").alias("size"))
        lit = _linked(light, comp, {"sub": "sub", "a": "node"}, {"comp": "comp"})
        name = lit.groupBy("sub", "comp").agg((-F.max("e") - 1).alias("to"))
        place = comp.join(sized, ["sub", "comp"]).join(name, ["sub", "comp"], "left")
        place = _kept(place.select("sub", "node", "comp", F.coalesce("to", "node").alias("to"), "size"))
        heavy = work.filter("e > cut")
        heavy = _linked(_linked(heavy, place, {"sub": "sub", "a": "node"}, {"to": "ta", "size": "za"}), place, {"sub": "sub", "b": "node"}, {"to": "tb", "size": "zb"})
        heavy = heavy.select("sub", "e", F.col("ta").alias("a"), F.col("tb").alias("b"), F.col("za").alias("sa"), F.col("zb").alias("sb"))
        lit = _linked(lit, name, {"sub": "sub", "comp": "comp"}, {"to": "to"}).select(F.col("to").alias("sub"), "e", "a", "b", "sa", "sb")
        edges = _kept(heavy.unionByName(lit))


def _chosen_locally(tree: DataFrame) -> DataFrame:
    """``cluster, topic_cluster`` as by levels, in one task. A cluster is named by its last merge, so parents have smaller names."""
    def walk(batches):
        t = pa.Table.from_batches(list(batches), schema=pa.schema([("cluster", pa.int64()), ("parent", pa.int64()), ("stability", pa.float64())])).sort_by("cluster")
        ids, outer = t.column("cluster").to_numpy(), t.column("parent")
        at = np.where(outer.is_null().to_numpy(zero_copy_only=False), -1, np.searchsorted(ids, outer.fill_null(0).to_numpy())).tolist()
        stability, below, label = t.column("stability").to_pylist(), [0.0] * len(ids), [None] * len(ids)
        chosen = [False] * len(ids)
        for i in range(len(ids) - 1, -1, -1):
            if at[i] >= 0:
                chosen[i] = stability[i] >= below[i]
                below[at[i]] += max(stability[i], below[i])
        for i, p in enumerate(at):
            if p >= 0:
                label[i] = int(ids[i]) if label[p] is None and chosen[i] else label[p]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label, pa.int64())], ["cluster", "topic_cluster"])

    return _kept(tree.select("cluster", "parent", F.col("stability").cast("double")).coalesce(1).mapInArrow(walk, "cluster long, topic_cluster long"))


def _chosen_by_levels(tree: DataFrame) -> DataFrame:
    """``cluster, topic_cluster``: the highest chosen cluster at or above each, none for the roots."""
    # up: a cluster is chosen where its stability is not below what its branches reach
    value = None
    open_ = tree
    while not open_.isEmpty():
        if value is None:
            ready = open_.filter("kids = 0").withColumn("below", F.lit(0.0))
        else:
            sums = value.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("cluster")).agg(F.sum("value").alias("below"), F.count(F.lit(1)).alias("_k"))
            ready = open_.join(sums, "cluster").filter(F.col("_k") == F.col("kids")).drop("_k")
        ready = ready.select("cluster", "parent", F.greatest("stability", "below").alias("value"), (F.col("parent").isNotNull() & (F.col("stability") >= F.col("below"))).alias("chosen"))
        value = _kept(ready if value is None else value.unionByName(ready))
        open_ = _kept(open_.join(value.select("cluster"), "cluster", "left_anti"))
    # down: the highest chosen cluster above each
    tree = _kept(tree.join(value.select("cluster", "chosen"), "cluster")) if value is not None else tree.withColumn("chosen", F.lit(False))
    level = tree.filter("parent IS NULL").select("cluster", F.lit(None).cast("long").alias("topic_cluster"))
    labels = level
    while True:
        below = _linked(tree.select("cluster", "parent", "chosen"), level, {"parent": "cluster"}, {"topic_cluster": "from"})
        level = _kept(below.select("cluster", F.coalesce("from", F.when(F.col("chosen"), F.col("cluster"))).alias("topic_cluster")))
        if level.isEmpty():
            break
        labels = labels.unionByName(level)
    return labels


def condensed_tree(forest: DataFrame, min_size: int, keys: Sequence[str] = (), local_edges: int = LOCAL_EDGES) -> Hierarchy:
    """Condensed tree and stable clusters of a spanning forest ``keys..., id1, id2, w``, for clusters of at least ``min_size`` (2 or more) documents.

    Parts of the merge tree are solved in tasks of bounded size; what crosses their borders is followed from part to part. The cluster tree is
    walked up for the choice and down for the labels, by one task or, above ``LOCAL_CLUSTERS``, by levels, each a round of joins. No number of rounds is set.
    """
    if min_size < 2:
        raise ValueError("min_size must be 2 at least")
    kk = list(keys)
    order, parts = merge_parts(forest, kk, local_edges)
    schema = "sub long, node long, merge boolean, size long, parent long, split boolean, up long, fall long"
    nodes = _kept(parts.groupBy("sub").applyInPandas(lambda pdf: _merged(pdf, min_size), schema))
    borders = _kept(nodes.filter("NOT merge AND node < 0"))  # merges of other parts, in the part that goes on with them
    merges = nodes.filter("merge")
    # the cluster of each part's last merge, from part to part
    chain = _linked(borders.filter(F.col("size") >= min_size).select("node", "sub", "parent"), merges, {"parent": "node"}, {"split": "ps", "up": "pu"})
    chain = chain.select(F.col("node").alias("r"), F.when(F.col("ps"), F.col("node")).otherwise(F.col("pu")).alias("to"), (~F.col("ps") & (F.col("pu") == F.col("sub"))).alias("open"))
    chain = _kept(chain)
    while True:
        step = _linked(chain, chain, {"to": "r"}, {"to": "to2", "open": "open2"}, "left")
        more = F.col("open") & F.col("to2").isNotNull()
        step = _kept(step.select("r", F.when(more, F.col("to2")).otherwise(F.col("to")).alias("to"), F.when(more, F.col("open2")).otherwise(F.lit(False)).alias("open")))
        chain = step
        if step.filter("open").isEmpty():
            break
    held = _linked(merges.filter(F.col("size") >= min_size), chain, {"up": "r"}, {"to": "_top"}, "left")
    held = held.withColumn("_e", -F.col("node") - 1)
    held = _linked(held, order, {"_e": "e"}, {**{c: c for c in kk}, "w": "w"})
    held = _kept(held.select(*kk, "node", "size", "parent", F.coalesce("_top", "up").alias("cluster"), (1 / F.greatest(F.col("w"), F.lit(10.0 ** -PLACES))).alias("lam")))
    # documents: the first merge above them that is large enough, maybe some parts away
    free = nodes.filter("node >= 0").select(F.col("node").alias("id"), "sub", "fall")
    found = []
    while True:
        free = _kept(free)
        found.append(free.filter("fall IS NOT NULL").select("id", "fall"))
        free = _linked(free.filter("fall IS NULL").select("id", F.col("sub").alias("at")), borders, {"at": "node"}, {"sub": "sub", "fall": "fall"}).select("id", "sub", "fall")
        if free.isEmpty():
            break
    fell = found[0]
    for f in found[1:]:
        fell = fell.unionByName(f)
    points = _kept(_linked(fell, held, {"fall": "node"}, {**{c: c for c in kk}, "cluster": "cluster", "lam": "lam"}).select(*kk, "id", "cluster", "lam"))
    # clusters and their parents
    top = held.filter(F.col("node") == F.col("cluster")).select(*kk, F.col("node").alias("cluster"), "size", "parent")
    top = _linked(top, borders, {"cluster": "node"}, {"parent": "outer"}, "left").withColumn("parent", F.coalesce("outer", "parent"))
    top = _linked(top, held, {"parent": "node"}, {"cluster": "above", "lam": "birth"}, "left").select(*kk, "cluster", F.col("above").alias("parent"), "size", F.coalesce("birth", F.lit(0.0)).alias("birth"))
    top = _kept(top)
    own = points.groupBy("cluster").agg(F.sum("lam").alias("_l"), F.count(F.lit(1)).alias("_n"))
    kids = top.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("cluster")).agg(F.sum(F.col("size") * F.col("birth")).alias("_kl"), F.sum("size").alias("_kn"), F.count(F.lit(1)).alias("kids"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    tree = top.join(own, "cluster", "left").join(kids, "cluster", "left")
    tree = _kept(tree.select(*kk, "cluster", "parent", "size", "birth", (zero("_l") + zero("_kl") - (zero("_n") + zero("_kn")) * F.col("birth")).alias("stability"), zero("kids").alias("kids")))
    walked = _chosen_locally(tree) if tree.count() <= LOCAL_CLUSTERS else _chosen_by_levels(tree)
    clusters = tree.join(walked, "cluster").select(*kk, "cluster", "parent", "size", "birth", "stability", (F.col("cluster") == F.col("topic_cluster")).alias("chosen"), "topic_cluster")
    return Hierarchy(points, clusters.withColumn("chosen", F.coalesce("chosen", F.lit(False))))


def hierarchy_topics(vectors: DataFrame, min_topic_size: int = 10, k: int = 5, keys: Sequence[str] = (), id_col: str = "doc_id", vec_col: str = "v",
                     local_edges: int = LOCAL_EDGES) -> DataFrame:
    """M12, M23 from the tree: ``keys..., id, topic, lam, probability``; topics 0, 1, ... by size in each group, -1 for the rest.

    ``lam`` is 1 / distance at which the document leaves its cluster (null in a group below the least size), probability its share of the topic's largest.
    """
    kk = list(keys)
    found = condensed_tree(spanning_forest(vectors, k, kk, id_col, vec_col), min_topic_size, kk, local_edges)
    at = found.points.join(found.clusters.select("cluster", "topic_cluster"), "cluster").select(F.col("id").alias(id_col), "lam", "topic_cluster")
    every = vectors.select(*kk, id_col).join(at, id_col, "left")
    sized = relabel_by_size(every.filter("topic_cluster IS NOT NULL"), kk, id_col, 1, "topic_cluster")
    peak = sized.groupBy(*kk, "topic").agg(F.max("lam").alias("_peak"))
    inside = sized.join(peak, kk + ["topic"]).select(*kk, id_col, "topic", "lam", (F.col("lam") / F.col("_peak")).alias("probability"))
    rest = every.filter("topic_cluster IS NULL").select(*kk, id_col, F.lit(-1).alias("topic"), "lam", F.lit(0.0).alias("probability"))
    return inside.unionByName(rest)


def hierarchy_exemplars(vectors: DataFrame, min_topic_size: int = 10, k: int = 5, keys: Sequence[str] = (), id_col: str = "doc_id", vec_col: str = "v",
                        local_edges: int = LOCAL_EDGES) -> DataFrame:
    """M22 from the tree: ``keys..., topic_cluster, id, lam``: of each topic's undivided clusters the documents that leave them last."""
    kk = list(keys)
    found = condensed_tree(spanning_forest(vectors, k, kk, id_col, vec_col), min_topic_size, kk, local_edges)
    leaf = found.clusters.join(found.clusters.select(F.col("parent").alias("cluster")), "cluster", "left_anti").filter("topic_cluster IS NOT NULL")
    last = found.points.groupBy("cluster").agg(F.max("lam").alias("_last"))
    out = found.points.join(leaf.select("cluster", "topic_cluster"), "cluster").join(last, "cluster").filter("lam = _last")
    return out.select(*kk, "topic_cluster", F.col("id").alias(id_col), "lam")
