"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine of at least c have squared distance of at most 2 - 2c. After a rotation (seeded, orthogonal) the vector
is cut into blocks of a few dimensions; in at least one block the squared distance is within the block's share of that
budget. Each block is a range join of its own: a grid over the block's leading coordinates, with cells as wide as the block's
radius, pairs each cell with itself and its neighbours. The union of the candidates of all blocks is verified in double precision.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.base import components, query, saved, table

BLOCK_DIMS = 8
GRID_DIMS = 2
#: Vectors of one cell that travel as one row; larger cells are several rows.
CHUNK = 1024


def rotation(d: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix: the same for every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed + d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def blocks_of(d: int) -> list[np.ndarray]:
    return np.array_split(np.arange(d), max(1, round(d / BLOCK_DIMS)))


def radius2(d: int, block: int, threshold: float) -> float:
    """The block's share of the squared distance, with a little more for rounding."""
    return (2 - 2 * threshold) * len(blocks_of(d)[block]) / d * (1 + 1e-4) + 1e-6


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that can have a link: label set, vector set, every component finite, not all zero."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine & F.exists("embedding", lambda x: x != 0))


def block_points(classes: DataFrame, threshold: float) -> DataFrame:
    """``label, dim, block, cell, id, x``: a row for each vector and block, with its place in the block's grid."""

    def run(batches):
        for batch in batches:
            emb = batch.column("embedding")
            rows = [np.asarray(v.values, np.float64) for v in emb]
            size = np.array([len(r) for r in rows])
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                x = np.stack([rows[i] for i in at])
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(d)
                for b, dims in enumerate(blocks_of(d)):
                    part = x[:, dims]
                    cell = np.floor(part[:, :GRID_DIMS] / np.sqrt(radius2(d, b, threshold))).astype(np.int32)
                    if cell.shape[1] < GRID_DIMS:
                        cell = np.pad(cell, ((0, 0), (0, GRID_DIMS - cell.shape[1])))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("label").take(pa.array(at)), pa.array(np.full(len(at), d, np.int32)), pa.array(np.full(len(at), b, np.int32)),
                         pa.array(list(cell), pa.list_(pa.int32())), batch.column("id").take(pa.array(at)), pa.array(list(part.astype(np.float32)), pa.list_(pa.float32()))],
                        names=["label", "dim", "block", "cell", "id", "x"])

    return classes.select("label", "id", "embedding").mapInArrow(run, "label int, dim int, block int, cell array<int>, id long, x array<float>")


def candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` (a < b): pairs within the budget of some block, each once."""
    key = ["label", "dim", "block", "cell"]
    points = block_points(classes, threshold)
    counts = saved(points.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")))
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    packed = points.join(counts, key).withColumn("chunk", chunk).groupBy(*key, "chunk")
    packed = saved(packed.agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("x")).alias("xs")))
    # each cell meets itself and the half of its neighbours that follow it
    steps = [s for s in itertools.product((-1, 0, 1), repeat=GRID_DIMS) if s >= (0,) * GRID_DIMS]
    near = F.explode(F.array(*(F.array(*(F.element_at("cell", i + 1) + F.lit(s[i]) for i in range(GRID_DIMS))) for s in steps)))
    pair = counts.select(*key, "chunks", near.alias("cell_b"))
    pair = pair.join(counts.select("label", "dim", "block", F.col("cell").alias("cell_b"), F.col("chunks").alias("chunks_b")), ["label", "dim", "block", "cell_b"])
    pair = pair.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).withColumn("chunk_b", F.explode(F.expr("sequence(0, chunks_b - 1)")))
    pair = pair.where("cell <> cell_b OR chunk <= chunk_b").select(*key, "chunk", "cell_b", "chunk_b")
    other = packed.select("label", "dim", "block", F.col("cell").alias("cell_b"), F.col("chunk").alias("chunk_b"), F.col("ids").alias("ids_b"), F.col("xs").alias("xs_b"))
    work = pair.join(packed, [*key, "chunk"]).join(other, ["label", "dim", "block", "cell_b", "chunk_b"]).select("dim", "block", "ids", "xs", "ids_b", "xs_b")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                d, b = batch.column("dim")[i].as_py(), batch.column("block")[i].as_py()
                ida, idb = (np.asarray(batch.column(c)[i].values) for c in ("ids", "ids_b"))
                x, y = (np.asarray(batch.column(c)[i].values).reshape(len(n), -1) for c, n in (("xs", ida), ("xs_b", idb)))
                dist = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
                p, q = np.nonzero(dist <= radius2(d, b, threshold))
                low, high = np.minimum(ida[p], idb[q]), np.maximum(ida[p], idb[q])
                once = low < high
                yield pa.RecordBatch.from_arrays([pa.array(low[once]), pa.array(high[once])], names=["a", "b"])

    return work.mapInArrow(run, "a long, b long").distinct()


def cosine_at_least(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs ``a, b`` those whose vectors have a cosine of at least the threshold."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("embedding").alias(f"v_{x}"))

    def run(batches):
        for batch in batches:
            a = np.asarray(batch.column("v_a").flatten(), np.float64)
            b = np.asarray(batch.column("v_b").flatten(), np.float64)
            off = np.asarray(batch.column("v_a").offsets)[:-1] - batch.column("v_a").offsets[0].as_py()
            if len(off):
                top = lambda v: np.repeat(np.maximum.reduceat(np.abs(v), off), np.diff(np.r_[off, len(v)]))
                a, b = a / top(a), b / top(b)
                cos = np.add.reduceat(a * b, off) / (np.sqrt(np.add.reduceat(a * a, off)) * np.sqrt(np.add.reduceat(b * b, off)))
                keep = pa.array(cos >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "v_a", "v_b")
    return both.mapInArrow(run, "a long, b long")


def vector_near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Near-duplicates among ``vectors(vec_id, embedding, label)`` of equal labels: ``vec_id, n_links, component_id, kept``.

    n_links: other rows with a cosine of at least ``threshold``; component_id: the smallest vec_id that links reach; kept: that is the
    own one. Vectors that are null, empty, zero or hold null or non-finite components, and null labels, have no link. Equal vectors
    are linked rows (each repeated row counts), but enter the search once; vectors of other lengths aren't linked. Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = vectors.select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<float>").alias("embedding"))
    fine = usable(rows)
    classes = fine.groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
    classes = saved(classes.withColumn("id", F.monotonically_increasing_id()))
    links = saved(cosine_at_least(candidates(classes, threshold), classes, threshold))
    both = links.union(links.select("b", "a")).toDF("id", "other")
    size = both.join(classes.select(F.col("id").alias("other"), "n"), "other").groupBy("id").agg(F.sum("n").alias("linked"))
    root = components(links).select(F.col("node").alias("id"), "root")
    named = classes.select("label", "embedding", "low", "n", "id").join(size, "id", "left").join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "root").select("label", "embedding", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    marked = rows.withColumn("_row", F.monotonically_increasing_id())
    out = marked.join(named, ["label", "embedding"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query("op3_subspace_pigeonhole_join")
def op3(spark, sf_dir):
    return vector_near_duplicates(table(spark, sf_dir, "embeddings"))
