"""Prefix trie of conversations with subtree totals by parallel tree contraction.

A node is a sequence of first turns. Its key is an exclusive-or of hashes of (place, turn), so that the keys of all prefixes are a running total, which
parts of a conversation compute apart from each other. Totals of subtrees come from contraction: rounds of joins take away all leaves (rake) and an
independent set of the nodes with a single child (compress), until the root is gone; compressed nodes get their totals back in reverse order.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from newsloom.llm.base import query, saved, table
from newsloom.operators.ordering import row_position

#: Turns of a conversation that one window holds, bytes of a packed piece of ids, and the largest share of all nodes (1/n) that joins by one parent.
PART, PIECE, SHARE = 1000, 1 << 16, 200
#: Heads come from the conversation whose number is the multiple of FAMILY below, and have fewer than HEADS turns.
FAMILY, HEADS = 5, 9
EMPTY = hashlib.sha256(b"").hexdigest()


def _key(a: str, b: str):
    return F.unhex(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def _saved_counted(df: DataFrame) -> tuple[DataFrame, int]:
    seen = Observation()
    out = saved(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get.get("n") or 0


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: turns ``c, d, t1, t2, size`` (d from 1; hashes of role and text, bytes of the text), and all ``c, length``."""
    clean = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = clean.select("c", "turn", "role", F.xxhash64(F.lit(1), "role", "text").alias("t1"), F.xxhash64(F.lit(2), "role", "text").alias("t2"), F.octet_length("text").cast("long").alias("size"))
    turns = saved(row_position(hashed, ["c"], ["turn", "role", "t1", "t2"], "p").select("c", "p", "t1", "t2", "size"))
    length = saved(turns.groupBy("c").agg(F.count(F.lit(1)).alias("n")))
    h = F.crc32(F.col("c").cast("string")) % HEADS
    plan = length.withColumn("b", F.col("c") - F.col("c") % FAMILY).withColumn("h", h)
    plan = plan.join(length.select(F.col("c").alias("b"), F.col("n").alias("nb")), "b", "left").withColumn("head", F.least("h", F.coalesce("nb", F.lit(0))))
    plan = saved(plan.select("c", "b", "h", "head", "n", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    # a conversation's own turns meet its plan part by part, so that a long one isn't one key
    pieces = plan.select("c", "h", "head", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PART))).alias("part"))
    own = turns.where(F.col("p") >= h).withColumn("part", F.floor(F.col("p") / PART)).join(pieces, ["c", "part"])
    own = own.select("c", (F.col("p") - F.col("h") + F.col("head") + 1).alias("d"), "t1", "t2", "size")
    heads = turns.where(F.col("p") < HEADS - 1).withColumnRenamed("c", "b").join(plan.select("c", "b", "h"), "b").where("p < h")
    return heads.select("c", (F.col("p") + 1).alias("d"), "t1", "t2", "size").union(own), plan.select("c", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """``c, d, node, parent, size``: the key of each turn's prefix, and of the prefix before it."""
    rows = turns.select("c", "d", F.floor((F.col("d") - 1) / PART).alias("part"), F.xxhash64("d", "t1", "t2", F.lit(1)).alias("e1"), F.xxhash64("d", "t1", "t2", F.lit(2)).alias("e2"), "size")
    rows = saved(rows)
    within = Window.partitionBy("c", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = rows.groupBy("c", "part").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    offset = total.select("c", "part", F.bit_xor("x1").over(before).alias("o1"), F.bit_xor("x2").over(before).alias("o2")).where("part > 0")
    run = rows.withColumn("w1", F.bit_xor("e1").over(within)).withColumn("w2", F.bit_xor("e2").over(within)).join(offset, ["c", "part"], "left")
    run = run.withColumn("k1", F.col("w1").bitwiseXOR(F.coalesce("o1", F.lit(0)))).withColumn("k2", F.col("w2").bitwiseXOR(F.coalesce("o2", F.lit(0))))
    run = run.withColumn("b1", F.col("k1").bitwiseXOR(F.col("e1"))).withColumn("b2", F.col("k2").bitwiseXOR(F.col("e2")))
    return run.select("c", "d", _key("k1", "k2").alias("node"), _key("b1", "b2").alias("parent"), "size")


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """``node`` and the sum of each of ``values`` over its subtree, for ``tree(node, parent, values...)``; a root's parent is null.

    Each round rakes all leaves into their parents, then compresses nodes with one child whose random number is below those of both neighbours: the
    child moves to the grandparent, and what it passes on is kept at its edge. Both kinds of rounds are joins on unique nodes and pre-aggregated sums;
    the tree shrinks by a constant factor whether it is bushy or a chain.
    """
    live, left = _saved_counted(tree.select("node", "parent", *values, *(F.lit(0).cast("long").alias(f"e_{v}") for v in values)))
    raked: list[DataFrame] = []
    compressed: list[DataFrame | None] = []
    r = 0
    while left:
        inner = live.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
        leaf = saved(live.join(inner, "node", "left_anti"))
        raked.append(leaf.select("node", *values))
        up = leaf.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(*(F.sum(F.col(v) + F.col(f"e_{v}")).alias(f"u_{v}") for v in values))
        rest = live.join(inner, "node", "left_semi").join(up, "node", "left")
        rest, left = _saved_counted(rest.select("node", "parent", *((F.col(v) + F.coalesce(f"u_{v}", F.lit(0))).alias(v) for v in values), *(f"e_{v}" for v in values)))
        if not left:
            compressed.append(None)
            break
        kids = rest.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"), F.min("node").alias("child"), *(F.sum(f"e_{v}").alias(f"c_{v}") for v in values))
        number = {x: F.xxhash64(F.lit(r), F.col(x)) for x in ("node", "parent", "child")}
        gone = rest.where("parent IS NOT NULL").join(kids.where("kids = 1"), "node").where((number["node"] < number["parent"]) & (number["node"] < number["child"]))
        gone, n = _saved_counted(gone.select("node", "parent", "child", *values, *(f"e_{v}" for v in values), *(f"c_{v}" for v in values)))
        compressed.append(gone if n else None)
        if n:
            moved = gone.select(F.col("child").alias("node"), F.col("parent").alias("to"), *((F.col(v) + F.col(f"e_{v}")).alias(f"m_{v}") for v in values))
            live = rest.join(gone, "node", "left_anti").join(moved, "node", "left").select(
                "node", F.coalesce("to", "parent").alias("parent"), *values, *((F.col(f"e_{v}") + F.coalesce(f"m_{v}", F.lit(0))).alias(f"e_{v}") for v in values))
            live, left = _saved_counted(live)
        else:
            live = rest
        r += 1
    total = None
    for leaf, gone in zip(reversed(raked), reversed(compressed)):
        if gone is not None:
            below = total.select(F.col("node").alias("child"), *(F.col(v).alias(f"t_{v}") for v in values))
            back = gone.join(below, "child").select("node", *((F.col(v) + F.col(f"c_{v}") + F.col(f"t_{v}")).alias(v) for v in values))
            total = total.union(saved(back))
        total = leaf if total is None else total.union(leaf)
    return total if total is not None else tree.select("node", *values)


def id_digests(rows: DataFrame) -> DataFrame:
    """``node, ends_sha256``: SHA-256 of the ascending ids ``c`` of each node, comma-joined.

    Range partitions pack sorted ids into pieces of text, so that a node with very many ids is spread; a digest then streams its few pieces.
    """

    def pack(batches):
        node, first, ids, size = None, None, [], 0

        def piece():
            return pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "first": pa.array([first], pa.int64()), "ids": pa.array([",".join(ids)], pa.string())})

        for batch in batches:
            done: list[pa.RecordBatch] = []
            for k, c in zip(batch.column("node").to_pylist(), batch.column("c").to_pylist()):
                if ids and (k != node or size >= PIECE):
                    done.append(piece())
                    ids, size = [], 0
                if not ids:
                    node, first = k, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if ids:
            yield piece()

    def digest(batches):
        node, sha = None, None

        def whole(rows):
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.string())], names=["node", "ends_sha256"])

        for batch in batches:
            done = []
            for k, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if sha is not None and k == node:
                    sha.update(b",")
                else:
                    if sha is not None:
                        done.append((node, sha.hexdigest()))
                    node, sha = k, hashlib.sha256()
                sha.update(ids.encode())
            yield whole(done)
        if sha is not None:
            yield whole([(node, sha.hexdigest())])

    pieces = rows.repartitionByRange("node", "c").sortWithinPartitions("node", "c").mapInArrow(pack, "node binary, first long, ids string")
    pieces = pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "ids")
    return pieces.mapInArrow(digest, "node binary, ends_sha256 string")


def parents_conv(nodes: DataFrame, count: int) -> DataFrame:
    """``node, parent_conv_id`` of all nodes but the root. Parents of more than a SHARE-th of all nodes (fewer than SHARE) are broadcast."""
    own = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    heavy = saved(own.where(F.col("n_children") * SHARE > count).drop("n_children"))
    child = nodes.where("parent IS NOT NULL").select("node", "parent")
    light = child.join(F.broadcast(heavy), "parent", "left_anti").join(own.drop("n_children"), "parent")
    return light.select("node", "parent_conv_id").union(child.join(F.broadcast(heavy), "parent").select("node", "parent_conv_id"))


def trie(conversations: DataFrame) -> DataFrame:
    """A row per node of the trie of all rebuilt ``conversations(conv_id, turn, role, text)``, with its key ``node`` and its parent's, ``parent``.

    Turns are ordered by turn, null first; turns of the same number go by role, then by a hash of the text, and equal ones all count. Null role and
    text are empty, and any length is read whole. Rows without a conv_id belong to no conversation. Other columns are ignored. An empty table gives
    no node. Different prefixes have different 128-bit keys but for a chance of about 2**-128 a pair. Tables go to the folder of spark.checkpoint.dir.
    """
    turns, convs = rebuilt(conversations)
    rows = saved(prefixes(turns))
    root = F.unhex(F.lit("0" * 32))
    top = convs.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    top = top.select(root.alias("node"), F.lit(None).cast("binary").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("size"))
    nodes = rows.groupBy("node").agg(F.min("parent").alias("parent"), F.min("c").alias("conv_id"), F.min("d").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.min("size").alias("size"))
    nodes = saved(nodes.union(top))
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes, count = _saved_counted(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    totals = subtree_totals(nodes.select("node", "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
                                         ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    plan = convs.withColumnRenamed("length", "d")
    ends = id_digests(rows.select("c", "d", "node").join(plan, ["c", "d"], "left_semi").select("node", "c").union(plan.where("d = 0").select(root.alias("node"), "c")))
    out = nodes.join(totals, "node").join(parents_conv(nodes, count), "node", "left").join(ends, "node", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))


@query("op11_tree_contraction_trie")
def op11(spark, sf_dir):
    return trie(table(spark, sf_dir, "conversations")).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
