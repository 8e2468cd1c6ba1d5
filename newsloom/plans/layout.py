"""T6 layout data set: G2 -> W3 -> H1 -> H4 -> H5 -> H6 -> G3 -> H8 -> A8 -> F4 -> H11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import scalar as SC
from newsloom.operators import curve, graph, ordering, sentiment
from newsloom.operators import vectors as V
from newsloom.plans import dataset
from newsloom.sources import tables

MONTH = ["year", "month"]
ORDER = ["topic_pos", "document1"]


def layout_nodes(g: DataFrame, vectors: DataFrame, bits: int = 9, mul: float = 100, weight: float = 0.01) -> DataFrame:
    """Nodes of the layout: T5 rows that have an edge > weight in their month, placed on the curve.

    The "has an edge" test of G2 reads each document's best partner (O(n x blocks) rows)
    instead of every pair above a near-zero weight.
    """
    best = V.best_partner(vectors.select("doc_id", *MONTH, "v"), "doc_id", "v", keys=MONTH)
    linked = best.filter(F.col("best_sim") > weight).select(*MONTH, F.col("id").alias("document1"))
    nodes = g.join(linked, MONTH + ["document1"], "left_semi")
    nodes = ordering.topic_boundary(nodes, MONTH, ORDER)
    spaced = curve.spacing_similarity(nodes, MONTH, ORDER, "topic", 1 << (2 * bits), mul)
    return curve.place_on_curve(spaced, MONTH, ORDER, bits)


def plot_table(placed: DataFrame, tam: float = 50) -> DataFrame:
    """H11 + F4 + H10: x, y, marker size, topic, sentiment colour and hover title per node."""
    return placed.select(
        *MONTH, "document1", "topic", "x", "y",
        SC.marker_size_inv(F.col("document1_size").cast("double"), tam).alias("marker_size"),
        sentiment.sentiment_colour(F.col("sentimet_classification")).alias("colour"),
        F.coalesce(F.col("document1_title"), F.col("topic_name")).alias("hover"),
        "spacing", "run", "topic_change",
    )


def layout_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    gi = dataset.graph_inputs(spark, sf_dir)
    g = dataset.graph_dataset(gi["docs"], gi["min_topic_size"], gi["threshold"])
    return plot_table(layout_nodes(g, gi["docs"]))


def layout_edges(spark: SparkSession, sf_dir: str):
    """G3 strong edges between placed nodes and their curves (H8)."""
    p = tables.fixture_params()
    gi = dataset.graph_inputs(spark, sf_dir)
    g = dataset.graph_dataset(gi["docs"], gi["min_topic_size"], gi["threshold"])
    placed = layout_nodes(g, gi["docs"]).select(*MONTH, F.col("document1").alias("doc_id"), "x", "y", "topic")
    pairs = V.cosine_pairs(gi["docs"].select("doc_id", *MONTH, "v"), "doc_id", "v", p["pair_threshold"], MONTH)
    strong = graph.strong_edges(pairs, p["pair_threshold"] - 1e-9, MONTH)
    strong = strong.join(placed.select(*MONTH, F.col("doc_id").alias("id1")), MONTH + ["id1"], "left_semi").join(
        placed.select(*MONTH, F.col("doc_id").alias("id2")), MONTH + ["id2"], "left_semi")
    return placed, strong, pairs
