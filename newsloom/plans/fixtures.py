"""Fixture frames over the given tables (FIXTURES.md section 3), shared by the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import vec
from newsloom.operators import vectors
from newsloom.plans import dataset
from newsloom.sources import tables

MONTH = ["year", "month"]


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with vector, fixture topic and sentiment."""
    return dataset.graph_inputs(spark, sf_dir)["docs"]


def month_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document pairs inside a month with cosine >= the pair threshold: year, month, id1 < id2, weight."""
    p = tables.fixture_params()
    d = tables.article_vectors(spark, sf_dir).select("doc_id", *MONTH, "v")
    return vectors.cosine_pairs(d, "doc_id", "v", p["pair_threshold"], MONTH)


def global_edges(spark: SparkSession, sf_dir: str, threshold: float | None = None) -> DataFrame:
    """Vector pairs over all embeddings with cosine >= threshold: id1 < id2, weight."""
    p = tables.fixture_params()
    v = tables.vector_view(spark, sf_dir)
    return vectors.cosine_pairs(v, "vec_id", "v", p["pair_threshold"] if threshold is None else threshold)


def topic_probabilities(d: DataFrame) -> DataFrame:
    """M14 fixture: softmax of the cosine to each real topic centroid of the month (topic order)."""
    real = d.filter(F.col("topic") != -1)
    cents = vectors.vector_mean(real, MONTH + ["topic"], "v", "centroid")
    # one row per month with its centroids (bounded by the topics), so each document meets one row, not a product
    month = cents.groupBy(*MONTH).agg(F.array_sort(F.collect_list(F.struct("topic", "centroid"))).alias("_cents"))
    cos = d.join(month, MONTH).withColumn("_cs", F.transform("_cents", lambda s: vec.cosine(F.col("v"), s["centroid"])))
    return cos.withColumn("probs", vec.softmax(F.col("_cs"))).drop("_cs", "_cents")
