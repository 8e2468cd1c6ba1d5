"""T5 graph data set and its inputs.

One pass for all months: ``(year, month)`` leads every key, so the month loop of the
reference becomes partitions of the same jobs. The only wide operations are the
window shuffles by ``(year, month[, topic])`` and the blocked pair product of V14.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import vec
from newsloom.operators import ordering, sentiment, vectors
from newsloom.sources import tables

MONTH = ["year", "month"]


def graph_inputs(spark: SparkSession, sf_dir: str) -> dict:
    """Fixture inputs of T5 from the given tables (FIXTURES.md section 3)."""
    p = tables.fixture_params()
    docs = tables.article_vectors(spark, sf_dir)
    assigned = tables.topic_assignment(docs, p["min_topic_size"])
    scored = sentiment.probabilities_from_logits(assigned, tables.fixture_sentiment(F.col("v")))
    return {"docs": scored, "min_topic_size": p["min_topic_size"], "threshold": p["pair_threshold"]}


def topic_info(assigned: DataFrame) -> DataFrame:
    """M16 (fixture form): ``year, month, topic, count, name``; name from the label."""
    return assigned.groupBy(*MONTH, "topic").agg(
        F.count(F.lit(1)).alias("count"),
        F.min("label").alias("_label"),
    ).select(
        *MONTH,
        "topic",
        "count",
        F.when(F.col("topic") == -1, F.lit("-1_outliers"))
        .otherwise(F.concat(F.col("topic").cast("string"), F.lit("_label"), F.col("_label").cast("string")))
        .alias("name"),
    )


def graph_dataset(docs: DataFrame, min_topic_size: int, threshold: float, keep_outliers: bool = False) -> DataFrame:
    """T5: W5 -> W1 -> J3 -> W2 -> J1 -> F2 -> F3 -> V14 -> J2 -> A4.

    ``docs``: doc_id, year, month, title, v, topic, negative, neutral, positive.
    Months with at most ``min_topic_size`` documents or a single info row are skipped.
    """
    docs = docs.select("doc_id", *MONTH, "title", "v", "topic", "label", "negative", "neutral", "positive")
    info = topic_info(docs)
    w_month = Window.partitionBy(*MONTH)
    months = (
        info.withColumn("_docs", F.sum("count").over(w_month))
        .withColumn("_rows", F.count(F.lit(1)).over(w_month))
        .filter((F.col("_docs") > min_topic_size) & (F.col("_rows") > 1))
    )
    ordered = ordering.centre_out(months, MONTH, keep_outlier=keep_outliers)
    cents = vectors.vector_mean(docs, MONTH + ["topic"], "v", "centroid")
    w_pos = Window.partitionBy(*MONTH).orderBy("topic_pos")
    topics = (
        ordered.join(cents, MONTH + ["topic"])
        .withColumn("_prev", F.lag("centroid").over(w_pos))
        .select(
            *MONTH,
            "topic",
            "topic_pos",
            F.col("name").alias("topic_name"),
            F.coalesce(vec.cosine(F.col("centroid"), F.col("_prev")), F.lit(0.0)).alias("similarity_previous_topic"),
        )
    )
    scaled = sentiment.sentiment_scale(docs, MONTH)
    sizes = vectors.neighbour_count(docs.select("doc_id", *MONTH, "v"), threshold, keys=MONTH)
    w_doc = Window.partitionBy(*MONTH, "topic").orderBy("doc_id")
    cls = sentiment.sentiment_class(F.col("negative"), F.col("neutral"), F.col("positive"))
    rows = (
        scaled.join(topics, MONTH + ["topic"])
        .join(sizes, MONTH + ["doc_id"])
        .withColumn("_pv", F.lag("v").over(w_doc))
        .withColumn("_pd", F.lag("doc_id").over(w_doc))
        .withColumn("_cls", cls)
    )
    out = rows.select(
        *MONTH,
        F.col("doc_id").alias("document1"),
        "topic",
        "topic_pos",
        F.lit(1.0).alias("probabilities"),
        F.coalesce(F.col("title"), F.lit("no title")).alias("document1_title"),
        F.col("size").alias("document1_size"),
        F.coalesce(F.col("_pd"), F.col("doc_id")).alias("document2"),
        F.when(F.col("_pd").isNull(), F.lit(0.0)).otherwise(vec.cosine(F.col("v"), F.col("_pv"))).alias(
            "similarity_previous_document"
        ),
        "similarity_previous_topic",
        "topic_name",
        F.col("_cls.label").alias("sentimet_classification"),
        F.col("_cls.score").alias("sentimet_score"),
        "setiment_scale",
    )
    return out.withColumn(
        "setiment_scale_mean", F.avg("setiment_scale").over(Window.partitionBy(*MONTH, "topic"))
    )


def graph_dataset_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph_inputs(spark, sf_dir)
    return graph_dataset(g["docs"], g["min_topic_size"], g["threshold"])
