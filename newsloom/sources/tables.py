"""Scans of the given parquet tables and the article / vector / topic views built on them.

The article view maps the ``documents`` table onto the reference's article model
(``doc_id, title, content, year, month``). Titles, months, vectors and topics follow
FIXTURES.md section 3; the same definitions are written in SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import vec

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one given table; projections and filters prune and push down."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Parameters of the fixture topics and graphs, the same for every folder; the oracles hold the same values.
FIXTURE_PARAMS = {"min_topic_size": 8, "pair_threshold": 0.35, "component_threshold": 0.35}


def fixture_params() -> dict:
    return dict(FIXTURE_PARAMS)


def article_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles ``doc_id, title, content, year, month`` over ``documents``.

    title = first line cut to 80 characters and trimmed, NULL for every 50th id (offset 7),
    year = 2015 + id mod 2, month = 1 + (id div 2) mod 3.
    """
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    first_line = F.trim(F.substring(F.substring_index("text", "\n", 1), 1, 80))
    return d.select(
        "doc_id",
        F.when(F.col("doc_id") % 50 == 7, F.lit(None).cast("string")).otherwise(first_line).alias("title"),
        F.col("text").alias("content"),
        (F.lit(2015) + F.col("doc_id") % 2).cast("int").alias("year"),
        (F.lit(1) + F.floor(F.col("doc_id") / 2) % 3).cast("int").alias("month"),
    )


def vector_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as DOUBLE arrays: ``vec_id, v, label``."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", vec.as_double(F.col("embedding")).alias("v"), "label")


def article_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that have a vector: ``doc_id, title, content, year, month, v, label``."""
    a = article_view(spark, sf_dir)
    v = vector_view(spark, sf_dir).withColumnRenamed("vec_id", "doc_id")
    return a.join(v, "doc_id")


def topic_assignment(docs: DataFrame, min_topic_size: int, key=("year", "month")) -> DataFrame:
    """Fixture topics: ``label`` groups per key; groups below ``min_topic_size`` -> -1;
    the others re-numbered 0,1,2... by (count desc, label). Adds ``topic``."""
    k = list(key)
    w_cnt = Window.partitionBy(*k, "label")
    sized = docs.withColumn("_n", F.count(F.lit(1)).over(w_cnt))
    big = sized.filter(F.col("_n") >= min_topic_size).select(*k, "label", "_n").distinct()
    ranked = big.withColumn(
        "topic",
        (F.row_number().over(Window.partitionBy(*k).orderBy(F.col("_n").desc(), F.col("label"))) - 1).cast("int"),
    ).select(*k, "label", "topic")
    return (
        sized.drop("_n")
        .join(ranked, k + ["label"], "left")
        .withColumn("topic", F.coalesce(F.col("topic"), F.lit(-1)))
    )


def fixture_sentiment(v: Column) -> Column:
    """Fixture logits: 4 x vector elements 1, 2, 3 (1-based) -> negative, neutral, positive."""
    return F.array(*(F.lit(4.0) * F.element_at(v, i) for i in (1, 2, 3)))
