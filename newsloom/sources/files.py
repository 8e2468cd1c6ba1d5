"""Sources and sinks: readers with explicit schemas, partitioned writers,
JSON news pages, date spines. Formats: parquet (default), CSV, JSON, text, .npy via binaryFile.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
])

NEWS_PAGE_SCHEMA = T.StructType([
    T.StructField("value", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("datePublished", T.StringType()),
    ]))),
])


def read_articles(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType = ARTICLE_SCHEMA) -> DataFrame:
    """CSV with header and quoted multi-line text, explicit schema (no inference)."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').option("sep", sep).csv(path))


def read_dense_vectors(spark: SparkSession, path: str, id_offset: int = 0) -> DataFrame:
    """``.npy`` matrices -> one row per vector (file, row, vector); files are read by
    ``binaryFile`` and decoded inside tasks (one file per task at most in memory)."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "path string, row long, vector array<double>"

    def decode(batches):
        import io

        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"]):
                m = np.load(io.BytesIO(c))
                m = m.reshape(len(m), -1)
                yield pd.DataFrame({"path": p, "row": np.arange(len(m), dtype=np.int64) + id_offset,
                                    "vector": list(m.astype(np.float64))})

    return raw.mapInPandas(decode, schema)


def read_sparse_vectors(spark: SparkSession, path: str) -> DataFrame:
    """S3: sparse vectors stored as COO parquet (doc, term, weight)."""
    return spark.read.parquet(path).select(F.col("doc").cast("long"), F.col("term").cast("string"),
                                           F.col("weight").cast("double"))


def read_between(df: DataFrame, date_col: str, start: str = "2000-01-01", end: str = "2030-01-01") -> DataFrame:
    """Date-range read; the filter reaches the parquet scan (pushed down)."""
    return df.filter((F.col(date_col) >= F.lit(start).cast("timestamp")) & (F.col(date_col) < F.lit(end).cast("timestamp")))


def read_named(spark: SparkSession, path: str, fmt: str = "parquet", nrows: int | None = None, **options) -> DataFrame:
    """Read by format with an optional row cap (a LIMIT the optimiser pushes down)."""
    df = spark.read.format(fmt).options(**options).load(path)
    return df.limit(nrows) if nrows is not None else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    """Replace or append; ``partition_by=('year', 'month')`` writes one folder per month."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def month_manifest(df: DataFrame) -> DataFrame:
    """The months present, with the reference's prefix text."""
    m = df.select("year", "month").distinct()
    return m.withColumn("year_month", F.concat(F.col("year").cast("string"), F.lit("_"), F.col("month").cast("string"), F.lit("_")))


def parse_news_json(df: DataFrame, json_col: str, schema: T.StructType = NEWS_PAGE_SCHEMA) -> DataFrame:
    """A page of articles (JSON) -> one row per article; body -> content; year and month."""
    parsed = df.select(F.from_json(F.col(json_col), schema).alias("_p"))
    items = parsed.select(F.inline("_p.value"))
    ts = F.to_timestamp("datePublished")
    return items.select(F.col("id"), F.col("title"), F.col("body").alias("content"), ts.alias("date_published"),
                        F.year(ts).alias("year"), F.month(ts).alias("month"))


def date_spine(start: F.Column, end: F.Column) -> F.Column:
    """Every calendar date from start to end (inclusive) as an array (explode it)."""
    return F.sequence(start.cast("date"), end.cast("date"), F.expr("interval 1 day"))


def date_chunks(spine: DataFrame, date_col: str = "date", days: int = 6) -> DataFrame:
    """Consecutive inclusive ranges of ``days`` dates; the last one is clamped.

    The chunk of a date is its day offset from the first date div ``days``; the first date
    is a scalar subquery, so no row numbering pass is needed."""
    first = spine.agg(F.min(date_col)).scalar()
    c = spine.withColumn("chunk", F.floor(F.datediff(F.col(date_col), first) / days).cast("long"))
    return c.groupBy("chunk").agg(F.min(date_col).alias("start"), F.max(date_col).alias("end"))


def append_sources(*dfs: DataFrame) -> DataFrame:
    """Stack several article files by column name (missing columns NULL)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
