"""Structured Streaming: the reference's polling loop re-aimed as a file
stream of news pages, with watermarks, window counts, de-duplication and a monthly sink.

Event time arrives as ``timestamp_ntz`` from parquet; watermarks need ``timestamp``, so
streams cast it (session time zone UTC).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators import clean
from newsloom.sources import files


def stream_articles(spark, path: str, max_files: int = 100) -> DataFrame:
    """New JSON pages landing in ``path`` -> article rows (S9 on a file stream)."""
    raw = spark.readStream.schema(T.StructType([T.StructField("page", T.StringType())])).option(
        "maxFilesPerTrigger", max_files).json(path)
    return files.parse_news_json(raw, "page")


def event_time(df: DataFrame, col: str = "ts", out: str = "event_time") -> DataFrame:
    """Cast a zone-free timestamp to ``timestamp`` for watermarks."""
    return df.withColumn(out, F.col(col).cast("timestamp"))


def stream_dedup(df: DataFrame, key: Sequence[str], time_col: str, delay: str = "1 day") -> DataFrame:
    """R2: the same article seen on several pages/days kept once (state bounded by the watermark)."""
    return df.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(key))


def stream_counts(df: DataFrame, time_col: str, size: str = "1 day", slide: str | None = None,
                  session_gap: str | None = None, delay: str = "1 hour", by: Sequence[str] = ()) -> DataFrame:
    """Counts per tumbling / sliding / session window; late rows past the watermark drop."""
    w = df.withWatermark(time_col, delay)
    win = F.session_window(time_col, session_gap) if session_gap else F.window(time_col, size, slide)
    return w.groupBy(win.alias("window"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum"))


def batch_counts(df: DataFrame, time_col: str, size: str = "1 day", slide: str | None = None,
                 by: Sequence[str] = ()) -> DataFrame:
    """R3 batch twin: the same window aggregation on a static frame (for the SQL oracle)."""
    win = F.window(time_col, size, slide)
    return df.groupBy(win.alias("window"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum"))


def stream_enrich(df: DataFrame, keywords: Sequence[str], k: int = 5) -> DataFrame:
    """Stateless enrichment on a stream: keyword hits and the cleaned title."""
    low = df.withColumn("_low", F.lower("content"))
    return low.withColumn("hits", clean.keyword_hits(F.col("_low"), keywords).cast("long")).withColumn(
        "relevant", F.col("hits") >= k).drop("_low")


def stream_monthly_sink(df: DataFrame, path: str, checkpoint: str, trigger_once: bool = True):
    """Every micro-batch written to its month partition; a batch id column makes replays
    idempotent (a rerun batch overwrites its own files only: dynamic partition overwrite)."""

    def write(batch: DataFrame, batch_id: int):
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("year", "month", "batch_id").parquet(path))

    w = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def update_log(df: DataFrame, path: str, checkpoint: str):
    """An aggregated stream in update mode as files: each micro-batch writes the rows that it changed under its own
    ``batch_id``, so a replayed batch overwrites its files, and groups behind the watermark leave the state.
    ``latest`` reads the last row of each group. A stream without rows leaves an empty table."""
    df.sparkSession.createDataFrame([], df.schema).write.mode("append").parquet(path)

    def write(batch: DataFrame, batch_id: int):
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))

    return df.writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The last written row of each group of an ``update_log`` with the stream's ``schema``."""
    rows = spark.read.schema(T.StructType(list(schema.fields) + [T.StructField("batch_id", T.LongType())])).parquet(path)
    values = [f.name for f in schema.fields if f.name not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col("batch_id")).alias("_last"))
    return last.select(*keys, "_last.*")


def stream_keyword_state(df: DataFrame, keywords: Sequence[str], time_col: str, delay: str = "1 day") -> DataFrame:
    """Running count of articles per keyword and month (streaming aggregation, update mode)."""
    kw = F.array(*[F.lit(w) for w in keywords])
    low = df.withColumn("_low", F.lower("content"))
    ex = low.select(time_col, "year", "month", F.explode(F.filter(kw, lambda w: F.instr(F.col("_low"), w) > 0)).alias("keyword"))
    return ex.withWatermark(time_col, delay).groupBy("keyword", "year", "month").agg(F.count(F.lit(1)).alias("n"))
