"""Update-mode streams as files: the last row of each group, late rows dropped, no rows."""

import time

from pyspark.sql import functions as F

from newsloom.streaming import streams

SCHEMA = "event_id long, ts timestamp, event_type string, value double"


def _land(spark, src, *rows):
    df = spark.createDataFrame([(i, ts, "a", 1.0) for i, ts in rows], "event_id long, ts string, event_type string, value double")
    df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)
    time.sleep(1.1)


def _counts(spark, src):
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src).withColumnRenamed("ts", "event_time")
    return streams.stream_counts(s, "event_time", "1 day", delay="1 hour", by=["event_type"])


def _latest(spark, out, agg):
    rows = streams.latest(spark, out, agg.schema, ["window", "event_type"]).collect()
    return {r.window.start.day: (r.n, r.value_sum) for r in rows}


def test_last_row_of_each_group_over_restarts(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    _land(spark, src, (1, "2024-01-01 10:00:00"), (2, "2024-01-01 11:00:00"), (3, "2024-01-03 10:00:00"))
    _land(spark, src, (4, "2024-01-03 10:30:00"))
    agg = _counts(spark, src)
    streams.update_log(agg, out, ck).awaitTermination()
    assert _latest(spark, out, agg) == {1: (2, 2.0), 3: (2, 2.0)}
    # behind the watermark: dropped; the open day goes on from its state
    _land(spark, src, (5, "2024-01-01 12:00:00"), (6, "2024-01-03 11:00:00"))
    again = _counts(spark, src)
    streams.update_log(again, out, ck).awaitTermination()
    assert _latest(spark, out, again) == {1: (2, 2.0), 3: (3, 3.0)}


def test_stream_without_rows_is_an_empty_table(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    spark.createDataFrame([], SCHEMA).write.parquet(src)
    agg = _counts(spark, src)
    streams.update_log(agg, out, ck).awaitTermination()
    assert _latest(spark, out, agg) == {}
