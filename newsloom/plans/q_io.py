"""Queries of the source/sink (S1-S12) and streaming (R1-R6) families."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators import aggregate as A
from newsloom.plans.q_clean import KEYWORDS
from newsloom.plans.registry import query
from newsloom.plans.sql_common import ARTICLES, with_
from newsloom.session import scratch_path
from newsloom.sources import files, tables
from newsloom.streaming import streams

MONTH = ["year", "month"]


def _articles_out(spark, sf_dir):
    a = tables.article_view(spark, sf_dir)
    return a.select(F.col("doc_id").alias("id"), "title", "content", "year", "month")


@query("s01_read_articles_csv", with_(ARTICLES, " SELECT doc_id AS id, title, year, month, length(content) AS content_len FROM art"))
def s01(spark, sf_dir):
    """S1 + S6: articles written as CSV (quoted multi-line text) and read back with a schema."""
    path = scratch_path(spark, "articles-csv")
    _articles_out(spark, sf_dir).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    r = files.read_articles(spark, path)
    return r.select("id", "title", "year", "month", F.length("content").cast("long").alias("content_len"))


@query("s04_read_between", """
 SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'""",
       rounded=False)
def s04(spark, sf_dir):
    """Date-range read (the range reaches the parquet scan as pushed filters)."""
    o = tables.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return files.read_between(o, "o_orderdate", "1996-01-01", "1998-01-01")


@query("s05_read_named", " SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def s05(spark, sf_dir):
    """Read by name and format."""
    return files.read_named(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet", "parquet").select(
        "l_orderkey", "l_linenumber", "l_quantity")


@query("s07_write_monthly", with_(ARTICLES, " SELECT doc_id AS id, year, month FROM art"))
def s07(spark, sf_dir):
    """One folder per (year, month), all of them read back."""
    path = scratch_path(spark, "monthly")
    files.write_table(_articles_out(spark, sf_dir).select("id", "year", "month"), path, partition_by=MONTH)
    return spark.read.parquet(path).select("id", "year", "month")


@query("s08_month_manifest", with_(ARTICLES, """
 SELECT DISTINCT year, month, CAST(year AS VARCHAR) || '_' || CAST(month AS VARCHAR) || '_' AS year_month FROM art"""))
def s08(spark, sf_dir):
    return files.month_manifest(tables.article_view(spark, sf_dir))


def _pages(spark, sf_dir):
    """News pages built from the documents: one JSON page per article."""
    a = tables.article_view(spark, sf_dir)
    day = F.lit(1) + F.col("doc_id") % 28
    date = F.concat_ws("-", F.col("year").cast("string"), F.lpad(F.col("month").cast("string"), 2, "0"),
                       F.lpad(day.cast("string"), 2, "0"))
    item = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("title"), F.col("content").alias("body"),
                    F.concat(date, F.lit("T08:30:00")).alias("datePublished"))
    return a.select(F.to_json(F.struct(F.array(item).alias("value"))).alias("page"))


@query("s09_parse_news_json", with_(ARTICLES, """
 SELECT CAST(doc_id AS VARCHAR) AS id, title, length(content) AS content_len, year, month FROM art"""))
def s09(spark, sf_dir):
    """JSON pages -> article rows (from_json + inline), year and month from the date."""
    r = files.parse_news_json(_pages(spark, sf_dir), "page")
    return r.select("id", "title", F.length("content").cast("long").alias("content_len"), "year", "month")


@query("s09_parse_props_json", " SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s09b(spark, sf_dir):
    """S9 on the events' JSON column: from_json with a schema."""
    e = tables.read_table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k long").alias("p")).select("event_id", F.col("p.k").alias("k"))


@query("s10_date_spine", """
 SELECT CAST(unnest(generate_series(CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE), INTERVAL 1 DAY)) AS DATE) AS date
 FROM orders""", rounded=False)
def s10(spark, sf_dir):
    """Every calendar date from the first to the last order date."""
    o = tables.read_table(spark, sf_dir, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return o.select(F.explode(files.date_spine(F.col("a"), F.col("b"))).alias("date"))


@query("s11_date_chunks", """
 WITH sp AS (SELECT CAST(unnest(generate_series(CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE), INTERVAL 1 DAY)) AS DATE) AS date FROM orders)
 SELECT CAST((date - (SELECT min(date) FROM sp)) // 6 AS BIGINT) AS chunk, min(date) AS start, max(date) AS "end" FROM sp GROUP BY 1""",
       rounded=False)
def s11(spark, sf_dir):
    """Consecutive 6-day ranges of the date spine, the last one clamped."""
    return files.date_chunks(s10(spark, sf_dir), "date", 6)


@query("s12_append_sources", with_(ARTICLES, """
 SELECT doc_id, title, NULL::INTEGER AS month FROM art WHERE year = 2015 UNION ALL SELECT doc_id, NULL, month FROM art WHERE year = 2016"""))
def s12(spark, sf_dir):
    """Two article sets with different columns stacked by name."""
    a = tables.article_view(spark, sf_dir)
    return files.append_sources(a.filter("year = 2015").select("doc_id", "title"), a.filter("year = 2016").select("doc_id", "month"))


# ------------------------------------------------------------------ streams
_EV_SQL = """
 SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value_sum
 FROM events GROUP BY 1, 2"""


def _window_rows(df):
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "value_sum")


@query("r03_window_counts_batch", _EV_SQL)
def r03b(spark, sf_dir):
    """R3 batch twin: events per day and type (tumbling windows)."""
    e = tables.read_table(spark, sf_dir, "events")
    return _window_rows(streams.batch_counts(streams.event_time(e), "event_time", "1 day", by=["event_type"]))


def _copy_events(spark, sf_dir, parts: int = 4):
    path = scratch_path(spark, "events-stream")
    tables.read_table(spark, sf_dir, "events").repartition(parts).write.parquet(path)
    return path, tables.read_table(spark, sf_dir, "events").schema


@query("r03_stream_counts", _EV_SQL)
def r03(spark, sf_dir):
    """The same counts from a stream over the given file (watermark 1 hour, update mode into files, available-now)."""
    schema = tables.read_table(spark, sf_dir, "events").schema
    # a glob that names the table alone: file streams refuse the plain path of one file
    s = streams.event_time(spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/events.parque[t]"))
    agg = streams.stream_counts(s, "event_time", "1 day", delay="1 hour", by=["event_type"])
    out = scratch_path(spark, "counts-out")
    streams.update_log(agg, out, out + "-ckpt").awaitTermination()
    return _window_rows(streams.latest(spark, out, agg.schema, ["window", "event_type"]))


@query("r02_stream_dedup", """
 SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL""")
def r02(spark, sf_dir):
    """R2: repeated (user, type) events kept once within the watermark (30 days covers the data)."""
    path, schema = _copy_events(spark, sf_dir)
    s = streams.event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    d = streams.stream_dedup(s, ["user_id", "event_type"], "event_time", "30 days")
    out = scratch_path(spark, "dedup-out")
    q = d.select("user_id", "event_type").writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", out + "-ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def _page_dir(spark, sf_dir, parts: int = 4):
    path = scratch_path(spark, "pages")
    _pages(spark, sf_dir).repartition(parts).write.json(path)
    return path


@query("r01_stream_articles", with_(ARTICLES, " SELECT CAST(doc_id AS VARCHAR) AS id, title, year, month FROM art"))
def r01(spark, sf_dir):
    """JSON pages landing as files -> article rows through a file stream."""
    src = _page_dir(spark, sf_dir)
    s = streams.stream_articles(spark, src, max_files=1)
    out = scratch_path(spark, "articles-out")
    q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-ckpt").trigger(
        availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select("id", "title", "year", "month")


@query("r04_stream_enrich", with_(ARTICLES, f"""
 SELECT CAST(doc_id AS VARCHAR) AS id, len(list_filter([{", ".join(repr(k) for k in KEYWORDS)}], lambda w: instr(lower(content), w) > 0)) AS hits
 FROM art"""))
def r04(spark, sf_dir):
    """Stateless enrichment (keyword hits) applied on the article stream."""
    s = streams.stream_enrich(streams.stream_articles(spark, _page_dir(spark, sf_dir), 1), KEYWORDS)
    out = scratch_path(spark, "enrich-out")
    q = s.select("id", "hits").writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", out + "-ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


@query("r05_stream_monthly_sink", with_(ARTICLES, " SELECT year, month, count(*) AS n FROM art GROUP BY year, month"))
def r05(spark, sf_dir):
    """Each micro-batch written to its month partition (foreachBatch, idempotent per batch)."""
    s = streams.stream_articles(spark, _page_dir(spark, sf_dir), 1)
    out = scratch_path(spark, "monthly-sink")
    q = streams.stream_monthly_sink(s, out, out + "-ckpt")
    q.awaitTermination()
    return spark.read.parquet(out).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


@query("r06_stream_keyword_state", with_(ARTICLES, f"""
 kw AS (SELECT unnest([{", ".join(repr(k) for k in KEYWORDS)}]) AS keyword)""", """
 SELECT keyword, year, month, count(*) AS n FROM art JOIN kw ON instr(lower(art.content), kw.keyword) > 0 GROUP BY ALL"""))
def r06(spark, sf_dir):
    """Running article count per keyword and month (streaming state, update mode into files)."""
    s = streams.stream_articles(spark, _page_dir(spark, sf_dir), 1)
    agg = streams.stream_keyword_state(s, KEYWORDS, "date_published", "3650 days")
    out = scratch_path(spark, "keywords-out")
    streams.update_log(agg, out, out + "-ckpt").awaitTermination()
    return streams.latest(spark, out, agg.schema, ["keyword", "year", "month"])
