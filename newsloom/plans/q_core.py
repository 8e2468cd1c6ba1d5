"""Flagship and first-slice queries: S13, T5."""

from __future__ import annotations

from newsloom.plans import dataset
from newsloom.plans.registry import query
from newsloom.plans.sql_common import ARTICLES, TOPICS, with_
from newsloom.sources import tables

T5_CTES = """
info AS (SELECT year, month, topic, count(*) AS cnt, min(label) AS lbl FROM sen GROUP BY year, month, topic),
mon AS (SELECT year, month FROM info GROUP BY year, month HAVING sum(cnt) > 8 AND count(*) > 1),
ord AS (
  SELECT i.year, i.month, i.topic,
         CASE WHEN i.topic = -1 THEN '-1_outliers'
              ELSE CAST(i.topic AS VARCHAR) || '_label' || CAST(i.lbl AS VARCHAR) END AS topic_name,
         row_number() OVER (PARTITION BY i.year, i.month
                            ORDER BY CASE WHEN i.topic % 2 = 1 THEN -i.topic ELSE i.topic END) AS topic_pos
  FROM info i JOIN mon USING (year, month) WHERE i.topic <> -1),
el AS (SELECT year, month, topic, generate_subscripts(v, 1) AS p, unnest(v) AS x FROM sen),
cen AS (SELECT year, month, topic, list(m ORDER BY p) AS c
        FROM (SELECT year, month, topic, p, avg(x) AS m FROM el GROUP BY year, month, topic, p)
        GROUP BY year, month, topic),
tp AS (
  SELECT o.*, coalesce(list_cosine_similarity(c.c, lag(c.c) OVER (PARTITION BY o.year, o.month ORDER BY o.topic_pos)), 0.0)
           AS similarity_previous_topic
  FROM ord o JOIN cen c USING (year, month, topic)),
sc AS (
  SELECT sen.*,
         (neutral + positive - negative - min(neutral + positive - negative) OVER w)
           / nullif(max(neutral + positive - negative) OVER w - min(neutral + positive - negative) OVER w, 0)
           AS setiment_scale
  FROM sen WINDOW w AS (PARTITION BY year, month)),
sz AS (
  SELECT a.year, a.month, a.doc_id, count(*) AS document1_size
  FROM sen a JOIN sen b ON a.year = b.year AND a.month = b.month AND list_cosine_similarity(a.v, b.v) >= 0.35
  GROUP BY a.year, a.month, a.doc_id),
g5 AS (
SELECT s.year, s.month, s.doc_id AS document1, s.topic, tp.topic_pos,
       CAST(1.0 AS DOUBLE) AS probabilities,
       coalesce(s.title, 'no title') AS document1_title,
       sz.document1_size,
       coalesce(lag(s.doc_id) OVER wd, s.doc_id) AS document2,
       CASE WHEN lag(s.doc_id) OVER wd IS NULL THEN 0.0
            ELSE list_cosine_similarity(s.v, lag(s.v) OVER wd) END AS similarity_previous_document,
       tp.similarity_previous_topic,
       tp.topic_name,
       CASE WHEN neutral >= negative AND neutral >= positive THEN 'neutral'
            WHEN negative > neutral AND negative > positive THEN 'negative' ELSE 'positive' END
         AS sentimet_classification,
       CASE WHEN neutral >= negative AND neutral >= positive THEN neutral
            WHEN negative > neutral AND negative > positive THEN negative ELSE positive END AS sentimet_score,
       setiment_scale,
       avg(setiment_scale) OVER (PARTITION BY s.year, s.month, s.topic) AS setiment_scale_mean
FROM sc s JOIN tp USING (year, month, topic) JOIN sz USING (year, month, doc_id)
WINDOW wd AS (PARTITION BY s.year, s.month, s.topic ORDER BY s.doc_id))"""
T5_FINAL = """
SELECT year, month, document1, topic, topic_pos, probabilities, document1_title, document1_size, document2,
       round(similarity_previous_document, 4) AS similarity_previous_document,
       round(similarity_previous_topic, 4) AS similarity_previous_topic, topic_name, sentimet_classification,
       round(sentimet_score, 4) AS sentimet_score, round(setiment_scale, 4) AS setiment_scale,
       round(setiment_scale_mean, 4) AS setiment_scale_mean
FROM g5"""
T5_SQL = with_(TOPICS, T5_CTES, T5_FINAL)


@query("t5_graph_dataset", T5_SQL)
def t5_graph_dataset(spark, sf_dir):
    """T5: the graph data set per month (flagship)."""
    return dataset.graph_dataset_query(spark, sf_dir)


@query("s13_article_view", with_(ARTICLES, " SELECT doc_id, title, year, month, length(content) AS content_chars FROM art"))
def s13_article_view(spark, sf_dir):
    from pyspark.sql import functions as F
    a = tables.article_view(spark, sf_dir)
    return a.select("doc_id", "title", "year", "month", F.length("content").cast("long").alias("content_chars"))


@query("w01_prev_topic_similarity", with_(TOPICS, T5_CTES, """
 SELECT DISTINCT year, month, topic, topic_pos, round(similarity_previous_topic, 4) AS similarity_previous_topic FROM g5"""))
def w01(spark, sf_dir):
    """Cosine of each topic's centroid to the previous topic in display order (first 0)."""
    g = dataset.graph_dataset_query(spark, sf_dir)
    return g.select("year", "month", "topic", "topic_pos", "similarity_previous_topic").distinct()


@query("w02_prev_doc_similarity", with_(TOPICS, T5_CTES, """
 SELECT year, month, document1, document2, round(similarity_previous_document, 4) AS similarity_previous_document FROM g5"""))
def w02(spark, sf_dir):
    """Previous document inside the topic (itself for the first) and the similarity to it (first 0)."""
    g = dataset.graph_dataset_query(spark, sf_dir)
    return g.select("year", "month", "document1", "document2", "similarity_previous_document")
