"""Queries of the window, ordering, top-k and scalar-function families with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import scalar as SC
from newsloom.functions import vec
from newsloom.operators import aggregate as A
from newsloom.operators import ordering as O
from newsloom.operators import sentiment as S
from newsloom.operators import vectors as V
from newsloom.plans import dataset
from newsloom.plans import fixtures as X
from newsloom.plans.registry import query
from newsloom.plans.sql_common import ARTICLES, GLOBAL_EDGES, PROBS, TOPICS, with_
from newsloom.sources import tables

MONTH = ["year", "month"]

_INFO_SQL = " info AS (SELECT year, month, topic, count(*) AS n FROM asg GROUP BY year, month, topic)"


def _info(spark, sf_dir):
    return A.topic_sizes(X.docs(spark, sf_dir))


@query("w05_centre_out", with_(TOPICS, _INFO_SQL, """
 SELECT year, month, topic, row_number() OVER (PARTITION BY year, month
          ORDER BY CASE WHEN topic % 2 = 1 THEN -topic ELSE topic END) AS topic_pos
 FROM info WHERE topic <> -1"""))
def w05(spark, sf_dir):
    return O.centre_out(_info(spark, sf_dir)).select(*MONTH, "topic", "topic_pos")


@query("w05_centre_out_keep", with_(TOPICS, _INFO_SQL, """
 SELECT year, month, topic, row_number() OVER (PARTITION BY year, month
          ORDER BY CASE WHEN topic = -1 THEN NULL WHEN topic % 2 = 1 THEN -topic ELSE topic END NULLS LAST) AS topic_pos
 FROM info"""))
def w05k(spark, sf_dir):
    return O.centre_out(_info(spark, sf_dir), keep_outlier=True).select(*MONTH, "topic", "topic_pos")


@query("w07_half_flip", with_(TOPICS, _INFO_SQL, """
 r AS (SELECT year, month, topic, count(*) OVER (PARTITION BY year, month) AS k FROM info WHERE topic <> -1)""", """
 SELECT year, month, topic, row_number() OVER (PARTITION BY year, month ORDER BY
          CASE WHEN topic = 0 THEN 0 WHEN topic <= (k - 1) // 2 THEN -topic ELSE topic END) AS topic_pos FROM r"""))
def w07(spark, sf_dir):
    return O.half_flip(_info(spark, sf_dir), MONTH).select(*MONTH, "topic", "topic_pos")


def _graph(spark, sf_dir):
    return dataset.graph_dataset_query(spark, sf_dir)


@query("w03_topic_boundary", with_(TOPICS, """
 ord AS (SELECT year, month, topic, row_number() OVER (PARTITION BY year, month
            ORDER BY CASE WHEN topic % 2 = 1 THEN -topic ELSE topic END) AS topic_pos
         FROM (SELECT DISTINCT year, month, topic FROM asg WHERE topic <> -1))""", """
 SELECT a.year, a.month, a.doc_id, coalesce(a.topic - lag(a.topic) OVER (PARTITION BY a.year, a.month ORDER BY o.topic_pos, a.doc_id), 0) AS topic_change
 FROM asg a JOIN ord o USING (year, month, topic)"""))
def w03(spark, sf_dir):
    d = X.docs(spark, sf_dir)
    pos = O.centre_out(A.topic_sizes(d))
    g = d.join(pos.select(*MONTH, "topic", "topic_pos"), MONTH + ["topic"])
    return O.topic_boundary(g, MONTH, ["topic_pos", "doc_id"]).select(*MONTH, "doc_id", "topic_change")


@query("w04_row_position", with_(ARTICLES, " SELECT doc_id, row_number() OVER (PARTITION BY year, month ORDER BY doc_id) - 1 AS row_pos FROM art"))
def w04(spark, sf_dir):
    return O.row_position(tables.article_view(spark, sf_dir), MONTH, ["doc_id"]).select("doc_id", "row_pos")


_P_SQL = """
 pp AS (SELECT year, month, topic, doc_id,
               CASE WHEN probs[topic + 1] >= 0.2 THEN 1.0 ELSE round(probs[topic + 1], 4) END AS p
        FROM prb WHERE topic <> -1),
 st AS (SELECT *, sum(CASE WHEN p = 1 THEN 1 ELSE 0 END) OVER w AS ones, count(*) OVER w AS n,
               row_number() OVER (PARTITION BY year, month, topic, p = 1 ORDER BY doc_id) - 1 AS rp
        FROM pp WINDOW w AS (PARTITION BY year, month, topic))"""


@query("w06_prob_centre", with_(TOPICS, PROBS, _P_SQL, """
 SELECT year, month, topic, doc_id, row_number() OVER (PARTITION BY year, month, topic ORDER BY
   CASE WHEN ones = 0 OR ones = n THEN 0 WHEN p = 1 THEN 1 WHEN rp % 2 = 0 THEN 0 ELSE 2 END,
   CASE WHEN ones = 0 OR ones = n THEN 0.0 WHEN p = 1 THEN 0.0 WHEN rp % 2 = 0 THEN p ELSE -p END,
   CASE WHEN ones = 0 OR ones = n OR p = 1 THEN doc_id ELSE rp END) AS doc_pos
 FROM st"""))
def w06(spark, sf_dir):
    d = X.topic_probabilities(X.docs(spark, sf_dir)).filter(F.col("topic") != -1)
    own = F.element_at("probs", F.col("topic") + 1)
    d = d.withColumn("p", F.when(own >= 0.2, F.lit(1.0)).otherwise(F.round(own, 4)))
    return O.prob_centre(d, MONTH + ["topic"], "p").select(*MONTH, "topic", "doc_id", "doc_pos")


@query("w08_order_by_size", with_(TOPICS, """
 SELECT year, month, doc_id, row_number() OVER (PARTITION BY year, month ORDER BY topic = -1, sz DESC, topic, doc_id) AS order_pos
 FROM (SELECT *, count(*) OVER (PARTITION BY year, month, topic) AS sz FROM asg)"""))
def w08(spark, sf_dir):
    return O.order_by_size(X.docs(spark, sf_dir), MONTH).select(*MONTH, "doc_id", "order_pos")


@query("w09_order_centre", with_(TOPICS, """
 sz AS (SELECT year, month, topic, count(*) AS s FROM asg GROUP BY ALL),
 rk2 AS (SELECT *, row_number() OVER (PARTITION BY year, month ORDER BY s DESC, topic) - 1 AS r FROM sz),
 ag AS (SELECT year, month,
               count_if(NOT (topic = -1 AND r = 0) AND r % 2 = 0) AS ne, count_if(r % 2 = 1) AS no,
               arg_min(s, r) FILTER (WHERE r % 2 = 1) AS fo,
               arg_max(s, r) FILTER (WHERE NOT (topic = -1 AND r = 0) AND r % 2 = 0) AS le
        FROM rk2 GROUP BY year, month),
 tk AS (SELECT rk2.*, CASE WHEN topic = -1 AND r = 0 THEN
                            CASE WHEN no > ne OR (no = ne AND NOT coalesce(fo >= le, false)) THEN 0 ELSE 3 END
                          WHEN r % 2 = 0 THEN 1 ELSE 2 END AS seg,
               CASE WHEN r % 2 = 0 THEN s ELSE -s END AS within
        FROM rk2 JOIN ag USING (year, month))""", """
 SELECT a.year, a.month, a.doc_id, row_number() OVER (PARTITION BY a.year, a.month ORDER BY tk.seg, tk.within, tk.r, a.doc_id) AS order_pos
 FROM asg a JOIN tk USING (year, month, topic)"""))
def w09(spark, sf_dir):
    return O.order_centre(X.docs(spark, sf_dir), MONTH).select(*MONTH, "doc_id", "order_pos")


@query("w11_overlap_batches", with_(ARTICLES, """
 p AS (SELECT doc_id, row_number() OVER (ORDER BY year, month, doc_id) - 1 AS row_pos, count(*) OVER () AS n FROM art),
 q AS (SELECT doc_id, row_pos, least(row_pos // 300, greatest(n // 300 - 1, 0)) AS own, greatest(n // 300 - 1, 0) AS last FROM p)""", """
 SELECT doc_id, row_pos, own AS batch FROM q
 UNION ALL SELECT doc_id, row_pos, own + 1 AS batch FROM q WHERE own + 1 <= last AND row_pos >= (own + 1) * 300 - 150"""))
def w11(spark, sf_dir):
    a = tables.article_view(spark, sf_dir).select("doc_id", *MONTH)
    return O.overlap_batches(a, MONTH + ["doc_id"], 300, 150).select("doc_id", "row_pos", "batch")


@query("w12_chunk_ranges", """
 WITH n AS (SELECT count(*) AS n FROM documents)
 SELECT id AS chunk, id * (n // 7) AS start, CASE WHEN id = 7 THEN n ELSE (id + 1) * (n // 7) END AS "end"
 FROM range(0, 8) t(id), n WHERE id * (n // 7) < CASE WHEN id = 7 THEN n ELSE (id + 1) * (n // 7) END""")
def w12(spark, sf_dir):
    return O.chunk_ranges(tables.read_table(spark, sf_dir, "documents"), 7).select(
        "chunk", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("w13_running_position", with_(TOPICS, """
 SELECT doc_id, round(sum(neutral) OVER (PARTITION BY year, month ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running
 FROM sen"""))
def w13(spark, sf_dir):
    return O.running_sum(X.docs(spark, sf_dir), MONTH, ["doc_id"], "neutral", "running").select("doc_id", "running")


# ------------------------------------------------------------------ K
@query("k01_sort_articles", with_(ARTICLES, " SELECT doc_id, year, month FROM art ORDER BY year, month, doc_id"))
def k01(spark, sf_dir):
    return tables.article_view(spark, sf_dir).select("doc_id", *MONTH).orderBy(*MONTH, "doc_id")


@query("k02_head", with_(ARTICLES, " SELECT doc_id, title FROM art ORDER BY year, month, doc_id LIMIT 25"))
def k02(spark, sf_dir):
    return tables.article_view(spark, sf_dir).orderBy(*MONTH, "doc_id").select("doc_id", "title").limit(25)


@query("k06_dominant_topic", with_(TOPICS, PROBS, """
 SELECT doc_id, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS best_topic, round(list_max(probs), 4) AS best_prob FROM prb"""))
def k06(spark, sf_dir):
    d = X.topic_probabilities(X.docs(spark, sf_dir))
    b = O.dominant_topic(F.col("probs"))
    return d.select("doc_id", b["topic"].alias("best_topic"), b["prob"].alias("best_prob"))


@query("k07_topics_above", with_(TOPICS, PROBS, """
 z AS (SELECT doc_id, generate_subscripts(probs, 1) - 1 AS topic, unnest(probs) AS prob FROM prb),
 hit AS (SELECT doc_id, CAST(topic AS INTEGER) AS topic, prob FROM z WHERE prob >= 0.2)""", """
 SELECT doc_id, topic, round(prob, 4) AS prob FROM hit
 UNION ALL SELECT doc_id, -1, 0.0 FROM prb WHERE doc_id NOT IN (SELECT doc_id FROM hit)"""))
def k07(spark, sf_dir):
    d = X.topic_probabilities(X.docs(spark, sf_dir))
    ex = d.select("doc_id", F.explode(O.topics_above(F.col("probs"), 0.2)).alias("t"))
    return ex.select("doc_id", F.col("t.topic").alias("topic"), F.col("t.prob").alias("prob"))


@query("k09_one_vs_all", """
 WITH vv AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
 SELECT b.vec_id, round(list_cosine_similarity(b.v, a.v), 4) AS cosine FROM vv a, vv b WHERE a.vec_id = 0""")
def k09(spark, sf_dir):
    return V.one_vs_all(tables.vector_view(spark, sf_dir), 0, "vec_id", "v")


@query("k10_most_similar_each", with_(GLOBAL_EDGES, """
 bp AS (SELECT a.vec_id AS id, arg_max(b.vec_id, (list_cosine_similarity(a.v, b.v), -b.vec_id)) AS best_id,
               max(list_cosine_similarity(a.v, b.v)) AS best_sim
        FROM vv a JOIN vv b ON a.vec_id <> b.vec_id GROUP BY a.vec_id)""", """
 SELECT id, best_id, round(best_sim, 4) AS best_sim FROM bp"""))
def k10(spark, sf_dir):
    return V.best_partner(tables.vector_view(spark, sf_dir), "vec_id", "v")


@query("k12_top_similar_topics", with_(TOPICS, PROBS, """
 ts AS (SELECT a.year, a.month, a.topic, b.topic AS other, list_cosine_similarity(a.c, b.c) AS sim
        FROM cent a JOIN cent b ON a.year = b.year AND a.month = b.month AND a.topic <> b.topic)""", """
 SELECT year, month, topic, other, round(sim, 4) AS sim, rank FROM (
   SELECT *, row_number() OVER (PARTITION BY year, month, topic ORDER BY sim DESC, other) AS rank FROM ts) WHERE rank <= 3"""))
def k12(spark, sf_dir):
    d = X.docs(spark, sf_dir).filter(F.col("topic") != -1)
    c = V.vector_mean(d, MONTH + ["topic"], "v", "c")
    o = c.select(*MONTH, F.col("topic").alias("other"), F.col("c").alias("oc"))
    ts = c.join(o, MONTH).filter(F.col("topic") != F.col("other")).select(
        *MONTH, "topic", "other", vec.cosine(F.col("c"), F.col("oc")).alias("sim"))
    return O.top_k(ts, MONTH + ["topic"], [F.col("sim").desc(), F.col("other")], 3)


# ------------------------------------------------------------------ F
@query("f01_softmax", with_(TOPICS, """
 SELECT doc_id, round(negative, 4) AS negative, round(neutral, 4) AS neutral, round(positive, 4) AS positive FROM sen"""))
def f01(spark, sf_dir):
    return X.docs(spark, sf_dir).select("doc_id", "negative", "neutral", "positive")


@query("f02_sentiment_class", with_(TOPICS, """
 SELECT doc_id, CASE WHEN neutral >= negative AND neutral >= positive THEN 'neutral'
                     WHEN negative > neutral AND negative > positive THEN 'negative' ELSE 'positive' END AS label,
        round(greatest(negative, neutral, positive), 4) AS score FROM sen"""))
def f02(spark, sf_dir):
    c = S.sentiment_class(F.col("negative"), F.col("neutral"), F.col("positive"))
    return X.docs(spark, sf_dir).select("doc_id", c["label"].alias("label"), c["score"].alias("score"))


@query("f03_sentiment_scale", with_(TOPICS, """
 SELECT doc_id, round((t - min(t) OVER w) / nullif(max(t) OVER w - min(t) OVER w, 0), 4) AS setiment_scale
 FROM (SELECT *, neutral + positive - negative AS t FROM sen) WINDOW w AS (PARTITION BY year, month)"""))
def f03(spark, sf_dir):
    return S.sentiment_scale(X.docs(spark, sf_dir)).select("doc_id", "setiment_scale")


@query("f04_sentiment_colour", with_(TOPICS, """
 SELECT doc_id, CASE WHEN neutral >= negative AND neutral >= positive THEN '#B0B0B0'
                     WHEN negative > neutral AND negative > positive THEN '#FF0000' ELSE '#FFD700' END AS colour FROM sen"""))
def f04(spark, sf_dir):
    c = S.sentiment_class(F.col("negative"), F.col("neutral"), F.col("positive"))
    return X.docs(spark, sf_dir).select("doc_id", S.sentiment_colour(c["label"]).alias("colour"))


@query("f05_marker_size", """
 SELECT doc_id, round(6.0 + coalesce((n_chars - min(n_chars) OVER w) / nullif(max(n_chars) OVER w - min(n_chars) OVER w, 0), 0.0) * 10.0, 4) AS marker
 FROM documents WINDOW w AS (PARTITION BY lang)""")
def f05(spark, sf_dir):
    d = tables.read_table(spark, sf_dir, "documents")
    return d.select("doc_id", SC.marker_size(F.col("n_chars").cast("double"), ["lang"]).alias("marker"))


@query("f06_marker_size_inv", """
 SELECT doc_id, round((1.0 - 1.0 / n_chars) * 5 + 1, 4) AS marker FROM documents""")
def f06(spark, sf_dir):
    d = tables.read_table(spark, sf_dir, "documents")
    return d.select("doc_id", SC.marker_size_inv(F.col("n_chars").cast("double"), 5).alias("marker"))


@query("f08_edge_width", with_(GLOBAL_EDGES, " SELECT id1, id2, round(0.3 * pow(weight, 1.75), 4) AS width FROM gedges"))
def f08(spark, sf_dir):
    return X.global_edges(spark, sf_dir).select("id1", "id2", SC.edge_width(F.col("weight")).alias("width"))


@query("f09_month_prefix", with_(ARTICLES, " SELECT DISTINCT CAST(year AS VARCHAR) || '_' || CAST(month AS VARCHAR) || '_' AS year_month FROM art"))
def f09(spark, sf_dir):
    return tables.article_view(spark, sf_dir).select(SC.month_prefix(F.col("year"), F.col("month")).alias("year_month")).distinct()


@query("f10_round", """
 SELECT o_orderkey, round(o_totalprice, 1) AS price_r1, round(o_totalprice / 7, 6) AS price_r6 FROM orders""", rounded=False)
def f10(spark, sf_dir):
    o = tables.read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.round("o_totalprice", 1).alias("price_r1"), F.round(F.col("o_totalprice") / 7, 6).alias("price_r6"))


@query("f11_polarity", with_(GLOBAL_EDGES, " SELECT id1, id2, CASE WHEN (id1 + id2) % 2 = 1 THEN 1 ELSE -1 END AS polarity FROM gedges"))
def f11(spark, sf_dir):
    return X.global_edges(spark, sf_dir).select("id1", "id2", SC.polarity(F.col("id1"), F.col("id2")).alias("polarity"))


@query("f12_valid_date", """
 SELECT o_orderkey, try_strptime(lpad(CAST(year(o_orderdate) AS VARCHAR), 4, '0') || '-' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0')
          || '-' || lpad(CAST(28 + o_orderkey % 4 AS VARCHAR), 2, '0'), '%Y-%m-%d') IS NOT NULL AS valid
 FROM orders""")
def f12(spark, sf_dir):
    o = tables.read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", SC.valid_date(F.lit(28) + F.col("o_orderkey") % 4, F.month("o_orderdate"),
                                                F.year("o_orderdate")).alias("valid"))
