"""Queries of the aggregation, join, set, ordering and top-k families with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom.functions import vec
from newsloom.operators import aggregate as A
from newsloom.operators import ordering as O
from newsloom.operators import sentiment as S
from newsloom.operators import vectors as V
from newsloom.plans import fixtures as X
from newsloom.plans.registry import query
from newsloom.plans.sql_common import ARTICLES, GLOBAL_EDGES, MONTH_EDGES, PROBS, TOPICS, VECTORS, with_
from newsloom.sources import tables

MONTH = ["year", "month"]


def _art(spark, sf_dir):
    return tables.article_view(spark, sf_dir)


# ------------------------------------------------------------------ A
@query("a01_articles_per_month", with_(ARTICLES, " SELECT year, month, count(*) AS n_articles FROM art GROUP BY year, month"))
def a01(spark, sf_dir):
    return A.articles_per_month(_art(spark, sf_dir))


@query("a01_articles_rollup", with_(ARTICLES, " SELECT year, month, count(*) AS n_articles FROM art GROUP BY ROLLUP (year, month)"))
def a01r(spark, sf_dir):
    return A.articles_per_month(_art(spark, sf_dir), rollup=True)


@query("a01_orders_per_month", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n_articles
FROM orders GROUP BY 1, 2""")
def a01o(spark, sf_dir):
    o = tables.read_table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return A.articles_per_month(o)


@query("a02_topic_sizes", with_(TOPICS, " SELECT year, month, topic, count(*) AS n_docs FROM asg GROUP BY year, month, topic"))
def a02(spark, sf_dir):
    return A.topic_sizes(X.docs(spark, sf_dir))


@query("a03_outlier_report", with_(TOPICS, """
 SELECT year, month, count_if(topic = -1) AS docs_without_topic, count_if(topic <> -1) AS docs_with_topic,
        count(DISTINCT CASE WHEN topic <> -1 THEN topic END) AS n_topics
 FROM asg GROUP BY year, month"""))
def a03(spark, sf_dir):
    return A.outlier_report(X.docs(spark, sf_dir))


@query("a04_topic_mean_sentiment", with_(TOPICS, """
 SELECT doc_id, year, month, topic,
        round(avg(neutral + positive - negative) OVER (PARTITION BY year, month, topic), 4) AS topic_mean
 FROM sen"""))
def a04(spark, sf_dir):
    d = X.docs(spark, sf_dir).withColumn("_t", F.col("neutral") + F.col("positive") - F.col("negative"))
    return A.topic_mean(d, "_t", MONTH + ["topic"], "topic_mean").select("doc_id", *MONTH, "topic", "topic_mean")


_NW_SQL = """
 nw AS (SELECT node, sum(weight) AS sum_weight FROM (
          SELECT id1 AS node, weight FROM gedges UNION ALL SELECT id2 AS node, weight FROM gedges) GROUP BY node)"""


@query("a05_node_weight", with_(GLOBAL_EDGES, _NW_SQL, " SELECT node, round(sum_weight, 4) AS sum_weight FROM nw"))
def a05(spark, sf_dir):
    return A.node_weight(X.global_edges(spark, sf_dir))


@query("a06_size_class", with_(GLOBAL_EDGES, _NW_SQL, """
 SELECT node, CASE WHEN mx = mn THEN 2.5
                   ELSE 1.0 + 0.5 * (greatest(1, ceil((sum_weight - mn) / ((mx - mn) / 7))) - 1) END AS size
 FROM nw, (SELECT min(sum_weight) AS mn, max(sum_weight) AS mx FROM nw)"""))
def a06(spark, sf_dir):
    return A.size_class(A.node_weight(X.global_edges(spark, sf_dir))).select("node", "size")


@query("a07_collect_members", with_(TOPICS, """
 g AS (SELECT year, month, topic, count(*) AS group_size FROM asg GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY year, month ORDER BY group_size DESC, topic) AS group_rank FROM g)""",
 """ SELECT a.year, a.month, a.topic, a.doc_id, row_number() OVER (PARTITION BY a.year, a.month, a.topic ORDER BY a.doc_id) AS member_pos,
        r.group_size, r.group_rank
 FROM asg a JOIN r USING (year, month, topic)"""))
def a07(spark, sf_dir):
    d = X.docs(spark, sf_dir)
    return A.collect_members(d, MONTH + ["topic"], "doc_id", rank_within=MONTH)


@query("a09_sentiment_totals", with_(TOPICS, """
 SELECT year, month, round(sum(negative), 4) AS sum_negative, count_if(negative > 0.5) AS n_negative,
        round(sum(neutral), 4) AS sum_neutral, count_if(neutral > 0.5) AS n_neutral,
        round(sum(positive), 4) AS sum_positive, count_if(positive > 0.5) AS n_positive
 FROM sen GROUP BY year, month"""))
def a09(spark, sf_dir):
    return A.sentiment_totals(X.docs(spark, sf_dir))


@query("a10_topic_date_range", with_(VECTORS, """
 SELECT label AS topic, arg_min(year, year * 100 + month) AS start_year, arg_min(month, year * 100 + month) AS start_month,
        arg_max(year, year * 100 + month) AS end_year, arg_max(month, year * 100 + month) AS end_month, count(*) AS n_docs
 FROM dv GROUP BY label"""))
def a10(spark, sf_dir):
    d = tables.article_vectors(spark, sf_dir).withColumnRenamed("label", "topic")
    return A.topic_date_range(d)


@query("a11_top_topic_share", with_(TOPICS, """
 s AS (SELECT year, month, topic, count(*) AS n FROM asg GROUP BY ALL),
 b AS (SELECT year, month, topic, n, CAST(sum(n) OVER (PARTITION BY year, month) AS BIGINT) AS month_docs,
              row_number() OVER (PARTITION BY year, month ORDER BY n DESC, topic) AS rn FROM s)""",
 """ SELECT year, month, month_docs, topic AS top_topic, n AS top_topic_docs, round(n * 100.0 / month_docs, 2) AS top_topic_pct
 FROM b WHERE rn = 1"""))
def a11(spark, sf_dir):
    return A.top_topic_share(X.docs(spark, sf_dir))


_BEST_SQL = """
 bp AS (SELECT a.vec_id AS id, arg_max(b.vec_id, (list_cosine_similarity(a.v, b.v), -b.vec_id)) AS best_id,
               max(list_cosine_similarity(a.v, b.v)) AS best_sim
        FROM vv a JOIN vv b ON a.vec_id <> b.vec_id GROUP BY a.vec_id)"""


@query("a12_similarity_in_degree", with_(GLOBAL_EDGES, _BEST_SQL, """
 SELECT best_id AS doc, count(*) AS n_best, round(avg(count(*)) OVER (), 4) AS mean_n_best
 FROM bp WHERE best_sim >= 0.35 GROUP BY best_id ORDER BY n_best DESC, doc LIMIT 3"""))
def a12(spark, sf_dir):
    """How often each document is someone's best match (>= t); the top 3 and the mean."""
    p = tables.fixture_params()
    best = V.best_partner(tables.vector_view(spark, sf_dir), "vec_id", "v")
    cnt = best.filter(F.col("best_sim") >= p["pair_threshold"]).groupBy(F.col("best_id").alias("doc")).agg(
        F.count(F.lit(1)).alias("n_best"))
    mean = cnt.agg(F.avg("n_best")).scalar()
    return cnt.withColumn("mean_n_best", mean).orderBy(F.col("n_best").desc(), "doc").limit(3)


@query("a13_no_strong_topic", with_(TOPICS, PROBS, """
 SELECT year, month, count_if(NOT list_bool_or(list_transform(probs, lambda p: p > 0.3))) AS n_no_strong FROM prb GROUP BY year, month"""))
def a13(spark, sf_dir):
    d = X.topic_probabilities(X.docs(spark, sf_dir))
    return d.groupBy(*MONTH).agg(F.count_if(~F.exists("probs", lambda p: p > 0.3)).alias("n_no_strong"))


@query("a14_zero_prob_assigned", with_(TOPICS, PROBS, """
 SELECT year, month, count_if(topic <> -1 AND probs[topic + 1] < 0.2) AS n_low_assigned, max(topic) AS max_topic
 FROM prb GROUP BY year, month"""))
def a14(spark, sf_dir):
    """Documents with a topic whose own probability is low (0 in the reference; < 0.2 on the fixture)."""
    d = X.topic_probabilities(X.docs(spark, sf_dir))
    own = F.element_at("probs", F.col("topic") + 1)
    return d.groupBy(*MONTH).agg(
        F.count_if((F.col("topic") != -1) & (F.when(F.col("topic") != -1, own) < 0.2)).alias("n_low_assigned"),
        F.max("topic").alias("max_topic"))


@query("a15_first_prob_low", with_(TOPICS, PROBS, """
 SELECT year, month, count_if(probs[1] < 0.25) AS n_first_low FROM prb GROUP BY year, month"""))
def a15(spark, sf_dir):
    """Documents whose first-topic probability is low (0 in the reference; < 0.25 on the fixture)."""
    d = X.topic_probabilities(X.docs(spark, sf_dir))
    return d.groupBy(*MONTH).agg(F.count_if(F.element_at("probs", 1) < 0.25).alias("n_first_low"))


@query("a16_topic_text_stats", with_(TOPICS, """
 SELECT year, month, topic, count(*) AS n_docs, length(string_agg(content, ' ' ORDER BY doc_id)) AS joined_length
 FROM asg GROUP BY year, month, topic"""))
def a16(spark, sf_dir):
    return A.topic_text_stats(X.docs(spark, sf_dir), MONTH + ["topic"])


@query("a17_distinct_values", " SELECT DISTINCT label, count(*) OVER () AS n_distinct FROM (SELECT DISTINCT label FROM embeddings)")
def a17(spark, sf_dir):
    return A.distinct_values(tables.read_table(spark, sf_dir, "embeddings"), "label")


@query("a18_assignment_audit", with_(TOPICS, PROBS, """
 au AS (SELECT doc_id, year, month, topic,
               list_position(probs, list_max(probs)) - 1 AS best,
               coalesce(list_bool_or(list_transform(list_filter(list_zip(probs, range(0, len(probs))), lambda z: z[1] >= 0.2),
                                            lambda z: z[2] = topic)), false) AS found
        FROM prb WHERE topic <> -1)""",
 """ SELECT year, month, count_if(best <> topic) AS n_differ, count_if(NOT found) AS n_not_found,
        count_if(best <> topic AND NOT found) AS n_both, count(*) AS n_assigned
 FROM au GROUP BY year, month"""))
def a18(spark, sf_dir):
    """Assigned topic vs best topic, and whether the assigned topic is among those >= t."""
    d = X.topic_probabilities(X.docs(spark, sf_dir)).filter(F.col("topic") != -1)
    best = O.dominant_topic(F.col("probs"))["topic"]
    found = F.exists(O.topics_above(F.col("probs"), 0.2), lambda s: s["topic"] == F.col("topic"))
    a = d.select(*MONTH, "topic", best.alias("_best"), found.alias("_found"))
    return a.groupBy(*MONTH).agg(
        F.count_if(F.col("_best") != F.col("topic")).alias("n_differ"),
        F.count_if(~F.col("_found")).alias("n_not_found"),
        F.count_if((F.col("_best") != F.col("topic")) & ~F.col("_found")).alias("n_both"),
        F.count(F.lit(1)).alias("n_assigned"))


@query("a20_cluster_count_compare", with_(TOPICS, """
 SELECT (SELECT count(DISTINCT label) FROM dv) AS labels_found,
        (SELECT count(*) FROM (SELECT DISTINCT year, month, topic FROM asg WHERE topic <> -1)) AS clusters_selected"""))
def a20(spark, sf_dir):
    d = X.docs(spark, sf_dir)
    labels = d.agg(F.count_distinct("label").alias("labels_found"))
    sel = d.filter(F.col("topic") != -1).select(*MONTH, "topic").distinct().agg(F.count(F.lit(1)))
    return labels.select("labels_found", sel.scalar().alias("clusters_selected"))


# ------------------------------------------------------------------ J
@query("j01_join_sentiment", with_(TOPICS, """
 SELECT a.doc_id, a.year, round(s.negative, 4) AS negative, round(s.neutral, 4) AS neutral, round(s.positive, 4) AS positive
 FROM art a JOIN sen s USING (doc_id)"""))
def j01(spark, sf_dir):
    s = X.docs(spark, sf_dir).select("doc_id", "negative", "neutral", "positive")
    return _art(spark, sf_dir).select("doc_id", "year").join(s, "doc_id")


@query("j02_join_title", with_(ARTICLES, """
 SELECT a.doc_id, coalesce(d.raw_title, coalesce(a.title, 'no_title')) AS title
 FROM art a LEFT JOIN (SELECT a2.doc_id, 'raw: ' || a2.title AS raw_title FROM art a2 JOIN documents d2 USING (doc_id)
                      WHERE d2.lang = 'fr') d USING (doc_id)"""))
def j02(spark, sf_dir):
    """Raw titles given for some documents (the French ones, marked here) override the clean title."""
    a = _art(spark, sf_dir).withColumn("title", F.coalesce("title", F.lit("no_title")))
    fr = tables.read_table(spark, sf_dir, "documents").filter(F.col("lang") == "fr").select("doc_id")
    raw = _art(spark, sf_dir).join(fr, "doc_id").select("doc_id", F.concat(F.lit("raw: "), "title").alias("title"))
    return A.join_title(a.select("doc_id", "title"), raw)


@query("j03_join_topic_info", with_(TOPICS, """
 info AS (SELECT year, month, topic, count(*) AS topic_docs FROM asg GROUP BY ALL)""",
 """ SELECT a.doc_id, a.topic, i.topic_docs FROM asg a JOIN info i USING (year, month, topic)"""))
def j03(spark, sf_dir):
    d = X.docs(spark, sf_dir)
    info = A.topic_sizes(d).withColumnRenamed("n_docs", "topic_docs")
    return d.join(info, MONTH + ["topic"]).select("doc_id", "topic", "topic_docs")


@query("j04_pair_lookup", with_(VECTORS, """
 SELECT a.doc_id AS doc, b.doc_id AS prev, round(list_cosine_similarity(a.v, b.v), 4) AS similarity
 FROM dv a JOIN dv b ON b.doc_id = a.doc_id - 2"""))
def j04(spark, sf_dir):
    """Similarity of given pairs (each document and the one two ids before it)."""
    d = tables.article_vectors(spark, sf_dir).select("doc_id", "v")
    pairs = d.select(F.col("doc_id").alias("doc"), (F.col("doc_id") - 2).alias("prev"))
    a = d.select(F.col("doc_id").alias("doc"), F.col("v").alias("va"))
    b = d.select(F.col("doc_id").alias("prev"), F.col("v").alias("vb"))
    return pairs.join(a, "doc").join(b, "prev").select("doc", "prev", vec.cosine(F.col("va"), F.col("vb")).alias("similarity"))


@query("j05_all_pairs", """
 WITH vv AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
 SELECT a.vec_id AS id1, b.vec_id AS id2, round(list_cosine_similarity(a.v, b.v), 4) AS weight
 FROM vv a, vv b""")
def j05(spark, sf_dir):
    """Every ordered pair incl. self pairs (blocked product, both directions)."""
    v = tables.vector_view(spark, sf_dir)
    return V.both_directions(V.cosine_pairs(v, "vec_id", "v", None, include_self=True))


@query("j06_semi_join", with_(TOPICS, """
 big AS (SELECT year, month, topic FROM asg WHERE topic <> -1 GROUP BY ALL HAVING count(*) >= 10)""",
 """ SELECT doc_id, topic FROM asg WHERE (year, month, topic) IN (SELECT (year, month, topic) FROM big)"""))
def j06(spark, sf_dir):
    d = X.docs(spark, sf_dir)
    big = A.topic_sizes(d).filter((F.col("topic") != -1) & (F.col("n_docs") >= 10)).select(*MONTH, "topic")
    return A.semi_join(d, big, MONTH + ["topic"]).select("doc_id", "topic")


@query("j07_anti_join", with_(TOPICS, MONTH_EDGES, """
 SELECT doc_id, year, month FROM dv WHERE doc_id NOT IN (SELECT id1 FROM medges UNION SELECT id2 FROM medges)"""))
def j07(spark, sf_dir):
    """Documents without any edge in their month."""
    e = X.month_edges(spark, sf_dir)
    ends = A.distinct_nodes(e, MONTH).withColumnRenamed("node", "doc_id")
    d = tables.article_vectors(spark, sf_dir).select("doc_id", *MONTH)
    return A.anti_join(d, ends, MONTH + ["doc_id"])


@query("j08_join_node_size", with_(GLOBAL_EDGES, _NW_SQL, """
 SELECT e.id1, e.id2, round(e.weight, 4) AS weight, round(n.sum_weight, 4) AS sum_weight FROM gedges e JOIN nw n ON n.node = e.id1"""))
def j08(spark, sf_dir):
    e = X.global_edges(spark, sf_dir)
    nw = A.node_weight(e).withColumnRenamed("node", "id1")
    return e.join(nw, "id1")


@query("j09_join_order", with_(GLOBAL_EDGES, """
 ord AS (SELECT vec_id AS id1, row_number() OVER (ORDER BY label, vec_id) AS order_pos FROM vv)""",
 """ SELECT e.id1, e.id2, o.order_pos FROM gedges e JOIN ord o USING (id1)"""))
def j09(spark, sf_dir):
    """Order position of id1 (nodes ordered by label, id) added to each edge."""
    v = tables.vector_view(spark, sf_dir).select(F.col("vec_id").alias("id1"), "label")
    order = O.global_position(v, ["label", "id1"], "_p").withColumn("order_pos", F.col("_p") + 1)
    return X.global_edges(spark, sf_dir).join(order.select("id1", "order_pos"), "id1").select("id1", "id2", "order_pos")


# ------------------------------------------------------------------ U
@query("u01_concat_rows", with_(ARTICLES, """
 SELECT doc_id, title, NULL::VARCHAR AS lang FROM art
 UNION ALL SELECT doc_id, NULL AS title, lang FROM documents"""))
def u01(spark, sf_dir):
    a = _art(spark, sf_dir).select("doc_id", "title")
    b = tables.read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return A.concat_rows(a, b)


@query("u02_distinct_nodes", with_(GLOBAL_EDGES, " SELECT id1 AS node FROM gedges UNION SELECT id2 FROM gedges"))
def u02(spark, sf_dir):
    return A.distinct_nodes(X.global_edges(spark, sf_dir))


@query("u03_dedup_first", """
 SELECT source, lang, doc_id FROM (
   SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents)
 WHERE rn = 1""")
def u03(spark, sf_dir):
    """The longest document per (source, lang)."""
    d = tables.read_table(spark, sf_dir, "documents")
    return A.dedup_first(d, ["source", "lang"], [F.col("n_chars").desc(), "doc_id"]).select("source", "lang", "doc_id")
