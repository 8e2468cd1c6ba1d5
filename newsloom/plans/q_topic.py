"""Queries of the topic-model family."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import aggregate as A
from newsloom.operators import factors as FA
from newsloom.operators import features as FT
from newsloom.operators import hierarchy as H
from newsloom.operators import ordering as O
from newsloom.operators import topics as TP
from newsloom.operators import vectors as V
from newsloom.plans import fixtures as X
from newsloom.plans.q_clean import _sql_bigrams  # noqa: F401
from newsloom.plans.registry import query
from newsloom.plans.sql_common import ARTICLES, PROBS, TOPICS, with_
from newsloom.sources import tables

MONTH = ["year", "month"]

_M12_SQL = """
WITH RECURSIVE
 vv AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 gedges AS (SELECT a.vec_id AS id1, b.vec_id AS id2 FROM vv a JOIN vv b ON a.vec_id < b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= 0.35),
 und AS (SELECT id1 AS a, id2 AS b FROM gedges UNION ALL SELECT id2, id1 FROM gedges),
 reach(node, root) AS (SELECT vec_id, vec_id FROM vv UNION SELECT u.b, r.root FROM reach r JOIN und u ON u.a = r.node),
 comp AS (SELECT node, min(root) AS comp FROM reach GROUP BY node),
 sz AS (SELECT comp, count(*) AS s FROM comp GROUP BY comp),
 big AS (SELECT comp, row_number() OVER (ORDER BY s DESC, comp) - 1 AS topic FROM sz WHERE s >= 10)
SELECT c.node AS vec_id, c.comp, CAST(coalesce(big.topic, -1) AS INTEGER) AS topic FROM comp c LEFT JOIN big USING (comp)"""


def _m12(spark, sf_dir):
    p = tables.fixture_params()
    return TP.density_topics(tables.vector_view(spark, sf_dir), p["component_threshold"], 10, id_col="vec_id")


@query("m12_density_topics", _M12_SQL)
def m12(spark, sf_dir):
    """Density-graph topics over all vectors (cosine >= t, components, size >= 10)."""
    return _m12(spark, sf_dir)


_M27_SQL = """
WITH RECURSIVE
 art AS (SELECT doc_id, CAST(2015 + doc_id % 2 AS INTEGER) AS year, CAST(1 + (doc_id // 2) % 3 AS INTEGER) AS month FROM documents),
 dv AS (SELECT a.*, CAST(e.embedding AS DOUBLE[]) AS v FROM art a JOIN embeddings e ON e.vec_id = a.doc_id),
 me AS (SELECT a.year, a.month, a.doc_id AS id1, b.doc_id AS id2 FROM dv a JOIN dv b
          ON a.year = b.year AND a.month = b.month AND a.doc_id < b.doc_id WHERE list_cosine_similarity(a.v, b.v) >= 0.3),
 und AS (SELECT year, month, id1 AS a, id2 AS b FROM me UNION ALL SELECT year, month, id2, id1 FROM me),
 reach(year, month, node, root) AS (SELECT year, month, doc_id, doc_id FROM dv
        UNION SELECT r.year, r.month, u.b, r.root FROM reach r JOIN und u ON u.year = r.year AND u.month = r.month AND u.a = r.node),
 comp AS (SELECT year, month, node, min(root) AS comp FROM reach GROUP BY ALL),
 sz AS (SELECT year, month, comp, count(*) AS s FROM comp GROUP BY ALL),
 big AS (SELECT year, month, comp, row_number() OVER (PARTITION BY year, month ORDER BY s DESC, comp) - 1 AS topic FROM sz WHERE s >= 3)
SELECT c.year, c.month, c.node AS doc_id, c.comp, CAST(coalesce(big.topic, -1) AS INTEGER) AS topic
FROM comp c LEFT JOIN big USING (year, month, comp)"""


@query("m27_topics_by_month", _M27_SQL)
def m27(spark, sf_dir):
    """M12 per (year, month) in one job: the month leads every key (cosine >= 0.3, size >= 3)."""
    d = tables.article_vectors(spark, sf_dir).select("doc_id", *MONTH, "v")
    return TP.density_topics(d, 0.3, 3, keys=MONTH)


@query("m14_membership", with_(TOPICS, PROBS, """
 SELECT doc_id, CAST(generate_subscripts(probs, 1) - 1 AS INTEGER) AS topic, round(unnest(probs), 4) AS probability FROM prb"""))
def m14(spark, sf_dir):
    """Probability per topic = softmax of the cosine to every topic centroid of the month."""
    d = X.docs(spark, sf_dir)
    return TP.probs_long(TP.membership(d, MONTH), MONTH).select("doc_id", "topic", "probability")


@query("m24_doc_topic_prob", with_(TOPICS, PROBS, """
 SELECT year, month, doc_id AS document, topic, round(CASE WHEN topic = -1 THEN 0.0 ELSE probs[topic + 1] END, 4) AS probability FROM prb"""))
def m24(spark, sf_dir):
    """Document, topic and the probability of the assigned topic."""
    d = X.docs(spark, sf_dir)
    return TP.doc_topic_prob(d, TP.membership(d, MONTH), MONTH)


_M12_CTES = _M12_SQL.split("SELECT c.node AS vec_id")[0].rstrip()


@query("m22_exemplars", _M12_CTES + """,
 tpc AS (SELECT c.node AS vec_id, coalesce(big.topic, -1) AS topic FROM comp c LEFT JOIN big USING (comp)),
 nb AS (SELECT a.vec_id, count(*) AS size FROM vv a JOIN vv b ON list_cosine_similarity(a.v, b.v) >= 0.35 GROUP BY a.vec_id),
 rk AS (SELECT t.topic, t.vec_id, nb.size, rank() OVER (PARTITION BY t.topic ORDER BY nb.size DESC) AS r
        FROM tpc t JOIN nb USING (vec_id) WHERE t.topic <> -1)
SELECT CAST(topic AS INTEGER) AS topic, vec_id, size FROM rk WHERE r = 1""")
def m22(spark, sf_dir):
    """Exemplars: the members with the most neighbours (>= t) of every topic."""
    p = tables.fixture_params()
    v = tables.vector_view(spark, sf_dir)
    sizes = V.neighbour_count(v, p["component_threshold"], "vec_id", "v")
    return TP.exemplars(_m12(spark, sf_dir), sizes, id_col="vec_id")


@query("m23_topic_doc_density", _M12_CTES + """,
 tpc AS (SELECT c.node AS vec_id, coalesce(big.topic, -1) AS topic FROM comp c LEFT JOIN big USING (comp)),
 kn AS (SELECT vec_id, sim FROM (
          SELECT a.vec_id, list_cosine_similarity(a.v, b.v) AS sim,
                 row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id) AS r
          FROM vv a JOIN vv b ON a.vec_id <> b.vec_id) WHERE r = 5)
SELECT CAST(t.topic AS INTEGER) AS topic, t.vec_id AS document, round(round(1.0 / (1.0 - kn.sim), 6), 4) AS density
FROM tpc t JOIN kn USING (vec_id)""")
def m23(spark, sf_dir):
    """Density of every document: 1 / cosine distance to its 5th neighbour."""
    return TP.topic_doc_density(_m12(spark, sf_dir), tables.vector_view(spark, sf_dir), 5, "vec_id", "v")


@query("m12_density_hierarchy")
def m12_hierarchy(spark, sf_dir):
    """M12, M23 by the density hierarchy of every month: topic, lambda and probability of each document."""
    d = tables.article_vectors(spark, sf_dir).select("doc_id", *MONTH, "v")
    return H.hierarchy_topics(d, 5, 3, MONTH)


@query("m22_hierarchy_exemplars")
def m22_hierarchy(spark, sf_dir):
    """M22 by the density hierarchy over all vectors: the documents that leave each topic's undivided clusters last."""
    return H.hierarchy_exemplars(tables.vector_view(spark, sf_dir), 5, 3, id_col="vec_id")


@query("m21_reduce_topics")
def m21(spark, sf_dir):
    """Merge the smallest topics of every month until 3 are left (iterative, checked by tests)."""
    d = X.docs(spark, sf_dir).select("doc_id", *MONTH, "topic", "v")
    return TP.reduce_topics(d, 3, MONTH).select("doc_id", *MONTH, "topic")


@query("m13_centroid_topics")
def m13(spark, sf_dir):
    """KMeans topics (seeded, k = 10) relabelled by size."""
    return TP.centroid_topics(tables.vector_view(spark, sf_dir), 10, 1, "vec_id", "v")


@query("m11_embed_documents")
def m11(spark, sf_dir):
    """Document vectors (word co-occurrence, randomised range finder) over the cleaned tokens."""
    a = tables.article_view(spark, sf_dir).select("doc_id", T.clean_tokens(F.col("content")).alias("toks"))
    e = TP.embed_documents(a, "toks", dim=16)
    return e.select("doc_id", F.size("embedding").alias("dims"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x).alias("sq"))


def _lda(spark, sf_dir, k=5):
    a = tables.article_view(spark, sf_dir)
    counts = FT.count_vectorize(a, ["doc_id"], "content", min_df=10, max_df=0.95, ngram=(2, 2))
    return TP.lda_topics(counts, "doc_id", k=k, max_iter=5)


@query("m09_doc_topic_table")
def m09(spark, sf_dir):
    """M6 + M9: LDA mixtures per document (rounded to 2) and the dominant topic."""
    return _lda(spark, sf_dir)[3]


@query("m10_lda_keywords")
def m10(spark, sf_dir):
    """The 20 best words per LDA topic."""
    model, vocab, _, _ = _lda(spark, sf_dir)
    return TP.lda_keywords(model, vocab, spark, 20)


@query("m08_lda_quality")
def m08(spark, sf_dir):
    """M8: log-likelihood and log-perplexity of the fitted LDA on its corpus."""
    model, _, cells, _ = _lda(spark, sf_dir)
    return FA.lda_quality(model, cells)


@query("m05_nmf")
def m05(spark, sf_dir):
    """M5: non-negative document factors (multiplicative updates) of the TF-IDF matrix, with each document's error."""
    a = tables.article_view(spark, sf_dir)
    w = FT.tfidf(FT.count_vectorize(a, ["doc_id"], "content", min_df=2, max_df=0.95), ["doc_id"])
    docs, _, _ = FA.nmf_factors(w, "doc_id", k=8, max_iter=15)
    return docs.select("doc_id", F.array_min("factors").alias("min_factor"), F.size("factors").alias("k"), "error")


@query("m28_topics_by_batch")
def m28(spark, sf_dir):
    """M12 per overlapping batch (W11: 300 rows, 150 back) with the batch as leading key."""
    d = tables.article_vectors(spark, sf_dir).select("doc_id", *MONTH, "v")
    b = O.overlap_batches(d, MONTH + ["doc_id"], 300, 150)
    return TP.density_topics(b.select("batch", "doc_id", "v"), 0.3, 3, keys=["batch"])


def _sql_ngrams(toks: str, n: int) -> str:
    return (f"list_transform(list_filter(range(1, len({toks}) + 1), lambda i: i <= len({toks}) - {n - 1}), "
            f"lambda i: array_to_string({toks}[i:i + {n - 1}], ' '))")


def _sweep_sql(n: int) -> str:
    tok = T.sql_remove_stopwords(f"regexp_extract_all(lower(content), '{FT.TOKEN_PATTERN}')")
    return f"""
 g{n} AS (SELECT doc_id, unnest({_sql_ngrams('toks', n)}) AS term FROM (SELECT doc_id, {tok} AS toks FROM art)),
 c{n} AS (SELECT a.year, a.month, a.topic, g.term, count(*) AS cnt FROM asg a JOIN g{n} g USING (doc_id) GROUP BY ALL),
 pc{n} AS (SELECT year, month, topic, sum(cnt) AS cc FROM c{n} GROUP BY ALL),
 pg{n} AS (SELECT year, month, avg(cc) AS A FROM pc{n} GROUP BY ALL),
 pt{n} AS (SELECT year, month, term, sum(cnt) AS ft FROM c{n} GROUP BY ALL),
 w{n} AS (SELECT c.year, c.month, c.topic, c.term, c.cnt / pc.cc * ln(1 + pg.A / pt.ft) AS weight,
                 row_number() OVER (PARTITION BY c.year, c.month, c.topic ORDER BY c.cnt / pc.cc * ln(1 + pg.A / pt.ft) DESC, c.term) AS r
          FROM c{n} c JOIN pc{n} pc USING (year, month, topic) JOIN pg{n} pg USING (year, month) JOIN pt{n} pt USING (year, month, term)),
 i{n} AS (SELECT '{n}_{n}' AS setting, year, month, topic, string_agg(term, '_' ORDER BY r) AS words FROM w{n} WHERE r <= 4 GROUP BY ALL)"""


@query("m26_ngram_sweep", with_(TOPICS, _sweep_sql(1), _sweep_sql(3), """
 SELECT setting, year, month, topic, CAST(topic AS VARCHAR) || '_' || words AS name FROM i1
 UNION ALL SELECT setting, year, month, topic, CAST(topic AS VARCHAR) || '_' || words AS name FROM i3"""))
def m26(spark, sf_dir):
    """Topic names under several n-gram settings, the setting as a key column."""
    d = X.docs(spark, sf_dir)
    out = None
    for n in (1, 3):
        counts = FT.doc_terms(d.select("doc_id", "content"), ["doc_id"], "content", ngram=(n, n))
        w = FT.ctfidf(counts, d.select("doc_id", *MONTH, "topic"), MONTH)
        names = FT.topic_names(FT.top_terms(w, MONTH + ["topic"], 4), MONTH).withColumn("setting", F.lit(f"{n}_{n}"))
        out = names if out is None else out.unionByName(names)
    return out.select("setting", *MONTH, "topic", "name")


@query("a19_ngram_outlier_rank", with_(TOPICS, """
 cnt AS (SELECT year, month, topic, count(*) AS n FROM asg GROUP BY ALL),
 fr AS (SELECT year, month, topic, n, row_number() OVER (PARTITION BY year, month ORDER BY topic) AS r FROM cnt)""", """
 SELECT year, month, topic AS first_topic, n AS first_count FROM fr WHERE r = 1 ORDER BY n"""))
def a19(spark, sf_dir):
    """The first info row (the -1 row when there is one) of every model, sorted by its count."""
    info = A.topic_sizes(X.docs(spark, sf_dir))
    first = A.dedup_first(info, MONTH, ["topic"])
    return first.select(*MONTH, F.col("topic").alias("first_topic"), F.col("n_docs").alias("first_count")).orderBy("first_count")


@query("k11_most_similar_greedy")
def k11(spark, sf_dir):
    """Order-dependent most-similar choice (fixpoint over exclusions; brute-force tested)."""
    return V.greedy_most_similar(tables.vector_view(spark, sf_dir), "vec_id", "v")


def _query_terms(counts):
    """The corpus's most frequent bigram (ties by text) as the search term, weight 1."""
    top = counts.groupBy("term").agg(F.sum("tf").alias("_n"))
    best = top.agg(F.max(F.struct(F.col("_n"), F.col("term"))).alias("b"))
    return best.select(F.col("b.term").alias("query"), F.col("b.term").alias("term"), F.lit(1.0).alias("weight"))


_M19_SQL = """
 ct AS (SELECT a.year, a.month, a.topic, b.term, sum(b.tf) AS cnt FROM asg a JOIN btf b USING (doc_id) GROUP BY ALL),
 pc AS (SELECT year, month, topic, sum(cnt) AS cc FROM ct GROUP BY ALL),
 pg AS (SELECT year, month, avg(cc) AS A FROM pc GROUP BY ALL),
 pt AS (SELECT year, month, term, sum(cnt) AS ft FROM ct GROUP BY ALL),
 cw AS (SELECT ct.year, ct.month, ct.topic, ct.term, ct.cnt / pc.cc * ln(1 + pg.A / pt.ft) AS weight
        FROM ct JOIN pc USING (year, month, topic) JOIN pg USING (year, month) JOIN pt USING (year, month, term)),
 q AS (SELECT term FROM (SELECT term, sum(tf) AS n FROM btf GROUP BY term) ORDER BY n DESC, term DESC LIMIT 1),
 tn AS (SELECT year, month, topic, sqrt(sum(weight * weight)) AS tn FROM cw GROUP BY ALL),
 sim AS (SELECT cw.year, cw.month, cw.topic, cw.term AS query, cw.weight / tn.tn AS similarity
         FROM cw JOIN q USING (term) JOIN tn USING (year, month, topic)),
 rk19 AS (SELECT *, row_number() OVER (PARTITION BY year, month, query ORDER BY similarity DESC, topic) AS rank FROM sim)"""


def _m19(spark, sf_dir):
    from newsloom.plans.q_feat import _ctfidf
    d = X.docs(spark, sf_dir)
    counts = FT.doc_terms(d.select("doc_id", "content"), ["doc_id"], "content", ngram=(2, 2))
    return TP.find_topics(_ctfidf(spark, sf_dir), _query_terms(counts), MONTH, 5, 0.01), d


@query("m19_find_topics", with_(TOPICS, __import__("newsloom.plans.q_feat", fromlist=["_BI_DOCS"])._BI_DOCS, _M19_SQL, """
 SELECT year, month, query, topic, round(similarity, 4) AS similarity, rank FROM rk19 WHERE rank <= 5 AND similarity >= 0.01"""))
def m19(spark, sf_dir):
    """The 5 topics per month closest to the corpus's most frequent bigram (similarity >= 0.01)."""
    return _m19(spark, sf_dir)[0]


@query("m20_term_topic_history", with_(TOPICS, __import__("newsloom.plans.q_feat", fromlist=["_BI_DOCS"])._BI_DOCS, _M19_SQL, """
 rng AS (SELECT year, month, topic, count(*) AS topic_docs FROM asg GROUP BY ALL)""", """
 SELECT r.year, r.month, r.query, r.topic, round(r.similarity, 4) AS similarity, g.topic_docs,
        r.year AS topic_start_year, r.month AS topic_start_month, r.year AS topic_end_year, r.month AS topic_end_month
 FROM rk19 r JOIN rng g USING (year, month, topic) WHERE r.rank <= 5 AND r.similarity >= 0.01"""))
def m20(spark, sf_dir):
    """M19 over every month model with the found topics' date range and size."""
    found, d = _m19(spark, sf_dir)
    return TP.term_topic_history(found.drop("rank"), d.select("doc_id", *MONTH, "topic"), MONTH)


@query("m25_recluster_outliers")
def m25(spark, sf_dir):
    """Outliers clustered again with a looser threshold, round by round."""
    p = tables.fixture_params()
    return TP.recluster_outliers(tables.vector_view(spark, sf_dir), p["component_threshold"], 10,
                                 step=0.05, min_left=15, id_col="vec_id", vec_col="v")


@query("w10_order_by_community")
def w10(spark, sf_dir):
    """Nodes ordered by community size (G5), members in id order."""
    from newsloom.operators import graph
    from newsloom.plans import fixtures as FX
    v = tables.vector_view(spark, sf_dir).select(F.col("vec_id").alias("doc_id"))
    com = graph.louvain(v, FX.global_edges(spark, sf_dir))
    return O.order_by_community(v, com, []).select("doc_id", "order_pos")


@query("m07_lda_grid")
def m07(spark, sf_dir):
    """M7: LDA over a grid of topic counts and learning decays, scored on held-out documents."""
    a = tables.article_view(spark, sf_dir)
    counts = FT.count_vectorize(a, ["doc_id"], "content", min_df=10, max_df=0.95, ngram=(2, 2))
    return TP.lda_grid(counts, "doc_id", folds=2)
