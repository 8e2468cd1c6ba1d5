"""Properties of the operators without an oracle: topic models, approximate pairs, orders."""

import numpy as np
import pytest


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        base = np.eye(8)[i % 4]
        rows.append((i, [float(x) for x in base + rng.normal(size=8) * 0.08]))
    return spark.createDataFrame(rows, "doc_id long, v array<double>")


def test_approximate_pairs_are_exact_and_mostly_found(spark, clustered):
    from newsloom.operators import vectors as V

    exact = {(r.id1, r.id2): r.weight for r in V.cosine_pairs(clustered, "doc_id", "v", 0.95).collect()}
    got = {(r.id1, r.id2): r.weight for r in V.approx_cosine_pairs(clustered, 0.95).collect()}
    assert set(got) <= set(exact) and all(abs(got[p] - exact[p]) < 1e-9 for p in got)
    assert len(got) >= 0.9 * len(exact) > 0


def test_centroid_topics_find_the_planted_groups(spark, clustered):
    from newsloom.operators.topics import centroid_topics

    got = {r.doc_id: r.topic for r in centroid_topics(clustered, 4).collect()}
    assert len(got) == 240 and sorted(set(got.values())) == [0, 1, 2, 3]
    assert all(len({got[i] for i in range(240) if i % 4 == g}) == 1 for g in range(4))


def test_density_topics_find_the_planted_groups(spark, clustered):
    from newsloom.operators.topics import density_topics

    got = {r.doc_id: r.topic for r in density_topics(clustered, 0.8, 10).collect()}
    assert all(len({got[i] for i in range(240) if i % 4 == g}) == 1 for g in range(4)) and len(set(got.values())) == 4


def test_lda_uses_every_document_and_learns(spark):
    from newsloom.operators.topics import lda_keywords, lda_topics

    rng = np.random.default_rng(2)
    rows = [(d, f"t{(d % 2) * 20 + w}", int(n)) for d in range(80) for w, n in enumerate(rng.integers(0, 4, 20)) if n]
    model, vocab, feats, mix = lda_topics(spark.createDataFrame(rows, "doc_id long, term string, tf long"), "doc_id", k=2, max_iter=20)
    got = {r.doc_id: r for r in mix.collect()}
    assert set(got) == set(range(80)) and all(abs(sum(r.mixture) - 1) < 0.02 for r in got.values())
    assert len({got[d].dominant_topic for d in range(0, 80, 2)}) == 1 and got[0].dominant_topic != got[1].dominant_topic
    words = {}
    for r in lda_keywords(model, vocab, spark, 10).collect():
        words.setdefault(r.topic, set()).add(int(r.term[1:]) // 20)
    assert all(len(v) == 1 for v in words.values())


def test_factors_are_non_negative_and_cover_all_documents(spark):
    from newsloom.operators.topics import nmf

    rng = np.random.default_rng(3)
    rows = [(d, f"t{w}", float(rng.uniform(0.1, 1))) for d in range(30) for w in range(12) if (d + w) % 3]
    docs, terms = nmf(spark.createDataFrame(rows, "doc_id long, term string, w double"), "doc_id", k=3)
    d = {r.doc_id: r.factors for r in docs.collect()}
    t = {r.term: r.factors for r in terms.collect()}
    assert len(d) == 30 and len(t) == 12 and min(min(v) for v in [*d.values(), *t.values()]) >= 0
    error = np.mean([(np.dot(d[i], t[w]) - x) ** 2 for i, w, x in rows])
    assert error < np.var([x for *_, x in rows])


def test_word_vectors_put_documents_of_equal_words_together(spark):
    from newsloom.operators.topics import embed_documents

    rng = np.random.default_rng(4)
    rows = [(i, [f"{'ab'[i % 2]}{w}" for w in rng.integers(0, 6, 60)]) for i in range(120)]
    got = {r.doc_id: np.array(r.embedding) for r in embed_documents(spark.createDataFrame(rows, "doc_id long, toks array<string>"), "toks", dim=8).collect()}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    same = np.mean([cos(got[i], got[i + 2]) for i in range(100)])
    other = np.mean([cos(got[i], got[i + 1]) for i in range(100)])
    assert len(got) == 120 and same > other


def test_order_by_community_is_by_size_and_gapless(spark):
    from newsloom.operators import ordering as O

    nodes = spark.createDataFrame([(1, i) for i in range(12)], "m int, doc_id long")
    comm = spark.createDataFrame([(1, i, 100 if i in (1, 3) else 200 if i < 8 else 300) for i in range(12)], "m int, doc_id long, community long")
    got = sorted((r.order_pos, r.doc_id) for r in O.order_by_community(nodes, comm, ["m"]).collect())
    assert [d for _, d in got] == [0, 2, 4, 5, 6, 7, 8, 9, 10, 11, 1, 3] and [p for p, _ in got] == list(range(1, 13))


def test_running_positions_equal_windows_over_many_partitions(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from newsloom.operators import ordering as O

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = np.random.default_rng(6)
        rows = [(int(m) if m < 3 else None, int(i), int(t), float(x)) for i, (m, t, x) in enumerate(zip(rng.choice(4, 500, p=[0.85, 0.05, 0.05, 0.05]), rng.integers(0, 5, 500), rng.normal(size=500)))]
        df = spark.createDataFrame(rows, "m int, i long, topic int, x double").repartition(7)
        w = Window.partitionBy("m").orderBy("topic", "i")
        expect = df.withColumn("pos", F.row_number().over(w) - 1).withColumn("ch", F.coalesce(F.col("topic") - F.lag("topic").over(w), F.lit(0)))
        expect = {r.i: (r.pos, r.ch, round(r.run, 9)) for r in expect.withColumn("run", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0))).collect()}
        pos = {r.i: r.row_pos for r in O.row_position(df, ["m"], ["topic", "i"]).collect()}
        change = {r.i: r.topic_change for r in O.topic_boundary(df, ["m"], ["topic", "i"]).collect()}
        run = {r.i: round(r.run, 9) for r in O.running_sum(df, ["m"], ["topic", "i"], "x", "run").collect()}
        assert {i: (pos[i], change[i], run[i]) for i in expect} == expect
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
