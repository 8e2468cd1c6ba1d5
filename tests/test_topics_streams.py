"""Iterative operators, streams and I/O on small inputs, against brute force or properties."""

import io
import os
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from newsloom.operators import regress as R
from newsloom.operators import sentiment as S
from newsloom.operators import topics as TP
from newsloom.operators import vectors as V
from newsloom.sources import files
from newsloom.streaming import streams


def _vecs(spark, X):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(X)], "doc_id long, v array<double>")


def _greedy_brute(X):
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    S_ = U @ U.T
    n = len(X)
    choice = {}
    for i in range(n):
        banned = {j for j in range(i) if choice.get(j, (-1,))[0] == i}
        best = (-1, -1.0)
        for j in range(n):
            if j == i or j in banned:
                continue
            if best[0] == -1 or S_[i, j] > best[1] or (S_[i, j] == best[1] and j < best[0]):
                best = (j, S_[i, j])
        choice[i] = best
    return choice


def test_greedy_most_similar_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(25, 4))
    want = _greedy_brute(X)
    got = {r.id: (r.best_id, r.best_sim) for r in V.greedy_most_similar(_vecs(spark, X.tolist()), k0=1).collect()}
    for i, (j, s) in want.items():
        assert got[i][0] == j
        if j != -1:
            assert abs(got[i][1] - s) < 1e-9


def test_mutual_best_pair_second_choice(spark):
    X = np.array([[1.0, 0.0], [0.99, 0.1], [0.0, 1.0]])
    got = {r.id: r.best_id for r in V.greedy_most_similar(_vecs(spark, X.tolist())).collect()}
    # 1 cannot take 0 (0 chose 1); 2 cannot take 1 (1 chose 2)
    assert got[0] == 1 and got[1] == 2 and got[2] == 0


def test_density_topics_properties_and_partition_independence(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(3, 6))
    X = np.vstack([c + 0.05 * rng.normal(size=(n, 6)) for c, n in zip(centres, (12, 8, 5))] + [rng.normal(size=(4, 6))])
    df = _vecs(spark, X.tolist())
    res = {}
    for parts in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        t = TP.density_topics(df, 0.9, min_topic_size=6)
        res[parts] = sorted((r.doc_id, r.topic) for r in t.collect())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert res["1"] == res["4"] == res["16"]
    sizes = pd.Series([t for _, t in res["1"] if t != -1]).value_counts().sort_index()
    assert list(sizes.index) == list(range(len(sizes)))
    assert all(sizes.diff().dropna() <= 0) and sizes.min() >= 6


def test_membership_rows_sum_to_one(spark):
    rng = np.random.default_rng(4)
    rows = [(i, 2015, 1, int(i % 3), [float(x) for x in rng.normal(size=4)]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, year int, month int, topic int, v array<double>")
    for r in TP.membership(df, ["year", "month"]).collect():
        assert abs(sum(r.probs) - 1.0) < 1e-9 and len(r.probs) == 3


def test_stream_counts_drop_late_rows(spark, tmp_path):
    import time

    src = str(tmp_path / "ev")
    rows1 = [(1, "2024-01-01 10:00:00", "a", 1.0), (2, "2024-01-01 11:00:00", "a", 1.0), (3, "2024-01-03 10:00:00", "a", 1.0)]
    late = [(4, "2024-01-01 12:00:00", "a", 5.0), (5, "2024-01-03 11:00:00", "a", 1.0)]
    schema = "event_id long, ts string, event_type string, value double"
    spark.createDataFrame(rows1, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(src)
    time.sleep(1.1)
    # an on-time file: late rows are filtered with the watermark of the batch before
    spark.createDataFrame([(6, "2024-01-03 10:30:00", "a", 1.0)], schema).withColumn(
        "ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)
    time.sleep(1.1)
    spark.createDataFrame(late, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    agg = streams.stream_counts(stream.withColumnRenamed("ts", "event_time"), "event_time", "1 day", delay="1 hour",
                                by=["event_type"])
    seen = []

    def keep(batch, batch_id):
        seen.extend((batch_id, r.window.start.day, r.n) for r in batch.collect())

    q = agg.writeStream.outputMode("update").foreachBatch(keep).option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    batches = sorted({b for b, _, _ in seen})
    first = {d: n for b, d, n in seen if b == batches[0]}
    last = {d: n for b, d, n in seen if b == batches[-1]}
    assert first == {1: 2, 3: 1}
    # the Jan 1 event came after the watermark (Jan 3 09:00): dropped; Jan 3 is updated
    assert last == {3: 3}


def test_stream_dedup_within_watermark(spark, tmp_path):
    src = str(tmp_path / "d")
    rows = [(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:30:00"), (2, "2024-01-01 10:00:00")]
    spark.createDataFrame(rows, "id long, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    s = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    d = streams.stream_dedup(s, ["id"], "ts", "1 hour")
    q = d.writeStream.format("memory").queryName("dedup_t").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.id for r in spark.table("dedup_t").collect()) == [1, 2]


def test_score_with_fallback(spark):
    df = spark.createDataFrame([(1, "a " * 10), (2, "b " * 1000)], "doc_id long, content string")

    def scorer(texts):
        if len(texts[0]) > 300:
            raise ValueError("too long")
        return [len(texts[0]) / 1000.0]

    got = {r.doc_id: (r.size, r.score) for r in S.score_with_fallback(df, scorer, [1200, 1100, 300, 200]).collect()}
    assert got[1] == (1200, 0.02) and got[2][0] == 300


def test_read_dense_vectors(spark, tmp_path):
    m = np.arange(12, dtype=np.float32).reshape(3, 4)
    p = tmp_path / "v.npy"
    np.save(p, m)
    got = files.read_dense_vectors(spark, str(p)).orderBy("row").collect()
    assert [list(r.vector) for r in got] == m.astype(float).tolist()


def test_haversine_and_model_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double")
    km = df.select(R.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("k")).first().k
    assert abs(km - 111.195) < 0.01
    rows = [(float(i), float(i % 3), str(i % 2), 2.0 * i + 1) for i in range(40)]
    d = spark.createDataFrame(rows, "x double, z double, c string, y double")
    model = R.regression_pipeline(["x", "z"], ["c"], "y").fit(d)
    path = str(tmp_path / "m")
    R.save_model(model, path)
    err = R.rmse(R.load_pipeline_model(path).transform(d), "y", "prediction").first().rmse
    assert err < 1e-6


def test_train_test_is_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = sorted(r.k for r in R.train_test(df, "k")[1].collect())
    b = sorted(r.k for r in R.train_test(df.repartition(7), "k")[1].collect())
    assert a == b and 200 < len(a) < 400


def test_components_of_a_chain_longer_than_any_round_limit(spark):
    from newsloom.operators.topics import connected_components

    ids = [(i * 7919) % 400 for i in range(400)]  # neighbours on the chain are far apart in value
    nodes = spark.createDataFrame([(1, i) for i in ids] + [(2, 5), (2, 6)], "m int, doc_id long")
    edges = spark.createDataFrame([(1, a, b, 1.0) for a, b in zip(ids, ids[1:])], "m int, id1 long, id2 long, weight double")
    got = connected_components(nodes, edges, ["m"]).collect()
    assert {(r.m, r.doc_id, r.comp) for r in got} == {(1, i, 0) for i in range(400)} | {(2, 5, 5), (2, 6, 6)}


def test_communities_end_where_no_node_gains(spark):
    import random

    from newsloom.operators import graph

    rng = random.Random(3)
    pairs = {(min(a, b), max(a, b)): rng.random() for a, b in (rng.sample(range(30), 2) for _ in range(60))}
    pairs |= {(i, j): 1.0 for i in range(30, 36) for j in range(i + 1, 36)}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "id1 long, id2 long, weight double")
    got = {r.doc_id: r.community for r in graph.communities(spark.range(36).withColumnRenamed("id", "doc_id"), edges).collect()}
    assert len({got[i] for i in range(30, 36)}) == 1
    for n in range(36):
        weight = {}
        for (a, b), w in pairs.items():
            if n in (a, b):
                other = got[b if n == a else a]
                weight[other] = weight.get(other, 0.0) + w
        assert not weight or max(weight.values()) <= weight.get(got[n], 0.0) + 1e-6


def test_reduced_topics_keep_every_document_and_the_wanted_number(spark):
    import numpy as np

    from newsloom.operators.topics import reduce_topics

    rng = np.random.default_rng(1)
    rows = [(i, i % 2, int(i % 13) - 1, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, m int, topic int, v array<double>")
    got = reduce_topics(docs, 4, ["m"]).collect()
    assert len(got) == 300
    for m in (0, 1):
        sizes = [sum(r.m == m and r.topic == t for r in got) for t in range(4)]
        assert {r.topic for r in got if r.m == m} <= {-1, 0, 1, 2, 3} and sizes == sorted(sizes, reverse=True)
    assert all((r.topic == -1) == (rows[r.doc_id][2] == -1) for r in got)


def test_reclustering_numbers_topics_without_collisions(spark):
    from newsloom.operators.topics import recluster_outliers

    import numpy as np

    rng = np.random.default_rng(2)
    rows, n = [], 0
    for g in range(12):
        base = np.eye(12)[g]
        for _ in range(5):
            v = base + rng.normal(size=12) * (0.02 if g < 6 else 0.22)
            rows.append((n, [float(x) for x in v]))
            n += 1
    got = recluster_outliers(spark.createDataFrame(rows, "doc_id long, v array<double>"), 0.95, 3, step=0.1, min_left=2, lowest=0.4).collect()
    assert len(got) == n and {(r.round == -1) == (r.topic == -1) for r in got} == {True}
    by_topic = {}
    for r in got:
        by_topic.setdefault(r.topic, set()).add(r.round)
    assert all(len(v) == 1 for t, v in by_topic.items()) and max(r.round for r in got) >= 1
    assert sorted(t for t in by_topic if t >= 0) == list(range(len([t for t in by_topic if t >= 0])))
