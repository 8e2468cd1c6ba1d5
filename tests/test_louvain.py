"""Louvain communities on several levels; TF-IDF features over all terms."""

import itertools
import math
import random

from pyspark.sql import functions as F

from newsloom.operators import graph, sentiment

EDGES = "grp long, id1 long, id2 long, weight double"


def quality(edges, label):
    m = sum(w for _, _, w in edges)
    inner, deg = {}, {}
    for a, b, w in edges:
        if label[a] == label[b]:
            inner[label[a]] = inner.get(label[a], 0) + w
        for x in (a, b):
            deg[label[x]] = deg.get(label[x], 0) + w
    return sum(inner.get(c, 0) / m - (d / (2 * m)) ** 2 for c, d in deg.items())


def graphs():
    rng = random.Random(2)
    clique = lambda ids, w=1.0: [(a, b, w) for a, b in itertools.combinations(ids, 2)]
    ring = [e for i in range(8) for e in clique(range(5 * i, 5 * i + 5))] + [(5 * i, (5 * i + 6) % 40, 1.0) for i in range(8)]
    star = [(0, i, 1.0) for i in range(1, 40)] + [(40, i, 1.0) for i in range(41, 60)] + [(0, 40, 0.5)]
    noise = [(*rng.sample(range(30), 2), rng.random()) for _ in range(70)] + [(3, 3, 2.0)]
    planted = [(a, b, 1.0) for a, b in itertools.combinations(range(48), 2) if rng.random() < (0.6 if a // 12 == b // 12 else 0.05)]
    return {1: ring, 2: star, 3: noise, 4: planted}


def test_no_node_and_no_community_can_gain(spark):
    data = graphs()
    edges = spark.createDataFrame([(g, min(a, b), max(a, b), w) for g, es in data.items() for a, b, w in es], EDGES).repartition(3)
    nodes = spark.createDataFrame([(g, i) for g in data for i in range(62)], "grp long, doc_id long")
    rows = graph.louvain(nodes, edges, ["grp"]).collect()
    assert len(rows) == 62 * len(data)
    single = edges.filter("id1 <> id2").groupBy("grp", "id1", "id2").agg(F.sum("weight").alias("weight"))
    local = {(r.grp, r.doc_id): r.community for r in graph.communities(nodes, single, ["grp"]).collect()}
    for g, es in data.items():
        label = {r.doc_id: r.community for r in rows if r.grp == g}
        assert all(c == min(i for i in label if label[i] == c) for c in label.values())
        ends = {x for a, b, _ in es for x in (a, b)}
        assert all(label[i] == i for i in label if i not in ends)
        q = quality(es, label)
        for c, d in itertools.permutations({label[i] for i in ends}, 2):  # joining two communities doesn't pay
            assert quality(es, {i: d if x == c else x for i, x in label.items()}) <= q + 1e-9
        assert q >= quality(es, {i: local[g, i] for i in label}) - 1e-9
        if g == 4:
            assert q >= quality(es, {i: i // 12 for i in range(62)}) - 1e-9
        if g == 1:
            assert all(len({label[i] for i in range(5 * k, 5 * k + 5)}) == 1 for k in range(8))


def test_no_edges(spark):
    nodes = spark.createDataFrame([(3,), (4,)], "doc_id long")
    edges = spark.createDataFrame([], "id1 long, id2 long, weight double")
    assert sorted(graph.louvain(nodes, edges).collect()) == [(3, 3), (4, 4)]


def test_tfidf_features_keep_every_term(spark):
    docs = [(1, ["a", "b", "a"]), (2, ["b", "rare"]), (3, []), (4, [f"t{i}" for i in range(500)])]
    got = {r.doc_id: r.features for r in sentiment.tfidf_features(spark.createDataFrame(docs, "doc_id long, toks array<string>")).collect()}
    assert set(got) == {1, 2, 3, 4} and {v.size for v in got.values()} == {503} and got[3].numNonzeros() == 0 and got[4].numNonzeros() == 500
    assert sorted(got[1].values) == sorted([2 * math.log(5 / 2), math.log(5 / 3)])
