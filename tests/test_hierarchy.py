"""Density hierarchy against a plain merge tree."""

import numpy as np
import pytest

from newsloom.operators import hierarchy as H

SCHEMA = "g long, doc_id long, v array<double>"


def plain_edges(ids, X, k):
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    d = np.round(1 - U @ U.T, 9)
    other = np.where(np.eye(len(ids), dtype=bool), np.inf, d)
    core = np.sort(other, axis=1)[:, min(k, len(ids) - 1) - 1]
    w = np.maximum(np.maximum(core[:, None], core[None, :]), d)
    return sorted((w[i, j], min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in range(i))


def plain_tree(ids, edges, least):
    """(documents: cluster as a set of members, lam), (clusters: members -> stability, chosen, chosen ancestor)."""
    comp = {i: frozenset([i]) for i in ids}
    merge = {}  # members -> (left, right, lam)
    mst = []
    for w, a, b in edges:
        if comp[a] != comp[b]:
            mst.append((a, b, w))
            x, y = comp[a], comp[b]
            merge[x | y] = (x, y, 1 / max(w, 1e-9))
            for i in x | y:
                comp[i] = x | y
    points, clusters = {}, {}

    def walk(members, cluster, birth):
        """Follow one cluster down; returns the sum of (lam - birth) and its child clusters."""
        stability, kids = 0.0, []
        while True:
            x, y, lam = merge[members]
            if len(x) >= least and len(y) >= least:
                for z in (x, y):
                    kids.append(z)
                    stability += len(z) * (lam - birth)
                    clusters[z] = (cluster, lam)
                    walk_result[z] = walk(z, z, lam)
                return stability, kids
            big, small = (x, y) if len(x) >= len(y) else (y, x)
            gone = small if len(big) >= least else x | y
            for i in gone:
                points[i] = (cluster, lam)
                stability += lam - birth
            if len(big) < least:
                return stability, kids
            members = big

    walk_result = {}
    top = frozenset(ids)
    if len(ids) < least:
        return mst, {}, {}, {}
    walk_result[top] = walk(top, top, 0.0)
    chosen = {}

    def value(c):
        s, kids = walk_result[c]
        below = sum(value(z) for z in kids)
        chosen[c] = c != top and s >= below
        return max(s, below)

    value(top)
    label = {}

    def down(c, above):
        label[c] = above or (c if chosen[c] else None)
        for z in walk_result[c][1]:
            down(z, label[c])

    down(top, None)
    return mst, points, {c: r[0] for c, r in walk_result.items()}, label


def groups(rng):
    """A dense and a sparse topic beside noise, a group of copies, small groups and one of a single row."""
    def cloud(n, spread, axis):
        return np.eye(8)[axis] + rng.normal(size=(n, 8)) * spread

    out = {1: np.concatenate([cloud(25, 0.03, 1), cloud(25, 0.12, 2), rng.normal(size=(20, 8))]),
           2: np.concatenate([np.repeat(cloud(1, 0, 3), 12, axis=0), cloud(30, 0.1, 4), cloud(14, 0.02, 5)]),
           3: rng.normal(size=(4, 8)), 4: rng.normal(size=(1, 8)), 5: rng.normal(size=(40, 8))}
    ids, at = {}, 0
    for g, x in out.items():
        ids[g] = list(range(at, at + len(x)))
        at += len(x)
    return ids, out


def test_equals_a_plain_merge_tree(spark, monkeypatch):
    """With short neighbour lists, small blocks and small parts, so that every way of the search is taken."""
    monkeypatch.setattr(H, "_KEEP", 5)
    rng = np.random.default_rng(7)
    ids, X = groups(rng)
    rows = [(g, i, x.tolist()) for g in ids for i, x in zip(ids[g], X[g])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    forest = H.spanning_forest(df, 5, ["g"], block_rows=16).cache()
    found = H.condensed_tree(forest, 6, ["g"], 6)
    tree, got_points, got_clusters = {}, {}, {}
    for r in forest.collect():
        tree.setdefault(r.g, []).append((r.id1, r.id2, r.w))
    for r in found.points.collect():
        got_points.setdefault(r.g, {})[r.id] = (r.cluster, r.lam)
    for r in found.clusters.collect():
        got_clusters.setdefault(r.g, {})[r.cluster] = r
    for g in ids:
        mst, points, stability, label = plain_tree(ids[g], plain_edges(ids[g], X[g], 5), 6) if len(ids[g]) > 1 else ([], {}, {}, {})
        assert sorted(x[:2] for x in tree.get(g, [])) == sorted(x[:2] for x in mst)
        assert np.allclose([x[2] for x in sorted(tree.get(g, []))], [x[2] for x in sorted(mst)], atol=1e-8)
        mine, cl = got_points.get(g, {}), got_clusters.get(g, {})
        assert set(mine) == set(points)
        # a cluster's members: what falls out of it or of a cluster below it
        members = {c: set() for c in cl}
        for i, (c, lam) in mine.items():
            assert lam == pytest.approx(points[i][1], rel=1e-5)
            while c is not None:
                members[c].add(i)
                c = cl[c].parent
        assert {frozenset(m) for m in members.values()} == set(stability)
        for c, r in cl.items():
            m = frozenset(members[c])
            assert r.size == len(m) and r.stability == pytest.approx(stability[m], rel=1e-6)
            assert (r.topic_cluster is None) == (label[m] is None) and (label[m] is None or frozenset(members[r.topic_cluster]) == label[m])
        assert all(frozenset(members[c]) == points[i][0] for i, (c, _) in mine.items())


def test_topics_of_different_density_are_told_apart(spark):
    rng = np.random.default_rng(7)
    ids, X = groups(rng)
    df = spark.createDataFrame([(g, i, x.tolist()) for g in ids for i, x in zip(ids[g], X[g])], SCHEMA)
    rows = H.hierarchy_topics(df, 6, 5, ["g"]).collect()
    assert len(rows) == sum(map(len, ids.values()))
    topic = {r.doc_id: r.topic for r in rows}
    dense, sparse = ([topic[i] for i in ids[1][a:a + 25]] for a in (0, 25))
    most = [max(set(x), key=x.count) for x in (dense, sparse)]
    assert most[0] != most[1] and -1 not in most and dense.count(most[0]) >= 23 and sparse.count(most[1]) >= 15
    assert all(r.topic == -1 and r.lam is None for r in rows if r.g in (3, 4))
    assert all(0 < r.probability <= 1 for r in rows if r.topic >= 0)
    best = H.hierarchy_exemplars(df, 6, 5, ["g"]).collect()
    assert best and all(topic[r.doc_id] >= 0 for r in best)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert H.hierarchy_topics(df, 6, 5, ["g"]).collect() == []


def test_a_deep_tree_of_clusters_is_walked_in_one_task(spark, monkeypatch):
    rng = np.random.default_rng(6)
    # a chain of 15 splits, each with a leaf beside it; parents have the smaller names
    rows, parent = [], None
    for i in range(15):
        name = -1000 + 10 * i
        rows += [(name, parent, float(rng.uniform(0, 3)), 2), (name + 5, name, float(rng.uniform(0, 3)), 0)]
        parent = name
    rows += [(parent + 6, parent, 1.0, 0), (77, None, 1.0, 0)]
    df = spark.createDataFrame(rows, "cluster long, parent long, stability double, kids int").repartition(4)
    kept = []
    keep = H._kept
    monkeypatch.setattr(H, "_kept", lambda x: kept.append(1) or keep(x))
    one = sorted(map(str, H._chosen_locally(df).collect()))
    assert len(kept) == 1 and len(one) == 32
    assert one == sorted(map(str, H._chosen_by_levels(df).collect())) and len(kept) > 30
    assert any("topic_cluster=-" in r for r in one)
    assert H._chosen_locally(df.limit(0)).count() == 0


def test_clusters_are_the_same_by_levels(spark, monkeypatch):
    rng = np.random.default_rng(3)
    points = [(i, [float(x) for x in rng.normal(size=3) + 4 * np.eye(3)[i % 3]]) for i in range(90)]
    df = spark.createDataFrame(points, "doc_id long, v array<double>")
    run = lambda: sorted(map(str, H.hierarchy_topics(df, 4, 3).collect()))
    one = run()
    monkeypatch.setattr(H, "LOCAL_CLUSTERS", 0)
    assert one == run() and len(one) == 90
