"""Vector metrics and all-pairs operators against brute force on small inputs."""

import numpy as np
from pyspark.sql import functions as F

from newsloom.operators import vectors as V

METRICS = V.METRICS


def _vecs(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "doc_id long, v array<double>")


def _pearson(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    if a.std() == 0 or b.std() == 0:
        return None
    return float(np.corrcoef(a, b)[0, 1])


def _ranks(x):
    x = np.asarray(x, float)
    return np.array([np.sum(x < v) + (np.sum(x == v) + 1) / 2 for v in x])


def _kendall_b(a, b):
    n = len(a)
    s = [(np.sign(a[j] - a[i]), np.sign(b[j] - b[i])) for i in range(n) for j in range(i + 1, n)]
    num = sum(x * y for x, y in s)
    den = np.sqrt(sum(x * x for x, _ in s) * sum(y * y for _, y in s))
    return None if den == 0 else float(num / den)


def test_pair_metrics_edge_cases(spark):
    rows = [(0, [1, 2, 3, 4]), (1, [2, 2, 2, 2]), (2, [0, 0, 0, 0]), (3, [4, 1, 1, 3]), (4, [1, 2, 3, 4])]
    got = {(r.document_1, r.document_2): r for r in V.pair_metrics(_vecs(spark, rows), block_rows=2).collect()}
    assert len(got) == 25
    vec = dict(rows)
    for (i, j), r in got.items():
        a, b = np.array(vec[i], float), np.array(vec[j], float)
        p = _pearson(a, b)
        assert (r.pearson_corr is None) == (p is None)
        if p is not None:
            assert abs(r.pearson_corr - p) < 1e-9
            assert abs(r.spearman_corr - _pearson(_ranks(a), _ranks(b))) < 1e-9
        k = _kendall_b(a, b)
        if k is not None and p is not None:
            assert abs(r.kendalltau_corr - k) < 1e-9
        na, nb = np.linalg.norm(a), np.linalg.norm(b)
        cos = 0.0 if na == 0 or nb == 0 else float(a @ b / na / nb)
        assert abs(r.cosine_similarity - cos) < 1e-9
        assert abs(r.euclidean_distance - np.linalg.norm(a - b)) < 1e-6
        assert abs(r.manhattan_distance - np.abs(a - b).sum()) < 1e-9
    assert got[(0, 4)].pearson_corr == 1.0 or abs(got[(0, 4)].pearson_corr - 1) < 1e-12


def test_cosine_pairs_match_brute_force_any_blocking(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(60, 8))
    df = _vecs(spark, list(enumerate(X.tolist())))
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    S = U @ U.T
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if S[i, j] >= 0.3}
    for block in (7, 25, 1000):
        got = {(r.id1, r.id2) for r in V.cosine_pairs(df, threshold=0.3, block_rows=block).collect()}
        assert got == want


def test_best_partner_ties_and_singletons(spark):
    rows = [(0, [1, 0]), (1, [1, 0]), (2, [1, 0]), (3, [0, 1])]
    df = _vecs(spark, rows).withColumn("g", F.when(F.col("doc_id") == 3, 1).otherwise(0))
    got = {r.id: (r.best_id, r.best_sim) for r in V.best_partner(df, keys=["g"], block_rows=1).collect()}
    assert got[0][0] == 1 and got[1][0] == 0 and got[2][0] == 0
    assert got[3] == (-1, None)


def test_neighbour_count_includes_itself(spark):
    rows = [(0, [1, 0]), (1, [0, 1]), (2, [0.9, 0.1])]
    got = {r.doc_id: r.size for r in V.neighbour_count(_vecs(spark, rows), 0.9).collect()}
    assert got == {0: 2, 1: 1, 2: 2}


def test_top_partners(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(30, 5))
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    S = U @ U.T
    np.fill_diagonal(S, -np.inf)
    top = V.top_partners(_vecs(spark, list(enumerate(X.tolist()))), 3, block_rows=8).collect()
    for r in top:
        order = np.argsort(-S[r.id], kind="stable")
        assert r.other == order[r.rank - 1]


def test_a_row_has_few_copies_while_its_blocks_can_grow(spark):
    df = _vecs(spark, [(i, [1.0, float(i)]) for i in range(60)])
    copies = V.block_pairs(df, "doc_id", "v", block_rows=2).groupBy("id").count().agg(F.max("count")).first()[0]
    assert copies == V.FEW_BLOCKS  # 30 before
    by_key = V.block_pairs(df.withColumn("g", F.lit(1)), "doc_id", "v", ["g"], block_rows=2)
    assert by_key.groupBy("id").count().agg(F.max("count")).first()[0] == V.FEW_BLOCKS


def test_stripes_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    X = np.round(rng.normal(size=(40, 4)), 1)
    X[7] = X[3]
    df = _vecs(spark, list(enumerate(X.tolist())))

    def results():
        return [sorted(tuple(r[:2]) for r in V.cosine_pairs(df, threshold=0.4, block_rows=9).collect()),
                sorted(tuple(r) for r in V.neighbour_count(df, 0.4, block_rows=9).collect()),
                sorted(tuple(r[:2]) for r in V.best_partner(df, block_rows=9).collect()),
                sorted((r.id, r["rank"], round(r.sim, 9)) for r in V.top_partners(df, 4, block_rows=9).collect())]

    whole = results()
    stripes = V.stripes
    # a stripe has one row: the function's own value goes to the tasks with it
    monkeypatch.setattr(V, "stripes", lambda L, R: ((s + i, S[i:i + 1].copy()) for s, S in stripes(L, R) for i in range(len(S))))
    assert results() == whole
    U = X / np.linalg.norm(X, axis=1, keepdims=True)
    assert dict(whole[1]) == dict(enumerate(((U @ U.T) >= 0.4).sum(1).tolist()))


def test_links_of_near_copies_are_joined_in_the_tasks(spark):
    from newsloom.operators.topics import connected_components

    rng = np.random.default_rng(6)
    X = np.vstack([np.ones((40, 6)) + rng.normal(scale=0.01, size=(40, 6)), rng.normal(size=(30, 6))])
    df = _vecs(spark, list(enumerate(X.tolist())))
    edges = V.component_edges(df, 0.9, block_rows=10)
    assert edges.count() <= 70 * V.FEW_BLOCKS < V.cosine_pairs(df, threshold=0.9).count()
    comps = [{r.doc_id: r.comp for r in connected_components(df.select("doc_id"), e).collect()}
             for e in (edges, V.cosine_pairs(df, threshold=0.9))]
    assert comps[0] == comps[1]


def test_lsh_pairs_are_those_of_a_common_bucket_without_a_join_of_buckets(spark):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(8)
    X = rng.normal(size=(80, 6))
    df = _vecs(spark, list(enumerate(X.tolist())) + [(90, [0.0] * 6), (91, [0.0] * 6)])
    out = V.approx_cosine_pairs(df, 0.35, tables=1)
    got = {(r.id1, r.id2): r.weight for r in out.collect()}
    unit = V.vec.normalise_df(df.withColumnRenamed("doc_id", "id"), "v", "_u").select("id", array_to_vector("_u").alias("features"))
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=0.5, numHashTables=1, seed=7).fit(unit)
    j = lsh.approxSimilarityJoin(unit, unit, float(np.sqrt(1.3)), distCol="d").filter("datasetA.id < datasetB.id")
    want = {(r[0], r[1]): 1 - r.d * r.d / 2 for r in j.select("datasetA.id", "datasetB.id", "d").collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - w) < 1e-9 for p, w in want.items())
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_pair_metrics_have_few_copies_and_small_results(spark, monkeypatch):
    rng = np.random.default_rng(4)
    X = np.round(rng.normal(size=(70, 5)), 1)
    vecs = _vecs(spark, list(enumerate(X)))
    made = []
    blocks = V.block_pairs
    monkeypatch.setattr(V, "block_pairs", lambda *a, **k: made.append(blocks(*a, **k)) or made[-1])
    run = lambda: {(r.document_1, r.document_2): [round(r[m], 6) for m in METRICS] for r in V.pair_metrics(vecs, block_rows=2).collect()}
    got = run()
    # blocks grow before their number does: 35 of 2 rows would be 35 copies of each
    assert len(got) == 70 * 70 and made[0].count() <= 70 * V.FEW_BLOCKS
    monkeypatch.setattr(V, "METRIC_ROWS", 3)
    monkeypatch.setattr(V, "SIGN_COLUMNS", 4)
    assert run() == got and all(got[j, i] == v for (i, j), v in got.items())


def test_a_pair_metrics_task_yields_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(V, "METRIC_ROWS", 10)
    kept = {}
    monkeypatch.setattr(V, "per_block_pair", lambda rep, keys, fields, fn: kept.update(fn=fn) or spark.createDataFrame([], "_g int, " + ", ".join(f"{n} {t.simpleString()}" for n, t in fields)))
    V.pair_metrics(_vecs(spark, [(0, [1, 2])]))
    X = np.random.default_rng(2).normal(size=(35, 4))
    sizes = [len(cols[0]) for cols in kept["fn"](np.arange(35), X, np.arange(35), X, True)]
    assert sum(sizes) == 35 * 35 and max(sizes) <= 100


def test_all_pairs_come_from_one_product(spark):
    from newsloom.plans import registry

    registry.load_all()
    df = registry.QUERIES["j05_all_pairs"](spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert df._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInArrow") == 1
    assert df.count() == n * n and df.select("id1", "id2").distinct().count() == n * n
