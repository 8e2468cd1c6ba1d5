"""M4 on index prefixes against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import features


def _vectors(spark, docs):
    """Unit vectors of ``{doc: {term: weight}}`` and all their pairs' cosines."""
    rows, unit = [], {}
    for d, tw in docs.items():
        n = np.sqrt(sum(x * x for x in tw.values()))
        unit[d] = {t: x / n for t, x in tw.items()}
        rows += [(d, t, float(x)) for t, x in unit[d].items()]
    ids = sorted(unit)
    cos = {(a, b): sum(x * unit[b].get(t, 0.0) for t, x in unit[a].items()) for i, a in enumerate(ids) for b in ids[i + 1:]}
    return spark.createDataFrame(rows, "doc_id long, term string, w double"), cos


def _random_docs(n, seed):
    """Few and many terms, groups of copies and near copies, one term in every document."""
    rng = np.random.default_rng(seed)
    docs = {}
    for d in range(n):
        if d % 4 == 3 and docs:
            near = dict(docs[int(rng.integers(0, d))])
            if d % 8 == 3:
                near[f"t{rng.integers(0, 60)}"] = float(rng.random() * 3)
            docs[d] = near
        else:
            docs[d] = {f"t{int(t)}": float(rng.random() + 0.05) for t in rng.zipf(1.3, int(rng.integers(1, 30))) % 60}
            docs[d]["all"] = 0.3
    return docs


def _found(df):
    return {(r.id1, r.id2): r.weight for r in df.collect()}


@pytest.mark.parametrize("threshold,list_rows,block_rows", [(0.6, 1024, 2048), (0.3, 7, 10), (0.95, 7, 10)])
def test_pairs_equal_brute_force(spark, threshold, list_rows, block_rows):
    """Whole and split posting lists, one and many blocks: the same pairs as all pairs give, and the same cosines."""
    vecs, cos = _vectors(spark, _random_docs(120, 5))
    want = {p: c for p, c in cos.items() if c >= threshold}
    got = _found(features.tfidf_cosine(vecs, threshold, list_rows=list_rows, block_rows=block_rows))
    unsure = {p for p, c in cos.items() if abs(c - threshold) < 1e-9}
    assert set(got) - unsure == set(want) - unsure
    assert all(abs(got[p] - cos[p]) < 1e-9 for p in got)


def test_candidates_are_far_fewer_than_all_pairs(spark):
    """Documents of own rare terms and one common term give no candidates; copies do."""
    docs = {d: {f"own{d}": 1.0, f"next{d}": 1.0, "all": 0.5} for d in range(100)}
    docs[100] = dict(docs[7])
    vecs, _ = _vectors(spark, docs)
    packed = vecs.join(vecs.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term").groupBy(F.col("doc_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("df", F.xxhash64("term").alias("h"), "w"))).alias("v")).select("id", "v.h", "v.w")
    got = features._prefix_candidates(packed, 0.6, 1024).collect()
    assert [(r.id1, r.id2) for r in got] == [(7, 100)]


def test_empty_null_and_unequal_input(spark):
    """No rows give no pairs, null keys, terms and weights are left out, ids of any size and order are kept."""
    schema = "doc_id long, term string, w double"
    assert features.tfidf_cosine(spark.createDataFrame([], schema), 0.5).count() == 0
    rows = [(2 ** 40, "a", 1.0), (-3, "a", 1.0), (None, "a", 1.0), (5, None, 1.0), (6, "a", None), (9, "b", 1.0)]
    assert _found(features.tfidf_cosine(spark.createDataFrame(rows, schema), 0.5)) == {(-3, 2 ** 40): 1.0}
    with pytest.raises(ValueError):
        features.tfidf_cosine(spark.createDataFrame([], schema), 0.0)


def test_vectors_have_few_copies_while_blocks_can_grow(spark):
    """120 documents that are all candidates of each other, 12 blocks of 10: a vector has a copy for each of 4 blocks, not of 12."""
    ids = range(120)
    packed = spark.createDataFrame([(i, [1], [1.0]) for i in ids], "id long, h array<long>, w array<double>")
    cand = spark.createDataFrame([(a, b) for a in ids for b in ids if a < b], "id1 long, id2 long")
    sides, vectors = features._block_sides(packed, cand, 10)
    assert sides.count() == 120 * 119 // 2 and vectors.count() <= 4 * 120
