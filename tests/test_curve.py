"""Hilbert curve and layout operators: fixed tables, properties, hand-made rows."""

from pyspark.sql import functions as F

from newsloom.functions import hilbert
from newsloom.operators import curve, graph


def _cells(spark, bits, dims):
    p = hilbert.points(spark, bits, dims).orderBy("d").collect()
    return [tuple(r[c] for c in ("x", "y", "z")[:dims]) for r in p]


def test_fixed_tables(spark):
    assert _cells(spark, 1, 2) == [(0, 0), (0, 1), (1, 1), (1, 0)]
    assert _cells(spark, 2, 2) == [(0, 0), (1, 0), (1, 1), (0, 1), (0, 2), (0, 3), (1, 3), (1, 2),
                                   (2, 2), (2, 3), (3, 3), (3, 2), (3, 1), (2, 1), (2, 0), (3, 0)]
    assert _cells(spark, 3, 2)[:8] == [(0, 0), (0, 1), (1, 1), (1, 0), (2, 0), (3, 0), (3, 1), (2, 1)]
    assert _cells(spark, 1, 3) == [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1), (1, 0, 0)]


def test_bijection_unit_steps(spark):
    for bits, dims in ((4, 2), (5, 2), (3, 3)):
        cells = _cells(spark, bits, dims)
        assert len(set(cells)) == len(cells) == 1 << (bits * dims)
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(cells, cells[1:]))
        assert cells[-1] == ((1 << bits) - 1,) + (0,) * (dims - 1)


def test_encode_inverts_decode(spark):
    p = hilbert.points(spark, 5, 2)
    back = hilbert.encode_2d(p, "x", "y", 5, "back")
    assert back.filter(F.col("back") != F.col("d")).count() == 0


def test_place_on_curve_exact_cell_and_past_end(spark):
    rows = [(1, 1, 0, 0.0), (1, 1, 1, 2.0), (1, 1, 2, 0.5), (1, 1, 3, 100.0)]
    df = spark.createDataFrame(rows, "year int, month int, pos int, spacing double")
    got = [(r.x, r.y) for r in curve.place_on_curve(df, ["year", "month"], ["pos"], 2).orderBy("pos").collect()]
    # cells of the 2-bit curve: 0 (0,0), 2 (1,1), 2.5 halfway (1,1)->(0,1), past the end -> last cell (3,0)
    assert got == [(0.0, 0.0), (1.0, 1.0), (0.5, 1.0), (3.0, 0.0)]


def test_spacing_one_doc_topic_and_ties(spark):
    rows = [(1, 1, 0, 0, 0.0, 0.0), (1, 1, 1, 1, 0.0, 0.5), (1, 1, 2, 1, 0.4, 0.5), (1, 1, 3, 2, 0.0, 0.5)]
    df = spark.createDataFrame(rows, "year int, month int, pos int, topic int, similarity_previous_document double, similarity_previous_topic double")
    sp = [r.spacing for r in curve.spacing_similarity(df, ["year", "month"], ["pos"], "topic", 16, 1).orderBy("pos").collect()]
    assert sp[0] == 0.0
    assert abs(sum(sp) - 15.0) < 1e-9
    assert abs(sp[1] - sp[3]) < 1e-12  # equal topic similarities share equally


def test_bezier_special_edges(spark):
    pos = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 5.0), (3, 5.0, 0.0), (4, 0.0, 0.0)], "doc_id long, x double, y double")
    edges = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "id1 long, id2 long")
    pts = curve.bezier_edges(edges, pos).collect()
    assert len(pts) == 60
    assert all(r.x == r.x and r.y == r.y for r in pts)  # no NaN for vertical, horizontal, zero length
    ends = {(r.id1, r.id2, r.step): (round(r.x, 9), round(r.y, 9)) for r in pts}
    assert ends[(1, 2, 0)] == (0.0, 0.0) and ends[(1, 2, 19)] == (0.0, 5.0)
    assert ends[(1, 4, 7)] == (0.0, 0.0)


def test_strong_edges_dedup(spark):
    e = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9), (3, 4, 0.1)], "id1 long, id2 long, weight double")
    assert [(r.id1, r.id2) for r in graph.strong_edges(e, 0.7).collect()] == [(1, 2)]


def test_filter_graph_drops_isolated_and_small_topics(spark):
    topics = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1)], "doc_id long, topic int")
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.1), (3, 4, 0.9)], "id1 long, id2 long, weight double")
    kept = sorted(r.doc_id for r in graph.filter_graph(edges, topics, weight=0.3, min_topic_news=2).collect())
    assert kept == [1, 2]
