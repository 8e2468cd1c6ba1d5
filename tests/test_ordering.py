"""Ordering, binning and window operators on hand-made rows."""

from pyspark.sql import functions as F

from newsloom.operators import aggregate as A
from newsloom.operators import ordering as O
from newsloom.operators import sentiment as S
from newsloom.sources import files


def test_size_class_bins(spark):
    df = spark.createDataFrame([(i, float(w)) for i, w in enumerate([1, 2, 3, 4, 5, 6, 8])], "node long, sum_weight double")
    got = [r["size"] for r in A.size_class(df).orderBy("node").collect()]
    assert got == [1.0, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0]
    eq = spark.createDataFrame([(1, 3.0), (2, 3.0)], "node long, sum_weight double")
    assert {r["size"] for r in A.size_class(eq).collect()} == {2.5}


def test_centre_out(spark):
    info = spark.createDataFrame([(1, t) for t in [-1, 0, 1, 2, 3, 4]], "g int, topic int")
    order = [r.topic for r in O.centre_out(info, ["g"], keep_outlier=True).orderBy("topic_pos").collect()]
    assert order == [3, 1, 0, 2, 4, -1]
    single = spark.createDataFrame([(1, 0)], "g int, topic int")
    assert [r.topic for r in O.centre_out(single, ["g"]).collect()] == [0]


def test_prob_centre(spark):
    rows = [(1, d, p) for d, p in [(0, 0.5), (1, 1.0), (2, 0.2), (3, 0.9), (4, 1.0), (5, 0.3)]]
    df = spark.createDataFrame(rows, "g int, doc_id long, p double")
    got = [r.doc_id for r in O.prob_centre(df, ["g"], "p").orderBy("doc_pos").collect()]
    # rest in doc order: 0(.5) 2(.2) 3(.9) 5(.3); even positions 0,3 asc by p -> 0, 3; centre 1, 4; odd 2,5 desc -> 5, 2
    assert got == [0, 3, 1, 4, 5, 2]
    none = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.2)], "g int, doc_id long, p double")
    assert [r.doc_id for r in O.prob_centre(none, ["g"], "p").orderBy("doc_pos").collect()] == [0, 1]


def _centre_docs(spark, sizes):
    rows, doc = [], 0
    for topic, n in sizes.items():
        for _ in range(n):
            rows.append((1, doc, topic))
            doc += 1
    return spark.createDataFrame(rows, "g int, doc_id long, topic int")


def test_order_centre_outlier_side(spark):
    # ranks by size: 0:A(5) 1:B(4) 2:-1(3) 3:C(2): evens A, -1 -> outlier removed; odds B, C -> more odds -> -1 in front
    df = _centre_docs(spark, {10: 5, 11: 4, -1: 3, 12: 2})
    seq = [r.topic for r in O.order_centre(df, ["g"]).orderBy("order_pos").collect()]
    topics = [t for i, t in enumerate(seq) if i == 0 or seq[i - 1] != t]
    assert topics == [-1, 10, 11, 12]
    nout = _centre_docs(spark, {10: 3, 11: 2, 12: 1})
    seq = [r.topic for r in O.order_centre(nout, ["g"]).orderBy("order_pos").collect()]
    assert [t for i, t in enumerate(seq) if i == 0 or seq[i - 1] != t] == [12, 10, 11]


def test_overlap_batches(spark):
    df = spark.range(7000).withColumnRenamed("id", "doc_id")
    b = O.overlap_batches(df, ["doc_id"], 3000, 1500)
    agg = {r.batch: (r.lo, r.hi, r.n) for r in b.groupBy("batch").agg(F.min("row_pos").alias("lo"), F.max("row_pos").alias("hi"), F.count("*").alias("n")).collect()}
    assert agg == {0: (0, 2999, 3000), 1: (1500, 6999, 5500)}


def test_sentiment_class(spark):
    rows = [(0.4, 0.2, 0.4), (0.5, 0.2, 0.3), (0.3, 0.4, 0.3), (0.4, 0.4, 0.2)]
    df = spark.createDataFrame(rows, "n double, u double, p double")
    got = [r.c.label for r in df.select(S.sentiment_class(F.col("n"), F.col("u"), F.col("p")).alias("c")).collect()]
    assert got == ["positive", "negative", "neutral", "neutral"]


def test_sentiment_scale_all_equal_is_null(spark):
    df = spark.createDataFrame([(1, 2, 0.2, 0.3, 0.5), (1, 2, 0.2, 0.3, 0.5)], "year int, month int, negative double, neutral double, positive double")
    assert {r.setiment_scale for r in S.sentiment_scale(df).collect()} == {None}


def test_dominant_and_above(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([0.3, 0.3, 0.1],)], "p array<double>")
    got = [tuple(r.d) for r in df.select(O.dominant_topic(F.col("p")).alias("d")).collect()]
    assert got == [(-1, 0.0), (0, 0.3)]
    above = df.select(O.topics_above(F.col("p"), 0.5).alias("a")).first()["a"]
    assert [tuple(x) for x in above] == [(-1, 0.0)]


def test_date_chunks(spark):
    spine = spark.createDataFrame([(1,)], "x int").select(F.explode(files.date_spine(F.lit("2020-01-01"), F.lit("2020-01-13"))).alias("date"))
    sizes = sorted(r.n for r in files.date_chunks(spine).withColumn("n", F.datediff("end", "start") + 1).collect())
    assert sizes == [1, 6, 6]


def test_round_half_up(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r.r for r in df.select(F.round("x", 0).alias("r")).collect()] == [1.0, 2.0, 3.0]


def test_order_centre_keeps_a_small_outlier_topic_in_its_place(spark):
    from newsloom.operators import ordering as O

    topics = [0] * 5 + [-1] * 4 + [1] * 3 + [2] * 2
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(topics)], "m int, doc_id long, topic int")
    rows = sorted((r.order_pos, r.topic) for r in O.order_centre(df, ["m"]).collect())
    assert list(dict.fromkeys(t for _, t in rows)) == [1, 0, -1, 2]
