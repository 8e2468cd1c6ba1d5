"""Steps that used to run several times for one result, or that held more than they need."""

from pyspark.ml.linalg import Vectors
from pyspark.sql import Observation
from pyspark.sql import functions as F

from newsloom.functions import vec
from newsloom.operators import clean, features, sentiment


def final_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_trained_model_works_in_a_session_that_observed_something(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    rows = [(i, float(i % 2), Vectors.dense([float(i % 2), 1.0 + i])) for i in range(8)]
    df = spark.createDataFrame(rows, ["doc_id", "label", "features"])
    got = sentiment.train_sentiment(df).transform(df).select("label", "prediction").collect()
    assert seen.get["n"] == 3 and all(r.label == r.prediction for r in got)


def test_softmax_computes_its_logits_once(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0],), (None,), ([],)], "a array<double>")
    p = df.select(vec.softmax(F.transform("a", lambda x: F.cbrt(x * x * x))).alias("p"))
    assert p._jdf.queryExecution().optimizedPlan().toString().count("CBRT") == 1
    got = [r.p for r in p.collect()]
    assert [round(x, 6) for x in got[0]] == [0.042010, 0.114195, 0.843795] and got[1:] == [None, []]


def test_counts_make_the_terms_of_a_text_once(spark):
    docs = spark.createDataFrame([(1, "red cat red"), (2, "cat dog"), (2, "dog eel"), (None, "cat"), (3, None)], "doc_id long, content string")
    counts = features.count_vectorize(docs, ["doc_id"], min_df=2)
    rows = {(r.doc_id, r.term, r.tf, r.df, r.n_docs) for r in counts.collect()}
    assert rows == {(1, "cat", 1, 3, 5), (2, "cat", 1, 3, 5), (None, "cat", 1, 3, 5)}
    assert final_plan(counts).count("Generate explode") == 1
    few = counts.groupBy("term").agg(F.first("df").alias("df"), F.sum("tf").alias("n"))
    assert [tuple(r) for r in few.collect()] == [("cat", 3, 3)]
    assert final_plan(few).count("Generate explode") == 1


def test_the_best_document_reads_the_vectors_once(spark):
    docs = spark.createDataFrame([(1, "red cat red"), (2, "cat dog"), (3, "dog eel")], "doc_id long, content string")
    vecs = features.tfidf(features.count_vectorize(docs, ["doc_id"]), ["doc_id"])
    best = features.most_similar_one(vecs, spark.createDataFrame([("dog", 1), ("eel", 2), ("fox", 1)], "term string, tf long"))
    assert best.first().doc_id == 3 and "explode" not in final_plan(best)


def test_class_terms_are_counted_once(spark):
    counts = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string").select(
        "doc_id", F.explode(F.split("text", " ")).alias("term"), F.lit(1).alias("tf"))
    topics = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, topic int")
    w = features.ctfidf(counts, topics, [])
    assert {(r.topic, r.term) for r in w.collect()} == {(0, "a"), (0, "b"), (1, "b"), (1, "c")} and "explode" not in final_plan(w)


def test_lemmas_come_to_token_arrays(spark):
    rows = [(1, ["cats", "run", "cat", None], ["men"]), (2, None, ["man", "cats"]), (3, [], None), (4, ["cats"], ["b"]), (4, ["a", "men"], ["cats"]),
            (None, ["cats", "gas"], []), (None, ["a"], None)]
    df = spark.createDataFrame(rows, "doc_id long, x array<string>, y array<string>").withColumn("x", F.transform("x", lambda t: F.regexp_replace(t, "#", "")))
    out = clean.lemmatize(df, ["doc_id"], {"u": "x", "v": "y"})
    got = {r.doc_id: (r.u, r.v) for r in out.collect()}
    assert got == {1: ("cat run cat", "man"), 2: ("", "man cat"), 3: ("", ""), 4: ("a cat man", "b cat"), None: ("a cat gas", "")}
    assert "regexp_replace" not in final_plan(out)  # tokens are made once, for the lemmas and for the result


def test_contractions_are_split_in_one_pass(spark):
    from newsloom.functions import text

    df = spark.createDataFrame([("Cannot gimme GONNA gotta lemme wanna cannots xgonna can-not",)], "t string")
    out = df.select(text.split_contractions(F.col("t")).alias("t"))
    assert out.first().t == "Can not gim me GON NA got ta lem me wan na cannots xgonna can-not"
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
