"""Sentiment operators."""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import vec
from newsloom.session import scratch_path, table_of

CLASSES = ("negative", "neutral", "positive")

# Plot colours per sentiment class.
SENTIMENT_COLOURS = {"neutral": "#B0B0B0", "positive": "#FFD700", "negative": "#FF0000"}


def sentiment_class(neg: Column, neu: Column, pos: Column) -> Column:
    """F2: struct(label, score). Neutral when >= both, negative when > both, else positive."""
    return (
        F.when((neu >= neg) & (neu >= pos), F.struct(F.lit("neutral").alias("label"), neu.alias("score")))
        .when((neg > neu) & (neg > pos), F.struct(F.lit("negative").alias("label"), neg.alias("score")))
        .otherwise(F.struct(F.lit("positive").alias("label"), pos.alias("score")))
    )


def sentiment_scale(df: DataFrame, keys: Sequence[str] = ("year", "month"), out: str = "setiment_scale") -> DataFrame:
    """min-max of neutral + positive - negative within each key group; all equal -> NULL."""
    w = Window.partitionBy(*keys)
    t = F.col("neutral") + F.col("positive") - F.col("negative")
    return df.withColumn(
        out, F.try_divide(t - F.min(t).over(w), F.max(t).over(w) - F.min(t).over(w))
    )


def sentiment_colour(label: Column) -> Column:
    """colour per class as a map literal lookup."""
    m = F.create_map(*[x for kv in SENTIMENT_COLOURS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return m[label]


def probabilities_from_logits(df: DataFrame, logits: Column) -> DataFrame:
    """F1 + N1 tail: three class probabilities from a logits array."""
    p = vec.softmax(logits)
    return df.select("*", *(F.element_at(p, i + 1).alias(c) for i, c in enumerate(CLASSES)))


def lexicon_from_labels(docs: DataFrame, labels: DataFrame, tokens_col: str = "toks", key: str = "doc_id",
                        min_docs: int = 5) -> DataFrame:
    """A learned default lexicon: per token, how much more often its labelled documents are
    toxic (negative weight) or of good quality (positive weight) than all labelled documents.
    Output: word, neg, neu (0), pos. Tokens in fewer than ``min_docs`` labelled documents are left out."""
    lab = docs.select(key, F.array_distinct(tokens_col).alias("_t")).join(labels, key)
    base = lab.agg(F.avg("toxic").alias("_bt"), F.avg("quality").alias("_bq"))
    per = lab.select(F.explode("_t").alias("word"), "toxic", "quality").groupBy("word").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("toxic").alias("_t"), F.avg("quality").alias("_q"))
    per = per.filter(F.col("_n") >= min_docs)
    bt = base.select("_bt").scalar()
    bq = base.select("_bq").scalar()
    return per.select("word", (F.col("_t") - bt).alias("neg"), F.lit(0.0).alias("neu"), (F.col("_q") - bq).alias("pos"))


def score_sentiment(docs: DataFrame, lexicon: DataFrame, tokens_col: str = "toks", key: str = "doc_id",
                    scale: float = 1.0) -> DataFrame:
    """N1 (default scorer): logits = summed lexicon weights of the tokens (join on word;
    the lexicon is vocabulary sized), softmax -> negative, neutral, positive."""
    ex = docs.select(key, F.explode(tokens_col).alias("word"))
    sums = ex.join(lexicon, "word").groupBy(key).agg(
        F.sum("neg").alias("_n"), F.sum("neu").alias("_u"), F.sum("pos").alias("_p"))
    allk = docs.select(key).join(sums, key, "left")
    logits = F.array(*[F.lit(scale) * F.coalesce(F.col(c), F.lit(0.0)) for c in ("_n", "_u", "_p")])
    return probabilities_from_logits(allk, logits).drop("_n", "_u", "_p")


def score_binary(scored: DataFrame) -> DataFrame:
    """Two-class form: label POSITIVE/NEGATIVE and its softmax score over (neg, pos) logits."""
    # both probabilities can underflow to 0
    p = F.coalesce(F.try_divide(F.col("positive"), F.col("positive") + F.col("negative")), F.lit(0.5))
    return scored.withColumn("label", F.when(p >= 0.5, F.lit("POSITIVE")).otherwise(F.lit("NEGATIVE"))).withColumn(
        "score", F.greatest(p, F.lit(1.0) - p))


def score_with_fallback(df: DataFrame, scorer, sizes, text_col: str = "content", key: str = "doc_id") -> DataFrame:
    """Per row, the first size of ``sizes`` whose cut text the scorer accepts (a scorer
    raises ValueError to refuse). Runs inside Arrow batches: ``scorer(list[str]) -> list[float]``
    is called per size on the rows still open. Output: key, size, score (NULL when none fits)."""
    sizes = list(sizes)

    def run(batches):
        for pdf in batches:
            out_size = [None] * len(pdf)
            out_score = [None] * len(pdf)
            texts = pdf[text_col].fillna("").tolist()
            for i, t in enumerate(texts):
                for s in sizes:
                    try:
                        out_score[i] = float(scorer([t[:s]])[0])
                        out_size[i] = s
                        break
                    except ValueError:
                        continue
            yield pd.DataFrame({key: pdf[key], "size": pd.array(out_size, dtype="Int64"),
                                "score": pd.array(out_score, dtype="Float64")})

    return df.select(key, text_col).mapInPandas(run, f"{key} long, size long, score double")


def tfidf_features(docs: DataFrame, tokens_col: str = "toks", key: str = "doc_id") -> DataFrame:
    """``key, features``: sparse TF-IDF vectors over all terms of ``docs(key, tokens)``, tf * ln((n + 1) / (df + 1)).

    Term numbers are positions in a Spark table of the distinct terms, so no two terms share one and none is left out. The rows are written to the
    shared folder before they become vectors: a fit reads them many times.
    """
    from pyspark.ml.linalg import Vectors, VectorUDT

    from newsloom.operators.ordering import global_position

    rows = table_of(docs.select(key, tokens_col), "tokens")
    tf = rows.select(key, F.explode(tokens_col).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = rows.count()
    terms = global_position(df, ["term"], "place").select("term", "place", F.log(F.lit(n + 1.0) / (F.col("df") + 1)).alias("idf"))
    terms = table_of(terms, "terms")
    size = terms.count()
    weights = tf.join(terms, "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", (F.col("tf") * F.col("idf")).alias("w")))).alias("x"))
    weights = rows.select(key).join(weights, key, "left").select(key, F.transform("x", lambda e: e["place"]).alias("place"), F.transform("x", lambda e: e["w"]).alias("w"))
    vector = F.udf(lambda place, w: Vectors.sparse(size, place or [], w or []), VectorUDT())
    return table_of(weights, "weights").select(key, vector("place", "w").alias("features"))


def train_sentiment(features: DataFrame, label: str = "label", features_col: str = "features", seed: int = 43):
    """A multinomial logistic regression on document features (e.g. TF-IDF vectors).

    The model comes back from the shared folder, without its training summary: that holds the session, which can't be sent to tasks once something
    in it was observed (``DataFrame.observe``).
    """
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel

    path = scratch_path(features.sparkSession, "model")
    LogisticRegression(family="multinomial", labelCol=label, featuresCol=features_col, maxIter=50).fit(features).write().save(path)
    return LogisticRegressionModel.load(path)
