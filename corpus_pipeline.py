"""Corpus pipeline: quality, near duplicates, benchmark contamination, personal data, tokens.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before kept; all but the last return the columns of documents.
Every row goes or stays by its own content: rows that share a doc_id, or have none, are documents of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bpe, decontaminate, ngram_join, pii, quality
from newsloom.llm.base import saved, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney model doesn't reject."""
    verdict = quality.classify(docs, table(spark, sf_dir, "labels"), hashed=True)
    return decontaminate.without_rows(docs, verdict.where("NOT kept").select("doc_id", "th", "lang"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicate texts: one with the smallest doc_id, or without any if none has one. Rows without a word stay."""
    member = saved(ngram_join.row_components(docs))
    best = member.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("b")).select("b.doc_id", "b.th")
    rows = member.groupBy("doc_id", "th").count()
    best = saved(best.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).join(rows, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("doc_id", "th", "count"))
    others = rows.join(best.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left_anti")
    kept = decontaminate.without_rows(docs, others.select("doc_id", "th"))
    repeated = best.where("count > 1").select("doc_id", "th")
    if repeated.isEmpty():
        return kept
    again = repeated.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    whole = kept.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), decontaminate.text_hash().alias("h"))
    once = whole.join(again, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_th")), "left_semi").groupBy("id", "h").agg(F.min("row").alias("row"))
    return decontaminate.without_rows(kept, repeated).union(once.select("row.*"))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage of more than a twentieth of their words."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256``: the token ids of every document, and digests of the ids and their decoded text."""
    path = public_tokenizers.path("word_bpe_49k.json")
    both = bpe.encode(docs, path, decoded=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", contamination),
    ("PII", personal_data),
    ("BPE encoding and decoding", tokens),
]

#: The model of the first stage can't be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
