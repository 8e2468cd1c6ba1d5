"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A sentence's score is a logistic function of its words and of the beginnings of longer words; a document is toxic unless all its sentences are clean:
P = 1 - prod(1 - p_s). Only documents are labelled, and the gradient shares the blame among sentences. The model is trained
in numpy on a bounded sample of labelled documents; every document is scored in its own partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.base import bounded_batches, query, saved, table
from newsloom.llm.words import NON_WORD, byte_class, words_of

#: Labelled documents that the model is trained on at most, of each class (those with the lowest hash of doc_id).
MAX_TOXIC, MAX_CLEAN = 2500, 5000
#: A feature needs this many training documents.
MIN_DOCS = 4
#: Lengths in bytes of the word beginnings that are features.
PREFIXES = (4, 6, 8)
_END = byte_class(b".!?\n\r")


def held_out(doc_id: Column) -> Column:
    """Rows that training must not see: crc32 of the id as text is a multiple of five (null ids as well)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sentences(words) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each sentence with a word, document of each sentence) of a chunk of rows."""
    n = len(words.hash)
    doc = np.repeat(np.arange(len(words.counts)), words.counts)
    ends = np.cumsum(_END[words.data])
    place = ends[words.start] if n else np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return first, doc[first]


def features(words) -> np.ndarray:
    """32-bit hashes of the word and its beginnings, a row for each word; 0 stands for none."""
    return np.stack([words.hash, *(words.prefix(k) for k in PREFIXES)], axis=1).view(np.uint64) >> np.uint64(32)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``toxic, words, first``: features and the first word of each sentence of the sampled documents."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = saved(part(1, MAX_TOXIC).union(part(0, MAX_CLEAN)))

    def run(batches):
        for batch in batches:
            words, first = [], []
            for w in words_of(batch.column("text"), NON_WORD):
                at, doc = sentences(w)
                rows = features(w).astype(np.uint32).view(np.int32)
                cut = np.searchsorted(doc, np.arange(len(w.counts) + 1))
                for i in range(len(w.counts)):
                    words.append(rows[w.first[i]:w.first[i + 1]].ravel())
                    first.append((at[cut[i]:cut[i + 1]] - w.first[i]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(words, pa.list_(pa.int32())), pa.array(first, pa.list_(pa.int32()))],
                                             names=["toxic", "words", "first"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")
    return rows.mapInArrow(run, "toxic int, words array<int>, first array<int>")


def fit(rows: pa.Table, rounds: int = 200, shrink: float = 5e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """(features in order, weights, bias) by Adam on the document likelihood, with an L1 penalty that clears features of no use."""
    rows = rows.combine_chunks()
    y = np.asarray(rows["toxic"]).astype(np.float64)
    width = 1 + len(PREFIXES)
    docs = [np.asarray(x.values).view(np.uint32) for x in rows["words"] if len(x)]
    starts = [np.asarray(x.values) for x in rows["first"] if len(x)]
    y = y[[len(x) > 0 for x in rows["words"]]]
    if not len(docs) or y.min() == y.max():
        return np.zeros(0, np.uint32), np.zeros(0), -8.0
    once = np.concatenate([np.unique(d) for d in docs])
    vocab, df = np.unique(once, return_counts=True)
    vocab = vocab[(df >= MIN_DOCS) & (vocab > 0)]
    words = np.concatenate(docs)
    if not len(vocab):
        return np.zeros(0, np.uint32), np.zeros(0), -8.0
    at = np.minimum(np.searchsorted(vocab, words), len(vocab) - 1)
    known = vocab[at] == words
    size = np.array([len(d) // width for d in docs])
    first = np.concatenate([s + o for s, o in zip(starts, np.cumsum(size) - size)])
    sent = np.repeat(np.arange(len(first)), width * np.diff(np.r_[first, len(words) // width]))[known]
    doc_first = np.r_[0, np.cumsum([len(s) for s in starts])[:-1]]
    doc = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
    word = at[known]
    weight = np.where(y > 0, (y == 0).sum() / max(1, y.sum()), 1.0) / len(y)
    theta, bias = np.zeros(len(vocab)), -6.0
    m, v, mb, vb = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.clip(bias + np.bincount(sent, theta[word], len(first)), -30, 30)
        total = np.add.reduceat(np.logaddexp(0, z), doc_first)
        slope = weight * np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0)
        g = slope[doc] / (1 + np.exp(-z))
        grad, gb = np.bincount(word, g[sent], len(vocab)), g.sum()
        rate = 0.3 * min(1.0, 2 * (1 - t / (rounds + 1)))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        theta -= scale * m / (1 - 0.9**t)
        theta = np.sign(theta) * np.maximum(np.abs(theta) - scale * shrink * 0.1, 0)
        bias -= rate * mb / (1 - 0.9**t) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    keep = theta != 0
    return vocab[keep], theta[keep], float(bias)


def score(docs: DataFrame, model) -> DataFrame:
    """``doc_id, score, n_sentences, offending``: noisy-or score and the sentences (place, score, text) that are toxic by themselves."""

    def run(batches):
        vocab, theta, bias = model.value
        for batch in batches:
            total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            bad: list[list] = [[] for _ in range(batch.num_rows)]
            for w in words_of(batch.column("text"), NON_WORD):
                if not len(w.hash):
                    continue
                first, doc = sentences(w)
                value = np.zeros(len(w.hash))
                if len(vocab):
                    key = features(w).astype(np.uint32)
                    at = np.minimum(np.searchsorted(vocab, key), len(vocab) - 1)
                    value = np.where(vocab[at] == key, theta[at], 0.0).sum(axis=1)
                z = np.clip(bias + np.add.reduceat(value, first), -30, 30)
                n = len(w.counts)
                total[w.rows] = np.bincount(doc, np.logaddexp(0, z), n)
                count[w.rows] = np.bincount(doc, minlength=n)
                start = np.searchsorted(doc, np.arange(n))
                last = np.r_[first[1:], len(w.hash)] - 1
                for s in np.flatnonzero(z > 0).tolist():
                    text = w.data[w.start[first[s]]:w.end[last[s]]].tobytes().decode("utf-8", "replace")
                    bad[w.rows.start + int(doc[s])].append({"sentence": int(s - start[doc[s]]), "score": float(1 / (1 + np.exp(-z[s]))), "text": text})
            kind = pa.list_(pa.struct([("sentence", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(-np.expm1(-total)), pa.array(count), pa.array(bad, kind)],
                                             names=["doc_id", "score", "n_sentences", "offending"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, n_sentences int, offending array<struct<sentence:int,score:double,text:string>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_sentences, offending`` of every row of ``docs(doc_id, text)``.

    Learns from labels whose doc_id isn't held out; a doc_id with several labels is toxic if one says so. A null or empty text has no
    sentence and score 0. Repeated rows have equal results; null doc_ids count as held out; other columns are ignored. Without labels of
    both classes every score is near 0.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs, labels).toArrow()))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "offending")


@query("op4_multiple_instance_toxicity")
def op4(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
