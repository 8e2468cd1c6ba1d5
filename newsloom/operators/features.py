"""Text features: counts, TF-IDF, c-TF-IDF, similarity.

Everything is long form ``(key, term, value)``: term statistics are aggregations, document
vectors are never densified, and document similarity is a search on index prefixes of rare
terms with exact verification, so frequent terms create no join rows.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.session import table_of

#: Blocks of documents before blocks grow in the verification of candidate pairs, and how many times larger they get.
FEW_BLOCKS = 4
TOKEN_PATTERN = "[\\p{L}\\p{N}_]{2,}"


def feature_tokens(c: Column, stop=True) -> Column:
    """Vectoriser tokens: runs of 2+ word characters of the lower-cased text, stop words out."""
    toks = F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0)
    return text.remove_stopwords(toks) if stop else toks


def doc_terms(df: DataFrame, key: Sequence[str], text_col: str = "content", ngram=(1, 1), stop=True) -> DataFrame:
    """Term counts per document: key..., term, tf. The texts are dealt by key, so their terms, which are many more bytes, are counted where they are."""
    k = list(key)
    toks = df.select(*k, text_col).repartition(*k).select(*k, feature_tokens(F.col(text_col), stop).alias("_t"))
    grams = toks.select(*k, F.explode(text.ngrams(F.col("_t"), ngram[0], ngram[1])).alias("term"))
    return grams.groupBy(*k, "term").agg(F.count(F.lit(1)).alias("tf"))


def count_vectorize(df: DataFrame, key: Sequence[str], text_col: str = "content", min_df: float = 1,
                    max_df: float = 1.0, ngram=(1, 1), stop=True, group: Sequence[str] = ()) -> DataFrame:
    """M2: counts of the kept vocabulary; df >= min_df (absolute when >= 1, else share) and
    df <= max_df * n_docs (share when <= 1). ``group`` makes the vocabulary per group."""
    k, g = list(key), list(group)
    n_docs = df.groupBy(*g).agg(F.count(F.lit(1)).alias("_n")) if g else None
    # dealt once, by term, for the document frequencies and for the join with them; every tf is above 0, but tests that read
    # all columns keep the two uses equal, so that Spark reuses the exchange and texts become terms once
    tf = doc_terms(df, k, text_col, ngram, stop).repartition(*g, "term")
    dfreq = tf.groupBy(*g, "term").agg(F.count_if((F.col("tf") > 0) | (F.xxhash64(*k) == 0)).alias("df"))
    if g:
        dfreq = dfreq.join(n_docs, g)
        n = F.col("_n")
    else:
        n = df.agg(F.count(F.lit(1))).scalar()
    lo = F.lit(min_df) if min_df >= 1 else F.ceil(F.lit(min_df) * n)
    hi = F.lit(max_df) if max_df > 1 else F.lit(max_df) * n
    vocab = dfreq.filter((F.col("df") >= lo) & (F.col("df") <= hi)).select(*g, "term", "df", n.alias("n_docs"))
    return tf.join(vocab, g + ["term"]).filter((F.col("tf") > 0) | (F.xxhash64(*k) == F.col("df")))


def tfidf(counts: DataFrame, key: Sequence[str]) -> DataFrame:
    """M3: tf * (ln((1 + n) / (1 + df)) + 1), L2-normalised per document: key..., term, w."""
    k = list(key)
    raw = counts.withColumn("_w", F.col("tf") * (F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(*k)))
    return raw.select(*k, "term", "df", "n_docs", (F.col("_w") / norm).alias("w"))


def tfidf_cosine(vecs: DataFrame, threshold: float, key: str = "doc_id", block_rows: int = 2048,
                 list_rows: int = 1024) -> DataFrame:
    """M4: document pairs with TF-IDF cosine >= threshold (exact): ``id1 < id2, weight``.

    ``vecs``: key (long), term, w and, if at hand, df; unit length per document, threshold above 0. Rows with a null
    key, term or weight are left out. A document's terms stand in order of df, rare ones first. Its index prefix ends
    where the rest is shorter than the threshold: two documents whose prefixes share no term can't reach it. A pair is
    a candidate if at some shared prefix term ``w1 * w2 + rest1 * rest2 >= threshold``, which holds at the first term
    that a pair of the result shares. Candidates are then verified on whole vectors.

    Short posting lists share buckets of a bounded number of entries, a list above ``list_rows`` is split into pairs of
    parts. Verification runs by pairs of document blocks; a vector goes only to block pairs where it has a candidate. A
    vector has a copy for each block at most, so above ``FEW_BLOCKS`` blocks the blocks grow first, up to ``FEW_BLOCKS`` times.
    Packed vectors and candidates are written to the shared folder while the query is built.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    v = vecs.where(F.col(key).isNotNull() & F.col("term").isNotNull() & F.col("w").isNotNull())
    if "df" not in v.columns:
        v = v.join(v.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term")
    packed = v.groupBy(F.col(key).cast("long").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("df", F.xxhash64("term").alias("h"), "w"))).alias("_sv"))
    # two parallel arrays reach pandas as numpy arrays (no per-element Python objects)
    packed = table_of(packed.select("id", F.col("_sv.h").alias("h"), F.col("_sv.w").alias("w")), "tfidf-vectors")
    cand = table_of(_prefix_candidates(packed, threshold, list_rows), "tfidf-candidates")
    return _verified_cosines(packed, cand, threshold, block_rows)


def _flat(ids, hs, ws):
    """Row numbers, term hashes and weights of packed vectors, one element per term."""
    lens = np.array([len(x) for x in hs], dtype=np.int64)
    if not lens.sum():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), lens
    return np.repeat(np.arange(len(ids)), lens), np.concatenate(list(hs)), np.concatenate(list(ws)), lens


def _prefix_candidates(packed: DataFrame, threshold: float, list_rows: int) -> DataFrame:
    """Distinct pairs ``id1 < id2`` that pass the bound at a shared term of their index prefixes."""
    floor = threshold - 1e-9

    def prefixes(batches):
        for pdf in batches:
            row, h, w, _ = _flat(pdf["id"], pdf["h"], pdf["w"])
            # lengths from each term on, summed from the document's own end: no error of other documents enters
            own = np.concatenate([np.sqrt(np.cumsum(np.square(x[::-1]))[::-1]) for x in pdf["w"]] or [np.empty(0)])
            last = np.append(row[1:] != row[:-1], True)[:len(row)]
            rest = np.where(last, 0.0, np.append(own[1:], 0.0)[:len(own)])
            prev = np.where(np.append(True, last[:-1])[:len(row)], 0, np.append(0, h[:-1])[:len(row)])
            use = own >= floor
            yield pd.DataFrame({"h": h[use], "prev": prev[use], "id": pdf["id"].to_numpy(np.int64)[row[use]], "w": w[use], "r": rest[use]})

    entries = packed.mapInPandas(prefixes, "h long, prev long, id long, w double, r double")
    hot = entries.groupBy("h").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > list_rows).select(
        "h", F.ceil(F.col("_m") / list_rows).cast("int").alias("_parts"))
    par = packed.sparkSession.sparkContext.defaultParallelism
    buckets = F.greatest(F.lit(2 * par), F.ceil(packed.agg(F.sum(F.size("h"))).scalar() / F.lit(16 * list_rows)))
    parted = entries.withColumn("_bucket", F.pmod(F.col("h"), F.coalesce(buckets, F.lit(1)))).join(hot, "h", "left")
    part = F.pmod(F.xxhash64("id"), F.coalesce("_parts", F.lit(1))).cast("int")
    copies = parted.withColumn("_p", part).withColumn(
        "_c", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    copies = copies.select(F.when(F.col("_parts").isNotNull(), F.col("h")).otherwise(F.col("_bucket")).alias("_k"),
                           F.col("_parts").isNotNull().alias("_hot"), F.least("_p", "_c").alias("_b1"),
                           F.greatest("_p", "_c").alias("_b2"), (F.col("_p") > F.col("_c")).alias("_right"), "h", "prev", "id", "w", "r")

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        cross = pdf["_b1"].iloc[0] != pdf["_b2"].iloc[0]
        left = pdf[~pdf["_right"]] if cross else pdf.sort_values("h", kind="stable")
        right = pdf[pdf["_right"]] if cross else left
        lh, rh = left["h"].to_numpy(), right["h"].to_numpy()
        lo = np.zeros(len(lh), np.int64) if cross else np.arange(1, len(lh) + 1)
        width = (np.full(len(lh), len(rh)) if cross else np.searchsorted(rh, lh, "right")) - lo
        la, lw, lr, lp, ra, rw, rr, rp = (side[c].to_numpy() for side in (left, right) for c in ("id", "w", "r", "prev"))
        one, two, upto, start = [], [], np.cumsum(width), 0
        while start < len(lh):
            done = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, done + 100_000, "right")))
            n = width[start:stop]
            i = np.repeat(np.arange(start, stop), n)
            j = lo[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            # an equal term right before this one is shared too, so the first shared term decides the pair elsewhere
            ok = (lw[i] * rw[j] + lr[i] * rr[j] >= floor) & ((lp[i] != rp[j]) | (lp[i] == 0)) & (la[i] != ra[j])
            a, b = la[i[ok]], ra[j[ok]]
            one.append(np.minimum(a, b))
            two.append(np.maximum(a, b))
            start = stop
        none = [np.empty(0, np.int64)]
        return pd.DataFrame({"id1": np.concatenate(one or none), "id2": np.concatenate(two or none)})

    return copies.groupBy("_k", "_hot", "_b1", "_b2").applyInPandas(pairs, "id1 long, id2 long").distinct()


def _block_sides(packed: DataFrame, cand: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """The candidate pairs with their pair of blocks, and the vectors for each pair of blocks."""
    par = packed.sparkSession.sparkContext.defaultParallelism
    least = int(np.ceil((np.sqrt(16 * par + 1) - 1) / 2))
    n = packed.agg(F.count(F.lit(1))).scalar()
    blocks = F.greatest(F.lit(least), F.least(F.lit(FEW_BLOCKS), F.ceil(n / F.lit(block_rows))), F.ceil(n / F.lit(FEW_BLOCKS * block_rows)))
    sides = cand.withColumn("_n", blocks).select(
        "id1", "id2", F.pmod(F.xxhash64("id1"), "_n").alias("_x"), F.pmod(F.xxhash64("id2"), "_n").alias("_y"))
    sides = sides.select("id1", "id2", F.least("_x", "_y").alias("_b1"), F.greatest("_x", "_y").alias("_b2"))
    need = sides.select(F.col("_b1").alias("_v1"), F.col("_b2").alias("_v2"), F.explode(F.array("id1", "id2")).alias("id")).distinct()
    return sides, need.join(packed, "id")


def _verified_cosines(packed: DataFrame, cand: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """Cosines of the candidate pairs on their whole vectors, those >= threshold kept."""
    sides, vectors = _block_sides(packed, cand, block_rows)

    def dots(pairs: pd.DataFrame, vecs: pd.DataFrame) -> pd.DataFrame:
        ids = vecs["id"].to_numpy(np.int64)
        order = np.argsort(ids)
        _, h, w, lens = _flat(ids, vecs["h"], vecs["w"])
        first = np.cumsum(lens) - lens
        terms, t = np.unique(h, return_inverse=True)
        pairs = pairs.sort_values("id1", kind="stable")
        a = order[np.searchsorted(ids[order], pairs["id1"].to_numpy(np.int64))]
        b = order[np.searchsorted(ids[order], pairs["id2"].to_numpy(np.int64))]
        dense, out = np.zeros(len(terms)), np.zeros(len(a))
        cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
        for s, e in zip(cuts, np.append(cuts[1:], len(a))):
            mine = slice(first[a[s]], first[a[s]] + lens[a[s]])
            dense[t[mine]] = w[mine]
            n = lens[b[s:e]]
            begin = np.cumsum(n) - n
            at = np.repeat(first[b[s:e]] - begin, n) + np.arange(n.sum())
            out[s:e] = np.add.reduceat(dense[t[at]] * w[at], begin)
            dense[t[mine]] = 0.0
        keep = out >= threshold
        return pd.DataFrame({"id1": pairs["id1"].to_numpy()[keep], "id2": pairs["id2"].to_numpy()[keep], "weight": out[keep]})

    return sides.groupBy("_b1", "_b2").cogroup(vectors.groupBy("_v1", "_v2")).applyInPandas(
        dots, "id1 long, id2 long, weight double")


def ctfidf(doc_counts: DataFrame, assign: DataFrame, group: Sequence[str], doc_key: str = "doc_id",
           topic: str = "topic") -> DataFrame:
    """Class TF-IDF per group: tf(t, c) * ln(1 + A / f(t)).

    ``doc_counts``: doc_key, term, tf; ``assign``: doc_key, group..., topic.
    tf(t, c) = count of t in class c / all counts of c; A = mean count per class in the
    group; f(t) = count of t over all classes of the group. Output: group..., topic, term, weight.
    """
    g = list(group) or ["_g"]
    a = assign if group else assign.withColumn("_g", F.lit(0))
    # written, as it is read four times
    ct = table_of(doc_counts.join(a.select(doc_key, *g, topic), doc_key).groupBy(*g, topic, "term").agg(F.sum("tf").alias("cnt")), "class-terms")
    per_class = ct.groupBy(*g, topic).agg(F.sum("cnt").alias("_cc"))
    per_group = per_class.groupBy(*g).agg(F.avg("_cc").alias("_A"))
    per_term = ct.groupBy(*g, "term").agg(F.sum("cnt").alias("_ft"))
    x = ct.join(per_class, g + [topic]).join(per_group, g).join(per_term, g + ["term"])
    out = x.select(*g, topic, "term",
                   (F.col("cnt") / F.col("_cc") * F.log(F.lit(1.0) + F.col("_A") / F.col("_ft"))).alias("weight"))
    return out if group else out.drop("_g")


def top_terms(weights: DataFrame, keys: Sequence[str], n: int = 10, by_abs: bool = False,
              min_abs: float | None = None) -> DataFrame:
    """The n heaviest terms per key (ties by term): keys..., term, weight, rank."""
    w = weights if min_abs is None else weights.filter(F.abs("weight") >= min_abs)
    o = F.abs(F.col("weight")) if by_abs else F.col("weight")
    win = Window.partitionBy(*keys).orderBy(o.desc(), F.col("term"))
    return w.withColumn("rank", F.row_number().over(win).cast("long")).filter(F.col("rank") <= n)


def terms_wide(top: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """K5: ``term_0, weight_0, ...`` one row per key (pivot on rank; n columns at most)."""
    p = top.groupBy(*keys).pivot("rank", list(range(1, n + 1))).agg(F.first("term").alias("term"), F.first("weight").alias("weight"))
    cols = list(keys)
    for i in range(1, n + 1):
        cols += [F.col(f"{i}_term").alias(f"term_{i - 1}"), F.col(f"{i}_weight").alias(f"weight_{i - 1}")]
    return p.select(*cols)


def topic_names(top: DataFrame, keys: Sequence[str], topic: str = "topic", n_words: int = 4) -> DataFrame:
    """M16 name: ``<id>_<w1>_<w2>_<w3>_<w4>`` from the best terms (bounded collect: n_words)."""
    k = list(keys)
    best = top.filter(F.col("rank") <= n_words).groupBy(*k, topic).agg(
        F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_t"))
    words = F.transform("_t", lambda s: s["term"])
    return best.select(*k, topic, F.concat_ws("_", F.col(topic).cast("string"), F.array_join(words, "_")).alias("name"))


def class_similarity(weights: DataFrame, group: Sequence[str], topic: str = "topic") -> DataFrame:
    """Cosine between class term vectors of a group (join on term; classes are few)."""
    g = list(group)
    norm = weights.groupBy(*g, topic).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_n"))
    u = weights.join(norm, g + [topic]).select(*g, topic, "term", (F.col("weight") / F.col("_n")).alias("u"))
    a = u.select(*g, F.col(topic).alias("topic1"), "term", F.col("u").alias("ua"))
    b = u.select(*g, F.col(topic).alias("topic2"), "term", F.col("u").alias("ub"))
    return a.join(b, g + ["term"]).groupBy(*g, "topic1", "topic2").agg(F.sum(F.col("ua") * F.col("ub")).alias("similarity"))


def most_similar_one(vecs: DataFrame, query_counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """K8: the best document for one query text: the query's TF-IDF vector (same idf as the
    corpus) against every document, by a join on term; ties -> smallest id. Output: key, similarity.

    ``vecs``: key, term, df, n_docs, w; ``query_counts``: term, tf.
    """
    # the vectors are computed once; only their entries for terms of the query are kept
    weight = F.col("tf") * (F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + 1)
    hits = table_of(vecs.join(query_counts, "term").select(key, "term", "w", weight.alias("_q")), "query-terms")
    q = hits.select("term", "_q").distinct()
    qn = q.agg(F.sqrt(F.sum(F.col("_q") * F.col("_q")))).scalar()
    sims = hits.groupBy(key).agg((F.sum(F.col("w") * F.col("_q")) / qn).alias("similarity"))
    return sims.orderBy(F.col("similarity").desc(), F.col(key)).limit(1)
