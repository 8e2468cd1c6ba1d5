"""Topic models as Spark jobs.

The reference's black-box topic model (embed -> reduce -> density clusters -> c-TF-IDF) is
rebuilt with the same contract: topic ids 0, 1, 2... by falling size, -1 for outliers,
``min_topic_size``, names, terms, similarities and per-document probabilities. The
clusterer is a density-graph one (cosine edges >= t, connected components, small ones -> -1),
not HDBSCAN: labels are not claimed equal to the reference's.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import vec
from newsloom.operators import factors
from newsloom.operators import vectors as V
from newsloom.session import ensure_checkpoint_dir, table_of


def connected_components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = (), node: str = "doc_id",
                         max_rounds: int = 1000) -> DataFrame:
    """Component label (smallest member id) per node: keys..., node, comp.

    Each round takes the least label among the neighbours and then the label of that label (pointer jumping), so
    the number of rounds grows with the logarithm of the longest path. A round is two joins and one aggregation,
    written to the cluster's checkpoint folder (lineage cut, survives executor loss; a checkpoint would keep the plan's
    size estimates, which the joins square in every round); one aggregated change count decides whether to go on. Raises if the search does not end.
    """
    k = list(keys)
    und = edges.select(*k, F.col("id1").alias("a"), F.col("id2").alias("b")).unionByName(
        edges.select(*k, F.col("id2").alias("a"), F.col("id1").alias("b")))
    und = table_of(und, "components")
    labels = table_of(nodes.select(*k, F.col(node).alias("n"), F.col(node).alias("comp")), "components")
    for _ in range(max_rounds):
        low = und.join(labels.withColumnRenamed("n", "a"), k + ["a"]).groupBy(*k, F.col("b").alias("n")).agg(
            F.min("comp").alias("_m"))
        # a neighbour's smaller label is also offered to the node that names the own component
        offer = labels.join(low, k + ["n"]).filter(F.col("_m") < F.col("comp"))
        offer = offer.select(*k, "n", "_m").unionByName(offer.select(*k, F.col("comp").alias("n"), "_m"))
        offer = offer.groupBy(*k, "n").agg(F.min("_m").alias("_m"))
        new = labels.join(offer, k + ["n"], "left").select(
            *k, "n", F.least("comp", F.coalesce("_m", "comp")).alias("_c"), F.col("comp").alias("_old"))
        jump = new.select(*k, F.col("n").alias("_c"), F.col("_c").alias("_cc"))
        new = new.join(jump, k + ["_c"]).select(*k, "n", F.col("_cc").alias("comp"), (F.col("_cc") < F.col("_old")).alias("_ch"))
        new = table_of(new, "components")
        labels = new.drop("_ch")
        if new.filter("_ch").isEmpty():
            return labels.withColumnRenamed("n", node)
    raise RuntimeError("component search did not end")


def relabel_by_size(comp: DataFrame, keys: Sequence[str], node: str, min_topic_size: int,
                    comp_col: str = "comp") -> DataFrame:
    """Clusters of at least ``min_topic_size`` members become topics 0, 1, ... by (size desc,
    cluster id); the rest -1. Adds ``topic``."""
    k = list(keys)
    sizes = comp.groupBy(*k, comp_col).agg(F.count(F.lit(1)).alias("_sz"))
    kept = sizes.filter(F.col("_sz") >= min_topic_size)
    if k:
        big = kept.withColumn(
            "topic", (F.row_number().over(Window.partitionBy(*k).orderBy(F.col("_sz").desc(), F.col(comp_col))) - 1).cast("int"))
    else:
        # no key: positions from a distributed sort, not a one-task window
        from newsloom.operators.ordering import global_position

        big = global_position(kept.withColumn("_nsz", -F.col("_sz")), ["_nsz", comp_col], "_pos").withColumn(
            "topic", F.col("_pos").cast("int")).drop("_nsz", "_pos")
    return comp.join(big.select(*k, comp_col, "topic"), k + [comp_col], "left").withColumn(
        "topic", F.coalesce(F.col("topic"), F.lit(-1)))


def density_topics(vectors: DataFrame, threshold: float, min_topic_size: int = 10, keys: Sequence[str] = (),
                   id_col: str = "doc_id", vec_col: str = "v") -> DataFrame:
    """Dense regions as topics: cosine edges >= threshold (blocked product), connected
    components, components below ``min_topic_size`` -> -1, ids by size. keys..., id, comp, topic."""
    k = list(keys)
    edges = V.component_edges(vectors, threshold, id_col, vec_col, k)
    comp = connected_components(vectors.select(*k, id_col), edges, k, id_col)
    return relabel_by_size(comp, k, id_col, min_topic_size)


def centroid_topics(vectors: DataFrame, k: int, min_topic_size: int = 1, id_col: str = "doc_id", vec_col: str = "v",
                    seed: int = 43, keys: Sequence[str] = ()) -> DataFrame:
    """KMeans (seeded) on unit vectors, clusters relabelled by size like M12."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = vec.normalise_df(vectors.select(*keys, id_col, vec_col), vec_col, "_u")
    feats = unit.select(*keys, id_col, array_to_vector("_u").alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="comp").fit(feats)
    comp = model.transform(feats).select(*keys, id_col, "comp")
    return relabel_by_size(comp, list(keys), id_col, min_topic_size)


def membership(docs: DataFrame, keys: Sequence[str], id_col: str = "doc_id", vec_col: str = "v",
               topic: str = "topic") -> DataFrame:
    """Probability per real topic = softmax of the cosine to every topic centroid of the
    key group (topic order): keys..., id, probs (array), long rows via ``probs_long``."""
    k = list(keys)
    real = docs.filter(F.col(topic) != -1)
    cents = V.vector_mean(real, k + [topic], vec_col, "_c")
    # one row per key with its centroids (bounded by the topics), so each document meets one row, not a product
    per_key = cents.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct(topic, "_c"))).alias("_cents"))
    arr = docs.select(*k, id_col, vec_col).join(per_key, k).withColumn(
        "_cs", F.transform("_cents", lambda s: vec.cosine(F.col(vec_col), s["_c"])))
    return arr.select(*k, id_col, vec.softmax(F.col("_cs")).alias("probs"))


def probs_long(probs: DataFrame, keys: Sequence[str], id_col: str = "doc_id") -> DataFrame:
    """Probability arrays as rows: keys..., id, topic, probability."""
    return probs.select(*keys, id_col, F.posexplode("probs").alias("topic", "probability")).withColumn(
        "topic", F.col("topic").cast("int"))


def doc_topic_prob(assign: DataFrame, probs: DataFrame, keys: Sequence[str], id_col: str = "doc_id",
                   topic: str = "topic") -> DataFrame:
    """Document, topic, probability of the assigned topic (0 for -1)."""
    k = list(keys)
    j = assign.select(*k, id_col, topic).join(probs, k + [id_col], "left")
    p = F.when(F.col(topic) == -1, F.lit(0.0)).otherwise(F.element_at("probs", F.col(topic) + 1))
    return j.select(*k, F.col(id_col).alias("document"), topic, p.alias("probability"))


def kth_neighbour(vectors: DataFrame, k: int, id_col: str = "doc_id", vec_col: str = "v",
                  keys: Sequence[str] = ()) -> DataFrame:
    """Cosine of each row's k-th most similar other row (ties by id): keys..., id, kth_sim."""
    top = V.top_partners(vectors, k, id_col, vec_col, keys)
    return top.filter(F.col("rank") == k).select(*keys, "id", F.col("sim").alias("kth_sim"))


def topic_doc_density(assign: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "doc_id",
                      vec_col: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """Topic, document, density = 1 / cosine distance to the k-th neighbour (r6)."""
    kn = kth_neighbour(vectors, k, id_col, vec_col, keys).withColumnRenamed("id", id_col)
    return assign.select(*keys, id_col, "topic").join(kn, list(keys) + [id_col]).select(
        *keys, "topic", F.col(id_col).alias("document"),
        F.round(F.try_divide(F.lit(1.0), F.lit(1.0) - F.col("kth_sim")), 6).alias("density"))


def exemplars(assign: DataFrame, sizes: DataFrame, keys: Sequence[str] = (), id_col: str = "doc_id") -> DataFrame:
    """The documents of each real topic with the highest neighbour count (ties all kept)."""
    k = list(keys)
    j = assign.filter(F.col("topic") != -1).join(sizes, k + [id_col])
    r = F.rank().over(Window.partitionBy(*k, "topic").orderBy(F.col("size").desc()))
    return j.withColumn("_r", r).filter("_r = 1").select(*k, "topic", id_col, "size")


def reduce_topics(docs: DataFrame, n: int, keys: Sequence[str], id_col: str = "doc_id", vec_col: str = "v") -> DataFrame:
    """While a group has more than ``n`` real topics, merge its smallest topic (ties:
    largest id) into its most similar other topic (centroid cosine, ties: smallest id).

    Works on the topic table (one row per topic: size and vector sum), one merge per group
    per round, checkpointed; the merge map reaches the documents by one join. Topics are
    renumbered by size at the end; -1 is never merged. Adds ``topic`` (reduced).
    """
    k = list(keys)
    ensure_checkpoint_dir(docs.sparkSession)
    real = docs.filter(F.col("topic") != -1)
    dims = real.select(*k, "topic", F.posexplode(vec_col).alias("_p", "_x")).groupBy(*k, "topic", "_p").agg(
        F.sum("_x").alias("_s"))
    sums = dims.groupBy(*k, "topic").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "_s"))), lambda s: s["_s"]).alias("vsum"))
    table = real.groupBy(*k, "topic").agg(F.count(F.lit(1)).alias("size")).join(sums, k + ["topic"])
    table = table.withColumn("cur", F.col("topic")).checkpoint(eager=True)
    # mapping original -> current topic
    mapping = table.select(*k, "topic", "cur")
    state = table.select(*k, "cur", "size", "vsum").checkpoint(eager=True)
    # every round takes one topic from each group that has too many, so the loop ends
    while True:
        cnt = state.groupBy(*k).agg(F.count(F.lit(1)).alias("_nt"))
        over = state.join(cnt.filter(F.col("_nt") > n), k)
        if over.limit(1).count() == 0:
            break
        w_small = Window.partitionBy(*k).orderBy(F.col("size"), F.col("cur").desc())
        small = over.withColumn("_r", F.row_number().over(w_small)).filter("_r = 1").select(
            *k, F.col("cur").alias("src"), F.col("vsum").alias("_sv"))
        cand = state.join(small, k).filter(F.col("cur") != F.col("src")).withColumn(
            "_sim", vec.cosine(F.col("vsum"), F.col("_sv")))
        w_best = Window.partitionBy(*k).orderBy(F.col("_sim").desc(), F.col("cur"))
        merge = cand.withColumn("_r", F.row_number().over(w_best)).filter("_r = 1").select(
            *k, "src", F.col("cur").alias("dst"))
        st = state.join(merge, k, "left")
        target = F.when(F.col("cur") == F.col("src"), F.col("dst")).otherwise(F.col("cur"))
        state = st.select(*k, target.alias("cur"), "size", "vsum").groupBy(*k, "cur").agg(
            F.sum("size").alias("size"),
            F.aggregate(F.collect_list("vsum"), F.array_repeat(F.lit(0.0), F.size(F.first("vsum"))),
                        lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b)).alias("vsum"),
        ).checkpoint(eager=True)
        mapping = mapping.join(merge, k, "left").select(
            *k, "topic", F.when(F.col("cur") == F.col("src"), F.col("dst")).otherwise(F.col("cur")).alias("cur")
        ).checkpoint(eager=True)
    final = state.withColumn(
        "_new", (F.row_number().over(Window.partitionBy(*k).orderBy(F.col("size").desc(), F.col("cur"))) - 1).cast("int"))
    m = mapping.join(final.select(*k, "cur", "_new"), k + ["cur"]).select(*k, "topic", "_new")
    return docs.join(m, k + ["topic"], "left").withColumn(
        "topic", F.coalesce(F.col("_new"), F.lit(-1))).drop("_new")


def embed_documents(df: DataFrame, tokens_col: str, dim: int = 64, seed: int = 43, window: int = 5, key: str = "doc_id") -> DataFrame:
    """M11 default encoder: word vectors from the co-occurrence table (``factors.word_vectors``); a document vector =
    mean of its word vectors, every word counted, the zero vector without words. ``key``: integer ids.

    A user encoder instead runs as ``mapInPandas`` (model loaded once per task)."""
    vectors, terms = factors.word_vectors(df, tokens_col, dim, seed, window)
    return factors.document_vectors(df, key, tokens_col, vectors, terms, dim)


def lda_topics(counts: DataFrame, key: str, k: int = 10, seed: int = 43, max_iter: int = 10):
    """M6/M9: variational LDA on term counts in long form (key, term, tf).

    Returns (model, terms, cells, doc_topics) where doc_topics has key, mixture (array, r2), dominant topic.
    Terms are numbered by a Spark table; the topics' weights stay a table too.
    """
    # written once: the terms' numbers and the cells are two passes over the counts
    counts = table_of(counts.select(key, "term", "tf"), "counts")
    terms = factors.number_terms(counts)
    cells = factors.term_cells(counts, key, terms)
    model = factors.fit_lda(cells, terms, k, seed, max_iter)
    mix = factors.lda_documents(model, cells).select(
        F.col("id").alias(key), F.transform("mixture", lambda x: F.round(x, 2)).alias("mixture"),
        (F.array_position("mixture", F.array_max("mixture")) - 1).cast("int").alias("dominant_topic"))
    return model, terms, cells, mix


def nmf(weights: DataFrame, key: str, k: int = 10, seed: int = 43, reg: float = 0.1, max_iter: int = 10):
    """M5 (re-aimed): non-negative factors of the document-term matrix by non-negative ALS.

    ``weights``: key (int-able), term, w. Returns (doc_factors, term_factors) with arrays.
    """
    from pyspark.ml.recommendation import ALS

    terms = weights.select("term").distinct().withColumn("_tid", F.xxhash64("term").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    x = weights.join(terms, "term").select(F.col(key).cast("int").alias("_d"), "_tid", F.col("w").cast("float").alias("_w"))
    als = ALS(rank=k, maxIter=max_iter, regParam=reg, nonnegative=True, implicitPrefs=False, seed=seed,
              userCol="_d", itemCol="_tid", ratingCol="_w", coldStartStrategy="drop")
    m = als.fit(x)
    docs = m.userFactors.select(F.col("id").cast("long").alias(key), F.col("features").alias("factors"))
    tf = m.itemFactors.join(terms, m.itemFactors.id == terms._tid).select("term", F.col("features").alias("factors"))
    return docs, tf


def find_topics(topic_terms: DataFrame, query_terms: DataFrame, keys: Sequence[str], n: int = 5,
                min_sim: float = 0.7) -> DataFrame:
    """Topics closest to a search term: cosine between the query's term vector and each
    topic's term weights (join on term), the best n per key, stopping below ``min_sim``.

    ``topic_terms``: keys..., topic, term, weight; ``query_terms``: query, term, weight.
    """
    k = list(keys)
    tn = topic_terms.groupBy(*k, "topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_tn"))
    qn = query_terms.groupBy("query").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_qn"))
    dots = topic_terms.join(query_terms.withColumnRenamed("weight", "_qw"), "term").groupBy(*k, "topic", "query").agg(
        F.sum(F.col("weight") * F.col("_qw")).alias("_d"))
    sim = dots.join(tn, k + ["topic"]).join(qn, "query").select(
        *k, "query", "topic", (F.col("_d") / (F.col("_tn") * F.col("_qn"))).alias("similarity"))
    w = Window.partitionBy(*k, "query").orderBy(F.col("similarity").desc(), F.col("topic"))
    return sim.withColumn("rank", F.row_number().over(w).cast("long")).filter(
        (F.col("rank") <= n) & (F.col("similarity") >= min_sim))


def term_topic_history(found: DataFrame, assign: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M19 over all models (keys) + first/last month and size of every found topic,
    sorted by query and start."""
    k = list(keys)
    ym = F.struct("year", "month")
    rng = assign.groupBy(*k, "topic").agg(F.min(ym).alias("_a"), F.max(ym).alias("_b"), F.count(F.lit(1)).alias("topic_docs"))
    h = found.join(rng, k + ["topic"]).select(
        *k, "query", "topic", "similarity", "topic_docs",
        F.col("_a.year").alias("topic_start_year"), F.col("_a.month").alias("topic_start_month"),
        F.col("_b.year").alias("topic_end_year"), F.col("_b.month").alias("topic_end_month"))
    return h.orderBy("query", "topic_start_year", "topic_start_month")


def recluster_outliers(vectors: DataFrame, threshold: float, min_topic_size: int, step: float = 0.05,
                       min_left: int = 15, lowest: float = 0.0, id_col: str = "doc_id", vec_col: str = "v") -> DataFrame:
    """Cluster, then cluster the -1 documents again with a looser threshold, round by
    round, until at most ``min_left`` outliers remain or the threshold falls below ``lowest``
    (where unrelated vectors would be joined).

    Output: id, round (when the topic was found; -1 never), topic (numbered on over the
    rounds, -1 for the rest). Each round's input is checkpointed.
    """
    ensure_checkpoint_dir(vectors.sparkSession)
    todo = vectors.select(id_col, vec_col).checkpoint(eager=True)
    found, r, used = None, 0, 0
    while threshold - r * step >= lowest and todo.count() > min_left:
        t = density_topics(todo, threshold - r * step, min_topic_size, id_col=id_col, vec_col=vec_col)
        got = t.filter(F.col("topic") != -1).select(id_col, F.lit(r).alias("round"), (F.lit(used) + F.col("topic")).alias("topic"))
        got = got.checkpoint(eager=True)
        last = got.agg(F.max("topic")).first()[0]
        used = used if last is None else last + 1
        found = got if found is None else found.unionByName(got)
        todo = todo.join(got.select(id_col), id_col, "left_anti").checkpoint(eager=True)
        r += 1
    allids = vectors.select(id_col)
    if found is None:
        return allids.select(id_col, F.lit(-1).alias("round"), F.lit(-1).alias("topic"))
    return allids.join(found, id_col, "left").select(
        id_col, F.coalesce("round", F.lit(-1)).alias("round"), F.coalesce("topic", F.lit(-1)).alias("topic"))


def lda_grid(counts: DataFrame, key: str, ks=(3, 5), decays=(0.5, 0.7), seed: int = 43, max_iter: int = 5,
             folds: int = 3) -> DataFrame:
    """M7: LDA for every (k, learning decay) of a grid, scored on held-out documents: the documents fall into
    ``folds`` by a hash of their key, a model trained on the others scores each fold, and the folds' log-likelihoods
    are averaged; perplexity is that of all folds' tokens. One row per setting, best first. Terms that occur in a
    held-out fold alone have the prior's weight."""
    from functools import reduce

    counts = table_of(counts.select(key, "term", "tf"), "counts")
    fold = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds))
    terms = factors.number_terms(counts)
    split = [(factors.term_cells(counts.filter(fold != i), key, terms), factors.term_cells(counts.filter(fold == i), key, terms))
             for i in range(folds)]
    scored = []
    for k in ks:
        for d in decays:
            for train, test in split:
                model = factors.fit_lda(train, terms, k, seed, max_iter, decay=d)
                tokens = test.cells.agg(F.coalesce(F.sum("w"), F.lit(0.0))).scalar()
                scored.append(factors.lda_quality(model, test).select(
                    F.lit(k).alias("k"), F.lit(float(d)).alias("learning_decay"), "log_likelihood", tokens.alias("_tokens")))
    every = reduce(DataFrame.unionByName, scored).groupBy("k", "learning_decay").agg(
        F.avg("log_likelihood").alias("log_likelihood"),
        (-F.sum("log_likelihood") / F.nullif(F.sum("_tokens"), F.lit(0.0))).alias("log_perplexity"))
    return every.orderBy(F.col("log_likelihood").desc(), "k", "learning_decay")


def lda_keywords(model, terms: DataFrame, spark, n: int = 20) -> DataFrame:
    """Best n words per topic: topic, rank, weight, term."""
    return factors.lda_terms(model, n)


def encode_with(df: DataFrame, encoder_factory, text_col: str, schema: str, batch_rows: int = 256) -> DataFrame:
    """Y2/Y3 hook: run a user model over Arrow batches. ``encoder_factory()`` is called once
    per task (model loaded once), then ``model(pandas.DataFrame) -> pandas.DataFrame``."""

    def run(batches):
        model = encoder_factory()
        for pdf in batches:
            for s in range(0, len(pdf), batch_rows):
                yield model(pdf.iloc[s:s + batch_rows])

    return df.mapInPandas(run, schema)


def apply_per_group(df: DataFrame, keys: Sequence[str], fn, schema: str) -> DataFrame:
    """Y4 hook: a user's own function per group (e.g. per month) with ``applyInPandas``.
    Built-in operators are keyed instead; this is for functions Spark cannot express."""
    return df.groupBy(*keys).applyInPandas(fn, schema)
