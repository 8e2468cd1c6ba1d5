"""N-gram Jaccard join by prefixes under several global token orders.

A document is the set of its distinct word n-grams. Two sets with Jaccard similarity of at least t share a
token among the first ``n - ceil(t n) + 1`` tokens of each, whatever the global order of the tokens is; so a
pair is verified only if it passes that test under every one of several orders.

1. Documents with equal sets become one class (a 64-bit fingerprint of the set).
2. A packed inverted index finds the tokens that two classes share. All orders put unshared tokens first, which
   shortens every prefix by their number and ends the search for a class with fewer than ``ceil(t n)`` shared tokens.
3. The classes left are joined on the prefix tokens of the first order. Long posting lists never become all pairs:
   each list pairs its classes with a few pivots of other components, links found merge components, and rounds with
   more pivots go on until each list lies in one component or all its pairs are tested.
4. Candidate pairs must share a prefix token under each other order as well; the rest is verified on the whole sets.
"""

from __future__ import annotations

import math
import re
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.base import bounded_batches, components, lean, query, saved, table
from newsloom.llm.decontaminate import text_hash
from newsloom.llm.words import mix, ngram_hash, sequence_hash, signed, words_of

#: Bits of a token in the index; a doubly used value could only count one more common token in one pair.
TOKEN_BITS = 56
FLUSH_TOKENS, FLUSH_DOCS = 750_000, 60_000
#: Postings of a bucket that are compared at a time.
RANGE_TOKENS = 1 << 18
NO_DOC = 0xFFFF
#: Least count of a frequent token, and how many of them may be broadcast (16 bytes each).
FREQUENT, MAX_FREQUENT = 32, 1_000_000
#: Factors that give the token orders, as signed 64-bit odd numbers.
ORDERS = (0x1B873593CC9E2D51, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)


def shingle_sets(col: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of every row; a row of fewer than ``k`` words is one sequence."""
    for w in words_of(col):
        grams = ngram_hash(w.hash, k)
        for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
            if b - a >= k:
                tokens = np.unique(grams[a:b - k + 1])
            else:
                tokens = np.array([sequence_hash(w.hash[a:b])] if b > a else [], np.uint64)
            yield w.rows.start + i, tokens


def fingerprint(tokens: np.ndarray) -> int:
    if not len(tokens):
        return 0
    return int(signed(mix(np.array([mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)))[0])


def set_classes(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, th, n_shingles, cls``: documents with equal sets have the same class; th is the text's hash."""

    @lean
    def run(batches):
        for batch in batches:
            n, cls = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, tokens in shingle_sets(batch.column("text"), k):
                n[i], cls[i] = len(tokens), fingerprint(tokens)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n), pa.array(cls)],
                                             names=["doc_id", "th", "n_shingles", "cls"])

    return docs.select("doc_id", text_hash().alias("th"), "text").mapInArrow(run, "doc_id long, th long, n_shingles long, cls long")


def _pack(tokens: np.ndarray, refs: np.ndarray, base: int = 0) -> list:
    """Sorted tokens as deltas, byte plane by byte plane, and the documents they belong to."""
    if not len(tokens):
        return [0, b"", b""]
    delta = np.diff(tokens, prepend=np.uint64(base))
    width = max(1, (int(delta.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return [width, planes.tobytes(), refs.astype(np.uint16).tobytes()]


def _unpack(width: int, deltas: bytes, refs: bytes, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    ref = np.frombuffer(refs, np.uint16)
    wide = np.zeros((len(ref), 8), np.uint8)
    if width:
        wide[:, :width] = np.frombuffer(deltas, np.uint8).reshape(width, -1).T
    return np.cumsum(wide.reshape(-1).view(np.uint64), dtype=np.uint64) + np.uint64(base), ref


def _step(buckets: int) -> int:
    return -(-(1 << TOKEN_BITS) // buckets)


BLOB = "bucket int, cls binary, n binary, open_width int, open binary, open_ref binary, known_width int, known binary, known_ref binary"
_BLOB_TYPES = pa.schema([("bucket", pa.int32()), ("cls", pa.binary()), ("n", pa.binary()), ("open_width", pa.int32()), ("open", pa.binary()),
                         ("open_ref", pa.binary()), ("known_width", pa.int32()), ("known", pa.binary()), ("known_ref", pa.binary())])


def _blobs(cls: list, sets: list, buckets: int) -> Iterator[pa.RecordBatch]:
    """The postings of some documents, one row for each bucket of tokens.

    A token of several documents here is known to be shared: its postings travel by (token, document), so that no
    bucket gets all documents of a frequent token, and a single mark tells the token's own bucket.
    """
    cls_of, n_of = np.array(cls, np.int64), np.array([len(s) for s in sets], np.int32)
    token = np.concatenate(sets) >> np.uint64(64 - TOKEN_BITS)
    ref = np.repeat(np.arange(len(sets), dtype=np.uint16), n_of)
    order = np.argsort(token, kind="stable")
    token, ref = token[order], ref[order]
    new = np.r_[True, token[1:] != token[:-1]]
    alone = new & np.r_[new[1:], True]
    open_token = token[new]
    open_ref = np.where(alone, ref, NO_DOC)[new]
    step = _step(buckets)
    cut = np.searchsorted(open_token, np.arange(buckets + 1, dtype=np.uint64) * np.uint64(step))
    cut[-1] = len(open_token)
    known, known_ref = token[~alone], ref[~alone]
    to = (mix(known ^ cls_of.view(np.uint64)[known_ref]) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    known, known_ref = known[by], known_ref[by]
    known_cut = np.searchsorted(to[by], np.arange(buckets + 1))
    rows = []
    for b in range(buckets):
        t, r = open_token[cut[b]:cut[b + 1]], open_ref[cut[b]:cut[b + 1]]
        kt, kr = known[known_cut[b]:known_cut[b + 1]], known_ref[known_cut[b]:known_cut[b + 1]]
        if not len(t) and not len(kt):
            continue
        present = np.unique(np.concatenate([r[r != NO_DOC], kr]))
        local = np.full(1 << 16, NO_DOC, np.uint16)
        local[present] = np.arange(len(present))
        rows.append([b, cls_of[present].tobytes(), n_of[present].tobytes(), *_pack(t, local[r], b * step), *_pack(kt, local[kr])])
        if len(rows) == 16:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOB_TYPES)], schema=_BLOB_TYPES)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOB_TYPES)], schema=_BLOB_TYPES)


_SHARED_TYPES = pa.schema([("cls", pa.int64()), ("n", pa.int32()), ("token", pa.int64())])


def _shared_in_bucket(blobs: list[dict], step: int) -> Iterator[pa.RecordBatch]:
    """Of one bucket: a row for each class and token that another class has too, a range of tokens at a time."""
    parts = {"open": [], "known": []}
    while blobs:
        row = blobs.pop()
        c, m = np.frombuffer(row["cls"], np.int64), np.frombuffer(row["n"], np.int32)
        for kind, part in parts.items():
            t, r = _unpack(row[f"{kind}_width"], row[kind], row[f"{kind}_ref"], row["bucket"] * step if kind == "open" else 0)
            if kind == "known":  # sorted by document so far
                order = np.argsort(t, kind="stable")
                t, r = t[order], r[order]
            if len(t):
                part.append((t, r.copy(), c, m))
    for kind, part in parts.items():
        if not part:
            continue
        low, high = min(int(t[0]) for t, *_ in part), max(int(t[-1]) for t, *_ in part)
        ranges = max(1, sum(len(t) for t, *_ in part) // RANGE_TOKENS)
        edges = [low + (high + 1 - low) * i // ranges for i in range(1, ranges)]
        cuts = [np.r_[0, np.searchsorted(t, np.array(edges, np.uint64)), len(t)] for t, *_ in part]
        for i in range(ranges):
            token, cls, n = [], [], []
            for (t, r, c, m), cut in zip(part, cuts):
                t, r = t[cut[i]:cut[i + 1]], r[cut[i]:cut[i + 1]]
                mark = r == NO_DOC
                at = np.where(mark, 0, r)
                token.append(t)
                cls.append(np.where(mark, 0, c[at]) if len(c) else np.zeros(len(t), np.int64))
                n.append(np.where(mark, 0, m[at]) if len(m) else np.zeros(len(t), np.int32))
            t, c, m = map(np.concatenate, (token, cls, n))
            del token, cls, n
            order = np.lexsort((m, c, t))
            t, c, m = t[order], c[order], m[order]
            once = np.r_[True, (t[1:] != t[:-1]) | (c[1:] != c[:-1]) | ((m[1:] > 0) != (m[:-1] > 0))] if len(t) else np.zeros(0, bool)
            t, c, m = t[once], c[once], m[once]
            if kind == "open":  # the marks and open postings of a token decide; known postings need no decision
                same = t[1:] == t[:-1]
                keep = (np.r_[False, same] | np.r_[same, False] if len(t) else np.zeros(0, bool)) & (m > 0)
                t, c, m = t[keep], c[keep], m[keep]
            if len(t):
                order = np.argsort(c, kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array(c[order]), pa.array(m[order], pa.int32()), pa.array(signed(t[order]))], schema=_SHARED_TYPES)


def shared_tokens(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """``cls, n, token``: for each class its tokens that some other class has, a row each: their number doesn't depend on the number of buckets."""

    @lean
    def run(batches):
        cls, sets, total, seen = [], [], 0, set()
        for batch in batches:
            for _, tokens in shingle_sets(batch.column("text"), k):
                if not len(tokens) or (c := fingerprint(tokens)) in seen:
                    continue
                seen.add(c)
                cls.append(c)
                sets.append(tokens)
                total += len(tokens)
                if total >= FLUSH_TOKENS or len(sets) >= FLUSH_DOCS:
                    yield from _blobs(cls, sets, buckets)
                    cls, sets, total, seen = [], [], 0, set()
        if sets:
            yield from _blobs(cls, sets, buckets)

    blobs = docs.select("text").mapInArrow(run, BLOB)
    step = _step(buckets)

    def of_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from lean(_shared_in_bucket)([row for batch in batches for row in batch.to_pylist()], step)

    return blobs.groupBy("bucket").applyInArrow(of_bucket, "cls long, n int, token long")


def bucket_count(docs: DataFrame) -> int:
    """Buckets of the index: about one for every 8 MB read, so that a bucket's postings fit in a task."""
    spark = docs.sparkSession
    size, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    split = int(size) << 10 * "kmgt".find(unit or "-") + 10
    parts = docs.rdd.getNumPartitions()
    return max(2 * spark.sparkContext.defaultParallelism, math.ceil(parts * split / (8 << 20)))


def _need(t_percent: int) -> str:
    """Shared tokens that a class of n tokens needs for a link: ceil(t n)."""
    return f"((n * {t_percent} + 99) div 100)"


def _common(a: str, b: str, t_percent: int) -> str:
    """Common tokens that a link between sets of a and b tokens needs: ceil(t (a + b) / (1 + t))."""
    return f"(({t_percent} * ({a} + {b}) + {99 + t_percent}) div {100 + t_percent})"


def live_classes(docs: DataFrame, k: int, t_percent: int) -> DataFrame:
    """``cls, n, tokens, q``: classes that can have a link, their shared tokens and the length of their prefixes."""
    parts = shared_tokens(docs, k, bucket_count(docs))
    live = parts.groupBy("cls", "n").agg(F.array_distinct(F.collect_list("token")).alias("tokens"))
    return live.withColumn("q", F.expr(f"size(tokens) - {_need(t_percent)} + 1")).where("q > 0")


def frequent_tokens(live: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of many classes and the number of those: all from the lowest power of two on that leaves at most MAX_FREQUENT."""
    count = live.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    count = saved(count.where(f"df >= {FREQUENT}").withColumn("size", F.floor(F.log2("df")).cast("int")))
    total, least = 0, 63
    for size, n in sorted(((r.size, r.n) for r in count.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        total += n
        if total > MAX_FREQUENT:
            break
        least = size
    rows = count.where(F.col("size") >= least).select("token", "df").toArrow()
    token, df = np.asarray(rows["token"]).view(np.uint64), np.asarray(rows["df"])
    order = np.argsort(token)
    return token[order], df[order]


def prefixes(live: DataFrame) -> DataFrame:
    """``cls, n, s, p0, p1, p2``: number of shared tokens of each class and its prefix under each order.

    The first two orders put frequent tokens last (by their counts among the live classes) and break ties by different hashes, the
    third is a hash alone.
    """
    frequent = live.sparkSession.sparkContext.broadcast(frequent_tokens(live))

    @lean
    def run(batches):
        token, df = frequent.value
        for batch in batches:
            lists = batch.column("tokens")
            value = np.asarray(lists.flatten()).view(np.uint64)
            off = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            weight = np.zeros(len(value), np.int64)
            if len(token):
                at = np.minimum(np.searchsorted(token, value), len(token) - 1)
                weight = np.where(token[at] == value, df[at], 0)
            cols = [batch.column("cls"), batch.column("n"), pa.array(np.diff(off), pa.int32())]
            for i, f in enumerate(ORDERS):
                key, out = mix(value * np.uint64(f)), []
                for a, b, q in zip(off[:-1].tolist(), off[1:].tolist(), batch.column("q").to_pylist()):
                    order = np.lexsort((key[a:b], weight[a:b])) if i < 2 else np.argsort(key[a:b])
                    out.append(signed(value[a:b][order[:q]]))
                cols.append(pa.array(out, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=["cls", "n", "s", "p0", "p1", "p2"])

    return live.mapInArrow(run, "cls long, n int, s int, p0 array<long>, p1 array<long>, p2 array<long>")


def verified(pairs: DataFrame, live: DataFrame, prefix: DataFrame, t_percent: int) -> DataFrame:
    """Of candidate pairs ``a, b``: those that pass the prefix test of every order and then the exact one.

    Behind the prefix of the longer class lie ``ceil(t n) - 1`` tokens; what a link needs beyond them must be common to both prefixes.
    """
    side = lambda x: prefix.select(F.col("cls").alias(x), F.struct("n", "p0", "p1", "p2").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    need = f"{_common('s_a.n', 's_b.n', t_percent)} - ((greatest(s_a.n, s_b.n) * {t_percent} + 99) div 100) + 1"
    for p in ("p0", "p1", "p2"):
        both = both.where(F.size(F.array_intersect(f"s_a.{p}", f"s_b.{p}")) >= F.greatest(F.lit(1), F.expr(need)))
    both = both.select("a", "b")
    whole = lambda x: live.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    both = both.join(whole("a"), "a").join(whole("b"), "b").withColumn("i", F.size(F.array_intersect("t_a", "t_b")))
    return both.where(f"100 * i >= {t_percent} * (n_a + n_b - i)").select("a", "b")


def linked_classes(live: DataFrame, t_percent: int) -> DataFrame:
    """``cls, root``: the component of every class that is left for the search."""
    prefix = saved(prefixes(live))
    label = prefix.select("cls", F.col("cls").alias("root"))
    # the class with the longest prefix for its size has the fewest tokens of its own: it is the nearest to all others
    rank = (F.size("p0") / F.col("n")).alias("rank")
    # rest: the shared tokens from this one on
    postings = prefix.select("cls", "n", "s", rank, F.posexplode("p0").alias("at", "token")).withColumn("rest", F.col("s") - F.col("at")).drop("s", "at")
    pivots = 1
    while True:
        lists = postings.join(label, "cls") if pivots > 1 else postings.withColumn("root", F.col("cls"))
        open_list = lists.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
        lists = saved(lists.join(open_list, "token"))
        if lists.isEmpty():
            return label
        part = F.pmod(F.xxhash64("cls"), F.lit(pivots))
        pivot = lists.groupBy("token", part.alias("part")).agg(F.max_by(F.struct("cls", "n", "rest", "root"), F.struct("rank", "cls")).alias("p"))
        pivot = saved(pivot.select("token", F.col("p.cls").alias("pivot"), F.col("p.n").alias("n_p"), F.col("p.rest").alias("rest_p"), F.col("p.root").alias("root_p")))
        # all common tokens of a link lie from its first one on, in both classes, and there must be enough of them
        near = lists.join(pivot, "token").where(f"root <> root_p AND least(rest, rest_p) >= {_common('n', 'n_p', t_percent)}")
        near = near.select(F.least("pivot", "cls").alias("a"), F.greatest("pivot", "cls").alias("b"), "pivot", "cls")
        pairs = saved(near.groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits"), F.min("cls").alias("cls"), F.min("pivot").alias("pivot")))
        steps = [pairs]
        if pivots == 1:
            # the partner with most common tokens first: it mostly settles the component, and the rest needn't be verified
            best = pairs.groupBy("cls").agg(F.max_by(F.struct("a", "b"), F.struct("hits", "a", "b")).alias("p")).select("p.a", "p.b")
            steps = [best.distinct(), pairs]
        for step in steps:
            named = step.select("a", "b")
            for x in ("a", "b"):
                named = named.join(label.select(F.col("cls").alias(x), F.col("root").alias(f"r{x}")), x)
            links = saved(verified(named.where("ra <> rb").select("a", "b"), live, prefix, t_percent))
            if links.isEmpty():
                continue
            edges = links
            for x in ("a", "b"):
                edges = edges.join(label.select(F.col("cls").alias(x), F.col("root").alias(f"r{x}")), x)
            moved = components(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("to"))
            label = saved(label.join(moved, "root", "left").select("cls", F.coalesce("to", "root").alias("root")))
        postings = lists.join(pivot.select("token", F.col("pivot").alias("cls")), ["token", "cls"], "left_anti").select("cls", "n", "rest", "rank", "token")
        pivots *= 64


def _members(docs: DataFrame, k: int, t_percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their classes, and ``cls, root`` of the classes that can have a link."""
    bounded_batches(docs.sparkSession)
    member = saved(set_classes(docs, k))
    return member, linked_classes(saved(live_classes(docs, k, t_percent)), t_percent)


def row_components(docs: DataFrame, k: int = 5, t_percent: int = 80) -> DataFrame:
    """``doc_id, th, root`` of every row with a shingle: root names the component of its text, whatever the doc_ids; th is the text's hash."""
    member, label = _members(docs, k, t_percent)
    return member.where("n_shingles > 0").join(label, "cls", "left").select("doc_id", "th", F.coalesce("root", "cls").alias("root"))


def ngram_jaccard_join(docs: DataFrame, k: int = 5, t_percent: int = 80) -> DataFrame:
    """Near-duplicate groups of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id``, a row for each input row.

    Words are runs of other characters than ASCII blanks, lower-cased in A-Z; the set of a document holds its distinct
    ``k``-word shingles (with fewer words, the whole sequence as one). Documents with similarity of at least
    ``t_percent`` in a hundred are linked; component_id is the smallest doc_id that links reach. A null or empty text has no
    shingle, no link and its own doc_id. Rows that repeat a doc_id or a text are rows of their own with equal results;
    a null doc_id can be a member but names a component only if all others there are null too. Other columns are
    ignored; an empty table gives an empty result.
    """
    member, label = _members(docs, k, t_percent)
    grouped = member.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("low"))
    grouped = grouped.join(label, "cls", "left").select("cls", "low", F.coalesce("root", "cls").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    named = grouped.join(lowest, "root").select("cls", "component_id")
    full = member.where("n_shingles > 0").join(named, "cls", "left").select("doc_id", "n_shingles", "component_id")
    return full.union(member.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


@query("op1_ngram_jaccard_join")
def op1(spark, sf_dir):
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))
