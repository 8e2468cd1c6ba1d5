"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

Counts, continuation counts and context sums of all trusted documents of the training half are grouped and joined in Spark. The
logarithm of a probability is a sum of one value for each word, pair and triple: the model is a table of such values by n-gram hash. It
stays in the shared folder, is dealt by ranges of hashes and meets the n-grams of all documents there, so no task holds all of it.
A document is rejected when its perplexity is above a quantile of the trusted documents of its language that weren't trained on.
"""

from __future__ import annotations

import uuid
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.base import bounded_batches, lean, query, saved, shared_folder, table
from newsloom.llm.decontaminate import text_hash
from newsloom.llm.words import _STEP, mix, signed, words_of

#: Share of trusted documents of a language that lie below its threshold.
QUANTILE = 0.99
START = np.uint64(0x51A2C3D4E5F60718)
#: Values of the model are whole multiples of 1 / UNIT, so sums don't depend on their order.
UNIT = 1 << 24
#: Words that a task packs at a time, bytes of text for each range of hashes, and the mark of a document's last word and pair.
PACK_WORDS, RANGE_BYTES, LAST = 1 << 20, 32 << 20, np.uint16(1 << 15)


def _before(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes two and one before each word; documents begin with START, START."""
    b = np.full(len(hashes), START, np.uint64)
    a = b.copy()
    b[1:] = hashes[:-1]
    a[2:] = hashes[:-2]
    head = first[:-1][np.diff(first) > 0]
    b[head] = START
    a[head] = START
    a[first[:-1][np.diff(first) > 1] + 1] = START
    return a, b


def _pair(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(b * _STEP[0] + c * _STEP[1] + np.uint64(2))


def _triple(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(a * _STEP[0] + b * _STEP[1] + c * _STEP[2] + np.uint64(3))


def ngram_rows(docs: DataFrame) -> DataFrame:
    """``a, b, c``: a row for each word of ``docs(text)``, with the hashes of the two before it."""

    @lean
    def run(batches):
        for batch in batches:
            for w in words_of(batch.column("text")):
                a, b = _before(w.hash, w.first)
                yield pa.RecordBatch.from_arrays([pa.array(signed(x)) for x in (a, b, w.hash)], names=["a", "b", "c"])

    return docs.select("text").mapInArrow(run, "a long, b long, c long")


def discounts(counts: DataFrame, n: str) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the numbers of n-grams with counts 1 to 4."""
    seen = {r[0]: r[1] for r in counts.where(F.col(n) <= 4).groupBy(n).count().collect()}
    n1, n2, n3, n4 = (seen.get(i, 0) for i in (1, 2, 3, 4))
    if not n1:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))


def _discount(n: str, d: tuple[float, float, float]):
    return F.when(F.col(n) == 1, d[0]).when(F.col(n) == 2, d[1]).otherwise(d[2])


def _contexts(counts: DataFrame, keys: list[str], d: tuple[float, float, float]) -> DataFrame:
    """``keys..., total, gamma``: sum of the counts of a context and the weight of its lower order."""
    return counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(_discount("n", d)).alias("left")).select(*keys, "total", (F.col("left") / F.col("total")).alias("gamma"))


def _units(c):
    return F.round(F.coalesce(c, F.lit(0.0)) * UNIT).cast("int")


def _keyed(df: DataFrame, hashed) -> DataFrame:
    """``k, v, g`` of ``df(words..., v, g)``: the words' hashes become the n-gram's."""
    words = df.columns[:-2]

    @lean
    def run(batches):
        for batch in batches:
            k = hashed(*(np.asarray(batch.column(w)).view(np.uint64) for w in words))
            yield pa.RecordBatch.from_arrays([pa.array(signed(k)), batch.column("v"), batch.column("g")], names=["k", "v", "g"])

    return df.mapInArrow(run, "k long, v int, g int")


def train(trusted: DataFrame) -> dict:
    """The model of all rows of ``trusted(text)``: ``path`` of its table ``k, v, g`` in the shared folder, ``unknown`` and ``start``.

    log p(c | a, b) is ``unknown`` plus v of the word c, the pair (b, c) and the triple (a, b, c) plus g of the contexts b and (a, b); n-grams
    that aren't in the table add nothing. v is the logarithm of an n-gram's probability less those of its lower order and its
    context's weight, g is the logarithm of that weight, both in 1 / UNIT. ``start``: g of the contexts before a document's first word.
    """
    spark = trusted.sparkSession
    c3 = saved(ngram_rows(trusted).groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n")))
    c2 = saved(c3.groupBy("b", "c").agg(F.count(F.lit(1)).alias("n")))
    c1 = saved(c2.groupBy("c").agg(F.count(F.lit(1)).alias("n")))
    d3, d2, d1 = (discounts(c, "n") for c in (c3, c2, c1))
    total, kinds, left = c1.agg(F.sum("n"), F.count(F.lit(1)), F.sum(_discount("n", d1))).first()
    total, left = total or 1, left or 1.0
    unknown = float(left) / total / (kinds + 1)
    x2, x3 = _contexts(c2, ["b"], d2), saved(_contexts(c3, ["a", "b"], d3))
    p1 = c1.select("c", ((F.col("n") - _discount("n", d1)) / F.lit(total) + F.lit(unknown)).alias("p1"))
    # above the lower order: p / (gamma * lower) is 1 + more / lower
    more = lambda d: (F.col("n") - _discount("n", d)) / F.col("total") / F.col("gamma")
    pairs = c2.join(x2, "b").join(p1, "c")
    p2 = saved(pairs.select("b", "c", (F.col("gamma") * (F.col("p1") + more(d2))).alias("p2"), _units(F.log1p(more(d2) / F.col("p1"))).alias("v")))
    word = p1.join(x2.withColumnRenamed("b", "c"), "c", "left").select("c", _units(F.log(F.col("p1") / F.lit(unknown))).alias("v"), _units(F.log("gamma")).alias("g"))
    pair = p2.join(x3.select(F.col("a").alias("b"), F.col("b").alias("c"), "gamma"), ["b", "c"], "left").select("b", "c", "v", _units(F.log("gamma")).alias("g"))
    triple = c3.join(x3, ["a", "b"]).join(p2.drop("v"), ["b", "c"]).select("a", "b", "c", _units(F.log1p(more(d3) / F.col("p2"))).alias("v"), F.lit(0).alias("g"))
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    _keyed(word, lambda c: c).union(_keyed(pair, _pair)).union(_keyed(triple, _triple)).write.parquet(path)
    first = int(START.view(np.int64))
    heads = x2.where(F.col("b") == first).select("gamma").union(x3.where((F.col("a") == first) & (F.col("b") == first)).select("gamma"))
    return {"path": path, "unknown": float(np.log(unknown)), "start": float(sum(np.log(r.gamma) for r in heads.collect()))}


_PACKED = "part int, keys binary, times binary, docs binary, ids binary, v binary, g binary"


def _packed_keys(keys: np.ndarray) -> tuple[int, bytes]:
    """Sorted keys as their differences, in the bytes that the largest needs."""
    step = np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys
    width = max(1, (int(step[1:].max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + keys[:1].tobytes() + step[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked_keys(data: bytes) -> np.ndarray:
    width = data[0]
    step = np.zeros(((len(data) - 9) // width, 8), np.uint8)
    step[:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(np.r_[np.frombuffer(data, "<u8", 1, 1), step.view("<u8")[:, 0]], dtype=np.uint64)


def _requests(docs: DataFrame, bits: int) -> DataFrame:
    """The n-grams of ``docs(id, text)``, packed for each range of hashes: sorted keys, how often each stands there, in which documents."""

    def pack(words):
        ids, keys, where, base = [], [], [], 0
        for own, w in words:
            n = np.repeat(np.arange(len(w.counts)), w.counts)
            end = np.zeros(len(n), np.uint16)
            end[w.first[1:][w.counts > 0] - 1] = LAST
            a, b = _before(w.hash, w.first)
            keys += [w.hash, _pair(b, w.hash), _triple(a, b, w.hash)]
            at = (base + n).astype(np.uint16)
            where += [at | end, at | end, at]
            ids.append(own)
            base += len(own)
        ids, keys, where = np.concatenate(ids), np.concatenate(keys), np.concatenate(where)
        order = np.argsort(keys, kind="stable")
        keys, where = keys[order], where[order]
        cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        for part in range(1 << bits):
            k, at = keys[cuts[part]:cuts[part + 1]], where[cuts[part]:cuts[part + 1]]
            if not len(k):
                continue
            new = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            used = np.unique(at & ~LAST)
            at = np.searchsorted(used, at & ~LAST).astype(np.uint16) | (at & LAST)
            times = np.diff(np.r_[new, len(k)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in (
                _packed_keys(k[new]), times.tobytes(), at.tobytes(), ids[used].tobytes(), None, None))], names=_NAMES)

    @lean
    def run(batches):
        held, size, rows = [], 0, 0
        for batch in batches:
            id_ = np.asarray(batch.column("id"))
            for w in words_of(batch.column("text")):
                more = w.rows.stop - w.rows.start
                if held and (size + len(w.hash) > PACK_WORDS or rows + more >= int(LAST)):
                    yield from pack(held)
                    held, size, rows = [], 0, 0
                held.append((id_[w.rows], w))
                size, rows = size + len(w.hash), rows + more
        if held:
            yield from pack(held)

    return docs.mapInArrow(run, _PACKED)


_NAMES = [x.split()[0] for x in _PACKED.split(", ")]


def _answers(model: DataFrame, docs: DataFrame, bits: int) -> DataFrame:
    """``id, units``: parts of the sums of the model's values of ``docs(id, text)``. Model and n-grams meet by ranges of hashes."""

    @lean
    def deal(batches):
        for batch in batches:
            k = np.asarray(batch.column("k")).view(np.uint64)
            order = np.argsort(k)
            k, v, g = k[order], np.asarray(batch.column("v"))[order], np.asarray(batch.column("g"))[order]
            cuts = np.searchsorted(k >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            for part in np.flatnonzero(np.diff(cuts)):
                x = slice(cuts[part], cuts[part + 1])
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([y], pa.binary()) for y in (
                    _packed_keys(k[x]), None, None, None, v[x].tobytes(), g[x].tobytes()))], names=_NAMES)

    def look(batches):
        asked, known = [], []
        for batch in batches:
            for r in batch.to_pylist():
                (asked if r["v"] is None else known).append(r)
        k = np.concatenate([_unpacked_keys(r["keys"]) for r in known] or [np.zeros(0, np.uint64)])
        v, g = (np.concatenate([np.frombuffer(r[x], np.int32) for r in known] or [np.zeros(0, np.int32)]) for x in "vg")
        del known
        order = np.argsort(k)
        k, v, g = k[order], v[order], g[order]
        if not len(k):
            return
        for r in asked:
            key, times, docs_, ids = _unpacked_keys(r["keys"]), *(np.frombuffer(r[x], t) for x, t in (("times", np.int32), ("docs", np.uint16), ("ids", np.int64)))
            at = np.minimum(np.searchsorted(k, key), len(k) - 1)
            hit = k[at] == key
            own, context = (np.repeat(np.where(hit, x[at], 0), times) for x in (v, g))
            units = np.zeros(len(ids), np.int64)
            np.add.at(units, docs_ & ~LAST, own + np.where(docs_ & LAST, 0, context).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(units)], names=["id", "units"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return lean(look)(batches)

    rows = model.repartition(F.expr(f"shiftrightunsigned(k, {64 - bits})")).mapInArrow(deal, _PACKED).union(_requests(docs, bits))
    return rows.groupBy("part").applyInArrow(run, "id long, units long")


def perplexities(docs: DataFrame, model) -> DataFrame:
    """``doc_id, th, lang, n_words, perplexity`` of every row, over its whole text; null where there is no word. th is the text's hash."""
    spark, m = docs.sparkSession, model.value

    @lean
    def count(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for w in words_of(batch.column("text")):
                n[w.rows] = w.counts
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "th", "lang", "id")), pa.array(n)], names=["doc_id", "th", "lang", "id", "n_words"])

    # equal rows share an id, and each takes its part of their sum
    rows = docs.select("doc_id", text_hash().alias("th"), "lang", "text").withColumn("id", F.xxhash64("doc_id", "th"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(1, int(max(2 * spark.sparkContext.defaultParallelism, size / RANGE_BYTES) - 1).bit_length())
    sums = _answers(spark.read.schema("k long, v int, g int").parquet(m["path"]), rows.select("id", "text"), bits).groupBy("id").agg(F.sum("units").alias("units"))
    counted = saved(rows.mapInArrow(count, "doc_id long, th long, lang string, id long, n_words long"))
    same = counted.groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
    each = F.coalesce(F.col("units") / F.col("rows"), F.lit(0.0)) / UNIT + F.lit(m["start"])
    perplexity = F.when(F.col("n_words") > 0, F.exp(-(each / F.col("n_words") + F.lit(m["unknown"]))))
    return counted.join(same, "id").join(sums, "id", "left").select("doc_id", "th", "lang", "n_words", perplexity.alias("perplexity"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, max_trusted: int | None = None, hashed: bool = False) -> DataFrame:
    """``doc_id, lang, n_words, perplexity, threshold, kept`` of every row of ``docs(doc_id, text, lang)``; with ``hashed``, also its text's hash ``th``.

    Trusted: doc_ids whose labels all have quality 1. A row is kept when its perplexity is at most the threshold of its language; a language
    (null is one) without trusted rows takes the threshold over all languages, and without any trusted row everything with a word is
    kept. The model is trained on all of a half of the trusted documents, or with ``max_trusted`` on so many of it at most.
    Null and empty texts have no perplexity and aren't kept. Repeated rows have equal results; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    trusted = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    # all of one half of the trusted documents are trained on, all of the other half give the thresholds
    half = trusted.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0)
    half = saved(half if max_trusted is None else half.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted))
    model = docs.sparkSession.sparkContext.broadcast(train(docs.join(half, "doc_id", "left_semi")))
    scored = saved(perplexities(docs, model))
    model.unpersist()
    held = scored.join(trusted, "doc_id", "left_semi").join(half, "doc_id", "left_anti").where("perplexity IS NOT NULL")
    cut = F.percentile_approx("perplexity", quantile, 10_000)
    overall = saved(held.agg(cut.alias("t"))).first()[0]
    by_lang = held.groupBy("lang").agg(cut.alias("threshold")).withColumnRenamed("lang", "_lang")
    out = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    limit = F.coalesce("threshold", F.lit(overall if overall is not None else float("inf")))
    out = out.select("doc_id", *["th"] * hashed, "lang", "n_words", "perplexity", limit.alias("threshold"))
    return out.withColumn("kept", F.expr("perplexity IS NOT NULL AND perplexity <= threshold"))


@query("op10_kneser_ney_quality")
def op10(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
