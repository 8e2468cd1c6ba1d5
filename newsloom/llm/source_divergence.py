"""Audit of how far the sources of a language differ in their terms.

Terms are counted in tasks over parts of the texts: short terms are packed into one or two 64-bit words and radix-sorted, long ones lie in buckets of
their length class and are sorted as bytes; runs of equal terms are counted. Spark adds the parts up, keeps the terms that enough documents of their
language hold, and deals them out by term. A task compares all sources over its terms; sums of the parts are the divergences.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.base import bounded_batches, query, saved, table
from newsloom.llm.words import column_bytes, row_chunks

MIN_DOCS, SMOOTH, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Terms that are sorted together, and kept (source, term) counts for one task of the comparison.
FLUSH_TERMS, PART_ROWS = 1 << 20, 200_000
#: Cells of the dense source x term table, and of the source x source table, that a task holds at a time.
CELLS = 1 << 21

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: _HEAD[k]: the first k bytes of a big-endian word.
_HEAD = np.array([(1 << 64) - (1 << 64 - 8 * k) for k in range(9)], np.uint64)


def term_places(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal letter runs; a run ends with its row."""
    n = len(data)
    inner = np.zeros(n + 2, bool)
    inner[1:-1] = _LETTER[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    return np.flatnonzero(inner[1:-1] & (~inner[:-2] | cut[:-1])), np.flatnonzero(inner[1:-1] & (~inner[2:] | cut[1:])) + 1


def packed(data: np.ndarray, start: np.ndarray, end: np.ndarray, words: int) -> list[np.ndarray]:
    """The bytes of each place as ``words`` big-endian 64-bit words, zeros behind its end (no term holds a zero byte)."""
    padded = np.zeros(len(data) + 8 * words + 8, np.uint8)
    padded[:len(data)] = data
    at = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    length = end - start
    return [at[start + 8 * k].astype(np.uint64) & _HEAD[np.clip(length - 8 * k, 0, 8)] for k in range(words)]


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """Stable ascending order by several unsigned keys, the first one most significant: 16 bits a pass, from the last."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in range(0, 8 * word.itemsize, 16):
            digit = (word >> word.dtype.type(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                # numpy sorts 16-bit integers by radix
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_counts(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places of the runs of equal keys in sorted rows, their lengths, and how many documents each has (documents ascend in a run)."""
    n = len(doc)
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    other = new.copy()
    other[1:] |= doc[1:] != doc[:-1]
    return first, np.diff(np.r_[first, n]), np.add.reduceat(other.astype(np.int64), first) if n else first


def counted(data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray, doc: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct (term, group) pairs of some places, by length class: terms, groups, counts, documents."""
    length = end - start
    for words, lo, hi in ((1, 1, 8), (2, 9, 16)):
        pick = np.flatnonzero((length >= lo) & (length <= hi))
        if not len(pick):
            continue
        keys = [*packed(data, start[pick], end[pick], words), group[pick]]
        order = radix_order(keys)
        keys = [k[order] for k in keys]
        first, n, docs = run_counts(keys, doc[pick][order])
        raw = np.stack([k[first] for k in keys[:-1]], 1).astype(">u8").view(np.uint8).reshape(len(first), 8 * words)
        yield _strings(raw), keys[-1][first], n, docs
    rest = np.flatnonzero(length > 16)
    width = 1 << np.ceil(np.log2(length[rest])).astype(int) if len(rest) else rest
    for w in np.unique(width).tolist():
        pick = rest[width == w]
        raw = np.zeros((len(pick), w), np.uint8)
        row = np.repeat(np.arange(len(pick)), length[pick])
        col = np.arange(len(row)) - np.repeat(np.cumsum(length[pick]) - length[pick], length[pick])
        raw[row, col] = data[start[pick][row] + col]
        key = raw.view(f"S{w}").ravel()
        order = np.lexsort((group[pick], key))
        first, n, docs = run_counts([key[order], group[pick][order]], doc[pick][order])
        yield _strings(raw[order][first]), group[pick][order][first], n, docs


def _strings(raw: np.ndarray) -> pa.Array:
    """Rows of bytes up to their zeros as strings."""
    used = raw != 0
    offsets = np.r_[0, np.cumsum(used.sum(1))].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(raw), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[used]))).cast(pa.string())


def _filled(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` of parts of the table: occurrences and documents; a term has a row for each part that holds it."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        groups: dict[tuple[str, str], int] = {}
        held: list[tuple[np.ndarray, ...]] = []
        size = docs_seen = 0

        def flush():
            data = np.concatenate([h[0] for h in held])
            shift = np.cumsum([0] + [len(h[0]) for h in held[:-1]])
            start = np.concatenate([h[1] + s for h, s in zip(held, shift)])
            end = np.concatenate([h[2] + s for h, s in zip(held, shift)])
            lang, source = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
            for term, group, n, docs_ in counted(data, start, end, np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])):
                for at in range(0, len(term), 50_000):
                    part = slice(at, at + 50_000)
                    of = pa.array(group[part])
                    yield pa.RecordBatch.from_arrays([lang.take(of), source.take(of), term[part], pa.array(n[part], pa.int64()), pa.array(docs_[part], pa.int64())],
                                                     names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            of = np.fromiter((groups.setdefault(g, len(groups)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())), np.uint32, batch.num_rows)
            data, offsets = column_bytes(batch.column("text"))
            for rows in row_chunks(offsets, 1 << 20):
                lo, hi = int(offsets[rows.start]), int(offsets[rows.stop])
                low, bounds = _LOWER[data[lo:hi]], offsets[rows.start:rows.stop + 1] - lo
                start, end = term_places(low, bounds)
                row = np.searchsorted(bounds, start, "right") - 1
                held.append((low, start, end, of[rows.start + row], docs_seen + row))
                docs_seen += rows.stop - rows.start
                size += len(start)
                if size >= FLUSH_TERMS:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return _filled(docs).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def shares(count: np.ndarray, total: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + SMOOTH) / total)``, exact: in Python integers where 64 bits don't hold the product."""
    out = 1 + SCALE * (np.minimum(count, 1 << 32) + SMOOTH) // total
    big = np.flatnonzero(count > 1 << 32)
    out[big] = [1 + SCALE * (int(c) + SMOOTH) // total for c in count[big]]
    return out


def compare(sources: pa.Table, terms: pa.Table, top: int) -> Iterator[pa.RecordBatch]:
    """Rows ``lang, source, part, item, value`` of a part of a language's terms.

    ``sources(lang, source, n, lang_n, v)`` are all sources of the language with their totals, ``terms(term, source, n)`` the counts above zero. Part
    ``pair`` has the sum of differences over these terms for each two sources (once), part ``term`` each source's ``top`` first terms.
    """
    name = sorted(sources.column("source").to_pylist(), key=lambda x: x.encode())
    by = {r["source"]: r for r in sources.to_pylist()}
    some = by[name[0]]
    lang, v = some["lang"], some["v"]
    total = [max(1, by[s]["n"] + SMOOTH * v) for s in name]
    lang_total = max(1, some["lang_n"] + SMOOTH * v)
    S = len(name)
    coded = terms.column("term").combine_chunks().dictionary_encode()
    term = coded.dictionary.to_pylist()
    raw = [t.encode() for t in term]
    rank = np.empty(len(term), np.int64)
    rank[sorted(range(len(term)), key=raw.__getitem__)] = np.arange(len(term))
    term = [term[i] for i in np.argsort(rank)]
    t = rank[coded.indices.to_numpy()] if len(term) else np.zeros(0, np.int64)
    place = {s: i for i, s in enumerate(name)}
    s = np.fromiter((place[x] for x in terms.column("source").to_pylist()), np.int64, len(t))
    n = terms.column("n").to_numpy()
    order = np.argsort(t, kind="stable")
    t, s, n = t[order], s[order], n[order]
    step = max(1, CELLS // S)
    rows_step = max(1, CELLS // max(S, 1))
    best: list[list[tuple[int, int]]] = [[] for _ in name]

    def dense(lo: int) -> np.ndarray:
        a, b = np.searchsorted(t, [lo, lo + step])
        count = np.zeros((S, min(step, len(term) - lo)), np.int64)
        count[s[a:b], t[a:b] - lo] = n[a:b]
        return count

    def emit(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), *(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.int64())],
                                          names=["lang", "source", "part", "item", "value"])

    # stripes of sources, so that the source x source sums stay bounded too
    for g0 in range(0, S, rows_step):
        stripe = range(g0, min(g0 + rows_step, S))
        sums = np.zeros((len(stripe), S), np.int64)
        for lo in range(0, len(term), step):
            count = dense(lo)
            p = np.stack([shares(count[i], total[i]) for i in range(S)])
            for g in stripe:
                sums[g - g0, g + 1:] += np.abs(p[g + 1:] - p[g]).sum(1)
            if g0 == 0:
                q = shares(count.sum(0), lang_total)
                for g in range(S):
                    f = p[g] - q
                    hit = np.flatnonzero((count[g] > 0) & (f > 0))
                    hit = hit[np.argsort(-f[hit], kind="stable")[:top]]
                    best[g] = sorted(best[g] + list(zip((-f[hit]).tolist(), (hit + lo).tolist())))[:top]
        for g in stripe:
            for h0 in range(g + 1, S, 10_000):
                yield emit([(name[g], "pair", name[h], int(sums[g - g0, h])) for h in range(h0, min(S, h0 + 10_000))])
    for g in range(S):
        if best[g]:
            yield emit([(name[g], "term", term[k], -f) for f, k in best[g]])


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, part_rows: int = PART_ROWS) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``docs(lang, source, text)``: all other sources of the language, and the source's ``top`` terms.

    Null text, lang and source are ''. A group without terms has shares like others; a language with one source has no pairs, one without kept terms has
    pairs of value 0. Rows that repeat count each time. Very long texts and terms are read whole. Ties go by item. Other columns are ignored; an empty
    table gives an empty result. Tables of counts go to the folder of spark.checkpoint.dir.
    """
    parts = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    parts = saved(parts)
    kept = parts.groupBy("lang", "term").agg(F.sum("docs").alias("df")).where(F.col("df") >= min_docs).select("lang", "term")
    kept = saved(parts.join(kept, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"))
    blocks = max(1, -(-kept.count() // part_rows))
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    by_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("v"))
    groups = _filled(docs).select("lang", "source").distinct().join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0)
    groups = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    terms = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))

    def kernel(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from compare(left, right, top)

    schema = "lang string, source string, part string, item string, value long"
    found = groups.groupBy("lang", "block").cogroup(terms.groupBy("lang", "block")).applyInArrow(_as_table(kernel, schema), schema)
    found = saved(found)
    pair = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pair.unionByName(pair.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).withColumn("part", F.lit("pair"))
    w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = both.unionByName(found.where("part = 'term'")).withColumn("rank", F.row_number().over(w).cast("int"))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def _as_table(kernel, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64() if c.endswith("long") else pa.string() for c in schema.split(", ")]
    empty = pa.schema(list(zip(names, kinds)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(kernel(left, right)), empty)

    return run


@query("op13_length_bucketed_divergence")
def op13(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents"))
