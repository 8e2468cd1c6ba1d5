"""Benchmark decontamination: a set of normalised test n-grams, scanned over every window of the corpus.

Words are lower-cased in A-Z and hold digits, letters and all non-ASCII characters. A test item gives its windows of 13
consecutive words (a shorter item is one window). Each document is scanned in place: the hash of every window is looked up in the set,
hits are verified as strings, and hit words, items and the verdict follow. Only DataFrame functions are used, and the text never
leaves the scan's partition unless the test set is too large for a set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.base import ORACLES, fresh, query, saved, table

WINDOW = 13
#: Windows of test items that go into the tasks as a set (8 bytes each); more are joined instead.
MAX_SET = 100_000
#: Keys of removed rows that are broadcast; more are joined with a shuffle.
MAX_BROADCAST_IDS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, everything else kept; lower() says the same for ASCII text and is much faster."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP, -1), "")


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """``win, len, items``: each distinct window of the test items and the items that have it."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    items = items.withColumn("len", F.least(F.lit(window), F.size("w")))
    at = items.select("item_id", "w", "len", F.explode(F.expr("sequence(1, size(w) - len + 1)")).alias("p"))
    return at.groupBy(F.expr("array_join(slice(w, p, len), ' ')").alias("win"), "len").agg(F.collect_set("item_id").alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``rid, doc_id, n_words, hit, items`` of every row of ``docs``: the places (from 1) of its hit words, and the items that occur.

    Null and empty texts have no words. A repeated row, also one that repeats a doc_id, has its own result (rid tells rows of one scan
    apart). Items without words or with a null text have no window; a null item_id marks words but isn't listed.
    """
    wins = saved(item_windows(benchmark, window))
    lengths = [r[0] for r in wins.select("len").distinct().orderBy("len").collect()]
    count = wins.count()
    d = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words(F.col("text")).alias("w"))
    found = d.withColumn("n_words", F.size("w").cast("long"))
    at = "CASE WHEN size(w) >= {n} THEN sequence(1, size(w) - {n} + 1) ELSE cast(array() AS array<int>) END"
    if count <= MAX_SET:
        known = wins.select("len", F.xxhash64(F.split("win", " ")).alias("h")).collect()
        parts = []
        for n in lengths:
            keys = ", ".join(str(r.h) + "L" for r in known if r.len == n).replace("-9223372036854775808L", "(-9223372036854775807L - 1L)")
            parts.append(f"transform(filter({at.format(n=n)}, i -> xxhash64(slice(w, i, {n})) IN ({keys})),"
                         f" i -> named_struct('p', i, 'len', {n}, 'win', array_join(slice(w, i, {n}), ' ')))")
        hits = F.expr(f"concat({', '.join(parts)})" if parts else "cast(array() AS array<struct<p:int,len:int,win:string>>)")
        hits = found.select("rid", "doc_id", "n_words", F.explode_outer(hits).alias("x"))
        hits = hits.select("rid", "doc_id", "n_words", "x.p", "x.len", "x.win").join(F.broadcast(wins.drop("len")), "win", "left")
    else:
        found = saved(found)  # the row ids must be the same for the search and for the check
        every = [found.select("rid", F.posexplode(F.expr(f"transform({at.format(n=n)}, i -> xxhash64(slice(w, i, {n})))")).alias("p", "h"), F.lit(n).alias("len")) for n in lengths]
        all_at = every[0]
        for more in every[1:]:
            all_at = all_at.union(more)
        keys = wins.select(F.xxhash64(F.split("win", " ")).alias("h"), "len").distinct()
        near = all_at.join(keys, ["h", "len"], "left_semi").select("rid", (F.col("p") + 1).alias("p"), "len")
        near = found.join(near, "rid").select("rid", "p", "len", F.expr("array_join(slice(w, p, len), ' ')").alias("win")).join(wins.drop("len"), "win")
        hits = found.select("rid", "doc_id", "n_words").join(near, "rid", "left")
    real = F.col("items").isNotNull()
    return hits.groupBy("rid", "doc_id", "n_words").agg(
        F.array_distinct(F.flatten(F.collect_list(F.when(real, F.expr("sequence(p, p + len - 1)"))))).alias("hit"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """``rid, doc_id, n_words, n_hit, n_items, items_sha256, contaminated``; contaminated: hit words are at least 1 in ``share``."""
    s = scan(docs, benchmark, window)
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    s = s.select("rid", "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                 F.sha2(ids.cast("binary"), 256).alias("items_sha256"))
    return s.withColumn("contaminated", F.expr(f"n_hit > 0 AND {share} * n_hit >= n_words"))


def text_hash() -> Column:
    """With doc_id it tells a row's content; a null text is an empty one."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``docs`` that aren't in ``rows(doc_id, th, ...)``: th is the text's hash, columns after it are those of ``docs`` by name; nulls are equal."""
    gone = saved(rows.distinct())
    names = fresh(docs, *(f"_gone_{c}" for c in rows.columns))
    same = F.lit(True)
    for c, name in zip(rows.columns, names):
        same = same & ((text_hash() == F.col(name)) if c == "th" else F.col(c).eqNullSafe(F.col(name)))
    gone_rows = gone.toDF(*names)
    if gone.count() <= MAX_BROADCAST_IDS:
        gone_rows = F.broadcast(gone_rows)
    return docs.join(gone_rows, same, "left_anti")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW, share: int = 20) -> DataFrame:
    """``docs`` without contamination, all columns kept: without contaminated documents, or (``mode='spans'``) without the hit words.

    In the first mode each row goes by its own verdict, also among rows of one doc_id or without one. In the second, a hit word
    goes with the separators after it, and n_chars, where there is one, is counted anew.
    """
    if mode == "documents":
        rows = docs.select(F.struct("doc_id", text_hash().alias("th")).alias("doc_id"), "text")
        return without_rows(docs, report(rows, benchmark, window, share).where("contaminated").select("doc_id.doc_id", "doc_id.th"))
    rid, found = fresh(docs, "_rid", "_hit")
    # equal rows have equal hits, so the text's own hash and the id tell them
    key = docs.withColumn(rid, F.xxhash64("doc_id", "text"))
    hit = scan(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), benchmark, window).where("size(hit) > 0")
    hit = hit.groupBy(F.col("doc_id").alias(rid)).agg(F.first("hit").alias(found))
    word = _GAP_ANY_CASE.replace("[", "[^", 1)
    pieces = F.regexp_extract_all("text", F.lit(f"({word}+{_GAP_ANY_CASE}*)"))
    left = F.filter(pieces, lambda x, i: ~F.array_contains(F.col(found), i + 1))
    text = F.when(F.col(found).isNull(), F.col("text")).otherwise(F.concat(F.regexp_extract("text", f"^{_GAP_ANY_CASE}*", 0), F.array_join(left, "")))
    out = key.join(hit, rid, "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


@query("op2_benchmark_decontamination")
def op2(spark, sf_dir):
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op2_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
