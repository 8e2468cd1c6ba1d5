"""Personal data by fixed patterns and bootstrapped contextual extraction.

E-mail addresses, IP addresses, card and phone numbers that the patterns find are the seeds. The words to the left of the seeds are lexical
patterns; runs of identifier groups and tokens with an inner @ or dot that follow such words are unseen instances. Patterns and instances form a
graph in which Spark scores both in turns: a pattern by the share of its instances that are known or believed, an instance by a noisy-or over its
patterns. Where an instance above a threshold stands behind a pattern above it, it adds a span to those of the seeds. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.base import fresh, query, saved, table

KINDS = ("email", "ip", "card", "phone")
#: What the contract's patterns match, written so that Java neither backtracks over long runs nor recurses.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text can have a match at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Unseen instances: tokens with a digit that aren't part of a longer one, with at least MIN_DIGITS digits, or tokens with an inner @ or dot.
_GROUP, _SYMBOLS = r"[A-Za-z@._+-]*+[0-9][A-Za-z0-9@._+-]*+", r"(?=[A-Za-z_+-]*+(?:\.[A-Za-z_+-]++)*+@[A-Za-z]|[A-Za-z_+-]++\.[A-Za-z])[A-Za-z@_+-]++(?:\.[A-Za-z@_+-]++)*+"
_APART = r"(?<![A-Za-z0-9@._+-])"
TOKEN = f"{_APART}(?:{_GROUP}|{_SYMBOLS})"
#: Runs of tokens with a digit, joined by single blanks or as a group in brackets; a dot before a blank ends a run.
_ATOM = rf"(?:\([0-9+]{{1,6}}+\)|{_GROUP})"
RUN = rf"{_APART}(?:{_ATOM}(?:(?:(?<!\.)\x20)?+{_ATOM})*+|{_SYMBOLS})"
#: A cheap test that a text can have one at all.
MAY_HAVE = rf"(?:[0-9][^0-9]*+){{4}}|@[A-Za-z]|[A-Za-z_+-]\.[A-Za-z]"
MIN_DIGITS = 4
ROUNDS = 3
#: Seeds that a pattern needs at least, and the score from which an instance is accepted.
MIN_SUPPORT, ACCEPT = 3, 0.8
_BLOCK = 64


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern with code point places and the text to their left: array of (s, e, value, ctx).

    Lengths of the pieces between matches and of the matches are summed up, block by block, so that a text with very many matches stays linear.
    """
    pieces = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0),
        lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m"), F.lower(F.regexp_extract(F.substring(g, -48, 48), r"\p{L}+[^\p{L}\p{N}]{0,3}$", 0)).alias("c")),
    )
    pieces = F.filter(pieces, lambda p: p.m.isNotNull())
    kind = "array<struct<s:int,e:int,value:string,ctx:string>>"
    none = F.array().cast(kind)

    def step(acc: Column, p: Column) -> Column:
        s = acc.at + p.g
        e = s + F.length(p.m)
        return F.struct(e.alias("at"), F.concat(acc.out, F.array(F.struct(s.alias("s"), e.alias("e"), p.m.alias("value"), p.c.alias("ctx")))).cast(kind).alias("out"))

    def block(acc: Column, i: Column) -> Column:
        inner = F.aggregate(F.slice(pieces, i, _BLOCK), F.struct(acc.at.alias("at"), none.alias("out")), step)
        return F.struct(inner.at.alias("at"), F.concat(acc.out, F.array(inner.out)).cast(f"array<{kind}>").alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    steps = F.when(F.size(pieces) > 0, F.sequence(F.lit(1), F.size(pieces), F.lit(_BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.aggregate(steps, start, block, lambda acc: acc.out))


def _luhn(digits: Column) -> Column:
    """Sum over the digits from the right, every second doubled, is a multiple of ten."""
    each = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), 0), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2))
    total = F.aggregate(each, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def found(docs: DataFrame) -> DataFrame:
    """``doc_id, th, base, other``: seeds and unseen instances of every row, as arrays of (k, s, e, value, ctx); th is the text's hash."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names = []
    for k, kind in enumerate(KINDS):
        typed = "array<struct<k:int,s:int,e:int,value:string,ctx:string>>"
        hit = F.when(F.col("text").rlike(NEEDS[kind]), located(F.col("text"), PATTERNS[kind])).otherwise(F.array().cast("array<struct<s:int,e:int,value:string,ctx:string>>"))
        out = out.withColumn(f"_{kind}", hit)
        good = F.filter(f"_{kind}", _keep(kind))
        out = out.withColumn(f"_{kind}", F.transform(good, _tagged(k)).cast(typed))
        names.append(f"_{kind}")
    out = out.withColumn("base", F.concat(*names))
    none = F.array().cast("array<struct<s:int,e:int,value:string,ctx:string>>")
    out = out.withColumn("_run", F.when(F.col("text").rlike(MAY_HAVE), F.filter(located(F.col("text"), RUN), _identifies)).otherwise(none))
    # a run that meets a seed comes apart into its tokens
    out = out.withColumn("_token", F.when(F.exists("_run", _meets("base")), F.filter(located(F.col("text"), TOKEN), _identifies)).otherwise(none))
    out = out.withColumn("_run", F.filter("_run", _apart("base")))
    out = out.withColumn("_token", F.filter(F.filter("_token", _apart("base")), _apart("_run")))
    out = out.withColumn("other", F.concat("_run", "_token"))
    return out.select("doc_id", F.xxhash64("text").alias("th"), "base", "other")


def _identifies(x: Column) -> Column:
    return (F.length(F.regexp_replace(x.value, "[^0-9]", "")) >= MIN_DIGITS) | x.value.rlike(r"@[A-Za-z]|^[^0-9]*[A-Za-z_+-]\.[A-Za-z][^0-9]*$")


def _meets(spans: str):
    return lambda x: F.exists(spans, lambda b: (b.s < x.e) & (x.s < b.e))


def _apart(spans: str):
    return lambda x: ~F.exists(spans, lambda b: (b.s < x.e) & (x.s < b.e))


def _keep(kind: str):
    return lambda x: _valid(kind, x.value)


def _tagged(k: int):
    return lambda x: F.struct(F.lit(k).alias("k"), x.s.alias("s"), x.e.alias("e"), x.value.alias("value"), x.ctx.alias("ctx"))


def accepted_instances(rows: DataFrame) -> DataFrame:
    """``ctx, value, k``: unseen instances with the kind of their patterns, and of these patterns those of high confidence.

    Edges are distinct (pattern, instance) pairs, so copies of a text count once, and each round is a few grouped joins.
    """
    seed = rows.select(F.explode("base").alias("x")).select("x.ctx", "x.value", "x.k")
    new = rows.select(F.explode("other").alias("x")).select("x.ctx", "x.value", F.lit(None).cast("int").alias("k"))
    edges = saved(seed.union(new).where("ctx <> ''").distinct())
    size = edges.groupBy("ctx").agg(F.countDistinct("value").alias("n"))
    seeds = edges.where("k IS NOT NULL").groupBy("ctx", "k").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= MIN_SUPPORT)
    patterns = saved(seeds.join(size, "ctx"))
    unseen = saved(edges.where("k IS NULL").select("ctx", "value").join(patterns.select("ctx").distinct(), "ctx", "left_semi"))
    belief = None
    for _ in range(ROUNDS):
        score = patterns.withColumn("extra", F.lit(0.0))
        if belief is not None:
            more = unseen.join(belief, "value").groupBy("ctx", "k").agg(F.sum("score").alias("extra"))
            score = patterns.join(more, ["ctx", "k"], "left").withColumn("extra", F.coalesce("extra", F.lit(0.0)))
        score = score.select("ctx", "k", ((F.col("support") + F.col("extra")) / (F.col("n") + 1)).alias("conf"))
        miss = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("conf"))))
        belief = saved(unseen.join(score, "ctx").groupBy("value", "k").agg((1 - F.exp(miss)).alias("score")).where("score > 0.05"))
    best = belief.groupBy("value").agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("k"), F.max("score").alias("score"))
    sure = score.where(F.col("conf") >= ACCEPT).select("ctx", "k")
    return unseen.join(best.where(F.col("score") >= ACCEPT).select("value", "k"), "value").join(sure, ["ctx", "k"]).select("ctx", "value", "k")


def _joined(spans: Column) -> Column:
    """kind:start:end in the order of kinds and starts."""
    name = F.array(*(F.lit(k) for k in KINDS))
    in_order = F.array_sort(F.transform(spans, lambda x: F.struct(x.k.alias("k"), x.s.alias("s"), x.e.alias("e"))))
    return F.array_join(F.transform(in_order, lambda x: F.concat_ws(":", F.element_at(name, x.k + 1), x.s.cast("string"), x.e.cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, th, base, spans`` of every row of ``docs(doc_id, text)``: seeds, and seeds with the discovered instances.

    Both are arrays of (k, s, e): kind by place in KINDS, code points, end exclusive. A null text is empty and has none. Repeated rows have equal
    results, and rows of equal doc_id and other texts their own; a null doc_id is a row like others. Other columns are ignored.
    """
    rows = saved(found(docs))
    known = accepted_instances(rows)
    hits = rows.select("doc_id", "th", F.explode("other").alias("x")).select("doc_id", "th", "x.s", "x.e", "x.value", "x.ctx").join(known, ["ctx", "value"])
    added = hits.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set(F.struct("k", "s", "e")).alias("added"))
    bare = F.transform("base", lambda x: F.struct(x.k.alias("k"), x.s.alias("s"), x.e.alias("e")))
    out = rows.select("doc_id", "th", bare.alias("base")).join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    return out.select("doc_id", "th", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame, max_broadcast: int = 200_000) -> DataFrame:
    """``docs``, all columns kept, with every span of its text replaced by its kind in brackets; n_chars is counted anew.

    Overlapping spans are replaced together by the first one's kind. Rows that need a change are told by doc_id and text.
    """
    id_, th, found_ = fresh(docs, "_id", "_th", "_spans")
    spans = personal_data(docs).where("size(spans) > 0").groupBy(F.col("doc_id").alias(id_), F.col("th").alias(th)).agg(F.first("spans").alias(found_))
    spans = saved(spans)
    if spans.count() <= max_broadcast:
        spans = F.broadcast(spans)
    label = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    ordered = F.array_sort(F.transform(found_, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.k.alias("k"))))

    def step(acc: Column, x: Column) -> Column:
        apart = x.s >= acc.at
        piece = F.concat(acc.out, F.array(F.substring(F.col("text"), acc.at + 1, x.s - acc.at), F.element_at(label, x.k + 1)))
        return F.struct(F.greatest(acc.at, x.e).alias("at"), F.when(apart, piece).otherwise(acc.out).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    end = lambda acc: F.concat(F.array_join(acc.out, ""), F.substring(F.col("text"), acc.at + 1, F.length("text") - acc.at))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(th))
    out = docs.join(spans, same, "left").withColumn("text", F.when(F.col(found_).isNull(), F.col("text")).otherwise(F.aggregate(ordered, start, step, end)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(found_).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


@query("op8_bootstrapped_pii")
def op8(spark, sf_dir):
    out = personal_data(table(spark, sf_dir, "documents"))
    count = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select("doc_id", *count, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _is_kind(k: int):
    return lambda x: x.k == k
