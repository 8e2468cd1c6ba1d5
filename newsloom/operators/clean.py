"""Projections, filters and text cleaning.

Everything but the lemmatiser is one ``select`` of chained column expressions (whole-stage
codegen, no Python). The lemmatiser needs a vocabulary lookup, done as joins on the
distinct token set (vocabulary sized) and one shuffle by document to put tokens back
in order; no token list ever passes through the driver.
"""

from __future__ import annotations

import functools
import operator
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.session import spread, table_of


def fill_title(df: DataFrame, value: str = "no_title", col: str = "title") -> DataFrame:
    """Null title -> value (``no_title`` in cleaning, ``no title`` in the graph set)."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(value)))


def lemma_map(tokens: DataFrame, vocab: DataFrame | None = None, rules=None) -> DataFrame:
    """Lemma per distinct token: ``tok, lemma`` for tokens whose lemma differs.

    Candidates are the token itself and, unless it has capitals, its suffix-rule results; a candidate counts only
    when it is a word of ``vocab`` (default: the distinct tokens themselves). The shortest
    candidate wins, ties by text. This is two aggregations and no join: every distinct token
    emits itself and its rule results keyed by the candidate word, and a word group says
    whether the word exists (groups hold at most a few rows per rule).
    """
    rules = text.NOUN_SUFFIX_RULES if rules is None else rules
    toks = tokens.select("tok").distinct()
    rule_arr = F.array(*[F.struct(F.lit(a).alias("suf"), F.lit(b).alias("rep")) for a, b in rules])
    cand = F.filter(
        F.transform(
            rule_arr,
            lambda r: F.when(
                (F.col("tok") == F.lower("tok")) & F.col("tok").endswith(r["suf"]) & (F.length("tok") - F.length(r["suf"]) + F.length(r["rep"]) > 0),
                F.concat(F.col("tok").substr(F.lit(1), F.length("tok") - F.length(r["suf"])), r["rep"]),
            ),
        ),
        lambda c: c.isNotNull(),
    )
    # candidate rows (word, tok): the token itself and its rule results; a word exists when
    # it is a vocabulary word (by default: any token)
    rows = toks.select("tok", F.explode(F.array_union(F.array(F.col("tok")), cand)).alias("word"),
                       F.lit(vocab is None).alias("in_vocab"))
    rows = rows.withColumn("in_vocab", F.col("in_vocab") & (F.col("word") == F.col("tok")))
    if vocab is not None:
        rows = rows.unionByName(
            vocab.select(F.lit(None).cast("string").alias("tok"), "word", F.lit(True).alias("in_vocab")).distinct())
    per_word = rows.groupBy("word").agg(
        F.max("in_vocab").alias("exists"),
        F.collect_set("tok").alias("from_toks"),
    )
    valid = per_word.filter("exists").select("word", F.explode("from_toks").alias("tok"))
    best = valid.groupBy("tok").agg(F.min(F.struct(F.length("word").alias("n"), F.col("word").alias("c"))).alias("b"))
    return best.filter(F.col("b.c") != F.col("tok")).select("tok", F.col("b.c").alias("lemma"))


def lemmatize(df: DataFrame, key: Sequence[str], token_cols: dict, vocab: DataFrame | None = None) -> DataFrame:
    """Lemmatise token arrays; ``token_cols`` maps output column -> token array column.

    Output: key..., one space-joined string per output column. Rows with equal keys become one, their tokens in order of position.

    The tokens are written to the shared folder while the query is built. Only the distinct tokens of a row that end like a
    suffix rule meet the lemmas; each key gets the few lemmas it needs as a map, so tokens stay in their arrays.
    """
    k = list(key)
    cols = list(dict.fromkeys(token_cols.values()))
    rows = table_of(df.select(*k, *cols), "tokens")
    ends = [a for a, _ in text.NOUN_SUFFIX_RULES]
    ends = [a for a in ends if not any(a != b and a.endswith(b) for b in ends)]

    def bends(t: Column) -> Column:
        return functools.reduce(operator.or_, (t.endswith(a) for a in ends))

    every = F.concat(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in cols))
    lm = lemma_map(rows.select(F.explode(every).alias("tok")).filter(F.col("tok").isNotNull()), vocab)
    need = rows.select(*k, F.explode(F.array_distinct(F.filter(every, bends))).alias("tok"))
    found = need.join(lm, "tok").groupBy(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(k))).agg(
        F.map_from_entries(F.collect_set(F.struct("tok", "lemma"))).alias("_m"))
    same = functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(k)))
    joined = rows.groupBy(*k).agg(F.collect_list(F.struct(*cols)).alias("_r")).join(found, same, "left")

    def lemma(t: Column) -> Column:
        return F.when(bends(t), F.coalesce(F.col("_m")[t], t)).otherwise(t)

    def joined_lemmas(src: str) -> Column:
        alone = F.transform(F.col("_r")[0][src], lemma)
        several = F.flatten(F.transform("_r", lambda r: F.transform(
            F.coalesce(r[src], F.array().cast("array<string>")), lambda t, i: F.struct(i.alias("_pos"), lemma(t).alias("_lem")))))
        merged = F.transform(F.array_sort(F.filter(several, lambda e: e["_lem"].isNotNull())), lambda e: e["_lem"])
        return F.coalesce(F.array_join(F.when(F.size("_r") == 1, alone).otherwise(merged), " "), F.lit(""))

    return joined.select(*k, *(joined_lemmas(src).alias(out) for out, src in token_cols.items()))


def preprocess(df: DataFrame, key: str = "doc_id", vocab: DataFrame | None = None) -> DataFrame:
    """P10: emoji, punctuation, lower case, digits, tokens, stop words, lemmas on title and content.

    Output: ``key, title, title_preproced, content_preproced``. A NULL content
    becomes the text ``nan``.
    """
    base = fill_title(spread(df.select(key, "title", "content"), key))
    toks = base.select(
        key,
        "title",
        text.clean_tokens(F.col("title")).alias("_tt"),
        text.clean_tokens(F.coalesce(F.col("content"), F.lit("nan"))).alias("_ct"),
    )
    lem = lemmatize(toks, [key], {"title_preproced": "_tt", "content_preproced": "_ct"}, vocab)
    return toks.select(key, "title").join(lem, key)


def preprocess_v2(df: DataFrame, col: str = "content", key: str = "doc_id", vocab: DataFrame | None = None) -> DataFrame:
    """The second cleaning order; lower-casing comes last, so ``The`` survives the stop list and ``Cities`` the lemmatiser."""
    toks = spread(df.select(key, col), key).select(key, text.clean_tokens_v2(F.col(col)).alias("_t"))
    out = f"{col}_preproced"
    return lemmatize(toks, [key], {out: "_t"}, vocab).withColumn(out, F.lower(out))


def select_valid(df: DataFrame, min_year: int = 2015, cols=("doc_id", "title", "content", "year", "month")) -> DataFrame:
    """Drop rows without year/month, keep the article columns, year >= min_year."""
    return df.dropna(subset=["year", "month"]).select(*cols).filter(F.col("year") >= min_year)


def keyword_hits(content: Column, keywords: Sequence[str]) -> Column:
    """Number of distinct keywords that occur as substrings of ``content`` (already lower case)."""
    kw = F.array(*[F.lit(w.lower()) for w in dict.fromkeys(keywords)])
    return F.size(F.filter(kw, lambda w: F.instr(content, w) > 0))


def keyword_filter(df: DataFrame, keywords: Sequence[str], k: int = 5, col: str = "content") -> DataFrame:
    """Keep articles where at least k distinct keywords occur (short literal list, no join).

    Adds ``hits``; lower(content) is projected once so the keyword lambda reads a column.
    """
    low = df.withColumn("_low", F.lower(col))
    return low.withColumn("hits", keyword_hits(F.col("_low"), keywords).cast("long")).filter(F.col("hits") >= k).drop("_low")


def expand_keywords(keywords: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Keywords plus their synonyms and first antonym, lower case, ``_`` -> space, distinct.

    ``keywords(word)``; ``lexicon(word, related, rel, rank)`` with rel in {'synonym','antonym'}.
    """
    first_ant = lexicon.filter(F.col("rel") == "antonym").groupBy("word").agg(
        F.min(F.struct("rank", "related")).alias("a")
    ).select("word", F.col("a.related").alias("related"))
    syn = lexicon.filter(F.col("rel") == "synonym").select("word", "related")
    rel = keywords.join(syn.unionByName(first_ant), "word").select(F.col("related").alias("word"))
    allw = keywords.select("word").unionByName(rel)
    return allw.select(F.regexp_replace(F.lower("word"), "_", " ").alias("word")).distinct()


def null_audit(df: DataFrame, col: str = "title") -> DataFrame:
    """Rows whose column is null."""
    return df.filter(F.col(col).isNull())


def outlier_docs(df: DataFrame, topic: str = "topic") -> DataFrame:
    """Documents of topic -1."""
    return df.filter(F.col(topic) == -1)


def month_slice(df: DataFrame, year: int, month: int) -> DataFrame:
    """One month (a partition filter when the data is written by year/month)."""
    return df.filter((F.col("year") == year) & (F.col("month") == month))


def nested_lengths(df: DataFrame, items: str, field: str) -> DataFrame:
    """Text length of each nested item, nulls skipped."""
    return (
        df.select(F.explode(items).alias("_it"))
        .select(F.length(F.col(f"_it.{field}")).alias("length"))
        .filter(F.col("length").isNotNull())
    )
