"""Queries of the cleaning family (P1-P22, M1) with their DuckDB oracles.

Long texts are compared through ``md5`` of the result plus its length: exact, compact.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import clean
from newsloom.plans.registry import query
from newsloom.plans.sql_common import ARTICLES, TOPICS, with_
from newsloom.sources import tables

KEYWORDS = ["worthless", "ther", "tion", "thha", "eron", "anea", "thre", "thes", "thon", "erin", "thti", "thble"]
REMAP = {"the": "THE", "and": "AND", "of": "OF"}


def _digest(c, name):
    return [F.md5(c).alias(f"{name}_md5"), F.length(c).cast("long").alias(f"{name}_len")]


def _sql_digest(x, name):
    return f"md5({x}) AS {name}_md5, length({x}) AS {name}_len"


def _art(spark, sf_dir):
    return tables.article_view(spark, sf_dir)


@query("p01_fill_title", with_(ARTICLES, " SELECT doc_id, coalesce(title, 'no_title') AS title FROM art"))
def p01(spark, sf_dir):
    return clean.fill_title(_art(spark, sf_dir)).select("doc_id", "title")


@query("p02_strip_emoji", with_(ARTICLES, f" SELECT doc_id, {_sql_digest(T.sql_strip_emoji('content'), 'content')} FROM art"))
def p02(spark, sf_dir):
    return _art(spark, sf_dir).select("doc_id", *_digest(T.strip_emoji(F.col("content")), "content"))


@query("p03_strip_punct", with_(ARTICLES, f" SELECT doc_id, {_sql_digest(T.sql_strip_punct('content'), 'content')} FROM art"))
def p03(spark, sf_dir):
    return _art(spark, sf_dir).select("doc_id", *_digest(T.strip_punct(F.col("content")), "content"))


@query("p04_lower", with_(ARTICLES, f" SELECT doc_id, {_sql_digest('lower(content)', 'content')} FROM art"))
def p04(spark, sf_dir):
    return _art(spark, sf_dir).select("doc_id", *_digest(F.lower("content"), "content"))


@query("p05_strip_digits", with_(ARTICLES, f" SELECT doc_id, {_sql_digest(T.sql_strip_digits('content'), 'content')} FROM art"))
def p05(spark, sf_dir):
    return _art(spark, sf_dir).select("doc_id", *_digest(T.strip_digits(F.col("content")), "content"))


_NL_SQL = "replace(replace(replace(content, chr(13) || chr(10), ' '), chr(13), ' '), chr(10), ' ')"


@query("p06_strip_newlines", with_(ARTICLES, f" SELECT doc_id, {_sql_digest(_NL_SQL, 'content')} FROM art"))
def p06(spark, sf_dir):
    return _art(spark, sf_dir).select("doc_id", *_digest(T.strip_newlines(F.col("content")), "content"))


def _tok_digest(c, name):
    return [F.size(c).cast("long").alias(f"{name}_tokens"), F.md5(F.array_join(c, " ")).alias(f"{name}_md5")]


def _sql_tok_digest(x, name):
    return f"len({x}) AS {name}_tokens, md5(array_to_string({x}, ' ')) AS {name}_md5"


_P7_IN = T.sql_strip_digits(f"lower({T.sql_strip_punct(T.sql_strip_emoji('content'))})")


@query("p07_tokenize", with_(ARTICLES, f" SELECT doc_id, {_sql_tok_digest(T.sql_tokenize(_P7_IN), 'content')} FROM art"))
def p07(spark, sf_dir):
    c = T.strip_digits(F.lower(T.strip_punct(T.strip_emoji(F.col("content")))))
    return _art(spark, sf_dir).select("doc_id", *_tok_digest(T.tokenize(c), "content"))


@query("p08_remove_stopwords", with_(ARTICLES, f" SELECT doc_id, {_sql_tok_digest(T.sql_clean_tokens('content'), 'content')} FROM art"))
def p08(spark, sf_dir):
    return _art(spark, sf_dir).select("doc_id", *_tok_digest(T.clean_tokens(F.col("content")), "content"))


def _sql_rules():
    vals = ", ".join(f"('{a}', '{b}')" for a, b in T.NOUN_SUFFIX_RULES)
    return f"rules AS (SELECT * FROM (VALUES {vals}) r(suf, rep))"


def _sql_lemmas(src_cte: str) -> str:
    """CTEs ex, lm and lem over ``src_cte(doc_id, f, toks)``; lem(doc_id, f, s)."""
    return f"""
 ex AS (SELECT doc_id, f, generate_subscripts(toks, 1) AS pos, unnest(toks) AS tok FROM {src_cte}),
dt AS (SELECT DISTINCT tok FROM ex),
{_sql_rules()},
cand AS (SELECT d.tok, substr(d.tok, 1, length(d.tok) - length(r.suf)) || r.rep AS cand
         FROM dt d JOIN rules r ON d.tok = lower(d.tok) AND suffix(d.tok, r.suf) AND length(d.tok) - length(r.suf) + length(r.rep) > 0),
okc AS (SELECT c.tok, c.cand FROM cand c WHERE c.cand IN (SELECT tok FROM dt) UNION SELECT tok, tok FROM dt),
lm AS (SELECT tok, cand AS lemma FROM (
         SELECT tok, cand, row_number() OVER (PARTITION BY tok ORDER BY length(cand), cand) AS rn FROM okc)
       WHERE rn = 1 AND cand <> tok),
lem AS (SELECT doc_id, f, string_agg(coalesce(lm.lemma, ex.tok), ' ' ORDER BY pos) AS s
        FROM ex LEFT JOIN lm USING (tok) GROUP BY doc_id, f)
"""


P09_SQL = with_(
    ARTICLES,
    f" src AS (SELECT doc_id, 'c' AS f, {T.sql_clean_tokens('content')} AS toks FROM art)",
    _sql_lemmas("src"),
    " SELECT a.doc_id, " + _sql_digest("coalesce(l.s, '')", "content") + " FROM art a LEFT JOIN lem l USING (doc_id)",
)


@query("p09_lemmatize", P09_SQL)
def p09(spark, sf_dir):
    a = _art(spark, sf_dir)
    toks = a.select("doc_id", T.clean_tokens(F.col("content")).alias("_t"))
    lem = clean.lemmatize(toks, ["doc_id"], {"content": "_t"})
    return lem.select("doc_id", *_digest(F.col("content"), "content"))


P10_SQL = with_(
    ARTICLES,
    f""" src AS (SELECT doc_id, 't' AS f, {T.sql_clean_tokens("coalesce(title, 'no_title')")} AS toks FROM art
         UNION ALL SELECT doc_id, 'c' AS f, {T.sql_clean_tokens("coalesce(content, 'nan')")} AS toks FROM art)""",
    _sql_lemmas("src"),
    f""" SELECT a.doc_id, coalesce(a.title, 'no_title') AS title, coalesce(t.s, '') AS title_preproced,
            {_sql_digest("coalesce(c.s, '')", 'content_preproced')}
     FROM art a LEFT JOIN lem t ON t.doc_id = a.doc_id AND t.f = 't'
                LEFT JOIN lem c ON c.doc_id = a.doc_id AND c.f = 'c'""",
)


@query("p10_preprocess", P10_SQL)
def p10(spark, sf_dir):
    pre = clean.preprocess(_art(spark, sf_dir))
    return pre.select("doc_id", "title", "title_preproced", *_digest(F.col("content_preproced"), "content_preproced"))


P11_SQL = with_(
    ARTICLES,
    f" src AS (SELECT doc_id, 'c' AS f, {T.sql_clean_tokens_v2('content')} AS toks FROM art)",
    _sql_lemmas("src"),
    " SELECT a.doc_id, " + _sql_digest("lower(coalesce(l.s, ''))", "content") + " FROM art a LEFT JOIN lem l USING (doc_id)",
)


@query("p11_preprocess_v2", P11_SQL)
def p11(spark, sf_dir):
    pre = clean.preprocess_v2(_art(spark, sf_dir))
    return pre.select("doc_id", *_digest(F.col("content_preproced"), "content"))


def _sql_remap(x):
    inner = "CASE " + " ".join(f"WHEN t = '{k}' THEN '{v}'" for k, v in REMAP.items()) + " ELSE t END"
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda t: {inner}), ' ')"


@query("p12_remap_tokens", with_(ARTICLES, f" SELECT doc_id, {_sql_digest(_sql_remap('content'), 'content')} FROM art"))
def p12(spark, sf_dir):
    return _art(spark, sf_dir).select("doc_id", *_digest(T.remap_tokens(F.col("content"), REMAP), "content"))


@query("p13_truncate_text", with_(ARTICLES, f" SELECT doc_id, {_sql_digest('substring(content, 1, 500)', 'content')} FROM art"))
def p13(spark, sf_dir):
    return _art(spark, sf_dir).select("doc_id", *_digest(T.truncate_text(F.col("content"), 500), "content"))


@query("p14_year_month", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders""")
def p14(spark, sf_dir):
    o = tables.read_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))


@query("p15_select_valid", with_(ARTICLES, " SELECT doc_id, title, year, month, length(content) AS content_len FROM art WHERE year >= 2016"))
def p15(spark, sf_dir):
    v = clean.select_valid(_art(spark, sf_dir), 2016)
    return v.select("doc_id", "title", "year", "month", F.length("content").cast("long").alias("content_len"))


_KW_SQL = "[" + ", ".join(f"'{k}'" for k in KEYWORDS) + "]"


@query("p17_keyword_filter", with_(ARTICLES, f"""
 SELECT doc_id, hits FROM (
   SELECT doc_id, len(list_filter({_KW_SQL}, lambda w: instr(lower(content), w) > 0)) AS hits FROM art)
 WHERE hits >= 5"""))
def p17(spark, sf_dir):
    a = _art(spark, sf_dir)
    return clean.keyword_filter(a, KEYWORDS, 5).select("doc_id", "hits")


@query("p18_null_audit", with_(ARTICLES, " SELECT doc_id, year, month FROM art WHERE title IS NULL"))
def p18(spark, sf_dir):
    return clean.null_audit(_art(spark, sf_dir)).select("doc_id", "year", "month")


@query("p19_outlier_docs", with_(TOPICS, " SELECT doc_id, year, month, label FROM asg WHERE topic = -1"))
def p19(spark, sf_dir):
    p = tables.fixture_params()
    a = tables.topic_assignment(tables.article_vectors(spark, sf_dir), p["min_topic_size"])
    return clean.outlier_docs(a).select("doc_id", "year", "month", "label")


@query("p20_token_length", with_(ARTICLES, f" SELECT doc_id, least(len({T.sql_tokenize('content')}) + 2, 512) AS n_tokens FROM art"))
def p20(spark, sf_dir):
    return _art(spark, sf_dir).select("doc_id", T.token_length(F.col("content")).alias("n_tokens"))


@query("p21_nested_lengths", """
SELECT doc_id, pos, length(item) AS length FROM (
  SELECT doc_id, generate_subscripts(items, 1) AS pos, unnest(items) AS item
  FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: nullif(l, '')) AS items FROM documents))
WHERE item IS NOT NULL""")
def p21(spark, sf_dir):
    d = tables.read_table(spark, sf_dir, "documents")
    items = F.transform(F.split("text", "\n", -1), lambda l: F.struct(F.nullif(l, F.lit("")).alias("summary")))
    nested = d.select("doc_id", items.alias("articles"))
    ex = nested.select("doc_id", F.posexplode("articles").alias("pos", "_it"))
    return ex.select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("pos"), F.length("_it.summary").cast("long").alias("length")
    ).filter(F.col("length").isNotNull())


@query("p22_month_slice", with_(ARTICLES, " SELECT doc_id, title FROM art WHERE year = 2016 AND month = 2"))
def p22(spark, sf_dir):
    return clean.month_slice(_art(spark, sf_dir), 2016, 2).select("doc_id", "title")


def _sql_bigrams(toks):
    return (f"list_transform(list_filter(range(1, len({toks}) + 1), lambda i: i <= len({toks}) - 1), "
            f"lambda i: array_to_string({toks}[i:i + 1], ' '))")


@query("m01_ngrams", with_(ARTICLES, f"""
 SELECT doc_id, len(g) AS n_grams, md5(array_to_string(g, '|')) AS grams_md5
 FROM (SELECT doc_id, {_sql_bigrams('toks')} AS g FROM (SELECT doc_id, {T.sql_clean_tokens('content')} AS toks FROM art))"""))
def m01(spark, sf_dir):
    toks = _art(spark, sf_dir).select("doc_id", T.clean_tokens(F.col("content")).alias("toks"))
    g = T.ngrams(F.col("toks"), 2, 2)
    return toks.select("doc_id", F.size(g).cast("long").alias("n_grams"), F.md5(F.array_join(g, "|")).alias("grams_md5"))
