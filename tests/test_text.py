"""Cleaning operators on hand-made rows (FIXTURES.md section 5)."""

from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import clean


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("r")).first()["r"]


def test_punct_and_digits(spark):
    s = "It’s — £5 “ok” © 3³ covid19"
    got = one(spark, s, lambda c: T.strip_digits(T.strip_punct(c)))
    # the rule in plain Python: punctuation -> one space each, then digits deleted
    punct = set(T.ASCII_PUNCT + T.PUNCT_EXTRA)
    want = "".join(ch for ch in ("".join(" " if ch in punct else ch for ch in s)) if not ch.isdigit())
    assert got == want
    assert "covid" in got and "5" not in got


def test_emoji_removed_without_space(spark):
    assert one(spark, "a\U0001F600b", T.strip_emoji) == "ab"


def test_newlines(spark):
    assert one(spark, "a\r\nb\rc\nd", T.strip_newlines) == "a b c d"


def test_stopwords_keep_repeats(spark):
    got = one(spark, "The the mr Mr not cat cat", lambda c: T.remove_stopwords(T.tokenize(c)))
    assert got == ["The", "Mr", "cat", "cat"]


def test_contractions(spark):
    assert one(spark, "cannot gonna wanna", T.tokenize) == ["can", "not", "gon", "na", "wan", "na"]


def test_v2_lowercases_last(spark):
    from newsloom.operators import clean

    assert one(spark, "The the", T.clean_tokens_v2) == ["The"]
    rows = [(1, "Cities cities"), (2, "city City “Trump’s” — The end")]
    got = dict(clean.preprocess_v2(spark.createDataFrame(rows, "doc_id long, content string")).collect())
    assert got == {1: "cities city", 2: "city city trump the end"}


def test_null_content_is_the_text_nan(spark):
    from newsloom.operators import clean

    rows = [(1, None, None), (2, "a title", "some words")]
    got = {r.doc_id: r for r in clean.preprocess(spark.createDataFrame(rows, "doc_id long, title string, content string")).collect()}
    assert got[1].content_preproced == "nan" and got[2].content_preproced != ""


def test_remap_two_keys(spark):
    got = one(spark, "donald and barack met", lambda c: T.remap_tokens(c, {"donald": "trump", "barack": "obama"}))
    assert got == "trump and obama met"


def test_ngrams_short_input(spark):
    assert one(spark, "a b c", lambda c: T.ngrams(F.split(c, " "), 2, 2)) == ["a b", "b c"]
    df = spark.createDataFrame([(["x"],)], "t array<string>")
    assert df.select(T.ngrams(F.col("t"), 2, 2).alias("g")).first()["g"] == []


def test_lemmatize_with_vocab(spark):
    docs = spark.createDataFrame([(1, ["cities", "buses", "leaves", "men", "wolves", "news", "zzz"])], "doc_id long, t array<string>")
    vocab = spark.createDataFrame([(w,) for w in ["city", "bus", "leaf", "man", "wolf", "news"]], "word string")
    out = clean.lemmatize(docs, ["doc_id"], {"lem": "t"}, vocab).first()["lem"]
    assert out == "city bus leaf man wolf news zzz"


def test_keyword_filter_distinct_and_substring(spark):
    kws = ["alpha", "beta", "gamma", "delta", "eps"]
    rows = [(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta eps"), (3, "alphabet betamax gammas deltas epsilon"),
            (4, "alpha alpha alpha alpha alpha")]
    df = spark.createDataFrame(rows, "doc_id long, content string")
    kept = sorted(r.doc_id for r in clean.keyword_filter(df, kws, 5).collect())
    assert kept == [2, 3]


def test_fill_title(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "doc_id long, title string")
    assert [r.title for r in clean.fill_title(df).orderBy("doc_id").collect()] == ["no_title", "x"]


def test_expand_keywords(spark):
    kw = spark.createDataFrame([("Good",)], "word string")
    lex = spark.createDataFrame([("Good", "fine_day", "synonym", 1), ("Good", "bad", "antonym", 1), ("Good", "evil", "antonym", 2)],
                                "word string, related string, rel string, rank int")
    got = sorted(r.word for r in clean.expand_keywords(kw, lex).collect())
    assert got == ["bad", "fine day", "good"]
