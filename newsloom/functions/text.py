"""Text column expressions: regex and array functions only, no UDF.

Each pattern is a Java/RE2-compatible regular expression, so the DuckDB oracle can use
the very same text (``sql_*`` helpers below build the oracle's expressions).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that the cleaning step turns into a space besides ASCII
# punctuation (the multi-character literals of the reference split into single characters).
PUNCT_EXTRA = "“’” —â€œ¦™ÂÃ¶§£©ª³"

# Spark's default English stop-word list (StopWordsRemover, 181 words) plus "mr".
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll "
    "she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've "
    "you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't "
    "shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's "
    "who's why's would"
).split() + ["mr"]

# Contractions split by the Treebank word tokenizer (the ones left after
# punctuation is gone): cannot, gimme, gonna, gotta, lemme, wanna.
CONTRACTIONS = [("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na")]

# Noun suffix rules of the lemmatizer (WordNet morphology, nouns).
NOUN_SUFFIX_RULES = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
    ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
]

EMOJI_CLASS = (
    "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2300}-\\x{23FF}\\x{2B00}-\\x{2BFF}"
    "\\x{FE00}-\\x{FE0F}\\x{200D}\\x{20E3}\\x{E0020}-\\x{E007F}]"
)
DIGIT_CLASS = (
    "[\\p{Nd}\\x{00B2}\\x{00B3}\\x{00B9}\\x{2070}\\x{2074}-\\x{2079}\\x{2080}-\\x{2089}\\x{2460}-\\x{2468}]"
)
WS = "[\\t\\n\\x{0B}\\f\\r ]+"


def _class_escape(ch: str) -> str:
    if ch.isalnum() and ord(ch) < 128:
        return ch
    return "\\x{%04X}" % ord(ch)


ASCII_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PUNCT_CLASS = "[" + "".join(_class_escape(c) for c in ASCII_PUNCT + PUNCT_EXTRA) + "]"
SHORT_PUNCT_CLASS = "[" + "".join(_class_escape(c) for c in ASCII_PUNCT + "“’”—") + "]"


def strip_emoji(c: Column) -> Column:
    """Delete emoji code points (no space put in)."""
    return F.regexp_replace(c, EMOJI_CLASS, "")


def strip_punct(c: Column, cls: str = PUNCT_CLASS) -> Column:
    """Every punctuation character becomes one space."""
    return F.regexp_replace(c, cls, " ")


def strip_digits(c: Column) -> Column:
    """P5: delete every digit character (superscripts and circled digits too)."""
    return F.regexp_replace(c, DIGIT_CLASS, "")


def strip_newlines(c: Column) -> Column:
    """CRLF, CR, LF -> one space each, in this order."""
    return F.replace(F.replace(F.replace(c, F.lit("\r\n"), F.lit(" ")), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))


def split_contractions(c: Column) -> Column:
    # one pass over the text for all of them
    firsts = "|".join(f"{a}(?={b}\\b)" for a, b in CONTRACTIONS)
    return F.regexp_replace(c, f"(?i)\\b({firsts})", "$1 ")


def tokenize(c: Column) -> Column:
    """Whitespace tokens after contraction splitting; empty tokens dropped."""
    return F.filter(F.split(split_contractions(c), WS), lambda t: t != "")


def remove_stopwords(tokens: Column, stop=None) -> Column:
    """Drop stop words, exact case-sensitive match, repeats of other tokens kept."""
    words = list(dict.fromkeys(STOP_WORDS if stop is None else stop))
    # ``isin`` over literals becomes a hash-set lookup (InSet) in the optimizer
    return F.filter(tokens, lambda t: ~t.isin(*words))


def remap_tokens(c: Column, mapping: dict) -> Column:
    """Replace whole space-separated tokens by a custom value."""
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.array_join(F.transform(F.split(c, " "), lambda t: F.coalesce(m[t], t)), " ")


def truncate_text(c: Column, n: int = 500) -> Column:
    """First n characters."""
    return F.substring(c, 1, n)


def token_length(c: Column, max_len: int = 512) -> Column:
    """P20: whitespace token count + 2 special tokens, cut at max_len."""
    return F.least(F.size(tokenize(c)) + F.lit(2), F.lit(max_len)).cast("long")


def ngrams(tokens: Column, lo: int, hi: int) -> Column:
    """M1: all n-grams of length lo..hi joined by a space, ordered by n then position.

    ``tokens`` must be a column reference (project the token array first): a lambda that
    names a computed expression re-evaluates it for every element.
    """
    def grams(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(tokens) + 1), lambda i: i <= F.size(tokens) - n + 1)
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))

    parts = [grams(n) for n in range(lo, hi + 1)]
    return parts[0] if len(parts) == 1 else F.flatten(F.array(*parts))


def clean_tokens(c: Column) -> Column:
    """P2 -> P3 -> P4 -> P5 -> P7 -> P8: tokens ready for lemmatisation."""
    return remove_stopwords(tokenize(strip_digits(F.lower(strip_punct(strip_emoji(c))))))


def clean_tokens_v2(c: Column) -> Column:
    """P11 order up to the lemmas: P3 (short list) -> P2 -> P5 -> P7 -> P8; lower-casing comes after the lemmatiser."""
    return remove_stopwords(tokenize(strip_digits(strip_emoji(strip_punct(c, SHORT_PUNCT_CLASS)))))


# ---------------------------------------------------------------- DuckDB oracle text
def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


def sql_strip_emoji(x: str) -> str:
    return f"regexp_replace({x}, {_q(EMOJI_CLASS)}, '', 'g')"


def sql_strip_punct(x: str, cls: str = PUNCT_CLASS) -> str:
    return f"regexp_replace({x}, {_q(cls)}, ' ', 'g')"


def sql_strip_digits(x: str) -> str:
    return f"regexp_replace({x}, {_q(DIGIT_CLASS)}, '', 'g')"


def sql_tokenize(x: str) -> str:
    for a, b in CONTRACTIONS:
        x = f"regexp_replace({x}, {_q('(?i)' + chr(92) + 'b(' + a + ')(' + b + ')' + chr(92) + 'b')}, '\\1 \\2', 'g')"
    return f"list_filter(regexp_split_to_array({x}, {_q(WS)}), lambda t: t <> '')"


def sql_remove_stopwords(tokens: str, stop=None) -> str:
    return f"list_filter({tokens}, lambda t: NOT list_contains({sql_list(STOP_WORDS if stop is None else stop)}, t))"


def sql_clean_tokens(x: str) -> str:
    return sql_remove_stopwords(sql_tokenize(sql_strip_digits(f"lower({sql_strip_punct(sql_strip_emoji(x))})")))


def sql_clean_tokens_v2(x: str) -> str:
    return sql_remove_stopwords(sql_tokenize(sql_strip_digits(sql_strip_emoji(sql_strip_punct(x, SHORT_PUNCT_CLASS)))))
