"""Source divergence against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from newsloom.llm import source_divergence as sd

DOCS = "doc_id long, text string, lang string, source string, n long, term string, value string, rank string, block string, part string"


def brute(docs, min_docs=30, top=50):
    count, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        g = (lang or "", source or "")
        groups.add(g)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        count[g].update(words)
        df[g[0]].update(set(words))
    out = {}
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, k in df[lang].items() if k >= min_docs), key=lambda t: t.encode())
        of = {s: [count[lang, s][t] for t in kept] for la, s in groups if la == lang}
        share = {s: [1 + 10**9 * (c + 5) // (sum(v) + 5 * len(kept)) for c in v] for s, v in of.items()}
        total = [sum(v[i] for v in of.values()) for i in range(len(kept))]
        q = [1 + 10**9 * (c + 5) // (sum(total) + 5 * len(kept)) for c in total]
        for s in of:
            rows = sorted(((-sum(abs(a - b) for a, b in zip(share[s], share[o])), o.encode()) for o in of if o != s))
            rows_ = [(s, "pair", o.decode(), -f) for f, o in rows]
            hits = sorted((b - a, t.encode()) for a, b, t, n in zip(share[s], q, kept, of[s]) if n > 0 and a > b)
            rows_t = [(s, "term", t.decode(), -f) for f, t in hits][:top]
            for part in (rows_, rows_t):
                for r, x in enumerate(part):
                    out[(lang, x[0], x[1], x[2])] = (x[3], r + 1)
    return out


def rows_of(df):
    return {(r.lang, r.source, r.part, r.item): (r.value, r.rank) for r in df.collect()}


def fixture(n=600):
    rng = random.Random(3)
    vocab = [f"{c}{'x' * (k % 23)}{d}" for k, (c, d) in enumerate((a, b) for a in "abcdéß" for b in "klmnoñ漢")] + ["y" * 40, "Z" * 17, "q" * 16, "r" * 8, "r" * 9, "ÀÉ", "Àé"]
    docs = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "de", None, "xx"])
        source = rng.choice(["a", "a", "a", "b", "é", None, "~"]) if lang != "xx" else "only"
        words = rng.choices(vocab[: rng.choice([10, 25, len(vocab)])], k=rng.randrange(40))
        docs.append((rng.choice([" ", ", ", "1"]).join(rng.choice([w, w.upper()]) if w.isascii() else w for w in words) if rng.random() > 0.05 else None, lang, source))
    docs += [("", "empty", "s1"), (None, "empty", "s2"), ("12 34", "empty", "s3"), ("w" * 200_000 + " " + "ab " * 50_000, "en", "long")]
    return docs + docs[:5]


def frame(make, docs, parts=5):
    return make([(i, t, la, s, 1, "a", "b", "c", "d", "e") for i, (t, la, s) in enumerate(docs)], DOCS).repartition(parts)


def test_equals_brute_force_in_small_parts(make, monkeypatch):
    docs = fixture()
    expect = brute(docs)
    assert rows_of(sd.divergence(frame(make, docs))) == expect
    monkeypatch.setattr(sd, "FLUSH_TERMS", 200)
    monkeypatch.setattr(sd, "CELLS", 8)
    got = rows_of(sd.divergence(frame(make, docs, 2), part_rows=20))
    assert got == expect
    assert {k[2] for k in got} == {"pair", "term"} and ("empty", "s1", "pair", "s2") in got and not any(k[1] == "only" and k[2] == "pair" for k in got)


def test_one_source_with_most_rows_and_a_common_term(make):
    docs = [("hot hot cold", "en", "big")] * 2000 + [("cold hot", "en", f"s{i % 3}") for i in range(90)]
    assert rows_of(sd.divergence(frame(make, docs, 8), part_rows=1)) == brute(docs)


def test_empty_table(make):
    assert sd.divergence(make([], DOCS)).collect() == []


def test_radix_order_and_shares_are_exact():
    rng = np.random.default_rng(0)
    words = [rng.integers(0, 3, 5000).astype(np.uint64) << np.uint64(40), rng.integers(0, 2**63, 5000).astype(np.uint64) >> np.uint64(50), rng.integers(0, 2, 5000).astype(np.uint32)]
    assert (sd.radix_order(words) == np.lexsort(words[::-1])).all()
    count = np.array([0, 7, 10**10, 3 * 10**15, (1 << 32) + 1, 1 << 32])
    total = 10**16 + 12345
    assert sd.shares(count, total).tolist() == [1 + 10**9 * (int(c) + 5) // total for c in count]


def test_long_terms_share_a_bucket_with_others_of_their_class():
    text = b"a" * 17 + b" " + b"a" * 20 + b" " + b"a" * 17 + b" b"
    data = np.frombuffer(text, np.uint8)
    start, end = sd.term_places(data, np.array([0, len(text)]))
    zero = np.zeros(len(start), np.uint32)
    got = {t: (int(k), int(d)) for term, _, n, docs in sd.counted(data, start, end, zero, zero.astype(int)) for t, k, d in zip(term.to_pylist(), n, docs)}
    assert got == {"a" * 17: (2, 1), "a" * 20: (1, 1), "b": (1, 1)}
