"""N-gram Jaccard join and vector join against brute force."""

import random
import re

import numpy as np

from newsloom.llm.base import components
from newsloom.llm.ngram_join import ngram_jaccard_join
from newsloom.llm.vector_join import vector_near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_join(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(ids, links)
    return {i: (len(sets[i]), root[i]) for i in ids}


def as_dict(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_join_equals_brute_force_on_edited_copies_and_shared_passages(make, clashing):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=60)
    texts, n = {}, 0
    for base in range(12):
        words = rng.choices(vocab, k=rng.choice([4, 5, 9, 40, 90]))
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts[n] = " ".join(copy)
            n += 1
    for k in range(40):  # documents that mostly consist of one common passage
        texts[n] = " ".join(passage + rng.choices(vocab, k=rng.choice([0, 3, 8, 14, 15, 16, 30])))
        n += 1
    texts |= {n: None, n + 1: "", n + 2: " \t\n", n + 3: "One", n + 4: "one", n + 5: "one two", n + 6: "x\x0by\x0cz"}
    df = make(list(texts.items()), "doc_id long, text string").repartition(5)
    assert as_dict(ngram_jaccard_join(clashing(df))) == brute_join(texts)


def test_join_with_repeated_rows_null_ids_and_no_rows(make):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (9, "A B C D E F"), (None, "a b c d e f"), (None, "p q r s t u")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(make(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (9, 2, 5), (None, 2, 5), (None, 2, None)], key=str)
    assert ngram_jaccard_join(make([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain_and_a_star(make):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    got = {r.node: r.root for r in components(make(chain + star + [(5, 5)], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}


def brute_vectors(rows, threshold=0.93):
    ok = [(i, np.array(v, np.float64), k) for i, v, k in rows if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for p, (i, v, k) in enumerate(ok):
        for j, w, m in ok[p + 1:]:
            if k == m and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold:
                links.append((i, j))
    root = roots([i for i, _, _ in rows], links)
    return {i: (sum(i in x for x in links), root[i], root[i] == i) for i, _, _ in rows}


def test_vectors_equal_brute_force(make, clashing):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for d in (1, 3, 64):
        for _ in range(12):
            base = rng.normal(size=d)
            for _ in range(6):
                v = base * rng.uniform(0.1, 9) + rng.normal(size=d) * rng.choice([0, 0.1, 0.25, 0.4])
                rows.append((n, [float(np.float32(x)) for x in v], int(rng.integers(3))))
                n += 1
    copy = rows[70][1]
    rows += [(n, None, 1), (n + 1, [0.0] * 64, 1), (n + 2, [float("nan")] * 64, 1), (n + 3, [float("inf")] * 3, 1), (n + 4, [None, 1.0, 2.0], 1), (n + 5, [], 1),
             (n + 6, copy, None), (n + 7, copy, 2), (n + 8, copy, 2), (n + 9, copy, 2)]
    df = make(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_near_duplicates(clashing(df)).collect()}
    assert got == brute_vectors(rows)


def test_no_vectors(make):
    assert vector_near_duplicates(make([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_rows_of_shared_tokens_do_not_grow_with_the_buckets(spark):
    from newsloom.llm import ngram_join

    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{words} tail{i}") for i in range(6)], "doc_id long, text string")
    few, many = (sorted(ngram_join.shared_tokens(docs, 5, b).collect()) for b in (2, 64))
    assert few == many and len(set(few)) == 6 * 56  # six classes share 56 shingles; a list per class and bucket before
