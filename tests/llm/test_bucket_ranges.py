"""Postings of a bucket of the n-gram join, a range of tokens at a time."""

from collections import Counter

import numpy as np

from newsloom.llm import ngram_join


def test_shared_tokens_of_a_bucket_come_in_ranges(monkeypatch):
    monkeypatch.setattr(ngram_join, "RANGE_TOKENS", 16)
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(1, 2**63, 300, dtype=np.uint64) << np.uint64(1))
    sets = [np.sort(rng.choice(pool, rng.integers(1, 60), replace=False)) for _ in range(30)]
    cls = [int(x) for x in rng.integers(1, 2**62, 30)]
    blobs = [b for part in (slice(0, 12), slice(12, 30)) for b in ngram_join._blobs(cls[part], sets[part], 1)]
    batches = list(ngram_join._shared_in_bucket([r for b in blobs for r in b.to_pylist()], ngram_join._step(1)))
    short = [[int(t) >> (64 - ngram_join.TOKEN_BITS) for t in s] for s in sets]
    seen = Counter(t for s in short for t in s)
    want = {(c, len(s), t) for c, s in zip(cls, short) for t in s if seen[t] > 1}
    assert len(batches) > 4
    assert {(r["cls"], r["n"], r["token"]) for b in batches for r in b.to_pylist()} == want
