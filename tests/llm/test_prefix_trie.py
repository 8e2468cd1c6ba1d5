"""Prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from newsloom.llm import prefix_trie

CONV = "conv_id long, turn long, role string, text string, node string, c string, d string, parent string, size string"


def brute(rows):
    seq = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            seq.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    seq = {c: [x[2:] for x in sorted(v)] for c, v in seq.items()}
    nodes, out = {}, {}
    for c, own in seq.items():
        h = zlib.crc32(str(c).encode()) % 9
        s = seq.get(c - c % 5, [])[:h] + own[h:]
        for d in range(len(s) + 1):
            n = nodes.setdefault(tuple(s[:d]), {"members": [], "ends": [], "kids": set()})
            n["members"].append(c)
            if d == len(s):
                n["ends"].append(c)
            if d:
                nodes[tuple(s[:d - 1])]["kids"].add(tuple(s[:d]))
    total = {}
    for p in sorted(nodes, key=len, reverse=True):
        n = nodes[p]
        leaves = sum(total[k][0] for k in n["kids"]) if n["kids"] else 1
        saved = sum(total[k][1] for k in n["kids"]) + ((len(n["members"]) - 1) * len(p[-1][1].encode()) if p else 0)
        total[p] = leaves, saved
    for p, n in nodes.items():
        parent = min(nodes[p[:-1]]["members"]) if p else None
        ends = hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest()
        row = (min(n["members"]), len(p), parent, len(n["members"]), len(n["kids"]), *total[p], ends)
        out[row] = out.get(row, 0) + 1
    return out


def result(df):
    out = {}
    for r in df.collect():
        k = (r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
        out[k] = out.get(k, 0) + 1
    return out


def frame(make, rows, parts=4):
    return make([(*r, "n", "c", "d", "p", "s") for r in rows], CONV).repartition(parts)


def fixture(convs=60):
    rng = random.Random(4)
    rows = []
    for c in rng.sample(range(200), convs):
        turns = rng.choice([1, 2, 3, 6, 9])
        for t in range(turns):
            rows.append((c, t, rng.choice(["user", "assistant", None]) if t % 3 == 2 else "user", rng.choice(["a", "bb", "éé", None, ""]) if t > 1 else "hi"))
    rows += [(300, t, "user", f"long {t}") for t in range(40)] + [(301, t, "user", f"long {t}") for t in range(37)]  # a chain
    rows += [(302, 0, "user", "hi"), (302, 0, "assistant", "hi"), (302, None, "user", "first"), (302, 5, "x", "same"), (302, 5, "x", "same")]
    rows += [(None, 0, "user", "hi"), (1000, 0, "user", "hi"), (10**12, 3, None, None), (305, 0, "u", "w " * 300_000)]
    return rows


@pytest.mark.parametrize("part, share, piece", [(1000, 200, 1 << 16), (3, 2, 4)])
def test_equals_brute_force(make, monkeypatch, part, share, piece):
    monkeypatch.setattr(prefix_trie, "PART", part)
    monkeypatch.setattr(prefix_trie, "SHARE", share)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows = fixture()
    assert result(prefix_trie.trie(frame(make, rows))) == brute(rows)


def test_one_conversation_many_times_and_turnless_ones(make):
    # all but the multiples of five have one turn, which a head of a missing conversation may replace by nothing
    rows = [(c, 0, "user", "same") for c in range(400) if c % 5] + [(c, 1, "assistant", "too") for c in range(0, 400, 7) if c % 5]
    expect = brute(rows)
    assert result(prefix_trie.trie(frame(make, rows))) == expect
    root = next(k for k in expect if k[1] == 0)
    assert root[7] != prefix_trie.EMPTY


def test_no_conversation(make):
    assert prefix_trie.trie(frame(make, [])).collect() == []
    assert prefix_trie.trie(frame(make, [(None, 0, "user", "x")])).collect() == []


def test_subtree_totals_of_random_trees(make):
    rng = random.Random(8)
    n = 300
    parent = [None] + [max(0, i - rng.choice([1, 1, 1, 1, 2, 30])) for i in range(1, n)]
    value = [rng.randrange(10) for _ in range(n)]
    expect = value[:]
    for i in range(n - 1, 0, -1):
        expect[parent[i]] += expect[i]
    tree = make(list(zip(range(n), parent, value)), "node long, parent long, v long")
    assert {r.node: r.v for r in prefix_trie.subtree_totals(tree, ["v"]).collect()} == dict(enumerate(expect))
