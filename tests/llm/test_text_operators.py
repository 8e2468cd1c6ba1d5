"""Decontamination, personal data, sharding and BPE against brute force, the library and round trips."""

import hashlib
import random
import re
import zlib

import public_tokenizers
from pyspark.sql import functions as F

from newsloom.llm import bpe, decontaminate, pii, sharding

DOCS = "doc_id long, text string, n_chars long"
TOKENS = public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_report(docs, items):
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            n = min(13, len(b))
            wins = {tuple(b[k:k + n]) for k in range(len(b) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k:k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination_equals_brute_force_by_set_and_by_join(make, clashing, monkeypatch):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)] + ["É", "ñandú", "x1"]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([1, 5, 13, 20])))) for k in range(15)] + [(90, None), (91, "--"), (3, "w1 w2")]
    docs = [(i, "; ".join([*rng.choices(vocab, k=rng.randrange(60)), rng.choice(items)[1] or "", "Tail"]).upper()) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "... !!")]
    df = clashing(make([(i, t, 1) for i, t in docs], DOCS).repartition(4))
    bench = make(items, "item_id long, text string")
    expect = brute_report(docs, items)
    for limit in (decontaminate.MAX_SET, 0):
        monkeypatch.setattr(decontaminate, "MAX_SET", limit)
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(df, bench).collect()}
        assert got == expect
    kept = decontaminate.decontaminate(df, bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, v in expect.items() if not v[4]} and kept.columns == df.columns


def test_spans_are_cut_and_empty_tables_work(make):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = make([(1, f"Foo, {item.upper()}! bar", 9), (2, None, 9), (3, "«clean»", 9)], DOCS)
    got = {r.doc_id: (r.text, r.n_chars) for r in decontaminate.decontaminate(docs, make([(1, item)], "item_id long, text string"), "spans").collect()}
    assert got == {1: ("Foo, bar", 8), 2: (None, 9), 3: ("«clean»", 9)}
    none = make([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.report(docs, none).collect()] == [False] * 3
    assert decontaminate.report(make([], DOCS), none).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((k, m.start(), m.end()))
    return out


def test_personal_data_seeds_equal_the_patterns(make, clashing):
    rng = random.Random(3)
    parts = ["a", "b1", ".", "@", "x.com", "-", "_", "%", "1", "22", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "1.2.3.999", " ", "+1 ", "(555) 123-4567", "é", "😀", "+", "\n"]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randrange(25))) for i in range(400)}
    texts |= {900: None, 901: "", 902: "1" * 5000, 903: "1 " * 3000 + "a." * 3000 + "@b.c", 904: "a@b.c_d@e.f.g@h.i " * 200}
    df = clashing(make(list(texts.items()), "doc_id long, text string"))
    got = {r.doc_id: [(x.k, x.s, x.e) for x in r.base] for r in pii.personal_data(df).collect()}
    assert got == {i: brute_spans(t) for i, t in texts.items()}


def test_context_discovers_unseen_identifiers_only_behind_sure_patterns(make):
    rows = [(i, f"text customer-ref: a{i}@b.com and then", 0) for i in range(30)] + [(100 + i, f"foo customer-ref: ZX-{1000 + i} bar", 0) for i in range(3)]
    rows += [(200, "foo the ZZ-99999 bar", 0), (None, "foo customer-ref: QQ-5555", 0)]
    df = make(rows + rows[:1], DOCS)
    spans = {r.doc_id: [(x.k, x.s, x.e) for x in r.spans] for r in pii.personal_data(df).collect()}
    assert spans[100] == [(0, 18, 25)] and spans[None] == [(0, 18, 25)] and spans[200] == [] and spans[0] == [(0, 19, 27)]
    out = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(df).collect()}
    assert out[101] == ("foo customer-ref: [EMAIL] bar", 29) and out[200] == ("foo the ZZ-99999 bar", 0)
    assert pii.personal_data(make([], DOCS)).count() == 0


def test_an_accepted_value_is_a_span_only_behind_its_pattern(make):
    rows = [(i, f"text customer-ref: a{i}@b.com and then", 0) for i in range(30)] + [(100, "foo customer-ref: 2020 bar", 0), (200, "it was in 2020 indeed", 0)]
    spans = {r.doc_id: [(x.k, x.s, x.e) for x in r.spans] for r in pii.personal_data(make(rows, DOCS)).collect()}
    assert spans[100] == [(0, 18, 22)] and spans[200] == []


def test_identifiers_in_groups_without_digits_and_behind_any_script(make):
    after = ["(555) 867-5309", "1234 5678 9012 3456", "jane.doe@localhost", "@jane_doe", "ZX-1000", "+1 (555) 12", "jane.doe"]
    rows = [(i, f"text customer-ref: a{i}@b.com and then", 0) for i in range(60)] + [(100 + i, f"foo customer-ref: {x} bar", 0) for i, x in enumerate(after)]
    rows += [(300 + i, f"и почта: b{i}@b.com и", 0) for i in range(30)] + [(400, "и почта: ZX-1000, и", 0), (401, "end. Next (see 12) x", 0), (402, "foo customer-ref: ZX-1000 c@d.com", 0)]
    out = {r.doc_id: r.text for r in pii.redact(make(rows, DOCS)).collect()}
    assert [out[100 + i] for i in range(len(after))] == ["foo customer-ref: [EMAIL] bar"] * len(after)
    assert out[400] == "и почта: [EMAIL], и" and out[401] == "end. Next (see 12) x" and out[402] == "foo customer-ref: [EMAIL] [EMAIL]"
    long = {1: "1 " * 6000, 2: "(5) " * 6000, 3: "a." * 9000, 4: "a@" * 9000, 5: "a-" * 9000 + "1"}
    assert pii.found(make([(i, t, 0) for i, t in long.items()], DOCS)).count() == 5
    assert all(len(r.other) <= 9000 for r in pii.found(make([(i, t, 0) for i, t in long.items()], DOCS)).collect())


def test_permutation_and_its_inverse(spark):
    for n in (1, 2, 3, 7, 1000, 4097):
        rows = spark.range(n).select("id", sharding.permuted(F.col("id"), n, 7).alias("p"))
        rows = rows.select("id", "p", sharding.permuted(F.col("p"), n, 7, inverse=True).alias("back")).collect()
        assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_shards_are_even_gapless_and_computable(make, clashing):
    texts = [(i, f"t{i % 9}" * (i % 5), 0) for i in range(203)] + [(None, None, 0), (None, "é", 0), (3, "again", 0), (3, "again", 0)]
    rows = sharding.shard_rows(clashing(make(texts, DOCS).repartition(6)), shards=8, seed=1)
    got = rows.withColumn("back", sharding.row_number_of(F.col("shard"), F.col("slot"), len(texts), 8, 1)).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(texts) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and all(r.back == r.row for r in got)
    expect = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in texts)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == expect
    again = sharding.shard_rows(make(texts, DOCS).repartition(2), shards=8, seed=1)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    assert sharding.shard_rows(make([], DOCS)).count() == 0


def test_bpe_equals_the_library(make, clashing):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    letters = "aAbB'sStT re ll vm dΣσİ\x1c\x1f\x85\xa0​<|startoftext|>  \n\t0129٣½²ⅷééß漢字かな😀👩‍🔬!!..??--__$$ aaaa xxxx"
    parts = ["<|startoftext|>", "<|endoftext|>", "<|startof", "'s", "'ll", "'RE"]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.1 else rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(800)]
    texts += [None, "", "   ", "a" * 5000, "!" * 3000, "ab" * 2000, "<|endoftext|>", "The quick brown fox"]
    df = clashing(make(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: (bytes(r.ids), r.decoded) for r in bpe.decode(bpe.encode(df, TOKENS), TOKENS).collect()}
    lib = Tokenizer.from_file(TOKENS)
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (b"".join(x.to_bytes(4, "little") for x in ids), lib.decode(ids, skip_special_tokens=False)), t
    digest = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bpe.digests(df, TOKENS).collect()}
    assert all(digest[i] == (len(b) // 4, hashlib.sha256(b).hexdigest()) for i, (b, _) in got.items())
    assert bpe.digests(make([], DOCS), TOKENS).count() == 0
