"""The pipeline on a small folder: each stage against a plain version of its rule."""

import os
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from newsloom.llm import quality

from .test_joins import brute_join
from .test_text_operators import brute_report, brute_spans


@pytest.fixture(scope="module")
def folder(spark, make, tmp_path_factory):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(80)]
    item = " ".join(rng.choices(vocab, k=20))
    rows = [(i, " ".join(rng.choices(vocab, k=60)), "en", "s", 0) for i in range(200)]
    rows += [(300 + i, rows[i][1] + " mail a@b.co", "en", "s", 0) for i in range(10)] + [(400, " ".join(rng.choices(vocab, k=20)) + " " + item, "de", "s", 0)]
    rows += [(500 + i, " ".join(str(rng.random()) for _ in range(40)), "en", "s", 0) for i in range(5)] + [(600, None, None, None, None), rows[0]]
    path = str(tmp_path_factory.mktemp("tables"))
    make(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    make([(i, int(i < 500), 0) for i, *_ in rows if i != 600], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    make([(7, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, folder)
        path = os.path.join(folder, f"out{k}.parquet")
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        rows = {r.doc_id: r for r in after.collect()}
        if name == "quality classifier":
            bad = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("NOT kept").collect()}
            assert set(rows) == {i for i, _ in before} - bad and {500, 504, 600} <= bad and len(bad) < 12
        elif name == "n-gram Jaccard join":
            brute = brute_join(dict(before))
            assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, (_, c) in brute.items() if i == c)
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert set(rows) == {i for i, v in brute_report(before, items).items() if not v[4]} and 400 not in rows
        elif name == "PII":
            assert set(rows) == {i for i, _ in before} and all(("@" not in rows[i].text) if brute_spans(t) else rows[i].text == t for i, t in before)
        else:
            assert set(rows) == {i for i, _ in before} and all(r.n_tokens * 4 == len(r.ids) for r in rows.values())
        docs = after
    assert spark.read.parquet(os.path.join(folder, "out4.parquet")).drop("ids").exceptAll(corpus_pipeline.run(spark, folder).drop("ids")).count() == 0


def test_every_operator_is_registered_once():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_rows_of_one_doc_id_or_of_none_go_by_their_own_content(spark, make, tmp_path):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(80)]
    text = lambda n=60: " ".join(rng.choices(vocab, k=n))
    item = text(20)
    trusted = [(i, text(), "en", "s", 0) for i in range(200)]
    clean = [(None, text(), "en", "s", 0) for _ in range(3)] + [(700, text(), "en", "s", 0) for _ in range(3)]
    bad = [(k, " ".join(str(rng.random()) for _ in range(40)), "en", "s", 0) for k in (None, 700)]
    dirty = [(k, text(10) + " " + item, "en", "s", 0) for k in (None, 700)]
    # copies: one with a smaller doc_id, two of a null doc_id, an exact one
    copies = [(5, clean[0][1], "en", "s", 0), clean[1], clean[3], (None, clean[4][1] + " end", "en", "s", 0)]
    folder = str(tmp_path)
    make([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    make([(7, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = make(trusted + clean + bad + dirty + copies, "doc_id long, text string, lang string, source string, n_chars long")
    first = corpus_pipeline.quality_classifier(spark, docs, folder)
    left = [(r.doc_id, r.text) for r in first.collect()]
    assert all(left.count(r[:2]) == (clean + copies).count(r) for r in clean) and not any(r[:2] in left for r in bad)
    second = corpus_pipeline.near_duplicates(spark, make(clean + copies, docs.schema), folder)
    want = [(5, clean[0][1]), clean[1][:2], clean[2][:2], clean[3][:2], clean[4][:2], clean[5][:2]]
    assert second.columns == docs.columns and sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in second.collect())
    third = corpus_pipeline.contamination(spark, make(clean + dirty, docs.schema), folder)
    assert sorted(str(r[:2]) for r in clean) == sorted(str((r.doc_id, r.text)) for r in third.collect())
