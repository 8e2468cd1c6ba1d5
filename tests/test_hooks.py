"""User hooks (Y2-Y6) and the sparse reader."""

import pandas as pd
from pyspark.sql import functions as F

from newsloom.operators import ordering as O
from newsloom.operators import topics as TP
from newsloom.sources import files


def test_encoder_loaded_once_per_task(spark):
    df = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))

    def factory():
        state = {"loads": 1}

        def model(pdf):
            return pd.DataFrame({"doc_id": pdf["doc_id"], "n": pdf["text"].str.len(), "loads": state["loads"]})

        return model

    out = TP.encode_with(df.repartition(2), factory, "text", "doc_id long, n long, loads long", batch_rows=3).collect()
    assert len(out) == 20 and {r.loads for r in out} == {1}
    assert {r.doc_id: r.n for r in out}[12] == 3


def test_apply_per_group(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], "g int, x double")
    out = TP.apply_per_group(df, ["g"], lambda pdf: pdf.assign(x=pdf.x - pdf.x.mean()), "g int, x double")
    assert sorted(r.x for r in out.collect()) == [-1.0, 0.0, 1.0]


def test_order_strategies_by_name(spark):
    df = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 0, 1), (1, 2, 1, 2)], "g int, doc_id long, topic int, topic_pos int")
    for name, fn in O.order_strategies().items():
        pos = sorted(r.order_pos for r in fn(df, ["g"]).collect())
        assert pos[0] in (0, 1) and len(pos) == 3, name


def test_read_sparse_vectors(spark, tmp_path):
    p = str(tmp_path / "coo")
    spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 1.0)], "doc int, term string, weight float").write.parquet(p)
    got = sorted(tuple(r) for r in files.read_sparse_vectors(spark, p).collect())
    assert got == [(1, "a", 0.5), (1, "b", 0.5), (2, "a", 1.0)]
