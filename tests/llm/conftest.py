import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    def build(rows, schema):
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def clashing():
    """Adds columns named like the operators' own inner columns."""

    def add(df):
        from pyspark.sql import functions as F

        for name in ("cls", "token", "rid", "_gone", "_id", "_th", "_spans", "_rid", "_hit", "id", "n", "kept", "score", "row", "w", "items", "p", "shard", "tie"):
            df = df.withColumn(name, F.lit("x"))
        return df

    return add
