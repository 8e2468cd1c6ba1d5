"""A sample of registered queries against their DuckDB oracles on the smallest tables.

Only queries whose parameters do not depend on the scale factor are taken (the fixture's
topic size and thresholds are per scale; the full set is checked by tools/oracle_check.py).
"""

import duckdb
import pytest

import __spark_entry__ as E
from newsloom.sources.tables import TABLES
from tools.oracle_check import digest

SF = "/root/testdata/sf0.001"
SAMPLE = ["p10_preprocess", "m04_tfidf_cosine", "v07_pair_metrics", "v08_cosine_pairs", "h02_hilbert_decode",
          "w11_overlap_batches", "r03_stream_counts", "s09_parse_news_json", "k10_most_similar_each", "a06_size_class"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(sdf.columns) == sorted(ocols)
    assert len(srows) == len(orows) > 0
    assert digest(sdf.columns, srows)[0] == digest(ocols, orows)[0]
