"""Results do not depend on the name of the input folder."""

import os

from conftest import SF001

import __spark_entry__ as entry


def test_same_rows_under_another_folder_name(spark, tmp_path):
    other = tmp_path / "prod"
    os.symlink(SF001, other)
    for name in ("v08_cosine_pairs", "p19_outlier_docs", "t5_graph_dataset"):
        a, b = (sorted(map(str, entry.queries()[name](spark, d).collect())) for d in (SF001, str(other)))
        assert a == b and (a or name == "t5_graph_dataset")
