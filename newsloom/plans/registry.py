"""Registry of named queries: a Spark builder and, where SQL can say it, a DuckDB oracle.

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the given tables.
Float columns are rounded to 4 places at the edge (both sides), so that different
summation orders cannot change the compared values.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def round_floats(df: DataFrame, places: int = 4) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def bigint_counts(sql: str) -> str:
    """DuckDB's ``count_if`` is HUGEINT; wrap every call in a BIGINT cast (Spark's type)."""
    out, i, tag = [], 0, "count_if("
    while True:
        j = sql.find(tag, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(tag) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k + 1] + " AS BIGINT)")
        i = k + 1


def query(name: str, sql: str | None = None, rounded: bool = True):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with an optional oracle."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return round_floats(df) if rounded else df

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = bigint_counts(sql)
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from newsloom.plans import q_agg, q_clean, q_core, q_feat, q_graph, q_io, q_model, q_order, q_topic, q_vec  # noqa: F401
