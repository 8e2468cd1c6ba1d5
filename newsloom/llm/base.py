"""Registry of the operator queries, session folders and the component search shared by the joins."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from typing import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with DuckDB SQL where that can say the same."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; one is made only for a local run that names none."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read from there: lineage ends, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Arrow batches of at most ``rows`` rows and about ``size`` bytes in this session: whole texts are long, and a batch is held several times over.

    Smaller bounds of the session stay as they are. The settings are read when a job runs, so they are not set back here.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key)
        now = int(now) if now.lstrip("-").isdigit() else most + 1
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Free memory of this process goes back to the system: objects no longer held, Arrow's pool and, where there is such a call, the allocator's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(fn):
    """The generator function ``fn`` for Arrow batches, whose worker gives its memory back when it ends: the worker lives on beside those of later stages."""

    @functools.wraps(fn)
    def run(*args):
        try:
            yield from fn(*args)
        finally:
            give_back()

    return run


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until they differ from all columns of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def _saved_with_signature(df: DataFrame):
    """``saved`` for edges, with their count and checksum taken while they are written."""
    seen = Observation()
    out = saved(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")))
    return out, (seen.get.get("n"), seen.get.get("sum"))


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``node, root`` (root: the smallest node) for every node in an edge.

    Large-star and small-star rounds: a number of rounds logarithmic in the longest path, each a few
    joins and pre-aggregated minima; no neighbour list is ever collected. Raises if it doesn't end.
    """
    cur, before = _saved_with_signature(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.where("m < u")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur, after = _saved_with_signature(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        if after == before:
            nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return nodes.union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = after
    raise RuntimeError("component search did not end")
