"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "newsloom") -> SparkSession:
    """A local session for tests and benchmarks (UI off, UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("NEWSLOOM_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; create a scratch one only when none is set.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is.
    A local folder is made only for local runs (tests) where nothing is configured.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for iterative operators")
    path = tempfile.mkdtemp(prefix="newsloom-ckpt-")
    sc.setCheckpointDir(path)
    return path


def spread(df, *keys: str):
    """Give CPU-heavy per-row work at least one partition per core.

    A large scan already has thousands of splits and is returned unchanged (no shuffle);
    a scan of a few big row groups is hash-partitioned by ``keys`` (round robin without).
    Reading the partition count plans the scan but runs nothing.
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)


def scratch_path(spark, name: str) -> str:
    """A fresh folder for intermediate files under the cluster's checkpoint folder (shared storage)."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{name}-{uuid.uuid4().hex[:12]}"


def table_of(df, name: str):
    """The rows written to the shared folder and read again: lineage ends, and size estimates start anew (a checkpoint keeps those of its plan)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def forget(*tables) -> None:
    """Takes back the folders of tables that ``table_of`` wrote; for rounds whose tables are written anew and read by nothing any more.

    The driver's collector runs once, as Spark clears the shuffle files of ended jobs when it finds them.
    """
    if tables:
        tables[0].sparkSession._jvm.System.gc()
    for t in tables:
        path = getattr(t, "_folder", None)
        if path:
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
