"""Shared storage for intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where it is unset in a local session (tests) a temporary folder is
    made; on a cluster that is an error, as executors share no local folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="faultline-"))
        configured = sc.getCheckpointDir()
    return configured.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/faultline/{name}-{uuid.uuid4().hex}"


#: Shuffle partitions behind one file of a table of narrow rows, where that is more files than cores.
FILE_PARTITIONS = 16


def materialize(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` once and read it back.

    For a result with several consumers: the work behind it runs once, a lost
    executor costs no recomputation of it, and later scans prune columns.

    ``narrow``: the rows are a few numbers, so they are dealt out once more, to as many files as there
    are cores. A file costs an executor several processes (Hadoop without its native library runs chmod for
    each file, checksum and folder), and a process just forked shares all memory of its executor.
    """
    spark = df.sparkSession
    if narrow:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(max(spark.sparkContext.defaultParallelism, parts // FILE_PARTITIONS))
    path = new_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Between large steps: the shuffle files of finished jobs stay on disk until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
