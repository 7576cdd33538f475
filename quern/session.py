"""Set-up that operators with kernels or several jobs need."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> None:
    """Put the package on the Python workers' path and give the context a checkpoint folder.

    The folder is the session's `spark.checkpoint.dir`; only a single-JVM session without that setting gets a temporary
    one, as a machine-local folder is not shared on a cluster.
    """
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(folder)


def spread(df: DataFrame, *keys: str, rows: int = 1024) -> DataFrame:
    """The rows dealt to several tasks for each core, `rows` to a task at most, by keys if there are any. For tables whose rows each
    become thousands: a file of a megabyte is one partition, however much is made of it."""
    n = df.count()
    tasks = max(1, min(4 * df.sparkSession.sparkContext.defaultParallelism, n // 8), -(-n // rows))
    return df.repartition(tasks, *keys)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back, which ends its lineage."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/quern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
