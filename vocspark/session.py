"""SparkSession helpers.

Cluster settings win: we only fill in values that are unset, so a job submitted
to a real cluster keeps its own shuffle partitions, checkpoint folder, etc.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "vocspark",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    if master or not os.environ.get("SPARK_MASTER"):
        b = b.master(master or "local[*]")
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("VOC_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder.

    On a cluster the operator sets ``spark.checkpoint.dir`` to a shared
    (HDFS/S3/...) path and we use it as is. Only a local session (tests) may
    leave it unset and gets a scratch folder; on a cluster that is an error, as
    executors would each write to a disk of their own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="vocspark-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint (never localCheckpoint): survives executor loss."""
    spark = spark or df.sparkSession
    checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def written(df):
    """df written once as Parquet under the checkpoint folder, and read back. An eager checkpoint runs the plan of
    df twice, once to count and once to write: too dear where df takes texts apart."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/vocspark-written/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df):
    """df over at least as many partitions as the session has cores.

    For text-heavy work and iterative fits on inputs of fewer file splits than that; larger inputs
    come back as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def cut_and_spread(df):
    """`cut_lineage`, over at least as many partitions as the session has cores. The plan of df runs once:
    asking a frame with shuffles for its partitions, as `spread` does, would run them beforehand."""
    x = cut_lineage(df)
    n = x.sparkSession.sparkContext.defaultParallelism
    return x if x.rdd.getNumPartitions() >= n else cut_lineage(x.repartition(n))
