"""Tables and folders in storage that the driver and every executor share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that the driver and every executor can reach.

    It lies in ``spark.checkpoint.dir``. Where that is unset and all runs in one process (tests, a
    notebook) a folder of the local file system is set for the session; on a cluster it is an error.
    """
    return f"{_shared_root(spark)}/loomgraph/{purpose}-{uuid.uuid4().hex}"


def _shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints/loomgraph"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage of ``df`` with a table in the shared folder, which outlives lost executors.

    Nothing else reads the shuffles of the write, so their files go with it.
    """
    spark = df.sparkSession
    path, setting = shared_folder(spark, purpose), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`settle` that nothing reads any more."""
    for df in tables:
        drop_folder(df.sparkSession, df.folder)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder written by :func:`settle`."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
