"""Intermediate results in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir. Only a session in one process may do without: it has /tmp/checkpoints."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/lintmill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends there, and a lost executor costs nothing.

    The folder goes when the application ends, or with ``forget``.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["lintmill_path"] = path
    return out


def forget(*frames: DataFrame) -> None:
    """Remove what ``written`` wrote; only for frames that nothing reads any more."""
    for df in frames:
        if path := df.__dict__.get("lintmill_path"):
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)
