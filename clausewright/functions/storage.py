"""Cutting the lineage of a plan at the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder under /tmp where a local session, as in tests, has none."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        context.setCheckpointDir(folder or "/tmp/checkpoints")
    return str(spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again. Unlike a checkpoint's, its size is known to the planner, which can then see whether a side is small enough to be broadcast."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)
