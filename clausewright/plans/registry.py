"""Where queries are registered, each with the SQL that says what it returns."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, for what a query writes and reads again."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        top = "/tmp/checkpoints"
    path = f"{str(top).rstrip('/')}/queries-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


def documents(spark: SparkSession) -> str:
    """A folder for small documents, which the driver alone writes and reads: one of its own where the shared one isn't a path of its file system."""
    import tempfile

    path = scratch(spark).removeprefix("file:")
    return path if Path(path).is_dir() else tempfile.mkdtemp(prefix="clausewright-")
