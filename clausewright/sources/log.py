"""An append-only log of numbered commits in one folder.

An append writes its rows under a name of their own and then puts a manifest `_commits/<number>.json` that names them, which must not
exist yet. Rows without a manifest, those of an append that failed or is under way, aren't part of the log; two writers can't take
one number, and the second takes the next. A row's place is its commit's number and its position in the commit, so a log is read in
the order in which it was written, however many files it has. A log from elsewhere, a file or folder of JSON lines, is read in the
order of its files, as commit 0. Manifests are metadata: one small file for each append."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS, FOLDER, POSITION = "_commits", "commit-", "_pos"
#: A local file system creates a file in two steps; writers of one process take turns.
_TURN = threading.Lock()


class Conflict(Exception):
    """Another writer has taken the number."""


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all commits."""
    folder, files = _files(spark, f"{path}/{COMMITS}")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def _publish(spark: SparkSession, path: str, number: int, name: str) -> None:
    target, files = _files(spark, f"{path}/{COMMITS}/{number:020d}.json")
    with _TURN:
        try:
            out = files.create(target, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or files.exists(target):
                raise Conflict(f"{path}: commit {number} is taken") from None
            raise
        out.write(bytearray(json.dumps({"folder": name}).encode()))
        out.close()


def append(rows: DataFrame, path: str, order: list[Column | str] | None = None, after: int | None = None) -> int:
    """Appends the rows, in that order or else as they come, as one commit and returns its number. With `after` it must be the next one: Conflict if another writer was faster."""
    spark = rows.sparkSession
    here, files = _files(spark, path)
    if files.exists(here) and files.getFileStatus(here).isFile():
        raise ValueError(f"{path} is a file; a log is a folder, move the file into one")
    name = f"{FOLDER}{uuid.uuid4().hex}"
    (rows.orderBy(*order) if order else rows).withColumn(POSITION, F.monotonically_increasing_id()).write.json(f"{path}/{name}")
    number = (max(commits(spark, path), default=0) if after is None else after) + 1
    while True:
        try:
            _publish(spark, path, number, name)
            return number
        except Conflict:
            if after is not None:
                folder, files = _files(spark, f"{path}/{name}")
                files.delete(folder, True)
                raise
            number += 1


def read(spark: SparkSession, path: str, schema: str, parse: Callable[[SparkSession, str | list[str], str], DataFrame], upto: int | None = None) -> DataFrame:
    """The rows of the log, with their place as log_pos, which sorts as they were written; up to that commit, if given. parse(spark, paths, schema) reads JSON lines."""
    here, files = _files(spark, path)
    found = {}
    for number in commits(spark, path):
        if upto is None or number <= upto:
            stream = files.open(_files(spark, f"{path}/{COMMITS}/{number:020d}.json")[0])
            found[json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))["folder"]] = number
            stream.close()
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    place = lambda commit, file, block, pos: F.struct(commit.cast("bigint").alias("commit"), file.alias("file"), block.cast("bigint").alias("block"), pos.cast("bigint").alias("pos")).alias("log_pos")
    parts = []
    if files.exists(here) and (files.getFileStatus(here).isFile() or any(s.isFile() and s.getPath().getName()[0] not in "._" for s in files.listStatus(here))):
        parts.append(parse(spark, path, schema).select("*", place(F.lit(0), file, block, F.monotonically_increasing_id())))
    if found:
        numbers = spark.createDataFrame(list(found.items()), "_folder string, _commit bigint")
        rows = parse(spark, [f"{path}/{name}" for name in found], f"{schema}, {POSITION} bigint").withColumn("_folder", F.regexp_extract(file, f"/({FOLDER}[0-9a-f]+)/", 1))
        # One row a commit.
        rows = rows.join(F.broadcast(numbers), "_folder").withColumn("log_pos", place(F.col("_commit"), F.lit(""), F.lit(0), F.col(POSITION)))
        parts.append(rows.drop("_folder", "_commit", POSITION))
    if not parts:
        return spark.createDataFrame([], f"{schema}, log_pos struct<commit:bigint,file:string,block:bigint,pos:bigint>")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
