"""Git history as a data source: a task for each file, or for each range of a file's lines, runs git and gives its rows.

    register(spark)
    spark.read.format("git_log").option("repo", "/shared/repo").option("files", '["src/a.py"]').option("days", 14).load()
    spark.read.format("git_blame").option("repo", "/shared/repo").option("file", "src/a.py").option("lines", 5000).load()

The repository has to be in a folder that all executors reach. A file that git doesn't know, or a call that takes over TIMEOUT seconds,
gives no rows."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COMMIT = "file_path string, commit_hash string, author_email string, commit_timestamp string, commit_message string"
BLAMED = "line_number bigint, commit_hash string, author_email string, line string"
TIMEOUT = 15
#: Lines of a file that a task blames, unless the option says otherwise.
LINES = 2_000


def git(repo: str, *args: str) -> str:
    try:
        return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, errors="replace", timeout=TIMEOUT, check=True).stdout
    except (subprocess.SubprocessError, OSError):
        return ""


def log_rows(repo: str, file: str, days: int | None) -> Iterator[tuple]:
    """COMMIT rows of a file's history, renames followed, newest first."""
    since = [f"--since={days} days ago"] if days is not None else []
    for line in git(repo, "log", "--follow", *since, "--format=%H%x1f%ae%x1f%ai%x1f%s", "--", file).split("\n"):
        if line:
            yield (file, *line.split("\x1f", 3))


def blame_rows(repo: str, file: str, first: int, last: int) -> Iterator[tuple]:
    """BLAMED rows of a range of a file's lines."""
    commit, mail, number = "", "", 0
    for line in git(repo, "blame", "-L", f"{first},{last}", "--line-porcelain", "--", file).split("\n"):
        head = line.split(" ")
        if len(head) >= 3 and len(head[0]) == 40 and not line.startswith("\t"):
            commit, number = head[0], int(head[2])
        elif line.startswith("author-mail "):
            mail = line.removeprefix("author-mail ").strip("<>")
        elif line.startswith("\t"):
            yield number, commit, mail, line[1:]


class _Log(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.files = options["repo"], json.loads(options["files"])
        self.days = int(options["days"]) if "days" in options else None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            yield from log_rows(self.repo, partition.value, self.days)


class _Blame(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.file = options["repo"], options["file"]
        self.first, self.last, self.lines = int(options.get("first", 1)), int(options["last"]) if "last" in options else None, int(options.get("lines", LINES))

    def partitions(self) -> list[InputPartition]:
        """Ranges of the file as it stands in HEAD."""
        n = git(self.repo, "show", f"HEAD:./{self.file}").count("\n") + 1
        last = min(n, self.last or n)
        return [InputPartition((a, min(a + self.lines - 1, last))) for a in range(self.first, last + 1, self.lines)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            yield from blame_rows(self.repo, self.file, *partition.value)


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return COMMIT

    def reader(self, schema) -> DataSourceReader:
        return _Log(dict(self.options))


class GitBlame(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_blame"

    def schema(self) -> str:
        return BLAMED

    def reader(self, schema) -> DataSourceReader:
        return _Blame(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (GitLog, GitBlame):
        spark.dataSource.register(source)
