"""A data source of commits: format("gitlog"), one partition for each repository below a folder."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomgraph.operators.commits import COMMIT


class _Repository(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def parse_log(repo: str, text: str) -> list[tuple]:
    """Rows of the output of git log in the format that read() asks for."""
    import re

    rows = []
    for record in text.split("\x1e")[1:]:
        head, _, files = record.partition("\x1d")
        commit, author, time, message = head.split("\x1f", 3)
        rows.append((repo, commit, message.strip(), int(time), author, sorted({f for f in files.split("\n") if f}), re.findall(r"#(\d+)", message)))
    return rows


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[_Repository]:
        return [_Repository(os.path.join(self.root, d)) for d in sorted(os.listdir(self.root)) if os.path.exists(os.path.join(self.root, d, ".git"))]

    def read(self, partition: _Repository):
        done = subprocess.run(["git", "-c", "safe.directory=*", "-C", partition.path, "log", "--all", "-m", "--root", "--name-only", "--no-renames", "--format=%x1e%H%x1f%an%x1f%at%x1f%B%x1d"], capture_output=True, text=True, errors="replace")
        seen: dict[str, tuple] = {}
        for row in parse_log(os.path.basename(partition.path), done.stdout if done.returncode == 0 else ""):
            old = seen.get(row[1])  # a merge has a record for each parent
            seen[row[1]] = row if old is None else (*row[:5], sorted({*old[5], *row[5]}), row[6])
        yield from seen.values()


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return COMMIT

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def read_commits(spark: SparkSession, root: str) -> DataFrame:
    """Commits of the repositories below root, which all executors have to see."""
    spark.dataSource.register(GitLog)
    return spark.read.format("gitlog").load(root)
