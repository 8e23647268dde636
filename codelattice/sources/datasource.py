"""Version-control sources by name: spark.read.format("git_log").option("root", ...).load().

register(spark) makes git_log, git_tree and git_blobs known. Options: root; git_log also since and most; git_tree commit;
git_blobs ids, separated by commas.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.shipping import ship
from . import git

PART = 500


class _Reader(DataSourceReader):
    def __init__(self, rows):
        self.rows = rows

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.rows()


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return git.TOUCHES

    def reader(self, schema) -> DataSourceReader:
        o = dict(self.options)
        return _Reader(lambda: git.log_rows(o["root"], o.get("since"), int(o.get("most", 5000))))


class GitTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "path string, blob string"

    def reader(self, schema) -> DataSourceReader:
        o = dict(self.options)
        return _Reader(lambda: git.tree_rows(o["root"], o.get("commit", "HEAD")))


class _BlobReader(DataSourceReader):
    def __init__(self, root: str, ids: list[str]):
        self.root, self.ids = root, sorted(set(ids))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(0, len(self.ids), PART)] or [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        some = self.ids[partition.value : partition.value + PART]
        yield from zip(some, git.contents(self.root, some))


class GitBlobs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_blobs"

    def schema(self) -> str:
        return "blob string, content binary"

    def reader(self, schema) -> DataSourceReader:
        o = dict(self.options)
        return _BlobReader(o["root"], [x for x in o.get("ids", "").split(",") if x])


def register(spark: SparkSession) -> None:
    ship(spark)
    for source in (GitLog, GitTree, GitBlobs):
        spark.dataSource.register(source)
