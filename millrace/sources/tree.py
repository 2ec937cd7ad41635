"""A source tree as a data source of Spark: batches with pushed suffixes, and a stream of files as they change.

Spark's own file sources leave out whatever begins with a dot or an underscore, and so every __init__.py. This one lists a folder that
driver and executors both see, deals the files over partitions by their size, and reads them as text: UTF-8 without what
isn't, line ends as \\n. Conditions on the suffix reach the listing, if spark.sql.python.filterPushdown.enabled is on (`source_tree`
sees to that, or says the suffixes by an option); files of other suffixes are never opened. Links to folders aren't followed.

    source_tree(spark, "/data/tree").filter("suffix in ('.py', '.md')")
    spark.readStream.format("millrace_tree").load("/data/tree")

A stream's offset is the time and the path of the last file that was taken: a file that is written again later comes again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

NAME = "millrace_tree"
SCHEMA = "path string, suffix string, size long, text string"
#: Bytes of files in a partition, about; a larger file is one alone.
PARTITION_BYTES = 32 << 20


@dataclass(frozen=True)
class Files(InputPartition):
    """Paths below the root."""

    paths: tuple[str, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "value", self.paths)


def suffix(path: str) -> str:
    return PurePosixPath(path).suffix


def listed(root: str) -> Iterator[tuple[str, int, int]]:
    """(path, size, time in nanoseconds) of the files below a folder."""
    todo = [""]
    while todo:
        below = todo.pop()
        with os.scandir(os.path.join(root, below)) as found:
            for entry in found:
                path = f"{below}/{entry.name}".lstrip("/")
                if entry.is_dir(follow_symlinks=False):
                    todo.append(path)
                elif entry.is_file():
                    stat = entry.stat()
                    yield path, stat.st_size, stat.st_mtime_ns


def dealt(files: list[tuple[str, int]], most: int) -> list[Files]:
    """The files as partitions of about so many bytes, in order."""
    out: list[Files] = []
    held: list[str] = []
    total = 0
    for path, size in files:
        if held and total + size > most:
            out.append(Files(tuple(held)))
            held, total = [], 0
        held.append(path)
        total += size
    return [*out, Files(tuple(held))] if held else out


def text_of(content: bytes) -> str:
    return content.decode("utf-8", "replace").replace("�", "").replace("\r\n", "\n").replace("\r", "\n")


@dataclass
class Tree:
    """Where files are, which count, and how they are dealt and read."""

    root: str
    most: int
    suffixes: frozenset[str] | None = None

    def wanted(self, path: str) -> bool:
        return self.suffixes is None or suffix(path) in self.suffixes

    def rows(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    content = f.read()
            except FileNotFoundError:  # gone since it was listed
                continue
            yield path, suffix(path), len(content), text_of(content)


@dataclass
class Reader(DataSourceReader):
    tree: Tree

    def partitions(self) -> list[Files]:
        return dealt(sorted((path, size) for path, size, _ in listed(self.tree.root) if self.tree.wanted(path)), self.tree.most) or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from self.tree.rows(partition)


class PushedReader(Reader):
    """With conditions on the suffix at the listing."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute != ("suffix",):
                yield f
            else:
                before = self.tree.suffixes
                self.tree.suffixes = frozenset(values if before is None else before & values)


@dataclass
class StreamReader(DataSourceStreamReader):
    tree: Tree
    start: dict = field(default_factory=lambda: {"at": -1, "path": ""})

    def initialOffset(self) -> dict:
        return self.start

    def latestOffset(self) -> dict:
        at, path = max(((at, path) for path, _, at in listed(self.tree.root) if self.tree.wanted(path)), default=(-1, ""))
        return {"at": at, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, upto = (start["at"], start["path"]), (end["at"], end["path"])
        found = sorted((path, size) for path, size, at in listed(self.tree.root) if self.tree.wanted(path) and after < (at, path) <= upto)
        return dealt(found, self.tree.most) or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from self.tree.rows(partition)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class SourceTree(DataSource):
    """Options: path; suffixes, with commas between; partitionBytes; pushdown, whether the session has it on."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _tree(self) -> Tree:
        said = self.options.get("suffixes")
        root = self.options["path"].removeprefix("file://").removeprefix("file:")
        return Tree(root, int(self.options.get("partitionBytes", PARTITION_BYTES)), None if said is None else frozenset(said.split(",")))

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushedReader if self.options.get("pushdown", "").lower() == "true" else Reader)(self._tree())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(self._tree())


def source_tree(spark: SparkSession, root: str, suffixes: tuple[str, ...] | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(path below root, suffix, size, text) of a folder that driver and executors see."""
    spark.dataSource.register(SourceTree)
    reader = spark.read.format(NAME).option("partitionBytes", partition_bytes).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (reader if suffixes is None else reader.option("suffixes", ",".join(suffixes))).load(root)
