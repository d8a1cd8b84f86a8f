"""Files below mounted roots as a Spark source that walks its subtrees in parallel."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .store import workers_import

#: Folders below the roots that are walked as partitions of their own, at most; further ones share a partition.
PARTITIONS = 2_000
#: Fixed value: a folder of this name, in any casing, is a shelf of copies.
SHELF = "duplicates"
SCHEMA = "root string, path string, dir string, file string, size long, mtime timestamp, problem string"


class Folders(InputPartition):
    """Folders (root, dir, depth) to walk; with ``below`` false only their own files."""

    def __init__(self, folders: list[tuple[str, str, int]], below: bool):
        self.folders, self.below = folders, below


def skipped(name: str) -> bool:
    return name.startswith(".") or name.lower() == SHELF


def subfolders(directory: str) -> list[str]:
    with os.scandir(directory) as entries:
        return sorted(e.path for e in entries if not skipped(e.name) and not e.is_symlink() and e.is_dir(follow_symlinks=False))


def walk(root: str, directory: str, depth: int, most: int | None, below: bool = True) -> Iterator[tuple]:
    """A row for each regular file, and one with ``problem`` for each folder that can't be listed. Hidden names, links and shelves are left out; ``most``: levels of folders below the root."""
    pending = [(directory, depth)]
    while pending:
        at, level = pending.pop()
        try:
            entries = sorted(os.scandir(at), key=lambda e: e.name)
        except OSError:
            yield root, None, at, None, None, None, "unreadable"
            continue
        for e in entries:
            if skipped(e.name) and not (e.name.lower() == SHELF and e.is_file(follow_symlinks=False)) or e.is_symlink():
                continue
            if e.is_dir(follow_symlinks=False):
                if below and (most is None or level < most):
                    pending.append((e.path, level + 1))
            elif e.is_file(follow_symlinks=False):
                try:
                    s = e.stat(follow_symlinks=False)
                except OSError:  # gone since it was listed
                    continue
                yield root, e.path, at, e.name, s.st_size, datetime.fromtimestamp(s.st_mtime, timezone.utc), None


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots, self.most = json.loads(options["roots"]), json.loads(options["max_depth"])

    def partitions(self) -> list[InputPartition]:
        """The roots' own files, and their folders dealt out; only names of folders next to the roots are held."""
        own, folders = [], []
        for root in self.roots:
            own.append((root, root, 0))
            try:
                folders += [(root, d, 1) for d in subfolders(root)] if self.most is None or self.most > 0 else []
            except OSError:
                pass  # told by the walk of its own files
        return [Folders([x], below=False) for x in own] + [Folders(folders[i::PARTITIONS], below=True) for i in range(min(PARTITIONS, len(folders)))]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for root, directory, depth in partition.folders:
            if depth == 0 and not os.path.isdir(directory):
                yield root, None, directory, None, None, None, "missing"
            else:
                yield from walk(root, directory, depth, self.most, partition.below)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def scan(spark: SparkSession, roots: list[str], max_depth: int | None = 4) -> DataFrame:
    """(root, path, dir, file, size, mtime, problem) of everything below ``roots`` (a short configured list, none inside another), each folder next to a root in a task of
    its own. ``problem``: null for a file, else 'missing' for a root that isn't there, or 'unreadable' for a folder (a root too) that can't be listed. Executors need the roots mounted."""
    workers_import(spark)
    spark.dataSource.register(TreeSource)
    return spark.read.format("file_tree").option("roots", json.dumps([r.rstrip("/") for r in roots])).option("max_depth", json.dumps(max_depth)).load()


def root_status(scanned: DataFrame, roots: list[str]) -> DataFrame:
    """(root, present, unreadable) of each configured root."""
    told = scanned.where((F.col("dir") == F.col("root")) & F.col("problem").isNotNull()).groupBy("root").agg(F.max("problem").alias("problem"))
    listed = scanned.sparkSession.createDataFrame([(r.rstrip("/"),) for r in roots], "root string")
    rows = listed.join(told, "root", "left")
    is_ = lambda p: F.coalesce(F.col("problem") == p, F.lit(False))
    return rows.select("root", (~is_("missing")).alias("present"), is_("unreadable").alias("unreadable"))
