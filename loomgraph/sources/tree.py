"""Data source of source trees.

Spark's file source drops names that begin with `_` or `.`, so the tree is walked here: the driver
lists paths, executors read the contents of their share.  A root with a scheme (hdfs://, s3://,
file://) is read through that file system; a plain path must be one that all executors see."""

from __future__ import annotations

import hashlib
import os
import posixpath

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomgraph.functions.text import LANGUAGES, lang_from_path

#: fixed values: folders that are not searched; and the folder of our own index
SKIPPED = frozenset(".git node_modules venv .venv __pycache__ dist build vendor target".split()) | {".loomgraph"}


def scan_source_files(root: str, skip: tuple[str, ...] = ()) -> list[str]:
    """Paths of the source files below root, sorted.  Unreadable folders are skipped, links not
    followed; skip: further names of folders that are not searched."""
    if "://" in root:
        return _scan_uri(root, SKIPPED.union(skip))
    found, work, skipped = [], [os.path.abspath(root)], SKIPPED.union(skip)
    while work:
        try:
            entries = list(os.scandir(work.pop()))
        except OSError:
            continue
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                if e.name not in skipped:
                    work.append(e.path)
            elif e.is_file(follow_symlinks=False) and e.name.endswith(tuple(LANGUAGES)):
                found.append(e.path)
    return sorted(found)


def _scan_uri(root: str, skipped: frozenset[str]) -> list[str]:
    fs, base = pafs.FileSystem.from_uri(root.rstrip("/"))
    found, work = [], [base]
    while work:
        try:
            entries = fs.get_file_info(pafs.FileSelector(work.pop()))
        except OSError:
            continue
        for e in entries:
            if e.type == pafs.FileType.Directory:
                if e.base_name not in skipped:
                    work.append(e.path)
            elif e.type == pafs.FileType.File and e.base_name.endswith(tuple(LANGUAGES)):
                found.append(e.path)
    return sorted(found)


def to_rel_path(root: str, path: str) -> str:
    if "://" in root:
        return posixpath.relpath(path, pafs.FileSystem.from_uri(root.rstrip("/"))[1])
    return os.path.relpath(path, os.path.abspath(root)).replace(os.sep, "/")


class _Share(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class SourceTreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options.get("path") or options.get("root")
        if not self.root:
            raise ValueError("source_tree needs a path")
        self.per_task = max(1, int(options.get("filesPerTask", 256)))
        self.skip = tuple(x for x in options.get("skip", "").split(",") if x)

    def partitions(self):
        paths = scan_source_files(self.root, self.skip)
        return [_Share(paths[i : i + self.per_task]) for i in range(0, len(paths), self.per_task)] or [_Share([])]

    def read(self, partition):
        fs = pafs.FileSystem.from_uri(self.root.rstrip("/"))[0] if "://" in self.root else None
        for path in partition.paths:
            try:
                with fs.open_input_stream(path, compression=None) if fs else open(path, "rb") as f:
                    data = f.read()
            except OSError:  # gone since it was listed
                continue
            rel = to_rel_path(self.root, path)
            yield rel, data.decode("utf-8", "replace"), lang_from_path(rel), hashlib.sha1(data).hexdigest()


class SourceTree(DataSource):
    """spark.read.format("source_tree").load(root): path, content, lang, hash (sha1 of the bytes)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, content string, lang string, hash string"

    def reader(self, schema) -> SourceTreeReader:
        return SourceTreeReader(self.options)


def read_tree(spark: SparkSession, root: str, files_per_task: int = 256, skip: tuple[str, ...] = ()) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("filesPerTask", files_per_task).option("skip", ",".join(skip)).load(root)
