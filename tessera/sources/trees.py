"""Artifact trees as a Spark data source: the files below a folder, with sizes and digests made by the tasks that list them."""

from __future__ import annotations

import hashlib
import stat
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES = "root string, relative string, size_bytes long, modified timestamp, sha256 string"
#: Bytes of a file that a task holds at once.
BLOCK = 1 << 20


class _Part(InputPartition):
    def __init__(self, relative: str, deep: bool):
        super().__init__((relative, deep))
        self.relative, self.deep = relative, deep


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def refused(relative: str) -> bool:
    """Whether a path is hidden or leads out of its root: a part that begins with a dot, an absolute path, or a backslash."""
    parts = relative.split("/")
    return not relative or relative.startswith("/") or "\\" in relative or any(p.startswith(".") or not p for p in parts)


class _Reader(DataSourceReader):
    """Options: path, digests (true or false). A partition for each of the root's folders, and one for its own files; links, whatever they
    lead to, and what is hidden are left out, with all that is below."""

    def __init__(self, options: dict):
        self.root, self.digests = options["path"].rstrip("/"), str(options.get("digests", "true")).lower() == "true"
        _, at = _store(self.root)
        if any(p == ".." for p in at.split("/")):
            raise ValueError(f"{self.root} leads out of itself")

    def _listed(self, relative: str) -> list:
        """(name, info) of what lies in a folder, without what is refused."""
        from pyarrow import fs

        store, at = _store(self.root)
        folder = f"{at}/{relative}" if relative else at
        out = []
        for info in store.get_file_info(fs.FileSelector(folder)):
            below = f"{relative}/{info.base_name}" if relative else info.base_name
            if not refused(below) and not self._link(store, f"{folder}/{info.base_name}"):
                out.append((below, info))
        return sorted(out, key=lambda x: x[0])

    @staticmethod
    def _link(store, path: str) -> bool:
        """Only local file systems have links; a file that goes meanwhile counts as one."""
        import os

        from pyarrow import fs

        if not isinstance(store, fs.LocalFileSystem):
            return False
        try:
            return stat.S_ISLNK(os.lstat(path).st_mode)
        except OSError:
            return True

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, at = _store(self.root)
        if store.get_file_info(at).type != fs.FileType.Directory:
            return [_Part("", False)]  # there is no such tree: no files
        return [_Part("", False), *(_Part(r, True) for r, info in self._listed("") if info.type == fs.FileType.Directory)]

    def read(self, part: _Part) -> Iterator[tuple]:
        from pyarrow import fs

        store, at = _store(self.root)
        if store.get_file_info(at).type != fs.FileType.Directory:
            return
        todo = [part.relative]
        while todo:
            for relative, info in self._listed(todo.pop()):
                if info.type == fs.FileType.Directory:
                    todo += [relative] if part.deep else []
                elif info.type == fs.FileType.File:
                    when = datetime.fromtimestamp(info.mtime_ns / 1e9, UTC) if info.mtime_ns is not None else None
                    yield (self.root, relative, info.size, when, self._digest(store, f"{at}/{relative}") if self.digests else None)

    @staticmethod
    def _digest(store, path: str) -> str:
        h = hashlib.sha256()
        with store.open_input_stream(path) as f:
            while block := f.read(BLOCK):
                h.update(block)
        return h.hexdigest()


class ArtifactTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifact_tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def artifact_files(spark: SparkSession, root: str, digests: bool = True) -> DataFrame:
    """(root, relative, size_bytes, modified, sha256): the files of a tree, as jobs.manifest takes them; none of a folder that isn't there."""
    spark.dataSource.register(ArtifactTree)
    return spark.read.format("artifact_tree").options(path=root, digests=str(digests).lower()).load()
