"""A data source of all files below a folder, hidden ones too, with read failures as rows (SRC-1, SRC-6).

The driver lists folders level by level only until there are enough for the tasks;
each task lists and reads what lies below its folders, so neither names nor contents
of a large tree pass through the driver. Any store that ``pyarrow.fs`` knows will do.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, content binary, error string"
#: Bytes of files in a batch, about.
BATCH = 4 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The store of a path, the path in it, and what stands before such paths; ValueError where pyarrow has no such store."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(path), ""
    try:
        fs, at = pafs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, NotImplementedError, OSError) as e:
        raise ValueError(f"no store for {path}") from e
    return fs, at, "" if isinstance(fs, pafs.LocalFileSystem) else path.partition("://")[0] + "://"


def listed(fs: pafs.FileSystem, folder: str) -> tuple[list[str], list[str]]:
    """Folders and files right in a folder, sorted; links to folders aren't followed."""
    found = fs.get_file_info(pafs.FileSelector(folder))
    link = os.path.islink if isinstance(fs, pafs.LocalFileSystem) else lambda _: False
    folders = sorted(x.path for x in found if x.type == pafs.FileType.Directory and not link(x.path))
    return folders, sorted(x.path for x in found if x.type == pafs.FileType.File)


@dataclass
class Part(InputPartition):
    """Folders to go down, and files."""

    folders: list[str]
    files: list[str]


class TreeReader(DataSourceReader):
    def __init__(self, root: str, tasks: int):
        self.root, self.tasks = root, tasks

    def partitions(self) -> list[Part]:
        fs, at, _ = opened(self.root)
        kind = fs.get_file_info(at).type
        if kind == pafs.FileType.NotFound:
            raise FileNotFoundError(f"{self.root} does not exist")
        if kind == pafs.FileType.File:
            return [Part([], [at])]
        folders, files = [at], []
        while folders and len(folders) < self.tasks:
            below = [listed(fs, f) for f in folders]
            files += [x for _, some in below for x in some]
            folders = [x for some, _ in below for x in some]
        n = max(1, min(self.tasks, len(folders) + len(files)))
        return [Part(folders[i::n], files[i::n]) for i in range(n)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, _, before = opened(self.root)
        rows, size = [], 0
        for path in self._below(fs, partition):
            try:
                with fs.open_input_stream(path) as f:
                    rows.append((before + path, f.read(), None))
            except OSError as e:
                rows.append((before + path, None, f"{type(e).__name__}: {e}"))
            size += len(rows[-1][1] or b"")
            if size >= BATCH or len(rows) == 1024:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    @staticmethod
    def _below(fs: pafs.FileSystem, partition: Part) -> Iterator[str]:
        yield from partition.files
        left = list(partition.folders)
        while left:
            folders, files = listed(fs, left.pop())
            yield from files
            left += folders


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    path, content, error = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(content, pa.binary()), pa.array(error, pa.string())], ["path", "content", "error"])


class TreeSource(DataSource):
    """``spark.read.format("source_tree").option("tasks", n).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], int(self.options.get("tasks", "64")))
