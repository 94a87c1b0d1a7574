"""A data source that lists files: each folder is listed by a task, and its rows stream out in batches."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders that are split into their subfolders until there are so many, and rows of a batch.
FOLDERS, ROWS = 256, 10_000
SCHEMA = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modificationTime", pa.timestamp("us", tz="UTC"))])


@dataclass(frozen=True)
class Entry:
    path: str
    folder: bool
    length: int
    micros: int


def hidden(name: str) -> bool:
    """Names that Spark's own readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


class Files:
    """A file system by the address of its root: local folders are read entry by entry, others through Arrow."""

    def __init__(self, root: str):
        local = re.match(r"(?:file:(?://(?=/))?)?(/.*)", root)
        self.remote, self.prefix = None, "file:"
        self.root = os.path.normpath(local[1]) if local else root
        if not local:
            from pyarrow import fs

            self.remote, self.root = fs.FileSystem.from_uri(root)
            self.prefix = root[: root.index(self.root)] if self.root in root else root.partition("://")[0] + "://"

    def address(self, path: str) -> str:
        return self.prefix + path

    def entries(self, folder: str) -> Iterator[Entry]:
        if self.remote is None:
            with os.scandir(folder) as found:
                for x in found:
                    if not hidden(x.name):
                        seen = x.stat()
                        yield Entry(x.path, x.is_dir(), seen.st_size, seen.st_mtime_ns // 1000)
            return
        from pyarrow import fs

        for x in self.remote.get_file_info(fs.FileSelector(folder)):
            if not hidden(x.base_name):
                yield Entry(x.path, x.type == fs.FileType.Directory, x.size or 0, (x.mtime_ns or 0) // 1000)

    def file(self, path: str) -> Entry | None:
        """The file at a path; None if a folder is there. Nothing there is an error."""
        if self.remote is None:
            seen = os.stat(path)
            return None if os.path.isdir(path) else Entry(path, False, seen.st_size, seen.st_mtime_ns // 1000)
        from pyarrow import fs

        x = self.remote.get_file_info(path)
        if x.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        return None if x.type == fs.FileType.Directory else Entry(x.path, False, x.size or 0, (x.mtime_ns or 0) // 1000)


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool

    def __init__(self, path: str, deep: bool):
        super().__init__(None)
        self.path, self.deep = path, deep


class MediaReader(DataSourceReader):
    def __init__(self, root: str, recursive: bool, suffixes: list[str], folders: int):
        self.root, self.recursive, self.suffixes, self.folders = root, recursive, tuple(s.lower() for s in suffixes), folders

    def partitions(self) -> list[Folder]:
        """Folders to list. A deep one is split into itself and its subfolders, of which alone the driver holds the names, the
        first ones first, until there are enough; so tasks do not grow with the number of files."""
        files = Files(self.root)
        if files.file(files.root) or not self.recursive:
            return [Folder(files.root, False)]
        deep, flat = [files.root], []
        while deep and len(deep) + len(flat) < self.folders:
            folder = deep.pop(0)
            flat.append(folder)
            deep += sorted(x.path for x in files.entries(folder) if x.folder)
        return [Folder(p, False) for p in flat] + [Folder(p, True) for p in deep]

    def _found(self, files: Files, part: Folder) -> Iterator[Entry]:
        single = files.file(part.path)
        if single:
            yield single
            return
        todo = [part.path]
        while todo:
            for x in files.entries(todo.pop()):
                if not x.folder:
                    yield x
                elif part.deep:
                    todo.append(x.path)

    def read(self, part: Folder) -> Iterator[pa.RecordBatch]:
        files, held = Files(self.root), []
        for x in self._found(files, part):
            if x.path.lower().endswith(self.suffixes) or not self.suffixes:
                held.append((files.address(x.path), x.length, x.micros))
            if len(held) == ROWS:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


class MediaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_files"

    def schema(self) -> str:
        return "path string, length bigint, modificationTime timestamp"

    def reader(self, schema) -> MediaReader:
        o = self.options
        return MediaReader(o["path"], o.get("recursive", "false") == "true", json.loads(o.get("suffixes", "[]")), int(o.get("folders", FOLDERS)))


def reaches(path: str) -> bool:
    """Can Python list the path? Stores that only Spark's readers open are listed by these."""
    try:
        Files(path)
    except Exception:
        return False
    return True
