"""Project trees as a data source: hidden and empty files too, and links told but not followed.

    spark.dataSource.register(ProjectTree)
    spark.read.format("project_tree").option("path", root).load()

Rows: path (relative), size, is_link, and content (null for links, for files over
``max_bytes``, and where ``content`` is false).  The driver lists the first ``depth``
levels; what lies deeper is listed by the tasks, one for each folder at that
depth, so a large tree is never a list in one place.  Files of the upper levels
are dealt out by FILES, and contents leave a task some BATCH bytes at a time.  A
folder that cannot be read stops the job: a missing subtree must not pass for an
empty one.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from veilspark.sources.shared import opened

MAX_BYTES = 50_000_000
#: Files of one folder that a task reads at most, bytes of contents and files that a batch holds, about.
FILES, BATCH, ROWS = 2048, 4 << 20, 2048
SCHEMA = pa.schema([("path", pa.string()), ("size", pa.int64()), ("is_link", pa.bool_()), ("content", pa.binary())])


@dataclass
class Part(InputPartition):
    """Files of one folder, or a folder with all below it."""

    paths: tuple[str, ...]
    deep: bool


class ProjectTree(DataSource):
    """Options: path (the root), depth (2), content (true), max_bytes."""

    @classmethod
    def name(cls) -> str:
        return "project_tree"

    def schema(self) -> str:
        return "path string, size bigint, is_link boolean, content binary"

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"].rstrip("/")
        self.depth, self.content = int(options.get("depth", "2")), options.get("content", "true").lower() == "true"
        self.max_bytes = int(options.get("max_bytes", str(MAX_BYTES)))

    def _linked(self, store: fs.FileSystem, path: str) -> bool:
        return isinstance(store, fs.LocalFileSystem) and os.path.islink(path)

    def _listed(self, store: fs.FileSystem, folder: str) -> tuple[list[str], list[str]]:
        """Files and links of a folder, and its folders, each by name."""
        files, folders = [], []
        for info in sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda i: i.base_name):
            (folders if info.type == fs.FileType.Directory and not self._linked(store, info.path) else files).append(info.path)
        return files, folders

    def partitions(self) -> list[Part]:
        store, root = opened(self.root)
        level, out = [root], []
        for _ in range(self.depth):
            below: list[str] = []
            for folder in level:
                files, folders = self._listed(store, folder)
                out += [Part(tuple(files[i : i + FILES]), False) for i in range(0, len(files), FILES)]
                below += folders
            level = below
        return [*out, *(Part((folder,), True) for folder in level)] or [Part((), False)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in self._rows(partition):
            held.append(row)
            size += len(row[3] or b"")
            if size >= BATCH or len(held) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)

    def _rows(self, partition: Part) -> Iterator[tuple]:
        store, root = opened(self.root)
        todo = list(reversed(partition.paths))
        while todo:
            path = todo.pop()
            linked = self._linked(store, path)
            info = store.get_file_info(path)
            if partition.deep and info.type == fs.FileType.Directory and not linked:
                files, folders = self._listed(store, path)
                todo += reversed([*files, *folders])
                continue
            size = 0 if linked else info.size or 0
            content = None
            if self.content and not linked and info.type == fs.FileType.File and size <= self.max_bytes:
                with store.open_input_stream(path) as data:
                    content = data.read()
            yield path[len(root) + 1 :], size, linked, content
