"""Staged publication of a file tree: readers see the old tree or the new one, whatever dies in between.

    spark.dataSource.register(PublishedTree)
    files.write.format("published_tree").option("path", target).option("run", run).mode("append").save()

Below the target lie ``versions/<run>/`` with a run's files, ``CURRENT`` with the
name of the run that counts, and ``journal.json`` while a run is at work.  Tasks
write each file beside its place and rename it, so a repeated or doubled attempt
writes the same file again.  A run counts from the moment that ``CURRENT`` is
renamed into place; all before can be thrown away, all after needs no repair.  A
journal that stays behind tells of a run that died: :func:`recover` removes what
it left, or finishes its tidying if it already counts.

The target is any file system that pyarrow opens by its address, so tasks on
other machines reach it; nothing passes through the driver but one line a task.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from veilspark.sources.shared import opened
from veilspark.sources.tree import ProjectTree

JOURNAL, CURRENT, VERSIONS, GONE = "journal.json", "CURRENT", "versions", "gone"


def _write(store: fs.FileSystem, path: str, data: bytes) -> None:
    """Write a file under another name and rename it, so that it is there whole or not at all."""
    beside = f"{path}.part-{uuid.uuid4().hex}"
    with store.open_output_stream(beside) as out:
        out.write(data)
    store.move(beside, path)


def _read(store: fs.FileSystem, path: str) -> bytes | None:
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(path) as lines:
        return lines.read()


def _delete(store: fs.FileSystem, path: str) -> None:
    kind = store.get_file_info(path).type
    if kind == fs.FileType.Directory:
        store.delete_dir(path)
    elif kind != fs.FileType.NotFound:
        store.delete_file(path)


def _withdrawn(store: fs.FileSystem, root: str, run: str) -> None:
    """Delete a run's files.  Their folder leaves its place first: a task that still writes finds none and makes none."""
    top = aside = f"{root}/{VERSIONS}/{run}"
    if store.get_file_info(top).type == fs.FileType.Directory:
        store.create_dir(f"{root}/{GONE}")
        aside = f"{root}/{GONE}/{uuid.uuid4().hex}"
        try:
            store.move(top, aside)
        except OSError:  # a store that renames no folders
            aside = top
    _delete(store, aside)
    _delete(store, f"{root}/{GONE}")
    _delete(store, f"{top}.json")


def safe_path(path: str) -> str:
    """``path`` if it stays below the tree that it is written to."""
    parts = PurePosixPath(path).parts
    if not path or path.startswith("/") or "\\" in path or "\0" in path or ".." in parts or "." in path.split("/") or "" in path.split("/"):
        raise ValueError(f"unsafe path {path!r}")
    return path


@dataclass
class Written(WriterCommitMessage):
    n_files: int
    n_bytes: int


class PublishedTree(DataSource):
    """Rows (path, content binary or text) as files of a run.  Options: path (the target), run (its name), keep (older runs to keep, 0)."""

    @classmethod
    def name(cls) -> str:
        return "published_tree"

    def writer(self, schema: StructType, overwrite: bool) -> PublishedWriter:
        return PublishedWriter(dict(self.options), schema.fieldNames())


class PublishedWriter(DataSourceWriter):
    """Files of one run; see the module."""

    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        self.target, self.run, self.keep = options["path"].rstrip("/"), options["run"], int(options.get("keep", "0"))
        safe_path(self.run)
        if "/" in self.run or not {"path", "content"} <= set(names):
            raise ValueError("a run's name is one part of a path, and rows have path and content")
        store, root = opened(self.target)
        store.create_dir(f"{root}/{VERSIONS}")
        held = _read(store, f"{root}/{JOURNAL}")
        if held is not None and json.loads(held)["run"] != self.run:
            raise ValueError(f"{self.target}: another run is at work or waits for recovery")
        if (_read(store, f"{root}/{CURRENT}") or b"").decode() == self.run:
            raise ValueError(f"{self.target}: run {self.run} is published already")
        if held is None:
            _write(store, f"{root}/{JOURNAL}", json.dumps({"run": self.run}).encode())
        store.create_dir(f"{root}/{VERSIONS}/{self.run}")

    def write(self, iterator: Iterator) -> Written:
        store, root = opened(self.target)
        top, made, n, size = f"{root}/{VERSIONS}/{self.run}", set(), 0, 0
        for row in iterator:
            path, content = safe_path(row["path"]), row["content"]
            data = content.encode() if isinstance(content, str) else bytes(content or b"")
            for folder in reversed(PurePosixPath(path).parents[:-1]):
                if folder not in made:
                    store.create_dir(f"{top}/{folder}", recursive=False)  # never the run's own folder, see _withdrawn
                    made.add(folder)
            _write(store, f"{top}/{path}", data)
            n, size = n + 1, size + len(data)
        return Written(n, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = opened(self.target)
        store.create_dir(f"{root}/{VERSIONS}/{self.run}")
        before = (_read(store, f"{root}/{CURRENT}") or b"").decode()
        done = {"run": self.run, "before": before, "files": sum(m.n_files for m in messages if m), "bytes": sum(m.n_bytes for m in messages if m)}
        _write(store, f"{root}/{VERSIONS}/{self.run}.json", json.dumps(done).encode())
        _write(store, f"{root}/{CURRENT}", self.run.encode())  # from here on the run counts
        tidied(store, root, self.keep)
        _delete(store, f"{root}/{JOURNAL}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = opened(self.target)
        if (_read(store, f"{root}/{CURRENT}") or b"").decode() != self.run:
            _withdrawn(store, root, self.run)
        _delete(store, f"{root}/{JOURNAL}")


def tidied(store: fs.FileSystem, root: str, keep: int) -> None:
    """Delete runs before the current one, but for ``keep`` of them."""
    run = (_read(store, f"{root}/{CURRENT}") or b"").decode()
    for n in range(1 << 30):
        told = _read(store, f"{root}/{VERSIONS}/{run}.json") if run else None
        if told is None:
            break
        if n > keep:
            _delete(store, f"{root}/{VERSIONS}/{run}")
            _delete(store, f"{root}/{VERSIONS}/{run}.json")
        run = json.loads(told)["before"]


def recover(target: str, keep: int = 0) -> str:
    """After a run died: "missing" if there is no journal, "removed" if the run never counted, "finished" if it does.  Call it when no writer is at work."""
    store, root = opened(target.rstrip("/"))
    held = _read(store, f"{root}/{JOURNAL}")
    if held is None:
        return "missing"
    run = json.loads(held)["run"]
    counts = (_read(store, f"{root}/{CURRENT}") or b"").decode() == run
    if counts:
        tidied(store, root, keep)
    else:
        _withdrawn(store, root, run)
    _delete(store, f"{root}/{JOURNAL}")
    return "finished" if counts else "removed"


def published(spark: SparkSession, target: str) -> DataFrame:
    """(path, size, content) of the run that counts, hidden files too; none if there is none.  Folders are listed by the tasks."""
    store, root = opened(target.rstrip("/"))
    run = (_read(store, f"{root}/{CURRENT}") or b"").decode()
    if not run:
        return spark.createDataFrame([], "path string, size bigint, content binary")
    spark.dataSource.register(ProjectTree)
    top = f"{target.rstrip('/')}/{VERSIONS}/{run}"
    return spark.read.format("project_tree").option("path", top).option("max_bytes", str(1 << 62)).load().select("path", "size", "content")


def publish(done: DataFrame, target: str, run: str, text: str = "masked_text", keep: int = 0) -> None:
    """Publish the READY rows of ``done`` (path, text, final_state) below ``target``, and the others below ``<target>-failed``, each as one run.

    Rows without a path are refused.  The failed ones come first: a run that dies
    there has published nothing.
    """
    spark = done.sparkSession
    spark.dataSource.register(PublishedTree)
    if done.where(F.col("path").isNull()).limit(1).count():
        raise ValueError("rows without a path cannot be published")
    rows = done.select("path", F.coalesce(F.col(text), F.lit("")).alias("content"), (F.col("final_state") == "READY").alias("ready"))
    for ready, at in ((False, f"{target.rstrip('/')}-failed"), (True, target)):
        part = rows.where(F.coalesce("ready", F.lit(False)) == F.lit(ready)).select("path", "content")
        part.write.format("published_tree").option("path", at).option("run", run).option("keep", str(keep)).mode("append").save()
