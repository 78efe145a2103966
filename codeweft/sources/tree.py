"""Source trees as a Spark data source: folders are listed and files are read by tasks, and what fails becomes a row.

The driver lists only the first levels, until there are enough folders to deal out; each task walks the subtrees it
got. Contents are read in a second step, which deals files to tasks by number, so one full folder is no single task's work.
File systems are opened through ``pyarrow.fs``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeweft.storage import materialize

MAX_BYTES = 10 * 1024 * 1024
EXCLUDED_DIRS = [".git", ".idea", ".gradle", "target", "build", "node_modules", "out", "dist", ".venv", "__pycache__"]
#: Folders that the driver finds before it stops listing, and levels that it looks at.
FOLDERS, LEVELS = 64, 6
#: Bytes of contents that a task reads, and that a batch holds, about.
TASK_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
LISTED = "relative_path string, size_bytes long, warning string"


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root, and the root's path in it."""
    files, path = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else os.path.abspath(root))
    return files, path.rstrip("/")


def children(files: fs.FileSystem, base: str, folder: str, excluded: frozenset[str]) -> tuple[list[str], list[tuple[str, int]]]:
    """(folders, files with sizes) right below a folder, as paths below ``base``; links are left out."""
    found = files.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/")))
    local = isinstance(files, fs.LocalFileSystem)
    kept = sorted((f for f in found if not (local and os.path.islink(f.path))), key=lambda f: f.path)
    below = lambda f: f.path[len(base) + 1 :]
    return (
        [below(f) for f in kept if f.type == fs.FileType.Directory and f.base_name not in excluded],
        [(below(f), f.size) for f in kept if f.type == fs.FileType.File],
    )


class _Reader(DataSourceReader):
    def __init__(self, root: str, excluded: list[str], most: int, folders: int) -> None:
        self.root, self.excluded, self.most, self.folders = root, frozenset(excluded), most, folders

    def partitions(self) -> list[InputPartition]:
        files, base = opened(self.root)
        flat, level = [], [""]
        for _ in range(LEVELS):
            if not level or len(level) >= self.folders:
                break
            following = []
            for folder in level:
                try:
                    following += children(files, base, folder, self.excluded)[0]
                except OSError:
                    pass  # the task that lists it says so
            flat += [(f, False) for f in level]
            level = following
        work = flat + [(f, True) for f in level]
        parts = min(len(work), 4 * self.folders)
        return [InputPartition(work[i::parts]) for i in range(parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, base = opened(self.root)
        stack = list(partition.value)
        while stack:
            folder, deep = stack.pop()
            try:
                below, found = children(files, base, folder, self.excluded)
            except OSError as e:
                yield folder, None, f"folder cannot be listed: {type(e).__name__}"
                continue
            for path, size in found:
                yield path, size, f"larger than {self.most} bytes" if size > self.most else None
            if deep:
                stack += [(f, True) for f in below]


class SourceTree(DataSource):
    """``source_tree``: ``relative_path, size_bytes, warning`` of all files below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema: T.StructType) -> DataSourceReader:
        o = self.options
        return _Reader(o["path"], json.loads(o["excluded"]), int(o["most"]), int(o["folders"]))


def list_tree(spark: SparkSession, root: str, excluded: list[str] | None = None, max_bytes: int = MAX_BYTES, folders: int = FOLDERS) -> DataFrame:
    """``relative_path, size_bytes, warning`` of all files below a root.

    Folders of excluded names are not entered and links are not followed. A file that is too large, and a folder that
    cannot be listed, has a warning.
    """
    spark.dataSource.register(SourceTree)
    names = json.dumps(EXCLUDED_DIRS if excluded is None else excluded)
    return spark.read.format("source_tree").options(excluded=names, most=max_bytes, folders=folders).load(root)


def with_contents(listed: DataFrame, root: str, tasks: int) -> DataFrame:
    """Adds ``content`` to the files without a warning; one that cannot be read gets a warning instead."""
    schema = f"{LISTED}, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(root)
        names = ["relative_path", "size_bytes", "warning", "content"]
        types = [pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            held, out = 0, []
            for path, size, warning in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                content = None
                if warning is None:
                    try:
                        with files.open_input_stream(f"{base}/{path}") as f:
                            content = f.read()
                        size = len(content)
                    except OSError as e:
                        warning = f"cannot be read: {type(e).__name__}"
                out.append((path, size, warning, content))
                held += len(content or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    held, out = 0, []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return listed.repartition(tasks).mapInArrow(run, schema)


def scan_tree(spark: SparkSession, root: str, excluded: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``relative_path, size_bytes, warning, content``: the listing, written once, with contents dealt by bytes."""
    listed = materialize(list_tree(spark, root, excluded, max_bytes), "listing")
    size = listed.where("warning IS NULL").agg(F.sum("size_bytes").alias("n")).first()["n"] or 0
    return with_contents(listed, root, max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))
