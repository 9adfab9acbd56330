"""A Python data source that lists folders on the executors.

    spark.dataSource.register(Files)
    spark.read.format("tessera_files").option("path", "/code").load()

The driver opens folders breadth-first only until there are TASKS of them; each task then walks its own. A walk ends after
FOLDERS_A_TASK folders or at the deadline, and says of what is left that it was not listed; scan.listing() sends those folders
out again, so no task holds a large part of the tree. Nothing is hidden: names with a leading dot or underscore are files
like others. Folders are read by the file system of the path: the local one (mounts included), or what pyarrow knows
by its scheme.
"""

from __future__ import annotations

import fnmatch
import os
import re
import stat
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Kinds of rows: a file; what stands for a folder that is not walked and why; a folder that was read.
FILE, FOLDER, NOT_LISTED = "file", "folder", "not_listed"
SKIPPED = ("symlink_directory", "permission_denied", "scan_error", "path_not_found", "excluded_directory")
SCHEMA = "path string, size long, mtime_ns long, kind string"
TASKS, FOLDERS_A_TASK, BATCH = 64, 2000, 4096
_NAMES = ["path", "size", "mtime_ns", "kind"]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string()]

Row = tuple[str, int | None, int | None, str]


def is_remote(path: str) -> bool:
    return bool(re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", path)) and not path.startswith("file:")


def plain(path: str) -> str:
    """A local path without its scheme."""
    return re.sub("^file:/+", "/", path)


@dataclass(frozen=True)
class Bounds:
    """How far walks go. pruned: shell globs of folder names that are not entered; deadline: seconds since the epoch."""

    recursive: bool = True
    pruned: tuple[str, ...] = ()
    deadline: float | None = None

    def prunes(self, name: str) -> bool:
        return any(fnmatch.fnmatchcase(name, g) for g in self.pruned)

    def over(self) -> bool:
        return self.deadline is not None and time.time() >= self.deadline


def children(folder: str, bounds: Bounds) -> tuple[list[Row], list[str]]:
    """(rows, folders below) of one folder."""
    rows: list[Row] = [(folder, None, None, FOLDER)]
    below: list[str] = []
    try:
        for name, path, size, mtime, kind in _remote(folder) if is_remote(folder) else _local(folder):
            if kind != FOLDER:
                rows.append((path, size, mtime, kind))
            elif bounds.prunes(name):
                rows.append((path, None, None, "excluded_directory"))
            else:
                below.append(path)
    except FileNotFoundError:
        return [(folder, None, None, "path_not_found")], []
    except PermissionError:
        return [(folder, None, None, "permission_denied")], []
    except OSError:
        return [(folder, None, None, "scan_error")], []
    return rows, sorted(below)


def _local(folder: str) -> Iterator[tuple]:
    with os.scandir(folder) as found:
        for e in found:
            try:
                link = e.is_symlink()
                if e.is_dir():
                    yield e.name, e.path, None, None, "symlink_directory" if link else FOLDER
                    continue
                s = e.stat()
                if stat.S_ISREG(s.st_mode):
                    yield e.name, e.path, s.st_size, s.st_mtime_ns, FILE
            except OSError:  # gone since, or a link to nowhere
                yield e.name, e.path, None, None, "scan_error"


def _remote(folder: str) -> Iterator[tuple]:
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    prefix = folder[: folder.index(base)] if base in folder else ""
    for f in system.get_file_info(fs.FileSelector(base)):
        if f.type == fs.FileType.Directory:
            yield f.base_name, prefix + f.path, None, None, FOLDER
        elif f.type == fs.FileType.File:
            yield f.base_name, prefix + f.path, f.size, f.mtime_ns, FILE


def one_file(path: str) -> Row | None:
    """The row of a path that is a file itself."""
    if is_remote(path):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(path)
        f = system.get_file_info(base)
        return (path, f.size, f.mtime_ns, FILE) if f.type == fs.FileType.File else None
    try:
        s = os.stat(path)
    except OSError:
        return None
    return (path, s.st_size, s.st_mtime_ns, FILE) if stat.S_ISREG(s.st_mode) else None


def walk(folders: list[str], bounds: Bounds, budget: int = FOLDERS_A_TASK) -> Iterator[pa.RecordBatch]:
    """Rows of all below folders, depth first, at most `budget` folders of it; the others as not listed."""
    rows: list[Row] = []
    left = list(reversed(folders))
    while left:
        if budget <= 0 or bounds.over():
            rows += [(f, None, None, NOT_LISTED) for f in left]
            break
        budget -= 1
        own, below = children(left.pop(), bounds)
        rows += own
        if bounds.recursive:
            left += reversed(below)
        if len(rows) >= BATCH:
            yield batch(rows)
            rows = []
    yield batch(rows)


def batch(rows: list[Row]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], _NAMES)


@dataclass
class Part(InputPartition):
    rows: tuple[Row, ...]
    folders: tuple[str, ...]

    def __init__(self, rows: tuple[Row, ...], folders: tuple[str, ...]):
        super().__init__(None)
        self.rows, self.folders = rows, folders


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = plain(options["path"]).rstrip("/") or "/"
        self.bounds = Bounds(options.get("recursive", "true").lower() == "true", tuple(g for g in options.get("pruned", "").split("\n") if g), float(options["deadline"]) if "deadline" in options else None)

    def partitions(self) -> list[Part]:
        alone = one_file(self.path)
        if alone:
            return [Part((alone,), ())]
        rows: list[Row] = []
        level = [self.path]
        # A few levels at the top, until there is work for all tasks; their rows are few and go with the first task.
        opened = 0
        while level and len(level) + opened < TASKS and not self.bounds.over():
            below: list[str] = []
            for f in level:
                own, more = children(f, self.bounds)
                rows += own
                below += more
                opened += 1
            level = below if self.bounds.recursive else []
            if len(rows) > BATCH:
                break
        return [Part(tuple(rows), ())] + [Part((), tuple(level[k::TASKS])) for k in range(min(TASKS, len(level)))]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.rows:
            yield batch(list(partition.rows))
        if partition.folders:
            yield from walk(list(partition.folders), self.bounds)


class Files(DataSource):
    """Options: path, recursive, pruned (globs of folder names, one a line), deadline (seconds since the epoch)."""

    @classmethod
    def name(cls) -> str:
        return "tessera_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))
