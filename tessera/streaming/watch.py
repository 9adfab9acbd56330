"""A streaming data source of a folder's changes: created, modified, deleted and moved files.

    spark.dataSource.register(FolderChanges)
    spark.readStream.format("tessera_changes").option("path", "/code").option("state", "/shared/state").load()

Offsets are numbers of snapshots. The folders at the top are the parts of a snapshot: a task walks one, writes what it finds as that
part of the new snapshot, under `state`, a folder that all tasks share, and gives what differs from the same part of the
snapshot before. A part that is there is not walked again, so a batch that is run again, in a lost task or after a restart from
the checkpoint, gives the same rows: nothing is lost or repeated. A file that keeps its inode, size and time under
another name of its part has moved; between parts it is deleted and created. Snapshots that a commit has passed are deleted.
With existing=false, what the first snapshot finds is not told. Files of all names are seen; links to folders are not followed.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, kind string, moved_to string, ts timestamp"
_PART = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64()), ("inode", pa.int64())])
_OUT = pa.schema([("path", pa.string()), ("kind", pa.string()), ("moved_to", pa.string()), ("ts", pa.timestamp("us", tz="UTC"))])
#: The part of the files that lie in the folder itself.
TOP = "."


@dataclass
class Part(InputPartition):
    name: str
    start: int
    end: int

    def __init__(self, name: str, start: int, end: int):
        super().__init__(None)
        self.name, self.start, self.end = name, start, end


def found(folder: str, deep: bool) -> Iterator[tuple[str, int, int, int]]:
    todo = [folder]
    while todo:
        try:
            with os.scandir(todo.pop()) as entries:
                for e in entries:
                    try:
                        if e.is_dir(follow_symlinks=False):
                            if deep:
                                todo.append(e.path)
                        elif e.is_file():
                            s = e.stat()
                            yield e.path, s.st_size, s.st_mtime_ns, s.st_ino
                    except OSError:
                        continue  # gone while it was looked at
        except OSError:
            continue


def differences(old: dict[str, tuple], new: dict[str, tuple]) -> list[tuple[str, str, str | None]]:
    """(path, kind, moved_to) from two states (size, mtime_ns, inode) by path; a move is told once, by its old path."""
    gone, come = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
    by_mark: dict[tuple, list[str]] = {}
    for p in gone:
        by_mark.setdefault(old[p], []).append(p)
    moved: dict[str, str] = {}
    for p in come:
        if by_mark.get(new[p]):
            moved[by_mark[new[p]].pop(0)] = p
    taken = set(moved.values())
    out = [(p, "moved", moved[p]) if p in moved else (p, "deleted", None) for p in gone]
    out += [(p, "created", None) for p in come if p not in taken]
    return out + [(p, "modified", None) for p in sorted(old.keys() & new.keys()) if old[p] != new[p]]


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.state = options["path"].rstrip("/") or "/", options["state"].rstrip("/")
        self.existing = options.get("existing", "true").lower() == "true"
        self.next: int | None = None

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        have = [int(n) for n in (os.listdir(self.state) if os.path.isdir(self.state) else []) if n.isdigit()]
        self.next = max([*have, self.next or 0]) + 1
        return {"snapshot": self.next}

    def _folder(self, n: int) -> str:
        return f"{self.state}/{n}"

    def partitions(self, start: dict, end: dict) -> list[Part]:
        names = {TOP}
        try:
            with os.scandir(self.path) as entries:
                names |= {e.name for e in entries if e.is_dir(follow_symlinks=False)}
        except OSError:
            pass
        for n in (start["snapshot"], end["snapshot"]):  # what was there, and what a run before this one has seen
            if os.path.isdir(self._folder(n)):
                names |= {unquote(f.removesuffix(".parquet")) for f in os.listdir(self._folder(n)) if f.endswith(".parquet")}
        return [Part(n, start["snapshot"], end["snapshot"]) for n in sorted(names)]

    def _file(self, n: int, name: str) -> str:
        return f"{self._folder(n)}/{quote(name, safe='') if name != TOP else TOP}.parquet"

    def _known(self, n: int, name: str) -> dict[str, tuple] | None:
        try:
            t = pq.read_table(self._file(n, name), schema=_PART)
        except FileNotFoundError:
            return None
        return dict(zip(t.column(0).to_pylist(), zip(*(t.column(k).to_pylist() for k in (1, 2, 3)))))

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        name, path = partition.name, self._file(partition.end, partition.name)
        new = self._known(partition.end, name)
        if new is None:
            rows = list(found(self.path if name == TOP else f"{self.path}/{name}", name != TOP))
            os.makedirs(os.path.dirname(path), exist_ok=True)
            own = f"{self._folder(partition.end)}/.{uuid.uuid4().hex}"
            pq.write_table(pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PART)], schema=_PART), own)
            try:
                os.link(own, path)  # of two tries of a task the first counts
            except FileExistsError:
                pass
            os.unlink(own)
            new = self._known(partition.end, name)
        old = self._known(partition.start, name)
        if old is None and partition.start == 0 and not self.existing:
            return
        now = os.stat(path).st_mtime_ns // 1000  # when the part was seen, also if the batch is run again
        rows = differences(old or {}, new or {})
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)] + [pa.array([now] * len(rows), pa.timestamp("us", tz="UTC"))], schema=_OUT)

    def commit(self, end: dict) -> None:
        # The snapshot of the last commit stays, and those before it go.
        for n in os.listdir(self.state) if os.path.isdir(self.state) else []:
            if n.isdigit() and int(n) < end["snapshot"]:
                shutil.rmtree(self._folder(int(n)), ignore_errors=True)


class FolderChanges(DataSource):
    """Options: path; state, a shared folder for snapshots; existing (true)."""

    @classmethod
    def name(cls) -> str:
        return "tessera_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(dict(self.options))
