"""Tables kept as plain Parquet generations, and the updates of them as expressions.

A publication writes folders of its own; then one commit, a small file that only one writer can create, names the folders of
all tables, so readers see all of them or none. Nothing is changed in place. Tables with a key lie in buckets by a hash of it: a
revision writes the buckets anew in which a key has changed, and its commit keeps the folders of all others.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.scalars import file_name, suffix


# Updates as expressions over tables.
def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys; of rows of new with equal keys one stays."""
    new = new.dropDuplicates(keys)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def without(old: DataFrame, condition: Column) -> DataFrame:
    """old without the rows for which the condition holds; null does not delete."""
    return old.where(~F.coalesce(condition, F.lit(False)))


def without_document(points: DataFrame, path: str) -> DataFrame:
    return without(points, (F.col("path_key") == path) | (F.col("file_path") == path))


def without_surplus(points: DataFrame, counts: DataFrame) -> DataFrame:
    """Chunks of re-read documents beyond their new number. counts: (path_key, n)."""
    out = points.join(counts.select("path_key", F.col("n").alias("new_n")), "path_key", "left")
    return out.where(F.col("new_n").isNull() | (F.col("chunk_id") < F.col("new_n"))).select(*points.columns)


def remapped(table: DataFrame, roots: DataFrame) -> DataFrame:
    """table with root ids replaced as roots (source, destination) says."""
    r = roots.select(F.col("source").alias("root_id"), "destination")
    return table.join(r, "root_id", "left").withColumn("root_id", F.coalesce("destination", "root_id")).select(*table.columns)


def looked_up(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows with the ids asked for, score 1; unknown ids give nothing."""
    return table.join(ids.select(key).distinct(), key, "left_semi").withColumn("score", F.lit(1.0))


def bounded(table: DataFrame, n: int, order: str) -> tuple[DataFrame, bool]:
    """The first n rows in an order, and whether there were more."""
    more = table.select(order).orderBy(order).limit(n + 1).count() > n
    return table.orderBy(order).limit(n), more


def backfilled(points: DataFrame, names: DataFrame) -> DataFrame:
    """points with entity_names set where names (point_id, entity_names) has them."""
    n = names.select("point_id", F.col("entity_names").alias("new_names"))
    return points.join(n, "point_id", "left").withColumn("entity_names", F.coalesce("new_names", "entity_names")).select(*points.columns)


def replaced_file(contribs: DataFrame, new: DataFrame) -> DataFrame:
    """Contributions with those of the files of new replaced by new: what edges and degrees are then computed from, once for the batch."""
    return contribs.join(new.select("root_id", "file_path").distinct(), ["root_id", "file_path"], "left_anti").unionByName(new)


def without_file(contribs: DataFrame, root_id: str, path: str) -> DataFrame:
    return without(contribs, (F.col("root_id") == root_id) & (F.col("file_path") == path))


def file_record(points: DataFrame) -> DataFrame:
    """What points of any payload version say of their file. Fields that a version lacks, or has blank, are taken from those that it has."""
    have = set(points.columns)

    def filled(*names: str) -> Column:
        return F.coalesce(*(F.when(F.col(n).cast("string") != "", F.col(n).cast("string")) for n in names if n in have), F.lit(None).cast("string"))

    path = filled("path_key", "file_path")
    version = F.coalesce(F.col("metadata_version").cast("int"), F.lit(1)) if "metadata_version" in have else F.lit(1)
    plain = [filled(n).alias(n) for n in ("relative_path", "root_path", "root_id", "file_type", "file_hash", "file_size", "mtime_ns", "chunk_count")]
    return points.select(
        path.alias("file_path"), path.alias("path_key"), F.coalesce(filled("file_name"), file_name(path)).alias("file_name"), F.coalesce(filled("display_path"), path).alias("display_path"),
        F.coalesce(filled("extension"), suffix(path)).alias("extension"), filled("modified_time", "indexed_at", "indexed_time").alias("last_updated"), version.alias("metadata_version"), (version < 2).alias("legacy_metadata"), *plain,
    )


CORE_FIELDS = ("file_path", "file_name", "chunk_id", "chunk_text", "start_char", "end_char")


def other_fields(points: DataFrame) -> DataFrame:
    """points with the fields of the core and, as metadata, a struct of all others."""
    rest = [c for c in points.columns if c not in CORE_FIELDS]
    return points.select(*(c for c in points.columns if c in CORE_FIELDS), F.struct(*rest).alias("metadata"))


def kept_build(rows: DataFrame, build: object) -> DataFrame:
    """Rows of the committed build alone: what other builds have left goes."""
    return rows.where(F.col("build_id") == F.lit(build))


def payload(points: DataFrame) -> DataFrame:
    """Version 3 of a chunk's payload from points (path_key, root_id, chunk_text, ...); missing link fields are empty or null."""
    have = set(points.columns)
    col = lambda c, default: F.col(c) if c in have else default.alias(c)
    none = F.array().cast("array<string>")
    return points.select(
        F.lit(3).alias("metadata_version"), F.lit("chunk").alias("schema"), F.md5("path_key").alias("doc_id"), "path_key", F.col("path_key").alias("file_path"), F.substring_index("path_key", "/", -1).alias("file_name"), F.col("path_key").alias("display_path"),
        F.expr("substring(path_key, length(root_id) + 2)").alias("relative_path"), F.col("root_id").alias("root_path"), "root_id", "extension", "file_type", "chunk_id", "chunk_text", "start_char", "end_char", F.sha2("chunk_text", 256).alias("chunk_hash"),
        col("entity_names", none), col("imported_modules", none), col("called_symbols", none), col("parent_symbol", F.lit(None).cast("string")), col("symbol_type", F.lit(None).cast("string")), col("line_start", F.lit(None).cast("int")), col("line_end", F.lit(None).cast("int")),
    )


# Generations and their commits.
class Conflict(RuntimeError):
    """Another writer has published since the state that was read."""


@dataclass
class Revision:
    """A change of a keyed table: the keys whose rows go (a DataFrame with the key's column), and the rows that come, also of other keys."""

    gone: DataFrame
    new: DataFrame


@dataclass
class Store:
    """Generations of named tables under a folder that driver and executors share.

    keys: the key column of the tables that lie in buckets. Commits are files numbered by version; a version is created once, so of two writers of
    one version the second gets a Conflict. Local folders create by linking, others by the file system's create without overwriting.
    """

    spark: SparkSession
    folder: str
    keys: dict[str, str] = field(default_factory=dict)
    buckets: int = 32

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        p, fs = self._fs(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def state(self) -> dict:
        last = [n for n in self._names(f"{self.folder}/_commits") if n.endswith(".json") and n[0] != "."]
        if not last:
            return {"version": 0, "tables": {}, "graph_version": 0}
        return self._json(f"{self.folder}/_commits/{last[-1]}")

    def _json(self, path: str) -> dict:
        p, fs = self._fs(path)
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, expected: int, new: dict) -> dict:
        """Names a new state, if no other writer has since version `expected`."""
        if self.state()["version"] != expected:
            raise Conflict(f"version {self.state()['version']}, not {expected}")
        new = new | {"version": expected + 1, "commit": uuid.uuid4().hex}
        self._create(f"{self.folder}/_commits", f"{new['version']:012d}.json", json.dumps(new, sort_keys=True))
        return new

    def _create(self, folder: str, name: str, text: str) -> None:
        p, fs = self._fs(f"{folder}/{name}")
        local = re.sub("^file:/*", "/", folder) if folder.startswith(("/", "file:")) else None
        if local:
            os.makedirs(local, exist_ok=True)
            own = f"{local}/.{uuid.uuid4().hex}"
            with open(own, "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(own, f"{local}/{name}")
            except FileExistsError:
                raise Conflict(f"{name} is another writer's") from None
            finally:
                os.unlink(own)
            return
        try:
            stream = fs.create(p, False)
        except Py4JJavaError as e:
            if "exist" in str(e.java_exception).lower():
                raise Conflict(f"{name} is another writer's") from None
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        return self._read(self.state()["tables"][name])

    def _read(self, own: dict, only: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(own["schema"])
        paths = [own["path"]] if "path" in own else [p for b, p in own["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows_of(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows with these keys (a column named like the table's key), from the buckets that can hold them."""
        key = self.keys[name]
        buckets = [x.b for x in keys.select(self._bucket(name).alias("b")).distinct().collect()]  # at most as many as there are buckets
        return self._read(self.state()["tables"][name], buckets).join(keys.select(key).distinct(), key, "left_semi")

    def has(self, name: str) -> bool:
        return name in self.state()["tables"]

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(self.keys[name]), F.lit(self.buckets)).cast("int")

    def _written(self, name: str, df: DataFrame) -> dict:
        path = f"{self.folder}/{name}/generation={uuid.uuid4().hex}"
        schema = json.loads(df.schema.json())
        if name not in self.keys:
            df.write.parquet(path)
            return {"path": path, "schema": schema}
        # Rows of a root lie together, so filters on it skip row groups.
        order = ["_b", *(c for c in ("root_id",) if c in df.columns)]
        df.withColumn("_b", self._bucket(name)).repartition("_b").sortWithinPartitions(*order).write.partitionBy("_b").parquet(path)
        found = {n.removeprefix("_b="): f"{path}/{n}" for n in self._names(path) if n.startswith("_b=")}
        return {"buckets": found, "schema": schema, "n": self.buckets}

    def publish(self, expected: int | None = None, dirty: bool = False, committed: tuple[str, int] | None = None, extra: dict | None = None, **tables: DataFrame | Revision) -> dict:
        """Writes new generations of tables, or of what a Revision touches, then names them all by one commit. With dirty the graph is marked as
        changed by the same commit; committed names a build and the version of the graph that it was made from; extra is told with the state."""
        now = self.state()
        made = {name: self._revised(name, now["tables"].get(name), x) if isinstance(x, Revision) else self._written(name, x) for name, x in tables.items()}
        new = now | (extra or {}) | {"tables": now["tables"] | made}
        if dirty:
            new |= {"graph_version": now.get("graph_version", 0) + 1, "committed_build_id": None}
        if committed:
            new |= {"committed_build_id": committed[0], "communities_version": committed[1]}
        return self.commit(now["version"] if expected is None else expected, new)

    def _revised(self, name: str, own: dict | None, r: Revision) -> dict:
        if own is None:
            return self._written(name, r.new)
        if own.get("n") != self.buckets:
            raise ValueError(f"{name} lies in {own.get('n')} buckets, not {self.buckets}")
        key = self.keys[name]
        keys = r.gone.select(key).union(r.new.select(key)).distinct()
        touched = [x.b for x in keys.select(self._bucket(name).alias("b")).distinct().collect()]  # at most as many as there are buckets
        old = self._read(own, touched).join(r.gone.select(key).distinct(), key, "left_anti")
        made = self._written(name, old.unionByName(r.new).select(*old.columns))
        kept = {b: p for b, p in own["buckets"].items() if int(b) not in touched}
        return made | {"buckets": kept | made["buckets"], "schema": own["schema"]}

    def reset(self, *names: str) -> dict:
        now = self.state()
        return self.commit(now["version"], now | {"tables": {k: v for k, v in now["tables"].items() if k not in names}})

    def commit_communities(self, build_id: str, graph_version: int, **tables: DataFrame) -> bool:
        """Publishes a build, tables and name in one commit, if the graph is still the one that it was made from and no build of it is committed."""
        now = self.state()
        if now.get("graph_version", 0) != graph_version or now.get("committed_build_id") is not None:
            return False
        try:
            self.publish(now["version"], committed=(build_id, graph_version), **tables)
        except Conflict:
            return False
        return True

    def is_dirty(self) -> bool:
        now = self.state()
        return now.get("graph_version", 0) != now.get("communities_version") or now.get("committed_build_id") is None

    def sweep(self, keep: int = 2) -> int:
        """Deletes commits before the last `keep`, and the folders that only they name; the number of folders. Readers of older states must have ended."""
        names = [n for n in self._names(f"{self.folder}/_commits") if n.endswith(".json") and n[0] != "."]
        used: set[str] = set()
        for n in names[-keep:]:
            for t in self._json(f"{self.folder}/_commits/{n}")["tables"].values():
                used |= {t["path"]} if "path" in t else set(t["buckets"].values())
        gone = 0
        for t in self._names(self.folder):
            for g in self._names(f"{self.folder}/{t}") if t != "_commits" else []:
                base = f"{self.folder}/{t}/{g}"
                mine = {u for u in used if u == base or u.startswith(base + "/")}
                dead = [base] if not mine else [f"{base}/{b}" for b in self._names(base) if b.startswith("_b=") and f"{base}/{b}" not in used]
                for d in dead if base not in used else []:
                    p, fs = self._fs(d)
                    fs.delete(p, True)
                    gone += 1
        for n in names[:-keep]:
            p, fs = self._fs(f"{self.folder}/_commits/{n}")
            fs.delete(p, False)
        return gone


def dirty(graph_version: Column, communities_version: Column, build: Column) -> Column:
    return ~graph_version.eqNullSafe(communities_version) | build.isNull()
