"""Files under a root as DataFrames: bounded scans with skip reasons, ignore rules, contents, hashes and types."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import file_name, iso_utc, suffix
from tessera.session import cut, ship
from tessera.sources import listing as source
from tessera.sources.policy import Policy, file_type, ignore_rules, left_out

MAX_FILE_BYTES = 50 << 20
CONTENT_BATCH = 16 << 20  # bytes of contents that a task holds at a time
FEW_RULES = 20_000  # folders with ignore files that are broadcast


def listing(spark: SparkSession, root: str, recursive: bool = True, pruned: tuple[str, ...] = (), max_seconds: float | None = None) -> DataFrame:
    """(path, size, mtime_ns, modified, kind): every file under root, or root itself, and what is not walked and why, by kind; folders named like a
    glob of pruned are not entered. After max_seconds what is left is of kind not_listed. Written once; no content is read.

    Rounds of the data source of listing.py: what a task leaves is dealt to others."""
    ship(spark).dataSource.register(source.Files)
    deadline = None if max_seconds is None else time.time() + max_seconds
    bounds = source.Bounds(recursive, pruned, deadline)
    options = {"path": root, "recursive": str(recursive), "pruned": "\n".join(pruned)} | ({} if deadline is None else {"deadline": repr(deadline)})
    found = cut(spark.read.format("tessera_files").options(**options).load())
    every = found.where(F.col("kind") != source.NOT_LISTED)
    left = found.where(F.col("kind") == source.NOT_LISTED)

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield from source.walk(x.column(0).to_pylist(), bounds)

    while not bounds.over() and not left.isEmpty():
        found = cut(left.select("path").repartition(source.TASKS, "path").mapInArrow(more, source.SCHEMA))
        every = every.union(found.where(F.col("kind") != source.NOT_LISTED))
        left = found.where(F.col("kind") == source.NOT_LISTED)
    out = every.union(left).where(F.col("kind") != source.FOLDER)
    return out.select("path", "size", "mtime_ns", F.timestamp_micros(F.expr("mtime_ns div 1000")).alias("modified"), "kind")


def files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """listing() of files alone, whatever their names."""
    return listing(spark, root, recursive).where(F.col("kind") == source.FILE)


def contents(found: DataFrame) -> DataFrame:
    """(path, content) of found (path, ...), read by the tasks, a few files at a time; a file that cannot be read has a null content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths, raw in _opened(batches):
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(raw, pa.binary())], ["path", "content"])

    ship(found.sparkSession)
    return found.select("path").mapInArrow(run, "path string, content binary")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes | None]]]:
    paths, raw, size = [], [], 0
    for x in batches:
        for p in x.column(0).to_pylist():
            try:
                if source.is_remote(p):
                    from pyarrow import fs

                    system, base = fs.FileSystem.from_uri(p)
                    with system.open_input_stream(base) as f:
                        c = f.read()
                else:
                    with open(p, "rb") as f:
                        c = f.read()
            except OSError:
                c = None
            paths.append(p)
            raw.append(c)
            size += len(c or b"")
            if size >= CONTENT_BATCH:
                yield paths, raw
                paths, raw, size = [], [], 0
    if paths:
        yield paths, raw


def hashed(found: DataFrame) -> DataFrame:
    """(path, file_hash): the MD5 of the contents of found (path, ...); null where they cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths, raw in _opened(batches):
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([None if c is None else hashlib.md5(c).hexdigest() for c in raw], pa.string())], ["path", "file_hash"])

    ship(found.sparkSession)
    return found.select("path").mapInArrow(run, "path string, file_hash string")


# Ignore files.
def ignore_files(root: str, found: DataFrame) -> DataFrame:
    """(folder, text): the texts of .gitignore among the files of listing(), by the folder that they hold for, and of .git/info/exclude for root."""
    base = root.rstrip("/")
    own = found.where((F.col("kind") == source.FILE) & (file_name("path") == ".gitignore")).select("path")
    extra = found.sparkSession.createDataFrame([(f"{base}/.git/info/exclude",)], "path string")
    folder = F.when(F.endswith("path", F.lit("/.git/info/exclude")), F.lit(base)).otherwise(F.regexp_replace("path", "/[^/]*$", ""))
    read = contents(own.union(extra)).where("content is not null")
    return read.select(F.when(folder == "", "/").otherwise(folder).alias("folder"), F.decode("content", "UTF-8").alias("text")).where(F.trim("text") != "")


def ancestors(path: Column | str) -> Column:
    """The folders above a path, '/' for the topmost."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return F.transform(above, lambda f: F.when(f == "", F.lit("/")).otherwise(f))


def gitignored(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(path): those of found (path, ...) that an ignore file of texts (folder, text) above them leaves out, as policy.left_out()
    says; any file that ignores a path wins.

    Rules are grouped by folder and meet paths by a join on the folders above them; folders with rules are broadcast while they are few."""
    rules = cut(ignore_rules(texts))
    if rules.limit(FEW_RULES + 1).count() <= FEW_RULES:
        rules = F.broadcast(rules)
    each = found.select("path", F.explode(ancestors("path")).alias("folder")).join(rules, "folder")
    below = F.when(F.col("folder") == "/", F.expr("substring(path, 2)")).otherwise(F.expr("substring(path, length(folder) + 2)"))
    each = each.withColumn("below", below).where(F.rlike("below", F.col("any_rule")))
    return each.where(left_out(F.col("below"), F.col("rules"))).select("path").distinct()


def scan_plan(found: DataFrame, policy: Policy | None = None, ignore: DataFrame | None = None, max_files: int | None = None, max_dirs: int | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """found (path, size, ...) with action, reason_codes and limit_hit. ignore: (folder, text) of ignore files. All files take part unless a bound is
    asked for: then files beyond max_files, and those of folders beyond max_dirs, in order of paths, are skipped and marked, as are folders
    that a listing did not reach. Rows of other kinds than files are skipped for the reason that their kind gives."""
    d = (policy or Policy()).decision("path")
    if "kind" not in found.columns:
        found = found.withColumn("kind", F.lit(source.FILE))
    if ignore is None:
        found = found.withColumn("left_out", F.lit(False))
    else:
        found = found.join(gitignored(found, ignore).withColumn("left_out", F.lit(True)), "path", "left")
    own, late = F.col("kind") == source.FILE, F.col("kind") == source.NOT_LISTED
    more = F.array_compact(F.array(F.when(F.col("size") > max_bytes, F.lit("file_too_large")), F.when(F.col("left_out"), F.lit("gitignored"))))
    codes = F.when(own, F.concat(d["reason_codes"], more)).when(late, F.array().cast("array<string>")).otherwise(F.array("kind"))
    out = found.withColumn("reason_codes", codes).withColumns({"secret_risk": d["secret_risk"], "limit_hit": late}).drop("left_out")
    fits = F.size("reason_codes") == 0
    folder = F.regexp_replace("path", "/[^/]*$", "")
    # The bounds are top-k: only so many paths are kept by each task.
    if max_dirs is not None:
        first = out.where(fits & ~F.col("limit_hit")).select(folder.alias("in_dir")).distinct().orderBy("in_dir").limit(max_dirs).withColumn("dir_fits", F.lit(True))
        out = out.withColumn("in_dir", folder).join(first, "in_dir", "left").withColumn("limit_hit", F.col("limit_hit") | (fits & F.col("dir_fits").isNull())).drop("in_dir", "dir_fits")
    if max_files is not None:
        first = out.where(fits & ~F.col("limit_hit")).select("path").orderBy("path").limit(max_files).withColumn("file_fits", F.lit(True))
        out = out.join(first, "path", "left").withColumn("limit_hit", F.col("limit_hit") | (fits & F.col("file_fits").isNull())).drop("file_fits")
    return out.withColumn("action", F.when(fits & ~F.col("limit_hit"), F.lit("index")).otherwise(F.lit("skip")))


def skip_counts(plan: DataFrame) -> DataFrame:
    """(reason, files): how many files each reason keeps out; limit for those beyond a bound."""
    why = F.when(F.col("limit_hit"), F.array(F.lit("limit"))).otherwise(F.col("reason_codes"))
    return plan.where("action = 'skip'").select(F.explode(why).alias("reason")).groupBy("reason").agg(F.count("*").alias("files"))


def texts(found: DataFrame) -> DataFrame:
    """found (path, size, modified, mtime_ns, ...) with text, file_hash, file_type, file_name, extension and modified_time; UTF-8, else Latin-1. Files that
    cannot be read are left out."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths, raw in _opened(batches):
            keep = [k for k, c in enumerate(raw) if c is not None]
            out = []
            for k in keep:
                try:
                    out.append(raw[k].decode("utf-8"))
                except UnicodeDecodeError:
                    out.append(raw[k].decode("latin-1"))
            yield pa.RecordBatch.from_arrays([pa.array([paths[k] for k in keep], pa.string()), pa.array(out, pa.string()), pa.array([hashlib.md5(raw[k]).hexdigest() for k in keep], pa.string())], ["path", "text", "file_hash"])

    ship(found.sparkSession)
    got = found.select("path").mapInArrow(decode, "path string, text string, file_hash string").join(found.select("path", "size", "modified", "mtime_ns"), "path")
    return got.select("*", file_type("path").alias("file_type"), file_name("path").alias("file_name"), suffix("path").alias("extension"), iso_utc(F.expr("mtime_ns div 1000000000")).alias("modified_time"))
