"""The stream of file changes: batches by quiet time and by age, applied by the files' state when the batch is flushed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.session import ship
from tessera.streaming.watch import FolderChanges

QUIET_S, MAX_AGE_S = 2.0, 10.0


def file_events(events: DataFrame) -> DataFrame:
    """(root_id, path, kind, ts) with moves as a deletion and a creation. events: (root_id, path, kind, ts, moved_to)."""
    two = F.array(F.struct(F.col("path").alias("path"), F.when(F.col("kind") == "moved", "deleted").otherwise(F.col("kind")).alias("kind")), F.when(F.col("kind") == "moved", F.struct(F.col("moved_to").alias("path"), F.lit("created").alias("kind"))))
    return events.select("root_id", "ts", F.explode(F.array_compact(two)).alias("e")).select("root_id", "e.path", "e.kind", "ts")


def quiet_batches(events: DataFrame, quiet: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """(root_id, start, end, paths): events with no pause as long as quiet, by session windows. Works on streams and on tables.

    Spark joins windows that touch, so theirs are a microsecond shorter: a pause of just quiet parts, as in split_batches()."""
    ts = F.col("ts").cast("timestamp")
    e = events.select("root_id", "path", ts.alias("ts"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    return e.groupBy("root_id", F.session_window("ts", f"{quiet} -1 microseconds").alias("w")).agg(F.array_sort(F.collect_set("path")).alias("paths")).select("root_id", F.col("w.start").alias("start"), (F.col("w.end") + F.expr("interval 1 microsecond")).alias("end"), "paths")


def split_batches(times: list[float], quiet: float = QUIET_S, max_age: float = MAX_AGE_S) -> list[int]:
    """The batch of each event in order of time: a new one after a pause of quiet, or once a batch is max_age old."""
    out, batch, first, last = [], 0, None, None
    for t in times:
        if last is not None and (t - last >= quiet or t - first >= max_age):
            batch, first = batch + 1, t
        first = t if first is None else first
        last = t
        out.append(batch)
    return out


def debounced_table(events: DataFrame, quiet: float = QUIET_S, max_age: float = MAX_AGE_S) -> DataFrame:
    """(root_id, batch, first_ts, last_ts, paths) of a table of events (root_id, path, ts).

    Pauses part a root's events into bursts by window functions; only a burst, which must be read in order for the age rule, is one group.
    """
    e = events.select("root_id", "path", F.col("ts").cast("timestamp").cast("double").alias("t"))
    w = Window.partitionBy("root_id").orderBy("t", "path")
    new = F.coalesce((F.col("t") - F.lag("t").over(w) >= quiet).cast("int"), F.lit(0))
    e = e.withColumn("new", new).withColumn("burst", F.sum("new").over(w)).drop("new")

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["t", "path"])
        x["part"] = split_batches(x.t.tolist(), quiet, max_age)
        g = x.groupby("part")
        return pd.DataFrame({"root_id": g.root_id.first(), "burst": g.burst.first(), "part": g.part.first(), "first_ts": g.t.min(), "last_ts": g.t.max(), "n_events": g.t.size(), "paths": g.path.agg(lambda p: sorted(set(p)))})

    # Only bursts that last max_age can be parted; all others, nearly all, are batches as they are.
    bursts = e.groupBy("root_id", "burst").agg(F.lit(0).alias("part"), F.min("t").alias("first_ts"), F.max("t").alias("last_ts"), F.count("*").alias("n_events"), F.array_sort(F.collect_set("path")).alias("paths"))
    lasting = F.col("last_ts") - F.col("first_ts") >= max_age
    parted = e.join(bursts.where(lasting).select("root_id", "burst"), ["root_id", "burst"], "left_semi").groupBy("root_id", "burst").applyInPandas(run, "root_id string, burst long, part int, first_ts double, last_ts double, n_events long, paths array<string>")
    return bursts.where(~lasting).unionByName(parted)


def debounced_stream(events: DataFrame, quiet: float = QUIET_S, max_age: float = MAX_AGE_S) -> DataFrame:
    """(root_id, first_ts, last_ts, paths) of a stream: flushed when quiet, or when a batch is max_age old, by timers in processing time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, paths = state.get if state.exists else (0.0, 0.0, [])
        now = state.getCurrentProcessingTimeMs() / 1000
        if not state.hasTimedOut:
            fresh = sorted({p for x in batches for p in x.path})
            if fresh:
                first, last, paths = (first if paths else now), now, sorted({*paths, *fresh})
        if paths and (state.hasTimedOut or now - first >= max_age):
            yield pd.DataFrame({"root_id": [key[0]], "first_ts": [first], "last_ts": [last], "paths": [paths]})
            state.remove()
        elif paths:
            state.update((first, last, paths))
            state.setTimeoutDuration(max(1, int(1000 * min(quiet, first + max_age - now))))

    ship(events.sparkSession)
    return events.groupBy("root_id").applyInPandasWithState(run, "root_id string, first_ts double, last_ts double, paths array<string>", "first double, last double, paths array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def apply_batch(changed: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(path, action): what a flush does for each path, by what is on disk now and not by the kind of event."""
    p = changed.select(F.explode("paths").alias("path")).distinct()
    there = on_disk.select("path", F.lit(True).alias("there"))
    return p.join(there, "path", "left").select("path", F.when(F.col("there"), "index").otherwise("remove").alias("action"))


def touched_folders(changed: DataFrame) -> DataFrame:
    """(root_id, folder) in which a batch's paths lie: what is looked at again, in case events were lost."""
    return changed.select("root_id", F.explode("paths").alias("path")).select("root_id", F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()


def event_source(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of file events from JSON lines that a watcher appends: (root_id, path, kind, moved_to, ts); kinds created, modified, deleted, moved."""
    raw = spark.readStream.schema("root_id string, path string, kind string, moved_to string, ts timestamp").json(folder)
    return file_events(raw.where(F.col("kind").isin("created", "modified", "deleted", "moved")))


def folder_source(spark: SparkSession, folder: str, state: str, existing: bool = False) -> DataFrame:
    """A stream of file events (root_id, path, kind, ts) of a folder, by watch.FolderChanges; state: a shared folder for its snapshots."""
    ship(spark).dataSource.register(FolderChanges)
    raw = spark.readStream.format("tessera_changes").option("path", folder).option("state", state).option("existing", str(existing).lower()).load()
    return file_events(raw.withColumn("root_id", F.lit(folder)))


def start_watch(events: DataFrame, checkpoint: str, flush, **trigger):
    """Starts the stream: flush(batch, id) for each micro-batch of debounced changes. One query owns a checkpoint folder, so a
    second one on it fails until the first has ended."""
    return debounced_stream(events).writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()
