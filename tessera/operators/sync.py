"""Listing, sync, audits, metrics, reconciliation and review over tables of files, roots and comments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import keywords, secret_rules, within
from tessera.operators.store import remapped
from tessera.session import cut
from tessera.sources.policy import Policy


# Listing.
def listing(points: DataFrame) -> DataFrame:
    """(path_key, chunk_count, last_updated, metadata_versions, first_chunk): a row a file, versions with their counts, and the smallest chunk id."""
    by_version = points.groupBy("path_key", "metadata_version").agg(F.count("*").alias("n"), F.max("modified_time").alias("t"), F.min("chunk_id").alias("c"))
    return by_version.groupBy("path_key").agg(F.sum("n").alias("chunk_count"), F.max("t").alias("last_updated"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("metadata_version", "n")))).alias("metadata_versions"), F.min("c").alias("first_chunk"))


def page(rows: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(skip).limit(limit)


def metadata_summary(points: DataFrame, sample: int = 20) -> DataFrame:
    """(metadata_version, chunks, files, is_legacy, sample): of each version its counts, whether it is older than 2, and its first paths."""
    by_file = points.groupBy("metadata_version", "path_key").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("metadata_version").orderBy("path_key"))
    each = by_file.withColumn("place", place).groupBy("metadata_version")
    return each.agg(F.sum("n").alias("chunks"), F.count("*").alias("files"), F.array_sort(F.collect_list(F.when(F.col("place") <= sample, F.col("path_key")))).alias("sample")).withColumn("is_legacy", F.col("metadata_version") < 2)


def clear_preview(points: DataFrame, folder: str) -> DataFrame:
    own = points.where(within("path_key", F.lit(folder)))
    return own.agg(F.count_distinct("path_key").alias("files"), F.count("*").alias("chunks"))


# Sync.
def diff(found: DataFrame, indexed: DataFrame, recursive: bool = True, complete: bool = True) -> DataFrame:
    """(path_key, state): new, unchanged, touched (same hash at another time), changed or removed.

    found, indexed: (path_key, mtime, file_hash). Removals count only where both sides were read whole and with subfolders.
    """
    d, i = found.alias("d"), indexed.alias("i")
    state = (
        F.when(F.col("i.path_key").isNull(), "new")
        .when(F.col("d.path_key").isNull(), "removed")
        .when(F.col("d.mtime") == F.col("i.mtime"), "unchanged")
        .when(F.col("d.file_hash") == F.col("i.file_hash"), "touched")
        .otherwise("changed")
    )
    out = d.join(i, F.col("d.path_key") == F.col("i.path_key"), "full_outer").select(F.coalesce("d.path_key", "i.path_key").alias("path_key"), state.alias("state"))
    return out if recursive and complete else out.where("state <> 'removed'")


def sync_counts(changes: DataFrame) -> DataFrame:
    return changes.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("new", "changed", "touched", "unchanged", "removed")))


# Audit.
def secret_audit(points: DataFrame, policy: Policy | None = None) -> DataFrame:
    """(path_key, chunks, reasons): files with secret paths or contents; never the matched values."""
    codes = F.array_distinct(F.concat((policy or Policy()).secret_reasons(F.col("path_key")), F.transform(secret_rules("chunk_text"), lambda r: F.concat(F.lit("content_signal:"), r))))
    hit = points.select("path_key", codes.alias("codes")).where(F.size("codes") > 0)
    return hit.groupBy("path_key").agg(F.count("*").alias("chunks"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("codes")))).alias("reasons"))


def purged(points: DataFrame, path: str, confirm: bool, policy: Policy | None = None) -> DataFrame:
    """points without a file; only when confirmed, and only for files that the audit reports."""
    if not confirm:
        raise ValueError("purging needs confirm=True")
    own = points.where(F.col("path_key") == path)
    if secret_audit(own, policy).isEmpty():
        raise ValueError(f"not a secret-like file: {path}")
    return points.where(F.col("path_key") != path)


# Outcome metrics.
OUTCOMES = ("success", "zero_result", "error")


def valid_calls(calls: DataFrame) -> DataFrame:
    """What the metrics sink takes: known outcomes only."""
    return calls.where(F.col("outcome").isin(*OUTCOMES))


def calls_sink(path: str):
    """What a stream of calls is given to, foreachBatch(calls_sink(path)): each batch is written under its own number, by day, and a batch that comes again
    replaces itself, so that every call is recorded once. recorded_calls() reads them."""

    def write(batch: DataFrame, number: int) -> None:
        valid_calls(batch).withColumn("day", F.to_date("timestamp")).write.mode("overwrite").partitionBy("day").parquet(f"{path.rstrip('/')}/batch={number}")

    return write


def recorded_calls(spark: SparkSession, path: str) -> DataFrame:
    """The calls of record_calls() or calls_sink(); a batch whose writing has not ended is left out."""
    return spark.read.parquet(path).drop("batch")


def record_calls(calls: DataFrame, path: str) -> None:
    """Appends the valid ones of calls (timestamp, tool_name, session_id, root_path, outcome) to a Parquet table, by day."""
    valid_calls(calls).withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(path)


def outcome_metrics(calls: DataFrame, since: Column | None = None, tool: str | None = None) -> DataFrame:
    """(tool_name, success, zero_result, error, total, success_rate)."""
    c = valid_calls(calls)
    c = c if since is None else c.where(F.col("timestamp") >= since)
    c = c if tool is None else c.where(F.col("tool_name") == tool)
    by = c.groupBy("tool_name").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES), F.count("*").alias("total"))
    return by.withColumn("success_rate", F.round(100 * F.col("success") / F.col("total"), 1))


# Reconciliation of the registry.
def longest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root_id): the deepest root that holds each path; null for none.

    Paths are exploded into their ancestors and joined by equality, so no pair is compared that does not match.
    """
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    tried = paths.select("path", F.explode(up).alias("root_id"))
    best = tried.join(roots.select("root_id").distinct(), "root_id").groupBy("path").agg(F.max_by("root_id", F.length("root_id")).alias("root_id"))
    return paths.select("path").distinct().join(best, "path", "left")


def decided(resolutions: DataFrame, purge: bool = True) -> DataFrame:
    """Decisions (root_id, serving_state, destination) from resolutions (root_id, status, root), as roots.resolve() gives them: a root that is its own is
    active, one within another is remapped to it, linked work trees and bare repositories are quarantined, a folder without a repository is purged
    (or retained), and what is unknown is left as it is."""
    own = F.col("status").isin("supported", "allowlisted")
    state = (
        F.when(own & (F.col("root") == F.col("root_id")), "active")
        .when(own & F.col("root").isNotNull(), "remapped")
        .when(F.col("status").isin("linked_worktree", "bare"), "quarantined")
        .when(F.col("status") == "no_repository", "purged" if purge else "retained")
        .otherwise("transient")
    )
    out = resolutions.select("root_id", state.alias("serving_state"), F.when(state == "remapped", F.col("root")).alias("destination"))
    return followed(out)


def followed(decisions: DataFrame) -> DataFrame:
    """decisions with the destinations that chains of remaps lead to in the end; steps double in each round. A chain that runs in a circle leads to the
    smallest root of the circle, which stays active."""
    d = cut(decisions)
    moves = d.where("serving_state = 'remapped'").select("root_id", F.col("destination").alias("to"), F.col("destination").alias("low"))
    n = moves.count()
    for _ in range(max(1, n.bit_length() + 1)):
        far = moves.select(F.col("root_id").alias("to"), F.col("to").alias("further"), F.col("low").alias("far_low"))
        step = cut(moves.join(far, "to", "left").select("root_id", F.coalesce("further", "to").alias("to"), F.least("low", F.coalesce("far_low", "low")).alias("low"), F.col("further").isNotNull().alias("went")))
        moves = step.select("root_id", "to", "low")
        if step.where("went").isEmpty():
            break
    # After more steps than there are moves, what still leads to a remapped root leads round in a circle.
    circle = moves.join(moves.select(F.col("root_id").alias("to"), F.col("low").alias("least")), "to", "left")
    end = circle.select("root_id", F.coalesce("least", "to").alias("end"))
    out = d.join(end, "root_id", "left")
    stays = F.col("end") == F.col("root_id")
    return out.select("root_id", F.when(stays, "active").otherwise(F.col("serving_state")).alias("serving_state"), F.when(~F.coalesce(stays, F.lit(False)), F.coalesce("end", "destination")).alias("destination"))


def reconciled(registry: DataFrame, decisions: DataFrame) -> DataFrame:
    """Registered roots after decisions (root_id, serving_state, destination): remapped ones replaced, purged ones gone, repeats merged."""
    out = registry.select("root_id").join(decisions, "root_id", "left")
    return out.where(~F.coalesce(F.col("serving_state") == "purged", F.lit(False))).select(F.when(F.col("serving_state") == "remapped", F.col("destination")).otherwise(F.col("root_id")).alias("root_id")).distinct()


def reconcile(registry: DataFrame, decisions: DataFrame, points: DataFrame, contribs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(registry, points, contributions, counts) after decisions (root_id, serving_state, destination): rows of remapped roots go to their
    destinations, those of purged ones go, all others stay as they are."""
    moved = decisions.where("serving_state = 'remapped'").select(F.col("root_id").alias("source"), "destination")
    purged = decisions.where("serving_state = 'purged'").select("root_id")
    kept = lambda t: remapped(t.join(purged, "root_id", "left_anti"), moved)
    return reconciled(registry, decisions), kept(points), kept(contribs), reconcile_counts(decisions)


def unclassified(registry: DataFrame, decisions: DataFrame) -> DataFrame:
    return registry.join(decisions, "root_id", "left_anti")


def reconcile_counts(decisions: DataFrame) -> DataFrame:
    states = ("active", "remapped", "quarantined", "purged", "transient", "retained")
    return decisions.agg(*(F.count_if(F.col("serving_state") == s).alias(s) for s in states), F.count_if(F.col("serving_state").isin("retained", "transient")).alias("skipped"))


def lock_conflicts(held: DataFrame) -> DataFrame:
    """(a, b): pairs of held paths of which one holds the other; by ancestors, not by comparing all."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    own = held.select("path").distinct()
    return own.select(F.col("path").alias("b"), F.explode(up).alias("a")).where("a <> b").join(own.select(F.col("path").alias("a")), "a", "left_semi").select("a", "b")


# Review threads.
def near_lines(findings: DataFrame, hunks: DataFrame, slack: int = 2) -> DataFrame:
    """Findings on lines within slack of a changed range (path, first, last) of their file."""
    h = hunks.select(F.col("path").alias("p"), "first", "last")
    return findings.join(h, (F.col("path") == F.col("p")) & F.col("line").between(F.col("first") - slack, F.col("last") + slack), "left_semi")


def already_raised(findings: DataFrame, threads: DataFrame, tolerance: int = 3, shared: int = 3) -> DataFrame:
    """(finding_id, thread_id): the first thread on the same path near the line or with enough keywords in common; null for new findings."""
    f, t = findings.withColumn("fk", keywords("text")), threads.select("thread_id", F.col("path").alias("tp"), F.col("line").alias("tl"), keywords("body").alias("tk"))
    alike = (F.abs(F.col("line") - F.col("tl")) <= tolerance) | (F.size(F.array_intersect("fk", "tk")) >= shared)
    m = f.join(t, (F.col("path") == F.col("tp")) & alike).groupBy("finding_id").agg(F.min("thread_id").alias("thread_id"))
    return findings.select("finding_id").join(m, "finding_id", "left")


def triage(threads: DataFrame) -> DataFrame:
    """(status, n): outdated, resolved or open."""
    status = F.when(F.col("is_resolved"), "resolved").when(F.col("is_outdated"), "outdated").otherwise("open")
    return threads.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def latest_comments(comments: DataFrame) -> DataFrame:
    """(thread_id, body, n): the newest comment of each thread and how many there are."""
    return comments.groupBy("thread_id").agg(F.max_by("body", F.struct("created_at", "comment_id")).alias("body"), F.count("*").alias("n"))


def hunk_lines(lines: DataFrame) -> DataFrame:
    """(diff_id, path, first, last) of the new side of diffs' hunks. lines: (diff_id, n, line); the file is that of the last +++ line above."""
    t = lines.select("diff_id", "n", F.regexp_extract("line", r"^\+\+\+ b/(.*)$", 1).alias("file"), "line")
    above = F.last(F.when(F.col("file") != "", F.col("file")), ignorenulls=True).over(Window.partitionBy("diff_id").orderBy("n"))
    m = lambda g: F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", g)
    h = t.withColumn("path", above).where(F.startswith("line", F.lit("@@ "))).select("diff_id", "path", m(1).try_cast("int").alias("first"), F.coalesce(m(2).try_cast("int"), F.lit(1)).alias("k"))
    return h.where("k > 0").select("diff_id", "path", "first", (F.col("first") + F.col("k") - 1).alias("last"))


def comment_drafts(findings: DataFrame) -> DataFrame:
    """(finding_id, path, line, body) of findings (finding_id, path, line, severity, title, description, fix): severity and title, then what
    is given of the description and the fix, with blank lines between."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    head = F.concat(F.lit("["), F.coalesce("severity", F.lit("UNSPECIFIED")), F.lit("] "), F.coalesce("title", F.lit("Review finding")))
    body = F.concat_ws("\n\n", head, blank(F.col("description")), F.when(F.col("fix") != "", F.concat(F.lit("Suggested fix: "), F.col("fix"))))
    return findings.select("finding_id", "path", "line", F.trim(body).alias("body"))


def summary_lines(rows: DataFrame, category: str, label: str, cap: int = 50) -> DataFrame:
    """(category, labels, total, more): the commonest labels of each category up to cap, and how many are left out."""
    w = Window.partitionBy(category).orderBy(F.desc("n"), label)
    by = rows.groupBy(category, label).agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(w))
    return by.groupBy(category).agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("place") <= cap, F.struct("place", F.concat(F.col(label), F.lit(": "), F.col("n").cast("string")).alias("t"))))), lambda x: x["t"]).alias("labels"), F.sum("n").alias("total"), F.count_if(F.col("place") > cap).alias("more"))


def history_page(prompts: DataFrame, contains: str | None, end: int, size: int) -> DataFrame:
    """The page of prompts that ends at place `end` from the newest; newest first."""
    p = prompts if contains is None else prompts.where(F.contains(F.lower("text"), F.lit(contains.lower())))
    return p.orderBy(F.desc("at"), F.desc("prompt_id")).offset(max(end - size, 0)).limit(size)
