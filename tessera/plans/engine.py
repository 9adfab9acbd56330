"""The engine's surface: index, sync, search in three channels, communities, audits, and clearing, over one store.

Methods build DataFrames over the generation that the last commit names and publish new ones; results are DataFrames of bounded
size or small dictionaries of counts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.identity import chunk_id
from tessera.functions.scalars import iso_utc, split_long_lines, within
from tessera.operators import cache, chunk, community, extract, graph, search, store, sync
from tessera.session import cut, ship
from tessera.sources import scan
from tessera.sources.policy import Policy

TARGET_ENTITIES, TARGET_SHARE, TOP_REPORTS = 20, 0.3, 3
POINTS, CONTRIBS, MENTIONS, VECTORS = "points", "contribs", "mentions", "entity_vectors"
#: Kept by changes from contributions and mentions: sums of edges, degrees, and how often an entity is used.
EDGES, DEGREES, USES = "edge_sums", "degrees", "uses"
KEYS = {POINTS: "path_key", CONTRIBS: "file_path", MENTIONS: "file_path", VECTORS: "entity_id", EDGES: "edge_id", DEGREES: "entity_id", USES: "entity_id"}


class Answerer(Protocol):
    """Writes an answer to a query from a context."""

    def answer(self, query: str, context: str) -> str: ...


@dataclass
class Engine:
    spark: SparkSession
    folder: str
    embedder: extract.Embedder = field(default_factory=extract.HashEmbedder)
    extractor: extract.Extractor | None = None
    summarizer: extract.Summarizer | None = None
    reporter: community.Reporter | None = None
    answerer: Answerer | None = None
    policy: Policy = field(default_factory=Policy)
    size: int = chunk.SIZE
    overlap: int = chunk.OVERLAP
    alpha: float = 0.0
    gleanings: int = 0
    active_roots: list[str] | None = None  # if given, only these are searched
    kept: cache.Kept | None = None  # answers of models, kept between runs

    def __post_init__(self) -> None:
        self.store = store.Store(ship(self.spark), self.folder, KEYS)

    def _vector(self, text: str) -> list[float]:
        return self.embedder.embed([text[:1800]])[0]

    def _active(self, table: DataFrame, root: str | None = None) -> DataFrame:
        t = table if root is None else table.where(F.col("root_id") == root)
        return t if self.active_roots is None else t.where(F.col("root_id").isin(self.active_roots))

    # Indexing.
    def preview(self, root: str, recursive: bool = True, use_ignore_files: bool = True) -> DataFrame:
        """(action, reason_codes, files) of what indexing would do. Policies see paths relative to the root."""
        return self._plan(root, recursive, use_ignore_files).groupBy("action", "reason_codes").agg(F.count("*").alias("files"))

    def _plan(self, root: str, recursive: bool, use_ignore_files: bool, only: list[str] | None = None, max_files: int | None = None, max_dirs: int | None = None, max_seconds: float | None = None) -> DataFrame:
        """scan_plan() of root, or of the parts `only` of it, with the whole path in full."""
        base, top = len(root.rstrip("/")) + 1, root.rstrip("/")
        pruned = tuple(d.strip("/") for d in self.policy.excluded_directories if "/" not in d.strip("/"))
        found = [scan.listing(self.spark, p, recursive, pruned, max_seconds) for p in only or [root]]
        found = reduce(DataFrame.union, found)
        ignore = None
        if use_ignore_files:
            ignore = scan.ignore_files(root, found)
            # Of parts, the ignore files above them too.
            steps = {f"{top}/{'/'.join(rest[:k])}".rstrip("/") for p in only or [] for rest in [p.removeprefix(top).strip("/").split("/")] for k in range(len(rest))}
            if steps:
                above = scan.contents(self.spark.createDataFrame([(f"{f}/.gitignore",) for f in sorted(steps)], "path string")).where("content is not null")
                ignore = ignore.union(above.select(F.regexp_replace("path", "/[^/]*$", ""), F.decode("content", "UTF-8"))).distinct()
            below = F.expr(f"substring(folder, {base})")
            ignore = ignore.select(F.when(below == "", "/").otherwise(below).alias("folder"), "text")
        found = found.withColumn("full", F.col("path")).withColumn("path", F.expr(f"substring(full, {base})"))
        return scan.scan_plan(found, self.policy, ignore, max_files, max_dirs)

    def _points(self, texts: DataFrame, root: str) -> DataFrame:
        formatted = F.when(F.col("file_type") == "json", split_long_lines("text", ",{[")).when(F.col("file_type") == "html", split_long_lines("text", ">")).otherwise(F.col("text"))
        c = chunk.chunked(texts.withColumn("text", formatted), ["path", "file_type", "extension", "file_hash", "modified_time", "mtime_ns"], self.size, self.overlap, lines=True)
        c = extract.linked_chunks(cut(c), extract.code_entities(texts.where("file_type = 'python'")))
        links = ("imported_modules", "called_symbols", "parent_symbol", "symbol_type", "line_start", "line_end")
        p = c.select(*links, F.col("path").alias("path_key"), F.lit(root).alias("root_id"), "file_type", "extension", "file_hash", "modified_time", "mtime_ns", "chunk_id", "chunk_text", "start_char", "end_char")
        more = p.select("path_key", "chunk_id", "file_hash", "modified_time", "mtime_ns", chunk_id("path_key", "chunk_id").alias("point_id"))
        return extract.embedded(store.payload(p), self.embedder, "chunk_text", kept=self.kept).join(more, ["path_key", "chunk_id"])

    def _graph(self, texts: DataFrame, points: DataFrame, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(contributions, mentions, entity vectors) of files: of their code's structure, and of what a model names, if there is one."""
        code = extract.code_entities(texts).withColumn("root_id", F.lit(root))
        if self.extractor:
            own = points.select("root_id", F.col("path_key").alias("file_path"), "chunk_id", "chunk_text")
            entities, facts, _ = extract.extracted_files(own, self.extractor, code, self.summarizer, self.gleanings, self.kept)
        else:
            entities, facts = extract.merged(extract.code_names(code), "file_path"), extract.code_facts(code)
        mentions = cut(entities.drop("descriptions").withColumn("chunk_ids", F.col("chunk_ids").cast("array<int>")))
        facts = cut(facts)
        stubs = graph.stub_endpoints(mentions, facts).withColumn("description", F.lit(""))
        every = mentions.groupBy("root_id", "entity_id").agg(F.min(F.struct("name", "type", "description")).alias("e")).select("root_id", "entity_id", "e.*").unionByName(stubs)
        return graph.contributions(facts), mentions, extract.entity_vectors(every, self.embedder, self.kept).where("embedding is not null")

    def index(self, root: str, recursive: bool = True, force: bool = False, dry_run: bool = False, use_ignore_files: bool = True, only: str | list[str] | None = None, max_files: int | None = None, max_dirs: int | None = None, max_seconds: float | None = None) -> dict:
        """Indexes what is new or changed under root (everything, if forced), or in its parts `only`, folders or files; removes what is gone, which is
        known only of a whole and recursive scan that no bound has cut short; and marks the graph dirty.

        Files whose time, in nanoseconds, has not moved are not opened. Of the others those with the hash that they had are given their new time, and
        are neither cut nor embedded again.
        """
        plan = self._plan(root, recursive, use_ignore_files, [only] if isinstance(only, str) else only, max_files, max_dirs, max_seconds)
        listed = cut(plan.select(F.col("full").alias("path_key"), "size", "modified", F.col("mtime_ns").alias("mtime"), "action", "limit_hit"))
        complete = only is None and listed.where("limit_hit").isEmpty()
        disk = listed.where("action = 'index'").drop("action", "limit_hit")
        known = self.spark.createDataFrame([], "path_key string, mtime long, file_hash string")
        if self.store.has(POINTS):
            known = self.store.read(POINTS).where(F.col("root_id") == root).groupBy("path_key").agg(F.max("mtime_ns").alias("mtime"), F.max("file_hash").alias("file_hash"))
        moved = disk if force else disk.join(known.select("path_key", "mtime"), ["path_key", "mtime"], "left_anti")
        hashes = scan.hashed(moved.select(F.col("path_key").alias("path"))).withColumnRenamed("path", "path_key")
        changes = cut(sync.diff(disk.select("path_key", "mtime").join(hashes, "path_key", "left"), known, recursive, complete))
        counts = sync.sync_counts(changes).first().asDict()
        if dry_run or not force and not counts["new"] + counts["changed"] + counts["touched"] + counts["removed"]:
            return counts
        anew = changes.where("state <> 'removed'") if force else changes.where("state in ('new', 'changed')")
        gone = anew.select("path_key").union(changes.where("state = 'removed'").select("path_key")).distinct()
        touched = disk.select("path_key", F.col("mtime").alias("new_ns")).join(changes.where("state = 'touched'").select("path_key"), "path_key", "left_semi")
        opened = disk.join(anew.select("path_key"), "path_key", "left_semi")
        texts = cut(scan.texts(opened.select(F.col("path_key").alias("path"), "size", "modified", F.col("mtime").alias("mtime_ns"))))
        points = cut(self._points(texts, root))
        contribs, mentions, vectors = self._graph(texts, points, root)
        self._replace(gone, points, contribs, mentions, vectors, touched)
        return counts

    def _replace(self, gone: DataFrame, points: DataFrame | None = None, contribs: DataFrame | None = None, mentions: DataFrame | None = None, vectors: DataFrame | None = None, touched: DataFrame | None = None) -> None:
        """Publishes, in one commit that marks the graph dirty, the tables without the rows of the files gone (path_key) and with the new rows.

        Only buckets that hold those files, or edges and entities that they change, are written. Sums of edges, degrees and uses are moved by what
        the files took away and brought; vectors of entities that nothing uses any more go."""
        if not self.store.has(POINTS):
            self._publish(points, contribs, mentions, vectors)
            return
        gone = cut(gone)
        files = gone.withColumnRenamed("path_key", "file_path")
        was = {name: cut(self.store.rows_of(name, files)) for name in (CONTRIBS, MENTIONS)}
        none = {name: t.limit(0) for name, t in was.items()}
        new = {CONTRIBS: none[CONTRIBS] if contribs is None else cut(contribs), MENTIONS: none[MENTIONS] if mentions is None else mentions}
        out = {name: store.Revision(files, new[name].select(*was[name].columns)) for name in (CONTRIBS, MENTIONS)}
        empty = self.store.read(POINTS).limit(0)
        rows, left = (empty if points is None else points), gone
        if touched is not None:
            again = self.store.rows_of(POINTS, touched).join(touched, "path_key").withColumn("mtime_ns", F.col("new_ns"))
            again = again.withColumn("modified_time", iso_utc(F.expr("mtime_ns div 1000000000"))).drop("new_ns")
            rows, left = rows.unionByName(again), gone.union(touched.select("path_key"))
        out[POINTS] = store.Revision(left, rows.select(*empty.columns))
        edges = cut(graph.edge_changes(was[CONTRIBS], new[CONTRIBS]))
        old_edges = cut(self.store.rows_of(EDGES, edges))
        out[EDGES] = store.Revision(edges.select("edge_id"), graph.changed_edges(old_edges, edges).select(*old_edges.columns))
        by = cut(graph.degree_changes(old_edges, edges))
        out[DEGREES] = store.Revision(by.select("entity_id"), graph.changed_counts(self.store.rows_of(DEGREES, by), by))
        uses = cut(graph.use_changes((was[MENTIONS], was[CONTRIBS]), (new[MENTIONS], new[CONTRIBS])))
        after = cut(graph.changed_counts(self.store.rows_of(USES, uses), uses))
        out[USES] = store.Revision(uses.select("entity_id"), after)
        # A stored vector goes when nothing uses its entity, or when a new one comes for it.
        unused = uses.select("entity_id").join(after.select("entity_id"), "entity_id", "left_anti")
        fresh = self.store.read(VECTORS).limit(0) if vectors is None else cut(vectors)
        out[VECTORS] = store.Revision(unused.union(fresh.select("entity_id")), fresh.select(*self.store.read(VECTORS).columns))
        self.store.publish(dirty=True, **out)

    def _publish(self, points: DataFrame, contribs: DataFrame, mentions: DataFrame, vectors: DataFrame) -> None:
        """Publishes whole tables, and the sums that are made from them."""
        contribs, mentions = cut(contribs), cut(mentions)
        edges = cut(graph.edge_sums(contribs))
        none = (mentions.limit(0), contribs.limit(0))
        uses = cut(graph.use_changes(none, (mentions, contribs)))
        vectors = vectors.join(uses.select("root_id", "entity_id"), ["root_id", "entity_id"], "left_semi")
        by = graph.degree_changes(edges.limit(0), edges)
        self.store.publish(dirty=True, **{POINTS: points, CONTRIBS: contribs, MENTIONS: mentions, VECTORS: vectors, EDGES: edges, DEGREES: by, USES: uses})

    def index_file(self, root: str, path: str, force: bool = False) -> dict:
        return self.index(root, force=force, only=path)

    def touched_folders(self, root: str, folders: list[str]) -> dict:
        """Indexes what appeared or changed directly in folders, all at once, as a safety net for lost events; nothing is removed."""
        return self.index(root, recursive=False, only=sorted(set(folders)))

    def remove_document(self, path: str) -> int:
        """Takes out one file, in all tables; the number of its chunks."""
        n = self.store.read(POINTS).where(F.col("path_key") == path).count()
        if n:
            self._replace(self.spark.createDataFrame([(path,)], "path_key string"))
        return n

    def entities(self) -> DataFrame:
        m = self.store.read(MENTIONS)
        g = m.groupBy("root_id", "entity_id").agg(F.min(F.struct("name", "type")).alias("x"), F.max("description").alias("description"), F.array_sort(F.collect_set("file_path")).alias("file_paths"))
        return g.select("root_id", "entity_id", "x.name", "x.type", "description", "file_paths", F.lower("x.name").alias("name_lower"))

    def edges(self) -> DataFrame:
        return graph.edges(self.store.read(CONTRIBS))

    def status(self, root: str) -> dict:
        if not self.store.has(POINTS):
            return {"status": "not_found", "files": 0, "chunks": 0}
        r = self.store.read(POINTS).where(F.col("root_id") == root).agg(F.count_distinct("path_key").alias("files"), F.count("*").alias("chunks"), F.min("metadata_version").alias("v")).first()
        return {"status": "not_found" if not r.chunks else "legacy" if r.v < 3 else "indexed", "files": r.files, "chunks": r.chunks}

    # Search.
    def search(self, query: str, limit: int = 10, min_score: float = 0.35, query_entities: list[str] | None = None, root: str | None = None, **where) -> DataFrame:
        """(rank, path_key, score, snippet): filters first, then exact scores, reranking, and at most five chunks of a file."""
        p = search.where_metadata(self._active(self.store.read(POINTS), root), **where)
        s = search.reranked(search.scored(p, self._vector(query)), query_entities or [], self.alpha).where(F.col("score") >= min_score)
        files = search.grouped_by_file(s, limit)
        best = files.select("path_key", F.col("chunks")[0]["chunk_id"].alias("chunk_id"))
        return search.snippets(s.join(F.broadcast(best), ["path_key", "chunk_id"]))

    def search_entities(self, query: str, limit: int = 10, min_score: float = 0.35, root: str | None = None) -> DataFrame:
        """Entities by meaning, from their stored vectors, or by a part of their name where nothing comes near."""
        v = self._active(self.store.read(VECTORS), root)
        near = search.nearest(v, self._vector(query), limit, "entity_id", min_score=min_score).select("entity_id", "name", "type", "score")
        return near if not near.isEmpty() else search.entities_like(self._active(self.entities(), root), query, limit).select("entity_id", "name", "type", F.lit(0.0).alias("score"))

    def build_communities(self) -> bool:
        """Detects communities of the current graph, all levels, writes their reports, and publishes both if the graph has not moved on."""
        version = self.store.state().get("graph_version", 0)
        e, g = cut(self.entities()), cut(self.edges())
        c = cut(community.communities(community.detect(e.select("root_id", "entity_id"), graph.undirected(g).select("a", "b"))))
        members = c.select("root_id", "community_id", "level", F.explode("entity_ids").alias("entity_id"))
        top = c.where("level = 0")
        facts = graph.community_facts(e, g, members.where("level = 0").select("community_id", "entity_id"))
        r = community.reports(facts, self.reporter) if self.reporter else community.extractive_reports(facts).select("community_id", "title", "summary", "findings")
        r = r.join(top.select("community_id", "root_id"), "community_id")
        r = extract.embedded(r.withColumn("text", F.concat_ws("\n", "title", "summary", F.array_join("findings", "\n"))), self.embedder, "text", kept=self.kept)
        return self.store.commit_communities(uuid.uuid4().hex, version, communities=c, members=members, reports=r)

    def readiness(self) -> str:
        """not_indexed, rebuilding (no build, or one of an older graph) or ready."""
        if not self.store.has(POINTS):
            return "not_indexed"
        return "rebuilding" if not self.store.has("reports") or self.store.is_dirty() else "ready"

    def communities(self, limit: int = 50, root: str | None = None, level: int | None = None) -> tuple[dict, DataFrame | None]:
        """The state, and the first communities by level and id; none before a build."""
        if not self.store.has("communities"):
            return {"mode": self.readiness()}, None
        c = self._active(self.store.read("communities"), root)
        return {"mode": self.readiness()}, graph.listed(c if level is None else c.where(F.col("level") == level), limit)

    def report(self, community: str) -> tuple[dict, DataFrame | None]:
        """The state, found or not, and a community's report."""
        if not self.store.has("reports"):
            return {"mode": self.readiness(), "found": False}, None
        r = self.store.read("reports").where(F.col("community_id") == community).drop("embedding", "text")
        return {"mode": self.readiness(), "found": not r.isEmpty()}, r

    def search_global(self, query: str, limit: int = 10, root: str | None = None) -> tuple[dict, DataFrame]:
        """(state, results): reports of the communities of the nearest entities if those are few, else of all; chunks before any build or
        where there is no report. state: mode, incomplete, coverage, confidence, and synthesis, an answer from the best reports if there is a model."""
        mode = self.readiness()
        chunks = lambda: self.search(query, limit, 0.0, root=root).select(F.col("path_key").alias("key"), "score")
        if mode == "not_indexed" or not self.store.has("reports"):
            return {"mode": mode, "incomplete": False, "coverage": "rebuilding", "synthesis": ""}, chunks()
        r, members = self._active(self.store.read("reports"), root), self._active(self.store.read("members"), root).where("level = 0")
        chosen = search.targets(self.search_entities(query, TARGET_ENTITIES, root=root), members, r, TARGET_SHARE)
        near = search.nearest(r.join(chosen, "community_id", "left_semi"), self._vector(query), limit, "community_id")
        if not near.isEmpty():
            return {"mode": mode, "incomplete": True, "coverage": "targeted"} | self._said(query, near), near.select(F.col("community_id").alias("key"), "score")
        counts = members.select("community_id").distinct().join(r.select("community_id", F.lit(1).alias("r")), "community_id", "left").agg(search.coverage(F.count("*"), F.count("r"), F.lit(mode == "rebuilding")).alias("c")).first()
        near = search.nearest(r, self._vector(query), limit, "community_id")
        if counts.c == "failed" or near.isEmpty():
            return {"mode": mode, "incomplete": True, "coverage": counts.c, "synthesis": ""}, chunks()
        return {"mode": mode, "incomplete": counts.c != "complete" or mode == "rebuilding", "coverage": counts.c} | self._said(query, near), near.select(F.col("community_id").alias("key"), "score")

    def _said(self, query: str, near: DataFrame) -> dict:
        """How sure the best of some reports is, and what a model says from the first of them."""
        best = near.orderBy(F.desc("score"), "community_id").limit(TOP_REPORTS).select("title", "summary", "score").collect()
        text = "\n\n".join(f"{b.title}\n{b.summary}" for b in best)
        sure = "none" if not best else "high" if best[0].score >= 0.7 else "medium" if best[0].score >= 0.5 else "low"
        return {"confidence": sure, "synthesis": self.answerer.answer(query, text) if self.answerer and best else ""}

    def answer(self, query: str, limit: int = 5, root: str | None = None, per_file: int = 2) -> tuple[str, str]:
        """(answer, context) from the best chunks of the best files; the answer is empty without a model."""
        s = search.scored(self._active(self.store.read(POINTS), root), self._vector(query))
        text = search.answer_context(search.grouped_by_file(s, limit).select("path_key"), s, per_file).first().context or ""
        return self.answerer.answer(query, text) if self.answerer else "", text

    def file_summary(self, path: str) -> tuple[str, str]:
        """(summary, context) of one file; the summary is empty without a model."""
        text = search.summary_context(self.store.read(POINTS), path).first().context or ""
        return self.answerer.answer(f"Summarize {path}", text) if self.answerer and text else "", text

    def search_root(self, root: str, query: str, limit: int = 10, min_score: float = 0.35) -> DataFrame:
        """(channel, key, score, rank) of chunks, entities and communities of one root."""
        chunks = self.search(query, limit, min_score, root=root).select(F.col("path_key").alias("key"), "score")
        entities = self.search_entities(query, limit, min_score, root).select(F.col("entity_id").alias("key"), "score")
        return search.envelope(chunks=chunks, entities=entities, communities=self.search_global(query, limit, root)[1])

    # Upkeep.
    def clear(self, path: str, confirm: bool = False, expected_files: int | None = None, expected_chunks: int | None = None) -> dict:
        """What lies under path, and, if confirmed with the counts that a preview gave, its removal."""
        p = self.store.read(POINTS)
        seen = sync.clear_preview(p, path).first().asDict()
        if not confirm:
            return seen | {"cleared": False}
        if (expected_files, expected_chunks) != (seen["files"], seen["chunks"]):
            raise ValueError(f"the counts have changed: {seen}")
        own = p.select("path_key").union(self.store.read(MENTIONS).select("file_path")).union(self.store.read(CONTRIBS).select("file_path"))
        self._replace(own.where(within("path_key", F.lit(path))).distinct())
        return seen | {"cleared": True}

    def audit(self) -> DataFrame:
        return sync.secret_audit(self.store.read(POINTS), self.policy)

    def purge(self, path: str, confirm: bool = False) -> None:
        """Takes out a file that the audit reports, from all tables."""
        sync.purged(self.store.read(POINTS), path, confirm, self.policy)
        self._replace(self.spark.createDataFrame([(path,)], "path_key string"))

    def reconcile(self, registry: DataFrame, decisions: DataFrame) -> tuple[DataFrame, dict]:
        """(the registry after decisions, counts by state), and the stored tables after them: remapped roots at their destinations, purged ones gone."""
        left, points, contribs, counts = sync.reconcile(registry, decisions, self.store.read(POINTS), self.store.read(CONTRIBS))
        _, mentions, vectors, _ = sync.reconcile(registry, decisions, self.store.read(MENTIONS), self.store.read(VECTORS))
        self._publish(points, contribs, mentions, vectors)
        return left, counts.first().asDict()

    def stats(self) -> dict:
        return {name: self.store.read(name).count() for name in self.store.state()["tables"]}
