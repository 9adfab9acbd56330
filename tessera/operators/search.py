"""Vector search over chunks, entities and reports: exact nearest neighbours, filters, grouping, reranking, envelopes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import blended, collapsed, cosine, dotted, within
from tessera.session import ship

#: Queries whose vectors fit this many bytes are broadcast; larger sets go in blocks.
MAX_QUERY_BYTES = 64 << 20
#: Scores that a task holds at once, queries by points.
BLOCK_CELLS = 1 << 20


def where_metadata(points: DataFrame, file_path: str | None = None, root_id: str | None = None, extensions: list[str] | None = None, file_types: list[str] | None = None, exclude: str | None = None, base_dirs: list[str] | None = None, min_score: float | None = None) -> DataFrame:
    """The conjunction of what is given; all of it is decided before any limit."""
    tests: list[Column] = []
    if file_path is not None:
        tests.append(F.col("file_path") == file_path)
    if root_id is not None:
        tests.append(F.col("root_id") == root_id)
    if extensions:
        tests.append(F.col("extension").isin([dotted(e) for e in extensions]))
    if file_types:
        tests.append(F.col("file_type").isin(file_types))
    if exclude is not None:
        tests += [F.col("file_path") != exclude, F.col("path_key") != exclude]
    if base_dirs:
        tests.append(reduce(lambda a, b: a | b, (within("path_key", F.lit(d)) for d in base_dirs)))
    if min_score is not None:
        tests.append(F.col("score") >= min_score)
    return reduce(DataFrame.where, tests, points)


def scored(points: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    return points.withColumn("score", cosine(vector, F.array(*(F.lit(float(x)) for x in query))))


def nearest(points: DataFrame, query: list[float], k: int, ties: str, vector: str = "embedding", min_score: float | None = None) -> DataFrame:
    """Exact top k by cosine, ties to the smaller `ties` column: one pass with a heap of k in each task."""
    s = scored(points.where(F.col(vector).isNotNull()), query, vector)
    if min_score is not None:
        s = s.where(F.col("score") >= min_score)
    return s.orderBy(F.desc("score"), ties).limit(k)


def nearest_batch(points: DataFrame, queries: DataFrame, k: int, id_col: str, query_id: str, vector: str = "embedding") -> DataFrame:
    """Exact top k for each query (query_id, q): (query_id, rank, id, score); 0 where either vector has no length.

    Queries go to all points in blocks of a checked size, as one matrix; each task keeps the k best of its points for each query, and
    those are ranked. Vectors of another length than the query's, or with null components, take no part.
    """
    size = queries.agg(F.coalesce(F.sum(F.size("q") * 8 + 16), F.lit(0)).alias("b")).first()["b"]
    n = max(1, -(-size // MAX_QUERY_BYTES))
    own = points.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    spark = ship(points.sparkSession)

    def block(b: int) -> DataFrame:
        asked = queries if n == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(n)) == b)
        rows = asked.select(F.col(query_id).cast("long").alias("i"), F.col("q").cast("array<double>").alias("q")).where("q is not null").collect()
        given = spark.sparkContext.broadcast(unit_blocks([(r.i, r.q) for r in rows]))
        return own.mapInArrow(lambda batches: best_of(batches, given.value, k), "query_id long, id long, score double")

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = reduce(DataFrame.union, (block(b) for b in range(n))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias(query_id), "rank", F.col("id").alias(id_col), "score")


def unit_blocks(vectors: list[tuple[int, list[float | None]]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix of vectors of length one) by their number of components."""
    by: dict[int, list] = {}
    for i, v in vectors:
        if None not in v:
            by.setdefault(len(v), []).append((i, v))
    out = {}
    for d, rows in by.items():
        x = np.array([v for _, v in rows], np.float64).reshape(len(rows), d)
        length = np.linalg.norm(x, axis=1, keepdims=True)
        out[d] = np.array([i for i, _ in rows], np.int64), x / np.where(length == 0, 1, length)
    return out


def _better(best: tuple[np.ndarray, np.ndarray], queries: np.ndarray, ids: np.ndarray, unit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """best (ids, scores) of each query with points taken in, by blocks of at most BLOCK_CELLS scores."""
    points = min(1024, BLOCK_CELLS)
    step = max(1, BLOCK_CELLS // points)
    out = []
    for a in range(0, len(queries), step):
        own, score = best[0][a : a + step], best[1][a : a + step]
        for b in range(0, len(ids), points):
            # Products of single rows, summed alike whatever else is in the block, so equal vectors tie.
            new = np.einsum("qd,pd->qp", queries[a : a + step], unit[b : b + points])
            own, score = np.concatenate([own, np.broadcast_to(ids[b : b + points], new.shape)], 1), np.concatenate([score, new], 1)
            turn = np.lexsort((own, -score), axis=1)[:, :k]
            own, score = np.take_along_axis(own, turn, 1), np.take_along_axis(score, turn, 1)
        out.append((own, score))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else best


def best_of(batches: Iterator[pa.RecordBatch], queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of a task's points (id, v) for each query: matrix products of blocks, beside the best so far."""
    best = {d: (np.zeros((len(q[0]), 0), np.int64), np.zeros((len(q[0]), 0))) for d, q in queries.items()}
    for x in batches:
        for d, (ids, unit) in unit_blocks(list(zip(x.column(0).to_pylist(), x.column(1).to_pylist()))).items():
            if d in queries:
                best[d] = _better(best[d], queries[d][1], ids, unit, k)
    for d, (ids, score) in best.items():
        if ids.size:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries[d][0], ids.shape[1])), pa.array(ids.ravel()), pa.array(score.ravel())], ["query_id", "id", "score"])


def entities_like(entities: DataFrame, text: str, limit: int) -> DataFrame:
    """Entities whose name holds the text, in small letters; by name, then id."""
    return entities.where(F.contains(F.col("name_lower"), F.lit(text.lower()))).orderBy("name_lower", "entity_id").limit(limit)


# An index of names by trigrams.
def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text in small letters; none of a shorter one."""
    t = F.lower(text)
    return F.when(F.length(t) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda k: F.substr(t, k, F.lit(3))))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class NameIndex:
    """Postings (hash, entity_id) of names' trigrams, stored in folders by hash, so that a search reads only those of its own trigrams.

    The names themselves lie beside them, in folders by a hash of the id, and are read only where candidates are."""

    spark: SparkSession
    path: str
    folders: int = 64

    def _folder(self, c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.folders)).cast("int")

    def build(self, entities: DataFrame) -> NameIndex:
        """entities: (entity_id, name_lower, ...)."""
        post = entities.select("entity_id", F.explode(trigrams(F.col("name_lower"))).alias("gram")).withColumn("folder", self._folder(F.col("gram")))
        post.repartition("folder").sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(f"{self.path}/postings")
        own = entities.withColumn("folder", self._folder(F.col("entity_id")))
        own.repartition("folder").write.partitionBy("folder").parquet(f"{self.path}/names")
        return self

    def like(self, text: str, limit: int) -> DataFrame:
        """entities_like() by the index: trigrams that all of the text's are found in are candidates, whose names are then compared. A text of fewer than three
        characters is looked for in all names."""
        small = text.lower()
        grams = sorted({small[k : k + 3] for k in range(len(small) - 2)})
        names = self.spark.read.parquet(f"{self.path}/names")
        if not grams:
            return entities_like(names.drop("folder"), text, limit)
        # The folders are asked of Spark's own hash; their numbers prune the read.
        at = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(self._folder(F.col("gram")).alias("f")).distinct().collect()
        post = self.spark.read.parquet(f"{self.path}/postings").where(F.col("folder").isin([r.f for r in at]) & F.col("gram").isin(grams))
        whole = post.groupBy("entity_id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("entity_id")
        return entities_like(names.join(whole, "entity_id", "left_semi").drop("folder"), text, limit)


def reranked(hits: DataFrame, query_entities: list[str], alpha: float) -> DataFrame:
    """Scores blended with the share of the query's entities that a hit names. Without alpha or entities nothing is joined or changed."""
    if alpha <= 0 or not query_entities:
        return hits
    names = F.array(*(F.lit(n) for n in sorted(set(query_entities))))
    overlap = F.size(F.array_intersect(F.coalesce("entity_names", F.array().cast("array<string>")), names))
    return hits.withColumn("score", blended("score", overlap, len(set(query_entities)), alpha))


def grouped_by_file(hits: DataFrame, limit: int, per_file: int = 5, file: str = "path_key", order: str = "chunk_id") -> DataFrame:
    """(file, score, chunks): a file's score is its best hit's; at most per_file chunks each; the best files."""
    w = Window.partitionBy(file).orderBy(F.desc("score"), order)
    kept = hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_file)
    chunk = F.struct("place", F.col(order), F.col("score"))
    return kept.groupBy(file).agg(F.max("score").alias("score"), F.sort_array(F.collect_list(chunk)).alias("chunks")).orderBy(F.desc("score"), file).limit(limit)


def snippets(hits: DataFrame, text: str = "chunk_text", file: str = "path_key", width: int = 500) -> DataFrame:
    """Ranks from 1, rounded scores and shortened texts. hits must be bounded: ranks are over all of them."""
    t = collapsed(text)
    short = F.when(F.length(t) > width, F.concat(F.substring(t, 1, width), F.lit("…"))).otherwise(t)
    return hits.select(F.row_number().over(Window.orderBy(F.desc("score"), file)).alias("rank"), file, F.round("score", 4).alias("score"), short.alias("snippet"))


def confidence(best: Column, n: Column, high: float = 0.7, low: float = 0.5) -> Column:
    """high, medium, low, or none without hits."""
    return F.when(n == 0, "none").when(best >= high, "high").when(best >= low, "medium").otherwise("low")


def coverage(expected: Column, covered: Column, dirty: Column) -> Column:
    """complete, partial, failed or rebuilding, from the counts of a build's reports."""
    return F.when(expected == 0, F.when(dirty, "rebuilding").otherwise("failed")).when(covered == 0, "failed").when(covered < expected, "partial").otherwise("complete")


def targets(entity_hits: DataFrame, membership: DataFrame, committed: DataFrame, ratio: float = 0.3, rounding: str = "floor") -> DataFrame:
    """Communities of the hit entities among the committed ones; none at all if they are more than a share of those."""
    found = membership.join(entity_hits.select("entity_id"), "entity_id", "left_semi").select("community_id").distinct().join(committed.select("community_id").distinct(), "community_id", "left_semi")
    cap = committed.select("community_id").distinct().agg((F.floor if rounding == "floor" else F.ceil)(F.count("*") * F.lit(ratio)).alias("cap"))
    n = found.agg(F.count("*").alias("n"))
    return found.join(F.broadcast(n.join(F.broadcast(cap), F.lit(True))), F.lit(True)).where(F.col("n") <= F.col("cap")).select("community_id")


def envelope(**channels: DataFrame) -> DataFrame:
    """Channels (key, score) as one table with the channel's name and ranks within it. Channels are bounded result lists."""
    w = Window.partitionBy("channel").orderBy(F.desc("score"), "key")
    each = [d.select(F.lit(name).alias("channel"), F.col("key").cast("string").alias("key"), "score") for name, d in channels.items()]
    return reduce(DataFrame.unionByName, each).withColumn("rank", F.row_number().over(w))


def summary_context(points: DataFrame, path: str, chunks: int = 3, chars: int = 4000) -> DataFrame:
    """(context): what a file is summarised from: its first chunks, cut to so many characters."""
    own = points.where(F.col("path_key") == path).orderBy("chunk_id").limit(chunks)
    return own.agg(F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "chunk_text"))), lambda c: c["chunk_text"]), "\n\n"), 1, chars).alias("context"))


def answer_context(files: DataFrame, chunks: DataFrame, per_file: int = 2, file: str = "path_key") -> DataFrame:
    """The context string for a language model: the best chunks of the files, in order of score."""
    w = Window.partitionBy(file).orderBy(F.desc("score"), "chunk_id")
    top = chunks.join(files.select(file), file, "left_semi").withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_file)
    part = F.struct((-F.col("score")).alias("o"), F.col(file), F.col("chunk_id"), F.concat(F.lit("File: "), F.col(file), F.lit("\n"), F.col("chunk_text")).alias("t"))
    return top.agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("context"))


def existence(table: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """(any_there, all_there) of the distinct ids asked for; nothing asked for is all there."""
    ids = asked.select(key).distinct()
    there = table.select(key).distinct().withColumn("there", F.lit(1))
    return ids.join(there, key, "left").agg((F.count("there") > 0).alias("any_there"), (F.count("there") == F.count("*")).alias("all_there"))
