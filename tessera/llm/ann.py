"""Operator 3: approximate nearest neighbours by an inverted file with product-quantised residuals.

Vectors are scaled to length one. Coarse centroids and, for the residuals, a codebook for each part of the vector are
fitted by k-means on at most SAMPLE rows (those with the smallest hashes of their ids). Every row is indexed: its cell
and a byte for each part. A query probes its nearest cells, so many as hold TARGET of the neighbours that brute force finds among all
rows for at most TRIALS of the queries. Asymmetric distance tables (its products with all codewords) rank the rows of a cell, and
the best RERANK of a block are ranked again by the exact cosine of the original vectors. So are all others of which the table's
value, with the length of what their code leaves out added, could still come among the k best: a block loses no neighbour to
codes that are too coarse for it.

Cells are dealt in blocks of at most BLOCK rows and their queries in blocks of about QUERY_BLOCK, each pair of blocks a
group of its own, so a cell or a vector with a third of all rows spreads over many tasks.

Vectors that are null, zero, or with null or non-finite components take no part, and rows with a null id neither. Every
other vector does: it is scaled by a power of two first, which changes no cosine, so that neither its square nor that of
its parts overflows. Vectors of another length have an index of their own, and a query is compared with those of its
length. Rows that repeat an id count once (the largest vector, compared as an array). A query's own id is never its
neighbour. Ties go to the smaller id. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize, mix

SAMPLE = 20_000
ROWS_PER_CELL, MIN_CELLS, MAX_CELLS = 400, 8, 4096
#: So many cells are probed as hold TARGET of the true neighbours of TRIALS queries (those with the smallest hashes), MIN_PROBES at least.
TARGET, TRIALS, MIN_PROBES = 0.98, 300, 4
PART_DIMS, CODEWORDS = 4, 256
RERANK = 96
BLOCK, QUERY_BLOCK = 4096, 1024


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), len(c))])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Coarse centroids and codebooks, and how many rows each cell holds."""

    def __init__(self, sample: np.ndarray, n_rows: int):
        cells = int(min(MAX_CELLS, max(MIN_CELLS, n_rows // ROWS_PER_CELL), len(sample)))
        self.centroids = kmeans(sample, cells, 12, 1)
        rest = sample - self.centroids[nearest(sample, self.centroids)]
        self.parts = np.array_split(np.arange(sample.shape[1]), max(1, sample.shape[1] // PART_DIMS))
        self.books = [kmeans(rest[:, p], CODEWORDS, 8, 2 + i) for i, p in enumerate(self.parts)]
        self.n_probes = MIN_PROBES
        self.rows = np.zeros(len(self.centroids), np.int64)
        self.queries = np.zeros(len(self.centroids), np.int64)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.centroids)
        rest = x - self.centroids[cell]
        return cell, np.stack([nearest(rest[:, p], b) for p, b in zip(self.parts, self.books)], 1).astype(np.uint8)

    def calibrate(self, q: np.ndarray, cells: np.ndarray) -> None:
        """Sets n_probes from queries and the cell of a neighbour of each; a query with several neighbours comes several times."""
        place = np.argsort(np.argsort(-(q @ self.centroids.T), axis=1, kind="stable"), axis=1)
        needed = np.sort(place[np.arange(len(q)), cells])
        if len(needed):
            self.n_probes = max(MIN_PROBES, int(needed[int(np.ceil(TARGET * len(needed))) - 1]) + 1)

    def rebuilt(self, cell: int, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        out = np.repeat(self.centroids[cell][None, :], len(codes), 0)
        for m, (p, book) in enumerate(zip(self.parts, self.books)):
            out[:, p] += book[codes[:, m]]
        return out

    def probes(self, q: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query its nearest cells; more of them where those hold fewer than k rows besides the query."""
        near = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")
        held = np.cumsum(self.rows[near], axis=1)
        return [c[: max(self.n_probes, int(np.searchsorted(h, k + 1)) + 1)] for c, h in zip(near, held)]

    def blocks(self, cell: np.ndarray) -> np.ndarray:
        return -(-self.rows[cell] // BLOCK)

    def query_blocks(self, cell: np.ndarray) -> np.ndarray:
        return np.maximum(1, -(-self.queries[cell] // QUERY_BLOCK))


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, d, v): ids, and vectors scaled and packed as d 64-bit floats, of the rows that take part."""
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("a")).where("vec_id is not null and a is not null")
    one = x.groupBy("vec_id").agg(F.max("a").alias("a"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, d, v = [], [], []
            for i, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if a and None not in a:
                    y = np.array(a, np.float64)
                    most = np.abs(y).max()
                    if np.isfinite(most) and most > 0:
                        ids.append(i)
                        d.append(len(y))
                        v.append(np.ldexp(y, -int(np.frexp(most)[1])).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(d, pa.int32()), pa.array(v, pa.binary())], ["vec_id", "d", "v"])

    return arrow_map(one, pack, "vec_id long, d int, v binary")


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row for which is_query (a Column over vec_id) holds."""
    own = materialize(usable(vectors, id_col, vector_col), "vectors")
    sizes = {r["d"]: r["n"] for r in own.groupBy("d").agg(F.count("*").alias("n")).collect()}
    found = [_search(own.where(F.col("d") == d).select("vec_id", "v"), n, is_query, k) for d, n in sorted(sizes.items())]
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, found) if found else empty


def _search(own: DataFrame, n_rows: int, is_query, k: int) -> DataFrame:
    """search() among n_rows vectors (vec_id, v) of one length."""
    spark = own.sparkSession
    # A share that surely holds the sample is cut off before it is sorted, so tasks send about SAMPLE rows in all.
    share = (SAMPLE + 6 * SAMPLE**0.5) / n_rows
    likely = own.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < int(share * (1 << 40))) if share < 1 else own
    sample = likely.orderBy(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)), "vec_id").limit(SAMPLE).toArrow()
    index = Index(unit(sample.column("v").to_pylist()), n_rows)
    first = spark.sparkContext.broadcast(index)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, code = first.value.encode(unit(b.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column(0), pa.array([c.tobytes() for c in code], pa.binary()), b.column(1)], ["cell", "vec_id", "code", "v"])

    indexed = materialize(arrow_map(own, encode, "cell int, vec_id long, code binary, v binary"), "index")
    # A row for each cell, so at most MAX_CELLS.
    for r in indexed.groupBy("cell").count().collect():
        index.rows[r["cell"]] = r["count"]
    _calibrate(index, own.where(is_query), indexed, k)
    second = spark.sparkContext.broadcast(index)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells = second.value.probes(unit(b.column(1).to_pylist()), k)
                at = np.repeat(np.arange(b.num_rows), [len(c) for c in cells])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells), pa.int32()), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], ["cell", "query_id", "q"])

    probes = materialize(arrow_map(own.where(is_query), probe, "cell int, query_id long, q binary"), "probes")
    for r in probes.groupBy("cell").count().collect():
        index.queries[r["cell"]] = r["count"]
    third = spark.sparkContext.broadcast(index)

    def dealt(ids: str, by_rows: bool):
        """Each row goes to its own block of its kind, once for each block of the other kind."""

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                cell = b.column("cell").to_numpy()
                key = mix(b.column(ids).to_numpy().astype(np.uint64))
                n_rows_, n_queries = third.value.blocks(cell), third.value.query_blocks(cell)
                mine, other = (n_rows_, n_queries) if by_rows else (n_queries, n_rows_)
                own = (key % np.maximum(mine, 1).astype(np.uint64)).astype(np.int32)
                at = np.repeat(np.arange(b.num_rows), other)
                turn = (np.arange(len(at)) - np.repeat(np.cumsum(other) - other, other)).astype(np.int32)
                out = b.take(pa.array(at))
                rb, qb = (own[at], turn) if by_rows else (turn, own[at])
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(rb, pa.int32()), pa.array(qb, pa.int32())], [*out.schema.names, "rb", "qb"])

        return deal

    blocks = arrow_map(indexed, dealt("vec_id", True), "cell int, vec_id long, code binary, v binary, rb int, qb int").groupBy("cell", "rb", "qb")
    asked = arrow_map(probes, dealt("query_id", False), "cell int, query_id long, q binary, rb int, qb int").groupBy("cell", "rb", "qb")

    def rank(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(xs):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        ix = third.value
        xs = xs.sort_values("vec_id")
        ids, codes = xs.vec_id.to_numpy(), np.frombuffer(b"".join(xs.code), np.uint8).reshape(len(xs), -1)
        x = np.frombuffer(b"".join(xs.v), np.float64).reshape(len(xs), -1)
        length = np.linalg.norm(x, axis=1)
        one = x / length[:, None]
        missed = np.linalg.norm(one - ix.rebuilt(int(xs.cell.iloc[0]), codes), axis=1) + 1e-9
        q = np.frombuffer(b"".join(qs.q), np.float64).reshape(len(qs), -1)
        centroid = ix.centroids[int(xs.cell.iloc[0])]
        out = []
        for at in range(0, len(qs), 128):
            qq = q[at : at + 128]
            u = qq / np.linalg.norm(qq, axis=1, keepdims=True)
            near = np.repeat((u @ centroid)[:, None], len(xs), 1)
            for m, (p, book) in enumerate(zip(ix.parts, ix.books)):
                near += (u[:, p] @ book.T)[:, codes[:, m]]
            own = qs.query_id.to_numpy()[at : at + 128]
            near[own[:, None] == ids[None, :]] = -np.inf
            keep = min(max(RERANK, 2 * k), len(xs))
            if keep < len(xs):
                # Rows are in order of their ids and the sort is stable: ties go to smaller ids.
                bar = -np.partition(-near, keep - 1, axis=1)[:, keep - 1]
            alike = None
            for i, row in enumerate(near):
                if keep < len(xs):
                    over = np.flatnonzero(row > bar[i])
                    best = np.concatenate([over, np.flatnonzero(row == bar[i])[: keep - len(over)]])
                else:
                    best = np.arange(len(xs))
                best = best[row[best] > -np.inf]
                score = lambda at: (x[at] * qq[i]).sum(1) / (length[at] * np.linalg.norm(qq[i]))  # noqa: E731, B023
                exact = score(best)
                if keep < len(xs) and len(best):
                    last = np.sort(exact)[-min(k, len(best))]
                    may = row + missed >= last
                    may[best] = False
                    if may.any():
                        # A product for all of the block's queries, off by no more than rounding, leaves few rows to the exact measure.
                        alike = u @ one.T if alike is None else alike
                        more = np.flatnonzero(may & (alike[i] >= last - 1e-9))
                        best, exact = np.concatenate([best, more]), np.concatenate([exact, score(more)])
                top = np.lexsort((ids[best], -exact))[:k]
                out.append((np.full(len(top), own[i]), ids[best[top]], exact[top]))
        return pd.DataFrame({n: np.concatenate([o[j] for o in out]) for j, n in enumerate(("query_id", "vec_id", "score"))})

    found = asked.cogroup(blocks).applyInPandas(rank, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrate(index: Index, asked: DataFrame, indexed: DataFrame, k: int) -> None:
    """Finds the k nearest of at most TRIALS queries among all rows, by one pass in which each task keeps k rows for each, and has index probe as many cells as those need."""
    spark = indexed.sparkSession
    trials = asked.orderBy(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 40)), "vec_id").limit(TRIALS).toArrow()
    if not trials.num_rows:
        return
    ids, q = trials.column("vec_id").to_numpy(), unit(trials.column("v").to_pylist())
    given = spark.sparkContext.broadcast((ids, q))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own = given.value
        # Scores, ids and cells of the best so far.
        kept = [np.zeros((len(own), 0)), np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0), np.int32)]
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                other = part.column("vec_id").to_numpy()
                score = own @ unit(part.column("v").to_pylist()).T
                score[own_ids[:, None] == other[None, :]] = -np.inf
                new = (score, np.broadcast_to(other, score.shape), np.broadcast_to(part.column("cell").to_numpy(), score.shape))
                every = [np.concatenate(x, 1) for x in zip(kept, new)]
                top = np.argpartition(-every[0], k - 1, axis=1)[:, :k] if every[0].shape[1] > k else np.arange(every[0].shape[1])[None, :].repeat(len(own), 0)
                kept = [np.take_along_axis(x, top, 1) for x in every]
        n = kept[0].shape[1]
        real = kept[0].ravel() > -np.inf
        cols = [np.repeat(np.arange(len(own), dtype=np.int32), n), kept[1].ravel(), kept[0].ravel(), kept[2].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c[real]) for c in cols], ["trial", "vec_id", "score", "cell"])

    found = arrow_map(indexed, best, "trial int, vec_id long, score double, cell int")
    w = Window.partitionBy("trial").orderBy(F.desc("score"), "vec_id")
    near = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("trial", "cell").toArrow()
    index.calibrate(q[near.column("trial").to_numpy()], near.column("cell").to_numpy())


def brute_force(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> pd.DataFrame:
    """What search() approximates, in one process: for tests and for measuring recall on small tables."""
    every = usable(vectors, id_col, vector_col).toArrow().to_pandas().sort_values("vec_id")
    asked = set(usable(vectors, id_col, vector_col).where(is_query).select("vec_id").toPandas().vec_id)
    out = []
    for _, own in every.groupby("d"):
        ids = own.vec_id.to_numpy()
        x = np.frombuffer(b"".join(own.v), np.float64).reshape(len(own), -1)
        n = np.linalg.norm(x, axis=1)
        for i in np.flatnonzero(np.isin(ids, list(asked))):
            s = (x * x[i]).sum(1) / (n * n[i])
            s[i] = -np.inf
            top = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
            out += [(ids[i], r + 1, ids[j], s[j]) for r, j in enumerate(top)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
