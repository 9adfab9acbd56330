"""Operator 12: hard negatives by one-dimensional distance keys.

Scores are inner products of integers, so vectors are augmented: with M the largest length, a row x becomes (x, sqrt(M^2 - |x|^2))
and an anchor q becomes (q, 0); then |q' - x'|^2 = |q|^2 + M^2 - 2 qx, and the highest scores are the smallest distances.

1. Pivots are fitted by k-means on at most SAMPLE rows. Each row has a key, (nearest pivot, distance from it); rows are stored
   sorted by it, cut into RINGS rings for each pivot, of which the exact bounds and counts are kept.
2. By the triangle inequality a ring's bounds limit the distance between an anchor and its rows, from below and above. An
   anchor's search visits rings by growing distance: first as many as hold FIRST rows, then more by GROWTH, and once it has as
   many rows as it wants, all rings that the last of these leaves possible. What it has then is certified: no unseen row can
   come before it. Positives are searched first, among rows of the anchor's label; each sets a range of scores, in
   which the negatives are searched among rows of other labels.
3. A round joins anchors and rings in blocks of at most BLOCK rows and about QUERY_BLOCK anchors, and scores are exact.

Rows with a null id, label or vector, or with a null or non-finite component (also after scaling) take no part. Rows that repeat
an id count once: the largest by the bytes of its vector, then by label. Vectors are compared with those of their length; a length with
few rows has no pivots: its anchors meet all of its rows in blocks. Scores beyond 64 bits count as the largest or smallest long.
Ties go to the smaller id. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ann import kmeans, nearest
from .common import arrow_map, forget, materialize, tuned
from .scans import lookup

SAMPLE = 20_000
ROWS_PER_PIVOT, MIN_PIVOTS, MAX_PIVOTS, RINGS = 1500, 4, 256, 8
#: A length with so many rows, and one in MOST_LENGTHS of all rows, has pivots; so at most MOST_LENGTHS have.
LEAST_INDEXED, MOST_LENGTHS = 256, 16
FIRST, GROWTH = 1024, 8
BLOCK, QUERY_BLOCK = 4096, 512
SLACK = 1e-9
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, d, sq, v): v packs floor(scale * x) as 64-bit floats, which hold these integers exactly; sq is its square."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("a"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, d, sq, v = [], [], [], []
            for i, a in enumerate(b.column(2).to_pylist()):
                if None not in a:
                    with np.errstate(over="ignore"):
                        y = np.floor(np.array(a, np.float64) * scale)
                    if np.isfinite(y).all():
                        keep.append(i)
                        d.append(len(y))
                        with np.errstate(over="ignore"):
                            sq.append(float(y @ y))
                        v.append((y + 0.0).tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(d, pa.int32()), pa.array(sq, pa.float64()), pa.array(v, pa.binary())], ["vec_id", "label", "d", "sq", "v"])

    packed = arrow_map(x.where("vec_id is not null and label is not null and a is not null"), pack, "vec_id long, label long, d int, sq double, v binary")
    one = packed.groupBy("vec_id").agg(F.max(F.struct("v", "label", "d", "sq")).alias("r"))
    return one.select("vec_id", "r.label", "r.d", "r.sq", "r.v")


def unpacked(raw: list[bytes], d: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), d)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The integer inner products of all rows of q and x, held within 64 bits."""
    if q.shape[1] * np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) < 2.0**53:
        return (q @ x.T).astype(np.int64)
    a, b = (np.array([[int(y) for y in row] for row in m], object).reshape(m.shape) for m in (q, x))
    return np.clip(a @ b.T, LOWEST, HIGHEST).astype(np.int64)


class Index:
    """Pivots in the augmented space, the rings of each by distance, and the exact bounds and counts of these."""

    def __init__(self, sample: np.ndarray, n_rows: int, most: float):
        self.most = most  # M squared
        x = self.augmented(sample)
        self.pivots = kmeans(x, int(min(MAX_PIVOTS, max(MIN_PIVOTS, n_rows // ROWS_PER_PIVOT), len(x))), 8, 12)
        own = nearest(x, self.pivots)
        far = np.linalg.norm(x - self.pivots[own], axis=1)
        share = np.arange(1, RINGS) / RINGS
        self.edges = [np.quantile(far[own == p], share) if (own == p).any() else np.zeros(RINGS - 1) for p in range(len(self.pivots))]
        size = len(self.pivots) * RINGS
        self.low, self.high, self.count = np.zeros(size), np.zeros(size), np.zeros(size, np.int64)

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0.0, self.most - (x * x).sum(1)))[:, None]], 1)

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pivot, distance from it and ring of each row."""
        x = self.augmented(x)
        own = nearest(x, self.pivots)
        far = np.linalg.norm(x - self.pivots[own], axis=1)
        ring = np.array([int(np.searchsorted(self.edges[p], f)) for p, f in zip(own, far)], np.int64)
        return own, far, own * RINGS + ring

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and ring, the lowest and the highest score that its rows can have; -inf for both where it has none."""
        both = (q * q).sum(1)[:, None] + self.most
        away = np.linalg.norm(np.concatenate([q, np.zeros((len(q), 1))], 1)[:, None] - self.pivots, axis=2) if len(q) * self.pivots.size < 1 << 24 else np.stack([np.linalg.norm(np.append(r, 0.0) - self.pivots, axis=1) for r in q])
        away = np.repeat(away, RINGS, 1)
        least, most = np.maximum(0.0, np.maximum(away - self.high, self.low - away)), away + self.high
        slack = SLACK * both + 1.0
        low, high = (both - most * most) / 2 - slack, (both - least * least) / 2 + slack
        return np.where(self.count > 0, low, -np.inf), np.where(self.count > 0, high, -np.inf)


def indexed(own: DataFrame) -> tuple[DataFrame, dict[int, Index]]:
    """own with its ring, sorted by (pivot, distance) and written, and the indexes of its frequent lengths. A rare length has one ring, 0."""
    spark = own.sparkSession
    sizes = own.groupBy("d").agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = {r["d"]: r["n"] for r in sizes.where(F.col("n") >= max(LEAST_INDEXED, total // MOST_LENGTHS)).collect()}
    found: dict[int, Index] = {}
    for d, n in sorted(frequent.items()):
        mine = own.where(F.col("d") == d)
        most = mine.agg(F.max("sq")).first()[0]
        if not most < 1e200:
            continue  # squares of such distances would not be finite
        hashed, share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)), (SAMPLE + 6 * SAMPLE**0.5) / n
        likely = mine.where(hashed < int(share * (1 << 40))) if share < 1 else mine
        sample = likely.orderBy(hashed, "vec_id").limit(SAMPLE).select("v").toArrow()
        found[d] = Index(unpacked(sample.column("v").to_pylist(), d), n, most)
    shared = spark.sparkContext.broadcast(found)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ds = b.column("d").to_numpy()
            pivot, far, ring = np.zeros(len(ds), np.int64), np.zeros(len(ds)), np.zeros(len(ds), np.int64)
            for d in np.unique(ds).tolist():
                if d in shared.value:
                    on = np.flatnonzero(ds == d)
                    pivot[on], far[on], ring[on] = shared.value[d].keys(unpacked(b.column("v").take(pa.array(on)).to_pylist(), d))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot), pa.array(far), pa.array(ring)], [*b.schema.names, "pivot", "far", "ring"])

    keyed = arrow_map(own.drop("sq"), key, "vec_id long, label long, d int, v binary, pivot long, far double, ring long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(keyed.repartitionByRange(parts, "d", "pivot", "far", "vec_id").sortWithinPartitions("d", "pivot", "far"), "rings")
    # At most MOST_LENGTHS * MAX_PIVOTS * RINGS rows.
    for r in rows.where(F.col("d").isin(list(found))).groupBy("d", "ring").agg(F.min("far").alias("a"), F.max("far").alias("z"), F.count("*").alias("n")).collect():
        ix = found[r["d"]]
        ix.low[r["ring"]], ix.high[r["ring"]], ix.count[r["ring"]] = r["a"], r["z"], r["n"]
    return rows, found


ASKED = "anchor_id long, label long, d int, q binary, same boolean, tags array<int>, highs array<long>, floors array<long>, needs array<long>, ring long, reach double"


def plan(state: DataFrame, shared, turn: int) -> DataFrame:
    """The rings that each search visits next, a row for each. reach: rings whose best score is as high or higher are then seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rings, reach = [], [], []
            ds = b.column("d").to_numpy()
            for d in np.unique(ds).tolist():
                on = np.flatnonzero(ds == d)
                if d not in shared.value:  # one ring, seen at once
                    if turn == 0:
                        at += on.tolist()
                        rings += [0] * len(on)
                        reach += [-np.inf] * len(on)
                    continue
                ix = shared.value[d]
                low, high = ix.bounds(unpacked(b.column("q").take(pa.array(on)).to_pylist(), d))
                for i, lo, hi in zip(on.tolist(), low, high):
                    seen, highs, needs = b.column("reach")[i].as_py(), b.column("highs")[i].as_py(), b.column("needs")[i].as_py()
                    want = np.zeros(len(hi), bool)
                    for most, least in zip(highs, needs):
                        want |= (hi >= least) & (lo <= most)
                    ids = np.flatnonzero(want & (hi < seen) & (ix.count > 0))
                    ids = ids[np.argsort(-hi[ids], kind="stable")]
                    bar = -np.inf
                    if len(ids) and (turn == 0 or LOWEST in needs):
                        k = int(np.searchsorted(np.cumsum(ix.count[ids]), FIRST * GROWTH**turn))
                        if k < len(ids):
                            bar = hi[ids[k]]
                            ids = ids[hi[ids] >= bar]
                    at += [i] * len(ids)
                    rings += ids.tolist()
                    reach += [bar] * len(ids)
            out = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(out.column(c) for c in STATE), pa.array(rings, pa.int64()), pa.array(reach, pa.float64())], [*STATE, "ring", "reach"])

    return arrow_map(state.select(*STATE, "reach"), run, ASKED)


STATE = ["anchor_id", "label", "d", "q", "same", "tags", "highs", "floors", "needs"]


def visited(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(anchor_id, tag, vec_id, score): of each pair of blocks of a ring, the k best rows for each range of scores of each anchor."""
    counts = asked.groupBy("d", "ring").agg(F.count("*").alias("n_asked")).join(rows.groupBy("d", "ring").agg(F.count("*").alias("n_rows")), ["d", "ring"])
    counts = counts.withColumns({"q_blocks": F.expr(f"cast(n_asked div {QUERY_BLOCK} + 1 as int)"), "r_blocks": F.expr(f"cast(n_rows div {BLOCK} + 1 as int)")})
    counts = materialize(counts, "blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    key = ["d", "ring", "rb", "qb"]
    a = lookup(asked.drop("reach"), counts.drop("n_rows"), ["d", "ring"], "n_asked").withColumns({"qb": spread("anchor_id", "q_blocks"), "rb": every("r_blocks")})
    r = lookup(rows.select("d", "ring", "vec_id", "label", "v"), counts.drop("n_asked"), ["d", "ring"], "n_rows").withColumns({"rb": spread("vec_id", "r_blocks"), "qb": every("q_blocks")})
    a, r = a.select(*key, *(c for c in STATE if c != "d")), r.select(*key, "vec_id", "label", "v")

    def meet(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(qs) and len(xs):
            xs = xs.sort_values("vec_id")
            ids, labels, d = xs.vec_id.to_numpy(), xs.label.to_numpy(), int(xs.d.iloc[0])
            x = unpacked(list(xs.v), d)
            for at in range(0, len(qs), 64):
                part = qs.iloc[at : at + 64]
                found = scores(unpacked(list(part.q), d), x)
                for s, own, label, same, tags, highs, needs in zip(found, part.anchor_id, part.label, part.same, part.tags, part.highs, part.needs):
                    fit = np.flatnonzero(((labels == label) == same) & (ids != own) & (s >= min(needs)) & (s <= max(highs)))
                    for tag, most, least in zip(tags, highs, needs):
                        mine = fit[(s[fit] >= least) & (s[fit] <= most)]
                        if len(mine) > k:
                            mine = mine[s[mine] >= np.partition(s[mine], len(mine) - k)[len(mine) - k]]
                            mine = mine[np.argsort(-s[mine], kind="stable")][:k]  # rows are in order of their ids
                        out.append((np.full(len(mine), own), np.full(len(mine), tag), ids[mine], s[mine]))
        cols = ("anchor_id", "tag", "vec_id", "score")
        return pd.DataFrame({c: np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j, c in enumerate(cols)})

    return a.groupBy(*key).cogroup(r.groupBy(*key)).applyInPandas(meet, "anchor_id long, tag int, vec_id long, score long")


def search(state: DataFrame, rows: DataFrame, index: dict[int, Index], k: int) -> DataFrame:
    """(anchor_id, tag, vec_id, score, rank): for each range (tags, highs, needs) of each search, its k best rows; a written table."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(index)
    best, turn = None, 0
    state = state.withColumns({"needs": F.col("floors"), "reach": F.lit(float("inf"))})
    w = Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "vec_id")
    while True:
        asked = materialize(plan(state, shared, turn), "asked")
        if asked.isEmpty():
            break
        found = visited(asked, rows, k)
        found = found if best is None else found.unionByName(best.drop("rank"))
        new = materialize(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "best")
        if best is not None:
            forget(best)
        best, turn = new, turn + 1
        # Those that were just asked go on, with the last score of each full range as what a row must reach.
        full = best.where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "score"))).alias("last"))  # a tag at most for each positive
        going = asked.groupBy("anchor_id").agg(*(F.first(c).alias(c) for c in STATE[1:]), F.max("reach").alias("reach"))
        needs = F.transform(F.arrays_zip("tags", "floors"), lambda t: F.greatest(t["floors"], F.coalesce(F.try_element_at(F.col("last"), t["tags"]), t["floors"])))
        state = materialize(going.join(full, "anchor_id", "left").withColumn("needs", needs).drop("last"), "searches")
    shared.destroy()
    return best if best is not None else spark.createDataFrame([], "anchor_id long, tag int, vec_id long, score long, rank int")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors: (vec_id, label, embedding). Anchors are the rows for which is_anchor, over vec_id, holds. For each of an anchor's first
    `positives` rows of its label: its first `negatives` rows of other labels whose score is low to high hundredths of the positive's.
    """
    tuned(vectors.sparkSession)
    own = materialize(usable(vectors, scale), "vectors")
    rows, index = indexed(own)
    anchors = materialize(own.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), "label", "d", F.col("v").alias("q")), "anchors")
    longs = lambda x: F.array(F.lit(x).cast("long"))
    first = anchors.withColumns({"same": F.lit(True), "tags": F.array(F.lit(0)), "highs": longs(HIGHEST), "floors": longs(LOWEST)})
    liked = search(first, rows, index, positives).select("anchor_id", F.col("rank").alias("tag"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    # The range of whole scores between the two shares of a positive's, by integers alone; empty for most negative scores.
    share = lambda percent: F.col("positive_score").cast("decimal(20,0)") * F.lit(percent) / F.lit(100)
    ranges = liked.withColumns({"least": F.ceil(share(low)).cast("long"), "most": F.floor(share(high)).cast("long")})
    kept = ranges.where("least <= most").groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("tag", "most", "least"))).alias("w"))  # at most `positives` entries
    second = anchors.join(kept, "anchor_id").select("anchor_id", "label", "d", "q", F.lit(False).alias("same"), F.col("w.tag").alias("tags"), F.col("w.most").alias("highs"), F.col("w.least").alias("floors"))
    far = search(second, rows, index, negatives).select("anchor_id", "tag", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = liked.join(far, ["anchor_id", "tag"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    out = materialize(out, "negatives")
    forget(own, rows, anchors)
    return out


#: Every pair of an anchor and a row is scored. Values are whole numbers far below 2^53, so their products are exact.
ORACLE = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(x::double * 256)) as v
           from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as s from e as a join e as b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select a, b, s from s where same qualify row_number() over (partition by a order by s desc, b) <= 5)
select p.a as anchor_id, p.b as positive_id, row_number() over (partition by p.a, p.b order by s.s desc, s.b) as rank, s.b as negative_id, p.s as positive_score, s.s as negative_score
from p join s on s.a = p.a and not s.same and 80 * p.s <= 100 * s.s and 100 * s.s <= 100 * p.s qualify rank <= 5"""
