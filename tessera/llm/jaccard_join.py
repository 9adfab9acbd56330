"""Operator 10: n-gram Jaccard join by vertical partitioning of a global n-gram order.

A document's set holds its distinct five-word shingles (fewer words: the whole sequence; none: empty, linked with
nothing). Two link when 100 * intersection >= 75 * union. The join is exact; only the order is approximate.

1. Order. All shingles of all documents are counted in ORDER_BUCKETS counters, a sketch of fixed size; the order is by
   the bucket's count, then the bucket, then the hash, so that what is frequent comes last. Pivots at equal shares of the
   counts cut the order into FRAGMENTS.
2. Classes. Documents with equal sets are one class; what follows is between classes.
3. Stars. If two sets link, their prefixes in the order (n - ceil(0.75 n) + 1 shingles) share a shingle. Each posting
   names a hub, the class whose prefix is commonest; each class is verified against the hub that it shares most with.
   Verified links give components.
4. Rest. Postings with several components left give the pairs of classes between them; those that the places in the order
   and the sizes still allow are verified. So a group of thousands of near copies is not expanded into its pairs, and no
   pair between components is missed.
5. Verifying: the sets are cut into their fragments, the overlap is counted for each fragment apart, and summed.

Nulls: a null text is empty; a row with a null doc_id links with nothing and has a null component. Rows that repeat a
doc_id are one document: the links of each are links of the doc_id, and all of them have one component. Empty tables give
no rows.

Sets are told apart by 64-bit prints, and shingles by 64-bit hashes. Among 10^8 distinct sets there is a chance of 1 in
3,700 that any two are taken for equal by mistake; among 10^10 some three pairs are to be expected. Prints of 128 bits
would add half to what is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import JACCARD_DEN, JACCARD_NUM, MOST_SALTS, arrow_map, chosen, connected_components, derive, forget, fresh, linked, materialize, mix, placed, sieve, signed, sized, tuned

ORDER_BITS = 22
ORDER_BUCKETS = 1 << ORDER_BITS
FRAGMENTS = 8
SKETCH_BLOCK = 1 << 16
TASKS_A_CORE, PARTS = 4, 2  # fewest tasks that count for the order, and partitions of the scan that one takes
HOT_POSTINGS = 128  # postings of a shingle that one task pairs with all others of it


class Order:
    """The global order: a one-to-one renaming of shingle hashes whose numbers are in that order, and the pivots."""

    def __init__(self, counts: np.ndarray):
        # One array of numbers, count before bucket, is sorted in place: ties go by the buckets, and little memory is taken.
        by = counts.astype(np.uint64)
        by <<= np.uint64(ORDER_BITS)
        by |= np.arange(len(counts), dtype=np.uint32)
        by.sort()
        self.rank = np.empty(len(counts), np.uint32)
        for a in range(0, len(by), SKETCH_BLOCK):
            own = by[a : a + SKETCH_BLOCK]
            self.rank[(own & np.uint64(ORDER_BUCKETS - 1)).astype(np.int64)] = np.arange(a, a + len(own), dtype=np.uint32)
        by >>= np.uint64(ORDER_BITS)
        mass = np.cumsum(by, out=by)
        at = np.searchsorted(mass, int(mass[-1]) * np.arange(1, FRAGMENTS) / FRAGMENTS) if mass[-1] else np.arange(1, FRAGMENTS)
        self.pivots = at.astype(np.uint64) << np.uint64(64 - ORDER_BITS)

    def rename(self, shingles: np.ndarray) -> np.ndarray:
        rank = self.rank[(shingles & np.uint64(ORDER_BUCKETS - 1)).astype(np.int64)].astype(np.uint64)
        return np.sort((rank << np.uint64(64 - ORDER_BITS)) | (shingles >> np.uint64(ORDER_BITS)))

    def fragments(self, ordered: np.ndarray) -> list[np.ndarray]:
        return np.split(ordered, np.searchsorted(ordered, self.pivots))


def count_order(docs: DataFrame) -> Order:
    """Counts over all documents, summed by blocks of counters; what reaches the driver is of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER_BUCKETS, np.uint32)
        for x in batches:
            texts = x.column(0).to_pylist()
            for lo, hi in common.buffers(texts):
                h, _, at = common.word_hashes(texts[lo:hi])[:3]
                every = common.shingle_all(h)
                # Those that begin in one text and end in another are counted too; they only shift the order a little.
                np.add.at(total, (every & np.uint64(ORDER_BUCKETS - 1)).astype(np.int64), np.uint32(1))
        yield from blocks(total, range(0, ORDER_BUCKETS, SKETCH_BLOCK))

    def blocks(total: np.ndarray, starts) -> Iterator[pa.RecordBatch]:
        for a in starts:
            # Byte planes apart: the upper ones are nearly all zeros and cost little in a shuffle.
            planes = total[a : a + SKETCH_BLOCK].view(np.uint8).reshape(-1, 4).T.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([a // SKETCH_BLOCK], pa.int32()), pa.array([planes], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for x in batches:
            for k, c in zip(x.column(0).to_pylist(), x.column(1)):
                own = np.frombuffer(c.as_buffer(), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
                total[k] = total[k] + own if k in total else own.astype(np.int64)
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.minimum(v, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())], ["block", "counts"])

    # A sketch for each task, so a task takes PARTS of the scan's partitions, of a bounded size each: sketches stay a small part of what is read.
    scanned = docs.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0
    texts = docs.select("text").coalesce(max(TASKS_A_CORE * docs.sparkSession.sparkContext.defaultParallelism, scanned // PARTS))
    parts = arrow_map(texts, count, "block int, counts binary").repartition(ORDER_BUCKETS // SKETCH_BLOCK, "block").mapInArrow(add, "block int, counts binary").repartition(common.FETCHES)
    counts = np.zeros(ORDER_BUCKETS, np.uint32)
    for r in parts.toLocalIterator():
        counts[r["block"] * SKETCH_BLOCK : (r["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(r["counts"], np.uint32)
    return Order(counts)


def print_of(ordered: np.ndarray) -> int:
    """A 64-bit print of a set."""
    x = mix(ordered + np.uint64(0x632BE59BD9B4E019))
    return int(signed(mix(x.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(x))))[0])


def least_overlap(na: Column, nb: Column) -> Column:
    """The smallest intersection with which sets of these sizes link."""
    return F.ceil((na + nb) * JACCARD_NUM / (JACCARD_NUM + JACCARD_DEN))


def prefix_length(n: int) -> int:
    return n - -(-n * JACCARD_NUM // JACCARD_DEN) + 1


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, order, name: str) -> DataFrame:
    """(a, b) of pairs (a, na, b, nb) that link, verified on their texts. pairs and the result are written tables."""
    need = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct().join(reps.select("fp", "doc_id"), "fp")
    need = materialize(need.select("doc_id"), "needed")

    def cut(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        rows = ([], [], [])
        for s in common.shingle_sets(texts):
            if len(s):
                s = order.value.rename(s)
                fp = print_of(s)
                for f, part in enumerate(order.value.fragments(s)):
                    if len(part):
                        for c, v in zip(rows, (fp, f, signed(part))):
                            c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.list_(pa.int64()))], ["fp", "f", "part"])

    parts, asked = sieve(docs, need, cut, "fp long, f int, part array<long>")
    out = materialize(linked(pairs, parts, FRAGMENTS), name)
    asked.destroy()
    forget(need, clean=True)
    return out


def shared_places(prefixes: DataFrame, reps_map, need_bits: int) -> np.ndarray:
    """A bitmap: where a prefix shingle's hashed place is taken twice or more. A shingle alone in its place has no partner, so its posting need not travel."""
    n = prefixes.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0)).alias("n")).first()["n"]
    own = placed(prefixes.select("doc_id", "prefix"), need_bits)
    return common.taken_twice(own, lambda x: chosen(x, reps_map.value).column("prefix").flatten().to_numpy().view(np.uint64), n)


def link(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id), a row for each row of docs."""
    sc = tuned(docs.sparkSession).sparkContext
    order = sc.broadcast(count_order(docs))

    def make(texts: list[str | None]) -> dict:
        n, fp, prefix = [], [], []
        for s in common.shingle_sets(texts):
            n.append(len(s))
            if len(s):
                s = order.value.rename(s)
            fp.append(print_of(s) if len(s) else None)
            prefix.append(signed(s[: prefix_length(len(s))]) if len(s) else None)
        return {"n": n, "fp": fp, "prefix": prefix}

    sets = materialize(derive(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], "n long, fp long, prefix array<long>", make), "sets")
    known = sets.where("doc_id is not null and fp is not null")
    reps = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "classes")

    # Postings of one document of each class (some more may pass the bitmap: the same posting again), of shingles that may have a partner.
    bits = common.need_bits(reps.count())
    reps_map = sc.broadcast(common.marked(reps, bits))
    twice = sc.broadcast(shared_places(known, reps_map, bits))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            x = chosen(x, reps_map.value)
            prefix = x.column("prefix")
            tokens, edges = prefix.flatten().to_numpy().view(np.uint64), prefix.offsets.to_numpy().astype(np.int64)
            edges = edges - edges[0]
            size = np.diff(edges)
            of = np.repeat(np.arange(len(size)), size)
            # How rare a class's prefix is: the shingle at a quarter of it. Of near copies, the one with the fewest words of its own ranks highest.
            common_ = (tokens[edges[:-1] + size // 4] >> np.uint64(1)).view(np.int64) if len(size) else np.zeros(0, np.int64)
            keep = np.flatnonzero(common.twice_among(tokens, twice.value))
            of = of[keep]
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([pa.array(signed(tokens[keep])), x.column("fp").take(take), x.column("n").take(take), pa.array((keep - edges[of]).astype(np.int32)), pa.array(common_[of])], ["token", "fp", "n", "pos", "q"])

    posts = arrow_map(placed(known, bits), post, "token long, fp long, n long, pos int, q long").repartition("token").dropDuplicates(["token", "fp"])
    hubs = posts.groupBy("token").agg(F.max(F.struct("q", "fp", "n")).alias("hub"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("token", F.col("hub.fp").alias("b"), F.col("hub.n").alias("nb"))
    shared = materialize(posts.drop("q").join(hubs, "token"), "postings")  # postings of two classes or more
    reps_map.destroy()
    twice.destroy()

    # Stars. A posting's hub is its class with the commonest prefix; a class is verified against the hub that it shares most with.
    stars = shared.where((F.col("fp") != F.col("b")) & sized(F.col("n"), F.col("nb"))).groupBy("fp", "n", "b", "nb").agg(F.count("*").alias("c"))
    best = stars.groupBy("fp", "n").agg(F.max(F.struct("c", "b", "nb")).alias("s")).select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("s.b").alias("b"), F.col("s.nb").alias("nb"), "s.c")
    # A star pair need not be complete: those with too little in common for a link by far are left to the next step.
    best = materialize(best.where(F.col("c") * 10 >= F.least("na", "nb")).drop("c"), "pairs")
    first = verified(best, reps, docs, order, "stars")
    groups = connected_components(first)

    # The rest: postings in which several components meet. If two sets link, their first common shingle stands early enough in both to leave
    # room for the least overlap of their sizes. A shingle of many such postings is dealt over salts: one side once, the other to each.
    own = shared.select("token", "fp", "n", "pos").join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("token", "fp", "n", "pos", F.coalesce("component", "fp").alias("g")).repartition("token")
    mixed = own.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("token", F.least(F.lit(MOST_SALTS), F.expr(f"c div {HOT_POSTINGS} + 1")).cast("int").alias("salts"))
    own = materialize(own.join(mixed, "token"), "mixed")
    forget(best, shared)
    x = own.withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")).alias("x")
    y = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("y")
    least = least_overlap(F.col("x.n"), F.col("y.n"))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.salt") == F.col("y.salt"))).where((F.col("x.fp") < F.col("y.fp")) & (F.col("x.g") != F.col("y.g")) & sized(F.col("x.n"), F.col("y.n")) & (F.col("x.pos") <= F.col("x.n") - least) & (F.col("y.pos") <= F.col("y.n") - least))
    more = materialize(met.select(F.col("x.fp").alias("a"), F.col("x.n").alias("na"), F.col("y.fp").alias("b"), F.col("y.n").alias("nb")).distinct(), "pairs")
    second = verified(more, reps, docs, order, "links")
    order.destroy()
    forget(own, more, groups)

    # Rows that repeat a doc_id with other texts are one document: their classes belong together.
    repeated = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("hi")).where("a < hi").select("doc_id", "a")
    same = known.select("doc_id", F.col("fp").alias("b")).join(repeated, "doc_id").where("a <> b").select("a", "b")
    nodes = connected_components(first.union(second).union(same))
    forget(first, second)
    label = reps.select("fp", "doc_id").join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.col("doc_id").alias("class_id"), F.coalesce("component", "fp").alias("component"))
    label = materialize(label, "labels")
    forget(nodes, reps)
    smallest = label.groupBy("component").agg(F.min("class_id").alias("component_id"))
    label = label.join(smallest, "component").select("fp", "class_id", "component_id")
    # A row without words goes with the other rows of its doc_id, if any.
    blank = sets.where("fp is null and doc_id is not null").select("doc_id", F.col("n").alias("n_shingles")).join(known.groupBy("doc_id").agg(F.min("fp").alias("fp")), "doc_id", "left")
    ids = known.select("doc_id", F.col("n").alias("n_shingles"), "fp").union(blank)
    nameless = sets.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("long").alias("class_id"))
    return ids.join(label, "fp", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id")).union(nameless)


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component the rows of its smallest doc_id stay, with their columns; rows linked with nothing stay."""
    name = fresh(docs.columns, "away")
    away = link(docs).where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(away, F.col("doc_id").cast("long") == F.col(name), "left_anti")
