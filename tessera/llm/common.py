"""What several of the corpus operators share: tables, materialising, vectorised shingles, components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.session import shared_path, ship

#: Rows and bytes in an Arrow batch, whichever is reached first: whole texts travel in them.
ARROW_ROWS, ARROW_BYTES = 500, 16 << 20
#: Texts are hashed in buffers of about this many bytes.
BUFFER_BYTES = 1 << 18
SHINGLE_WORDS = 5
#: Two sets link when 100 * intersection >= 75 * union.
JACCARD_NUM, JACCARD_DEN = 75, 100
#: Pairs with one set that a task takes; a set in more is dealt to several tasks.
HOT_PAIRS, MOST_SALTS = 256, 4096
FETCHES = 8  # parts in which what is gathered in the driver arrives
FEW_HUBS = 200_000  # so many rows of two numbers may be broadcast
#: Places in a bitmap of ids: so many for each id, within these bounds (128 MB at most).
NEED_PLACES, LEAST_NEED_BITS, MOST_NEED_BITS = 16, 1 << 16, 1 << 30
#: Places for each number, and the most places: a bitmap of at most 128 MB. Beyond it more numbers than need be travel.
TWICE_PLACES, MAX_TWICE_BITS, TWICE_BLOCKS = 8, 1 << 30, 64
SENT = 1 << 20  # places sent at a time


def tuned(spark: SparkSession) -> SparkSession:
    """The package on the executors, and Arrow batches small enough for whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema), with the package shipped and batches bounded."""
    tuned(df.sparkSession)
    return df.mapInArrow(run, schema)


def fresh(names: Iterable[str], base: str) -> str:
    """base, or base with underscores before it, so that it is none of names."""
    taken = {n.lower() for n in names}
    while base.lower() in taken:
        base = "_" + base
    return base


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once in the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*tables: DataFrame, clean: bool = False) -> None:
    """Delete tables of materialize() from which everything has been made that will be.

    Shuffle files and broadcasts of finished steps stay on the executors' disks until the driver collects its garbage, so that
    is asked for too with clean: long operators would else hold all of their shuffles at once, and the driver's heap only grows.
    """
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    if clean and tables:
        gc.collect()
        sc._jvm.System.gc()


def derive(df: DataFrame, keep: list[str], new: str, make: Callable[[list], dict]) -> DataFrame:
    """The columns of keep, untouched, and those of the schema new that make() gives for a batch of texts.

    make takes the texts and returns lists or arrays by name; a new column replaces one of its name in keep.
    """
    added = T.StructType.fromDDL(new)
    names = [f.name for f in added.fields]
    own = [c for c in keep if c not in names]
    # Numbered on their way through Python, as names may hold anything.
    source = df.select(*(quoted(c).alias(f"c{k}") for k, c in enumerate(own)), F.col("text").alias("given"))
    schema = T.StructType(source.schema.fields[:-1] + [T.StructField(f"n{k}", f.dataType, f.nullable) for k, f in enumerate(added.fields)])
    types = pa.schema(to_arrow_schema(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            got = make(x.column(len(own)).to_pylist())
            yield pa.RecordBatch.from_arrays([*x.columns[: len(own)], *(pa.array(got[f.name], f.type) for f in types)], [f.name for f in schema.fields])

    return arrow_map(source, run, schema).toDF(*own, *names)


def quoted(name: str) -> Column:
    """A column by its name, whatever is in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def share_of(column: Column, share: float) -> Column:
    """Whether a hash of column is among the smallest `share` of all hashes: a sample that is the same in every run."""
    return F.pmod(F.xxhash64(column, F.lit(77)), F.lit(1 << 40)) < F.lit(int(min(1.0, share) * (1 << 40)))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = _stream(256, 11)
_PLACE = _stream(SHINGLE_WORDS, 23) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, np.int64)
_STOP[[0x21, 0x2E, 0x3F]] = 1
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(19, (n - 1).bit_length())
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def word_spans(raw: list[bytes], space: np.ndarray = _SPACE) -> tuple:
    """(bytes of all texts, start and end of each word, offsets of each text's words, sums of hashed bytes, what brings a sum back to its start)."""
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends_at = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
    apart = space[buf]
    edge = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    if not apart[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _power(_BASE, len(buf)), out=total[1:])
    offsets = np.concatenate(([0], np.searchsorted(start, ends_at))).astype(np.int64)
    return buf, start, end, offsets, total, _power(_BASE_INV, len(buf))[start]


def word_hashes(texts: list[str | None], space: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> tuple:
    """64-bit hashes of all words (A-Z lower-cased) of the texts in order; space marks the bytes between words.

    By default words are `[^\\x20\\x09-\\x0D]+`. Returns (hash per word, whether a sentence or line ends there: 1 and
    2, offsets of the words of each text, one more than texts), and for each length of prefixes the hash of so
    many leading bytes of every word, 0 where the word is not longer.
    """
    buf, start, end, offsets, total, back = word_spans([b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in texts], space)
    h = mix((total[end] - total[start]) * back)
    heads = [np.where(end - start > k, mix((total[np.minimum(start + k, len(buf))] - total[start]) * back + np.uint64(k)), np.uint64(0)) for k in prefixes]
    stops = _STOP[buf[end - 1]] | (buf[end] == 10) * 2 if len(end) else np.zeros(0, np.int64)
    return h, stops, offsets, *heads


def shingle_all(h: np.ndarray) -> np.ndarray:
    """Hashes of every five consecutive word hashes; entry i begins at word i."""
    n = max(0, len(h) - SHINGLE_WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE_WORDS):
        out += h[k : k + n] * _PLACE[k]
    return mix(out)


def short_shingle(h: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer than five words: its whole sequence."""
    out = np.array([len(h)], np.uint64)
    for k in range(len(h)):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[k : k + 1])
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def buffers(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BUFFER_BYTES each."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= BUFFER_BYTES:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text, the sorted hashes of its distinct five-word shingles; empty without words."""
    for lo, hi in buffers(texts):
        h, _, at = word_hashes(texts[lo:hi])
        every = shingle_all(h)
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= SHINGLE_WORDS:
                yield distinct(every[a : b - SHINGLE_WORDS + 1])
            elif b > a:
                yield short_shingle(h[a:b])
            else:
                yield np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def need_bits(n: int) -> int:
    """The size of a bitmap for n ids. Beyond MOST_NEED_BITS / NEED_PLACES ids it fills up, and more passes than need be."""
    return min(MOST_NEED_BITS, max(LEAST_NEED_BITS, 1 << (NEED_PLACES * n).bit_length()))


def marked(ids: DataFrame, bits: int, place: Column | None = None) -> np.ndarray:
    """A bitmap with the places of hashed ids (a column doc_id) set, or with the places given."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits)) if place is None else place
    at = ids.select(F.bitmap_bucket_number(place).alias("k"), F.bitmap_bit_position(place).alias("p"))
    rows = at.groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits"))
    flags = np.zeros((bits // 32768 + 2, 4096), np.uint8)
    for r in rows.repartition(FETCHES).toLocalIterator():  # a job for each partition, a part of the bitmap in the driver at a time
        flags[r["k"]] = np.frombuffer(r["bits"], np.uint8)
    return flags


def placed(df: DataFrame, bits: int) -> DataFrame:
    """df with the columns at_bucket and at_bit: where its doc_id is in such a bitmap."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    return df.withColumns({"at_bucket": F.bitmap_bucket_number(place), "at_bit": F.bitmap_bit_position(place)})


def chosen(x: pa.RecordBatch, flags: np.ndarray) -> pa.RecordBatch:
    """The rows of a placed() batch that a bitmap marks."""
    k, p = x.column("at_bucket").to_numpy(), x.column("at_bit").to_numpy()
    return x.take(pa.array(np.flatnonzero(flags[k, p >> 3] >> (p & 7).astype(np.uint8) & 1)))


def place_of(numbers: np.ndarray, bits: int) -> np.ndarray:
    return (mix(numbers) & np.uint64(bits - 1)).astype(np.int64)


def _blocks(at: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    edges = np.searchsorted(at, np.arange(TWICE_BLOCKS + 1, dtype=np.int64) * size)
    for k in np.flatnonzero(np.diff(edges)):
        yield int(k), at[edges[k] : edges[k + 1]]


def taken_twice(df: DataFrame, numbers: Callable[[pa.RecordBatch], np.ndarray], n: int) -> np.ndarray:
    """A bitmap of bounded size: where the place of one of some n numbers (64 bits) is taken twice or more. A number alone in its place has no equal.
    Places are sent as 32-bit numbers, sorted by blocks."""
    bits = min(MAX_TWICE_BITS, max(1 << 16, 1 << (TWICE_PLACES * n).bit_length()))
    if n > 4 * MAX_TWICE_BITS:  # nearly all places would be taken twice, so nothing need be counted
        return np.full(bits // 8, 255, np.uint8)
    size = bits // TWICE_BLOCKS

    def sent(own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, part in _blocks(np.sort(place_of(np.concatenate(own), bits)), size):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype("<u4").tobytes()], pa.binary())], ["block", "places"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = [np.zeros(0, np.uint64)], 0
        for x in batches:
            own.append(numbers(x))
            held += len(own[-1])
            if held > SENT:
                yield from sent(own)
                own, held = own[:1], 0
        yield from sent(own)

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for x in batches:
            for k, b in zip(x.column(0).to_pylist(), x.column(1)):
                at = np.frombuffer(b.as_buffer(), "<u4") - np.uint32(k * size)
                count = seen.setdefault(k, np.zeros(size, np.uint8))
                u, times = np.unique(at, return_counts=True)
                count[u] = np.minimum(2, count[u] + np.minimum(times, 2))
        for k, count in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(count > 1, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    got = arrow_map(df, places, "block int, places binary").repartition(TWICE_BLOCKS, "block").mapInArrow(twice, "block int, bits binary").repartition(FETCHES).toLocalIterator()
    out = np.zeros((TWICE_BLOCKS, size // 8), np.uint8)
    for r in got:
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def twice_among(numbers: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """For each number whether such a bitmap marks its place."""
    at = place_of(numbers, 8 * len(flags))
    return (flags[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def sieve(docs: DataFrame, ids: DataFrame, make: Callable[[list, list], pa.RecordBatch], schema: str) -> tuple[DataFrame, Broadcast]:
    """make(doc_ids, texts) for the rows of docs whose doc_id may be one of ids (a written table): all that are, and few others.

    Only a bitmap of bounded size is broadcast, so texts that are not asked for are neither shuffled nor cut up. What passes
    by chance has to be told apart by what follows. The broadcast is returned too, to be destroyed once the rows are written.
    """
    bits = need_bits(ids.count())
    need = docs.sparkSession.sparkContext.broadcast(marked(ids, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            own = chosen(x, need.value)
            if own.num_rows:
                yield make(own.column("doc_id").to_pylist(), own.column("text").to_pylist())

    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(placed(own, bits), run, schema), need


def sized(na: Column, nb: Column) -> Column:
    """Whether sets of these sizes can link."""
    return (na * JACCARD_DEN >= nb * JACCARD_NUM) & (nb * JACCARD_DEN >= na * JACCARD_NUM)


def linked(pairs: DataFrame, parts: DataFrame, fragments: int) -> DataFrame:
    """(a, b) of pairs (a, na, b, nb), a written table, whose sets link. parts: (fp, f, part), the fragments of each set, which
    may repeat; overlaps are counted by fragment and summed by pair.

    Both joins use one exchange of the parts, by set and fragment. A set that is the b of many pairs, as hubs are, would
    bring all of those to one task: such pairs are dealt over salts, and the fragments of these few sets copied to each.
    """
    one = parts.repartition("fp", "f").dropDuplicates(["fp", "f"])
    hot = pairs.groupBy("b").agg(F.count("*").alias("c")).where(F.col("c") > HOT_PAIRS).select("b", F.least(F.lit(MOST_SALTS), F.expr(f"c div {HOT_PAIRS} + 1")).cast("int").alias("salts"))
    hot = materialize(hot, "hot")
    n_hot = hot.count()
    few = F.broadcast(hot) if n_hot <= FEW_HUBS else hot
    x, y = one.alias("x"), one.alias("y")

    def first_side(own: DataFrame) -> DataFrame:
        asked = own.withColumn("g", F.explode(F.array(*map(F.lit, range(fragments)))))
        return asked.join(x, (asked.a == F.col("x.fp")) & (asked.g == F.col("x.f"))).drop("fp", "f").withColumnRenamed("part", "pa")

    left = first_side(pairs.join(few, "b", "left_anti") if n_hot else pairs)
    both = left.join(y, (left.b == F.col("y.fp")) & (left.g == F.col("y.f"))).select("a", "na", "b", "nb", "pa", "part")
    if n_hot:
        dealt = first_side(pairs.join(few, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")).drop("salts"))
        copies = one.join(few.withColumnRenamed("b", "fp"), "fp").select(F.col("fp").alias("b"), F.col("f").alias("g"), "part", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        both = both.union(dealt.join(copies, ["b", "g", "salt"]).select("a", "na", "b", "nb", "pa", "part"))
    overlap = both.select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "part")).cast("long").alias("o")).groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return overlap.where(F.col("o") * JACCARD_DEN >= (F.col("na") + F.col("nb") - F.col("o")) * JACCARD_NUM).select("a", "b")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every end of an edge; component: the smallest node reachable. A written table.

    Large-star and small-star rounds: each node links to the smallest of its neighbours, until nothing changes.
    No node's neighbours are gathered: every step is a minimum by key and a join. Each round is written in the
    shared folder, and the one before it deleted. Null ends and self-links are ignored; empty input gives no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    first = e = materialize(e, "links")
    while True:
        # Large star: the larger neighbours of a node go to the smallest node of its neighbourhood.
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: the smaller neighbours, and the node, go to the smallest of them.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        before, e = e, materialize(small, "links")
        if before is not first:
            forget(before)
        # Done when every node has one smaller neighbour and that one has none.
        up = e.groupBy("u").agg(F.count("*").alias("n"))
        if up.join(e.select(F.col("v").alias("u"), F.lit(1).alias("higher")), "u", "left").where("n > 1 or higher = 1").isEmpty():
            break
    nodes = first.select(F.col("u").alias("node")).union(first.select("v")).distinct()
    out = nodes.join(e.select(F.col("u").alias("node"), "v"), "node", "left").groupBy("node").agg(F.min(F.coalesce("v", "node")).alias("component"))
    out = materialize(out, "components")
    forget(first, e)
    return out
