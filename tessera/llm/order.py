"""Operator 7: token ids in training order, as fixed-stride binary shards.

Documents become token ids with an end id, cut into sequences of at most LENGTH. Every document has room in a range of
numbers for as many sequences as its bytes could give: each partition of the scan has a range as large as the fullest
partition needs, which is counted first, so a text is tokenised once and two numbers are all that the driver holds. A keyed
Feistel permutation with cycle-walking of all these numbers gives every sequence its place in a global order, without a
shuffle of an order. Records go, in compressed blocks, to the shard of their range of places, where Spark sorts the blocks
by smaller ranges; the records of one such range at a time are put in order and written with one stride by Spark's own
writer. Places that no sequence has taken leave no gap: the permuted places are closed up, so a record's slot is the rank of
its place among those taken. Record i of shard k is at byte i * stride, and its slot is i plus the records of the shards
before, which their sizes tell. Training reads shards from front to back, and read_from() resumes at any slot: the sizes
name the shard, and one multiplication the byte; shards before it are not opened.

Shards hold about SHARD_BYTES; smaller inputs give FEWEST shards for each core, but none of less than LEAST_BYTES. How many
records there will be is reckoned from those that a sample of SAMPLE_TEXTS texts gives for its room, as texts of digits or of
Chinese have many more ids a byte than prose. Writing holds one block of a shard at a time, and reading RANGE_BYTES: read_shards()
and read_from() open shards at the records that are asked for, so shards of any size can be read.

A record: doc_id (8 bytes, signed), sequence within the document (4), tokens (2), ids (2 each, PAD beyond the end), a line
feed; numbers are little-endian. The ids of the vocabulary named must be below PAD.

The scan is read twice. A partition that needs more than the fullest did at first fails the job; input that is not a plain
scan is to be written first.

Nulls: a null text is empty and becomes the end id alone; a null doc_id is written as NO_ID and read back as null.
Rows that repeat are written each for itself. Empty tables write no shard.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_path

from .common import arrow_map, mix, share_of
from .tokens import encoder, word_bpe_path

LENGTH, PAD, END_ID = 256, 0xFFFF, 0
SHARD_BYTES, LEAST_BYTES, FEWEST = 1 << 30, 8 << 20, 16
BLOCK = 8192  # records that are put in order at a time, about
GROWTH = 3  # a byte of a text gives at most so many ids: normal forms have up to three times the bytes
DEALT = 16 << 20  # bytes of records that are dealt to shards at a time
ROUNDS = 6
SAMPLE_TEXTS = 2000
RANGE_BYTES = 32 << 20  # of a shard that a task reads at a time
NO_ID = -(1 << 63)


def record(length: int) -> np.dtype:
    return np.dtype([("doc_id", "<i8"), ("seq", "<u4"), ("n", "<u2"), ("ids", "<u2", length), ("feed", "u1")])


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of numbers below n: a bijection of range(n)."""
    half = np.uint64(max(1, -(-max(1, (n - 1).bit_length()) // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(key % (1 << 64)))
    out = x.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> half, out[walk] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[walk] = (left << half) | right
        walk = walk[out[walk] >= n]  # outside: walk on along the cycle
    return out.astype(np.int64)


def _sequences(n_ids: int, length: int) -> int:
    """Sequences of so many ids and the end id."""
    return -(-(n_ids + 1) // length)


def reckoned(rows: DataFrame, path: str, length: int, room: int) -> int:
    """About how many records rows (doc_id, text) give that have room for so many: by the share that a sample, of bounded size, takes of its room."""
    n = rows.count()
    sample = rows.where(share_of(F.xxhash64("doc_id", "text"), SAMPLE_TEXTS / max(1, n))).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            texts = x.column(0).to_pylist()
            if texts:
                taken = sum(_sequences(len(i), length) for i in encoder(path, 2).encode(texts))
                places = sum(_sequences(GROWTH * len((t or "").encode("utf-8", "surrogatepass")), length) for t in texts)
                yield pa.RecordBatch.from_arrays([pa.array([taken], pa.int64()), pa.array([places], pa.int64())], ["taken", "places"])

    r = arrow_map(sample, count, "taken long, places long").agg(F.sum("taken").alias("taken"), F.sum("places").alias("places")).first()
    return max(1, round(room * r.taken / r.places)) if r.places else room // 8


def write_shards(docs: DataFrame, to: str, key: int, path: str | None = None, length: int = LENGTH, shard_bytes: int | None = None) -> None:
    """Writes all sequences of docs under `to`."""
    spark = docs.sparkSession
    path = path or word_bpe_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    room = F.ceil((GROWTH * F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / length)
    by_part = rows.select(F.spark_partition_id().alias("part"), room.alias("room")).groupBy("part").agg(F.sum("room").alias("room"))
    one = by_part.agg(F.max("room").alias("most"), (F.max("part") + 1).alias("parts"), F.sum("room").alias("taken")).first()
    if not one.most:
        return
    most, total = one.most, one.most * one.parts
    kind = record(length)
    about = reckoned(rows, path, length, one.taken)
    if shard_bytes is None:
        fewest = FEWEST * spark.sparkContext.defaultParallelism
        shard_bytes = max(LEAST_BYTES, min(SHARD_BYTES, about * kind.itemsize // fewest))
    n_shards = max(1, about * kind.itemsize // shard_bytes)
    n_blocks = n_shards * max(1, about // (BLOCK * n_shards))  # as many in each shard

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts' records with their places, by shard, compressed for about DEALT bytes at a time."""
        zip_ = zstandard.ZstdCompressor(level=3)
        at = TaskContext.get().partitionId() * most
        limit = at + most

        def sent(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            place, out = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            turn = np.argsort(place)
            place, out = place[turn], out[turn]
            to_block = place * n_blocks // total if total * n_blocks < 1 << 62 else np.minimum(n_blocks - 1, (place / (total / n_blocks)).astype(np.int64))
            edges = np.concatenate([[0], np.flatnonzero(np.diff(to_block)) + 1, [len(place)]])
            own = [zip_.compress(place[a:b].astype("<i8").tobytes() + out[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
            part = to_block[edges[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array((part // (n_blocks // n_shards)).astype(np.int32)), pa.array(part), pa.array(np.diff(edges), pa.int64()), pa.array(own, pa.binary())], ["shard", "part", "n", "block"])

        held, size = [], 0
        for x in batches:
            texts = x.column(1).to_pylist()
            if not texts:
                continue
            ids = encoder(path, 2).encode(texts)
            rooms = np.array([_sequences(GROWTH * len((t or "").encode("utf-8", "surrogatepass")), length) for t in texts], np.int64)
            n_own = np.array([_sequences(len(i), length) for i in ids], np.int64)
            of = np.repeat(np.arange(len(ids)), n_own)
            out = np.zeros(len(of), kind)
            out["doc_id"] = x.column(0).fill_null(NO_ID).to_numpy()[of]
            out["seq"], out["feed"] = np.arange(len(of)) - np.repeat(np.cumsum(n_own) - n_own, n_own), 10
            k = 0
            for own, m in zip(ids, n_own):
                t = np.full(m * length, PAD, "<u2")
                t[: len(own)], t[len(own)] = own, END_ID
                out["ids"][k : k + m] = t.reshape(m, length)
                out["n"][k : k + m] = length
                out["n"][k + m - 1] = len(own) + 1 - (m - 1) * length
                k += m
            held.append((permuted(at + (np.cumsum(rooms) - rooms)[of] + out["seq"], total, key), out))
            at += int(rooms.sum())
            if at > limit:
                raise RuntimeError("a partition of the scan needs more room than at the first reading; write the table first")
            size += out.nbytes
            if size > DEALT:
                yield from sent(held)
                held, size = [], 0
        if held:
            yield from sent(held)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's records in order of their slots; blocks of one part follow one another."""
        unzip, slots, out, now = zstandard.ZstdDecompressor(), [], [], None

        def records() -> Iterator[pa.RecordBatch]:
            r = np.concatenate(out)[np.argsort(np.concatenate(slots))]
            for a in range(0, len(r), 2048):
                raw = r[a : a + 2048].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + kind.itemsize - 1] for i in range(0, len(raw), kind.itemsize)], pa.binary())], ["record"])

        for x in batches:
            for part, n, block in zip(x.column("part").to_pylist(), x.column("n").to_pylist(), x.column("block").to_pylist()):
                if part != now and out:
                    yield from records()
                    slots, out = [], []
                now = part
                raw = unzip.decompress(block)
                slots.append(np.frombuffer(raw[: 8 * n], "<i8"))
                out.append(np.frombuffer(raw[8 * n :], kind))
        if out:
            yield from records()

    dealt = arrow_map(rows, deal, "shard int, part long, n long, block binary").repartitionById(n_shards, F.col("shard")).sortWithinPartitions("part")
    # The writer puts the bytes of strings as they are and a line feed after each, so records keep their stride.
    arrow_map(dealt, put, "record binary").select(F.col("record").cast("string").alias("value")).write.option("compression", "none").text(to)


def shard_files(spark: SparkSession, path: str, length: int = LENGTH) -> list[tuple[int, str, int, int]]:
    """(number, path, slot of its first record, records) of each shard, from the files' sizes alone: a row a shard."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    out, at = [], 0
    for r in sorted(files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "path", "length").collect()):
        if r["length"] % record(length).itemsize:
            raise RuntimeError(f"shard {r['shard']} is cut short")
        out.append((r["shard"], r["path"], at, r["length"] // record(length).itemsize))
        at += out[-1][3]
    return out


def _bytes_of(path: str, start: int, size: int) -> bytes:
    """A range of a file: of a local or mounted path, or by pyarrow's file system for its scheme."""
    if path.startswith(("/", "file:")):
        with open(unquote(re.sub("^file:/*", "/", path)), "rb") as f:
            f.seek(start)
            raw = f.read(size)
    else:
        system, base = fs.FileSystem.from_uri(path)
        with system.open_input_file(base) as f:
            raw = f.read_at(size, start)
    if len(raw) != size:
        raise RuntimeError(f"{path} is cut short")
    return raw


READ = "slot long, shard int, byte_offset long, doc_id long, seq long, n_tokens long, ids_crc32 long, ids binary"


def rows_of(raw: memoryview | bytes, base: int, shard: int, first: int, length: int) -> Iterator[pa.RecordBatch]:
    """READ rows of a shard's bytes from its record `first` on; base is the slot of the shard's first record."""
    kind = record(length)
    if len(raw) % kind.itemsize:
        raise RuntimeError(f"shard {shard} is cut short")
    every = np.frombuffer(raw, kind)
    for a in range(0, len(every), 4096):
        r = every[a : a + 4096]
        n = r["n"].astype(np.int64)
        ids = [i[: 2 * m] for i, m in zip(map(bytes, np.ascontiguousarray(r["ids"]).view("u1")), n.tolist())]
        at = first + a + np.arange(len(r))
        doc = pa.array(r["doc_id"].copy(), pa.int64(), mask=r["doc_id"] == NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(base + at), pa.array(np.full(len(r), shard, np.int32)), pa.array(at * kind.itemsize), doc, pa.array(r["seq"].astype(np.int64)), pa.array(n), pa.array(list(map(zlib.crc32, ids)), pa.int64()), pa.array(ids, pa.binary())], ["slot", "shard", "byte_offset", "doc_id", "seq", "n_tokens", "ids_crc32", "ids"])


def read_shards(spark: SparkSession, path: str, length: int = LENGTH) -> DataFrame:
    """What the shards hold: (slot, shard, byte_offset, doc_id, seq, n_tokens, ids_crc32, ids)."""
    return read_from(spark, path, 0, length)


def read_from(spark: SparkSession, path: str, slot: int, length: int = LENGTH) -> DataFrame:
    """read_shards() from a slot on, as training does that goes on after a stop: what is before it is not read. Shards are read by ranges of records."""
    step = max(1, RANGE_BYTES // record(length).itemsize)
    later = [(k, p, base, max(0, slot - base), n) for k, p, base, n in shard_files(spark, path, length) if base + n > slot]
    if not later:
        return spark.createDataFrame([], READ)
    shards = spark.createDataFrame(later, "k int, path string, base long, first long, n long")
    ranges = shards.select("k", "path", "base", "n", F.explode(F.sequence("first", F.col("n") - 1, F.lit(step))).alias("a"))
    ranges = ranges.repartitionByRange(max(1, min(10_000, sum(-(-(n - first) // step) for *_, first, n in later))), "k", "a")
    size = record(length).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for r in x.to_pylist():
                m = min(step, r["n"] - r["a"])
                yield from rows_of(_bytes_of(r["path"], r["a"] * size, m * size), r["base"], r["k"], r["a"], length)

    return arrow_map(ranges, run, READ)


def training_order(docs: DataFrame, key: int = 20_240_601) -> DataFrame:
    """Writes docs in training order in the shared folder and returns what is read back, without the ids."""
    spark = docs.sparkSession
    to = shared_path(spark, "shards")
    write_shards(docs, to, key)
    if docs.isEmpty():
        return spark.createDataFrame([], "slot long, shard int, byte_offset long, doc_id long, seq long, n_tokens long, ids_crc32 long")
    return read_shards(spark, to).drop("ids")
