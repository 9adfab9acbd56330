"""Operator 5: best-fit packing by minimum bin slack.

Documents are token ids with an end id; those longer than a sequence are cut into pieces of its length. Lengths take at
most `size` values, so the packing is planned on their histogram alone, which does not grow with the corpus: each bin
starts with the longest length left, a bitset subset-sum over the lengths left finds the fullest feasible combination
for the rest, and that combination is taken as often as the counts allow. Every place of a combination then holds a
range of the pieces of its length, by rank; ranks are row numbers within salted blocks of a length plus the blocks'
offsets, so a length with a third of all pieces spreads over many tasks.

Nulls: a null text is empty and becomes the end id alone; a null doc_id stays. Rows that repeat are packed each for
itself. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize
from .tokens import encoder, word_bpe_path

SIZE, END_ID = 2048, 0
BLOCK = 2000  # pieces of one length that are ranked together


def pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32); crc32 of the ids as little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder(path, 4).encode(x.column(1).to_pylist())):
                ids = ids.tobytes() + END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    d = docs.select("doc_id", "text")
    return arrow_map(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def fullest(room: int, left: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of lengths with counts, longest first, the combination with the largest sum up to room, as (length, times)."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length, count in left:
        if length > room:
            continue
        before, copies, power = reach, min(count, room // length), 1
        while copies:  # powers of two stand for up to so many copies
            n = min(power, copies)
            reach |= (reach << (length * n)) & mask
            copies -= n
            power *= 2
        steps.append((length, count, before))
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for length, count, before in reversed(steps):
        n = 0
        while not before >> at & 1:  # as few copies as bring the sum within what was reached without this length
            at -= length
            n += 1
        if n:
            out.append((length, n))
    return out


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins) until every count is used up."""
    left = {k: v for k, v in sorted(counts.items(), reverse=True) if v > 0}
    out = []
    while left:
        first = next(iter(left))
        own = {first: 1}
        rest = [(k, v - (k == first)) for k, v in left.items() if v > (k == first)]
        for k, n in fullest(size - first, rest):
            own[k] = own.get(k, 0) + n
        times = min(left[k] // n for k, n in own.items())
        out.append(([k for k, n in own.items() for _ in range(n)], times))
        for k, n in own.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def places(bins: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length the ranges of ranks: columns (first rank, first sequence, offset)."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, times in bins:
        offset = 0
        for k in lengths:
            rows.setdefault(k, []).append((used.get(k, 0), sequence, offset))
            used[k] = used.get(k, 0) + times
            offset += k
        sequence += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece."""
    spark = docs.sparkSession
    own = materialize(pieces(docs, path or word_bpe_path(), size), "pieces")
    # At most `size` rows.
    counts = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(plan(counts, size)))
    many = {k: -(-n // BLOCK) for k, n in counts.items() if n > BLOCK}
    salts = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in many.items() for x in kv)), F.col("length")), F.lit(1)) if many else F.lit(1)
    salted = own.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), salts.cast("long")))
    blocks = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    w = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("n", F.row_number().over(w)).join(blocks, ["length", "salt"]).select(*own.columns, (F.col("n") - 1 + F.col("before")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            length, rank = x.column("length").to_numpy(), x.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                t, at = table.value[int(k)], np.flatnonzero(length == k)
                j = np.searchsorted(t[:, 0], rank[at], side="right") - 1
                sequence[at], offset[at] = t[j, 1] + rank[at] - t[j, 0], t[j, 2]
            yield pa.RecordBatch.from_arrays([*x.columns[:-1], pa.array(sequence), pa.array(offset)], [*x.schema.names[:-1], "sequence_id", "offset"])

    return arrow_map(ranked, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema) + ", sequence_id long, offset long")
