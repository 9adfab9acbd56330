"""Running values over groups of any size, and lookups by keys of any frequency.

A window puts each group in one task, and a join puts each key there. Here rows are dealt by ranges of (group, order), so a
group with a third of all rows lies in many tasks; each task runs over its own rows, and what a group's earlier tasks have
is added from a table of one row for each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, forget, materialize, signed

#: A key with more rows than this, and than one in MOST_HOT of all rows, is hot; so there are at most MOST_HOT hot keys, which are broadcast.
HOT_ROWS, MOST_HOT = 4096, 100_000


def _running(values: np.ndarray, start: np.ndarray, add: np.ufunc, back: np.ufunc) -> np.ndarray:
    """Of values, the running result of an operation with an inverse; start: for each row the first row of its group."""
    total = add.accumulate(values)
    before = np.where(start > 0, total[start - 1], np.uint64(0))
    return back(total, before)


def running(df: DataFrame, group: list[str], order: list[Column], sums: tuple[str, ...] = (), xors: tuple[str, ...] = (), last: tuple[str, ...] = (), when: str | None = None) -> DataFrame:
    """df with, for each row of its group in the order given, run_<name> for each column of sums, xors and last.

    group: columns of longs without nulls. sums and xors: columns of longs without nulls, added up modulo 2^64 or by
    exclusive or up to the row, itself included. last: columns of longs, as they stand in the last row up to this one for
    which the boolean column `when` holds; null where there is none.
    """
    spark = df.sparkSession
    added = [f"run_{c}" for c in (*sums, *xors, *last)]
    extra = [T.StructField(c, T.LongType()) for c in added] + [T.StructField("run_part", T.IntegerType()), T.StructField("run_seq", T.LongType())]
    schema = T.StructType([*df.schema.fields, *extra])
    names = [f.name for f in schema.fields]
    ops = [(c, np.add, np.subtract) for c in sums] + [(c, np.bitwise_xor, np.bitwise_xor) for c in xors]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, key, state = TaskContext.get().partitionId(), 0, None, {}
        for x in batches:
            n = x.num_rows
            if not n:
                continue
            keys = np.stack([x.column(g).to_numpy() for g in group], 1)
            new = np.ones(n, bool)
            new[1:] = (keys[1:] != keys[:-1]).any(1)
            if tuple(keys[0]) != key:
                state = {}
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            out = []
            for c, add, back in ops:
                run = _running(x.column(c).to_numpy().view(np.uint64), start, add, back)
                run = np.where(start == 0, add(run, state.get(c, np.uint64(0))), run)
                state[c] = run[-1]
                out.append(pa.array(signed(run), pa.int64()))
            if last:
                flag = x.column(when).to_numpy(zero_copy_only=False)
                at = np.maximum.accumulate(np.where(flag, np.arange(n), -1))
                at = np.where(at >= start, at, -1)
                for c in last:
                    v = x.column(c).to_numpy()
                    held = state.get(("last", c))
                    none = (at < 0) & ((start > 0) | (held is None))
                    run = np.where(at >= 0, v[at], held if held is not None else 0)
                    out.append(pa.array(run, pa.int64(), mask=none))
                    state["last", c] = None if none[-1] else run[-1]
            key = tuple(keys[-1])
            out += [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n))]
            seq += n
            yield pa.RecordBatch.from_arrays([*x.columns, *out], names)

    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *group, *order).sortWithinPartitions(*group, *order)
    held = materialize(arrow_map(dealt, local, schema), "running")
    at = [F.col(c) for c in (*group, *added)]
    # A row for each task: the group that it begins with, and the one that it ends with and its values.
    ends = held.groupBy("run_part").agg(F.min(F.struct("run_seq", *group)).alias("a"), F.max(F.struct("run_seq", *at)).alias("z")).orderBy("run_part").collect()
    carry: dict[int, dict] = {}
    key, state = None, {}
    for r in ends:
        first, final = tuple(r["a"][g] for g in group), tuple(r["z"][g] for g in group)
        if first == key:
            carry[r["run_part"]] = {"key": key} | state
        before = state if first == key == final else {}
        key, state = final, {}
        for c, add, _ in ops:
            mine = np.array([r["z"][f"run_{c}"]], np.int64).view(np.uint64)
            state[c] = int(signed(add(mine, np.array([before.get(c, 0)], np.int64).view(np.uint64)))[0])
        for c in last:
            mine = r["z"][f"run_{c}"]
            state[c] = before.get(c) if mine is None else mine
    shared = spark.sparkContext.broadcast(carry)
    own = [c for c in names if c not in ("run_part", "run_seq")]

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            cols = {c: x.column(c) for c in own}
            part = x.column("run_part").to_numpy()
            for p in np.unique(part).tolist():
                own_carry = shared.value.get(p)
                if own_carry is None:
                    continue
                on = part == p
                for g, k in zip(group, own_carry["key"]):
                    on &= x.column(g).to_numpy() == k
                if not on.any():
                    continue
                for c, add, _ in ops:
                    v = cols[f"run_{c}"].to_numpy().view(np.uint64)
                    cols[f"run_{c}"] = pa.array(signed(np.where(on, add(v, np.array([own_carry[c]], np.int64).view(np.uint64)), v)))
                for c in last:
                    v = cols[f"run_{c}"]
                    if own_carry[c] is not None:
                        empty = v.is_null().to_numpy(zero_copy_only=False)
                        cols[f"run_{c}"] = pa.array(np.where(empty & on, own_carry[c], v.fill_null(0).to_numpy()), pa.int64(), mask=empty & ~on)
            yield pa.RecordBatch.from_arrays([cols[c] for c in own], own)

    out = arrow_map(held, carried, T.StructType([f for f in schema.fields if f.name in own]))
    out.held = held
    return out


def done(*tables: DataFrame) -> None:
    """Delete what running() has written for tables from which everything has been made."""
    forget(*(t.held for t in tables))


def lookup(rows: DataFrame, dim: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows joined with dim (inner or left), which has a row for each key of them; its column `weight` says how many rows have that key. dim: a written table.

    Hot keys are few by their definition and are broadcast, so that their rows stay where they are."""
    total = dim.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"]
    limit = max(HOT_ROWS, total // MOST_HOT)
    hot = dim.where(F.col(weight) > limit)
    if hot.isEmpty():
        return rows.join(dim, on, how)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(dim.where(F.col(weight) <= limit), on, how)
    return rows.join(F.broadcast(hot), on).unionByName(rest)
