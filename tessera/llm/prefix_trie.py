"""Operator 11: the trie of conversation prefixes, and sums over its subtrees by heavy-path decomposition.

Turns of a conversation are ordered by turn (null first), then role, then the first 16 hex digits of their text's SHA-256.
A conversation c is rebuilt: the first h turns of conversation c - c % 100, then its own after its first h, where h is the CRC
of c's digits modulo 6 (% as in SQL: the sign of the dividend). Every distinct sequence of first turns is a node.

1. Turns are numbered, and prefixes get prints of 2 x 64 bits (an exclusive or of hashes of turn and place), by running
   values over ranges of (conversation, place); so a conversation may hold a third of all rows. Nodes are groups of prefixes.
2. Each node's heavy child is the one with most conversations (then the smallest conv_id); all other nodes are light and
   begin a path of their own. A light node has at most half of its parent's conversations, so a walk from the root meets at
   most log2(conversations) light nodes: that number is a path's level.
3. From the deepest level up: along every path of the level, values are added up from its end (running values again), and
   the sum at its top is attached to the top's parent, which lies on a path one level higher.

Null roles and texts are empty; rows with a null conv_id take no part; rows that repeat a turn, also in all columns, are turns
of their own. Conversations of which no turn is left are members of the root. Other columns are ignored. An empty table has no
members and so no root: no rows. Of 10^10 nodes, the chance that two share a print is 2 x 10^-19.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, forget, materialize
from .scans import done, lookup, running

#: Conversations share their first turns with the one whose id is a multiple of so many, up to so many turns.
FAMILY, HEAD_TURNS = 100, 6
#: Ids of conversations in a row of digested text.
CHUNK_IDS = 1 << 16
NODE = ["d", "f1", "f2"]
TRIE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered(conversations: DataFrame) -> DataFrame:
    """(c, place, h1, h2, len): the turns of each conversation, counted from 1, by prints of role and text and code points of text."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    own = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), F.substring(F.sha2(text, 256), 1, 16).alias("tie"),
        F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), role, text).alias("h2"), F.length(text).cast("long").alias("len"), F.lit(1).cast("long").alias("one"),
    )
    return running(own, ["c"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie")], sums=("one",))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, d, h1, h2, len, is_end): the turns of rebuilt conversations, and (c, total) of all conversations; both written."""
    n = turns.groupBy("c").agg(F.count("*").alias("n"))
    n = materialize(n.select("c", "n", (F.crc32(F.col("c").cast("string")) % HEAD_TURNS).alias("h"), (F.col("c") - F.col("c") % FAMILY).alias("base")), "conversations")
    head = F.least(F.col("h"), F.coalesce("base_n", F.lit(0).cast("long")))
    convs = n.join(n.select(F.col("c").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("head", head)
    convs = materialize(convs.select("c", "n", "h", "base", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "conversations")
    heads = turns.where(f"c % {FAMILY} = 0 and run_one < {HEAD_TURNS}").select(F.col("c").alias("base"), F.col("run_one").alias("d"), "h1", "h2", "len")
    first = convs.join(heads, "base").where("d <= head").select("c", "d", "h1", "h2", "len", (F.col("d") == F.col("total")).alias("is_end"))
    own = lookup(turns.select("c", "run_one", "h1", "h2", "len"), convs, ["c"], "n").where("run_one > h").withColumn("d", F.col("run_one") - F.col("h") + F.col("head"))
    rows = materialize(first.unionByName(own.select("c", "d", "h1", "h2", "len", (F.col("d") == F.col("total")).alias("is_end"))), "rebuilt")
    forget(n)
    return rows, convs


def digests(ends: DataFrame) -> DataFrame:
    """(d, f1, f2, ends_sha256) of ends (d, f1, f2, c): the SHA-256 of each node's conversations, ascending and joined by commas.

    Ids are joined in chunks where ranges of (node, c) lie, and a node's chunks are hashed one after the other, so no task holds more
    than a chunk of a node's list."""
    own = ends.select(*NODE, "c")
    dealt = own.repartitionByRange(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), *NODE, "c").sortWithinPartitions(*NODE, "c")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, key, ids = TaskContext.get().partitionId(), 0, None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(NODE, key)) | {"part": part, "seq": seq, "ids": ",".join(map(str, ids)).encode()}], pa.schema(kinds))

        kinds = [("d", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("ids", pa.binary())]
        ready: list[pa.RecordBatch] = []
        for x in batches:
            for *k, c in zip(*(col.to_pylist() for col in x.columns)):
                if k != key or len(ids) == CHUNK_IDS:
                    if ids:
                        ready.append(row())
                        seq += 1
                    key, ids = k, []
                ids.append(c)
            if ready:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready = []
        if ids:
            yield row()

    chunks = arrow_map(dealt, join, "d long, f1 long, f2 long, part int, seq long, ids binary")
    chunks = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "part", "seq")

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for x in batches:
            out: list[tuple] = []
            for *k, ids in zip(*(x.column(c).to_pylist() for c in (*NODE, "ids"))):
                if k != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids)
                else:
                    sha.update(b",")
                    sha.update(ids)
            yield _rows(out)
        if key is not None:
            yield _rows([(*key, sha.hexdigest())])

    return arrow_map(chunks, hash_all, "d long, f1 long, f2 long, ends_sha256 string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [*NODE, "ends_sha256"])


def paths(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """tree, written, with level and (t_d, t1, t2), the top of each node's heavy path.

    The nodes above a node are those of its smallest conversation's prefixes: its level is the number of light ones, and its
    path begins at the last."""
    flags = lookup(rows.select("c", *NODE), tree.select(*NODE, "conv_id", "n_convs", F.col("is_light").cast("long").alias("light"), "is_light"), NODE, "n_convs")
    up = running(flags.select("c", *NODE, "light", "is_light", (F.col("conv_id") == F.col("c")).alias("is_own")), ["c"], [F.col("d")], sums=("light",), last=tuple(NODE), when="is_light")
    zero = F.lit(0).cast("long")
    top = [F.coalesce("run_d", zero).alias("t_d"), F.coalesce("run_f1", zero).alias("t1"), F.coalesce("run_f2", zero).alias("t2")]
    below = tree.join(up.where("is_own").select(*NODE, F.col("run_light").alias("level"), *top), NODE)
    root = tree.where("d = 0").select("*", zero.alias("level"), zero.alias("t_d"), zero.alias("t1"), zero.alias("t2"))
    out = materialize(below.unionByName(root), "paths")
    done(up)
    return out


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(d, f1, f2, run_<value>...): the values of paths() summed over each node's subtree, level by level from the deepest."""
    levels = nodes.agg(F.max("level")).first()[0]
    found, attached = [], None
    for level in reversed(range(levels + 1)):
        own = nodes.where(F.col("level") == level).select(*NODE, "p1", "p2", "t_d", "t1", "t2", *values)
        if attached is not None:
            own = own.join(attached, NODE, "left").select(*NODE, "p1", "p2", "t_d", "t1", "t2", *((F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values))
        own = running(own, ["t_d", "t1", "t2"], [F.col("d").desc()], sums=tuple(values))
        found.append(own)
        tops = own.where("d = t_d and f1 = t1 and f2 = t2 and d > 0")
        attached = tops.groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(*(F.sum(f"run_{v}").alias(f"more_{v}") for v in values))
    out = materialize(reduce(DataFrame.union, (f.select(*NODE, *(f"run_{v}" for v in values)) for f in found)), "sums")
    done(*found)
    return out


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node."""
    turns = numbered(conversations)
    rebuilt_rows, convs = rebuilt(turns)
    done(turns)
    smallest = convs.agg(F.min("c")).first()[0]
    if smallest is None:
        forget(rebuilt_rows, convs)
        return conversations.sparkSession.createDataFrame([], TRIE)
    keyed = rebuilt_rows.withColumns({"f1": F.xxhash64("h1", "h2", "d"), "f2": F.xxhash64("h2", "d", "h1")}).select("c", "d", "f1", "f2", "len", "is_end")
    run = running(keyed, ["c"], [F.col("d")], xors=("f1", "f2"))
    rows = run.select("c", "d", F.col("run_f1").alias("f1"), F.col("run_f2").alias("f2"), F.col("run_f1").bitwiseXOR(F.col("f1")).alias("p1"), F.col("run_f2").bitwiseXOR(F.col("f2")).alias("p2"), "len", "is_end")
    rows = materialize(rows, "prefixes")
    done(run)
    forget(rebuilt_rows)

    zero = F.lit(0).cast("long")
    nodes = rows.groupBy(*NODE).agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("len").alias("len"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    root = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = materialize(nodes.unionByName(root.select(zero.alias("d"), zero.alias("f1"), zero.alias("f2"), "conv_id", "n_convs", zero.alias("len"), zero.alias("p1"), zero.alias("p2"))), "nodes")

    # Children by parent; the heavy one is named, so that it is found by its own key and not by its parent's, which may have many children.
    heaviest = F.max(F.struct("n_convs", (-F.col("conv_id")).alias("o"), F.col("f1").alias("h1"), F.col("f2").alias("h2"))).alias("heavy")
    kids = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count("*").alias("n_children"), heaviest)
    kids = materialize(kids.select(*NODE, "n_children", "heavy.h1", "heavy.h2"), "children")
    heavy = kids.select((F.col("d") + 1).alias("d"), F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.lit(True).alias("is_heavy"))
    tree = nodes.join(kids.select(*NODE, "n_children"), NODE, "left").join(heavy, NODE, "left")
    tree = tree.select(*NODE, "p1", "p2", "conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), (F.col("is_heavy").isNull() & (F.col("d") > 0)).alias("is_light"),
                       F.col("n_children").isNull().cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("len")).alias("tokens"))
    tree = materialize(tree, "tree")
    forget(nodes, kids)

    placed = paths(rows, tree)
    sums = subtree_sums(placed, ["leaves", "tokens"])
    ends = rows.where("is_end").select(*NODE, "c").union(convs.where("total = 0").select(zero, zero, zero, "c"))
    sha = materialize(digests(ends), "ends")

    # A parent's conv_id: those of the root's children are known, and parents of very many children are broadcast.
    parents = materialize(tree.where("d > 0 and n_children > 0").select(F.col("d").alias("q_d"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n")), "parents")
    deep = lookup(tree.where("d > 1").withColumn("q_d", F.col("d") - 1), parents, ["q_d", "p1", "p2"], "n")
    cols = [*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children"]
    top = tree.where("d <= 1").withColumn("parent_conv_id", F.when(F.col("d") == 1, F.lit(smallest).cast("long")))
    every = deep.select(*cols).unionByName(top.select(*cols))
    out = every.join(sums, NODE).join(sha, NODE, "left")
    out = out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("run_leaves").alias("n_leaves"), F.col("run_tokens").alias("saved_tokens"),
                     F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    out = materialize(out, "trie")
    forget(rows, convs, tree, placed, sums, sha, parents)
    return out


#: Prefixes are compared as they stand (hashes of turns one after the other), and each node is counted at all nodes above it.
ORACLE = r"""
with t as (select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x, row_number() over (partition by conv_id
             order by turn nulls first, coalesce(role, ''), substr(sha256(coalesce(text, '')), 1, 16)) as p from conversations where conv_id is not null),
v as (select c, count(*) as n, c - c % 100 as b, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(c::varchar, ''),
        lambda ch: [ascii(ch)::bigint, 256, 256, 256, 256, 256, 256, 256, 256]))),
        lambda a, e: case when e < 256 then xor(a, e) else xor(a >> 1, 3988292384 * (a & 1)) end), 4294967295) % 6 as h from t group by c),
w as (select v.c, v.n, v.b, v.h, least(v.h, coalesce(o.n, 0)) as head from v left join v as o on o.c = v.b),
a as (select w.c, t.p as d, r, x from w join t on t.c = w.b and t.p <= w.head union all select w.c, t.p - w.h + w.head, r, x from w join t on t.c = w.c and t.p > w.h),
k as (select c, d, length(x) as len, string_agg(sha256(length(r) || ':' || r || x), '') over (partition by c order by d) as k from a),
nodes as (select d, k, min(c) as conv_id, count(*) as n_convs, max(len) as len from k group by d, k
          union all select 0, '', min(c), count(*), 0 from w having count(*) > 0),
kids as (select d - 1 as d, substr(k, 1, 64 * (d - 1)) as k, count(*) as n from nodes where d > 0 group by all),
own as (select o.*, coalesce(kids.n, 0) as n_children from nodes as o left join kids on kids.d = o.d and kids.k = o.k),
up as (select i as d, substr(k, 1, 64 * i) as k, sum((n_children = 0)::bigint) as leaves, sum((n_convs - 1) * len) as tokens
       from (select *, unnest(range(0, d + 1)) as i from own) group by all),
ends as (select d, k, sha256(string_agg(c::varchar, ',' order by c)) as sha from
         (select w.c, coalesce(m.d, 0) as d, coalesce(m.k, '') as k from w left join (select c, max(d) as d, arg_max(k, d) as k from k group by c) as m on m.c = w.c) group by d, k)
select o.conv_id, o.d::bigint as depth, q.conv_id as parent_conv_id, o.n_convs, o.n_children, up.leaves::bigint as n_leaves, up.tokens::bigint as saved_tokens, coalesce(ends.sha, sha256('')) as ends_sha256
from own as o join up on up.d = o.d and up.k = o.k left join nodes as q on q.d = o.d - 1 and q.k = substr(o.k, 1, 64 * (o.d - 1)) left join ends on ends.d = o.d and ends.k = o.k"""
