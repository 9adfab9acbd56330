"""Operator 8: chat formatting of reply trees.

Messages are nodes (conv_id, node, parent, role, text, score); a null parent marks a root. Iterative self-joins double
each node's pointer towards its root (ids, depths and scores alone; texts stay behind), so depth d takes log2(d) joins.
Leaves are ranked by the score summed over their path, then by depth and by the smaller node; for the best leaf of each
conversation the same pointers, taken downwards, list the nodes of its path. Each chosen path is formatted as one
conversation: turns are marked, control strings within texts are escaped so that they can be read back exactly, and the
assistant's texts are the spans of the loss mask.

Nulls: a null text or role is empty; rows with a null conv_id form one conversation of that id; a row with a null node takes
no part; a node whose parent is missing is a root. Where replies form a cycle, its smallest node counts as a root, so
every node has a path. Of rows that repeat a node, the one counts that is first by parent (null first), score (largest
first), role and text. Rows of a conversation table that repeat a turn follow one another, by role and text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize

#: The template's own marks; none can occur in an escaped text, as that holds no "<", "[" or "|".
BEGIN, MIDDLE, END = "<|turn|>", "<|says|>", "<|end|>\n"
_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "|": "\\p"}
_BACK = {v: k for k, v in _ESCAPES.items()}
_OUT = re.compile(r"[\\<\[|]")
_IN = re.compile(r"\\[\\lbp]")
_TURN = re.compile(re.escape(BEGIN) + r"([^<]*)" + re.escape(MIDDLE) + r"([^<]*)" + re.escape(END))
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _OUT.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _IN.sub(lambda m: _BACK[m[0]], text)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """One conversation's string, and the spans of it that count for the loss."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head, body = BEGIN + escape(role) + MIDDLE, escape(text)
        if role == LOSS_ROLE:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), mask


def parsed(text: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def chain(conversations: DataFrame) -> DataFrame:
    """A table of turns as reply trees: each row replies to the one before it in its conversation. node: (turn, role, text hash, count)."""
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text_hash")
    ids = c.withColumn("text_hash", F.xxhash64("text")).withColumn("node", F.row_number().over(w).cast("long"))
    return ids.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _key(conv_id: Column) -> Column:
    """A conversation's key as text: null and the empty text are two."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("null"))


def _order() -> Column:
    """What decides between rows of one node."""
    return F.struct(F.col("parent"), (-F.coalesce(F.col("score"), F.lit(0.0)).cast("double")).alias("minus_score"))


def _jumps(m: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Pointers of 1, 2, 4, ... steps up, (c, node, total, depth) of all nodes that come to a root, and what is still going after more steps than there are nodes.

    m: (c, node, parent, score), a node once. Each row still going has low, the smallest node on the steps that it has taken.
    """
    most = m.groupBy("c").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    known = m.select("c", F.col("node").alias("parent"), F.lit(True).alias("known"))
    now = m.join(known, ["c", "parent"], "left").select("c", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"), F.col("node").alias("low"))
    jumps, done = [], None
    for _ in range(most.bit_length() + 1):
        now = materialize(now, "jumps")
        at_root = now.where("up is null").select("c", "node", "total", "depth")
        done = at_root if done is None else done.union(at_root)
        going = now.where("up is not null")
        jumps.append(going.select("c", "node", "up"))
        if going.isEmpty():
            break
        # Only nodes still on their way are joined; where one's pointer leads, the sums up to the root or as far as known stand.
        none = F.lit(None).cast("long")
        far = going.select("c", "node", "up", "total", "depth", "low").union(done.select("c", "node", none, "total", "depth", "node"))
        far = far.select("c", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"), F.col("low").alias("low2"))
        now = going.join(far, ["c", "up"]).select("c", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth"), F.least("low", "low2").alias("low"))
    return jumps, done, going.select("c", "node", "up", "low")


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(c, node, branch, place): the nodes of the best root-to-leaf paths of each conversation, branches counted from 1, places from the leaf.

    Every pointer step doubles, so the rounds are the logarithm of the largest conversation at most, and cycles end too.
    """
    m = messages.where("node is not null").select(_key(F.col("conv_id")).alias("c"), F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), "score")
    m = m.groupBy("c", "node").agg(F.min(_order()).alias("o")).select("c", "node", "o.parent", (-F.col("o.minus_score")).alias("score"))
    m = materialize(m, "nodes")
    jumps, now, lost = _jumps(m)
    if not lost.isEmpty():
        # After more steps than nodes, pointers stand on cycles. A cycle's smallest node becomes a root.
        roots = lost.join(lost.select("c", F.col("up").alias("node")).distinct(), ["c", "node"]).where("low = node").select("c", "node", F.lit(True).alias("is_root"))
        m = materialize(m.join(roots, ["c", "node"], "left").select("c", "node", F.when(F.col("is_root").isNull(), F.col("parent")).alias("parent"), "score"), "nodes")
        jumps, now, _ = _jumps(m)
    leaves = m.join(m.select("c", F.col("parent").alias("node")).where("node is not null").distinct(), ["c", "node"], "left_anti").select("c", "node")
    w = Window.partitionBy("c").orderBy(F.desc("total"), F.desc("depth"), "node")
    best = leaves.join(now, ["c", "node"]).withColumn("branch", F.row_number().over(w)).where(F.col("branch") <= branches)
    path = best.select("c", "node", "branch", F.lit(0).cast("long").alias("place"))
    for k in reversed(range(len(jumps) - 1)):
        higher = path.join(jumps[k], ["c", "node"]).select("c", F.col("up").alias("node"), "branch", (F.col("place") + (1 << k)).alias("place"))
        path = path.union(higher)
        if k % 3 == 0:
            path = materialize(path, "paths")
    return path


def conversations_as_text(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, branch, formatted, loss): the best paths of each conversation; loss: an array of (start, end) code points."""
    path = best_paths(messages, branches).withColumnRenamed("node", "n")
    own = messages.select("conv_id", "role", "text", _key(F.col("conv_id")).alias("c_key"), _order().alias("c_order"), F.col("node").cast("long").alias("c_node"))
    turn = F.struct((-F.col("place")).alias("o"), F.col("c_order").alias("d"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    turns = own.join(path, (F.col("c_key") == path.c) & (F.col("c_node") == path.n)).select("conv_id", "branch", turn)
    grouped = turns.groupBy("conv_id", "branch").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # Of rows that repeat a node, the first.
    grouped = grouped.select("conv_id", "branch", F.filter("turns", lambda t, i: (i == 0) | (t["o"] != F.get("turns", F.greatest(i - 1, F.lit(0)))["o"])).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            done = [formatted([(t["role"], t["text"]) for t in own]) for own in x.column(2).to_pylist()]
            loss = pa.array([[{"start": a, "end": b} for a, b in d[1]] for d in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array([d[0] for d in done], pa.string()), loss], ["conv_id", "branch", "formatted", "loss"])

    return arrow_map(grouped, run, f"conv_id {messages.schema['conv_id'].dataType.simpleString()}, branch int, formatted string, loss array<struct<start:long,end:long>>")


def digests(texts: DataFrame) -> DataFrame:
    """What the output says, read back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            texts, masks = x.column("formatted").to_pylist(), x.column("loss").to_pylist()
            turns = [parsed(t) for t in texts]
            loss = ["".join(unescape(t[s["start"] : s["end"]]) for s in m) for t, m in zip(texts, masks)]
            sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
            out = [[len(t) for t in turns], [sha("".join(f"{r}\n{s}\n" for r, s in t)) for t in turns], [len(s) for s in loss], [sha(s) for s in loss], [len(t) for t in texts]]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([x.column(0), *(pa.array(v, k) for v, k in zip(out, kinds))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return arrow_map(texts, run, f"conv_id {texts.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def planted(spark) -> DataFrame:
    """Conversation -7 of the contract: its texts are control strings of another template."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, LOSS_ROLE, text)], "conv_id long, turn long, role string, text string")


ORACLE = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, replace(replace(replace(replace(text, '\', '\\'), '<', '\l'), '[', '\b'), '|', '\p') as t, replace(replace(replace(replace(role, '\', '\\'), '<', '\l'), '[', '\b'), '|', '\p') as r from c)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(8 + length(r) + 8 + length(t) + 8)::bigint as formatted_chars
from e group by conv_id"""
