"""Operator 2: benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared with small letters and single spaces. An item of m characters may occur with up to
floor(ERROR_RATE * m) edits. It is split into one piece more than that, so one piece at least occurs unchanged: all
pieces of a block of items are sought at once by one automaton, and around every hit the item is verified by Myers'
bit-parallel distance, at any start and end within the window. Windows of an item that overlap are verified as one, so
nothing is verified twice and nothing is dropped.

Documents are only mapped: nothing is shuffled. Items travel to the tasks in blocks of at most BLOCK_CHARS characters;
a larger benchmark takes several turns.

Nulls: null or blank texts and items match nothing; items with a null id are ignored; a null doc_id stays. Items that
repeat an id are each sought, and the smallest distance is reported.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import derive, fresh, quoted

ERROR_RATE = 0.05
BLOCK_CHARS = 4_000_000
Hit = tuple[int, int, int]


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


class Pattern:
    """Myers' algorithm for one item, with the item's characters as bit masks."""

    def __init__(self, item_id: int, item: str):
        self.id, self.size, self.errors = item_id, len(item), int(len(item) * ERROR_RATE)
        self.pieces = pieces(item, self.errors)
        self.masks: dict[str, int] = {}
        for k, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << k

    def search(self, text: str) -> tuple[int, int]:
        """(smallest distance of the item to any part of the text, end of the first such part)."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score, best, end = full, 0, self.size, self.size, 0
        get = self.masks.get
        for j, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph, mh = minus | ~(xh | plus), plus & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best, end = score, j + 1
            ph, mh = ph << 1, mh << 1
            plus, minus = (mh | ~(xv | ph)) & full, ph & xv & full
        return best, end


class Finder:
    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.patterns = [Pattern(i, t) for i, t in items]
        at: dict[str, list[tuple[int, int]]] = {}
        for n, p in enumerate(self.patterns):
            for a, piece in p.pieces:
                at.setdefault(piece, []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[Hit]:
        """(item id, distance, end in the normalised text) of the items within their error budgets."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for n, offset in where:
                p = self.patterns[n]
                lo = max(0, end + 1 - size - offset - p.errors)
                hi = min(len(text), end + 1 - size - offset + p.size + p.errors)
                windows.setdefault(n, []).append([lo, hi])
        best: dict[int, tuple[int, int]] = {}
        for n, own in windows.items():
            p = self.patterns[n]
            own.sort()
            merged = [own[0]]
            for lo, hi in own[1:]:
                if lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            for lo, hi in merged:
                distance, end = p.search(text[lo:hi])
                if distance <= p.errors:
                    best[p.id] = min(best.get(p.id, (distance, lo + end)), (distance, lo + end))
        return [(i, d, e) for i, (d, e) in sorted(best.items())]


def item_blocks(benchmark: DataFrame):
    """The items, normalised, in blocks of bounded size."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-2 * size // BLOCK_CHARS)) if size > BLOCK_CHARS else 1
    for k in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = sorted({(r["item_id"], normal(r["text"])) for r in own.collect()})
        if rows := [r for r in rows if r[1]]:
            yield rows


_finders: dict[str, Finder] = {}


def finder(key: str, items: list[tuple[int, str]]) -> Finder:
    """The worker's automaton of a block of items, made once and not for every task; only the last one is kept."""
    if key not in _finders:
        _finders.clear()
        _finders[key] = Finder(items)
    return _finders[key]


def _hits(docs: DataFrame, items: list[tuple[int, str]], keep: list[str], name: str) -> DataFrame:
    block = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))

    def make(texts: list[str | None]) -> dict:
        own = finder(*block.value)
        return {name: [[{"item_id": i, "distance": d, "end": e} for i, d, e in own.find(normal(t))] for t in texts]}

    return derive(docs, keep, f"{name} array<struct<item_id:long,distance:int,end:long>>", make)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, end_char): the items found in each document; end_char in its normalised text."""
    found = [_hits(docs, items, ["doc_id"], "hits").select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.distance", F.col("h.end").alias("end_char")) for items in item_blocks(benchmark)]
    empty = docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, distance int, end_char long")
    return reduce(DataFrame.union, found) if found else empty


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those in which an item is found."""
    out, name = docs, fresh(docs.columns, "hits")
    for items in item_blocks(benchmark):
        out = _hits(out, items, out.columns, name).where(F.size(name) == 0).select(*map(quoted, docs.columns))
    return out
