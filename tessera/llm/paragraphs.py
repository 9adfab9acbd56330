"""Operator 1: substring dedup by paragraph MinHash banding.

Paragraphs of a document, in words: its lines of MIN_WORDS words or more; runs of shorter lines, joined until they have as
many; and, of lines longer than MAX_WORDS, the parts between such sentence ends as a hash of their last word picks, one in
PART_ENDS, so that equal passages are cut alike. A paragraph's set holds its distinct five-word shingles. Paragraphs with
equal sets are one class, found by a print of the set. The others are banded: BANDS bands of BAND_ROWS minimum hashes find
pairs of similarity 0.75 with probability 1 - (1 - 0.75^2)^6 = 0.993. A sketch of SKETCH_BITS parities for each set says
which pairs may link: sketches differ in no more bits than the sets in shingles, so no pair that links is dropped. Every class
is first paired with the nearest hub of its bands; pairs are verified by their exact Jaccard similarity, and what links gives
components. Rounds of neighbours follow in bands of more than DENSE paragraphs: a band is sorted by its sketches, from another word of theirs each round, and a
paragraph is paired with the nearest of another component among the NEXT before and after it; so components that belong together
come together by few pairs, however many near copies there are. Then all pairs of a band that still lie in different components
and may link are verified, so that none that shares a band is missed: each paragraph's nearest pair first, then the rest.

As shared passages begin and end anywhere, there are windows of WINDOW words as well, which count as equal or not; a bitmap of
prints seen twice, of bounded size, keeps nearly all others out of what is written and shuffled. Of every
REACH successive starts the one with the smallest hash has a window, so a passage of WINDOW + REACH - 1 = 51 words or more
that stands in two documents has a window in common at least, wherever it begins.

Of a cluster the occurrence with the smallest (doc_id, first word) is kept; the others are removals. Only clusters over two
documents or more count.

Nulls: null texts and those with fewer than MIN_WORDS words have no paragraphs; rows with a null doc_id are ignored. Rows
that repeat a doc_id are one document. Ties of hashes go to the later start. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import JACCARD_DEN, JACCARD_NUM, arrow_map, connected_components, forget, linked, materialize, mix, sieve, signed, sized

MIN_WORDS, MAX_WORDS, PART_ENDS = 30, 96, 4
WINDOW, REACH = 34, 18
BANDS, BAND_ROWS = 6, 2
_TURNS = (mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)).tolist()
#: Classes of a band that one task pairs with all others of it; a band of more is dealt to several.
SALTED = 128
#: Bands of so many classes or fewer have no rounds of neighbours: all of their pairs are DENSE / 2 for each of their rows at most.
DENSE = 32
TURNS = 3  # rounds of neighbours
NEXT = 8  # paragraphs after one, in the order of sketches, that are tried as neighbours
TURN = 0x2545F4914F6CDD1D  # turns prints so that another of them is the smallest
SKETCH_BITS = 256
SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]
UNITS = "doc_id long, is_paragraph boolean, first_word int, n_words int, n int, fp long, bands array<long>, sketch array<long>"


def paragraphs(h: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends (exclusive) of a text's paragraphs."""
    n = len(h)
    ends = np.flatnonzero(stops & 2) + 1
    ends = np.concatenate([ends, [n]]) if not len(ends) or ends[-1] < n else ends
    starts = np.concatenate([[0], ends[:-1]])
    size = ends - starts
    found = [np.stack([starts, ends])[:, size >= MIN_WORDS]]
    # Runs of short lines.
    first, joined = -1, []
    for a, b, k in zip(starts.tolist(), ends.tolist(), size.tolist()):
        if k >= MIN_WORDS:
            first = -1
        else:
            first = a if first < 0 else first
            if b - first >= MIN_WORDS:
                joined.append((first, b))
                first = -1
    if joined:
        found.append(np.array(joined).T)
    # Parts of long lines.
    if (size > MAX_WORDS).any():
        last = mix(h[(ends_of := np.flatnonzero(stops > 0) + 1) - 1] + np.uint64(7))
        picked = ends_of[last % np.uint64(PART_ENDS) == 0]
        for a, b in zip(starts[size > MAX_WORDS].tolist(), ends[size > MAX_WORDS].tolist()):
            cut = np.concatenate([[a], picked[(picked > a) & (picked < b)], [b]])
            part = np.stack([cut[:-1], cut[1:]])
            found.append(part[:, (part[1] - part[0] >= MIN_WORDS) & (part[1] - part[0] < b - a)])
    return tuple(np.concatenate(found, 1))


def windows(every: np.ndarray, n: int) -> np.ndarray:
    """First words of the windows of a text of n words: of each REACH successive starts the one with the smallest hash."""
    starts = n - WINDOW + 1
    if starts < 1:
        return np.zeros(0, np.int64)
    g = mix(every[:starts] + np.uint64(0x5851F42D4C957F2D))[::-1]
    reach = min(REACH, starts)
    best = np.lib.stride_tricks.sliding_window_view(g, reach).argmin(1) + np.arange(starts - reach + 1)
    return np.unique(starts - 1 - best)


class Sets:
    """The distinct shingles of runs of shingles, all together: of run i, values[edges[i] : edges[i + 1]], in order."""

    def __init__(self, every: np.ndarray, s: np.ndarray, e: np.ndarray):
        n = e - s
        of = np.repeat(np.arange(len(s)), n)
        at = np.arange(len(of)) + np.repeat(s - (np.cumsum(n) - n), n)
        v = every[at]
        turn = np.lexsort((v, of))
        v, of = v[turn], of[turn]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (of[1:] != of[:-1])
        self.values, self.of = v[new], of[new]
        self.edges = np.searchsorted(self.of, np.arange(len(s) + 1))
        self.n = np.diff(self.edges)

    def prints(self) -> np.ndarray:
        """A print of each set; that of a run without repeats is the same sum."""
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(self.values))])
        return mix((total[self.edges[1:]] - total[self.edges[:-1]]) ^ self.n.astype(np.uint64))

    def bands(self) -> np.ndarray:
        low = np.stack([np.minimum.reduceat(self.values * np.uint64(t), self.edges[:-1]) for t in _TURNS], 1)
        return mix(low[:, 0::BAND_ROWS] + mix(low[:, 1::BAND_ROWS]) + np.arange(BANDS, dtype=np.uint64))

    def sketches(self) -> np.ndarray:
        """For each set and each of SKETCH_BITS places, whether an odd number of the shingles falls there."""
        at = self.of * SKETCH_BITS + (self.values % np.uint64(SKETCH_BITS)).astype(np.int64)
        odd = np.bincount(at, minlength=len(self.n) * SKETCH_BITS) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(self.n), -1)


def mixed(every: np.ndarray) -> np.ndarray:
    return mix(every ^ np.uint64(0x2545F4914F6CDD1D))


def _lists(rows: np.ndarray, empty: int) -> pa.Array:
    """A list for each row, and as many nulls after them."""
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
    return pa.concat_arrays([lists, pa.nulls(empty, lists.type)])


def _window_prints(every: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Prints of the windows that begin at shingles start; that of a set without repeats is the same sum."""
    size = WINDOW - common.SHINGLE_WORDS + 1
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(every))])
    return mix((total[start + size] - total[start]) ^ np.uint64(size))


def _all_windows(x: pa.RecordBatch) -> np.ndarray:
    """The prints of all windows of a batch (doc_id, text)."""
    texts, out = x.column(1).to_pylist(), [np.zeros(0, np.uint64)]
    for lo, hi in common.buffers(texts):
        h, _, at = common.word_hashes(texts[lo:hi])[:3]
        every = common.shingle_all(h)
        starts = [windows(every[p:q], q - p) + p for p, q in zip(at[:-1], at[1:]) if q - p >= WINDOW]
        if starts:
            out.append(_window_prints(every, np.concatenate(starts)))
    return np.concatenate(out)


def _units(batches: Iterator[pa.RecordBatch], twice: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Paragraphs, and the windows that may have an equal one."""
    end = common.SHINGLE_WORDS - 1  # shingles s .. e - end - 1 are those of words s .. e - 1
    for x in batches:
        ids, texts = x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_pylist()
        for lo, hi in common.buffers(texts):
            h, stops, at = common.word_hashes(texts[lo:hi])[:3]
            every = common.shingle_all(h)
            found: list[tuple] = []  # of each document its number, first word, first words and ends of paragraphs, first words of windows
            for i, p, q in zip(range(lo, hi), at[:-1], at[1:]):
                if q - p >= MIN_WORDS:
                    found.append((i, p, *paragraphs(h[p:q], stops[p:q]), windows(every[p:q], q - p)))
            if not found:
                continue
            docs, first = np.array([f[0] for f in found]), np.array([f[1] for f in found])
            of_p, of_w = np.repeat(np.arange(len(found)), [len(f[2]) for f in found]), np.repeat(np.arange(len(found)), [len(f[4]) for f in found])
            a, b, w = (np.concatenate([f[k] for f in found]) for k in (2, 3, 4))
            s, e = a + first[of_p], b + first[of_p]
            own = Sets(every, s, e - end)
            fp_w = _window_prints(every, w + first[of_w])
            may = common.twice_among(fp_w, twice)
            fp_w, w, of_w, size = fp_w[may], w[may], of_w[may], WINDOW - end
            of = np.concatenate([of_p, of_w])
            is_paragraph = np.arange(len(of)) < len(a)
            n_words = np.concatenate([b - a, np.full(len(w), WINDOW)])
            n = np.concatenate([own.n, np.full(len(w), size)])
            none = len(a) == 0
            lists = [pa.nulls(len(of), pa.list_(pa.int64()))] * 2 if none else [_lists(signed(own.bands()), len(w)), _lists(own.sketches(), len(w))]
            prints = np.concatenate([own.prints() if not none else np.zeros(0, np.uint64), fp_w])
            yield pa.RecordBatch.from_arrays([pa.array(ids[docs[of]], pa.int64()), pa.array(is_paragraph), pa.array(np.concatenate([a, w]).astype(np.int32)), pa.array(n_words.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(signed(prints)), *lists], ["doc_id", "is_paragraph", "first_word", "n_words", "n", "fp", "bands", "sketch"])


def _sets(texts: list[str | None], flags: np.ndarray, bits: int) -> pa.RecordBatch:
    """The sets of those paragraphs of texts whose prints a bitmap marks."""
    fps, parts = [np.zeros(0, np.uint64)], []
    for lo, hi in common.buffers(texts):
        h, stops, at = common.word_hashes(texts[lo:hi])[:3]
        spans = [np.stack(paragraphs(h[p:q], stops[p:q])) + p for p, q in zip(at[:-1], at[1:]) if q - p >= MIN_WORDS]
        if spans and (s := np.concatenate(spans, 1)).size:
            own = Sets(common.shingle_all(h), s[0], s[1] - common.SHINGLE_WORDS + 1)
            prints = own.prints()
            place = (prints & np.uint64(bits - 1)).astype(np.int64)
            at = np.where(place > 0, place + 32767, 0)  # how Spark's bitmap functions number buckets and bits
            keep = np.flatnonzero(flags.ravel()[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            fps.append(prints[keep])
            parts += [signed(own.values[own.edges[k] : own.edges[k + 1]]) for k in keep]
    return pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(fps))), pa.array(parts, pa.list_(pa.int64()))], ["fp", "part"])


def stored_sets(fps: DataFrame, lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(fp, f, part), a written table: the sets of the paragraphs with the prints fps, made once from their texts; f is 0."""
    ids = materialize(fps.join(lines.select("fp", "doc_id"), "fp"), "needed")
    bits = common.need_bits(ids.count())
    place = F.col("fp").bitwiseAND(F.lit(bits - 1))
    asked_for = docs.sparkSession.sparkContext.broadcast(common.marked(ids, bits, place))
    rows, asked = sieve(docs, ids, lambda _, texts: _sets(texts, asked_for.value, bits), "fp long, part array<long>")
    sets = rows.join(ids.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])
    sets = materialize(sets.select("fp", F.lit(0).alias("f"), "part"), "sets")
    asked.destroy()
    asked_for.destroy()
    forget(ids, clean=True)
    return sets


class Sought:
    """The sets of paragraphs that pairs have asked for so far, each made once: written tables."""

    def __init__(self, lines: DataFrame, docs: DataFrame):
        self.lines, self.docs, self.tables = lines, docs, []

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of pairs (a, na, b, nb) of paragraphs, a written table, that link; a written table."""
        need = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
        new = need
        for t in self.tables:
            new = new.join(t.select("fp"), "fp", "left_anti")
        new = materialize(new, "sought")
        if not new.isEmpty():
            self.tables.append(stored_sets(new, self.lines, self.docs))
        forget(new)
        sets = reduce(DataFrame.union, self.tables) if self.tables else self.docs.sparkSession.createDataFrame([], "fp long, f int, part array<long>")
        out = materialize(linked(pairs, sets.join(need, "fp", "left_semi"), 1), "linked")
        return out


def apart() -> Column:
    """In how many bits the sketches of x and y differ."""
    return sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in SKETCH), F.lit(0))


def may_link() -> Column:
    """Whether sizes and sketches of x and y allow a link."""
    return sized(F.col("x.n"), F.col("y.n")) & (apart() * (JACCARD_DEN + JACCARD_NUM) <= (F.col("x.n") + F.col("y.n")) * (JACCARD_DEN - JACCARD_NUM))


def pair() -> list[Column]:
    return [F.col("x.fp").alias("a"), F.col("x.n").alias("na"), F.col("y.fp").alias("b"), F.col("y.n").alias("nb"), apart().alias("apart")]


def sketched(lines: DataFrame) -> DataFrame:
    return lines.select("fp", "n", *(F.col("sketch")[k].alias(c) for k, c in enumerate(SKETCH)), *(F.col("bands")[k].alias(f"b{k}") for k in range(BANDS)))


def shared_bands(lines: DataFrame) -> DataFrame:
    """(band, k, fp), a written table: the bands of lines in which two classes or more meet; k: which of the class's bands it is. Most bands have
    one class, so they are all shuffled here once and what follows handles few."""
    own = lines.select("fp", F.posexplode("bands").alias("k", "band"))
    many = own.withColumn("c", F.count("*").over(Window.partitionBy("band"))).where("c > 1")
    return materialize(many.select("band", "k", "fp"), "bands")


def stars(bands: DataFrame, lines: DataFrame) -> DataFrame:
    """(a, na, b, nb): each class with the nearest of its bands' hubs that sizes and sketches allow. A band's hubs are three of its classes,
    the smallest and the largest print and one between, so there are a few pairs for each class at most."""
    turn = F.lit(TURN)
    hubs = bands.groupBy("band").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.min(F.col("fp").bitwiseXOR(turn)).bitwiseXOR(turn).alias("mid")).where("lo < hi")
    hubs = hubs.select("band", F.explode(F.array_distinct(F.array("lo", "mid", "hi"))).alias("hub"))
    met = bands.join(hubs, "band").where("fp <> hub").select("fp", "hub").distinct()
    own = sketched(lines)
    x, y = own.alias("x"), own.alias("y")
    near = met.join(x, met.fp == F.col("x.fp")).join(y, met.hub == F.col("y.fp")).where(may_link()).select(*pair())
    return near.groupBy("a").agg(F.min(F.struct("apart", "b", "na", "nb")).alias("p")).select("a", "p.na", "p.b", "p.nb")


def _several(rows: DataFrame) -> DataFrame:
    """rows (band, g, ...) of those bands in which several components g meet, with the number c of a band's rows."""
    many = rows.groupBy("band").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("c")).where("lo < hi")
    return rows.join(many.select("band", "c"), "band")


def crossed(bands: DataFrame, lines: DataFrame, groups: DataFrame) -> DataFrame:
    """(band, k, fp, n, g, c, sketch..., b0...), a written table: the rows of those bands (shared_bands()) in which several components (node, component)
    meet."""
    own = bands.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("band", "k", "fp", F.coalesce("component", "fp").alias("g"))
    first = materialize(own, "bands")
    out = materialize(_several(first).join(sketched(lines), "fp"), "crossed")
    forget(first, clean=True)
    return out


def still_crossed(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """What is left of crossed() when components have come together as joined (node, component) says; a band without several stays without."""
    own = rows.drop("c").join(joined.withColumnRenamed("node", "g"), "g", "left").withColumn("g", F.coalesce("component", "g")).drop("component")
    out = materialize(_several(own), "crossed")
    forget(rows)
    return out


def between_components(links: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, component) of the components of rows that links (a, b) bring together; a written table."""
    of = rows.select("fp", "g").distinct()
    ends = links.join(of.select(F.col("fp").alias("a"), F.col("g").alias("ga")), "a").join(of.select(F.col("fp").alias("b"), F.col("g").alias("gb")), "b")
    return connected_components(ends, "ga", "gb")


def neighbours(rows: DataFrame, turn: int) -> DataFrame:
    """(a, na, b, nb), a written table: each paragraph of crossed() with the nearest one of another component among the NEXT before and after it, where
    a band is sorted by sketch, from its word `turn` on. Bands are dealt by ranges, so that large ones lie in many tasks."""
    words = [*SKETCH[turn:], *SKETCH[:turn]]
    dealt = rows.select("band", "fp", "n", "g", *SKETCH).repartitionByRange("band", *words).sortWithinPartitions("band", *words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for x in batches:
            now = np.stack([x.column(c).to_numpy() for c in ("band", "fp", "n", "g", *SKETCH)], 1)
            v = now if held is None else np.concatenate([held, now])
            held = v[-NEXT:]
            best, mate = np.full(len(v), 1 << 20), np.zeros(len(v), np.int64)
            for step in range(1, min(NEXT, len(v) - 1) + 1):
                a, b = v[:-step], v[step:]
                bits = np.bitwise_count((a[:, 4:] ^ b[:, 4:]).view(np.uint64)).sum(1, dtype=np.int64)
                n = a[:, 2] + b[:, 2]
                ok = (a[:, 0] == b[:, 0]) & (a[:, 3] != b[:, 3]) & (bits * (JACCARD_DEN + JACCARD_NUM) <= n * (JACCARD_DEN - JACCARD_NUM))
                ok &= np.minimum(a[:, 2], b[:, 2]) * JACCARD_DEN >= np.maximum(a[:, 2], b[:, 2]) * JACCARD_NUM
                bits = np.where(ok, bits, 1 << 20)
                for mine, other in ((np.arange(len(a)), step), (np.arange(len(a)) + step, -step)):
                    nearer = bits < best[mine]
                    best[mine[nearer]], mate[mine[nearer]] = bits[nearer], mine[nearer] + other
            at = np.flatnonzero(best < 1 << 20)
            p, q = v[at], v[mate[at]]
            swap = p[:, 1] > q[:, 1]
            p, q = np.where(swap[:, None], q, p), np.where(swap[:, None], p, q)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (p[:, 1], p[:, 2], q[:, 1], q[:, 2], best[at])], ["a", "na", "b", "nb", "apart"])

    found = arrow_map(dealt, run, "a long, na long, b long, nb long, apart long")
    return materialize(nearest(found), "pairs")


def rounds(rows: DataFrame, sets: Sought) -> list[DataFrame]:
    """The links (a, b) that rounds of neighbours find in those bands of crossed() that have more than DENSE rows; written tables. What other bands
    link is left to between()."""
    found = []
    dense = materialize(rows.where(F.col("c") > DENSE), "dense")
    for turn in range(TURNS):
        if dense.isEmpty():
            break
        near = neighbours(dense, turn)
        found.append(sets.verified(near))
        joined = between_components(found[-1], dense)
        dense = still_crossed(dense, joined)
        forget(near, joined)
    forget(dense)
    return found


def between(rows: DataFrame) -> DataFrame:
    """(a, na, b, nb, apart), a written table: the pairs of a band of crossed() in different components whose sizes and sketches allow a link, each once,
    in the first band that it shares. Large bands are dealt to as many tasks as their rows ask for."""
    rows = rows.withColumn("salts", F.expr(f"cast(c div {SALTED} + 1 as int)"))
    x = rows.withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")).alias("x")
    y = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("y")
    first = [(F.col("x.k") <= i) | (F.col(f"x.b{i}") != F.col(f"y.b{i}")) for i in range(BANDS - 1)]
    met = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.fp") < F.col("y.fp")) & (F.col("x.g") != F.col("y.g")) & may_link() & reduce(Column.__and__, first))
    return materialize(met.select(*pair()), "met")


def nearest(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, na, b, nb, apart), each end's pair with the fewest bits apart."""
    own = F.struct("apart", "a", "na", "b", "nb")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("end"), own.alias("p"))
    return ends.groupBy("end").agg(F.min("p").alias("p")).select("p.a", "p.na", "p.b", "p.nb").distinct()


def still_apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, na, b, nb) of pairs whose ends lie in different components (node, component)."""
    of = lambda end, name: groups.select(F.col("node").alias(end), F.col("component").alias(name))
    both = pairs.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left")
    return both.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "na", "b", "nb")


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, is_paragraph, first_word, n_words, cluster_id, n_occurrences, kept): paragraphs and windows that occur in two documents or more.

    cluster_id is the print of one of the cluster's classes; n_occurrences counts the paragraph's own class, which is 1
    where it is linked by similarity alone.
    """
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # About a window for each half of REACH words, and a word for six characters.
    chars = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    twice = docs.sparkSession.sparkContext.broadcast(common.taken_twice(own, _all_windows, chars // (3 * REACH)))
    units = materialize(arrow_map(own, lambda batches: _units(batches, twice.value), UNITS), "units")
    twice.destroy()
    # Numbers alone, so that they are aggregated by hashing; where a class begins is asked of the few that are in a cluster.
    classes = units.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n_occurrences"))

    # Paragraphs that are not equal but share a band.
    lines = units.where("is_paragraph").groupBy("fp", "n").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    lines = materialize(lines, "lines")
    bands = shared_bands(lines)
    near = materialize(stars(bands, lines), "pairs")
    sets = Sought(lines, docs)
    links = sets.verified(near)
    groups = connected_components(links)
    forget(near)
    rows = crossed(bands, lines, groups)
    forget(bands, groups)
    # Where bands are large, what joins most components with few pairs comes first: near ones in the order of the sketches, from each of their words on.
    found = rounds(rows, sets)
    if found:
        more = reduce(DataFrame.union, found)
        joined = between_components(more, rows)
        rows = still_crossed(rows, joined)
        links = links.union(more)
        forget(joined)
    # Then all pairs that the bands still allow between components: each paragraph's nearest first, then those whose ends are apart even so.
    met = between(rows)
    first = materialize(nearest(met), "pairs")
    more = sets.verified(first)
    links = links.union(more)
    joined = between_components(more, rows)
    of = materialize(rows.select(F.col("fp").alias("node"), "g").distinct().join(joined.withColumnRenamed("node", "g"), "g", "left").select("node", F.coalesce("component", "g").alias("component")), "groups")
    rest = materialize(still_apart(met, of), "pairs")
    forget(first, met, joined, of, rows)
    links = links.union(sets.verified(rest))
    groups = connected_components(links).withColumnRenamed("node", "fp")

    member = classes.join(groups, "fp", "left").where("lo < hi or component is not null").select("fp", "n_occurrences", (F.col("lo") < F.col("hi")).alias("shared"), F.coalesce("component", "fp").alias("cluster_id"))
    found = materialize(units.join(member, "fp").select("doc_id", "is_paragraph", "first_word", "n_words", "cluster_id", "n_occurrences", "shared"), "found")
    forget(rest, lines, units, *sets.tables)
    place = F.struct("doc_id", "first_word", "is_paragraph")
    clusters = found.groupBy("cluster_id").agg(F.min(place).alias("keeper"), F.max("doc_id").alias("last"), F.bool_or("shared").alias("shared"))
    clusters = clusters.where("shared or keeper.doc_id < last").select("cluster_id", "keeper")
    out = found.join(clusters, "cluster_id")
    return out.select("doc_id", "is_paragraph", "first_word", "n_words", "cluster_id", "n_occurrences", (place == F.col("keeper")).alias("kept"))


def removals(docs: DataFrame) -> DataFrame:
    """The paragraphs to take out: repeated() without one kept occurrence of each cluster."""
    return repeated(docs).where("not kept").drop("kept")
