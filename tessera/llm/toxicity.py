"""Operator 9: toxicity by a factorization machine over hashed terms.

A document's features are the distinct hashes of its words and of their leading 4 and 6 bytes (so that families of
words share what is learned). A factorization machine of second order (Rendle, 2010) learns a weight and a vector of
RANK numbers for each feature; the products of the vectors score pairs of features, such as an insult with a group.

Fitting takes at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled rows, those with the smallest hashes of their ids, whose
crc32(doc_id as text) mod 3 is not 1. Labels are counted first, so that only about as many as are wanted leave the
partitions. The sample's features are collected in the driver, the one bounded gathering here.
Scoring is a map over the documents, without a shuffle, and takes nothing but the text.

Nulls: a null or empty text has no features and gets the machine's bias; a null doc_id is scored, is not held out and
is never learned from; null labels are ignored, repeated labels of a document count as the largest. Without labels of
both classes all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import derive, fresh, quoted, tuned

BUCKETS = 1 << 20
RANK = 8
PREFIXES = (4, 6)
MIN_DF = 20
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
EPOCHS, BATCH, RATE, PENALTY = 10, 128, 0.08, 6e-3
CALIBRATION = 6  # every sixth sampled row is kept from the fit, to turn the machine's sums into probabilities
THRESHOLD = 0.7
_APART = np.zeros(256, bool)
_APART[:0x30] = _APART[0x3A:0x41] = _APART[0x5B:0x61] = _APART[0x7B:0x80] = True


def features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The distinct hashed terms of each text, below BUCKETS."""
    for lo, hi in common.buffers(texts):
        h, _, at, *heads = common.word_hashes(texts[lo:hi], _APART, PREFIXES)
        every = np.stack([h, *heads])
        hashed = (every % np.uint64(BUCKETS)).astype(np.int32)
        hashed[every == 0] = -1
        for a, b in zip(at[:-1], at[1:]):
            x = common.distinct(hashed[:, a:b].ravel())
            yield x[1:] if len(x) and x[0] < 0 else x


class Machine:
    """Weights for the features that enough training rows have; others count nothing."""

    def __init__(self, row: np.ndarray, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.row, self.bias, self.weights, self.vectors = row, bias, weights, vectors
        self.slope, self.shift = 1.0, 0.0

    def score(self, sets: Iterator[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.sums(sets) + self.shift, -30, 30)))

    def sums(self, sets: Iterator[np.ndarray]) -> np.ndarray:
        out = []
        for x in sets:
            r = self.row[x]
            r = r[r >= 0]
            v = self.vectors[r]
            total = v.sum(0)
            out.append(self.bias + self.weights[r].sum() + 0.5 * float((total * total).sum() - (v * v).sum()))
        return np.clip(np.array(out, np.float64), -30, 30)

    def calibrate(self, sums: np.ndarray, toxic: np.ndarray) -> Machine:
        """Platt's scaling: one-dimensional logistic regression, by Newton steps with a small ridge."""
        x, y, p = np.stack([sums, np.ones(len(sums))]), toxic.astype(float), np.array([1.0, 0.0])
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(p @ x, -30, 30)))
            step = np.linalg.solve((x * (q * (1 - q))) @ x.T + 0.05 * np.eye(2), x @ (q - y) + 0.05 * (p - [1, 0]))
            p = p - np.clip(step, -0.5, 0.5)
        if p[0] > 0:
            self.slope, self.shift = float(p[0]), float(p[1])
        return self


def nothing_learned() -> Machine:
    return Machine(np.full(BUCKETS, -1, np.int32), -30.0, np.zeros(0, np.float32), np.zeros((0, RANK), np.float32))


def fit(sets: list[np.ndarray], toxic: np.ndarray, seed: int = 7) -> Machine:
    """A machine fitted on most of the rows and calibrated on the others; on all where classes are few."""
    apart = np.arange(len(sets)) % CALIBRATION == 0
    if not 0 < toxic.sum() < len(toxic):
        return nothing_learned()
    if min(toxic[apart].sum(), (~toxic[apart]).sum()) < 5:
        return descend(sets, toxic, seed)
    machine = descend([x for x, a in zip(sets, apart) if not a], toxic[~apart], seed)
    return machine.calibrate(machine.sums(x for x, a in zip(sets, apart) if a), toxic[apart])


def descend(sets: list[np.ndarray], toxic: np.ndarray, seed: int) -> Machine:
    """Minibatches with AdaGrad on the logistic loss; classes are weighed alike."""
    df = np.bincount(np.concatenate(sets), minlength=BUCKETS)
    kept = np.flatnonzero(df >= min(MIN_DF, max(1, len(sets) // 50)))
    row = np.full(BUCKETS, -1, np.int32)
    row[kept] = np.arange(len(kept), dtype=np.int32)
    rows = [r[r >= 0] for r in (row[x] for x in sets)]
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(kept), np.float32), rng.normal(0, 0.01, (len(kept), RANK)).astype(np.float32)
    gw, gv = np.full(len(kept), 1e-2, np.float32), np.full((len(kept), RANK), 1e-2, np.float32)
    share = toxic.mean()
    bias, gb = float(np.log(share / (1 - share))), 1e-2
    cost = np.where(toxic, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            n = np.array([len(rows[i]) for i in batch])
            r = np.concatenate([rows[i] for i in batch])
            of = np.repeat(np.arange(len(batch)), n)
            x = v[r]
            total = np.zeros((len(batch), RANK), np.float32)
            np.add.at(total, of, x)
            z = bias + np.bincount(of, w[r], len(batch)) + 0.5 * ((total**2).sum(1) - np.bincount(of, (x**2).sum(1), len(batch)))
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[batch]) * cost[batch] / len(batch)
            u, inv = np.unique(r, return_inverse=True)
            dw = np.bincount(inv, d[of], len(u)).astype(np.float32) + PENALTY * w[u]
            dv = np.zeros((len(u), RANK), np.float32)
            np.add.at(dv, inv, (d[of, None] * (total[of] - x)).astype(np.float32))
            dv += PENALTY * v[u]
            gw[u] += dw**2
            gv[u] += dv**2
            gb += float(d.sum()) ** 2
            w[u] -= RATE * dw / np.sqrt(gw[u])
            v[u] -= 0.2 * RATE * dv / np.sqrt(gv[u])
            bias -= 0.2 * RATE * float(d.sum()) / gb**0.5
    return Machine(row, bias, w, v)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fits on the bounded sample; the features are made on the executors."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("is_toxic")).where(~held_out(F.col("doc_id")))
    there = {r["is_toxic"]: r["n"] for r in known.groupBy("is_toxic").agg(F.count("*").alias("n")).collect()}

    def smallest(kind: int, n: int) -> DataFrame:
        """The n rows of a class with the smallest hashes; a share that surely holds them is cut off before they are sorted."""
        own = known.where(F.col("is_toxic") == kind).withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
        share = (n + 6 * n**0.5 + 50) / max(1, there.get(kind, 0))
        return (own.where(F.col("h") < int(share * (1 << 40))) if share < 1 else own).orderBy("h", "doc_id").limit(n).drop("h")

    sample = smallest(1, SAMPLE_TOXIC).union(smallest(0, SAMPLE_CLEAN))
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN pairs of numbers, so the sample may be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"doc_id": x.doc_id, "is_toxic": x.is_toxic, "terms": [s.astype("<i4").tobytes() for s in features(x.text.tolist())]})

    tuned(docs.sparkSession)
    got = rows.mapInPandas(make, "doc_id long, is_toxic int, terms binary").toArrow().to_pandas().sort_values(["doc_id", "terms"]).drop_duplicates("doc_id")
    return fit([np.frombuffer(t, "<i4") for t in got.terms], got.is_toxic.to_numpy() > 0) if len(got) else nothing_learned()


def scored(docs: DataFrame, machine: Machine, keep: list[str], name: str) -> DataFrame:
    """The columns of keep and the score, in [0, 1], as a column of the name given, which keep must not have."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    return derive(docs, keep, f"{name} double", lambda texts: {name: model.value.score(features(texts))})


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs."""
    s = scored(docs, learn(docs, labels), ["doc_id"], "score")
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the machine does not reject, with their columns as they were."""
    name = fresh(docs.columns, "toxic_score")
    return scored(docs, learn(docs, labels), docs.columns, name).where(F.col(name) < THRESHOLD).select(*map(quoted, docs.columns))
