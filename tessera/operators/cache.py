"""What models have said, kept between runs by the content that they were asked about.

A table for each kind of answer (embeddings, extractions, ...) holds (key, value, used, size): the key is a hash of the model's name
and the text, used the number of the last run that asked for it. A run looks up its keys in the buckets that can hold them,
asks the model for the others only, and publishes those, with the new use of the ones found, in one commit. Beyond max_bytes,
the keys that have not been asked for longest go. Of two runs that publish at once the second merges anew: answers to
equal questions are equal, so none can be wrong.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.store import Conflict, Revision, Store
from tessera.session import cut

TRIES = 5


def model_name(model: object) -> str:
    """A model's name: what it says itself, or its class."""
    return str(getattr(model, "name", None) or f"{type(model).__module__}.{type(model).__qualname__}")


def content_key(model: object, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model_name(model) + "\x1f"), text), 256)


@dataclass
class Kept:
    """Answers under a folder that driver and executors share."""

    spark: SparkSession
    folder: str
    max_bytes: int = 1 << 40
    buckets: int = 64

    def _store(self, kind: str) -> Store:
        return Store(self.spark, f"{self.folder.rstrip('/')}/{kind}", {"answers": "key"}, self.buckets)

    def through(self, kind: str, asked: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(key, value) for asked (key, ...), keys once each: from what is kept, and from ask(), which gives (key, value) for the rows that are not. Null
        values are not kept, so they are asked for again. A written table."""
        store, asked = self._store(kind), cut(asked)
        for left in reversed(range(TRIES)):
            state = store.state()
            run = state.get("run", 0) + 1
            known = cut(store.rows_of("answers", asked)) if "answers" in state["tables"] else None
            missing = asked if known is None else asked.join(known.select("key"), "key", "left_anti")
            made = cut(ask(missing))
            new = made.where("value is not null").select("key", "value", F.lit(run).alias("used"), F.octet_length(F.to_json(F.struct("value"))).cast("long").alias("size"))
            rows = new if known is None else new.unionByName(known.withColumn("used", F.lit(run)))
            rows = cut(rows)
            try:
                if not rows.isEmpty():
                    store.publish(state["version"], extra={"run": run}, answers=Revision(rows.select("key"), rows))
                break
            except Conflict:
                if not left:
                    raise
        self._evict(store)
        return rows.select("key", "value").unionByName(made.where("value is null").select("key", "value"))

    def _evict(self, store: Store) -> None:
        """Takes out the answers of the runs that are longest ago, until the others fit."""
        if not store.has("answers"):
            return
        total = 0
        # A row for each run that something kept was last used in.
        for r in store.read("answers").groupBy("used").agg(F.sum("size").alias("n")).orderBy(F.desc("used")).collect():
            total += r.n
            if total > self.max_bytes:
                old = store.read("answers").where(F.col("used") <= r.used)
                try:
                    store.publish(answers=Revision(cut(old.select("key")), old.limit(0)))
                except Conflict:
                    pass  # the run that came first does it
                return
