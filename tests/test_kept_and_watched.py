"""Answers kept between runs, a folder's changes as a stream, calls recorded once, decisions of reconciliation."""

import random
import uuid

from pyspark.sql import functions as F

from tessera.functions import registered
from tessera.operators import cache, extract, store, sync
from tessera.plans.engine import Engine
from tessera.streaming import events, watch


class Noted(extract.HashEmbedder):
    def __init__(self, folder):
        super().__init__()
        self.folder = folder

    def embed(self, texts):
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return super().embed(texts)


class Model:
    name = "m1"

    def __init__(self, folder):
        self.folder = folder

    def chat(self, messages):
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(messages[-1]["content"])
        if "broken" in messages[-1]["content"]:
            raise ValueError("no")
        return '("entity"<|>River<|>concept<|>wide<|>1)##<|COMPLETE|>'


def test_a_second_engine_asks_no_model(spark, tmp_path):
    root, calls = tmp_path / "code", tmp_path / "calls"
    root.mkdir()
    calls.mkdir()
    (root / "a.md").write_text("# River\n\nthe river runs\n")
    kept = cache.Kept(spark, str(tmp_path / "kept"), buckets=4)
    one = Engine(spark, str(tmp_path / "s1"), embedder=Noted(str(calls)), extractor=Model(str(calls)), kept=kept)
    one.index(str(root))
    n = len(list(calls.iterdir()))
    assert n >= 3
    two = Engine(spark, str(tmp_path / "s2"), embedder=Noted(str(calls)), extractor=Model(str(calls)), kept=cache.Kept(spark, str(tmp_path / "kept"), buckets=4))
    two.index(str(root))
    assert len(list(calls.iterdir())) == n
    for t in ("points", "entity_vectors", "mentions"):
        rows = lambda e: sorted(str(r) for r in e.store.read(t).collect())  # noqa: B023, E731
        assert rows(one) == rows(two), t


def test_failures_are_asked_again_and_old_answers_go(spark, tmp_path):
    kept = cache.Kept(spark, str(tmp_path / "kept"), buckets=4)
    asked = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string")
    seen = []

    def ask(missing):
        seen.append(sorted(r.key for r in missing.collect()))
        return missing.select("key", F.when(F.col("key") != "bad", F.concat(F.lit("answer "), "key")).alias("value"))

    assert {r.key: r.value for r in kept.through("x", asked("a", "b", "bad"), ask).collect()} == {"a": "answer a", "b": "answer b", "bad": None}
    assert {r.key: r.value for r in kept.through("x", asked("b", "c", "bad"), ask).collect()} == {"b": "answer b", "c": "answer c", "bad": None}
    assert seen == [["a", "b", "bad"], ["bad", "c"]]
    small = cache.Kept(spark, str(tmp_path / "kept"), max_bytes=30, buckets=4)
    small.through("x", asked("c"), ask).collect()
    left = small._store("x").read("answers").select("key").collect()
    assert [r.key for r in left] == ["c"]
    # A writer that came between is merged with.
    other, publish = small._store("x"), store.Store.publish

    def late(self, *a, **k):
        store.Store.publish = publish
        publish(other, answers=store.Revision(asked("z"), spark.createDataFrame([("z", "answer z", 9, 1)], "key string, value string, used int, size long")))
        return publish(self, *a, **k)

    store.Store.publish = late
    try:
        kept.through("x", asked("d"), ask).collect()
    finally:
        store.Store.publish = publish
    assert {r.key for r in kept._store("x").read("answers").collect()} >= {"c", "d", "z"}


def test_extraction_is_kept_but_for_failures(spark, tmp_path):
    kept, model = cache.Kept(spark, str(tmp_path / "kept"), buckets=4), Model(str(tmp_path))
    b = spark.createDataFrame([("r", "/a", 0, [0], ["fine"]), ("r", "/b", 0, [0], ["broken"]), ("r", "/c", 0, [0], ["fine"])], "root_id string, file_path string, batch int, chunk_ids array<int>, texts array<string>")
    for _ in range(2):
        got = {r.file_path: (len(r.answers), r.error) for r in extract.answered(b, model, 0, kept).collect()}
        assert got == {"/a": (1, None), "/b": (0, "ValueError"), "/c": (1, None)}
    said = [f.read_text() for f in tmp_path.iterdir() if f.is_file()]
    assert sum("fine" in t for t in said) == 1 and sum("broken" in t for t in said) == 2 * extract.RETRIES


def changes(spark, folder, tmp_path, out):
    """One batch of changes, appended to out by its number."""
    s = spark.readStream.format("tessera_changes").option("path", str(folder)).option("state", str(tmp_path / "state")).load()
    got = []

    def flush(batch, number):
        got.append((number, sorted((r.path.rsplit("/", 1)[1], r.kind, r.moved_to and r.moved_to.rsplit("/", 1)[1]) for r in batch.collect())))
        if out == "fail":
            raise RuntimeError("stopped before the commit")

    q = s.writeStream.foreachBatch(flush).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    except Exception:
        assert out == "fail"
    return [g for g in got if g[1]]


def test_changes_of_a_folder_are_told_once(spark, tmp_path):
    spark.dataSource.register(watch.FolderChanges)
    root = tmp_path / "code"
    (root / "pkg" / "deep").mkdir(parents=True)
    (root / "_x").mkdir()
    for n in ("a.py", "pkg/b.py", "pkg/deep/c.py", "_x/.d"):
        (root / n).write_text(n)
    assert [g[1] for g in changes(spark, root, tmp_path, "")] == [[(".d", "created", None), ("a.py", "created", None), ("b.py", "created", None), ("c.py", "created", None)]]
    (root / "pkg" / "b.py").rename(root / "pkg" / "deep" / "e.py")
    (root / "a.py").write_text("longer than before")
    (root / "_x" / ".d").unlink()
    (root / "_x").rmdir()
    want = [(".d", "deleted", None), ("a.py", "modified", None), ("b.py", "moved", "e.py")]
    failed = changes(spark, root, tmp_path, "fail")
    assert [g[1] for g in failed] == [want]
    (root / "new.py").write_text("after the batch was seen")
    again = changes(spark, root, tmp_path, "")
    assert again[0] == failed[0], "the batch that was not committed comes again as it was"
    later = [x for g in again[1:] + changes(spark, root, tmp_path, "") for x in g[1]]
    assert later == [("new.py", "created", None)]
    assert changes(spark, root, tmp_path, "") == []


def test_a_folder_as_file_events(spark, tmp_path):
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "a").write_text("1")
    told = []

    def once():
        q = events.folder_source(spark, str(tmp_path / "code"), str(tmp_path / "state")).writeStream
        q = q.foreachBatch(lambda b, n: told.extend((r.path.rsplit("/", 1)[1], r.kind) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    once()
    assert told == []  # what is there at first is not told
    (tmp_path / "code" / "a").rename(tmp_path / "code" / "b")
    once()
    assert sorted(told) == [("a", "deleted"), ("b", "created")]


def test_differences_against_replay():
    r = random.Random(4)
    old = {f"/f{k}": (k, k, k) for k in range(20)}
    new = {p if r.random() < 0.7 else p + "x": v if r.random() < 0.7 else (v[0] + 1, *v[1:]) for p, v in old.items() if r.random() < 0.8} | {"/new": (99, 99, 99)}
    state = dict(old)
    for p, kind, to in watch.differences(old, new):
        if kind == "deleted":
            del state[p]
        elif kind == "moved":
            state[to] = state.pop(p)
            assert state[to] == new[to]
        else:
            assert (p in state) == (kind == "modified")
            state[p] = new[p]
    assert state == new


def test_calls_are_recorded_once(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "t", "s", "/r", o) for o in ("success", "error", "odd")]
    calls = spark.createDataFrame(rows, "timestamp string, tool_name string, session_id string, root_path string, outcome string").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    sink = sync.calls_sink(str(tmp_path / "calls"))
    for number in (0, 1, 1, 0):
        sink(calls, number)
    assert sync.recorded_calls(spark, str(tmp_path / "calls")).count() == 4


def test_decisions_follow_chains(spark):
    rows = [("/a", "supported", "/a"), ("/b", "supported", "/a"), ("/c", "supported", "/b"), ("/d", "allowlisted", "/c"), ("/e", "bare", None), ("/f", "linked_worktree", None), ("/g", "no_repository", None), ("/h", "unknown", None), ("/x", "supported", "/y"), ("/y", "supported", "/z"), ("/z", "supported", "/x"), ("/w", "supported", "/y")]
    got = {r.root_id: (r.serving_state, r.destination) for r in sync.decided(spark.createDataFrame(rows, "root_id string, status string, root string")).collect()}
    assert got == {"/a": ("active", None), "/b": ("remapped", "/a"), "/c": ("remapped", "/a"), "/d": ("remapped", "/a"), "/e": ("quarantined", None), "/f": ("quarantined", None), "/g": ("purged", None), "/h": ("transient", None), "/x": ("active", None), "/y": ("remapped", "/x"), "/z": ("remapped", "/x"), "/w": ("remapped", "/x")}


def test_table_functions(spark):
    registered.register(spark)
    rows = spark.sql("select * from structure_rows(TABLE(select 'f' as key, 'import os\nclass A(B): pass' as source))").collect()
    assert {(r.key, r.kind, r.name) for r in rows} >= {("f", "class", "A")}
    assert spark.sql("select * from chunk_rows(TABLE(select 1 as key, cast(null as string) as text, 'text' as kind))").isEmpty()


