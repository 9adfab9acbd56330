"""The engine's surface, end to end on a small folder."""

import os
import subprocess
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunk, extract, graph
from tessera.plans.engine import Engine
from tessera.sources import roots


class Counting(extract.HashEmbedder):
    """Notes in a folder how many texts each call embeds."""

    def __init__(self, folder):
        super().__init__()
        self.folder = folder

    def embed(self, texts):
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(t.replace("\n", " ") for t in texts))
        return super().embed(texts)


class Echo:
    def answer(self, query, context):
        return f"{query}: {len(context)}"


def test_index_search_sync_and_clear(spark, tmp_path):
    root, calls = tmp_path / "code", tmp_path / "calls"
    (root / "src").mkdir(parents=True)
    calls.mkdir()
    (root / "src" / "a.py").write_text("import json\nclass Parser(Base):\n    def parse(self):\n        load()\n")
    (root / "src" / "notes.md").write_text("# River\n\nthe river runs to the sea and the sea is wide\n")
    (root / "src" / "key.pem").write_text("secret")
    (root / "src" / "out.log").write_text("ignored")
    (root / ".gitignore").write_text("*.log\n.gitignore\n")
    e = Engine(spark, str(tmp_path / "store"), embedder=Counting(str(calls)), answerer=Echo())
    assert e.status(str(root))["status"] == "not_found" and e.readiness() == "not_indexed"
    assert e.index(str(root), dry_run=True)["new"] == 2 and not e.store.has("points")
    assert e.index(str(root))["new"] == 2 and e.status(str(root))["files"] == 2
    top = e.search("the river runs to the sea", min_score=0.1).first()
    assert top["path_key"].endswith("notes.md") and top["rank"] == 1
    assert {(r.name, r.type) for r in e.entities().collect()} >= {("Parser", "class"), ("Base", "class"), ("json", "module"), ("load", "function")}
    assert {r.entity_id for r in e.store.read("entity_vectors").collect()} >= {r.entity_id for r in e.entities().collect()}
    assert e.search_entities("pars", 5, 0.99).first().name.lower().startswith("pars")
    assert e.search_global("river")[0]["mode"] == "rebuilding" and e.communities()[1] is None
    assert e.build_communities() and not e.store.is_dirty() and not e.build_communities()
    state, found = e.search_global("Parser")
    assert state["mode"] == "ready" and state["synthesis"].startswith("Parser: ") and not found.isEmpty()
    assert {r.channel for r in e.search_root(str(root), "Parser Base river", 5, 0.0).collect()} == {"chunks", "entities", "communities"}
    assert e.answer("river")[1].startswith("File: ") and e.file_summary(str(root / "src" / "notes.md"))[0].startswith("Summarize")
    first = e.communities(1)[1].first().community_id
    assert e.report(first)[0]["mode"] == "ready" and not e.report("none")[0]["found"] and e.audit().isEmpty()

    # A file with a new time and the old contents is given its time and is not embedded again; another root is not searched.
    before = len(list(calls.iterdir()))
    os.utime(root / "src" / "notes.md", (2_000_000_000, 2_000_000_000))
    counts = e.index(str(root))
    assert (counts["touched"], counts["unchanged"]) == (1, 1) and len(list(calls.iterdir())) == before
    assert e.index(str(root))["unchanged"] == 2
    other = tmp_path / "other"
    other.mkdir()
    (other / "river.md").write_text("the river runs to another sea\n")
    assert e.index(str(other))["new"] == 1
    keys = {r.key for r in e.search_root(str(other), "the river runs to the sea", 5, 0.0).where("channel = 'chunks'").collect()}
    assert keys == {str(other / "river.md")}
    assert not e.search("river", min_score=0.0, root=str(root)).where(F.col("path_key").startswith(str(other))).count()
    e.active_roots = [str(root)]
    assert not e.search("river", min_score=0.0).where(F.col("path_key").startswith(str(other))).count()
    e.active_roots = None

    (root / "src" / "notes.md").unlink()
    (root / "src" / "b.py").write_text("import os\n")
    (root / "src" / "new").mkdir()
    (root / "src" / "new" / "deep.py").write_text("import re\n")
    assert e.touched_folders(str(root), [str(root / "src")])["new"] == 1 and e.status(str(root))["files"] == 3
    counts = e.index(str(root))
    assert (counts["new"], counts["removed"], counts["unchanged"]) == (1, 1, 2) and e.store.is_dirty()
    (root / "src" / "new" / "deep.py").write_text("import abc\nimport re\n")
    os.utime(root / "src" / "new" / "deep.py", (2_000_000_100, 2_000_000_100))
    assert e.index_file(str(root), str(root / "src" / "new" / "deep.py"))["changed"] == 1
    assert e.remove_document(str(root / "src" / "new" / "deep.py")) == 1 and e.remove_document("/none") == 0
    assert "abc" not in {r.name for r in e.entities().collect()} and "abc" not in {r.name for r in e.store.read("entity_vectors").collect()}

    registry = spark.createDataFrame([(str(root),), (str(other),)], "root_id string")
    left, n = e.reconcile(registry, spark.createDataFrame([(str(other), "purged", None)], "root_id string, serving_state string, destination string"))
    assert [r.root_id for r in left.collect()] == [str(root)] and n["purged"] == 1 and e.status(str(other))["files"] == 0
    seen = e.clear(str(root))
    assert not seen["cleared"]
    with pytest.raises(ValueError):
        e.clear(str(root), True, 99, 99)
    assert e.clear(str(root), True, seen["files"], seen["chunks"])["cleared"] and e.stats()["points"] == 0 and e.stats()["entity_vectors"] == 0


def test_git_roots(tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path / "r")], check=True)
    (tmp_path / "r" / "pkg").mkdir()
    (tmp_path / "plain").mkdir()
    subprocess.run(["git", "init", "-q", "--bare", str(tmp_path / "bare")], check=True)
    assert roots.resolve(str(tmp_path / "r" / "pkg")) == roots.Resolution("supported", str(tmp_path / "r"))
    assert roots.resolve(str(tmp_path / "bare")).status == "bare"
    assert roots.resolve(str(tmp_path / "plain")).status == "no_repository"
    assert roots.resolve(str(tmp_path / "plain"), (str(tmp_path),)).status == "allowlisted"


def test_mail_text_and_merge(spark):
    assert chunk.mail_text("<style>x</style><p>Hello <b>you</b></p><div>a<br>b</div><script>z</script>") == "Hello you\na\nb"
    old = spark.createDataFrame([("e", 1, ["/a"], [1])], "entity_id string, frequency long, file_paths array<string>, chunk_ids array<int>")
    new = spark.createDataFrame([("e", "/b", 1), ("e", "/a", 2), ("f", "/a", 1)], "entity_id string, file_path string, chunk_id int")
    got = {r.entity_id: r for r in graph.merged_entities(old, new).collect()}
    assert (got["e"].frequency, got["e"].file_paths, got["e"].chunk_ids) == (3, ["/a", "/b"], [1, 2]) and got["f"].frequency == 1
    c = spark.createDataFrame([(1, "b"), (0, "z"), (0, "a")], "level int, community_id string")
    assert [r.community_id for r in graph.listed(c, 2).collect()] == ["a", "z"]
    assert graph.entity_map(c.withColumn("entity_id", F.lit(1)).withColumn("build_id", F.lit(1)).union(c.withColumn("entity_id", F.lit(1)).withColumn("build_id", F.lit(1)))).count() == 3
