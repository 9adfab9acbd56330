"""Operators on small fixtures with known results."""

import random
import re

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import identity, scalars
from tessera.operators import chunk, community, extract, graph, search, store, sync
from tessera.sources import policy, scan
from tessera.streaming import events

ROOT = "test_root"


def test_ids(spark):
    import hashlib

    r = spark.range(1).select(
        identity.entity_id(F.lit("Foo"), F.lit(" Class "), F.lit("/r")).alias("e"),
        identity.community_id(F.lit("/r"), F.array(F.lit("b"), F.lit("a"))).alias("two"),
        identity.community_id(F.lit("/r"), F.array(F.lit("a"))).alias("one"),
        identity.extraction_key(F.array(F.lit("ab"), F.lit("c"))).alias("k"),
    ).first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert r.e == sha("foo|class|/r") and r.two == sha("/r|" + repr(("a", "b"))) and r.one == sha("/r|" + repr(("a",)))
    assert r.k == sha("2:ab\x001:c")


@pytest.mark.parametrize(
    "path,action,secret",
    [("/tmp/app/.env.local", "skip", True), ("/tmp/app/key.pem", "skip", True), ("/home/u/.ssh/id_rsa", "skip", True), ("/tmp/app/credentials.json", "skip", True), ("/tmp/app/src/main.py", "index", False), ("/tmp/app/logo.PNG", "skip", False), ("/tmp/app/node_modules/x.js", "skip", False)],
)
def test_policy(spark, path, action, secret):
    d = spark.createDataFrame([(path,)], "path string").select(policy.Policy().decision("path").alias("d")).first().d
    assert (d.action, d.secret_risk) == (action, secret)


def test_content_rule_names_no_value(spark):
    r = spark.createDataFrame([("secret = 'abcdefgh1'",), ("nothing",), (None,)], "t string").select(scalars.secret_rules("t").alias("r")).collect()
    assert [x.r for x in r[:2]] == [["generic_secret_assignment"], []]


def test_content_rules_see_the_whole_text(spark):
    d = spark.createDataFrame([("x " * 100_001 + "secret = 'abcdefgh1'",)], "t string")
    assert d.select(scalars.secret_rules("t").alias("r")).first().r == ["generic_secret_assignment"]
    assert d.select(scalars.secret_rules("t", 200_000).alias("r")).first().r == []


@pytest.mark.parametrize("path,out", [("/r/build/x.o", True), ("/r/a.log", True), ("/r/src/a.py", False), ("/r/other/foo", False), ("/r/sub/foo", True), ("/r/sub/deep/foo", True)])
def test_ignore_files(spark, path, out):
    files = {"/r": "build/\n*.log\n", "/r/sub": "foo\n"}
    assert spark.createDataFrame([(path,)], "p string").select(policy.ignored(F.col("p"), files).alias("x")).first().x is out


def test_scan_and_decode(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def f(): pass\n")
    (tmp_path / "src" / "latin.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "src" / "key.pem").write_text("x")
    found = scan.files(spark, str(tmp_path))
    plan = {r.path.rsplit("/", 1)[1]: r for r in scan.scan_plan(found, policy.Policy(excluded_directories=[])).collect()}
    assert plan["a.py"].action == "index" and plan["key.pem"].action == "skip" and plan["key.pem"].secret_risk
    texts = {r.file_name: r for r in scan.texts(found).collect()}
    assert texts["latin.txt"].text == "café" and texts["a.py"].file_type == "python"
    limited = scan.scan_plan(found, policy.Policy(excluded_directories=[]), max_files=1)
    assert limited.where("limit_hit").count() == 1 and {(r.reason, r.files) for r in scan.skip_counts(limited).collect()} >= {("limit", 1)}
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "c.py").write_text("x = 1\n")
    (tmp_path / "z" / ".gitignore").write_text("c.*\n")
    found = scan.files(spark, str(tmp_path)).where("path not like '%.gitignore'")
    one = scan.scan_plan(found, policy.Policy(excluded_directories=[]), max_dirs=1)
    assert {r.path.rsplit("/", 1)[1] for r in one.where("limit_hit").collect()} == {"c.py"}
    (tmp_path / ".git" / "info").mkdir(parents=True)
    (tmp_path / ".git" / "info" / "exclude").write_text("nothing\n")
    ignore = scan.ignore_files(str(tmp_path), scan.files(spark, str(tmp_path)))
    assert {tuple(r) for r in ignore.collect()} == {(str(tmp_path / "z"), "c.*\n"), (str(tmp_path), "nothing\n")}
    assert {r.path.rsplit("/", 1)[1] for r in scan.scan_plan(found, policy.Policy(excluded_directories=[]), ignore).where("array_contains(reason_codes, 'gitignored')").collect()} == {"c.py"}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n,;#", max_size=400), st.sampled_from(["text", "markdown", "python", "json"]), st.integers(20, 60), st.integers(0, 15))
def test_chunks_cover(text, kind, size, overlap):
    got = chunk.chunks_of(text, kind, size, overlap)
    assert bool(got) == bool(text.strip())
    words = "".join(text.split())
    joined = "".join("".join(c[0].split()) for c in got)
    assert not words or set(words) == set(joined)
    if kind in ("text", "json"):
        assert all(len(c[0]) <= size for c in got)
    for own, a, b in got:
        assert re.sub(r"\s*\n\s*\n\s*", "\n\n", text[a:b]) == re.sub(r"\s*\n\s*\n\s*", "\n\n", own)
    assert all(c[0].strip() for c in got)
    if overlap == 0 and kind == "text":
        assert joined == words


def test_chunk_rules():
    assert [c[0] for c in chunk.chunks_of("aaa\n\nbbb\n\nccc", "text", 10, 0)] == ["aaa\n\nbbb", "ccc"]
    assert [c[0] for c in chunk.chunks_of("aaa\n\nbbb\n\nccc", "text", 10, 3)] == ["aaa\n\nbbb", "bbb\n\nccc"]
    code = "import x\nclass A:\n    pass\ndef f():\n    return 1\n"
    assert [c[0].split("\n")[0] for c in chunk.chunks_of(code, "python", 25, 0)] == ["import x", "class A:", "def f():"]
    page = "<html><head><style>x</style></head><body><h1>A long enough heading</h1><table><tr><th>Name</th><th>Value</th></tr><tr><td>first thing</td><td>one hundred</td></tr></table><p>A paragraph that has more than thirty characters.</p><script>no</script></body></html>"
    assert chunk.html_text(page).split("\n\n") == ["# A long enough heading", "Name: first thing | Value: one hundred", "A paragraph that has more than thirty characters."]


@pytest.mark.parametrize("alpha,hits,want", [(0.5, [("a", 0.9, []), ("b", 0.4, ["foo"])], [("b", 0.70), ("a", 0.45)]), (1.0, [("a", 0.9, []), ("b", 0.1, ["foo"])], [("b", 1.0), ("a", 0.0)]), (0.0, [("a", 0.9, []), ("b", 0.4, ["foo"])], [("a", 0.9), ("b", 0.4)])])
def test_rerank(spark, alpha, hits, want):
    h = spark.createDataFrame(hits, "id string, score double, entity_names array<string>")
    got = search.reranked(h, ["foo"], alpha).orderBy(F.desc("score")).collect()
    assert [(r.id, round(r.score, 6)) for r in got] == want


def test_nearest_zero_vectors_and_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0]), (4, None)], "id long, embedding array<float>")
    assert [(r.id, r.score) for r in search.nearest(v, [1.0, 0.0], 5, "id").collect()] == [(1, 1.0), (3, 1.0), (2, 0.0)]


def edges_of(spark, rows):
    f = spark.createDataFrame([(ROOT, f, i, s, "x", t, "x", k, float(w), "") for i, (f, s, t, k, w) in enumerate(rows)], "root_id string, file_path string, ordinal long, source string, source_type string, target string, target_type string, edge_type string, weight double, description string")
    c = graph.contributions(f)
    names = f.select(F.explode(F.array("source", "target")).alias("name")).distinct()
    e = names.select(F.lit(ROOT).alias("root_id"), identity.entity_id("name", F.lit("x"), F.lit(ROOT)).alias("entity_id"), "name", F.lower("name").alias("name_lower"), F.array().cast("array<string>").alias("file_paths"))
    return c, graph.edges(c), e


@pytest.mark.parametrize("texts", ["AR", "RA"])
def test_facts_that_tie_but_for_their_description(spark, texts):
    f = spark.createDataFrame([(ROOT, "/a.py", 1, "A", "x", "B", "x", "k", 2.0, t) for t in texts], "root_id string, file_path string, ordinal long, source string, source_type string, target string, target_type string, edge_type string, weight double, description string").coalesce(1)
    assert [c.description for c in graph.contributions(f).collect()] == ["R"] and [e.description for e in graph.edges_of(f).collect()] == ["R"]


def test_graph_scenarios(spark):
    c, g, e = edges_of(spark, [("/a.py", "A", "B", "calls", 1.0), ("/b.py", "A", "B", "calls", 2.5), ("/a.py", "B", "C", "calls", 1), ("/a.py", "C", "C", "calls", 1), ("/a.py", "main", "helper", "calls", 1), ("/a.py", "setup", "helper", "calls", 1)])
    by = {r.name: r.entity_id for r in e.collect()}
    assert {(r.source_id, r.target_id): r.weight for r in g.collect()}[by["A"], by["B"]] == 3.5
    hops = lambda seed, d, t=None: {n: r.hops for r in graph.neighbours(g, e.where(F.col("name") == seed), d, t).collect() for n, i in by.items() if i == r.entity_id}
    assert hops("A", 1) == {"B": 1} and hops("A", 2) == {"B": 1, "C": 2} and hops("A", 2, ["imports"]) == {}
    assert {r.name for r in graph.callers(e, g, "HELPER").collect()} == {"main", "setup"}
    assert {r.name: r.degree for r in graph.degrees(e, g).collect()}["C"] == 2
    less = graph.edges(store.without_file(c, ROOT, "/b.py"))
    assert {(r.source_id, r.target_id): r.weight for r in less.collect()}[by["A"], by["B"]] == 1.0
    assert graph.edges(store.without_file(store.without_file(c, ROOT, "/b.py"), ROOT, "/a.py")).isEmpty()


def modularity(groups, pairs):
    m = len(pairs)
    of = {n: i for i, g in enumerate(groups) for n in g}
    deg = {}
    for a, b in pairs:
        deg[a], deg[b] = deg.get(a, 0) + 1, deg.get(b, 0) + 1
    return sum(of[a] == of[b] for a, b in pairs) / m - sum((sum(deg.get(n, 0) for n in g) / (2 * m)) ** 2 for g in groups)


def by_force(nodes, pairs):
    """The most modularity of any grouping of a few nodes."""
    def groupings(rest):
        if not rest:
            yield []
            return
        for g in groupings(rest[1:]):
            yield [[rest[0]], *g]
            for i in range(len(g)):
                yield [*g[:i], [rest[0], *g[i]], *g[i + 1 :]]

    return max(modularity(g, pairs) for g in groupings(nodes))


def detected(spark, nodes, pairs):
    e = spark.createDataFrame([(ROOT, n) for n in nodes], "root_id string, entity_id string")
    out = community.detect(e, spark.createDataFrame(pairs, "a string, b string")).collect()
    levels = {}
    for r in out:
        levels.setdefault(r.level, {}).setdefault(r.group, []).append(r.entity_id)
    return levels


def test_detection_against_brute_force(spark):
    r = random.Random(3)
    nodes = [f"n{i}" for i in range(8)]
    pairs = sorted({tuple(sorted(r.sample(nodes, 2))) for _ in range(12)})
    got = detected(spark, nodes, pairs)
    assert sorted(n for g in got[0].values() for n in g) == nodes
    assert modularity(list(got[0].values()), pairs) >= by_force(nodes, pairs) - 0.06
    cliques = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")]
    one = detected(spark, [*"abcxyz!"], cliques)
    assert sorted(map(sorted, one[0].values())) == [["!"], ["a", "b", "c"], ["x", "y", "z"]]
    assert detected(spark, [*"ba"], [])[0] == {"a": ["a"], "b": ["b"]}


def test_detection_of_a_large_part_nests(spark):
    """One connected part of thousands of nodes, by the same method; levels lie within one another."""
    r = random.Random(5)
    n, own = 5200, 26
    pairs = {tuple(sorted((f"n{i:05}", f"n{(i // own) * own + r.randrange(own) if r.random() < 0.9 else r.randrange(n):05}"))) for i in range(n) for _ in range(3)}
    pairs = sorted(p for p in pairs if p[0] != p[1])
    e = spark.createDataFrame(pd.DataFrame({"root_id": ROOT, "entity_id": [f"n{i:05}" for i in range(n)]}))
    p = spark.createDataFrame(pd.DataFrame(pairs, columns=["a", "b"]))
    groups = community.cut(community.detect(e, p))
    planted = e.select("root_id", "entity_id", F.expr("cast(substring(entity_id, 2) as int) div 26").cast("string").alias("group"))
    assert community.modularity(groups.where("level = 0"), p) >= community.modularity(planted, p) - 0.02
    c = community.communities(groups).collect()
    assert max(x.level for x in c) >= 1
    members = {(x.level, x.community_id): set(x.entity_ids) for x in c}
    assert all(x.level == 0 or set(x.entity_ids) <= members[x.level - 1, x.parent_id] for x in c if len(x.entity_ids) > 1)
    assert graph.hierarchy([spark.createDataFrame([("p", "a")], "community_id string, entity_id string"), spark.createDataFrame([("q", "b")], "community_id string, entity_id string")]) is None


def test_records(spark):
    text = '("entity"<|>Alice<|>person<|>A software engineer<|>1)##("entity"<|>Python<|>technology<|>A programming language<|>1)##("relationship"<|>Alice<|>Python<|>Alice uses Python<|>8)##("relationship"<|>a<|>b<|>c<|>many)##broken##<|COMPLETE|>'
    a = spark.createDataFrame([(1, text)], "id long, answer string")
    assert [(r.name, r.type) for r in extract.entity_records(a).collect()] == [("Alice", "person"), ("Python", "technology")]
    got = extract.relationship_records(a).collect()
    assert [(r.source, r.target, r.weight, r.source_type, r.target_type) for r in got] == [("Alice", "Python", 8.0, "person", "technology")]


class Talker:
    """Names the words it has been asked about with a capital; says once that more is missing; fails on FAIL."""

    def __init__(self):
        self.seen = 0

    def chat(self, messages):
        text = messages[1]["content"]
        if "FAIL" in text:
            raise RuntimeError("no answer")
        if messages[-1]["content"] == extract.MORE:
            return "Y" if len(messages) < 7 else "N"
        turn = sum(m["role"] == "assistant" for m in messages)
        names = sorted(set(re.findall(r"\b[A-Z][a-z]+\b", text.split("\n\n", 1)[1])))
        return "##".join(f'("entity"<|>{n}<|>name<|>seen {turn}<|>1)' for n in names[turn : turn + 1]) + f'##("relationship"<|>{names[0]}<|>Other<|>r<|>2)##<|COMPLETE|>'


class Shorten:
    def summarize(self, name, descriptions):
        if name == "Bad":
            raise ValueError
        return f"{name}: {len(descriptions)}"


def test_model_extraction(spark):
    rows = [("/r", "/a.py", 0, "Alpha and Beta"), ("/r", "/a.py", 1, "more of Alpha"), ("/r", "/b.py", 0, "FAIL"), ("/r", "/c.py", 0, "x"), ("/r", "/c.py", 150, "Late beyond the bound")]
    chunks = spark.createDataFrame(rows[:3], "root_id string, file_path string, chunk_id int, chunk_text string")
    code = extract.code_entities(spark.createDataFrame([("/a.py", "class Alpha(Base):\n    pass\n")], "path string, text string")).withColumn("root_id", F.lit("/r"))
    entities, facts, failures = extract.extracted_files(chunks, Talker(), code, Shorten(), gleanings=2)
    got = {(r.file_path, r.name, r.type): r for r in entities.collect()}
    assert {k[1:] for k in got} == {("Alpha", "name"), ("Beta", "name"), ("Alpha", "class"), ("Base", "class")}
    assert got["/a.py", "Alpha", "name"].chunk_ids == [0] and got["/a.py", "Alpha", "class"].chunk_ids == []
    assert {(r.source, r.target, r.edge_type, r.source_type) for r in facts.collect()} == {("Alpha", "Other", "related", "name"), ("Alpha", "Other", "related", ""), ("Alpha", "Base", "inherits", "class")}
    assert [(r.file_path, r.error) for r in failures.collect()] == [("/b.py", "RuntimeError")]
    late = extract.batches(spark.createDataFrame(rows[3:], chunks.schema)).collect()
    assert [r.chunk_ids for r in late] == [[0]]
    many = spark.createDataFrame([("A", ["x", "y"], "x; y"), ("Bad", ["x", "y"], "x; y"), ("One", ["x"], "x")], "name string, descriptions array<string>, description string")
    assert {r["name"]: r.description for r in extract.summarized(many, Shorten()).collect()} == {"A": "A: 2", "Bad": "x", "One": "x"}


def test_registered_functions(spark):
    from tessera.functions.registered import register

    register(spark)
    assert [(r.chunk_id, r.chunk_text) for r in spark.sql("select inline(chunks('aaa bbb', 'text'))").collect()] == [(0, "aaa bbb")]
    assert spark.sql("select mail_text('<p>a</p>b') as t").first().t == "a\nb"
    assert [r["name"] for r in spark.sql("select inline(python_structure('class A: pass'))").collect()] == ["A"]
    answer = '("entity"<|>parse(x)<|>t<|>(d))##entity<|>"y"<|>t<|>d<|>1'
    d = spark.createDataFrame([(answer,)], "answer string")
    d.createOrReplaceTempView("answers")
    assert spark.sql("select inline(e) from (select entity_records(answer) as e from answers)").collect() == d.select(F.inline(extract.entity_array("answer"))).collect()


@pytest.mark.parametrize("text,want", [("1", [10]), ("1,3", [10, 30]), (None, [10, 20, 30]), ("9", [10, 20, 30]), ("x", [10, 20, 30])])
def test_ordinals(spark, text, want):
    d = spark.createDataFrame([(text,)], "o string").select(extract.ordinals_to_chunks(F.col("o"), F.array(F.lit(10), F.lit(20), F.lit(30))).alias("c"))
    assert d.first().c == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=30), st.integers(1, 5), st.integers(1, 60))
def test_batches(lengths, items, chars):
    got = extract.batches_of(lengths, items, chars)
    for b in set(got):
        own = [n for n, k in zip(lengths, got) if k == b]
        assert len(own) <= items and (sum(own) <= chars or len(own) == 1)


def test_batched_equals_fold(spark):
    texts = ["a" * n for n in (5, 5, 20, 1, 1, 1, 30, 2)]
    got = spark.createDataFrame([(texts,)], "t array<string>").select(extract.batched(F.col("t"), 3, 22).alias("b")).first().b
    assert got == extract.batches_of([len(t) for t in texts], 3, 22)
    assert extract.batches_of([1] * 5, 2, 100) == [0, 0, 1, 1, 2]


def test_code_entities(spark):
    f = spark.createDataFrame([("/a.py", "import os\nclass A(B):\n    def f(self):\n        g()\n"), ("/bad.py", "def ("), ("/none.py", None)], "path string, text string")
    got = {(r["kind"], r["name"], r["edge_type"], r["target"]) for r in extract.code_entities(f).collect()}
    assert got == {("module", "<module>", "imports", "os"), ("class", "A", "", ""), ("class", "A", "inherits", "B"), ("function", "f", "", ""), ("function", "f", "calls", "g")}


def test_metrics(spark):
    rows = [("2024-02-01 00:00:00", "t", o) for o in ["success"] * 3 + ["zero_result", "error", "unknown"]] + [("2023-12-20 00:00:00", "t", "error")]
    c = spark.createDataFrame(rows, "timestamp string, tool_name string, outcome string").withColumn("timestamp", F.to_timestamp("timestamp"))
    r = sync.outcome_metrics(c, F.lit("2024-01-02").cast("timestamp")).first()
    assert (r.total, r.success, r.success_rate) == (5, 3, 60.0)
    assert scalars.since_days("30d") == 30
    with pytest.raises(ValueError):
        scalars.since_days("month")


def test_sync_cases(spark):
    found = spark.createDataFrame([("new", 1, "a"), ("same", 1, "a"), ("touched", 2, "a"), ("changed", 2, "b")], "path_key string, mtime long, file_hash string")
    indexed = spark.createDataFrame([("same", 1, "a"), ("touched", 1, "a"), ("changed", 1, "a"), ("gone", 1, "a")], "path_key string, mtime long, file_hash string")
    want = {"new": "new", "same": "unchanged", "touched": "touched", "changed": "changed", "gone": "removed"}
    assert {r.path_key: r.state for r in sync.diff(found, indexed).collect()} == want
    assert "gone" not in {r.path_key for r in sync.diff(found, indexed, complete=False).collect()}
    assert "gone" not in {r.path_key for r in sync.diff(found, indexed, recursive=False).collect()}


def test_audit_and_purge(spark):
    p = spark.createDataFrame([("/a/key.pem", "x"), ("/a/m.py", "token = 'abcdefghij'"), ("/a/ok.py", "fine")], "path_key string, chunk_text string")
    assert {r.path_key for r in sync.secret_audit(p).collect()} == {"/a/key.pem", "/a/m.py"}
    assert sync.purged(p, "/a/key.pem", True).count() == 2
    for path, confirm in (("/a/ok.py", True), ("/a/key.pem", False)):
        with pytest.raises(ValueError):
            sync.purged(p, path, confirm)


def test_reconcile(spark):
    registry = spark.createDataFrame([("/m",), ("/m/pkg",), ("/plain",), ("/w",)], "root_id string")
    d = spark.createDataFrame([("/m", "active", None), ("/m/pkg", "remapped", "/m"), ("/plain", "purged", None)], "root_id string, serving_state string, destination string")
    assert {r.root_id for r in sync.reconciled(registry, d).collect()} == {"/m", "/w"}
    assert [r.root_id for r in sync.unclassified(registry, d).collect()] == ["/w"]


def test_hunks_and_findings(spark):
    diff = ["diff --git a/x b/x", "+++ b/src/x.py", "@@ -1,2 +10,3 @@ def f", "+a", "@@ -9 +30 @@", "+++ b/y.py", "@@ -1,1 +5,0 @@"]
    h = sync.hunk_lines(spark.createDataFrame([(1, *x) for x in enumerate(diff)] + [(2, 0, "@@ -1 +7 @@")], "diff_id int, n long, line string")).where("diff_id = 1")
    assert {(r.path, r["first"], r["last"]) for r in h.collect()} == {("src/x.py", 10, 12), ("src/x.py", 30, 30)}
    f = spark.createDataFrame([(1, "src/x.py", 8, "a"), (2, "src/x.py", 15, "a"), (3, "y.py", 5, "a")], "finding_id long, path string, line int, text string")
    assert {r.finding_id for r in sync.near_lines(f, h).collect()} == {1}


def test_store_generations_and_commits(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    v = s.publish(points=one)["version"]
    pinned = s.read("points")
    s.publish(v, points=store.upserted(s.read("points"), spark.createDataFrame([(2, "c"), (3, "d")], "id long, t string"), ["id"]))
    assert {(r.id, r.t) for r in s.read("points").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert pinned.count() == 2
    with pytest.raises(store.Conflict):
        s.publish(v, points=one)
    # Of two writers that have both checked, the first to create the version wins, whichever wrote its tables first.
    for other in ("published late", "published early"):
        now, mine = s.state(), []
        theirs = store.Store(spark, s.folder)
        first, second = (theirs, s) if other == "published early" else (s, theirs)
        check = second.state
        second.state = lambda: now  # noqa: B023  # it has checked before the other commits
        mine.append(first.commit(now["version"], now | {"by": other}))
        with pytest.raises(store.Conflict):
            second.commit(now["version"], now | {"by": "nobody"})
        second.state = check
        assert s.state() == theirs.state() == mine[0]
    with pytest.raises(store.Conflict):
        s._create(f"{s.folder}/_commits", f"{s.state()['version']:012d}.json", "{}")


def test_store_builds(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    v = s.publish(dirty=True, points=spark.range(1))["graph_version"]
    assert v == 1 and s.is_dirty() and not s.commit_communities("b", v - 1)
    assert s.commit_communities("b", v, communities=spark.range(2)) and not s.is_dirty() and not s.commit_communities("c", v)
    assert s.read("communities").count() == 2 and s.state()["committed_build_id"] == "b"
    s.publish(dirty=True)
    assert s.is_dirty()
    s.reset("communities")
    assert not s.has("communities") and s.has("points")


@pytest.mark.parametrize("times,want", [([0, 1, 2], [0, 0, 0]), ([0, 1, 5], [0, 0, 1]), ([float(x) for x in range(13)], [0] * 10 + [1] * 3), ([], [])])
def test_debounce_rule(times, want):
    assert events.split_batches(times) == want


def test_debounced_table_parts_lasting_bursts(spark):
    times = [0.0, 1.0, 5.0] + [100.0 + i for i in range(13)]
    e = spark.createDataFrame([("/r", f"/r/f{i}", t) for i, t in enumerate(times)], "root_id string, path string, s double").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted((r.first_ts, r.n_events) for r in events.debounced_table(e).collect())
    assert got == [(0.0, 2), (5.0, 1), (100.0, 10), (110.0, 3)]


def test_debounced_table_equals_a_plain_loop(spark):
    r = random.Random(6)
    rows = [(f"/r{r.randrange(3)}", f"/r/f{i}", float(r.randrange(120)) + r.random()) for i in range(300)]
    e = spark.createDataFrame(rows, "root_id string, path string, s double").withColumn("ts", F.timestamp_seconds("s"))
    want = []
    for root in sorted({x[0] for x in rows}):
        own = sorted((round(t, 6), p) for k, p, t in rows if k == root)
        for b in set(cuts := events.split_batches([t for t, _ in own])):
            mine = [x for x, c in zip(own, cuts) if c == b]
            want.append((root, len(mine), sorted(p for _, p in mine)))
    assert sorted((g.root_id, g.n_events, list(g.paths)) for g in events.debounced_table(e).collect()) == sorted(want)


def test_event_source_and_touched_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"root_id": "/r", "path": "/r/a/x", "kind": "moved", "moved_to": "/r/b/x", "ts": "2024-01-01T00:00:00Z"}\n{"root_id": "/r", "path": "/r/c", "kind": "opened", "ts": "2024-01-01T00:00:00Z"}\n')
    got = []
    q = events.event_source(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda d, i: got.extend(d.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(g.path, g.kind) for g in got} == {("/r/a/x", "deleted"), ("/r/b/x", "created")}
    b = spark.createDataFrame([("/r", ["/r/a/x", "/r/a/y", "/r/b/x"])], "root_id string, paths array<string>")
    assert {(t.root_id, t.folder) for t in events.touched_folders(b).collect()} == {("/r", "/r/a"), ("/r", "/r/b")}


def test_metrics_table_and_command(spark, tmp_path, capsys, monkeypatch):
    from tessera import metrics

    rows = [("2024-02-01 00:00:00", "t", "s", "/r", o) for o in ("success", "success", "error", "unknown")]
    c = spark.createDataFrame(rows, "timestamp string, tool_name string, session_id string, root_path string, outcome string").withColumn("timestamp", F.to_timestamp("timestamp"))
    sync.record_calls(c, str(tmp_path / "calls"))
    sync.record_calls(c.limit(1), str(tmp_path / "calls"))
    monkeypatch.setattr(metrics, "build", lambda app: spark)
    assert metrics.main(["query", str(tmp_path / "calls"), "--json"]) == 0
    assert '"total": 4' in capsys.readouterr().out
    assert metrics.main(["query", str(tmp_path / "calls"), "--since", "1d", "--tool", "t"]) == 0 and capsys.readouterr().out == ""


def test_moves_and_apply(spark):
    e = spark.createDataFrame([("/r", "/r/tmp", "created", None), ("/r", "/r/tmp", "moved", "/r/x"), ("/r", "/r/tmp", "deleted", None)], "root_id string, path string, kind string, moved_to string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    f = events.file_events(e)
    b = events.quiet_batches(f)
    assert b.first().paths == ["/r/tmp", "/r/x"]
    disk = spark.createDataFrame([("/r/x",)], "path string")
    assert {r.path: r.action for r in events.apply_batch(b, disk).collect()} == {"/r/tmp": "remove", "/r/x": "index"}


def test_stream_of_changes(spark, tmp_path):
    e = spark.createDataFrame([("/r", f"/r/f{i}", "created", None) for i in range(4)], "root_id string, path string, kind string, moved_to string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    got: list[pd.DataFrame] = []
    s = events.file_events(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = events.debounced_stream(s, quiet=0.2, max_age=1.0).writeStream.foreachBatch(lambda d, i: got.append(d.toPandas())).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    import time

    until = time.time() + 60
    while time.time() < until and not any(len(g) for g in got):
        time.sleep(0.5)
    q.stop()
    assert sorted(p for g in got for ps in g.paths for p in ps) == [f"/r/f{i}" for i in range(4)]


def test_embeds_each_text_once(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id long, t string")
    got = {r.id: r.embedding for r in extract.embedded(d, extract.HashEmbedder(8), "t").collect()}
    assert got[1] == got[2] and got[3] is None and abs(sum(x * x for x in got[1]) - 1) < 1e-6


def test_targets_cap(spark):
    m = spark.createDataFrame([(f"c{i}", f"e{i}") for i in range(10)], "community_id string, entity_id string")
    few = m.where("entity_id in ('e1', 'e2')")
    assert search.targets(few, m, m).count() == 2 and search.targets(m.where("entity_id < 'e5'"), m, m).count() == 0
    tiny = m.where("community_id < 'c2'")
    assert search.targets(tiny.limit(1), tiny, tiny).count() == 0 and search.targets(tiny.limit(1), tiny, tiny, rounding="ceil").count() == 1


def test_a_pause_of_just_the_quiet_time_parts(spark):
    base = 1_704_067_200_000_000
    # Steps of 2 s, of just less, of just more.
    steps = [0, 2_000_000, 1_999_999, 2_000_000, 2_000_001, 1, 2_000_000]
    us = [base + 172_425 + sum(steps[: k + 1]) for k in range(len(steps))]
    f = spark.createDataFrame([("/r", f"p{k}", t) for k, t in enumerate(us)], "root_id string, path string, t long").select("root_id", "path", F.lit("modified").alias("kind"), F.timestamp_micros("t").alias("ts"))
    want = [["p0"], ["p1", "p2"], ["p3"], ["p4", "p5"], ["p6"]]
    q = events.quiet_batches(f).orderBy("start").select("paths", F.unix_micros("start").alias("a"), F.unix_micros("end").alias("b")).collect()
    assert [r.paths for r in q] == want and (q[1].a, q[1].b) == (us[1], us[2] + 2_000_000)
    assert [r.paths for r in events.debounced_table(f).orderBy("first_ts").collect()] == want


def test_neighbours_do_not_swap_places_for_ever(spark):
    """Of 1500 pairs linked to nobody else each is a community, however the halves are dealt."""
    nodes = spark.range(3000).select(F.lit(ROOT).alias("root_id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("entity_id"))
    pairs = spark.range(1500).select(F.concat(F.lit("n"), (F.col("id") * 2).cast("string")).alias("a"), F.concat(F.lit("n"), (F.col("id") * 2 + 1).cast("string")).alias("b"))
    g = community.detect(nodes, pairs).where("level = 0").groupBy("group").count()
    assert {(r["count"], r.n) for r in g.groupBy("count").agg(F.count("*").alias("n")).collect()} == {(2, 1500)}


def test_edges_by_keys_give_what_ids_give(spark):
    rows = [("/a.py", "A", "B", 1.0, "r"), ("/b.py", "A", "B", 2.0, "s"), ("/a.py", "B", "C", 1.0, ""), ("/a.py", "C", "C", 1.0, ""), ("/b.py", "C", "D", 4.0, "")]
    f = spark.createDataFrame([(ROOT, p, k, a, "x", b, "x", "k", w, t) for k, (p, a, b, w, t) in enumerate(rows)], "root_id string, file_path string, ordinal long, source string, source_type string, target string, target_type string, edge_type string, weight double, description string")
    keyed, plain = graph.edges_of(f), graph.edges(graph.contributions(f))
    columns = ["edge_id", "source_id", "target_id", "edge_type", "weight", "description"]
    rows_of = lambda d, *c: sorted(map(tuple, d.select(*c).collect()))
    assert rows_of(keyed, *columns) == rows_of(plain, *columns) and len(rows_of(plain, *columns)) == 4
    e = f.select(F.explode(F.array("source", "target")).alias("name")).distinct().select("name", identity.entity_id("name", F.lit("x"), F.lit(ROOT)).alias("entity_id"))
    members = e.select(F.when(F.col("name") < "C", "one").otherwise("two").alias("community_id"), "entity_id")
    inner = ["community_id", *columns]
    assert rows_of(graph.internal_edges(keyed, members), *inner) == rows_of(graph.internal_edges(plain, members), *inner)
    assert rows_of(graph.neighbours(keyed, e.where("name = 'A'"), 2), "entity_id", "hops") == rows_of(graph.neighbours(plain, e.where("name = 'A'"), 2), "entity_id", "hops")
    # One shuffle serves the groups by file and edge and the sums by edge.
    assert keyed._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1
    assert keyed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange ") == 1


def test_best_of_many_queries_in_bounded_blocks(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(search, "BLOCK_CELLS", 64)
    rng = np.random.default_rng(3)
    q, x = rng.normal(size=(50, 4)), rng.normal(size=(90, 4)).repeat(2, 0)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(x.tolist())], ["id", "v"])
    got = pa.Table.from_batches(search.best_of(iter([batch]), search.unit_blocks(list(enumerate(q.tolist()))), 5)).to_pandas()
    score = np.einsum("qd,pd->qp", q / np.linalg.norm(q, axis=1)[:, None], x / np.linalg.norm(x, axis=1)[:, None])
    for i in range(50):
        assert got[got.query_id == i].id.tolist() == np.lexsort((np.arange(len(x)), -score[i]))[:5].tolist()


def test_chunks_come_in_small_batches(spark):
    d = spark.range(400, numPartitions=1).select("id", F.lit("a text of some words").alias("text"), F.lit("text").alias("file_type"))
    sizes = chunk.chunked(d, ["id"]).mapInArrow(lambda bs: (b.select(["chunk_id"]) for b in bs), "chunk_id int").count()
    assert sizes == 400 and chunk.ROWS <= 256


def test_reports_are_parsed_once_a_row(spark):
    d = spark.createDataFrame([('```json\n{"title": "t", "summary": "s", "findings": ["a", "b"]}\n```',), ("none",), (None,)], "t string").select(scalars.report_fields("t").alias("r")).select("r.title", "r.summary", "r.findings")
    assert [tuple(r) for r in d.collect()] == [("t", "s", ["a", "b"]), ("", "", []), ("", "", [])]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_greedy_sends_no_graph_through_the_driver(spark, monkeypatch):
    """Joins of rounds are shuffled by key; only the sums by root may be broadcast."""
    plans, own = [], community.cut
    monkeypatch.setattr(community, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df))
    e = own(spark.createDataFrame([("/r", x) for x in "abcd"], "root_id string, entity_id string"))
    p = own(spark.createDataFrame([("a", "b"), ("c", "d")], "a string, b string"))
    got = {(g.entity_id, g.group) for g in community.greedy(e, p).collect()}
    assert {x for x, g in got if g == dict(got)["a"]} == {"a", "b"} and {x for x, g in got if g == dict(got)["c"]} == {"c", "d"}
    assert sum("BroadcastHashJoin" in x for x in plans) <= 1
