"""Scans, ignore rules, buckets, sums kept by changes, communities by two methods and the index of names: against plain readings of the same rules."""

import itertools
import os
import random
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunk, community, graph, search, store
from tessera.plans.engine import Engine
from tessera.sources import listing, policy, scan


def test_a_scan_sees_every_file(spark, tmp_path, monkeypatch):
    names = ["pkg/__init__.py", "pkg/_util.py", "_private/b.py", "__tests__/c.js", ".github/ci.yml", ".eslintrc.json", "a.py", "b/c/d/e/f.md", "z/café #1.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    (tmp_path / "node_modules" / "x").mkdir(parents=True)
    (tmp_path / "node_modules" / "x" / "y.js").write_text("no")
    (tmp_path / "link").symlink_to(tmp_path / "pkg")
    (tmp_path / "nowhere").symlink_to(tmp_path / "none")
    (tmp_path / "one.lnk").symlink_to(tmp_path / "a.py")
    want = {str(tmp_path / n): len(n.encode()) for n in names} | {str(tmp_path / "one.lnk"): 4}
    for tasks, budget in ((64, 2000), (1, 1)):  # the second leaves folders to further rounds
        monkeypatch.setattr(listing, "TASKS", tasks)
        monkeypatch.setattr(listing.walk, "__defaults__", (budget,))
        found = scan.listing(spark, str(tmp_path), pruned=("node_*",)).collect()
        assert {f.path: f.size for f in found if f.kind == "file"} == want
        assert {(f.path.rsplit("/", 1)[1], f.kind) for f in found if f.kind != "file"} == {("link", "symlink_directory"), ("nowhere", "scan_error"), ("node_modules", "excluded_directory")}
    assert all(f.mtime_ns == os.stat(f.path).st_mtime_ns for f in found if f.kind == "file")
    assert {f.path for f in scan.listing(spark, str(tmp_path), recursive=False).where("kind = 'file'").collect()} == {p for p in want if os.path.dirname(p) == str(tmp_path)}
    assert [f.path for f in scan.listing(spark, str(tmp_path / "a.py")).collect()] == [str(tmp_path / "a.py")]
    assert [f.kind for f in scan.listing(spark, str(tmp_path / "none")).collect()] == ["path_not_found"]
    late = scan.scan_plan(scan.listing(spark, str(tmp_path), max_seconds=0.0))
    assert late.where("limit_hit").count() == 1 and late.where("action = 'index'").isEmpty()
    counts = {r.reason: r.files for r in scan.skip_counts(scan.scan_plan(scan.listing(spark, str(tmp_path), pruned=("node_*",)), max_files=3)).collect()}
    assert counts == {"limit": 7, "symlink_directory": 1, "scan_error": 1, "excluded_directory": 1}
    texts = {t.path: t.text for t in scan.texts(scan.files(spark, str(tmp_path))).collect()}
    assert texts[str(tmp_path / ".github/ci.yml")] == ".github/ci.yml" and len(texts) == 11


def test_walks_end_and_say_what_is_left(tmp_path):
    for k in range(9):
        (tmp_path / f"d{k}" / "e").mkdir(parents=True)
    rows = [r for b in listing.walk([str(tmp_path)], listing.Bounds(), 4) for r in b.to_pylist()]
    assert sum(r["kind"] == "folder" for r in rows) == 4 and sum(r["kind"] == "not_listed" for r in rows) == 8
    assert [r["kind"] for b in listing.walk([str(tmp_path)], listing.Bounds(deadline=time.time() - 1)) for r in b.to_pylist()] == ["not_listed"]


RULES = ["*.py[cod]", "\\#x", "foo\\ ", "!a.pyc", "[!a-c]og", "doc/**/*.txt", "/top", "build/", "!build/keep", "**/deep", "x[", "[[:digit:]]z", "a\\*b", "q?", "[]-]k", "\\!n", "lib/**", "sp ", "[^/]y"]
PATHS = ["b.pyc", "a.pyc", "sub/c.pyd", "b.pyx", "#x", "foo ", "foo", "dog", "bog", "doc/a.txt", "doc/x/y/a.txt", "top", "sub/top", "build/keep", "sub/build/o", "buildx", "m/deep/f", "7z", "zz", "a*b", "axb", "qq", "q", "]k", "-k", "!n", "lib/a/b", "lib", "sp", "ay", "x["]


def test_ignore_rules_are_those_of_git(spark, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / "sub").mkdir()
    (tmp_path / ".gitignore").write_text("\n".join(RULES) + "\n")
    (tmp_path / "sub" / ".gitignore").write_text("zz\n")
    paths = [*PATHS, "sub/zz"]
    # Git asks the disk what is a folder.
    for p in sorted(paths, key=len, reverse=True):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        if not (tmp_path / p).exists():
            (tmp_path / p).write_text("")
    said = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--no-index", "-z", "--stdin"], input="\0".join(p for p in paths if (tmp_path / p).is_file()), capture_output=True, text=True).stdout
    files = [p for p in paths if (tmp_path / p).is_file()]
    found = spark.createDataFrame([(f"/r/{p}",) for p in files], "path string")
    texts = spark.createDataFrame([("/r", (tmp_path / ".gitignore").read_text()), ("/r/sub", "zz\n"), ("/other", "*\n")], "folder string, text string")
    got = {r.path.removeprefix("/r/") for r in scan.gitignored(found, texts).collect()}
    assert got == {p for p in said.split("\0") if p}
    one = found.select("path", policy.ignored(F.col("path"), {"/r": (tmp_path / ".gitignore").read_text(), "/r/sub": "zz\n"}).alias("x")).where("x").collect()
    assert {r.path.removeprefix("/r/") for r in one} == got


def test_many_folders_of_rules(spark):
    texts = spark.createDataFrame([(f"/r/d{k}", "".join(f"no{j}.*\n" for j in range(60))) for k in range(40)], "folder string, text string")
    found = spark.createDataFrame([("/r/d3/a/no7.x",), ("/r/d3/yes.x",), ("/r/no7.x",)], "path string")
    assert [r.path for r in scan.gitignored(found, texts).collect()] == ["/r/d3/a/no7.x"]


def folders(s, name):
    return set(s.state()["tables"][name]["buckets"].values())


def test_a_changed_file_writes_its_buckets_alone(spark, tmp_path):
    root = tmp_path / "code"
    root.mkdir()
    for k in range(12):
        (root / f"m{k}.py").write_text(f"import lib{k}\nclass C{k}(Base{k}):\n    def f{k}(self):\n        g{k}()\n")
    e = Engine(spark, str(tmp_path / "store"))
    assert e.index(str(root))["new"] == 12
    before = {t: folders(e.store, t) for t in ("points", "contribs", "mentions", "edge_sums", "degrees", "uses", "entity_vectors")}
    was = os.stat(root / "m5.py")
    (root / "m5.py").write_text("import other\nclass C5(Base5):\n    def f5(self):\n        h5()\n")
    os.utime(root / "m5.py", ns=(was.st_atime_ns, was.st_mtime_ns + 1_000))  # within the second
    assert e.index(str(root))["changed"] == 1
    for t in ("points", "contribs", "mentions"):
        assert len(folders(e.store, t) - before[t]) == 1 and len(before[t] - folders(e.store, t)) == 1
    assert folders(e.store, "edge_sums") & before["edge_sums"] and folders(e.store, "entity_vectors") & before["entity_vectors"]
    # What was kept by changes is what is made anew.
    again = Engine(spark, str(tmp_path / "again"))
    again.index(str(root))
    for t, cols in (("edge_sums", ["edge_id", "source_id", "target_id", "weight", "n"]), ("degrees", ["entity_id", "n"]), ("uses", ["entity_id", "n"]), ("entity_vectors", ["entity_id", "name"]), ("points", ["path_key", "chunk_id", "chunk_text", "mtime_ns"])):
        assert sorted(map(tuple, e.store.read(t).select(*cols).collect())) == sorted(map(tuple, again.store.read(t).select(*cols).collect())), t
    five = e.store.read("points").where("path_key like '%m5.py'").first()
    assert (five.imported_modules, five.called_symbols, five.symbol_type, five.parent_symbol, five.line_start, five.line_end) == (["other"], ["h5"], "class", None, 1, 4)
    assert e.store.sweep(1) > 0
    assert e.store.read("points").select("path_key").distinct().count() == 12


def test_chunks_keep_columns_of_any_name_and_know_their_lines(spark):
    text = "a\n" * 400
    d = spark.createDataFrame([(1, 2, 3, text, "text")], "`__text` int, `a.b` int, c0 int, text string, file_type string")
    got = chunk.chunked(d, ["__text", "a.b", "c0"], 100, 10, lines=True).collect()
    assert got[0].__fields__[:3] == ["__text", "a.b", "c0"] and all(tuple(g)[:3] == (1, 2, 3) for g in got) and len(got) > 3
    assert all(g.line_start == text.count("\n", 0, g.start_char) + 1 and g.line_end == text.count("\n", 0, g.end_char - 1) + 1 for g in got)


def test_sums_by_changes_equal_sums_anew(spark):
    r = random.Random(11)
    schema = "root_id string, file_path string, edge_id string, source_id string, target_id string, edge_type string, weight double"

    def file(path):
        return [("r", path, f"{a}>{b}", a, b, "calls", r.choice([0.1, 1.0, 2.5])) for a, b in {(r.choice("abcde"), r.choice("abcde")) for _ in range(r.randrange(5))}]

    now = {f"/f{k}": file(f"/f{k}") for k in range(8)}
    table = lambda files: spark.createDataFrame([x for f in files for x in now[f]], schema)
    sums = graph.cut(graph.edge_sums(table(now)))
    degrees = graph.cut(graph.degree_changes(sums.limit(0), sums))
    for _ in range(4):
        paths = r.sample(sorted(now), 3)
        gone = graph.cut(table(paths))
        for p in paths:
            now[p] = file(p)
        changes = graph.cut(graph.edge_changes(gone, table(paths)))
        touched = graph.cut(sums.join(changes.select("edge_id"), "edge_id", "left_semi"))
        by = graph.cut(graph.degree_changes(touched, changes))
        degrees = graph.cut(degrees.join(by.select("entity_id"), "entity_id", "left_anti").unionByName(graph.changed_counts(degrees, by)))
        sums = graph.cut(sums.join(changes.select("edge_id"), "edge_id", "left_anti").unionByName(graph.changed_edges(touched, changes)))
        anew = graph.edge_sums(table(now))
        row = lambda t: sorted((x.edge_id, x.source_id, x.target_id, round(x.weight, 6), x.n) for x in t.collect())
        assert row(sums) == row(anew)
        count = {}
        for x in anew.collect():
            for end in {x.source_id, x.target_id}:
                count[end] = count.get(end, 0) + 1
        assert {x.entity_id: x.n for x in degrees.collect()} == count


def modularity(groups, pairs):
    of = {n: k for k, g in enumerate(groups) for n in g}
    deg = {}
    for a, b in pairs:
        for x in (a, b):
            deg[x] = deg.get(x, 0) + 1
    m = len(pairs)
    return sum(of[a] == of[b] for a, b in pairs) / m - sum((sum(deg.get(n, 0) for n in g) / 2 / m) ** 2 for g in groups)


def merged_by_force(nodes, pairs):
    """Greedy merging, one best pair at a time."""
    groups = [{n} for n in nodes]
    while True:
        now = modularity(groups, pairs)
        best = max(((modularity([g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] | groups[j]], pairs), -i, -j) for i, j in itertools.combinations(range(len(groups)), 2)), default=(0, 0, 0))
        if best[0] <= now + 1e-12:
            return now
        i, j = -best[1], -best[2]
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] | groups[j]]


def parts(rows):
    by = {}
    for x in rows:
        by.setdefault(x.group, set()).add(x.entity_id)
    return list(by.values())


def is_connected(group, pairs):
    near = {n: set() for n in group}
    for a, b in pairs:
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    seen, todo = set(), [next(iter(group))]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += near[x]
    return seen == set(group)


def random_graph(seed, n, groups):
    r = random.Random(seed)
    nodes = [f"n{k:02d}" for k in range(n)]
    pairs = {(a, b) for a, b in itertools.combinations(nodes, 2) if r.random() < (0.5 if int(a[1:]) % groups == int(b[1:]) % groups else 0.05)}
    return nodes, sorted(pairs)


@pytest.mark.parametrize("seed,n,groups", [(1, 24, 3), (2, 30, 5)])
def test_communities_by_moves_and_by_merging(spark, seed, n, groups):
    nodes, pairs = random_graph(seed, n, groups)
    e = spark.createDataFrame([("r", x) for x in nodes], "root_id string, entity_id string")
    p = spark.createDataFrame(pairs, "a string, b string")
    every = community.detect(e, p).collect()
    top = parts([x for x in every if x.level == 0])
    merged = parts(community.greedy(e, p).collect())
    force = merged_by_force(nodes, pairs)
    linked = {x for q in pairs for x in q}
    for level in {x.level for x in every}:
        assert all(is_connected(g, pairs) for g in parts([x for x in every if x.level == level]))
    assert modularity(merged, pairs) >= force - 0.05 and modularity(top, pairs) >= force - 0.02
    assert sorted(x for g in merged for x in g) == nodes and all(g <= linked or len(g) == 1 for g in merged)


def test_names_by_trigrams(spark, tmp_path):
    r = random.Random(8)
    rows = [(f"e{k}", "".join(r.choice("abcİß é") for _ in range(r.randrange(0, 9)))) for k in range(300)] + [("x", None), ("y", "")]
    e = spark.createDataFrame(rows, "entity_id string, name string").withColumn("name_lower", F.lower("name"))
    index = search.NameIndex(spark, str(tmp_path / "names")).build(e)
    for text in ("abc", "ABCA", "a", "", "bb", "é ", "ß a", "zzz", "aaaa", "cab"):
        want = search.entities_like(e, text, 1000).select("entity_id").collect()
        assert index.like(text, 1000).select("entity_id").collect() == want, text
    plan = index.like("abca", 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [folder" in plan


def test_a_key_of_a_store_stays_in_its_bucket(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), {"t": "k"}, buckets=8)
    s.publish(t=spark.range(100).select(F.col("id").cast("string").alias("k"), F.lit("a").alias("v")))
    one = s.state()["tables"]["t"]["buckets"]
    gone = spark.createDataFrame([("3",)], "k string")
    s.publish(t=store.Revision(gone, spark.createDataFrame([("3", "b")], "k string, v string")))
    two = s.state()["tables"]["t"]["buckets"]
    assert sum(one[b] != two[b] for b in one) == 1 and s.read("t").where("v = 'b'").count() == 1 and s.read("t").count() == 100
    s.publish(t=store.Revision(s.read("t").select("k"), s.read("t").limit(0)))
    assert s.read("t").isEmpty() and s.state()["tables"]["t"]["buckets"] == {}
    s.publish(t=store.Revision(gone, spark.createDataFrame([("9", "c")], "k string, v string")))
    assert [tuple(x) for x in s.read("t").collect()] == [("9", "c")]
