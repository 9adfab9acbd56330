"""Operators 11 to 13: brute force on small tables, DuckDB on the smallest, pages of several templates, odd inputs."""

import collections
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives, html_text, prefix_trie, registry, scans
from tests.conftest import SF
from tests.test_registry import norm

TURNS = "conv_id long, turn long, role string, text string, d long, c string"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_hard_negatives", "op13_html_text"])
def test_queries_equal_sql(spark, duck, name):
    df, r = registry.queries()[name](spark, SF), duck.sql(registry.oracle_sql()[name])
    assert sorted(r.columns) == sorted(df.columns)
    cols = sorted(df.columns)
    at = [r.columns.index(c) for c in cols]
    assert sorted("|".join(norm(x[c]) for c in cols) for x in df.collect()) == sorted("|".join(norm(x[i]) for i in at) for x in r.fetchall())


def test_running_values_cross_partitions(spark):
    r = random.Random(3)
    rows = [(g, i, r.randrange(-9, 9), r.random() < 0.1, r.randrange(-(2**62), 2**62)) for g, n in ((1, 3), (2, 5000), (7, 1), (8, 900)) for i in range(n)]
    got = scans.running(spark.createDataFrame(rows, "g long, i long, x long, f boolean, y long").repartition(5), ["g"], [F.col("i").desc()], sums=("x",), xors=("y",), last=("i",), when="f")
    state = collections.defaultdict(lambda: [0, 0, None])
    want = {}
    for g, i, x, f, y in sorted(rows, key=lambda t: (t[0], -t[1])):
        s = state[g]
        s[0], s[1], s[2] = s[0] + x, s[1] ^ y, i if f else s[2]
        want[g, i] = tuple(s)
    assert {(t.g, t.i): (t.run_x, t.run_y, t.run_i) for t in got.collect()} == want
    assert scans.running(spark.createDataFrame([], "g long, x long"), ["g"], [], sums=("x",)).isEmpty()


def trie_by_force(rows):
    by = collections.defaultdict(list)
    tie = lambda t: hashlib.sha256(t.encode()).hexdigest()[:16]
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", tie(text or ""), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in by.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    nodes = collections.defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = collections.defaultdict(list)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    sums = {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves, saved = int(not kids[k]), (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0)
        sums[k] = (leaves + sum(sums[x][0] for x in kids[k]), saved + sum(sums[x][1] for x in kids[k]))
    out = []
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(made[c]) == len(k))))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids[k]), *sums[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(-205, -195), -7, -3, *range(0, 40), *range(95, 110), 200, 305, 307]:
        same = r.random() < 0.3
        for t in range(r.choice([1, 2, 3, 7, 12])):
            rows.append((c, r.choice([None, t, t, t]), r.choice(["user", None, ""]) if not same else "user", f"say {t}" if same else r.choice([f"word {r.randrange(3)}", "é\U0001f600", None, ""])))
    rows += [rows[5]] * 2 + [(None, 0, "user", "x")]
    return rows


def test_tries_by_force(spark, monkeypatch):
    for seed, hot in ((1, False), (2, True)):
        if hot:  # all keys are hot, and digests come in pieces
            monkeypatch.setattr(scans, "HOT_ROWS", 2)
            monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 2)
        rows = conversations(seed)
        got = prefix_trie.trie(spark.createDataFrame([(*x, 5, "c") for x in rows], TURNS)).collect()
        assert sorted((tuple(g) for g in got), key=repr) == trie_by_force(rows)


def test_long_and_copied_conversations(spark):
    rows = [(c, t, "user", f"t{t}" if t < 290 else f"{c} {t}") for c in range(1, 5) for t in range(300)] + [(c, t, "a", "same") for c in range(400, 440) for t in range(4)]
    got = prefix_trie.trie(spark.createDataFrame([(*x, 5, "c") for x in rows], TURNS)).collect()
    assert sorted((tuple(g) for g in got), key=repr) == trie_by_force(rows)
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).isEmpty()
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b", 5, "c")], TURNS)).isEmpty()


def negatives_by_force(rows):
    own = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own[i] = (label, [math.floor(256 * x) for x in v])
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for a, (label, q) in own.items():
        if a % 100:
            continue
        s = sorted(((-clip(sum(x * y for x, y in zip(q, v))), i, lab == label) for i, (lab, v) in own.items() if i != a and len(v) == len(q)))
        for neg, p, _ in [x for x in s if x[2]][:5]:
            pos = -neg
            hit = [(i, -m) for m, i, same in s if not same and 80 * pos <= -100 * m <= 100 * pos][:5]
            out += [(a, p, r + 1, i, pos, m) for r, (i, m) in enumerate(hit)]
    return sorted(out)


def rows_of_vectors(seed, n=420):
    r = random.Random(seed)
    hot = [r.gauss(0, 1) for _ in range(6)]
    rows = []
    for i in range(n):
        v = hot if r.random() < 0.3 else [r.choice([0.0, 0.5, 1.0]) for _ in range(6)] if r.random() < 0.5 else [r.gauss(0.3, 1) for _ in range(6)]
        rows.append((i * (r.choice([1, 1, 1, -1]) if i else 1), r.randrange(3), v))
    rows += [(1000, 1, [1.0, 2.0]), (1001, 1, [2.0, 1.0]), (1002, 0, [1.0, 1.5]), (1100, 2, []), (1101, 2, []), (1102, 0, [])]
    rows += [(1200, 0, [1e30, -1e30]), (1201, 0, [3.0, -1e25]), (1202, 1, [1e29, 2.0]), (1203, 0, [-1e30, 1.0])]
    rows += [(1300, None, hot), (1301, 0, None), (None, 0, hot), (1302, 0, [None] * 6), (1400, 0, [float("nan")] * 6), (1500, 0, [float("inf")] * 6)]
    return rows


VECTORS = "vec_id long, label int, embedding array<double>, d string, ring string, sq int"


def test_negatives_by_force(spark, monkeypatch):
    for seed, small in ((4, False), (5, True)):
        if small:  # many rounds, and rings in many blocks
            for name, value in (("FIRST", 8), ("GROWTH", 2), ("BLOCK", 16), ("QUERY_BLOCK", 2), ("ROWS_PER_PIVOT", 20)):
                monkeypatch.setattr(hard_negatives, name, value)
            monkeypatch.setattr(scans, "HOT_ROWS", 3)
        rows = rows_of_vectors(seed)
        v = spark.createDataFrame([(*x, "d", "r", 1) for x in rows], VECTORS)
        got = hard_negatives.mine(v, F.col("vec_id") % 100 == 0).collect()
        want = negatives_by_force(rows)
        assert sorted(tuple(g) for g in got) == want and len(want) > 50
    # A repeated id counts once, and one that takes no part does not hide another.
    again = v.union(v.where("vec_id % 5 = 0")).union(spark.createDataFrame([(100, None, [9.0] * 6, "d", "r", 1), (100, 1, [float("nan")] * 6, "d", "r", 1)], VECTORS))
    assert sorted(tuple(g) for g in hard_negatives.mine(again, F.col("vec_id") % 100 == 0).collect()) == want
    assert hard_negatives.mine(v.limit(0), F.col("vec_id") % 100 == 0).isEmpty()
    assert hard_negatives.mine(v, F.col("vec_id") < -10**9).isEmpty()


PAGES = "page_id long, url string, html string, mark int, text string"


def extracted(spark, pages):
    got = html_text.extract(spark.createDataFrame([(*p, 1, "t") for p in pages], PAGES)).collect()
    assert all(g.n_chars == len(g.text) for g in got) and len(got) == len(pages)
    return {g.page_id: g.text for g in got}


def said(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def templates(seed):
    """Pages of hosts with templates of their own, and their main texts."""
    r = random.Random(seed)
    pages, want = [], {}
    for k in range(160):
        paras = [said(r, r.randrange(8, 40)) for _ in range(r.randrange(2, 7))]
        if k % 16 == 8:  # a copy of an earlier article
            paras = want[k - 8].split("\n")
        host, body = k % 4, "".join(f"<p>{p}</p>" for p in paras)
        menu = "<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/a'>About us</a></li></ul>"
        if host == 0:  # marks of HTML
            page = f"<body><header><h1>Site</h1></header><nav>{menu}</nav><article>{body}<aside>See also {said(r, 3)}</aside></article><footer>&copy; {said(r, 2)}</footer>"
        elif host == 1:  # names
            page = f"<div class='top-menu'>{menu}</div><div class='cookie-notice'>We use cookies {said(r, 2)}</div><div class=post>{body}</div><div id=comments><p>{said(r, 9)}</p></div><form>Mail <input></form>"
        elif host == 2:  # nothing but repetition
            page = f"<div class=x1>{menu}</div><div class=x2><div class=x3>{body}</div><div class=x4>Call us today on {k * 7} numbers</div></div><div class=x5>All rights reserved</div>"
        else:  # an article within a page that has more around it
            page = f"<div class=x1>{said(r, 6)}</div><main><article><header><h1>{paras[0]}</h1><p>by {said(r, 2)}</p></header>{''.join(f'<p>{p}' for p in paras[1:])}<section class='comments'><article><p>{said(r, 8)}</p></article></section></article></main>"
        pages.append((k, f"https://www.h{host}.example/{k}", page))
        want[k] = "\n".join(paras)
    return pages, want


def test_main_texts_of_templates(spark, monkeypatch):
    pages, want = templates(6)
    assert extracted(spark, pages) == want
    monkeypatch.setattr(html_text, "FEW_LOW", 0)  # removals go back by joins
    monkeypatch.setattr(scans, "HOT_ROWS", 3)
    assert extracted(spark, [*pages, *((1000 + p[0], *p[1:]) for p in pages[:6])]) == {**want, **{1000 + k: want[k] for k in range(6)}}


def test_odd_pages(spark):
    pages = [
        (1, None, None), (2, "x", ""), (3, "http://[", "only  text &amp; &#x41;&nbsp;more"), (4, "//h/p", "<p>a<br>b<p>c <b>d</b>e<script>x</script>f<div hidden>no</div>"),
        (5, "http://u@H.example:8/", "<article>" + "word " * 60_000 + "</article>"), (6, "http://h", "<div>" * 5000 + "deep" + "<b>" * 5000 + " x"), (7, "http://h", "<nav>menu</nav><script>"),
        (8, "http://h", "<!-- <p>no</p> --><p title='a>b'>yes</p><style>p{}</style><![CDATA[raw]]>"), (None, "http://h", "<p>null id"), (9, "http://h", "<p>tail &am"),
        (10, "http://h", "<div class='page has-sidebar'><div class='post'>kept</div><div class='sidebar'>gone</div></div>"), (11, "http://h", "<div class='comments-on'><article>kept</article></div>"),
        (12, "http://h", "<table><tr><td>a<td>b<tr><td>c</table><p>x <span class='share-bar'>no</span> <select><option>1</select>y"),
    ]
    got = extracted(spark, pages)
    assert {k: v for k, v in got.items() if k not in (5, 6)} == {
        1: "", 2: "", 3: "only text & A more", 4: "a b\nc def", 7: "", 8: "yes\nraw", None: "null id", 9: "tail &am", 10: "kept", 11: "kept", 12: "a\nb\nc\nx y",
    }
    assert got[5] == " ".join(["word"] * 60_000) and got[6] == "deep x"
    assert html_text.extract(spark.createDataFrame([], PAGES)).isEmpty()


def test_copies_do_not_make_an_article_unimportant(spark):
    r = random.Random(9)
    text, page = said(r, 30), "<div class=a>Home page</div><div class=b><p>{}</p><p>{}</p></div>"
    pages = [(k, "http://h/", page.format(text, "the same end")) for k in range(40)] + [(100 + k, "http://h/", page.format(said(r, 30), said(r, 5))) for k in range(20)]
    got = extracted(spark, pages)
    assert all(got[k] == text + "\nthe same end" for k in range(40)) and all("Home" not in t for t in got.values())


def test_importance_of_content_and_presentation(spark):
    """By hand: four bodies; a text in all of them, one in two, and paths with one and with four styles."""
    pages = [(k, "http://h/", f"<i class=q>s</i><div class=m>all</div><div class=n>{'half' if k < 2 else 'h' * k}</div>" + "".join(f"<p>{k} {j} {'w' * (9 + k)}</p>" for j in range(k + 1))) for k in range(4)]
    tree, texts = html_text.style_tree(spark.createDataFrame([(*p, 1, "t") for p in pages], PAGES))
    found = sorted((round(x.importance, 6), x.bodies) for x in texts.collect())
    assert found[0] == (0.0, 4) and (0.5, 4) in found
    shown = sorted((x.styles, round(x.presentation, 6)) for x in tree.collect())
    assert shown[0] == (1, 0.0) and shown[-1] == (4, 1.0)


