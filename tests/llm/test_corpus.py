"""The corpus operators: brute force on small corpora, exact round trips, held-out accuracy, and the odd cases of each."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, chat, common, decontaminate, jaccard_join, licenses, order, packing, paragraphs, registry, secrets, tokens, toxicity
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "one", "one two three four", "é ß 漢字 \U0001f600 " * 3, "w" * 3000, "a b c d e " * 2000]


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, None, "s", None) for i, t in enumerate(texts)], DOCS)


def odd_docs(spark):
    """Odd texts, a null id, a repeated row, and columns whose names the operators use themselves."""
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "one two three four five", "x", "y", 3), (3, "one", None, None, None)]
    d = spark.createDataFrame(rows, DOCS)
    return d.withColumns({c: F.lit(7) for c in ("fp", "n", "hit", "h", "score", "token", "component_id", "part", "is_toxic", "toxic_score", "spans", "length")})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def shingles_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def prose(r, n):
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "seven", "ocean", "maple"]) + str(r.randrange(60)) for _ in range(n))


def edited(r, text, k):
    w = text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_word_and_shingle_hashes():
    texts = ["A b\x0bc\td", None, "", "a b c d", "x y z u v x y z u v", "\xa0a b", "A B C D e f"]
    for t, s in zip(texts, common.shingle_sets(texts)):
        assert len(s) == len(shingles_of(t))
    assert list(common.shingle_sets(["A b c d"]))[0] == list(common.shingle_sets(["a B\nC d"]))[0]


def test_components(spark):
    r = random.Random(1)
    e = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for a, b in e:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in e if a != b for x in (a, b)}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


def links_by_force(rows):
    s = {i: shingles_of(t) for i, t in rows if i is not None}
    par = {i: i for i in s}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                par[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(x) for i, x in s.items()}


def test_jaccard_join_is_exact(spark):
    r = random.Random(2)
    texts = []
    for _ in range(25):
        base = prose(r, r.randrange(5, 90))
        texts += [base] + [edited(r, base, r.randrange(0, 5)) for _ in range(r.randrange(0, 6))]
    base = prose(r, 60)
    texts += [edited(r, base, r.randrange(0, 3)) for _ in range(60)] + [base] * 20
    passage = prose(r, 50)
    texts += [prose(r, 30) + " " + passage + " " + prose(r, 30) for _ in range(30)]
    texts += ["x y", "x y", "x y z", "", None]
    r.shuffle(texts)
    want, n = links_by_force(list(enumerate(texts)))
    got = jaccard_join.link(docs_of(spark, texts)).collect()
    assert {g.doc_id: g.component_id for g in got} == want and {g.doc_id: g.n_shingles for g in got} == n
    kept = {g.doc_id for g in jaccard_join.keep_one(docs_of(spark, texts)).select("doc_id").collect()}
    assert kept == {i for i, c in want.items() if i == c}


def test_jaccard_join_odd_rows(spark):
    got = jaccard_join.link(odd_docs(spark)).collect()
    assert len(got) == len(ODD) + 2
    assert [g.component_id for g in got if g.doc_id is None] == [None]
    assert {g.doc_id: g.component_id for g in got if g.doc_id is not None} == {i: i for i in range(len(ODD))}
    assert jaccard_join.link(empty(spark)).isEmpty()
    assert sorted(jaccard_join.keep_one(odd_docs(spark)).columns) == sorted(odd_docs(spark).columns)


def test_paragraphs_find_shared_passages(spark):
    r = random.Random(4)
    sentence = lambda k: " ".join(prose(r, k).split()).capitalize() + "."
    passage = " ".join(sentence(9) for _ in range(7))
    line = " ".join(sentence(10) for _ in range(8))
    near = edited(r, line, 1)
    clean = lambda: " ".join(sentence(r.randrange(6, 14)) for _ in range(12))
    texts = [clean() for _ in range(20)] + [prose(r, 5) + " " + passage + " " + prose(r, 7) + ". " + clean() for _ in range(4)] + [clean() + "\n" + t + "\n" + clean() for t in (line, near)]
    got = paragraphs.repeated(docs_of(spark, texts)).collect()
    assert {g.doc_id for g in got} == set(range(20, 26))
    for c in {g.cluster_id for g in got}:
        assert sum(g.kept for g in got if g.cluster_id == c) == 1
    for g in got:
        w = words_of(texts[g.doc_id])
        assert 0 < g.n_words <= len(w) - g.first_word
    lines = {g.doc_id for g in got if g.is_paragraph}
    assert {24, 25} <= lines
    assert paragraphs.repeated(empty(spark)).isEmpty()
    assert {g.doc_id for g in paragraphs.repeated(odd_docs(spark)).collect()} <= {7}
    assert paragraphs.removals(docs_of(spark, texts)).count() == sum(not g.kept for g in got)


def clusters_by_doc(rows):
    out = collections.defaultdict(set)
    for g in rows:
        out[g.doc_id].add(g.cluster_id)
    return out


def test_paragraph_recall_against_brute_force(spark):
    """Lines of one template (0.5 to 0.6 alike) with near copies at 0.75 or more: pairs of them meet in bands whose hub is another family."""
    r = random.Random(11)
    texts = []
    for _ in range(4):
        template = prose(r, 70)
        for _ in range(50):
            line = f"{template} {prose(r, 30)}"
            texts += [line, edited(r, line, 1)]
    short = prose(r, 31)
    texts += [short, f"{short} {short}", f"{short} {short} {short} {short}"]  # periodic: the last two have equal sets
    sets = [shingles_of(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])]
    assert len(pairs) > 180 and (402, 401) in pairs
    got = clusters_by_doc(paragraphs.repeated(docs_of(spark, texts)).where("is_paragraph").collect())
    found = [p for p in pairs if got[p[0]] & got[p[1]]]
    assert len(found) >= 0.99 * len(pairs) and (402, 401) in found


def test_rounds_of_neighbours_only_in_large_bands(spark, monkeypatch):
    """Small bands cost no rounds, and the result is the same with and without them."""
    r = random.Random(14)
    template, texts = prose(r, 70), []
    for _ in range(12):
        line = f"{template} {prose(r, 30)}"
        texts += [line, edited(r, line, 1)]
    turns, own = [], paragraphs.neighbours
    monkeypatch.setattr(paragraphs, "neighbours", lambda rows, turn: turns.append(rows.agg(F.min("c")).first()[0]) or own(rows, turn))
    without = sorted(paragraphs.repeated(docs_of(spark, texts)).collect())
    assert not turns and len({g.doc_id for g in without}) == len(texts)
    monkeypatch.setattr(paragraphs, "DENSE", 4)
    assert sorted(paragraphs.repeated(docs_of(spark, texts)).collect()) == without
    assert turns and min(turns) > 4


def test_every_passage_of_51_words_is_found(spark):
    """Wherever it begins, without stops or line ends to cut at, in the middle of other words."""
    r = random.Random(12)
    texts, want = [], []
    for k in range(60):
        passage = prose(r, 51)
        texts += [f"{prose(r, r.randrange(60))} {passage} {prose(r, r.randrange(60))}" for _ in range(2)]
        want.append((2 * k, 2 * k + 1))
    got = clusters_by_doc(paragraphs.repeated(docs_of(spark, texts)).collect())
    assert all(got[a] & got[b] for a, b in want)
    assert paragraphs.repeated(docs_of(spark, [prose(r, 200) for _ in range(30)])).isEmpty()


def test_runs_of_short_lines_and_parts_of_long_ones(spark):
    r = random.Random(13)
    sentence = lambda: " ".join(prose(r, 9).split()).capitalize() + "."
    lines = "\n".join(prose(r, 8) for _ in range(5))
    long = " ".join(sentence() for _ in range(40))
    near = " ".join(w if k % 60 else "changed" for k, w in enumerate(long.split()))
    texts = [f"{prose(r, 50)}\n{lines}\n{prose(r, 50)}", f"{prose(r, 40)}\n{edited(r, lines, 0)}\n{prose(r, 60)}", f"{prose(r, 90)} {long}", f"{near} {prose(r, 100)}", prose(r, 200)]
    got = clusters_by_doc(paragraphs.repeated(docs_of(spark, texts)).where("is_paragraph").collect())
    assert set(got) == {0, 1, 2, 3} and got[0] & got[1] and len(got[2] & got[3]) > 1


def distance_to_part(p, t):
    prev = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        cur = [i + 1]
        for j, b in enumerate(t):
            cur.append(min(prev[j] + (a != b), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def test_decontamination_equals_brute_force(spark):
    r = random.Random(5)
    items = [(i, prose(r, r.randrange(6, 14))) for i in range(12)]
    texts = [prose(r, 40) for _ in range(10)]
    for i in range(8):
        own = list(items[i][1])
        for _ in range(i % 5):
            k = r.randrange(len(own))
            own[k] = r.choice("abcxyz ")
        texts.append(prose(r, 10) + "  " + "".join(own).upper().replace(" ", "\n ") + " " + prose(r, 10))
    want = set()
    for d, t in enumerate(texts):
        for i, item in items:
            p = decontaminate.normal(item)
            k = distance_to_part(p, decontaminate.normal(t))
            if k <= int(len(p) * decontaminate.ERROR_RATE):
                want.add((d, i, k))
    b = spark.createDataFrame(items + [(None, "x"), (50, None), (51, " ")], "item_id long, text string")
    got = {(g.doc_id, g.item_id, g.distance) for g in decontaminate.contaminated(docs_of(spark, texts), b).collect()}
    assert got == want and want
    left = {g.doc_id for g in decontaminate.drop_contaminated(docs_of(spark, texts), b).collect()}
    assert left == set(range(len(texts))) - {d for d, *_ in want}
    assert decontaminate.contaminated(odd_docs(spark), b).isEmpty() and decontaminate.drop_contaminated(odd_docs(spark), b).count() == len(ODD) + 2
    assert decontaminate.contaminated(docs_of(spark, texts), b.limit(0)).isEmpty() and decontaminate.contaminated(empty(spark), b).isEmpty()


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    r = random.Random(6)
    items = [(i, prose(r, 10)) for i in range(20)]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = docs_of(spark, [prose(r, 5) + " " + t for _, t in items])
    assert {(g.doc_id, g.item_id) for g in decontaminate.contaminated(d, b).collect()} == {(i, i) for i in range(20)}
    assert decontaminate.drop_contaminated(d, b).isEmpty()


def test_ann_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)) + rng.normal(size=(8, 16))[rng.integers(0, 8, 3000)] * 2
    rows = [(i, [float(v) for v in x[i]]) for i in range(3000)]
    odd = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0] * 3), (None, [1.0] * 16), (5200, [float("inf")] * 16)]
    v = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    is_query = F.col("vec_id") % 50 == 0
    got = ann.search(v, is_query).toPandas()
    want = ann.brute_force(v, is_query)
    assert set(got.query_id) == set(want.query_id) and (got.groupby("query_id").size() == 5).all()
    both = set(zip(got.query_id, got.vec_id)) & set(zip(want.query_id, want.vec_id))
    assert len(both) / len(want) >= 0.9
    for g in got.itertuples():
        a, b = x[g.query_id], x[g.vec_id]
        assert g.query_id != g.vec_id and abs(g.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    assert got.sort_values(["query_id", "rank"]).groupby("query_id").score.apply(lambda s: s.is_monotonic_decreasing).all()
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(400)], "vec_id long, embedding array<float>")
    ties = ann.search(same, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [t.vec_id for t in ties] == [1, 2, 3, 4, 5]
    few = ann.search(same.where("vec_id < 3"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [t.vec_id for t in few] == [1, 2]
    assert ann.search(same.limit(0), F.col("vec_id") == 0).isEmpty()


@pytest.mark.parametrize("kind", ["one tight group", "tight groups", "queries unlike the rows"])
def test_ann_recall_whatever_the_rows(spark, kind):
    rng = np.random.default_rng(5)
    n, d = 6000, 32
    if kind == "one tight group":
        x = 3 * rng.normal(size=d) + 0.01 * rng.normal(size=(n, d))
    elif kind == "tight groups":
        x = 5 * rng.normal(size=(20, d))[rng.integers(0, 20, n)] + 0.05 * rng.normal(size=(n, d))
    else:
        x = rng.normal(size=d) + 0.02 * rng.normal(size=(n, d))
        x[::50] = rng.normal(size=(n // 50, d))
    v = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = ann.search(v, F.col("vec_id") % 50 == 0).toPandas(), ann.brute_force(v, F.col("vec_id") % 50 == 0)
    both = set(zip(got.query_id, got.vec_id)) & set(zip(want.query_id, want.vec_id))
    assert len(both) / len(want) >= 0.95


def test_ann_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, [float(y) for y in rng.normal(size=8)]) for i in range(600)], "vec_id long, embedding array<double>")
    got, want = ann.search(v, F.col("vec_id") % 5 == 0).toPandas(), ann.brute_force(v, F.col("vec_id") % 5 == 0)
    assert len(set(zip(got.query_id, got.vec_id)) & set(zip(want.query_id, want.vec_id))) / len(want) >= 0.9
    assert not got.duplicated(["query_id", "vec_id"]).any()


def test_license_templates(spark):
    """Texts are found with other words around them and between them, not where their rare words stand in another order."""
    from tessera.llm.license_texts import TEMPLATES

    r = random.Random(14)
    names = list(TEMPLATES)
    texts = [f"{prose(r, r.randrange(80))}\n{TEMPLATES[n][1].upper() if k % 2 else TEMPLATES[n][1]}\n{prose(r, 30)}" for k, n in enumerate(names)]
    shuffled = TEMPLATES["mit"][1].split()
    r.shuffle(shuffled)
    changed = TEMPLATES["isc"][1].replace("disclaims all", "accepts all").replace("DISCLAIMS ALL", "ACCEPTS ALL")
    texts += [" ".join(shuffled), changed, prose(r, 300) + " license software warranty " * 3000]
    got = {g.doc_id: g for g in licenses.scan(docs_of(spark, texts)).collect()}
    for k, n in enumerate(names):
        assert TEMPLATES[n][0] in got[k].labels.split(",") and got[k].score == 1.0, n
    assert got[len(names)].labels == "" and got[len(names)].score < 0.5
    assert "isc" not in got[len(names) + 1].labels and 0.5 < got[len(names) + 1].score <= 1.0
    assert got[len(names) + 2].labels == "" and got[len(names) + 2].n_words == 9300


def test_licenses_odd_rows(spark):
    texts = ["Under THE MIT-License. under the\x00mit license", "apache license, version 2.0 and CC BY-NC", None, "the mit under license", "GNU General Public License, version 3", "cc by cc by nc"]
    got = {g.doc_id: g for g in licenses.scan(docs_of(spark, texts)).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (2, 0, 4, "mit")
    assert got[1].base_labels == "apache-2,cc-by-nc" and got[2].n_words == 0 and got[2].first_word is None and got[2].labels == ""
    assert got[3].n_base == 0 and got[4].labels == "gpl-3" and got[4].base_labels == "" and got[5].first_word == 2
    assert all(0 <= g.score <= 1 for g in got.values()) and got[0].score == 1.0
    assert licenses.scan(odd_docs(spark)).count() == len(ODD) + 2 and licenses.scan(empty(spark)).isEmpty()


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.word_bpe_path())


HARD = ["İstanbul ΑΣ ς ﬁ ǅ", "ẖH̱ éÉ", "\x1ca\x1cb don't we'LL 12,5 ...!?", "x <|endoftext|> y", "a b c\x85d", "한국 漢字 \U0001f600", "w." * 50, "Σ. a., .", "KK ſ", "'s 'S it's IT'S."]


def test_word_encoder_equals_the_tokenizer(spark, whole):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + HARD
    for width in (2, 4):
        for t, got in zip(texts, tokens.WordEncoder(tokens.word_bpe_path(), width).encode(texts)):
            assert got.dtype.itemsize == width and got.tolist() == whole.encode(t, add_special_tokens=False).ids


def check_packing(rows, texts, whole, size):
    bins = collections.defaultdict(list)
    own = collections.defaultdict(list)
    for g in rows:
        bins[g.sequence_id].append((g.offset, g.length))
        own[g.doc_id].append(g)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= size
    for d, t in texts.items():
        ids = (whole.encode(t, add_special_tokens=False).ids if t else []) + [0]
        parts = sorted(own[d], key=lambda g: g.piece)
        assert [g.start for g in parts] == list(range(0, len(ids), size))
        for g in parts:
            p = ids[g.start : g.start + g.length]
            assert len(p) == g.length and zlib.crc32(np.array(p, "<u4").tobytes()) == g.ids_crc32
    return len(bins)


def test_packing(spark, whole, monkeypatch):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    rows = packing.pack(d).collect()
    n = check_packing(rows, texts, whole, packing.SIZE)
    assert n <= -(-sum(g.length for g in rows) // packing.SIZE) + 1
    monkeypatch.setattr(packing, "BLOCK", 10)
    check_packing(packing.pack(d, size=128).collect(), texts, whole, 128)
    odd = packing.pack(odd_docs(spark)).collect()
    assert len({(g.sequence_id, g.offset) for g in odd}) == len(odd) and sum(g.doc_id == 3 for g in odd) == 2
    assert packing.pack(empty(spark)).isEmpty()


def test_fullest_is_optimal():
    r = random.Random(7)
    for _ in range(200):
        left = sorted(((k, r.randrange(1, 4)) for k in r.sample(range(1, 30), r.randrange(1, 6))), reverse=True)
        room = r.randrange(0, 60)
        sums = {0}
        for k, c in left:
            sums = {s + k * i for s in sums for i in range(c + 1) if s + k * i <= room}
        got = packing.fullest(room, left)
        assert sum(k * n for k, n in got) == max(sums) and all(n <= dict(left)[k] for k, n in got)


def test_training_order(spark, whole, tmp_path, monkeypatch):
    for n in (1, 2, 3, 17, 1000):
        assert sorted(order.permuted(np.arange(n), n, 5)) == list(range(n))
    assert list(order.permuted(np.arange(100), 100, 1)) != list(order.permuted(np.arange(100), 100, 2))
    d = spark.read.parquet(f"{SF}/documents.parquet")
    order.write_shards(d, str(tmp_path / "shards"), 9, length=64, shard_bytes=20_000)
    back = order.read_shards(spark, str(tmp_path / "shards"), length=64).collect()
    assert sorted(b.slot for b in back) == list(range(len(back)))
    assert len({b.shard for b in back}) > 1
    bases = {k: (base, n) for k, _, base, n in order.shard_files(spark, str(tmp_path / "shards"), 64)}
    assert all(b.byte_offset == (b.slot - bases[b.shard][0]) * (15 + 2 * 64) for b in back)
    for slot in (0, 1, bases[2][0] - 1, bases[2][0], bases[2][0] + 3, len(back) - 1, len(back)):
        rest = order.read_from(spark, str(tmp_path / "shards"), slot, length=64).collect()
        assert sorted(rest) == sorted(b for b in back if b.slot >= slot)
    by_slot = [(b.doc_id, b.seq) for b in sorted(back, key=lambda b: b.slot)]
    assert by_slot != sorted(by_slot)
    for f in (tmp_path / "shards").glob("part-*"):
        assert f.stat().st_size % (15 + 128) == 0
    docs = collections.defaultdict(list)
    for b in back:
        docs[b.doc_id].append((b.seq, np.frombuffer(b.ids, "<u2").tolist()))
    for r in d.collect():
        assert [i for _, p in sorted(docs[r.doc_id]) for i in p] == whole.encode(r.text, add_special_tokens=False).ids + [0]
    # Texts with very many ids a byte: shards are as large as asked for, and ranges of them are read.
    r = random.Random(70)
    dense = ["".join(r.choice("0123456789abcdef") for _ in range(6000)) for _ in range(60)] + ["".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(2000)) for _ in range(60)] + [",".join(str(r.random()) for _ in range(300)) for _ in range(60)]
    monkeypatch.setattr(order, "RANGE_BYTES", 3000)
    order.write_shards(docs_of(spark, dense), str(tmp_path / "dense"), 4, length=64, shard_bytes=60_000)
    shards = order.shard_files(spark, str(tmp_path / "dense"), 64)
    assert max(n for *_, n in shards) * (15 + 128) < 1.3 * 60_000 and len(shards) > 8
    again = collections.defaultdict(list)
    for b in order.read_shards(spark, str(tmp_path / "dense"), length=64).collect():
        again[b.doc_id].append((b.seq, np.frombuffer(b.ids, "<u2").tolist()))
    for i, t in enumerate(dense):
        assert [x for _, p in sorted(again[i]) for x in p] == whole.encode(t, add_special_tokens=False).ids + [0]
    last = sum(n for *_, n in shards) - 3
    assert sorted(b.slot for b in order.read_from(spark, str(tmp_path / "dense"), last, length=64).collect()) == [last, last + 1, last + 2]
    assert order.training_order(empty(spark)).isEmpty()
    odd = order.training_order(odd_docs(spark)).collect()
    assert sum(b.doc_id is None for b in odd) == 1 and {b.doc_id for b in odd} == {None, *range(len(ODD))}


def test_secrets_base_and_field(spark):
    key = "AKIA" + "Q" * 16
    texts = [f'Token = "abcdef123" and {key} x', "password: abc", "password: abcdef token=", "f" * 24 + " " + "0" * 23, "é" * 5 + " secret='s3cr3tvalue'", "toKen = abcdefgh1", None, "AKIA123"]
    got = {g.doc_id: g for g in secrets.scan(docs_of(spark, texts)).collect()}
    assert [got[i].n_assign for i in range(8)] == [1, 0, 1, 0, 1, 0, 0, 0] and got[0].n_access == 1 and got[3].n_hex == 1
    assert got[4].spans.startswith("assign:6:") and "crf" not in got[3].base_sha256
    for i, t in enumerate(texts):
        base = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, b, k in secrets.base_spans(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
    clean = {r.doc_id: r for r in secrets.redact(docs_of(spark, texts)).collect()}
    assert key not in clean[0].text and clean[6].text is None and clean[1].text == texts[1] and clean[4].n_chars == len(clean[4].text)
    assert secrets.scan(odd_docs(spark)).count() == len(ODD) + 2 and secrets.scan(empty(spark)).isEmpty()
    assert secrets.redact(odd_docs(spark)).columns == odd_docs(spark).columns


def test_viterbi_equals_enumeration_and_field_generalises():
    import itertools

    rng = np.random.default_rng(3)
    f = secrets.Field(rng.normal(size=(secrets.BUCKETS, 3)), rng.normal(size=(3, 3)))
    for n in (1, 2, 4):
        feats = [[int(i) for i in rng.integers(0, secrets.BUCKETS, 5)] for _ in range(n)]
        e = f.scores(feats)
        value = lambda tags: f.moves[0, tags[0]] + sum(e[k, t] for k, t in enumerate(tags)) + sum(f.moves[a, b] for a, b in zip(tags, tags[1:])) + f.moves[tags[-1], 0]  # noqa: E731,B023
        assert tuple(f.viterbi(feats)) == max(itertools.product(range(3), repeat=n), key=value)
    r = random.Random(8)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    train = [f"some words token {r.choice('=:')} {hexes(r.randrange(24, 48))} more" for _ in range(60)] + [f"see {hexes(r.randrange(24, 48))} there" for _ in range(60)] + [f"call {r.randrange(10**9, 10**10)} or visit 192.168.{r.randrange(99)}.{r.randrange(99)}/index today" for _ in range(60)]
    field = secrets.fit(train)
    held = f"the token is {hexes(23)} here"  # too short for the rules
    assert [s for s in secrets.all_spans(held, field) if s[2] == 3] and not secrets.all_spans("call 5550001234 today", field)


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>user<|says|>x<|end|>\n", "\\l\\\\b", "", "é\n|["]
    for t in nasty:
        assert chat.unescape(chat.escape(t)) == t and not re.search(r"[<\[|]", chat.escape(t))
    turns = [(r, t) for t in nasty for r in ("user", "assistant", "<sys>")]
    text, mask = chat.formatted(turns)
    assert chat.parsed(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 5, None, "x"), (2, 5, None, "x"), (None, 0, "user", "lost"), (3, None, "assistant", "[a]")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(70)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1))
    got = {g.conv_id: g for g in chat.digests(chat.conversations_as_text(chat.chain(c))).collect()}
    assert {k: g.n_turns for k, g in got.items()} == {1: 2, 2: 2, None: 1, 3: 1, 9: 70}
    assert got[9].turns_sha256 == hashlib.sha256("".join(f"{'assistant' if i % 2 else 'user'}\nt{i}\n" for i in range(70)).encode()).hexdigest()
    assert got[9].loss_sha256 == hashlib.sha256("".join(f"t{i}" for i in range(1, 70, 2)).encode()).hexdigest() and got[1].loss_chars == 0
    assert chat.digests(chat.conversations_as_text(chat.chain(c.limit(0)))).isEmpty()


def test_chat_picks_the_best_branch(spark):
    m = spark.createDataFrame([(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", "then", 0.0), (1, 5, 2, "user", "other", 0.5), (2, 1, 99, "user", "orphan", 0.0)], "conv_id long, node long, parent long, role string, text string, score double")
    got = {r.conv_id: [t for _, t in chat.parsed(r.formatted)] for r in chat.conversations_as_text(m).collect()}
    assert got == {1: ["q", "good", "then"], 2: ["orphan"]}


def test_toxicity_learns_pairs_and_holds_out(spark):
    r = random.Random(9)
    plain = [f"w{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(1500):
        a, b = r.random() < 0.5, r.random() < 0.5
        w = r.choices(plain, k=8) + ["fools"] * a + ["groupx"] * b
        r.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(a and b)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {g.doc_id: g for g in toxicity.toxicity(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    held = [(got[i].score, t) for i, _, t in labels if got[i].held_out]
    assert np.mean([(s >= 0.5) == (t == 1) for s, t in held]) > 0.9
    none = toxicity.toxicity(odd_docs(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(none) == len(ODD) + 2 and all(0 <= g.score <= 1 and g.predicted == 0 for g in none)
    nulls = spark.createDataFrame([(0, None, None), (None, 1, 1), (1, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd_docs(spark), nulls).count() == len(ODD) + 2 and toxicity.toxicity(empty(spark), nulls).isEmpty()


def test_toxicity_ignores_held_out_labels(spark):
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r.doc_id: r.score for r in toxicity.toxicity(d, x).collect()} for x in (lab, flipped))
    assert one == two


def test_queries_with_sql(spark, duck):
    q, o = registry.queries(), registry.oracle_sql()
    for name in o:
        df = q[name](spark, SF)
        cols = sorted(df.columns)
        r = duck.sql(o[name])
        at = [r.columns.index(c) for c in cols]
        f = lambda v: round(v, 6) if isinstance(v, float) else v
        assert sorted(str([f(x[c]) for c in cols]) for x in df.collect()) == sorted(str([f(x[i]) for i in at]) for x in r.fetchall()), name


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = common.table(spark, SF, "documents")
    names = docs.columns
    before = docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, SF), name)
        assert docs.columns == names and docs.dtypes == common.table(spark, SF, "documents").dtypes
        assert 0.5 * before < docs.count() <= before
    left = {r.doc_id for r in docs.collect()}
    got = p.run(spark, SF).collect()
    assert {g.doc_id for g in got} == left
    bench = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(b in decontaminate.normal(r.text) for r in docs.collect() for b in bench)


def test_chat_cycles_repeats_and_branches(spark):
    kind = "conv_id string, node long, parent long, role string, text string, score double"
    cyc = [("c", 1, 1, "user", "self", 0.0), ("c", 2, 1, "assistant", "hung", 1.0), ("d", 5, 7, "user", "five", 0.0), ("d", 6, 5, "assistant", "six", 0.0), ("d", 7, 6, "user", "seven", 0.0), ("d", 8, 6, "user", "eight", 9.0)]
    rep = [("e", 1, None, "user", "b", 0.0), ("e", 1, None, "user", "a", 0.0), ("e", 2, 1, "assistant", "y", 1.0), ("e", 2, 1, "assistant", "x", 2.0), ("", 1, None, "user", "blank", 0.0), (None, 1, None, "user", "null", 0.0), (None, None, 1, "user", "no node", 5.0)]
    m = spark.createDataFrame(cyc + rep, kind).withColumns({c: F.lit(3) for c in ("c", "n", "place", "branch_", "up")})
    got = {r.conv_id: [t for _, t in chat.parsed(r.formatted)] for r in chat.conversations_as_text(m).collect()}
    assert got == {"c": ["self", "hung"], "d": ["five", "six", "eight"], "e": ["a", "x"], "": ["blank"], None: ["null"]}
    tree = spark.createDataFrame([("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "one", 1.0), ("t", 3, 1, "assistant", "two", 2.0), ("t", 4, 1, "assistant", "three", 0.5)], kind)
    two = {r.branch: [t for _, t in chat.parsed(r.formatted)] for r in chat.conversations_as_text(tree, branches=2).collect()}
    assert two == {1: ["q", "two"], 2: ["q", "one"]}
    long = spark.createDataFrame([("l", i, i + 1 if i < 40 else 0, "user", f"t{i}", 0.0) for i in range(41)], kind)
    assert [t for _, t in chat.parsed(chat.conversations_as_text(long).first().formatted)] == [f"t{i}" for i in (0, *range(40, 0, -1))]
