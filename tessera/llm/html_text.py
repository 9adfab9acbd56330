"""Operator 13: main texts of web pages by a site style tree.

The pages of a host are merged into one tree: an element is told by its path, that is by the tag, class and role of each element
down to it, and by what marks say of it. Each page is read into blocks (the runs of text between block elements), each at a path.

* Content nodes are the texts at a path. Of the m bodies of the host that have the path, k have the text: its importance is
  1 - log k / log m, 0 where all have it and 1 where one has. Bodies are counted, not pages: pages whose longest text is the
  same are one, so that copies of an article do not make each other unimportant.
* Presentation nodes are the styles of a path, the numbers of blocks that pages have there; their importance is the
  entropy of the styles over the bodies, to the base m.
* A path's importance is (1 - g) presentation + g content, g = DAMPING to the number of styles, content the mean over its texts.
  Marks come first: a path that HTML or its names mark as a menu, header, footer, sidebar, notice, advert, form, script, style
  or readers' comments (an article within an article is one) has importance 0, as has one beside the article of a page
  whose article holds LANDMARK of the text that marks leave; a path within an article has 1.

Paths and texts below IMPORTANCE are removed from each page; statistics count where a path has LEAST_BODIES bodies or more. A
branch goes when all paths below it go. Headings in a header of the article stay. If nothing were left of a page, the texts
are kept that no mark removes; and where names (not elements or roles) mark everything, they do not count within articles.

White space is what str.split takes for it; a line break (br) within a block counts as white space, and elements without text,
such as pictures, do not part it; character references are decoded as HTML does. Null html is empty, and pages without
text give an empty text. A null or malformed url has the host ''. Rows that repeat a page are rows of the result each, and one body.
Elements nested deeper than MAX_DEPTH share the path of that depth, and
those within MAX_OPEN open ones count as parts of the last. Paths and texts are told apart by 64-bit hashes.
No page's blocks are gathered from others: statistics are sums by key, and only the keys to remove go back to the pages, as a
broadcast of at most FEW_LOW numbers, and beyond that by joins.
"""

from __future__ import annotations

import hashlib
import html as html_module
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, forget, materialize
from .scans import lookup

IMPORTANCE, LEAST_BODIES, DAMPING = 0.2, 4, 0.9
LANDMARK = 0.2
MAX_DEPTH, MAX_OPEN = 64, 512
FEW_LOW = 1 << 20
CACHED = 1 << 16  # hashes of paths that a task keeps

# Names of HTML elements, roles and the words by which pages commonly name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big br button canvas cite code data datalist del dfn em font i ins kbd label mark math meter nobr object optgroup option output progress q rp rt ruby s samp select small span strike strong sub sup svg time tt u var video".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "thead": frozenset(["tbody", "tfoot"]), "tbody": frozenset(["tbody", "tfoot"]), "option": frozenset(["option", "optgroup"]), "head": frozenset(["body"]),
}
#: Elements beyond which an end tag, or an implied end, does not reach.
SCOPES = frozenset("html body table ul ol dl article section main aside nav div".split())
NOISE_TAGS = frozenset("head nav aside footer form button select input menu dialog svg canvas object audio video math".split()) | RAW
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
NOISE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "masthead topbar footer sidebar aside comment comments disqus respond cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login search share sharing social related recommended recommendations pagination pager toolbar copyright".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_DIGITS = re.compile("[0-9]+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")
#: What a name's word means after one of these is the contrary, or of the whole page.
_NOT = frozenset("no not without has with hide hidden is".split())

#: In rising order: an element within another is at least what that is.
KEEP, HEADER, NAMED, NOISE = 0, 1, 2, 3
#: What marks say of a block: nothing, that it is part of an article, that it goes, or that it stands beside an article.
PLAIN, INSIDE, MARKED, BESIDE = 0, 1, 2, 3


class Element:
    __slots__ = ("tag", "path", "depth", "verdict", "article", "block")

    def __init__(self, tag: str, path: int, depth: int, verdict: int, article: int, block: Element | None = None):
        self.tag, self.path, self.depth, self.verdict, self.article = tag, path, depth, verdict, article
        self.block = block or self  # the innermost element that is a block of its own


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), html_module.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _named_noise(names: str) -> bool:
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if any(w in NOISE_WORDS and (k == 0 or words[k - 1] not in _NOT) for k, w in enumerate(words)):
            return True
    return False


def _verdict(tag: str, a: dict[str, str], up: Element) -> int:
    """What the marks of an element, and of those around it, say of it."""
    if up.verdict == NOISE:
        return NOISE
    role = a.get("role", "").lower().strip()
    hidden = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", ""))
    if tag in NOISE_TAGS or role in NOISE_ROLES or hidden or tag == "article" and up.article:
        return NOISE
    names = f"{a.get('class', '')} {a.get('id', '')}"
    if tag == "header" or "header" in (w.lower() for w in _WORDS.findall(names)):
        return max(up.verdict, HEADER) if up.article else NOISE if tag == "header" else NAMED
    return NAMED if tag not in ("html", "body", "main") and _named_noise(names) else up.verdict


def blocks(source: str) -> list[tuple[int, str, int, int]]:
    """(path, text, verdict, article): the blocks of a page with text, in order. verdict: KEEP, NAMED (names alone mark it) or NOISE;
    article: the number of the article that it is part of, or 0."""
    n_articles, at, end = 0, 0, len(source)
    stack = [Element("", 0, 0, KEEP, 0)]
    parts: list[str] = []
    out: list[tuple] = []

    def say(text: str) -> None:
        e, block = stack[-1], stack[-1].block
        if e is block or e.verdict in (KEEP, HEADER) or block.verdict not in (KEEP, HEADER):
            parts.append(html_module.unescape(text))

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                e = stack[-1].block
                verdict = e.verdict
                if verdict == HEADER:
                    verdict = KEEP if any(x.tag in HEADINGS for x in stack) else NOISE
                out.append((e.path, text, verdict, e.article))

    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            say(source[at:])
            break
        if m.start() > at:
            say(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        inline = tag in INLINE
        if m[1]:
            if not inline:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                other = stack[k].tag
                if other == tag:
                    del stack[k:]
                    break
                if other in SCOPES and tag not in SCOPES or inline and other not in INLINE:
                    break
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else end
            continue
        if tag == "br":
            parts.append(" ")
        if tag in VOID and tag != "hr":
            continue
        if not inline:
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if tag in CLOSED_BY.get(stack[k].tag, ()):
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES:
                    break
            # Inline elements that were left open end with the block that they stand in.
            while stack[-1].tag in INLINE:
                stack.pop()
            if tag == "hr":
                continue
        a = _attributes(m[3]) if m[3].strip(" /\t\r\n") else {}
        up = stack[-1]
        verdict, article, path, depth = _verdict(tag, a, up), up.article, up.path, up.depth
        if tag == "article" and not article and not _named_noise(f"{a.get('class', '')} {a.get('id', '')}"):
            n_articles += 1
            article = n_articles
        if depth < MAX_DEPTH and not inline:
            path, depth = _path(path, tag, " ".join(sorted(a.get("class", "").split())), a.get("role", "")), depth + 1
        if len(stack) < MAX_OPEN:
            stack.append(Element(tag, path, depth, verdict, article, up.block if inline else None))
    flush()
    return out


def _hash(data: bytes, seed: int = 0) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=seed.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


_paths: dict[tuple, int] = {}


def _path(*parts) -> int:
    """A 64-bit number of a tuple, the same in every process."""
    have = _paths.get(parts)
    if have is None:
        if len(_paths) >= CACHED:
            _paths.clear()
        have = _paths[parts] = _hash(repr(parts).encode("utf-8", "surrogatepass"))
    return have


def read(url: str | None, source: str | None) -> tuple[list[str], list[int], list[int], list[int]]:
    """Of each block its text, what marks say of it, the key of its path in the tree of the host, and the key of its text there. Digits count as equal."""
    every = blocks(source or "")
    if every and all(b[2] != KEEP for b in every):  # a name around the whole page: articles count in spite of it
        every = [(*b[:2], KEEP, b[3]) if b[2] == NAMED and b[3] else b for b in every]
    sizes = [len(b[1]) if b[2] == KEEP else 0 for b in every]
    inside = sum(n for n, b in zip(sizes, every) if b[3])
    settled = inside > 0 and inside >= LANDMARK * sum(sizes)
    host = host_of(url)
    marks = [MARKED if b[2] != KEEP else INSIDE if settled and b[3] else BESIDE if settled else PLAIN for b in every]
    paths = [_path(host, b[0], m) for b, m in zip(every, marks)]
    texts = [_hash(_DIGITS.sub("0", b[1]).encode("utf-8", "surrogatepass"), p) for b, p in zip(every, paths)]
    return [b[1] for b in every], marks, paths, texts


NODES = "path long, text long, mark int, body long, style int"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page and path: the number of its blocks there, and their texts; where marks decide, one row."""
    for x in batches:
        rows: list[tuple] = []
        for url, source in zip(*(c.to_pylist() for c in x.columns)):
            said, marks, paths, texts = read(url, source)
            left = [t for t, m in zip(said, marks) if m in (PLAIN, INSIDE)] or said
            if left:
                body = _hash(max(left, key=lambda t: (len(t), t)).encode("utf-8", "surrogatepass"))
                style = Counter(paths)
                seen = {(p, t if m == PLAIN else p, m) for p, t, m in zip(paths, texts, marks)}
                rows += [(p, t, m, body, style[p]) for p, t, m in seen]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "text", "mark", "body", "style"])


def style_tree(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, mark, bodies, styles, presentation, content, importance) and, of the texts at paths that marks leave to statistics,
    (path, text, bodies, importance); both written."""
    seen = materialize(arrow_map(pages.select("url", F.col("html").cast("string").alias("html")), _nodes, NODES).distinct(), "nodes")
    styles = seen.select("path", "mark", "body", "style").distinct().groupBy("path", "mark", "style").agg(F.count("*").alias("n"))
    paths = styles.groupBy("path", "mark").agg(F.sum("n").alias("bodies"), F.count("*").alias("styles"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = F.when(F.col("bodies") > 1, 1 - F.col("s") / (F.col("bodies") * F.log("bodies"))).otherwise(1.0)
    paths = paths.withColumn("presentation", F.greatest(F.lit(0.0), entropy)).drop("s")
    texts = seen.where(F.col("mark") == PLAIN).select("path", "text", "body").distinct().groupBy("path", "text").agg(F.count("*").alias("k"))
    n_texts = texts.groupBy("path").agg(F.count("*").alias("n_texts"))
    known = materialize(paths.join(n_texts, "path"), "paths")
    texts = lookup(texts, known.select("path", "bodies", "n_texts"), ["path"], "n_texts")
    alone = F.when(F.col("bodies") > 1, 1 - F.log("k") / F.log("bodies")).otherwise(1.0)
    texts = materialize(texts.select("path", "text", "k", "bodies", F.greatest(F.lit(0.0), alone).alias("importance")), "texts")
    content = texts.groupBy("path").agg((F.sum(F.col("k") * F.col("importance")) / F.sum("k")).alias("content"))
    share = F.pow(F.lit(DAMPING), F.col("styles"))
    counted = (1 - share) * F.col("presentation") + share * F.col("content")
    by_mark = F.when(F.col("mark") == INSIDE, 1.0).when(F.col("mark") != PLAIN, 0.0).when(F.col("bodies") < LEAST_BODIES, 1.0).otherwise(counted)
    tree = materialize(paths.join(content, "path", "left").withColumn("importance", by_mark), "tree")
    forget(seen, known)
    return tree, texts


def _kept(said: list[str], marks: list[int], gone: list[bool]) -> str:
    left = [t for t, g in zip(said, gone) if not g]
    return "\n".join(left or [t for t, m in zip(said, marks) if m in (PLAIN, INSIDE)])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page (page_id, url, html)."""
    spark = pages.sparkSession
    tree, texts = style_tree(pages)
    low = tree.where(F.col("importance") < IMPORTANCE).select(F.col("path").alias("key"))
    low = materialize(low.union(texts.where((F.col("bodies") >= LEAST_BODIES) & (F.col("importance") < IMPORTANCE)).select("text")).distinct(), "low")
    own = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    few = low.count() <= FEW_LOW
    keys = np.sort(low.toArrow().column("key").to_numpy()) if few else None
    shared = spark.sparkContext.broadcast(keys)
    if not few:
        own = own.withColumns({"u1": F.xxhash64(F.lit(1), "url", "html"), "u2": F.xxhash64(F.lit(2), "url", "html")})
        own = lookup(own, _removals(own, low), ["u1", "u2"], "weight", how="left").select("page_id", "url", "html", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low_keys = shared.value
        for x in batches:
            out = []
            for i, (url, source) in enumerate(zip(x.column("url").to_pylist(), x.column("html").to_pylist())):
                said, marks, paths, texts_ = read(url, source)
                if low_keys is not None:
                    gone = (_among(low_keys, paths) | _among(low_keys, texts_)).tolist()
                else:
                    listed = set(x.column("gone")[i].as_py() or ())
                    gone = [n in listed for n in range(len(said))]
                out.append(_kept(said, marks, gone))
            yield pa.RecordBatch.from_arrays([x.column("page_id"), x.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    out = arrow_map(own, run, kind)
    forget(tree, texts)
    return out


def _among(keys: np.ndarray, own: list[int]) -> np.ndarray:
    own_ = np.array(own, np.int64)
    if not len(keys):
        return np.zeros(len(own_), bool)
    return keys[np.minimum(np.searchsorted(keys, own_), len(keys) - 1)] == own_


def _removals(own: DataFrame, low: DataFrame) -> DataFrame:
    """(u1, u2, gone, weight): of each page (u1, u2) the numbers of its blocks that go, and how many rows have the page; written."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = []
            for u1, u2, url, source in zip(*(x.column(c).to_pylist() for c in ("u1", "u2", "url", "html"))):
                _, _, paths, texts = read(url, source)
                rows += [(u1, u2, n, k) for n, both in enumerate(zip(paths, texts)) for k in both]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["u1", "u2", "n", "key"])

    rows = materialize(arrow_map(own.select("u1", "u2", "url", "html"), keys, "u1 long, u2 long, n int, key long"), "keys")
    counted = materialize(rows.groupBy("key").agg(F.count("*").alias("n_rows")).join(low, "key"), "low")
    met = lookup(rows, counted, ["key"], "n_rows").groupBy("u1", "u2", "n").agg(F.count("*").alias("w"))
    out = materialize(met.groupBy("u1", "u2").agg(F.collect_list("n").alias("gone"), F.max("w").alias("weight")), "gone")
    forget(rows, counted)
    return out


#: For pages as the test tables have them: one article each, headings and paragraphs, a few character references.
ORACLE = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') as x from pages),
b as (select page_id, url, list_transform(regexp_split_to_array(regexp_replace(x, '<br>', ' ', 'g'), '</?(?:h1|p)>'), lambda t: trim(regexp_replace(
  replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&quot;', '"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) as t from a),
c as (select page_id, url, array_to_string(list_filter(t, lambda y: y <> ''), chr(10)) as text from b)
select page_id, url, text, length(text)::bigint as n_chars from c"""
