"""Operator 4: license scans, with DataFrame functions only.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the whole text with A-Z lower-cased. There are templates of
two kinds: licence texts and notices of up to some two hundred words (license_texts), and short phrases, the base ones of the
contract among them. The index holds postings (template, place) of each template's anchors: of the words that stand in it
once, the ANCHORS rarest by inverse document frequency over all documents (PHRASE_ANCHORS for a phrase), ties to the smaller
word. A file looks up the anchors that it has; every posting votes for the place where the template would begin. A licence
text is found where half of its anchors agree and its mandatory key phrases stand at their places from there; a phrase
where all of its anchors agree and all of its words stand there. As every place of a phrase has its anchors, no phrase is
lost. All is done within a row, so nothing is shuffled but the document frequencies of the template words.

Nulls: a null text counts as empty; a null doc_id stays. Rows that repeat give repeated rows. Other columns are ignored.
Empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

#: The base phrases of the contract, and those that the method adds.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
MORE = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "this is free and unencumbered software": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
ANCHORS, PHRASE_ANCHORS = 12, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A vote is one number: the template, then the place where it begins, moved so that it is never negative.
PLACES = 1 << 40


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, tuple[str, ...]], ...]  # mandatory phrases and their places
    is_phrase: bool

    def once(self) -> dict[str, int]:
        """The words that stand in the template once, and their places."""
        return {w: k for k, w in enumerate(self.words) if self.words.count(w) == 1}

    def need(self, n_anchors: int) -> int:
        return n_anchors if self.is_phrase else -(-n_anchors // 2)


def words_of(text: str) -> tuple[str, ...]:
    return tuple(filter(None, re.split(APART, text.translate(str.maketrans(UPPER, LOWER)))))


def templates() -> list[Template]:
    """Phrases first, the base ones before the others."""
    out = [Template(label, words_of(p), ((0, words_of(p)),), True) for p, label in {**BASE, **MORE}.items()]
    for label, text, keys in TEMPLATES.values():
        own = words_of(text)
        places = []
        for k in map(words_of, keys):
            places.append((next(i for i in range(len(own)) if own[i : i + len(k)] == k), k))
        out.append(Template(label, own, tuple(places), False))
    return out


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), APART), lambda w: w != "")


def vocabulary() -> list[str]:
    return sorted({w for t in templates() for w in t.once()})


def frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of documents, and for each template word that of the documents with it: a row a word, for all documents."""
    vocab = F.array(*map(F.lit, vocabulary()))
    # The empty string stands for the document itself.
    seen = docs.select(F.explode(F.array_union(F.array(F.lit("")), F.array_intersect(words(F.col("text")), vocab))).alias("word"))
    df = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return df.pop("", 0), df


def weights(n_docs: int, df: dict[str, int]) -> dict[str, float]:
    """ln((1 + documents) / (1 + documents with the word)), to 6 places."""
    return {w: round(math.log((1 + n_docs) / (1 + df.get(w, 0))), 6) for w in vocabulary()}


def anchors(t: Template, idf: dict[str, float]) -> list[tuple[str, int]]:
    """The rarest words that stand once in a template, and their places."""
    own = t.once()
    return [(w, own[w]) for w in sorted(own, key=lambda w: (-idf[w], w))[: PHRASE_ANCHORS if t.is_phrase else ANCHORS]]


def scan(docs: DataFrame, idf: dict[str, float] | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: 1 where a template is found; else the largest share of a licence text's anchors, two at least, that stand as in it.
    """
    idf = idf or weights(*frequencies(docs))
    every = templates()
    index = [anchors(t, idf) for t in every]
    postings: dict[str, list[int]] = {}
    for k, own in enumerate(index):
        for w, p in own:
            postings.setdefault(w, []).append(k * PLACES + PLACES // 2 - p)
    rare = sorted(postings)
    lookup = F.create_map(*(x for w in rare for x in (F.lit(w), F.array(*(F.lit(v).cast("long") for v in postings[w])))))
    needs = F.array(*(F.lit(t.need(len(own))) for t, own in zip(every, index)))
    keys = F.array(*(F.array(*(F.struct(F.lit(q).alias("q"), F.array(*map(F.lit, p)).alias("p")) for q, p in t.keys)) for t in every))
    n_phrases, n_base = len(BASE) + len(MORE), len(BASE)
    none = F.expr("cast(array() as array<bigint>)")

    w = docs.select("doc_id", words(F.col("text")).alias("w"))
    # The file's anchors, and the votes of their postings; most files have none.
    hits = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("at"), x.alias("word"))), lambda s: s["word"].isin(rare))
    votes = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(lookup, h["word"]), lambda v: v + h["at"])))
    voted = w.select("doc_id", "w", F.when(F.arrays_overlap("w", F.array(*map(F.lit, rare))), F.sort_array(votes)).otherwise(none).alias("votes"))

    template = lambda v: F.floor(v / PLACES).cast("int")
    start = lambda v: (v % PLACES - PLACES // 2).cast("int")
    # In order, equal votes stand together: one begins a run of at least n where the vote n - 1 further on is the same.
    agreed = F.array_distinct(F.filter("votes", lambda v, i: F.coalesce(F.get("votes", i + F.get(needs, template(v)) - 1) == v, F.lit(False))))
    stands = lambda v, key: (start(v) + key["q"] >= 0) & (F.slice("w", F.greatest(start(v) + key["q"], F.lit(0)) + 1, F.size(key["p"])) == key["p"])
    found = F.filter(agreed, lambda v: F.forall(F.get(keys, template(v)), lambda key: stands(v, key)))
    placed = voted.select("doc_id", F.size("w").cast("long").alias("n_words"), "votes", F.when(F.size("votes") > 0, found).otherwise(none).alias("found"))
    base = placed.withColumn("base", F.transform(F.filter("found", lambda v: template(v) < n_base), start))

    names = F.array(*(F.lit(t.label) for t in every))
    joined = lambda which: F.array_join(F.array_sort(F.array_distinct(F.transform(which, lambda v: F.get(names, template(v))))), ",")
    begin = F.struct(F.lit(-1).cast("long").alias("v"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def count(acc: Column, v: Column) -> Column:
        run = F.when(v == acc["v"], acc["run"] + 1).otherwise(1)
        return F.struct(v.alias("v"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    most = F.aggregate(F.filter("votes", lambda v: v >= n_phrases * PLACES), begin, count, lambda acc: acc["best"])
    score = F.when(F.size("found") > 0, 1.0).when((F.size("votes") > 0) & (most >= 2), F.least(F.lit(1.0), F.round(most / ANCHORS, 6))).otherwise(0.0)
    return base.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base").cast("long").alias("first_word"), F.array_max("base").cast("long").alias("last_word"), joined(F.filter("found", lambda v: template(v) < n_base)).alias("base_labels"), joined(F.col("found")).alias("labels"), score.alias("score"))


def oracle() -> str:
    """DuckDB SQL for scan() over the view documents: postings of all words as a table, votes by grouping."""
    every = templates()
    quote = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    apart = "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
    n_phrases, n_base = len(BASE) + len(MORE), len(BASE)
    once = ", ".join(f"({k}, '{w}', {p})" for k, t in enumerate(every) for w, p in t.once().items())
    keys = ", ".join(f"({k}, {q}, {quote(p)})" for k, t in enumerate(every) for q, p in t.keys)
    labels = ", ".join(f"({k}, '{t.label}')" for k, t in enumerate(every))
    return f"""
with d as (select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {apart}), lambda x: x <> '') as w from documents),
n as (select count(*) as n from d),
t(k, word, pos) as (values {once}),
label(k, label) as (values {labels}),
keys(k, q, p) as (values {keys}),
places as (select r, unnest(w) as word, unnest(range(len(w))) as place from d),
seen as (select * from places where word in (select word from t)),
df as (select word, count(distinct r) as c from seen group by word),
idf as (select k, t.word, pos, round(ln((1 + n.n) / (1 + coalesce(c, 0))), 6) as x from t cross join n left join df on df.word = t.word),
anchors as (select * from (select *, row_number() over (partition by k order by x desc, word) as o from idf) where o <= case when k < {n_phrases} then {PHRASE_ANCHORS} else {ANCHORS} end),
needs as (select k, case when k < {n_phrases} then count(*) else ceil(count(*) / 2.0) end as need from anchors group by k),
votes as (select r, k, place - pos as o, count(*) as v from seen join anchors using (word) group by all),
agreed as (select r, votes.k, o, w from votes join needs using (k) join d using (r) where v >= need),
found as (select r, agreed.k, o from agreed join keys using (k) group by r, agreed.k, o having bool_and(o + q >= 0 and w[o + q + 1 : o + q + len(p)] = p)),
one as (select r, count(*) filter (where k < {n_base}) as n_base, min(o) filter (where k < {n_base}) as first_word, max(o) filter (where k < {n_base}) as last_word, list_sort(list(distinct label) filter (where k < {n_base})) as b, list_sort(list(distinct label)) as l from found join label using (k) group by r),
most as (select r, max(v) as v from votes where k >= {n_phrases} group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(array_to_string(b, ','), '') as base_labels, coalesce(array_to_string(l, ','), '') as labels,
       case when one.r is not null then 1.0 when most.v >= 2 then least(1.0, round(most.v / {ANCHORS}::double, 6)) else 0.0 end::double as score
from d left join one using (r) left join most using (r)"""
