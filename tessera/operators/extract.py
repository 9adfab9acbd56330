"""Entities from text: the record protocol of models, extraction in batches, code structure, merging, and what is embedded."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.identity import entity_id, extraction_key
from tessera.functions.scalars import embed_input, entity_text
from tessera.operators.cache import Kept, content_key
from tessera.session import cut, ship

FIELD, RECORD, DONE = "<|>", "##", "<|COMPLETE|>"
#: Chunks of a file that are extracted from, and chunks and characters of one question. Fixed values.
MAX_CHUNKS, BATCH_CHUNKS, BATCH_CHARS = 100, 4, 12_000
RETRIES = 3

PROMPT = f"""List every entity and every relationship that the text names, a record each.
An entity: ("entity"{FIELD}NAME{FIELD}TYPE{FIELD}DESCRIPTION{FIELD}CHUNKS){RECORD}
CHUNKS are the numbers of the chunks that it stands in, with commas between them; 1 where the text has no chunk marks.
Types: person, organization, technology, file, function, class, concept.
A relationship: ("relationship"{FIELD}SOURCE{FIELD}TARGET{FIELD}DESCRIPTION{FIELD}STRENGTH){RECORD}
STRENGTH is a whole number from 1 to 10. End with {DONE}"""
CONTINUE = "Some are missing. Add, in the same form, those that the text itself names."
MORE = "Is any still missing? Answer Y or N."


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Extractor(Protocol):
    """A chat model: the answer to messages of {"role", "content"}."""

    def chat(self, messages: list[dict[str, str]]) -> str: ...


class Summarizer(Protocol):
    def summarize(self, name: str, descriptions: list[str]) -> str: ...


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def record_fields(text: Column | str) -> Column:
    """The records of a model's answer as arrays of fields. One "(" before a record and one ")" after it are taken off if they are there, and
    the quotes around the first field, its tag; all else in the fields stays."""
    t = F.col(text) if isinstance(text, str) else text
    records = F.transform(F.split(t, RECORD), _stripped)
    bare = F.transform(records, lambda r: F.regexp_replace(F.regexp_replace(r, r"^\(", ""), r"\)$", ""))
    fields = F.transform(bare, lambda r: F.transform(F.split(r, r"<\|>"), _stripped))
    return F.transform(fields, lambda f: F.transform(f, lambda x, i: F.when(i == 0, F.regexp_replace(x, '^"+|"+$', "")).otherwise(x)))


def entity_array(text: Column | str) -> Column:
    """The entities of an answer, as structs (name, type, description, ordinals): records of four fields or more."""
    own = F.filter(record_fields(text), lambda r: (F.get(r, F.lit(0)) == "entity") & (F.size(r) >= 4))
    return F.transform(own, lambda r: F.struct(r[1].alias("name"), r[2].alias("type"), r[3].alias("description"), F.get(r, F.lit(4)).alias("ordinals")))


def relationship_array(text: Column | str) -> Column:
    """The relationships of an answer, as structs (source, target, description, weight): records of five fields or more whose weight is a number."""
    number = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"
    own = F.filter(record_fields(text), lambda r: (F.get(r, F.lit(0)) == "relationship") & (F.size(r) >= 5) & F.coalesce(F.get(r, F.lit(4)).rlike(number), F.lit(False)))
    return F.transform(own, lambda r: F.struct(r[1].alias("source"), r[2].alias("target"), r[3].alias("description"), r[4].try_cast("double").alias("weight")))


def entity_records(answers: DataFrame, text: str = "answer") -> DataFrame:
    """answers with (name, type, description, ordinals)."""
    return answers.select("*", F.inline(entity_array(text))).drop(text)


def relationship_records(answers: DataFrame, text: str = "answer") -> DataFrame:
    """answers with (source, target, description, weight, source_type, target_type). Types are those of the entities of the same answer with
    that name, in small letters, the last where names repeat; empty for none."""
    known = answers.withColumns({"own_entities": entity_array(text), "own_links": relationship_array(text)})
    out = known.select("*", F.inline("own_links"))

    def kind(end: str) -> Column:
        same = F.filter("own_entities", lambda e: F.lower(e["name"]) == F.lower(F.col(end)))
        return F.coalesce(F.try_element_at(same, F.lit(-1))["type"], F.lit(""))

    return out.withColumns({"source_type": kind("source"), "target_type": kind("target")}).drop(text, "own_entities", "own_links")


def ordinals_to_chunks(ordinals: Column, chunk_ids: Column) -> Column:
    """Chunk ids for "1,3"; all of them where no ordinal is known."""
    asked = F.transform(F.split(F.coalesce(ordinals, F.lit("")), ","), lambda o: F.trim(o).try_cast("int"))
    known = F.filter(asked, lambda o: o.isNotNull() & (o >= 1) & (o <= F.size(chunk_ids)))
    return F.when(F.size(known) > 0, F.array_distinct(F.transform(known, lambda o: F.element_at(chunk_ids, o)))).otherwise(chunk_ids)


def question(texts: Column) -> Column:
    """The chunks of a batch under numbered marks."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("=== CHUNK "), (i + 1).cast("string"), F.lit(" ===\n"), t)), "\n\n")


def batches(chunks: DataFrame, most_chunks: int = BATCH_CHUNKS, most_chars: int = BATCH_CHARS, per_file: int = MAX_CHUNKS) -> DataFrame:
    """(root_id, file_path, batch, chunk_ids, texts) of chunks (root_id, file_path, chunk_id, chunk_text): in order, as many to a batch as
    fit; a larger chunk is one by itself. Of a file its first per_file chunks take part, so what is collected for a file is bounded."""
    own = chunks.where(F.col("chunk_id") < per_file).groupBy("root_id", "file_path").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "chunk_text"))).alias("c"))
    numbered = own.withColumn("b", batched(F.transform("c", lambda x: x["chunk_text"]), most_chunks, most_chars))
    each = numbered.withColumn("batch", F.explode(F.sequence(F.lit(0), F.array_max("b"))))
    mine = F.filter("c", lambda x, i: F.get("b", i) == F.col("batch"))
    return each.select("root_id", "file_path", "batch", F.transform(mine, lambda x: x["chunk_id"]).alias("chunk_ids"), F.transform(mine, lambda x: x["chunk_text"]).alias("texts"))


def conversation(model: Extractor, text: str, gleanings: int) -> list[str]:
    """The answers to one question: the first, and those to at most so many requests for more, while the model says that more is missing."""

    def ask(messages: list[dict[str, str]]) -> str:
        for left in reversed(range(RETRIES)):
            try:
                return model.chat(messages)
            except Exception:
                if not left:
                    raise
        return ""

    messages = [{"role": "system", "content": PROMPT}, {"role": "user", "content": f"Text to analyze:\n\n{text}"}]
    answers = [ask(messages)]
    messages.append({"role": "assistant", "content": answers[0]})
    for _ in range(gleanings):
        messages.append({"role": "user", "content": CONTINUE})
        answers.append(ask(messages))
        messages += [{"role": "assistant", "content": answers[-1]}, {"role": "user", "content": MORE}]
        said = ask(messages)
        messages.append({"role": "assistant", "content": said})
        if not said.strip().upper().startswith("Y"):
            break
    return answers


def answered(asked: DataFrame, model: Extractor, gleanings: int = 0, kept: Kept | None = None) -> DataFrame:
    """batches() with (answers, error). Equal batches are asked once: by a key of their texts, under which the answers are joined back; with kept,
    once for all runs. A batch whose question fails has no answers and the error's name; the others go on."""
    keyed = asked.withColumn("key", extraction_key("texts"))

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in rows:
            out = []
            for text in x.q:
                try:
                    out.append((conversation(model, text, gleanings), None))
                except Exception as e:
                    out.append(([], type(e).__name__))
            yield pd.DataFrame({"key": x.key, "answers": [o[0] for o in out], "error": [o[1] for o in out]})

    ship(asked.sparkSession)
    q = keyed.select("key", question(F.col("texts")).alias("q")).dropDuplicates(["key"])
    if kept is None:
        return keyed.join(q.mapInPandas(run, "key string, answers array<string>, error string"), "key").drop("key")
    # Kept under the model's name, how often it is asked for more, and the question; failures are not kept.
    both = cut(q.withColumn("asked_key", F.col("key")).withColumn("key", content_key(model, F.concat(F.lit(f"{gleanings}\x1f"), "q"))))

    def ask(missing: DataFrame) -> DataFrame:
        said = missing.mapInPandas(run, "key string, answers array<string>, error string")
        return said.select("key", F.when(F.col("error").isNull(), F.struct("answers", "error")).alias("value"), F.col("error").alias("failed"))

    failed: list[DataFrame] = []

    def noted(missing: DataFrame) -> DataFrame:
        out = cut(ask(missing))
        failed[:] = [out.where("value is null").select("key", "failed")]
        return out.select("key", "value")

    got = kept.through("answers", both.select("key", "q"), noted).join(failed[0], "key", "left")
    once = both.join(got, "key").select(F.col("asked_key").alias("key"), F.coalesce("value.answers", F.array().cast("array<string>")).alias("answers"), F.col("failed").alias("error"))
    return keyed.join(once, "key").drop("key")


def extracted_entities(answers: DataFrame) -> DataFrame:
    """(root_id, file_path, name, type, description, chunk_id, ordinal) of answered(): a row for each entity and chunk, ordinals in order of the answers."""
    each = answers.select("root_id", "file_path", "batch", "chunk_ids", F.posexplode("answers").alias("turn", "answer"))
    named = each.select("root_id", "file_path", "batch", "chunk_ids", "turn", F.posexplode(entity_array("answer")).alias("place", "e"))
    ordinal = F.col("batch").cast("long") * 1_000_000_000 + F.col("turn").cast("long") * 1_000_000 + F.col("place")
    return named.select("root_id", "file_path", "e.name", "e.type", "e.description", ordinal.alias("ordinal"), F.explode(ordinals_to_chunks(F.col("e.ordinals"), F.col("chunk_ids"))).alias("chunk_id"))


def extracted_links(answers: DataFrame) -> DataFrame:
    """Facts (root_id, file_path, ordinal, source, source_type, target, target_type, edge_type, weight, description) of answered(), of the type related."""
    each = answers.select("root_id", "file_path", "batch", F.posexplode("answers").alias("turn", "answer"))
    each = each.select("root_id", "file_path", (F.col("batch").cast("long") * 1000 + F.col("turn")).alias("ordinal"), "answer")
    return relationship_records(each).select("root_id", "file_path", "ordinal", "source", "source_type", "target", "target_type", F.lit("related").alias("edge_type"), "weight", "description")


def merged(extracted: DataFrame, *by: str) -> DataFrame:
    """extracted (root_id, name, type, description, chunk_id, ordinal) by entity, and by more columns if given: name and type of the first,
    distinct descriptions in order, chunks; frequency: distinct chunks, 1 for what is named once."""
    e = extracted.withColumn("entity_id", entity_id("name", "type", "root_id"))
    first = F.min_by(F.struct("name", "type"), "ordinal")
    texts = F.array_distinct(F.transform(F.filter(F.sort_array(F.collect_set(F.struct("ordinal", "description"))), lambda x: x["description"] != ""), lambda x: x["description"]))
    frequency = F.when(F.count_distinct("ordinal") > 1, F.greatest(F.count_distinct("chunk_id"), F.lit(1))).otherwise(1).cast("long")
    out = e.groupBy("root_id", *by, "entity_id").agg(first.alias("x"), texts.alias("descriptions"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), frequency.alias("frequency"))
    return out.select("root_id", *by, "entity_id", F.col("x.name").alias("name"), F.col("x.type").alias("type"), F.array_join("descriptions", "; ").alias("description"), "descriptions", "chunk_ids", "frequency")


def summarized(entities: DataFrame, model: Summarizer) -> DataFrame:
    """merged() with one description where there are several: the model's, asked once for each name and list, or the first where it fails."""
    many = entities.where(F.size("descriptions") > 1).select("name", "descriptions").distinct()

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in rows:
            out = []
            for name, texts in zip(x["name"], x.descriptions):
                try:
                    out.append(model.summarize(name, list(texts)))
                except Exception:
                    out.append(texts[0])
            yield pd.DataFrame({"name": x["name"], "descriptions": x.descriptions, "summary": out})

    ship(entities.sparkSession)
    said = many.mapInPandas(run, "name string, descriptions array<string>, summary string")
    return entities.join(said, ["name", "descriptions"], "left").withColumn("description", F.coalesce("summary", "description")).select(*entities.columns)


def extracted_files(chunks: DataFrame, model: Extractor, code: DataFrame | None = None, summarizer: Summarizer | None = None, gleanings: int = 0, kept: Kept | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities by file, facts, failures) of chunks (root_id, file_path, chunk_id, chunk_text): what the model names and what the code's
    structure shows (code: code_facts()), merged for each file. failures: (file_path, batch, error)."""
    answers = answered(batches(chunks), model, gleanings, kept)
    named = extracted_entities(answers)
    if code is not None:
        named = named.unionByName(code_names(code))
    entities = merged(named, "file_path")
    facts = extracted_links(answers)
    facts = facts if code is None else facts.unionByName(code_facts(code))
    return summarized(entities, summarizer) if summarizer else entities, facts, answers.where("error is not null").select("file_path", "batch", "error")


def annotated(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """chunks (chunk_id, ...) with the sorted names of the entities in them; empty where there are none."""
    names = entities.select(F.explode("chunk_ids").alias("chunk_id"), "name").groupBy("chunk_id").agg(F.array_sort(F.collect_set("name")).alias("entity_names"))
    return chunks.join(names, "chunk_id", "left").withColumn("entity_names", F.coalesce("entity_names", F.array().cast("array<string>")))


def python_structure(source: str) -> list[tuple[str, str, str, str, int]]:
    """(kind, name, edge, target, line) of classes, functions, base classes, imports and calls; nothing for what does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple[str, str, str, str, int]] = []
    name_of = lambda n: n.id if isinstance(n, ast.Name) else n.attr if isinstance(n, ast.Attribute) else ""

    def visit(node: ast.AST, inside: str) -> None:
        for n in ast.iter_child_nodes(node):
            where = inside
            if isinstance(n, ast.ClassDef):
                out.append(("class", n.name, "", "", n.lineno))
                out.extend(("class", n.name, "inherits", name_of(b), n.lineno) for b in n.bases if name_of(b))
                where = n.name
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(("function", n.name, "", "", n.lineno))
                where = n.name
            elif isinstance(n, ast.Import):
                out.extend(("module", inside, "imports", a.name, n.lineno) for a in n.names)
            elif isinstance(n, ast.ImportFrom) and n.module:
                out.append(("module", inside, "imports", n.module, n.lineno))
            elif isinstance(n, ast.Call) and name_of(n.func):
                out.append(("function", inside, "calls", name_of(n.func), n.lineno))
            visit(n, where)

    visit(tree, "<module>")
    return out


def code_entities(files: DataFrame) -> DataFrame:
    """files (path, text) as (path, kind, name, edge_type, target, line)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame([(p, *r) for p, t in zip(x.path, x["text"]) for r in python_structure(t or "")], columns=["path", "kind", "name", "edge_type", "target", "line"])

    ship(files.sparkSession)
    return files.select("path", "text").mapInPandas(run, "path string, kind string, name string, edge_type string, target string, line int")


def _code_ends(code: DataFrame) -> DataFrame:
    """code (root_id, ...) of code_entities() with the names and types of both ends; a module is named by its path."""
    kind = F.when(F.col("edge_type") == "imports", "module").when(F.col("edge_type") == "inherits", "class").otherwise("function")
    return code.select("root_id", "path", "line", "edge_type", F.when(F.col("kind") == "module", F.col("path")).otherwise(F.col("name")).alias("source"), F.col("kind").alias("source_type"), "target", kind.alias("target_type"))


def code_names(code: DataFrame) -> DataFrame:
    """extracted_entities() of code: what is defined and the ends of its relations, without descriptions or chunks."""
    ends = F.array_compact(F.array(F.struct(F.col("source").alias("name"), F.col("source_type").alias("type")), F.when(F.col("edge_type") != "", F.struct(F.col("target").alias("name"), F.col("target_type").alias("type")))))
    each = _code_ends(code).select("root_id", F.col("path").alias("file_path"), "line", F.explode(ends).alias("e"))
    return each.select("root_id", "file_path", "e.name", "e.type", F.lit("").alias("description"), (F.lit(1 << 50) + F.col("line")).alias("ordinal"), F.lit(None).cast("int").alias("chunk_id"))


def code_facts(code: DataFrame) -> DataFrame:
    """extracted_links() of code: imports, base classes and calls."""
    return _code_ends(code).where("edge_type <> ''").select("root_id", F.col("path").alias("file_path"), F.col("line").cast("long").alias("ordinal"), "source", "source_type", "target", "target_type", "edge_type", F.lit(1.0).alias("weight"), F.lit("").alias("description"))


def linked_chunks(chunks: DataFrame, code: DataFrame) -> DataFrame:
    """chunks (path, chunk_id, line_start, line_end, ...) with what code_entities() finds on their lines: imported_modules, called_symbols, symbol_type (of the
    first definition in it) and parent_symbol (the last definition that begins before it)."""
    met = chunks.select("path", "chunk_id", "line_start", "line_end").join(code.where("line is not null"), "path")
    inside = F.col("line").between(F.col("line_start"), F.col("line_end"))
    defined = (F.col("edge_type") == "") & F.col("kind").isin("class", "function")
    names = lambda edge: F.array_sort(F.collect_set(F.when(inside & (F.col("edge_type") == edge), F.col("target"))))
    own = met.groupBy("path", "chunk_id").agg(
        names("imports").alias("imported_modules"), names("calls").alias("called_symbols"),
        F.min(F.when(inside & defined, F.struct("line", "kind")))["kind"].alias("symbol_type"), F.max(F.when((F.col("line") < F.col("line_start")) & defined, F.struct("line", "name")))["name"].alias("parent_symbol"),
    )
    none = F.array().cast("array<string>")
    out = chunks.join(own, ["path", "chunk_id"], "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("imported_modules", "called_symbols")})


def batches_of(lengths: list[int], most_items: int, most_chars: int) -> list[int]:
    """The batch number of each item: a new batch where one more item or its characters would not fit."""
    out, batch, items, chars = [], 0, 0, 0
    for n in lengths:
        if items and (items >= most_items or chars + n > most_chars):
            batch, items, chars = batch + 1, 0, 0
        items, chars = items + 1, chars + n
        out.append(batch)
    return out


def batched(chunks: Column, most_items: int, most_chars: int) -> Column:
    """batches_of() over an array of texts, as a fold of built-in functions: an array of batch numbers."""
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("items"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        new = (acc["items"] > 0) & ((acc["items"] >= most_items) | (acc["chars"] + F.length(t) > most_chars))
        batch = acc["batch"] + F.when(new, 1).otherwise(0)
        return F.struct(batch.alias("batch"), (F.when(new, 0).otherwise(acc["items"]) + 1).alias("items"), (F.when(new, 0).otherwise(acc["chars"]) + F.length(t)).alias("chars"), F.concat(acc["out"], F.array(batch)).alias("out"))

    return F.aggregate(chunks, start, step, lambda acc: acc["out"])


def embedded(rows: DataFrame, embedder: Embedder, text: str, batch: int = 100, kept: Kept | None = None) -> DataFrame:
    """rows with an embedding of text: each distinct text is embedded once, in batches, and joined back by its hash; with kept, once for all runs.
    A text that the model fails on, by itself too, has no embedding."""
    keyed = rows.withColumn("embed_key", content_key(embedder, embed_input(text)))
    todo = keyed.select("embed_key", embed_input(text).alias("t")).where("t is not null").dropDuplicates(["embed_key"])

    def one(t: str) -> list[float] | None:
        try:
            return embedder.embed([t])[0]
        except Exception:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            v: list = []
            for i in range(0, len(x), batch):
                texts = x.t.tolist()[i : i + batch]
                try:
                    v += embedder.embed(texts)
                except Exception:
                    v += map(one, texts)
            yield pd.DataFrame({"embed_key": x.embed_key, "embedding": v})

    ship(rows.sparkSession)
    ask = lambda t: t.mapInPandas(run, "embed_key string, embedding array<float>")
    if kept is None:
        said = ask(todo)
    else:
        anew = lambda missing: ask(missing.withColumnRenamed("key", "embed_key")).toDF("key", "value")
        said = kept.through("embeddings", todo.withColumnRenamed("embed_key", "key"), anew).toDF("embed_key", "embedding")
    return keyed.join(said, "embed_key", "left").drop("embed_key")


def entity_vectors(entities: DataFrame, embedder: Embedder, kept: Kept | None = None) -> DataFrame:
    """(root_id, entity_id, name, type, embedding) of entities (root_id, entity_id, name, type, description); null where the model failed.
    Ends of edges without an entity of their own are embedded by their names."""
    texts = entities.select("root_id", "entity_id", "name", "type", entity_text("name", "description").alias("text"))
    return embedded(texts, embedder, "text", kept=kept).drop("text")


def embedding_counts(vectors: DataFrame) -> DataFrame:
    """(entities_total, entities_embedded, entities_embed_failed)."""
    return vectors.agg(F.count("*").alias("entities_total"), F.count("embedding").alias("entities_embedded"), F.count_if(F.col("embedding").isNull()).alias("entities_embed_failed"))


class HashEmbedder:
    """A stand-in without a model: counts of hashed words, scaled to length one. For tests and for runs offline."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = [0.0] * self.width
            for w in t.lower().split():
                v[zlib.crc32(w.encode()) % self.width] += 1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out
