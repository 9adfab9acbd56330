"""The entity graph: edges from contributions of files, degrees, callers, neighbourhoods, community facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.identity import edge_id, entity_id, entity_key
from tessera.session import cut


def _by_keys(facts: DataFrame) -> DataFrame:
    """The last fact of each file and edge, edges by the keys of their ends: nothing is hashed before rows are fewer.

    Rows lie by edge, which serves the groups by file and edge and the sums by edge that follow: one shuffle for both."""
    f = facts.select("root_id", "file_path", entity_key("source", "source_type", "root_id").alias("source_key"), entity_key("target", "target_type", "root_id").alias("target_key"), "edge_type", "ordinal", "weight", "description")
    f = f.repartition("root_id", "source_key", "target_key", "edge_type")
    last = F.max(F.struct("ordinal", "weight", "description"))
    return f.groupBy("root_id", "file_path", "source_key", "target_key", "edge_type").agg(last.alias("x")).select("root_id", "file_path", "source_key", "target_key", "edge_type", "x.weight", "x.description")


def _hashed(keyed: DataFrame) -> DataFrame:
    """keyed with edge_id, source_id and target_id."""
    out = keyed.withColumns({"source_id": F.sha2("source_key", 256), "target_id": F.sha2("target_key", 256)})
    return out.withColumn("edge_id", edge_id("source_id", "target_id", "edge_type", "root_id"))


def contributions(facts: DataFrame, keyed: bool = False) -> DataFrame:
    """facts (root_id, file_path, ordinal, source, source_type, target, target_type, edge_type, weight, description) as edge
    contributions: one for each edge and file, the last of the file by ordinal, then by weight and description.
    Keyed, they have source_key and target_key in place of ids, for sums that hash what is left."""
    if keyed:
        return _by_keys(facts)
    return _hashed(_by_keys(facts)).select("root_id", "file_path", "edge_id", "source_id", "target_id", "edge_type", "weight", "description")


def _summed() -> tuple[Column, Column]:
    """Weights summed; descriptions in order of their files."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("description") != "", F.struct("file_path", "description")))), lambda x: x["description"]), " | ")
    return F.sum("weight").alias("weight"), text.alias("description")


def edges(contribs: DataFrame) -> DataFrame:
    """Edges as sums of their stored contributions, or of keyed ones: then ids are made once for each edge."""
    if "source_key" in contribs.columns:
        return _hashed(contribs.groupBy("root_id", "source_key", "target_key", "edge_type").agg(*_summed()))
    return contribs.groupBy("root_id", "edge_id", "source_id", "target_id", "edge_type").agg(*_summed())


def edges_of(facts: DataFrame) -> DataFrame:
    """edges(contributions(facts)), with the keys of the ends: ids are made once for each edge."""
    return edges(contributions(facts, keyed=True))


# Stored sums, kept by signed changes: only keys that a change names are touched.
SUMS = ["root_id", "edge_id", "source_id", "target_id", "edge_type"]


def edge_changes(gone: DataFrame, new: DataFrame) -> DataFrame:
    """(edge keys, weight, n): what edge sums change by when contributions `gone` are taken back and `new` ones come; edges without a change are left out."""
    signed = lambda c, sign: c.select(*SUMS, (F.col("weight") * F.lit(sign)).alias("weight"), F.lit(int(sign)).cast("long").alias("n"))
    d = signed(gone, -1.0).unionByName(signed(new, 1.0)).groupBy(*SUMS).agg(F.round(F.sum("weight"), 9).alias("weight"), F.sum("n").alias("n"))
    return d.where("weight <> 0 or n <> 0")


def edge_sums(contribs: DataFrame) -> DataFrame:
    """(edge keys, weight, n): edges with summed weights and the number of their contributions, all anew."""
    return contribs.groupBy(*SUMS).agg(F.round(F.sum("weight"), 9).alias("weight"), F.count("*").alias("n"))


def changed_edges(old: DataFrame, changes: DataFrame) -> DataFrame:
    """The sums of the edges that changes name, as they are afterwards; edges without contributions are gone. old: edge_sums() that hold those edges."""
    c = changes.select("root_id", "edge_id", *(F.col(x).alias(f"c_{x}") for x in (*SUMS[2:], "weight", "n")))
    both = old.join(c, ["root_id", "edge_id"], "right")
    zero = F.lit(0)
    out = both.select("root_id", "edge_id", *(F.coalesce(x, f"c_{x}").alias(x) for x in SUMS[2:]), F.round(F.coalesce("weight", zero) + F.col("c_weight"), 9).alias("weight"), (F.coalesce("n", zero) + F.col("c_n")).alias("n"))
    return out.where("n > 0")


def degree_changes(old: DataFrame, changes: DataFrame) -> DataFrame:
    """(root_id, entity_id, n): what degrees change by, from the edges that changes let appear (+1) or vanish (-1); a loop counts once."""
    was = old.select("root_id", "edge_id", F.col("n").alias("was"))
    c = changes.join(was, ["root_id", "edge_id"], "left").withColumn("was", F.coalesce("was", F.lit(0)))
    sign = F.when((F.col("was") == 0) & (F.col("n") > 0), 1).when((F.col("was") > 0) & (F.col("was") + F.col("n") <= 0), -1).otherwise(0).cast("long")
    ends = c.select("root_id", sign.alias("sign"), F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("entity_id")).where("sign <> 0")
    return ends.groupBy("root_id", "entity_id").agg(F.sum("sign").alias("n")).where("n <> 0")


def use_changes(gone: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(root_id, entity_id, n): by how much the uses of entities change, which are mentions and ends of contributions. Both: (mentions, contributions)."""

    def uses(mentions: DataFrame, contribs: DataFrame, sign: int) -> DataFrame:
        ends = contribs.select("root_id", F.explode(F.array("source_id", "target_id")).alias("entity_id"))
        return mentions.select("root_id", "entity_id").union(ends).withColumn("n", F.lit(sign).cast("long"))

    return uses(*gone, -1).union(uses(*new, 1)).groupBy("root_id", "entity_id").agg(F.sum("n").alias("n")).where("n <> 0")


def changed_counts(old: DataFrame, changes: DataFrame) -> DataFrame:
    """The counts (root_id, entity_id, n) that changes name, as they are afterwards, without those that have come to nothing."""
    c = changes.select("root_id", "entity_id", F.col("n").alias("by"))
    out = old.join(c, ["root_id", "entity_id"], "right").select("root_id", "entity_id", (F.coalesce("n", F.lit(0)) + F.col("by")).alias("n"))
    return out.where("n > 0")


def degrees(entities: DataFrame, edge_table: DataFrame) -> DataFrame:
    """entities (entity_id, ...) with their degree: the edges that touch them, a loop once."""
    keyed = "source_key" in edge_table.columns
    two = ("source_key", "target_key") if keyed else ("source_id", "target_id")
    ends = edge_table.select(F.explode(F.array_distinct(F.array(*two))).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("degree"))
    ends = ends.withColumn("entity_id", F.sha2("entity_id", 256)) if keyed else ends
    return entities.join(ends, "entity_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def callers(entities: DataFrame, edge_table: DataFrame, name: str) -> DataFrame:
    """Entities with a calls edge to the entity of that name: the first by id where names repeat."""
    target = entities.where(F.col("name_lower") == name.lower()).orderBy("entity_id").limit(1).select(F.col("entity_id").alias("target_id"))
    into = edge_table.where(F.col("edge_type") == "calls").join(F.broadcast(target), "target_id").select(F.col("source_id").alias("entity_id")).distinct()
    return entities.join(into, "entity_id", "left_semi")


def neighbours(edge_table: DataFrame, seeds: DataFrame, depth: int, edge_types: list[str] | None = None) -> DataFrame:
    """(entity_id, hops): what is within depth undirected steps of the seeds, each once with its fewest steps, without the seeds.

    Only the frontier is expanded; what was seen is taken out by an anti-join, and lineage is cut at each step. Edges with keys are kept by
    them, which are shorter than ids.
    """
    e = edge_table if edge_types is None else edge_table.where(F.col("edge_type").isin(edge_types))
    keyed = "source_key" in e.columns
    source, target = ("source_key", "target_key") if keyed else ("source_id", "target_id")
    id_of = (lambda c: F.sha2(c, 256)) if keyed else F.col
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = e.where(F.col(source) != F.col(target)).select(F.explode(F.array(way(source, target), way(target, source))).alias("x")).select("x.a", "x.b")
    seen = frontier = seeds.select("entity_id").distinct().withColumn("hops", F.lit(0))
    both = cut(both) if depth > 1 else both  # read at every step, so made once
    for k in range(1, depth + 1):
        step = frontier.join(both, frontier.entity_id == id_of("a")).select("b").distinct().select(id_of("b").alias("entity_id"))
        frontier = cut(step.join(seen, "entity_id", "left_anti").withColumn("hops", F.lit(k)))
        seen = seen.union(frontier)
    return seen.where("hops > 0")


def undirected(edge_table: DataFrame) -> DataFrame:
    """(a, b, weight, description): both directions summed, loops dropped."""
    keyed = "source_key" in edge_table.columns
    source, target = ("source_key", "target_key") if keyed else ("source_id", "target_id")
    e = edge_table.where(F.col(source) != F.col(target)).select(F.least(source, target).alias("a"), F.greatest(source, target).alias("b"), "weight", "edge_id", F.coalesce("description", F.lit("")).alias("description"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("description") != "", F.struct("edge_id", "description")))), lambda x: x["description"]), "; ")
    out = e.groupBy("a", "b").agg(F.sum("weight").alias("weight"), text.alias("description"))
    if not keyed:
        return out
    ids = out.withColumns({"a": F.sha2("a", 256), "b": F.sha2("b", 256)})
    return ids.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight", "description")


def internal_edges(edge_table: DataFrame, members: DataFrame) -> DataFrame:
    """(community_id, edge columns): edges with both ends in one community. members: (community_id, entity_id). Edges (root_id, source_key,
    target_key, edge_type, ...) get their ids when those between communities are gone."""
    if "source_key" in edge_table.columns:
        s, t = (members.select(F.col("community_id").alias(c), F.col("entity_id").alias(i)) for c, i in (("community_id", "_s"), ("_c", "_t")))
        own = edge_table.join(s, F.sha2("source_key", 256) == s["_s"]).drop("_s")
        return _hashed(own.join(t, (F.sha2("target_key", 256) == t["_t"]) & (own["community_id"] == t["_c"])).drop("_t", "_c"))
    s = members.select("community_id", F.col("entity_id").alias("source_id"))
    t = members.select("community_id", F.col("entity_id").alias("target_id"))
    return edge_table.join(s, "source_id").join(t, ["community_id", "target_id"])


def community_facts(entities: DataFrame, edge_table: DataFrame, members: DataFrame) -> DataFrame:
    """(community_id, names, files, edge_count): sorted names and files of the members, and the edges among them."""
    own = members.join(entities.select("entity_id", "name", "file_paths"), "entity_id")
    files = own.select("community_id", F.explode_outer("file_paths").alias("f")).groupBy("community_id").agg(F.array_sort(F.collect_set("f")).alias("files"))
    names = own.groupBy("community_id").agg(F.sort_array(F.collect_list("name")).alias("names"))
    count = internal_edges(edge_table, members).groupBy("community_id").agg(F.count("*").alias("edge_count"))
    return names.join(files, "community_id").join(count, "community_id", "left").withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))


def top_edges(entities: DataFrame, edge_table: DataFrame, members: DataFrame, k: int = 15) -> DataFrame:
    """The first k edges of each community by the names of their ends."""
    n = entities.select("entity_id", "name")
    e = internal_edges(edge_table, members).join(n.withColumnsRenamed({"entity_id": "source_id", "name": "source_name"}), "source_id").join(n.withColumnsRenamed({"entity_id": "target_id", "name": "target_name"}), "target_id")
    w = Window.partitionBy("community_id").orderBy("source_name", "target_name", "edge_id")
    return e.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def hierarchy(levels: list[DataFrame]) -> DataFrame | None:
    """(level, community_id, entity_id, parent_id) of levels (community_id, entity_id), coarsest first: each community's parent is the one
    of the level above that holds all of its members. None if any has none: such levels are no hierarchy."""
    out = levels[0].select(F.lit(0).alias("level"), "community_id", "entity_id", F.lit(None).cast("string").alias("parent_id"))
    for k, (above, own) in enumerate(zip(levels[:-1], levels[1:]), 1):
        linked = own.join(parents(own, above), "community_id", "left")
        if not linked.where("parent_id is null").isEmpty():
            return None
        out = out.union(linked.select(F.lit(k), "community_id", "entity_id", "parent_id"))
    return out


def parents(children: DataFrame, candidates: DataFrame) -> DataFrame:
    """(community_id, parent_id): the one candidate that holds all of a child's members; children with none or several are left out.

    Both: (community_id, entity_id)."""
    size = children.groupBy("community_id").agg(F.count("*").alias("n"))
    shared = children.join(candidates.withColumnRenamed("community_id", "parent_id"), "entity_id").groupBy("community_id", "parent_id").agg(F.count("*").alias("m"))
    full = shared.join(size, "community_id").where("m = n")
    return full.groupBy("community_id").agg(F.min("parent_id").alias("parent_id"), F.count("*").alias("k")).where("k = 1").drop("k")


def member_files(entities: DataFrame, members: DataFrame) -> DataFrame:
    """(community_id, file_ids): the distinct files of the members, without blanks."""
    own = members.join(entities.select("entity_id", F.explode("file_paths").alias("f")), "entity_id").where("f <> ''")
    return own.groupBy("community_id").agg(F.array_sort(F.collect_set("f")).alias("file_ids"))


def stub_endpoints(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """(root_id, entity_id, name, type) of the ends of facts that no entity stands for; the first name in order where they differ in letters' case."""
    ends = F.array(F.struct(F.col("source").alias("name"), F.col("source_type").alias("type")), F.struct(F.col("target").alias("name"), F.col("target_type").alias("type")))
    # Names are few beside facts, so they are hashed once they are distinct.
    each = facts.select("root_id", F.explode(ends).alias("e")).select("root_id", "e.name", "e.type").distinct().withColumn("entity_id", entity_id("name", "type", "root_id"))
    once = each.groupBy("root_id", "entity_id").agg(F.min(F.struct("name", "type")).alias("e")).select("root_id", "entity_id", "e.name", "e.type")
    return once.join(entities.select("entity_id"), "entity_id", "left_anti").select("root_id", "entity_id", "name", "type")


def merged_entities(old: DataFrame, facts: DataFrame) -> DataFrame:
    """old (entity_id, frequency, file_paths, chunk_ids) with facts (entity_id, file_path, chunk_id) merged in: each fact counts once more,
    files and chunks are appended where they are missing."""
    new = facts.groupBy("entity_id").agg(F.count("*").alias("k"), F.array_sort(F.collect_set("file_path")).alias("f"), F.array_sort(F.collect_set("chunk_id")).alias("c"))
    none = lambda c: F.coalesce(c, F.array().cast(old.schema["file_paths" if c == "f" or c == "file_paths" else "chunk_ids"].dataType))
    out = old.join(new, "entity_id", "full_outer")
    return out.select("entity_id", (F.coalesce("frequency", F.lit(0)) + F.coalesce("k", F.lit(0))).alias("frequency"), F.array_union(none("file_paths"), none("f")).alias("file_paths"), F.array_union(none("chunk_ids"), none("c")).alias("chunk_ids"))


def listed(communities: DataFrame, limit: int) -> DataFrame:
    """The first communities by level and id: sorted, then limited."""
    return communities.orderBy("level", "community_id").limit(limit)


def entity_map(facts: DataFrame) -> DataFrame:
    """Membership without repeats: (community_id, entity_id, build_id)."""
    return facts.dropDuplicates(["community_id", "entity_id", "build_id"])
