"""Queries over the entity graph, communities and extraction."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import identity
from tessera.operators import chunk, community, extract, graph, search, store
from tessera.session import cut
from tessera.sources import catalog
from tessera.sources.catalog import SHOP, sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_G = sql("facts", "contribs", "edges", "entities")
_GM = sql("facts", "contribs", "edges", "entities", "members")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_of(catalog.facts(spark, sf_dir))


def people_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among customers and suppliers of one order, for community queries: customer to supplier, by lineitem, with the keys of their ends."""
    o = catalog.table(spark, sf_dir, "lineitem").join(catalog.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    g = o.groupBy("o_custkey", "l_suppkey").agg(F.sum("l_quantity").alias("weight"))
    key = lambda kind, c: identity.entity_key(F.concat(F.lit(f"{kind} "), F.col(c).cast("string")), F.lit(kind), F.lit(SHOP))
    return g.select(F.lit(SHOP).alias("root_id"), key("customer", "o_custkey").alias("source_key"), key("supplier", "l_suppkey").alias("target_key"), F.lit("buys").alias("edge_type"), "weight", F.lit("").alias("description"))


_PE = f"""pe as (select sha256('customer ' || o_custkey || '|customer|{SHOP}') as source_id, sha256('supplier ' || l_suppkey || '|supplier|{SHOP}') as target_id, sum(l_quantity) as weight from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
pe2 as (select *, sha256(source_id || '|' || target_id || '|buys|{SHOP}') as edge_id from pe)"""
_PM = sql("members") + ", " + _PE


@query(sql("facts", "contribs", "edges") + "select edge_id, edge_type, weight, description from edges")
def a1_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select("edge_id", "edge_type", "weight", "description")


@query(_G + ", d as (select source_id as e, edge_id from edges union select target_id, edge_id from edges) select entity_id, (select count(*) from d where e = entity_id) as degree from entities")
def a2_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(catalog.entities(spark, sf_dir), edges(spark, sf_dir)).select("entity_id", "degree")


@query(sql("facts", "contribs", "edges") + "select least(source_id, target_id) as a, greatest(source_id, target_id) as b, sum(weight) as weight from edges where source_id <> target_id group by all")
def a9_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.undirected(edges(spark, sf_dir)).select("a", "b", "weight")


@query(sql("facts", "contribs") + "select file_path, count(*) as n, sum(weight) as weight from contribs group by file_path")
def m8_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.contribs(spark, sf_dir).groupBy("file_path").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query(_G + "select e.name from entities e where e.entity_id in (select source_id from edges where edge_type = 'calls' and target_id in (select entity_id from entities where name_lower = 'nation_3'))")
def j1_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.callers(catalog.entities(spark, sf_dir), edges(spark, sf_dir), "NATION_3").select("name")


@query(_G + ", t as (select unnest(file_paths) as f from entities) select f as file_path, count(*) as n from t group by f")
def j4_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.entities(spark, sf_dir).select(F.explode("file_paths").alias("file_path")).groupBy("file_path").agg(F.count("*").alias("n"))


@query(_PM + "select community_id, count(*) as n, sum(weight) as weight from pe2 join members s on s.entity_id = source_id join members t using (community_id) where t.entity_id = target_id group by community_id")
def j3_internal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.internal_edges(people_edges(spark, sf_dir), catalog.members(spark, sf_dir)).groupBy("community_id").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query(_PM + "select community_id, list_sort(list(name)) as names, (select count(*) from pe2 join members s on s.entity_id = source_id join members t on t.entity_id = target_id and t.community_id = s.community_id where s.community_id = p.community_id) as edge_count from (select 'n' || k as community_id, name from people) p group by community_id")
def a10_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = catalog.table(spark, sf_dir, "customer").select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("name"), F.lit("customer").alias("type")).union(catalog.table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")), F.lit("supplier")))
    e = e.select(identity.entity_id("name", "type", F.lit(SHOP)).alias("entity_id"), "name", F.array().cast("array<string>").alias("file_paths"))
    return graph.community_facts(e, people_edges(spark, sf_dir), catalog.members(spark, sf_dir)).select("community_id", "names", "edge_count")


@query(_PM + ", n as (select sha256(name || '|' || type || '|/shop') as id, name from people), i as (select community_id, a.name as source_name, b.name as target_name, row_number() over (partition by community_id order by a.name, b.name, edge_id) as place from pe2 join members s on s.entity_id = source_id join members t using (community_id) join n a on a.id = source_id join n b on b.id = target_id where t.entity_id = target_id) select community_id, source_name, target_name, place::bigint as place from i where place <= 15")
def w6_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = catalog.table(spark, sf_dir, "customer").select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("name"), F.lit("customer").alias("type")).union(catalog.table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")), F.lit("supplier")))
    e = e.select(identity.entity_id("name", "type", F.lit(SHOP)).alias("entity_id"), "name")
    t = graph.top_edges(e, people_edges(spark, sf_dir), catalog.members(spark, sf_dir))
    return t.select("community_id", "source_name", "target_name", F.col("place").cast("long").alias("place"))


@query(sql("members") + "select distinct 'n' || n_nationkey as community_id, 'r' || n_regionkey as parent_id from nation join people on k = n_nationkey")
def j9_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.parents(catalog.members(spark, sf_dir), catalog.members(spark, sf_dir, 0))


@query(_GM + "select community_id, list_sort(list(distinct f)) as file_ids from (select community_id, unnest(file_paths) as f from members join entities using (entity_id)) group by community_id")
def j10_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.member_files(catalog.entities(spark, sf_dir), catalog.members(spark, sf_dir))


@query(_PM + ", hit as (select distinct entity_id from members where entity_id in (select target_id from pe2 where weight > 150)) select distinct community_id from members where entity_id in (select entity_id from hit)")
def j7_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = people_edges(spark, sf_dir).where("weight > 150").select("target_key").distinct().select(F.sha2("target_key", 256).alias("entity_id"))
    return catalog.members(spark, sf_dir).join(hits, "entity_id", "left_semi").select("community_id").distinct()


@query(sql("members") + ", hit as (select entity_id from members where community_id in ('n1', 'n2', 'n3')), f as (select distinct community_id from members where entity_id in (select entity_id from hit)) select community_id from f where (select count(*) from f) <= floor((select count(distinct community_id) from members) * 0.3)")
def u1_targets_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = catalog.members(spark, sf_dir)
    return search.targets(m.where(F.col("community_id").isin("n1", "n2", "n3")), m, m)


_BFS = """, und as (select source_id as a, target_id as b from edges {w} union select target_id, source_id from edges {w}), seed as (select entity_id as id from entities where name = '{seed}'),
h1 as (select distinct b as id from und join seed on a = seed.id where b not in (select id from seed)){more}"""
_H2 = ", h2 as (select distinct b as id from und join h1 on a = h1.id where b not in (select id from h1 union all select id from seed))"


def _seed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return catalog.entities(spark, sf_dir).where(F.col("name") == name)


@query(_G + _BFS.format(w="", seed="customer 1", more="") + " select id as entity_id, 1::bigint as hops from h1")
def g1_bfs_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph.neighbours(edges(spark, sf_dir), _seed(spark, sf_dir, "customer 1"), 1)
    return n.select("entity_id", F.col("hops").cast("long").alias("hops"))


@query(_G + _BFS.format(w="", seed="customer 1", more=_H2) + " select id as entity_id, 1::bigint as hops from h1 union all select id, 2 from h2")
def g1_bfs_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph.neighbours(edges(spark, sf_dir), _seed(spark, sf_dir, "customer 1"), 2)
    return n.select("entity_id", F.col("hops").cast("long").alias("hops"))


@query(_G + _BFS.format(w="where edge_type = 'calls'", seed="NATION_3", more=_H2) + " select id as entity_id, 1::bigint as hops from h1 union all select id, 2 from h2")
def g1_bfs_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph.neighbours(edges(spark, sf_dir), _seed(spark, sf_dir, "NATION_3"), 2, ["calls"])
    return n.select("entity_id", F.col("hops").cast("long").alias("hops"))


@query(_G + _BFS.format(w="", seed="x", more="").replace("where name = 'x'", "where contains(name_lower, 'part 10') order by name_lower, entity_id limit 1") + " select id as entity_id from h1")
def g2_neighbours_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = search.entities_like(catalog.entities(spark, sf_dir), "part 10", 5).orderBy("name_lower", "entity_id").limit(1)
    return graph.neighbours(edges(spark, sf_dir), seed, 1).select("entity_id")


@query(_G + f"select entity_id, sha256('{SHOP}|' || entity_id) as community_id from entities")
def g5_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.singletons(catalog.entities(spark, sf_dir)).select(F.col("entity_ids")[0].alias("entity_id"), "community_id")


@query(sql("members") + f"select community_id as name, sha256('{SHOP}|(' || string_agg('''' || entity_id || '''', ', ' order by entity_id) || case when count(*) = 1 then ',' else '' end || ')') as id from members group by community_id")
def g8_community_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = catalog.members(spark, sf_dir).groupBy(F.col("community_id").alias("name")).agg(F.collect_list("entity_id").alias("ids"))
    return m.select("name", identity.community_id(F.lit(SHOP), "ids").alias("id"))


@query("with m as (select a.n_regionkey, list(a.n_name order by a.n_name) as ms from nation a group by 1) select n_regionkey, sha256('" + SHOP + "|(' || list_aggregate(list_transform(ms, lambda x: chr(39) || x || chr(39)), 'string_agg', ', ') || case when len(ms) = 1 then ',' else '' end || ')') as community_id, ms as entity_ids from m")
def g7_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations linked to all others of their region and to no others: the communities of most modularity are the regions."""
    n = catalog.table(spark, sf_dir, "nation")
    other = n.select(F.col("n_name").alias("b"), "n_regionkey")
    pairs = n.select(F.col("n_name").alias("a"), "n_regionkey").join(other, "n_regionkey").where("a < b").select("a", "b")
    nodes = n.select(F.lit(SHOP).alias("root_id"), F.col("n_name").alias("entity_id"))
    c = community.communities(community.detect(nodes, pairs)).where("level = 0").select("community_id", "entity_ids", F.col("entity_ids")[0].alias("n_name"))
    return c.join(n.select("n_name", "n_regionkey"), "n_name").select("n_regionkey", "community_id", "entity_ids")


@query(sql("members") + "select 1::int as level, 'n' || k as community_id, entity_id, 'r' || n_regionkey as parent_id from (select 'n' || p.k as c, p.k, sha256(name || '|' || type || '|/shop') as entity_id from people p) x join nation on n_nationkey = x.k union all select 0, community_id, entity_id, null from members0")
def g6_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels that nest: regions, and the nations within them."""
    return graph.hierarchy([catalog.members(spark, sf_dir, 0), catalog.members(spark, sf_dir)]).select("level", "community_id", "entity_id", "parent_id")


@query("select n_regionkey, n_nationkey % 2 as level, min(n_name) as first from nation group by all order by level, n_regionkey limit 6")
def k7_list_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog.table(spark, sf_dir, "nation").groupBy("n_regionkey", (F.col("n_nationkey") % 2).alias("level")).agg(F.min("n_name").alias("first")).withColumn("community_id", F.col("n_regionkey"))
    return graph.listed(c, 6).select("n_regionkey", "level", "first")


@query("with o as (select s_nationkey as k, count(*) as n, list_sort(list(s_suppkey)) as f from supplier group by 1), c as (select c_nationkey as k, count(*) as n, list_sort(list(distinct c_custkey % 50)) as f from customer group by 1) select coalesce(o.k, c.k) as k, coalesce(o.n, 0) + coalesce(c.n, 0) as frequency, list_sort(list_distinct(coalesce(o.f, []) || coalesce(c.f, []))) as chunk_ids from o full join c using (k)")
def s28_merge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of suppliers' nations, and the facts of customers merged into them."""
    s = catalog.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("entity_id")).agg(F.count("*").alias("frequency"), F.array_sort(F.collect_set(F.col("s_suppkey").cast("string"))).alias("file_paths"), F.array_sort(F.collect_set("s_suppkey")).alias("chunk_ids"))
    c = catalog.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("entity_id"), F.col("c_custkey").cast("string").alias("file_path"), (F.col("c_custkey") % 50).alias("chunk_id"))
    return graph.merged_entities(s, c).select(F.col("entity_id").alias("k"), "frequency", F.array_sort("chunk_ids").alias("chunk_ids"))


@query("select distinct l_partkey % 20 as entity_id, l_suppkey as community_id, l_linenumber % 2 as build_id from lineitem where l_linenumber % 2 = 0")
def s29_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships without repeats, and without those of other builds."""
    m = catalog.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 20).alias("entity_id"), F.col("l_suppkey").alias("community_id"), (F.col("l_linenumber") % 2).alias("build_id"))
    return store.kept_build(graph.entity_map(m), 0)


@query("with v as (select n_name as entity_id, n_regionkey as r from nation) select entity_id, case when r = 1 then 'new' else 'old' end as embedding from v where r <> 2 and entity_id not like '%3' union all select 'extra', 'new'")
def s25_entity_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors after an upsert of one region's and a new one, a deletion of a root's and one by ids."""
    n = catalog.table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("root_id"), F.col("n_name").alias("entity_id"), F.lit("old").alias("embedding"))
    new = n.where("root_id = '1'").withColumn("embedding", F.lit("new")).union(spark.createDataFrame([("9", "extra", "new")], "root_id string, entity_id string, embedding string"))
    v = store.upserted(n, new, ["root_id", "entity_id"])
    v = store.without(v, F.col("root_id") == "2")
    return v.join(n.where("entity_id like '%3'").select("entity_id"), "entity_id", "left_anti").select("entity_id", "embedding")


@query(_PM + ", c as (select k, list_sort(list(name)) as names, list_sort(list(distinct type)) as files from people group by k) select 'n' || k as community_id, left(array_to_string(names[1:3], ', ') || case when len(names) > 3 then ' and ' || (len(names) - 3) || ' more' else '' end, 200) as title, left(len(names) || ' entities in ' || len(files) || ' files, 7 relations', 500) as summary, list_transform(files[1:5], lambda f: left('Defined in ' || f, 200)) as findings, names as entity_names, files as file_paths, 7::int as edge_count, 'extractive' as generated_by from c where len(names) >= 2")
def l10_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractive reports of the nations' people; those with one member have none."""
    c = catalog.table(spark, sf_dir, "customer").select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("name"), F.lit("customer").alias("type"), F.col("c_nationkey").alias("k"))
    s = catalog.table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")), F.lit("supplier"), "s_nationkey")
    f = c.union(s).groupBy(F.concat(F.lit("n"), F.col("k").cast("string")).alias("community_id")).agg(F.array_sort(F.collect_list("name")).alias("names"), F.array_sort(F.collect_set("type")).alias("files"), F.lit(7).alias("edge_count"))
    return community.extractive_reports(f)


_ANSWER = """case p_partkey % 4
when 0 then '("entity"<|>parse(x)<|>' || p_type || '<|>ends with (note)<|>' || p_size || ')##("entity"<|>short)##'
when 1 then 'entity<|> ' || p_name || ' <|>' || p_type || '<|>"quoted"##garbage##'
when 2 then chr(10) || '(""entity""<|>"' || p_name || '"<|>' || p_type || '<|>two' || chr(10) || 'lines<|>1,2) ##' || chr(10)
else '("entity"<|>' || p_name || '<|>t<|>((d))<|>x)' end || '##("relationship"<|>a<|>b<|>c<|>many)##<|COMPLETE|>'"""


@query("select p_partkey, case p_partkey % 4 when 0 then 'parse(x)' when 2 then '\"' || p_name || '\"' else p_name end as name, case when p_partkey % 4 = 3 then 't' else p_type end as type, case p_partkey % 4 when 0 then 'ends with (note)' when 1 then '\"quoted\"' when 2 then 'two' || chr(10) || 'lines' else '((d))' end as description, case p_partkey % 4 when 0 then p_size::varchar when 1 then null when 2 then '1,2' else 'x' end as ordinals from part")
def l3_parse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with parentheses and quotes in their fields, without outer parentheses, over lines, and malformed ones."""
    p = catalog.table(spark, sf_dir, "part").withColumn("answer", F.expr(_ANSWER.replace("chr(10)", "'\\n'")))
    return extract.entity_records(p.select("p_partkey", "answer")).select("p_partkey", "name", "type", "description", "ordinals")


@query("select p_partkey, 'f(' || p_size || ')' as source, 'Lib' as target, 'uses (it)' as description, p_size + 0.5::double as weight, p_type as source_type, case when p_partkey % 2 = 0 then 'second' else '' end as target_type from part")
def l3_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships with the types of the entities of the same answer, the last of a name; weights that are no numbers are left out."""
    lib = F.when(F.col("p_partkey") % 2 == 0, F.lit('("entity"<|>LIB<|>first<|>d)##("entity"<|>lib<|>second<|>d)##')).otherwise("")
    size = F.col("p_size").cast("string")
    answer = F.concat(F.lit('("entity"<|>F('), size, F.lit(")<|>"), "p_type", F.lit("<|>d<|>1)##"), lib, F.lit('("relationship"<|>f('), size, F.lit(")<|>Lib<|>uses (it)<|>"), size, F.lit('.5)##("relationship"<|>a<|>b<|>c<|>8x)##<|COMPLETE|>'))
    return extract.relationship_records(catalog.table(spark, sf_dir, "part").select("p_partkey", answer.alias("answer")))


class FirstWords:
    """A stand-in for a model: of each chunk its first word is an entity, and the one before it is related to it."""

    def chat(self, messages: list[dict[str, str]]) -> str:
        words = [t.split()[0] for t in re.split(r"=== CHUNK \d+ ===\n", messages[1]["content"])[1:]]
        named = [f'("entity"{extract.FIELD}{w}{extract.FIELD}word{extract.FIELD}d{k}{extract.FIELD}{k})' for k, w in enumerate(words, 1)]
        linked = [f'("relationship"{extract.FIELD}{a}{extract.FIELD}{b}{extract.FIELD}next{extract.FIELD}1)' for a, b in zip(words[:-1], words[1:])]
        return extract.RECORD.join([*named, *linked, extract.DONE])


_TURNS = "t as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn, role, text) - 1 as chunk_id, regexp_extract(text, '\\S+') as word from conversations where regexp_matches(text, '\\S'))"


@query(f"with {_TURNS}, m as (select conv_id, lower(word) as key, list_sort(list(distinct chunk_id::int)) as chunk_ids, arg_min(word, chunk_id) as name from t where chunk_id < 100 group by all) select conv_id, name, 'word' as type, chunk_ids, len(chunk_ids)::bigint as frequency from m")
def l8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that a stand-in model names in batches of conversations' turns, mapped back to chunks and merged by file."""
    entities, _, _ = extract.extracted_files(_turn_chunks(spark, sf_dir), FirstWords())
    return entities.select(F.col("file_path").cast("long").alias("conv_id"), "name", "type", "chunk_ids", "frequency")


def _turn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog.table(spark, sf_dir, "conversations").where(F.col("text").rlike(r"\S"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    return c.select(F.lit("/c").alias("root_id"), F.col("conv_id").cast("string").alias("file_path"), place.alias("chunk_id"), F.col("text").alias("chunk_text"))


class NoSevens:
    """A stand-in whose model fails on texts with a 7 before the colon."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        if any("7:" in t for t in texts):
            raise ValueError("7")
        return [[float(len(t)), 1.0] for t in texts]


@query("select count(*) as entities_total, count(*) filter (where p_partkey % 10 <> 7) as entities_embedded, count(*) filter (where p_partkey % 10 = 7) as entities_embed_failed from part")
def l9_embedding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that fails on some entities leaves those, and no others, without a vector."""
    e = catalog.table(spark, sf_dir, "part").select(F.lit("/r").alias("root_id"), F.col("p_partkey").cast("string").alias("entity_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.lit("part").alias("type"), F.col("p_type").alias("description"))
    return extract.embedding_counts(extract.entity_vectors(e, NoSevens()))


@query(_G + ", known as (select entity_id from entities where type <> 'part'), e as (select name, type, entity_id from entities where type = 'part') select name, type from e")
def l9_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of edges without an entity: here all parts."""
    known = catalog.entities(spark, sf_dir).where("type <> 'part'")
    return graph.stub_endpoints(known, catalog.facts(spark, sf_dir)).select("name", "type")


@query("select p_partkey, case when p_size % 5 between 1 and 3 then [p_partkey * 10 + p_size % 5] else [p_partkey * 10 + 1, p_partkey * 10 + 2, p_partkey * 10 + 3] end as chunk_ids from part")
def l4_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = catalog.table(spark, sf_dir, "part")
    chunks = F.array(*(F.col("p_partkey") * 10 + k for k in (1, 2, 3)))
    return p.select("p_partkey", extract.ordinals_to_chunks((F.col("p_size") % 5).cast("string"), chunks).alias("chunk_ids"))


@query("with f as (select p_brand, p_type, min(p_partkey) as k from part group by all), d as (select p_brand, string_agg(p_type, '; ' order by k) as description from f group by 1) select p_brand as name, d.description, list_sort(list(distinct p_size % 3)) as chunk_ids, case when count(*) = 1 then 1 else count(distinct p_size % 3) end as frequency from part join d using (p_brand) group by p_brand, d.description")
def a8_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = catalog.table(spark, sf_dir, "part")
    m = p.select(F.lit(SHOP).alias("root_id"), F.col("p_brand").alias("name"), F.lit("brand").alias("type"), F.col("p_type").alias("description"), (F.col("p_size") % 3).alias("chunk_id"), F.col("p_partkey").alias("ordinal"))
    return extract.merged(m).select("name", "description", "chunk_ids", "frequency")


@query("select doc_id, coalesce((select list_sort(list(distinct n_name)) from nation where n_nationkey % 7 = doc_id % 7 and n_regionkey < 2), []) as entity_names from documents")
def j16_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = catalog.table(spark, sf_dir, "nation").where("n_regionkey < 2").select(F.col("n_name").alias("name"), F.array(F.col("n_nationkey") % 7).alias("chunk_ids"))
    d = catalog.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 7).alias("chunk_id"))
    return extract.annotated(d, n).select("doc_id", "entity_names")


@query("with d as (select doc_id, length(text) as t, greatest(ceil((length(text) - 128) / 384.0), 1)::bigint as n from documents where length(text) > 0), l as (select *, t - (n - 1) * 384 as last from d) select doc_id, list_transform(range(n), lambda k: case when k < n - 1 or k % 2 = 1 or k = 0 then k // 2 when last <= 476 then k // 2 - 1 else k // 2 end)::int[] as batches from l")
def w5_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches of each document's chunks of 512 characters, of at most 4 chunks and 1500 characters: two to a batch, and the last one as a third where it fits."""
    d = catalog.table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", chunk.strided("text").alias("c"))
    return d.select("doc_id", extract.batched(F.transform("c", lambda c: c["chunk_text"]), 4, 1500).alias("batches"))


@query(f"with {_TURNS}, b as (select conv_id, chunk_id, (chunk_id // 4)::int as batch, '=== CHUNK ' || (chunk_id % 4 + 1) || ' ===' || chr(10) || text as part from t where chunk_id < 100) select conv_id, batch, string_agg(part, chr(10) || chr(10) order by chunk_id) as question from b group by all")
def l5_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is asked about batches of four turns."""
    b = extract.batches(_turn_chunks(spark, sf_dir), 4, 1_000_000)
    return b.select(F.col("file_path").cast("long").alias("conv_id"), "batch", extract.question(F.col("texts")).alias("question"))


class Lengths:
    """A stand-in: the length of the text and its number of spaces."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count(" "))] for t in texts]


@query("select doc_id, length(t)::float as n, (length(t) - length(replace(t, ' ', '')))::float as spaces from (select doc_id, left(text, 1800) as t from documents)")
def l2_embed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's vector; equal texts are embedded once."""
    e = extract.embedded(catalog.table(spark, sf_dir, "documents").select("doc_id", "text"), Lengths(), "text")
    return e.select("doc_id", F.col("embedding")[0].alias("n"), F.col("embedding")[1].alias("spaces"))


@query("select doc_id, md5('/corpus/' || doc_id || ':' || (doc_id % 3)) as id, sha256(text) as chunk_hash, md5(text) as file_hash from documents")
def ids_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = catalog.table(spark, sf_dir, "documents")
    return d.select("doc_id", identity.chunk_id(F.concat(F.lit("/corpus/"), F.col("doc_id").cast("string")), F.col("doc_id") % 3).alias("id"), identity.chunk_hash("text").alias("chunk_hash"), identity.file_hash("text").alias("file_hash"))


@query("select p_partkey, sha256(lower(p_name) || '|' || lower(trim(p_type)) || '|/r') as id from part")
def ids_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "part").select("p_partkey", identity.entity_id("p_name", "p_type", F.lit("/r")).alias("id"))


@query("select n_nationkey, sha256(n_name || '|' || n_regionkey || '|calls|/r') as id from nation")
def ids_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "nation").select("n_nationkey", identity.edge_id("n_name", F.col("n_regionkey").cast("string"), F.lit("calls"), F.lit("/r")).alias("id"))


@query("select n_nationkey, regexp_replace(md5('/r|1|b|' || n_name), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') as point, regexp_replace(md5(n_name || '|/r'), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') as entity_point from nation")
def ids_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = catalog.table(spark, sf_dir, "nation")
    return n.select("n_nationkey", identity.community_point(F.lit("/r"), F.lit(1), F.lit("b"), "n_name").alias("point"), identity.entity_point("n_name", F.lit("/r")).alias("entity_point"))


def _orders_as_files(spark: SparkSession, sf_dir: str):
    """Lines of orders as contributions: an order is a file, and an edge leads from a supplier to a part."""
    x = catalog.table(spark, sf_dir, "lineitem")
    name = lambda c: F.col(c).cast("string")
    return x.select("l_linenumber", F.lit(SHOP).alias("root_id"), name("l_orderkey").alias("file_path"), F.concat(name("l_suppkey"), F.lit(">"), name("l_partkey")).alias("edge_id"), name("l_suppkey").alias("source_id"), F.concat(F.lit("p"), name("l_partkey")).alias("target_id"), F.lit("holds").alias("edge_type"), F.col("l_quantity").alias("weight"), (F.col("l_orderkey") % 5 == 0).alias("edited"))


_LEFT = "with x as (select * from lineitem where case when l_orderkey % 5 = 0 then l_linenumber >= 3 else l_linenumber <= 4 end)"


def _edited_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sums before, changes, sums of the changed edges before) when every fifth order is replaced by other lines of it."""
    x = _orders_as_files(spark, sf_dir)
    was = x.where("l_linenumber <= 4")
    old = graph.edge_sums(was)
    changes = cut(graph.edge_changes(was.where("edited"), x.where("edited and l_linenumber >= 3")))
    return old, changes, old.join(changes.select("edge_id"), "edge_id", "left_semi")


@query(_LEFT + " select l_suppkey || '>' || l_partkey as edge_id, sum(l_quantity) as weight, count(*) as n from x group by 1")
def s26_edge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of edges after a change of files, from the sums before it and what the change takes and brings."""
    old, changes, touched = _edited_orders(spark, sf_dir)
    kept = old.join(changes.select("edge_id"), "edge_id", "left_anti")
    return kept.unionByName(graph.changed_edges(touched, changes)).select("edge_id", "weight", "n")


@query(_LEFT + ", e as (select distinct l_suppkey, l_partkey from x) select entity_id, count(*) as n from (select l_suppkey::varchar as entity_id from e union all select 'p' || l_partkey from e) group by 1")
def s27_degree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees after the same change, from those before it and the edges that it lets appear or vanish."""
    old, changes, touched = _edited_orders(spark, sf_dir)
    before = graph.degree_changes(old.limit(0), old)
    by = cut(graph.degree_changes(touched, changes))
    return before.join(by.select("entity_id"), "entity_id", "left_anti").unionByName(graph.changed_counts(before, by)).select("entity_id", "n")


def _customers_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each customer linked to one supplier and to nobody else: the best communities are the suppliers with their customers."""
    suppliers = catalog.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    of = catalog.table(spark, sf_dir, "customer").crossJoin(suppliers.agg(F.count("*").alias("n"))).select("c_custkey", (F.pmod(F.col("c_custkey") * 7, F.col("n")) + 1).alias("k"))
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    pairs = of.join(suppliers.hint("merge"), "k").select(name("c", "c_custkey").alias("a"), name("s", "k").alias("b"))
    nodes = of.select(name("c", "c_custkey").alias("entity_id")).union(suppliers.select(name("s", "k"))).withColumn("root_id", F.lit(SHOP))
    return nodes, pairs


_STARS = """with n as (select count(*) as n from supplier), p as (select 'c' || c_custkey as a, s_suppkey as k from customer, n, supplier where s_suppkey = (c_custkey * 7) % n.n + 1),
g as (select k, count(*) as m from p group by k)
select entity_id, coalesce(m, 0) + 1 as members from (select a as entity_id, k from p union all select 's' || s_suppkey, s_suppkey from supplier union all
select 'c' || c_custkey, null from customer where 'c' || c_custkey not in (select a from p)) left join g using (k)"""


@query(_STARS)
def g6_leiden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity with the size of its coarsest community."""
    nodes, pairs = _customers_of(spark, sf_dir)
    g = cut(community.detect(nodes, pairs).where("level = 0"))
    return g.join(g.groupBy("group").agg(F.count("*").alias("members")).hint("merge"), "group").select("entity_id", "members")


@query(_STARS)
def g7_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, pairs = _customers_of(spark, sf_dir)
    g = cut(community.greedy(nodes, pairs))
    return g.join(g.groupBy("group").agg(F.count("*").alias("members")).hint("merge"), "group").select("entity_id", "members")
