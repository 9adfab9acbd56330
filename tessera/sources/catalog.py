"""The engine's tables over the driver's: chunk points, entities and edges, tool calls, file events, communities.

Each function reads Parquet and projects; the same tables as SQL are in SQL, for checks with another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.identity import entity_id
from tessera.operators.graph import contributions
from tessera.session import ship

SHOP = "/shop"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """One chunk point for each document; with vectors, those of embeddings with the same id."""
    d = table(spark, sf_dir, "documents")
    ext = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "fr", ".py").when(F.col("lang") == "de", ".html").otherwise(".txt")
    kind = F.when(F.col("lang") == "en", "markdown").when(F.col("lang") == "fr", "python").when(F.col("lang") == "de", "html").otherwise("text")
    root = F.concat(F.lit("/corpus/"), F.col("source"))
    path = F.concat_ws("/", root, F.col("lang"), F.concat(F.col("doc_id").cast("string"), ext))
    out = d.select("doc_id", root.alias("root_id"), path.alias("path_key"), path.alias("file_path"), ext.alias("extension"), kind.alias("file_type"), F.col("text").alias("chunk_text"), (F.col("doc_id") % 7).alias("chunk_id"), (2 + F.col("doc_id") % 2).alias("metadata_version"), (F.col("doc_id") * 1000).alias("modified_time"))
    if not vectors:
        return out
    return out.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What files state: customers order parts; suppliers call on their nation."""
    o, n = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")), table(spark, sf_dir, "nation")
    name = lambda kind, key: F.concat(F.lit(f"{kind} "), F.col(key).cast("string"))
    buys = o.select(F.lit(SHOP).alias("root_id"), F.concat(F.lit("/o/"), F.col("o_orderpriority")).alias("file_path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), name("customer", "o_custkey").alias("source"), F.lit("customer").alias("source_type"), name("part", "l_partkey").alias("target"), F.lit("part").alias("target_type"), F.lit("orders").alias("edge_type"), F.col("l_quantity").alias("weight"), F.col("l_returnflag").alias("description"))
    s = table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    calls = s.select(F.lit(SHOP), F.lit("/s/suppliers"), "s_suppkey", name("supplier", "s_suppkey"), F.lit("supplier"), "n_name", F.lit("nation"), F.lit("calls"), F.lit(1.0), F.lit(""))
    return buys.union(calls)


def contribs(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    return contributions(facts(spark, sf_dir), keyed)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root_id, entity_id, name, name_lower, type, file_paths) of all ends of facts."""
    f = facts(spark, sf_dir)
    ends = f.select("root_id", F.explode(F.array(F.struct(F.col("source").alias("name"), F.col("source_type").alias("type")), F.struct(F.col("target").alias("name"), F.col("target_type").alias("type")))).alias("e"), "file_path")
    g = ends.groupBy("root_id", "e.name", "e.type").agg(F.array_sort(F.collect_set("file_path")).alias("file_paths"))
    return g.select("root_id", entity_id("name", "type", "root_id").alias("entity_id"), "name", F.lower("name").alias("name_lower"), "type", "file_paths")


def members(spark: SparkSession, sf_dir: str, level: int = 1) -> DataFrame:
    """Customers and suppliers by nation (level 1) or region (level 0)."""
    n = F.broadcast(table(spark, sf_dir, "nation"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("name"), F.lit("customer").alias("type"), F.col("c_nationkey").alias("n_nationkey"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")), F.lit("supplier"), "s_nationkey")
    key = F.concat(F.lit("n"), F.col("n_nationkey").cast("string")) if level else F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    return c.union(s).join(n, "n_nationkey").select(key.alias("community_id"), entity_id("name", "type", F.lit(SHOP)).alias("entity_id"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "zero_result").otherwise("success")
    return e.select(F.col("ts").alias("timestamp"), F.concat(F.lit("t"), (F.col("user_id") % 8).cast("string")).alias("tool_name"), F.col("user_id").cast("string").alias("session_id"), outcome.alias("outcome"))


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("/r"), (F.col("user_id") % 5).cast("string")).alias("root_id"), F.concat(F.lit("/r"), (F.col("user_id") % 5).cast("string"), F.lit("/f"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("kind"), "ts")


#: The same tables as common table expressions.
SQL = {
    "points": """points as (select doc_id, '/corpus/' || source as root_id, '/corpus/' || source || '/' || lang || '/' || doc_id || case lang when 'en' then '.md' when 'fr' then '.py' when 'de' then '.html' else '.txt' end as path_key,
        case lang when 'en' then '.md' when 'fr' then '.py' when 'de' then '.html' else '.txt' end as extension, case lang when 'en' then 'markdown' when 'fr' then 'python' when 'de' then 'html' else 'text' end as file_type,
        text as chunk_text, doc_id % 7 as chunk_id, 2 + doc_id % 2 as metadata_version, doc_id * 1000 as modified_time from documents)""",
    "vpoints": "vpoints as (select p.*, embedding::double[] as v from points p join embeddings e on e.vec_id = p.doc_id)",
    "q": "q as (select embedding::double[] as q from embeddings where vec_id = 0)",
    "facts": f"""facts as (select '/o/' || o_orderpriority as file_path, l_orderkey * 10 + l_linenumber as ordinal, 'customer ' || o_custkey as source, 'customer' as source_type, 'part ' || l_partkey as target, 'part' as target_type, 'orders' as edge_type, l_quantity as weight, l_returnflag as description
        from lineitem join orders on l_orderkey = o_orderkey
        union all select '/s/suppliers', s_suppkey, 'supplier ' || s_suppkey, 'supplier', n_name, 'nation', 'calls', 1.0, '' from supplier join nation on s_nationkey = n_nationkey),
        facts2 as (select *, sha256(lower(source) || '|' || source_type || '|{SHOP}') as source_id, sha256(lower(target) || '|' || target_type || '|{SHOP}') as target_id from facts),
        facts3 as (select *, sha256(source_id || '|' || target_id || '|' || edge_type || '|{SHOP}') as edge_id from facts2)""",
    "contribs": "contribs as (select file_path, edge_id, source_id, target_id, edge_type, weight, description from (select *, row_number() over (partition by file_path, edge_id order by ordinal desc, weight desc, description desc) as k from facts3) where k = 1)",
    "edges": "edges as (select edge_id, source_id, target_id, edge_type, sum(weight) as weight, coalesce(string_agg(case when description <> '' then description end, ' | ' order by file_path), '') as description from contribs group by all)",
    "entities": f"""ends as (select source as name, source_type as type, file_path from facts union all select target, target_type, file_path from facts),
        entities as (select sha256(lower(name) || '|' || type || '|{SHOP}') as entity_id, name, lower(name) as name_lower, type, list_sort(list(distinct file_path)) as file_paths from ends group by name, type)""",
    "members": f"""people as (select 'customer ' || c_custkey as name, 'customer' as type, c_nationkey as k from customer union all select 'supplier ' || s_suppkey, 'supplier', s_nationkey from supplier),
        members as (select 'n' || k as community_id, sha256(name || '|' || type || '|{SHOP}') as entity_id from people),
        members0 as (select 'r' || n_regionkey as community_id, sha256(name || '|' || type || '|{SHOP}') as entity_id from people join nation on k = n_nationkey)""",
    "calls": "calls as (select ts as timestamp, 't' || (user_id % 8) as tool_name, user_id::varchar as session_id, case event_type when 'error' then 'error' when 'view' then 'zero_result' else 'success' end as outcome from events)",
    "changes": "changes as (select '/r' || (user_id % 5) as root_id, '/r' || (user_id % 5) || '/f' || user_id as path, event_type as kind, ts from events)",
}


def sql(*names: str) -> str:
    """A WITH clause of the tables named."""
    return "with " + ",\n".join(SQL[n] for n in names) + "\n"
