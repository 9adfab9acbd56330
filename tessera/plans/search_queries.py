"""Queries over chunk points and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.operators import search, sync
from tessera.session import shared_path
from tessera.sources import catalog
from tessera.sources.catalog import sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = catalog.table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else []


_KNN = sql("points", "vpoints", "q") + ", s as (select v.*, list_cosine_similarity(v, q) as score from vpoints v, q)\n"


@query(sql("q") + "select vec_id, round(list_cosine_similarity(embedding::double[], q), 6) as score from embeddings, q order by list_cosine_similarity(embedding::double[], q) desc, vec_id limit 20")
def k1_knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = catalog.table(spark, sf_dir, "embeddings")
    return search.nearest(v, first_vector(spark, sf_dir), 20, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("with s as (select a.vec_id as query_id, b.vec_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s from embeddings a, embeddings b where a.vec_id % 50 = 0), r as (select *, row_number() over (partition by query_id order by round(s, 12) desc, vec_id) as rank from s) select query_id, rank::int as rank, vec_id, round(s, 6) as score from r where rank <= 10")
def k1_knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top 10 of every row whose id is divisible by 50, against all rows."""
    v = catalog.table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return search.nearest_batch(v, q, 10, "vec_id", "query_id").withColumn("score", F.round("score", 6))


@query(_KNN + "select doc_id, path_key, round(score, 6) as score from s where extension in ('.md', '.py') and file_type in ('markdown', 'python') and root_id = '/corpus/src0' order by s.score desc, doc_id limit 10")
def k1_knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = search.where_metadata(catalog.points(spark, sf_dir, True), root_id="/corpus/src0", extensions=["md", ".py"], file_types=["markdown", "python"])
    return search.nearest(p, first_vector(spark, sf_dir), 10, "doc_id").select("doc_id", "path_key", F.round("score", 6).alias("score"))


@query(_KNN + "select doc_id, round(score, 6) as score from s where score >= 0.2 and (path_key = '/corpus/src1' or starts_with(path_key, '/corpus/src1/') or starts_with(path_key, '/corpus/src2/en/')) order by s.score desc, doc_id limit 15")
def f5_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = search.scored(catalog.points(spark, sf_dir, True), first_vector(spark, sf_dir))
    return search.where_metadata(p, base_dirs=["/corpus/src1", "/corpus/src2/en"], min_score=0.2).orderBy(F.desc("score"), "doc_id").limit(15).select("doc_id", F.round("score", 6).alias("score"))


@query(sql("q") + "select vec_id, round(list_cosine_similarity(embedding::double[], q), 6) as score from embeddings, q where label = 3 order by list_cosine_similarity(embedding::double[], q) desc, vec_id limit 10")
def k2_entity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = catalog.table(spark, sf_dir, "embeddings").where("label = 3")
    return search.nearest(v, first_vector(spark, sf_dir), 10, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(sql("q") + "select vec_id, round(list_cosine_similarity(embedding::double[], q), 6) as score from embeddings, q where vec_id % 3 = (select max(vec_id % 3) from embeddings) order by list_cosine_similarity(embedding::double[], q) desc, vec_id limit 5")
def k3_report_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = catalog.table(spark, sf_dir, "embeddings").withColumn("build", F.col("vec_id") % 3)
    committed = v.agg(F.max("build").alias("build"))
    return search.nearest(v.join(F.broadcast(committed), "build", "left_semi"), first_vector(spark, sf_dir), 5, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(sql("q") + "select vec_id, round(list_cosine_similarity(embedding::double[], q), 6) as score from embeddings, q where vec_id in (select distinct l_suppkey from lineitem where l_quantity > 45) order by list_cosine_similarity(embedding::double[], q) desc, vec_id limit 5")
def k4_subset_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = catalog.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("vec_id")).distinct()
    v = catalog.table(spark, sf_dir, "embeddings").join(ids, "vec_id", "left_semi")
    return search.nearest(v, first_vector(spark, sf_dir), 5, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(_KNN + ", r as (select *, row_number() over (partition by root_id order by score desc, doc_id) as k from s), g as (select root_id, max(score) as sc, list(doc_id order by k) as chunks from r where k <= 5 group by root_id) select root_id, round(sc, 6) as score, chunks from g order by sc desc, root_id limit 8")
def a7_group_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = search.scored(catalog.points(spark, sf_dir, True), first_vector(spark, sf_dir))
    g = search.grouped_by_file(s, 8, file="root_id", order="doc_id")
    return g.select("root_id", F.round("score", 6).alias("score"), F.transform("chunks", lambda c: c["doc_id"]).alias("chunks"))


@query(_KNN + ", r as (select *, row_number() over (partition by root_id order by score desc, doc_id) as k from s), t as (select *, row_number() over (order by score desc, path_key) as rank from r where k <= 5) select rank::bigint as rank, path_key, round(score, 4) as score, case when length(x) > 500 then x[1:500] || '…' else x end as snippet from (select *, trim(regexp_replace(chunk_text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as x from t) where rank <= 20")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest chunks, at most five of a source, ranked, with snippets."""
    s = search.scored(catalog.points(spark, sf_dir, True), first_vector(spark, sf_dir))
    w = Window.partitionBy("root_id").orderBy(F.desc("score"), "doc_id")
    top = s.withColumn("k", F.row_number().over(w)).where("k <= 5").orderBy(F.desc("score"), "path_key").limit(20)
    return search.snippets(top).withColumn("rank", F.col("rank").cast("long"))


@query(_KNN + ", n as (select *, list_filter(['alpha', 'beta', 'gamma'], lambda x: doc_id % 2 = 0 and x = 'alpha' or doc_id % 3 = 0 and x = 'beta') as names from s) select doc_id, round(0.85 * score + 0.15 * len(list_intersect(names, ['alpha', 'beta'])) / 2, 6) as score from n order by 0.85 * score + 0.15 * len(list_intersect(names, ['alpha', 'beta'])) / 2 desc, doc_id limit 10")
def q8_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = search.scored(catalog.points(spark, sf_dir, True), first_vector(spark, sf_dir))
    names = F.array_compact(F.array(F.when(F.col("doc_id") % 2 == 0, "alpha"), F.when(F.col("doc_id") % 3 == 0, "beta")))
    return search.reranked(s.withColumn("entity_names", names), ["alpha", "beta"], 0.15).orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"))


@query(sql("points") + "select root_id, count(*) as n from points where extension in ('.md', '.txt') and file_type in ('markdown', 'text') and path_key <> '/corpus/src0/en/0.md' group by root_id")
def f1_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = search.where_metadata(catalog.points(spark, sf_dir), extensions=["md", "txt"], file_types=["markdown", "text"], exclude="/corpus/src0/en/0.md")
    return p.groupBy("root_id").agg(F.count("*").alias("n"))


@query(sql("points") + "select doc_id from points where path_key = '/corpus/src1' or starts_with(path_key, '/corpus/src1/')")
def f3_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.points(spark, sf_dir).where(scalars.within("path_key", F.lit("/corpus/src1"))).select("doc_id")


@query("select a.s as a, b.s as b from (select distinct '/corpus/' || source as s from documents) a, (select distinct '/corpus/' || source || '/en' as s from documents) b where starts_with(b.s, a.s || '/')")
def f4_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = catalog.table(spark, sf_dir, "documents").select(F.concat(F.lit("/corpus/"), F.col("source")).alias("path")).distinct()
    return sync.lock_conflicts(a.union(a.select(F.concat(F.col("path"), F.lit("/en")))))


@query(sql("facts", "entities") + "select name, type from entities where contains(name_lower, 'er 1') order by name_lower, entity_id limit 25")
def f6_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.entities_like(catalog.entities(spark, sf_dir), "ER 1", 25).select("name", "type")


@query(sql("facts", "entities") + "select name, type from entities where contains(name_lower, 'er 1') order by name_lower, entity_id limit 25")
def f6_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f6_like by stored postings of trigrams."""
    return search.NameIndex(spark, shared_path(spark, "names")).build(catalog.entities(spark, sf_dir).select("entity_id", "name", "name_lower", "type")).like("ER 1", 25).select("name", "type")


@query(sql("points") + "select doc_id from points where root_id in (select '/corpus/src' || n_nationkey from nation where n_regionkey = 1)")
def f7_active_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = catalog.table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.concat(F.lit("/corpus/src"), F.col("n_nationkey").cast("string")).alias("root_id"))
    return catalog.points(spark, sf_dir).join(active, "root_id", "left_semi").select("doc_id")


@query("with a as (select n_regionkey, n_nationkey * 40 as doc_id from nation), t as (select a.*, d.doc_id is not null as there from a left join (select distinct doc_id from documents) d using (doc_id)) select n_regionkey, bool_or(there) as any_there, bool_and(there) as all_there from t group by n_regionkey")
def f8_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the ids that each region asks for, whether any and whether all are there."""
    d = catalog.table(spark, sf_dir, "documents").select("doc_id")
    n = catalog.table(spark, sf_dir, "nation").select("n_regionkey", (F.col("n_nationkey").cast("long") * 40).alias("doc_id"))
    each = [search.existence(d, "doc_id", n.where(F.col("n_regionkey") == k)).select(F.lit(k).cast("int").alias("n_regionkey"), "any_there", "all_there") for k in range(5)]
    return reduce(DataFrame.union, each)


@query("select doc_id, case when length(text) > 80 then rtrim(text[1:80]) || '…' else text end as short, left(text, 1800) as embed_input from documents")
def f11_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "documents").select("doc_id", scalars.truncated("text", 80).alias("short"), scalars.embed_input("text").alias("embed_input"))


@query("select doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda w: length(w) >= 4)).list_sort() as words from documents")
def c4_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "documents").select("doc_id", F.array_sort(scalars.keywords("text")).alias("words"))


@query("select doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as text from documents")
def c3_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "documents").select("doc_id", scalars.collapsed("text").alias("text"))


_LOGGED = "event_type || ' Error, FAIL: ' || props || ' failed critical-exception EXCEPTION errors'"


@query(f"select event_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_LOGGED}, '(?i)\\b(e)r(ror)\\b', '\\1*\\2', 'g'), '(?i)\\b(f)a(il)\\b', '\\1*\\2', 'g'), '(?i)\\b(e)x(ception)\\b', '\\1*\\2', 'g'), '(?i)\\b(c)r(itical)\\b', '\\1*\\2', 'g') as masked from events")
def c1_mask_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    logged = F.concat("event_type", F.lit(" Error, FAIL: "), "props", F.lit(" failed critical-exception EXCEPTION errors"))
    return catalog.table(spark, sf_dir, "events").select("event_id", scalars.mask_log_words(logged).alias("masked"))


@query("with d as (select p_partkey, p_name, case p_partkey % 4 when 0 then null when 1 then ' ' || chr(10) when 2 then p_type || chr(10) || 'x' || chr(13) || 'y' else repeat(p_type || ' ', 40) end as t from part), e as (select *, translate(coalesce(t, ''), chr(13) || chr(10), '  ') as u from d) select p_partkey, p_name || ': ' || case when trim(u) = '' then '(no description)' else left(u, 256) end as text from e")
def c5_entity_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    description = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit(" \n")).when(k == 2, F.concat("p_type", F.lit("\nx\ry"))).otherwise(F.repeat(F.concat("p_type", F.lit(" ")), F.lit(40)))
    return catalog.table(spark, sf_dir, "part").select("p_partkey", scalars.entity_text("p_name", description).alias("text"))


@query(sql("points") + "select doc_id, lower(extension) as suffix, doc_id || extension as name, len(string_split(path_key, '/')) - 1 as n_parts, path_key[length(root_id) + 2:] as relative from points")
def c8_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path_key")
    return catalog.points(spark, sf_dir).select("doc_id", scalars.suffix(p).alias("suffix"), scalars.file_name(p).alias("name"), F.size(scalars.path_parts(p)).cast("long").alias("n_parts"), scalars.relative_to(p, F.col("root_id")).alias("relative"))


@query("select event_id, strftime(to_timestamp(event_id * 3600) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as iso from events")
def c11_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "events").select("event_id", scalars.iso_utc(F.col("event_id") * 3600).alias("iso"))


@query("select round(avg(list_cosine_similarity(a.embedding::double[], b.embedding::double[])), 6) as mean, count(*) as n from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def c12_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = catalog.table(spark, sf_dir, "embeddings")
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return v.join(b, "vec_id").agg(F.round(F.avg(scalars.cosine("embedding", "e2")), 6).alias("mean"), F.count("*").alias("n"))


@query("select event_id, case event_id % 4 when 0 then ['a', event_type] when 1 then [] when 2 then [] else ['1', 'x y'] end as items from events")
def c17_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays from JSON text; objects and what is no JSON give empty ones."""
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit('["a", "'), "event_type", F.lit('"]'))).when(k == 1, F.col("props")).when(k == 2, F.lit("no json [")).otherwise(F.lit('[1, "x y"]'))
    return catalog.table(spark, sf_dir, "events").select("event_id", scalars.string_list(text).alias("items"))


@query("select p_partkey, left(repeat(p_name || ' ', 30), 200) as title, left(repeat(p_type || ' ', 60), 500) as summary, list_transform(range(5), lambda i: left(i || repeat(p_brand, 40), 200)) as findings from part")
def c18_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports in fenced JSON, their fields cut to length: of seven findings five stay."""
    found = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.concat(F.lit('"'), i.cast("string"), F.repeat("p_brand", F.lit(40)), F.lit('"'))), ", ")
    text = F.concat(F.lit('```json\n{"title": "'), F.repeat(F.concat("p_name", F.lit(" ")), F.lit(30)), F.lit('", "summary": "'), F.repeat(F.concat("p_type", F.lit(" ")), F.lit(60)), F.lit('", "findings": ['), found, F.lit("]}\n```"))
    # A small file is few splits, and its rows are much work: they are dealt to all cores.
    p = catalog.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return p.select("p_partkey", scalars.report_fields(text).alias("r")).select("p_partkey", F.inline(F.array("r")))


@query("select p_partkey, case p_partkey % 3 when 0 then 'one' || chr(10) || p_brand when 1 then p_name else '' end as text from part")
def c22_content_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of messages whose content is a list of parts, a string, or something else."""
    k = F.col("p_partkey") % 3
    parts = F.concat(F.lit('[{"type": "text", "text": "one"}, {"type": "image", "text": "no"}, {"type": "text"}, {"type": "text", "text": "'), "p_brand", F.lit('"}]'))
    content = F.when(k == 0, parts).when(k == 1, F.concat(F.lit('"'), "p_name", F.lit('"'))).otherwise(F.lit('{"type": "text"}'))
    return catalog.table(spark, sf_dir, "part").select("p_partkey", scalars.joined_parts(content).alias("text"))


@query("select event_id, ts, case event_id % 3 when 2 then null else date_trunc('second', ts) end as parsed from events")
def c11_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.concat(F.date_format(F.col("ts") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise(F.lit("yesterday"))
    return catalog.table(spark, sf_dir, "events").select("event_id", "ts", scalars.iso_time(text).cast("timestamp_ntz").alias("parsed"))


@query("select vec_id, 'none' as confidence from embeddings where false union all select label::bigint, case when max(s) >= 0.7 then 'high' when max(s) >= 0.5 then 'medium' else 'low' end from (select label, list_cosine_similarity(embedding::double[], q) as s from embeddings, (select embedding::double[] as q from embeddings where vec_id = 0)) group by label")
def q11_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = search.scored(catalog.table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir))
    g = s.groupBy("label").agg(F.max("score").alias("best"), F.count("*").alias("n"))
    return g.select(F.col("label").cast("long").alias("vec_id"), search.confidence(F.col("best"), F.col("n")).alias("confidence"))


@query("with c as (select o_orderpriority, count(*) as expected, count(*) filter (where o_orderstatus = 'F') as covered from orders group by 1) select o_orderpriority, case when expected = 0 then 'failed' when covered = 0 then 'failed' when covered < expected then 'partial' else 'complete' end as state, expected, covered from c")
def q10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("expected"), F.count_if(F.col("o_orderstatus") == "F").alias("covered"))
    return c.select("o_orderpriority", search.coverage(F.col("expected"), F.col("covered"), F.lit(False)).alias("state"), "expected", "covered")


@query(sql("q") + ", c as (select vec_id, list_cosine_similarity(embedding::double[], q) as s from embeddings, q order by s desc, vec_id limit 5), e as (select vec_id, s from (select vec_id, label, list_cosine_similarity(embedding::double[], q) as s from embeddings, q) where label = 1 order by s desc, vec_id limit 3), u as (select 'chunks' as channel, vec_id::varchar as key, s from c union all select 'entities', vec_id::varchar, s from e) select channel, key, round(s, 6) as score, (row_number() over (partition by channel order by s desc, key))::int as rank from u")
def u6_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = catalog.table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir)
    key = F.col("vec_id").alias("key")
    out = search.envelope(chunks=search.nearest(v, q, 5, "vec_id").select(key, "score"), entities=search.nearest(v.where("label = 1"), q, 3, "vec_id").select(key, "score"))
    return out.withColumn("score", F.round("score", 6))


@query(_KNN + ", r as (select *, row_number() over (partition by root_id order by score desc, chunk_id) as k from s where root_id in ('/corpus/src1', '/corpus/src2')) select string_agg('File: ' || root_id || chr(10) || chunk_text, chr(10) || chr(10) order by score desc, root_id, chunk_id) as context from r where k <= 2")
def l12_answer_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context for an answer: the two best chunks of each of two sources, best first."""
    s = search.scored(catalog.points(spark, sf_dir, True), first_vector(spark, sf_dir))
    files = spark.createDataFrame([("/corpus/src1",), ("/corpus/src2",)], "root_id string")
    return search.answer_context(files, s, 2, "root_id")


@query(sql("points") + "select string_agg(chunk_text, chr(10) || chr(10) order by chunk_id, doc_id)[1:4000] as context from (select chunk_text, chunk_id, doc_id from points where root_id = '/corpus/src1' and doc_id < 100 order by chunk_id, doc_id limit 3)")
def l13_summary_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = catalog.points(spark, sf_dir).where("root_id = '/corpus/src1' and doc_id < 100")
    one = p.select(F.lit("/f").alias("path_key"), (F.col("chunk_id") * 1_000_000 + F.col("doc_id")).alias("chunk_id"), "chunk_text")
    return search.summary_context(one, "/f")


