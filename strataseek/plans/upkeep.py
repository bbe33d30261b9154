"""More queries with SQL: upkeep, extraction, the queue, dates and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import chunker
from ..functions import text as T
from ..operators import entities, graph, ontology
from ..sources import corpus as C
from ..sources import jsonl
from ..streaming import tasks
from .catalog import FOUND, MEM, NOW, asked, found, memories, query, table, task_state, vectors

ASK = """case event_id % 12 when 0 then event_id || ' days ago' when 1 then 'a couple of days ago' when 2 then 'What was it yesterday?' when 3 then 'A week  ago' when 4 then (event_id % 9) || ' weeks ago, or yesterday'
 when 5 then 'last week' when 6 then 'a month ago' when 7 then (event_id % 5) || ' month ago' when 8 then 'last month' when 9 then 'last year' when 10 then 'never' else 'recently' end"""
DAY_SQL = " ".join(f"when regexp_matches(q, '{p}') then {f'try_cast(regexp_extract(q, $${p}$$, 1) as int) * {times}' if times else days}" for p, days, _, times in T.OFFSETS)
TOLERANCE_SQL = " ".join(f"when regexp_matches(q, '{p}') then {tol}" for p, _, tol, _ in T.OFFSETS)


@query(f"with a as (select event_id, lower({ASK}) as q from events) select event_id, (case {DAY_SQL} end)::bigint as days, (case {TOLERANCE_SQL} end)::bigint as tolerance from a")
def relative_dates(spark, d):
    made = table(spark, d, "events").select("event_id", T.day_offset(F.expr(ASK)).alias("x"))
    return made.select("event_id", "x.days", "x.tolerance")


@query("select event_id, epoch_us(date_trunc('day', ts)) // 1000000 as day from events where event_id % 7 <> 0 union all select event_id, null from events where event_id % 7 = 0")
def question_day(spark, d):
    ts = F.col("ts").cast("timestamp")
    said = F.when(F.col("event_id") % 7 == 0, "some day (Sat)").otherwise(F.date_format(ts, "yyyy/MM/dd (E) HH:mm"))
    return table(spark, d, "events").select("event_id", F.unix_timestamp(jsonl.question_day(said).cast("timestamp")).alias("day"))


TOKS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda t: length(t) > 2)"


@query(f"""with {MEM}, c as (select id, title, {TOKS.format('content')} as a, {TOKS.format('title')} as b from mem), k as (select id, title, list_filter(a, lambda t: list_contains(b, t)) as w from c)
select id, if(len(w) > 0, 'name match: ''' || array_to_string(w[1:3], ' ') || ''' → ' || substring(trim(title), 1, 80), 'content overlap → ' || substring(trim(title), 1, 80)) as reason from k""")
def suggested_reason(spark, d):
    return memories(spark, d).select("id", T.reason(F.col("content"), F.col("title")).alias("reason"))


@query(f"with {FOUND}, tk as (select item_id as query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as token from benchmark), s as (select distinct lower(name) as form, md5(nn || chr(0) || type) as canon, nn from ent) select query_id, canon from tk join s on contains(form, token) union select query_id, canon from tk join s on token = nn")
def seed_entities(spark, d):
    f = found(spark, d)
    stored = entities.upsert(f).withColumn("canonical_id", F.lit(None).cast("string"))
    said = f.select(F.md5(F.concat_ws("\0", T.normalize_name(F.col("name")), "type")).alias("entity_id"), "surface_form")
    tokens = asked(spark, d).select("query_id", F.explode(F.array_distinct(T.ascii_tokens(F.col("query")))).alias("token"))
    return graph.seed_entities(tokens, said, stored)


@query("select 'error' as severity, 'event_time' as \"check\", 'e' || event_id as subject, 'end before start' as detail from events where event_id % 3 = 1 and event_type <> 'view'")
def ontology_event_times(spark, d):
    e = table(spark, d, "events")
    at = F.col("ts").cast("timestamp")
    end = F.when(F.col("event_id") % 3 == 0, at + F.expr("interval 1 hour")).when(F.col("event_id") % 3 == 1, at - F.expr("interval 1 hour")).otherwise(at)
    kind = F.when(F.col("event_type") == "view", "Note").otherwise("Event")
    text = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return ontology.event_times(e.select(F.concat(F.lit("e"), "event_id").alias("id"), kind.alias("type"), F.create_map(F.lit("start"), text(at), F.lit("end"), text(end)).alias("properties")))


@query("with r as (select 'p' || l_partkey as s, 's' || l_suppkey as t, 'references' as r, l_orderkey as m, l_discount as c from lineitem), old as (select distinct s, t, r, m from r where m % 3 = 0) select s as source_entity_id, t as target_entity_id, r as relation_type, m as source_memory_id, max(c) as confidence from r where not exists (select 1 from old where old.s = r.s and old.t = r.t and old.m = r.m) group by all")
def relation_insert(spark, d):
    r = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("source_entity_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_entity_id"), F.lit("references").alias("relation_type"), F.col("l_orderkey").alias("source_memory_id"), F.col("l_discount").alias("confidence"))
    return entities.new_relations(r, r.where("source_memory_id % 3 = 0"))


@query(f"with {FOUND} select md5(nn || chr(0) || type) as id, nn as name_normalized, type, count(*) as mention_count from ent group by nn, type having count(*) >= 2 and length(nn) % 5 <> 0")
def candidate_entities(spark, d):
    stored = entities.upsert(found(spark, d)).withColumn("canonical_id", F.when(F.length("name_normalized") % 5 == 0, F.lit("x")))
    return entities.candidates(stored).select("id", "name_normalized", "type", "mention_count")


@query("with v as (select vec_id as id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings), p as (select a.id as a, b.id as b from v a join v b on a.label = b.label and a.id < b.id where round(list_cosine_similarity(a.e, b.e), 6) >= 0.4) select count(*) as pairs, count(*) filter (where a % 2 = 0) as merged, round(count(*) * 0.0002e0, 6) as cost from p")
def dedup_pass_summary(spark, d):
    pairs = entities.duplicate_pairs(vectors(spark, d).select("id", F.col("label").alias("type"), "embedding"), 0.4)
    return entities.dedup_summary(pairs, F.col("a") % 2 == 0)


@query(f"with {FOUND} select memory_id, count(distinct nn || chr(0) || type) as entities, count(*) as mentions from ent group by 1")
def extraction_counts(spark, d):
    return entities.write_counts(found(spark, d))


@query("select doc_id as id, case when doc_id % 2 = 0 then length(text) >= 1500 else length(text) > 2000 end as chunked from documents where text is not null")
def chunk_hysteresis(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select(F.col("doc_id").alias("id"), chunker.keep_chunked(F.col("doc_id") % 2 == 0, F.col("text")).alias("chunked"))


@query("select 'memory' as level, count(*) as total, count(*) filter (where vec_id % 3 = 0 or vec_id % 5 = 0) as stale from embeddings")
def status_report(spark, d):
    v = vectors(spark, d)
    meta = v.where("id % 3 <> 0").select("id", F.lit("local").alias("model_name"), F.when(F.col("id") % 5 == 0, "v0").otherwise("v1").alias("model_version"), F.lit(384).alias("dim"))
    waiting = C.stale(meta, v.select("id"), "local", "v1", 384)
    return v.agg(F.count("*").alias("total")).crossJoin(waiting.agg(F.count("*").alias("stale"))).select(F.lit("memory").alias("level"), "total", "stale")


@query("with v as (select vec_id as id, vec_id % 4 as chunk_index, label from embeddings) select id, chunk_index from v where id % 3 = 0 or label = 3")
def stale_chunks(spark, d):
    v = vectors(spark, d).withColumn("chunk_index", F.col("id") % 4)
    key = F.concat_ws(":", "id", "chunk_index")
    meta = v.where("id % 3 <> 0").select(key.alias("id"), F.lit("m").alias("model_name"), F.lit("1").alias("model_version"), F.when(F.col("label") == 3, 64).otherwise(384).alias("dim"))
    rows = v.select(key.alias("id"), F.col("id").alias("row_id"), "chunk_index")
    return C.stale(meta, rows, "m", "1", 384).select(F.col("row_id").alias("id"), "chunk_index")


@query(f"with {MEM} select 'extract:' || id as task_id, id::varchar as memory_id, 'extract' as task_type, 'pending' as status from mem where length(content) > 50 and id % 5 <> 0 and id % 3 <> 0")
def enqueue_extract(spark, d):
    """Tasks of memories that no agent has extracted (a fifth has been), but for those that wait."""
    mem = memories(spark, d).withColumn("agent_provided", F.col("id") % 5 == 0).withColumn("id", F.col("id").cast("string"))
    new = tasks.to_extract(mem, F.lit(NOW))
    waiting = new.where(F.col("memory_id").cast("bigint") % 3 == 0)
    return tasks.enqueue_once(new, waiting).select("task_id", "memory_id", "task_type", "status")


@query("with e as (select 't' || (user_id % 100) as task_id, case event_type when 'view' then 'pending' when 'click' then 'running' when 'purchase' then 'done' when 'error' then 'failed' else 'pending' end as status, case user_id % 3 when 0 then 'extract' when 1 then 'dedup' else 'reembed' end as task_type, epoch_us(ts) / 1e6 as ts, event_id from events), st as (select * from (select *, row_number() over (partition by task_id, task_type order by ts desc, event_id desc) as n from e) where n = 1) select task_type, task_id from (select *, row_number() over (partition by task_type order by ts, event_id) as k from st where status = 'pending') where k = 1")
def queue_claim(spark, d):
    """The task of each type that has waited longest."""
    return tasks.claim(task_state(spark, d), ["ts", "event_id"]).select("task_type", "task_id")


@query(f"with {MEM} select id, title, array_to_string(tags, ',') as tags, status, accessed_at as updated_at, count(*) over () as total from mem where list_contains(tags, 'en') order by accessed_at desc, id limit 100 offset 0")
def list_by_tags(spark, d):
    return C.page(memories(spark, d).withColumn("updated_at", F.col("accessed_at")), ["en"], 1000, 0, True).withColumn("tags", F.array_join("tags", ","))


@query("with t as (select conv_id, '[conv_' || conv_id || '] ' || text as title from conversations where turn = 0) select t.title, c.conv_id, count(*) as n from t join conversations c on c.conv_id = t.conv_id group by 1, 2")
def title_prefix_join(spark, d):
    """Hits tell their session by the ``[id]`` that their titles begin with."""
    turns = table(spark, d, "conversations")
    titled = turns.where("turn = 0").select(F.concat(F.lit("[conv_"), "conv_id", F.lit("] "), "text").alias("title"))
    at = titled.select("title", F.regexp_extract("title", r"^\[conv_(\d+)\]", 1).cast("bigint").alias("conv_id"))
    return at.join(turns, "conv_id").groupBy("title", "conv_id").agg(F.count("*").alias("n"))


@query(f"with {MEM} select id, '[\"' || array_to_string(tags, '\",\"') || '\"]' as tags from mem")
def tags_json(spark, d):
    made = memories(spark, d).select("id", F.to_json("tags").alias("tags"))
    return made.select("id", F.to_json(F.from_json("tags", "array<string>")).alias("tags"))


def _types(i: int) -> str:
    return entities.ENTITY_TYPES[i % len(entities.ENTITY_TYPES)]


@query("select doc_id as id, (if(doc_id % 2 = 0, 1, 0) + if(doc_id % 3 = 0, 1, 0) + if(doc_id % 5 = 0, 1, 0) + if(doc_id % 7 = 0, 1, 0))::bigint as wrong from documents")
def payload_check(spark, d):
    docs = table(spark, d, "documents")
    item = lambda name, kind: F.struct(name.alias("name"), kind.alias("type"), F.lit(None).cast("string").alias("surface_form"))
    i = F.col("doc_id")
    ents = F.array(item(F.when(i % 2 == 0, " ").otherwise("a"), F.lit(_types(0))), item(F.lit("b"), F.when(i % 3 == 0, "Thing").otherwise(_types(1))), item(F.when(i % 5 == 0, F.repeat(F.lit("x"), F.lit(S.NAME_CHARS + 1))).otherwise("c"), F.lit(_types(2))))
    rel = F.array(F.struct(F.lit("a").alias("from"), F.lit("b").alias("to"), F.when(i % 7 == 0, "likes").otherwise("mentions").alias("rel")))
    return docs.select(i.alias("id"), F.size(entities.payload_errors(ents, rel)).alias("wrong"))
