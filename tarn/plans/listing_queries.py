"""Queries on conflicts, model replies, lookups, listings and checks before an entity changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import conflicts as K
from tarn.operators import listings as L
from tarn.operators import replies as P
from tarn.plans import fixtures as X
from tarn.plans.fixtures import sql
from tarn.plans.registry import Registry
from tarn.tables import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

RESOLUTION = "case doc_id % 4 when 1 then 'supersede' when 2 then 'keep_both' when 3 then 'merge' end"
DEC = f"""dec as (select doc_id as id, doc_id as incoming, doc_id + 1 as c1, doc_id + 2 as c2, {RESOLUTION} as resolution,
 case when doc_id % 8 = 1 then doc_id when doc_id % 8 = 5 then doc_id + 1 end as winner, case when doc_id % 3 = 0 then 'llm' end as decided_by from documents)"""
MERGE = """mrg as (select c_custkey as id, c_nationkey * 40 as canonical_id, c_name as source_name, c_custkey % 3 = 0 as live from customer)"""


def now() -> Column:
    return F.lit("2024-06-01").cast("timestamp")


def decisions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr(
        "doc_id as id", "doc_id as incoming", "array(doc_id + 1, doc_id + 2) as candidates", f"{RESOLUTION} as resolution",
        "case when doc_id % 8 = 1 then doc_id when doc_id % 8 = 5 then doc_id + 1 end as winner", "case when doc_id % 3 = 0 then 'llm' end as decided_by",
        "doc_id as created_at", "doc_id as resolved_at",
    )


def merges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr(
        "c_custkey as id", "cast(c_nationkey * 40 as long) as canonical_id", "c_name as source_name", "case when c_custkey % 3 <> 0 then c_custkey end as reverted_at", "c_custkey as created_at"
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Turns as chunks of their conversation; every third conversation is a session of its own."""
    return table(spark, d, "conversations").selectExpr(
        "10000000 + conv_id * 1000 + turn as id", "conv_id as document", "turn as place", "text as content", "case when conv_id % 3 = 0 then conv_id end as session_id"
    )


CHUNK = """chunk as (select 10000000 + conv_id * 1000 + turn as id, conv_id as document, turn as place, text as content, case when conv_id % 3 = 0 then conv_id end as session_id from conversations)"""


@query(
    sql(
        "mem",
        f""", {DEC}, two as (select id, incoming, unnest([c1, c2]) as candidate, unnest([0, 1]) as place from dec where resolution is null)
select two.id, incoming, candidate, cast(place as integer) as place, round(list_cosine_similarity(a.vec::double[], b.vec::double[]), 6) as similarity
from two left join mem a on a.id = incoming left join mem b on b.id = candidate""",
    )
)
def pending_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return K.pending(decisions(spark, d), X.mem(spark, d)).withColumn("similarity", F.round("similarity", 6))


@query(
    f"""with {DEC} select id, case when resolution = 'supersede' then case when winner = incoming then 'keep_new' else 'keep_existing' end else resolution end as outcome,
coalesce(decided_by, 'human') as decided_by from dec where resolution is not null"""
)
def resolved_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return K.settled(decisions(spark, d))


@query(
    f"""with {DEC}, pr as (select l_orderkey as a, l_partkey as b from lineitem), own as (select incoming as low, c1 as high from dec union all select incoming, c2 from dec)
select a, b from pr anti join own on low = least(a, b) and high = greatest(a, b)"""
)
def unqueued_pairs(spark: SparkSession, d: str) -> DataFrame:
    return K.unqueued(table(spark, d, "lineitem").selectExpr("l_orderkey as a", "l_partkey as b"), decisions(spark, d))


MERGED = f"""{DEC}, dm as (select *, 1000000 + id as made from dec where resolution = 'merge'),
gone as (select incoming as id from dm union select c1 from dm union select c2 from dm),
lin as (select dm.made, coalesce(m.root_id, dm.made) as root_id, coalesce((select max(version) from mem h where h.root_id = m.root_id), 0) as head from dm left join mem m on m.id = c1)"""


def _decided(spark: SparkSession, d: str) -> DataFrame:
    return decisions(spark, d).filter("resolution = 'merge'").selectExpr("id", "incoming", "candidates", "1000000 + id as made", "'merged ' || id as content")


@query(
    sql(
        "mem",
        f""", {MERGED} select id, case when id in (select id from gone) then 'stale' else status end as status, root_id, version from mem
union all select made, 'active', root_id, cast(head + row_number() over (partition by root_id order by made) as integer) from lin""",
    )
)
def merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    after, _ = K.merge_conflicts(_decided(spark, d), X.plain_mem(spark, d), now())
    return after.select("id", "status", "root_id", "version")


@query(
    sql(
        "mem rep",
        f""", {MERGED} select 'belief' as what, id, status = 'active' as active from mem union all select 'belief', made, false from lin
union all select 'edge', from_id, active from rep
union all select 'edge', made, false from dm union all select 'edge', made, false from dm union all select 'edge', made, false from dm""",
    )
)
def revert_merges(spark: SparkSession, d: str) -> DataFrame:
    decided = _decided(spark, d)
    after, made = K.merge_conflicts(decided, X.plain_mem(spark, d), now())
    rows, edges = K.revert_merges(decided, after, X.rep(spark, d).unionByName(made), now())
    return rows.select(F.lit("belief").alias("what"), "id", (F.col("status") == "active").alias("active")).unionByName(
        edges.select(F.lit("edge").alias("what"), F.col("from_id").alias("id"), "active")
    )


@query(
    """select c_custkey as id, case c_custkey % 5 when 0 then 'keep_new' when 1 then 'keep_both' when 2 then 'keep_existing' else 'unsure' end as verdict,
case when c_custkey % 5 = 2 then case when c_nationkey between 1 and 2 then c_nationkey * 10 else 10 end end as winner,
case c_custkey % 5 when 3 then 'model did not decide' when 4 then 'unparseable reply' else 'r' || c_custkey end as reason from customer"""
)
def auto_resolutions(spark: SparkSession, d: str) -> DataFrame:
    """Replies of a scripted model, one of five kinds: three verdicts, one without any, one not JSON."""
    prompts = table(spark, d, "customer").selectExpr("c_custkey as id", "c_custkey || ' ' || c_nationkey as prompt")

    def scripted(batch: list[str]) -> list[str]:
        made = []
        for prompt in batch:
            key, nation = map(int, prompt.split())
            said = ("KEEP_NEW", "keep_both", "keep_existing", "", "")[key % 5]
            reason = "" if key % 5 == 3 else f"r{key}"
            made.append("I can't tell" if key % 5 == 4 else f'Sure: [{{"verdict": "{said}", "existing": {nation}, "reason": "{reason}"}}]')
        return made

    replies = P.completed(prompts, scripted).withColumn("candidates", F.array(F.lit(10), F.lit(20)))
    return P.resolutions(replies)


@query(
    """select p_partkey as a, p_size as b, case p_partkey % 4 when 0 then 'same' when 1 then 'distinct' else 'unsure' end as verdict,
least(1.0, p_size / 40.0) as confidence, p_name as reason from part where p_partkey % 4 <> 3"""
)
def entity_verdicts(spark: SparkSession, d: str) -> DataFrame:
    reply = """case when p_partkey % 4 = 3 then '{"verdict": "maybe"}' else concat('Answer: {"verdict": "', case p_partkey % 4 when 0 then 'Same' when 1 then 'distinct' else ' unsure' end,
 '", "confidence": ', p_size / 40.0D, ', "reason": " ', p_name, ' "}') end as reply"""
    return P.entity_verdicts(table(spark, d, "part").selectExpr("p_partkey as a", "p_size as b", reply))


@query(
    """select conv_id as session, turn as chunk, cast(k as integer) as place, case k when 0 then 'fact' else 'episode' end as type, case k when 0 then 'a' || turn else 'b' end as content,
case k when 0 then 'c' end as canonical, case k when 0 then 10 else 12 end as from_line, case k when 0 then 20 else 13 end as to_line from conversations, (values (0), (3)) v(k)"""
)
def distilled_memories(spark: SparkSession, d: str) -> DataFrame:
    reply = """concat('[{"type": "fact", "content": " a', turn, ' ", "canonical": "c", "lines": [3, 99]}, {"type": "joke", "content": "x"}, 7,
 {"type": "episode", "content": "b", "canonical": " ", "lines": [11.6, 13]}, {"type": "fact", "content": " "}]') as reply"""
    rows = table(spark, d, "conversations").selectExpr("conv_id as session", "turn as chunk", "10L as first", "20L as last", reply)
    return P.distilled(rows)


@query(
    sql(
        "mem",
        f""", {CHUNK}, ids as (select doc_id as id from documents union select 10000000 + l_orderkey * 1000 from lineitem),
both_ as (select id, text as content from mem union all select id, content from chunk) select ids.id, sha256(content) as content_hash from ids left join both_ on both_.id = ids.id""",
    )
)
def passages(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "documents").selectExpr("doc_id as id").union(table(spark, d, "lineitem").selectExpr("10000000 + l_orderkey * 1000"))
    return L.passages(ids, X.plain_mem(spark, d), chunks(spark, d)).select("id", F.sha2("content", 256).alias("content_hash"))


@query(f"with {CHUNK} select id, document from chunk where session_id is null or session_id = 3")
def session_scope(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).filter(L.in_session(F.col("session_id"), F.lit(3))).select("id", "document")


@query("select event_id as id from events where event_id % 5 not in (0, 1, 2)")
def recall_prompts(spark: SparkSession, d: str) -> DataFrame:
    prompt = F.expr("case event_id % 5 when 0 then ' \n' when 1 then '\t/help' when 2 then '!ls' else ' why / when ' || event_type end")
    return table(spark, d, "events").filter(L.asks(prompt)).select(F.col("event_id").alias("id"))


@query(
    """with m as (select p_name as title, 'kb/' || p_partkey as path from part where contains(lower(p_name), 'an') or contains('kb/' || p_partkey, 'an'))
select title, path, cast(null as bigint) as more from (select * from m order by title, path limit 50)
union all select null, null, count(*) - 50 from m having count(*) > 50"""
)
def list_documents(spark: SparkSession, d: str) -> DataFrame:
    return L.list_documents(table(spark, d, "part").selectExpr("p_name as title", "'kb/' || p_partkey as path"), " AN ")


@query(sql("mem act", "select cast(floor(avg(length(text)) + 0.5) as bigint) as chars from act"))
def mean_length(spark: SparkSession, d: str) -> DataFrame:
    return L.mean_length(X.plain_mem(spark, d))


@query(sql("ent", f", {MERGE} select mrg.id, canonical_id, coalesce(ent.name, '(removed)') as canonical_name, source_name, live from mrg left join ent on ent.id = canonical_id"))
def entity_merges(spark: SparkSession, d: str) -> DataFrame:
    return L.entity_merges(merges(spark, d), X.plain_ent(spark, d))


@query(
    sql(
        "ent",
        f""", {DEC}, late as (select * from dec where resolution = 'keep_both' order by dec.id desc limit 50)
select late.id, coalesce(a.name, '(gone)') as incoming_name, coalesce(b.name, '(gone)') as candidate_name, coalesce(decided_by, 'human') as decided_by
from late left join ent a on a.id = incoming left join ent b on b.id = c1""",
    )
)
def settled_pairs(spark: SparkSession, d: str) -> DataFrame:
    return L.settled_pairs(decisions(spark, d), X.plain_ent(spark, d))


@query(
    f"""with {CHUNK}, e as (select 10000000 + l_orderkey * 1000 + l_linenumber as from_id, l_partkey as to_id from lineitem where l_returnflag <> 'R' and l_linenumber % 4 <> 3)
select document, place, id, to_id as entity from chunk left join e on from_id = id"""
)
def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem").selectExpr(
        "10000000 + l_orderkey * 1000 + l_linenumber as from_id", "l_partkey as to_id", "case when l_linenumber % 4 = 3 then 'about' else 'mention' end as relation", "l_returnflag <> 'R' as active"
    )
    rows = chunks(spark, d)
    return L.document_chunks(rows.select("document"), rows, edges)


@query(
    sql(
        "typed edge",
        """, sup as (select s_suppkey + 1000 as id from supplier) select from_id, to_id, relation from (select from_id, to_id, relation from typed union all select from_id, to_id, relation from edge)
where relation <> 'mention' and from_id not in (select id from sup) and to_id not in (select id from sup)""",
    )
)
def wiped_edges(spark: SparkSession, d: str) -> DataFrame:
    shape = ["from_id", "to_id", "relation"]
    edges = X.typed(spark, d).select(*shape).unionByName(X.edge(spark, d).select(*shape))
    return L.wiped_edges(edges, table(spark, d, "supplier").selectExpr("s_suppkey + 1000 as id"))


@query(sql("mem act", f", {CHUNK} select 'memory' as src, id from act union all select 'chunk', id from chunk where session_id is null"))
def to_index_anew(spark: SparkSession, d: str) -> DataFrame:
    return L.to_index_anew(X.plain_mem(spark, d), chunks(spark, d))


PATCH = (
    "case p_partkey % 6 when 0 then null when 1 then '  ' when 2 then '@' || upper(p_name) when 3 then 'Alias ' || (p_partkey + 1) when 4 then 'alias ' || p_partkey else 'new ' || p_partkey end as name",
    "case when p_partkey % 7 = 0 then 'nonsense' when p_partkey % 7 < 4 then lower(p_type) end as entity_type",
)


@query(
    f"""with pat as (select p_partkey + p_partkey % 11 // 10 * 10000000 as id, p_partkey as k, {', '.join(PATCH)} from part),
own as (select lower(trim(p_name)) as key, min(p_partkey) as low, max(p_partkey) as high from part group by 1)
select pat.id, case when pat.id <> k then 'unknown' when entity_type = 'nonsense' then 'type' when k % 6 = 1 then 'empty'
 when k % 6 = 2 and (low <> pat.id or high <> pat.id) then 'taken' when k % 6 = 3 and k + 1 in (select p_partkey from part) then 'alias' else 'ok' end as verdict
from pat join part on part.p_partkey = k left join own on own.key = lower(trim(p_name))"""
)
def rename_verdicts(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    patches = part.selectExpr("p_partkey + (case when p_partkey % 11 = 10 then 10000000 else 0 end) as id", *PATCH)
    aliases = part.selectExpr("'alias ' || p_partkey as name_key", "p_partkey as canonical_id")
    types = part.selectExpr("lower(p_type) as type")
    return L.rename_verdicts(patches, part.selectExpr("p_partkey as id", "p_name as name"), aliases, types)


@query(
    f"""with {MERGE}, ids as (select p_partkey as id from part union all select -1), f as (select canonical_id, count(*) as folds from mrg where live group by 1)
select ids.id, case when folds is not null then 'folded' when ids.id = -1 then 'unknown' else 'ok' end as verdict, coalesce(folds, 0) as folds from ids left join f on canonical_id = ids.id"""
)
def delete_verdicts(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").selectExpr("p_partkey as id")
    ids = part.union(spark.range(1).selectExpr("-1L"))
    return L.delete_verdicts(ids, part, merges(spark, d))


@query(
    """with ed as (select user_id as id, max(event_id) as edited from events group by 1)
select id, edited from ed where not (id % 3 = 0)"""
)
def to_refetch(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "events").selectExpr("user_id as id", "event_id as edited")
    cached = listed.groupBy("id").agg(F.max("edited").alias("edited"))
    return L.to_refetch(listed, cached.withColumn("edited", F.when(F.col("id") % 3 != 0, F.col("edited") - 1).otherwise(F.col("edited"))))


@query("select event_id as id from events where date_diff('microsecond', ts, (select max(ts) from events)) >= 2000000")
def stable_files(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("modified"))
    latest = files.agg(F.max("modified")).first()[0]
    return L.stable(files, F.lit(latest)).select("id")
