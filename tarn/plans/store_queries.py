"""Belief-store, reconciliation and session queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.checkpoints import shared_dir
from tarn.operators import beliefs as B
from tarn.operators import reconcile as C
from tarn.operators import sessions as S
from tarn.plans import fixtures as X
from tarn.plans.fixtures import sql
from tarn.plans.registry import Registry
from tarn.sources import files
from tarn.sources.store import Store, merged
from tarn.tables import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

DUP = """dup as (select id, keeper from (select id, first_value(id) over (partition by content_hash order by asserted_at, id) as keeper from act) where id <> keeper)"""
LEAK = """leak as (select distinct a.id from act a join rep r on r.to_id = a.id and r.active join act b on b.id = r.from_id)"""
STALE = """orphan as (select id from mem where status = 'stale' and id not in (select to_id from rep where active))"""
HEADS = """heads as (select root_id, count(*) as heads, string_agg(cast(id as varchar), ',' order by version, id) as ids from act group by root_id having count(*) > 1)"""


@query(sql("mem", "select id, text from mem where status = 'active' order by asserted_at desc, id limit 20"))
def memories(spark: SparkSession, d: str) -> DataFrame:
    rows = X.plain_mem(spark, d).filter("status = 'active'")
    return rows.orderBy(F.desc("asserted_at"), "id").limit(20).select("id", F.col("content").alias("text"))


@query(sql("mem act", f", {DUP} select id, keeper from dup"))
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return B.exact_duplicates(X.plain_mem(spark, d))


@query(sql("mem act rep", f", {LEAK} select id from leak"))
def replaces_leaks(spark: SparkSession, d: str) -> DataFrame:
    return B.replaces_leaks(X.plain_mem(spark, d), X.rep(spark, d))


@query(sql("mem rep", f", {STALE} select id from orphan"))
def orphan_stale(spark: SparkSession, d: str) -> DataFrame:
    return B.stale_without_edge(X.plain_mem(spark, d), X.rep(spark, d))


@query(sql("mem act", f", {HEADS} select root_id, heads, ids from heads"))
def multi_head(spark: SparkSession, d: str) -> DataFrame:
    return B.multi_head(X.plain_mem(spark, d))


@query(
    sql(
        "mem",
        """select a.id as asked, b.id, b.version, b.status, cast(row_number() over (partition by a.id order by b.version desc, b.id desc) as integer) as place
from mem a join mem b on a.root_id = b.root_id""",
    )
)
def version_history(spark: SparkSession, d: str) -> DataFrame:
    rows = X.plain_mem(spark, d)
    return B.history(rows, rows.select("id"))


@query(
    sql(
        "mem",
        """, child as (select id + 1000000 as id, id as parent from mem where id % 4 = 0)
select id, case when id in (select parent from child) then 'stale' else status end as status, root_id, version from mem
union all select c.id, 'active', m.root_id, m.version + 1 from child c join mem m on m.id = c.parent""",
    )
)
def new_versions(spark: SparkSession, d: str) -> DataFrame:
    rows = X.plain_mem(spark, d)
    children = rows.filter("id % 4 = 0").select((F.col("id") + 1000000).alias("id"), F.col("id").alias("parent"), F.lit("next").alias("content"))
    return B.new_versions(rows, children, F.lit("2024-06-01").cast("timestamp"))[0].select("id", "status", "root_id", "version")


INCOMING = """inc as (select item_id as id, text, sha256(text) as content_hash from benchmark union all select 100000 + doc_id, text, sha256(text) from documents where doc_id % 2 = 0),
cand as (select id, id * 3 as candidate from inc where id % 3 <> 0),
verd as (select id, candidate, case id % 5 when 1 then 'identical' when 2 then 'contradictory' else 'complementary' end as label from cand)"""


@query(
    sql(
        "mem act",
        f""", {INCOMING}, one as (select *, min(id) over (partition by content_hash) as twin from inc)
select one.id, case when one.content_hash in (select content_hash from act) or twin <> one.id then 'merged' when label = 'contradictory' then 'conflict'
 when label = 'identical' then 'versioned' else 'added' end as outcome from one left join verd on verd.id = one.id""",
    )
)
def save_outcomes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("doc_id % 2 = 0").selectExpr("100000 + doc_id as id", "text")
    incoming = table(spark, d, "benchmark").selectExpr("item_id as id", "text").union(docs).withColumn("content_hash", F.sha2("text", 256))
    candidates = incoming.filter("id % 3 <> 0").selectExpr("id", "id * 3 as candidate")
    label = "case id % 5 when 1 then 'identical' when 2 then 'contradictory' else 'complementary' end as label"
    return B.save_outcomes(incoming, X.plain_mem(spark, d), candidates, candidates.selectExpr("id", "candidate", label)).select("id", "outcome")


def _conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = X.plain_mem(spark, d).filter("id % 9 = 0 and status = 'active'")
    action = F.expr("case id % 2 when 0 then 'keep_new' else 'keep_existing' end")
    return rows.select(
        F.col("id").alias("incoming"), F.array(F.col("id") + 1).alias("candidates"), "id", action.alias("action"), F.lit(None).cast("long").alias("winner")
    )


CONF = """conf as (select id as incoming, id + 1 as candidate, case id % 2 when 0 then 'keep_new' else 'keep_existing' end as action from mem where id % 9 = 0 and status = 'active'),
head as (select root_id, max(version) as head from mem group by root_id),
gone as (select candidate as id from conf where action = 'keep_new' union select incoming from conf where action = 'keep_existing'),
moved as (select c.incoming as id, m.root_id as to_root, h.head from conf c join mem m on m.id = c.candidate join head h on h.root_id = m.root_id where action = 'keep_new')"""


@query(
    sql(
        "mem",
        f""", {CONF} select mem.id, case when mem.id in (select id from gone) then 'stale' else status end as status, coalesce(to_root, root_id) as root_id,
cast(coalesce(head + 1, version) as integer) as version from mem left join moved on moved.id = mem.id""",
    )
)
def resolve_conflicts(spark: SparkSession, d: str) -> DataFrame:
    after, _, _ = B.resolve_conflicts(_conflicts(spark, d), X.plain_mem(spark, d), F.lit("2024-06-01").cast("timestamp"))
    return after.select("id", "status", "root_id", "version")


@query(sql("mem", "select id, status, root_id, version from mem"))
def revert_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows, edges = X.plain_mem(spark, d), X.rep(spark, d)
    after, made, decisions = B.resolve_conflicts(_conflicts(spark, d), rows, F.lit("2024-06-01").cast("timestamp"))
    return B.revert_conflicts(decisions, after, edges.unionByName(made))[0].select("id", "status", "root_id", "version")


@query("select count(*) filter (where doc_id is not null) as kept, count(distinct doc_id - doc_id % 3) as roots from documents where doc_id - doc_id % 3 not in (select doc_id - doc_id % 3 from documents where doc_id % 11 = 0)")
def delete_lineages(spark: SparkSession, d: str) -> DataFrame:
    rows = X.plain_mem(spark, d)
    left, _ = B.without_lineages(rows, X.rep(spark, d), rows.filter("id % 11 = 0").select("id"))
    return left.agg(F.count("*").alias("kept"), F.countDistinct("root_id").alias("roots"))


@query(
    """select event_id as id, case when event_id % 4 = 0 then null else event_id % 60 end as age from events
where event_type <> 'error' and (event_id % 4 = 0 or event_id % 60 > 30)"""
)
def due_for_recheck(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") != "error", "active").otherwise("stale").alias("status"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 60).alias("age"),
    )
    rows = rows.withColumn("last_rechecked_at", now - F.make_interval(days=F.col("age").cast("int")))
    return B.due(rows, now).select("id", "age")


FIND = f"""{DUP}, {LEAK}, {STALE}, {HEADS}, every as (
 select 'retire' as kind, 'duplicate' as class, id as subject, 'same text as ' || keeper as reason, false as integrity, 1 as pass from dup
 union all select 'retire', 'leak', id, 'replaced but active', true, 2 from leak
 union all select 'conflict', 'multi_head', root_id, 'heads ' || ids, false, 3 from heads
 union all select 'question', 'orphan', id, 'stale, nothing replaces it', false, 4 from orphan),
found as (select * exclude (n) from (select *, row_number() over (partition by subject order by pass) as n from every) where n = 1)"""
CAPS = """caps as (select * from (values ('retire', false, 10), ('retire', true, 10), ('conflict', false, 5), ('question', false, 3)) v(kind, integrity, cap))"""


@query(sql("mem act rep", f", {FIND} select kind, class, subject, reason from found"))
def reconcile_findings(spark: SparkSession, d: str) -> DataFrame:
    return C.findings(X.plain_mem(spark, d), X.rep(spark, d)).select("kind", "class", "subject", "reason")


def _capped(spark: SparkSession, d: str) -> DataFrame:
    caps = [("retire", False, 10), ("retire", True, 10), ("conflict", False, 5), ("question", False, 3)]
    caps = spark.createDataFrame(caps, "kind string, integrity boolean, cap int")
    blocked = X.plain_mem(spark, d).filter("id % 13 = 0").select(F.col("id").alias("subject"))
    return C.capped(C.findings(X.plain_mem(spark, d), X.rep(spark, d)), caps, blocked)


@query(
    sql(
        "mem act rep",
        f""", {FIND}, {CAPS} select f.kind, f.class, f.subject, row_number() over (partition by f.kind, f.integrity order by pass, subject) <= cap as surfaced
from found f join caps using (kind, integrity) where subject % 13 <> 0""",
    )
)
def cap_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _capped(spark, d).select("kind", "class", "subject", "surfaced")


@query(sql("mem", "select id, status, true as intact from mem"))
def reconcile_revert(spark: SparkSession, d: str) -> DataFrame:
    rows = X.plain_mem(spark, d)
    after, ledger = C.apply_run(rows, _capped(spark, d), F.lit("2024-06-01").cast("timestamp"))
    back = C.revert_run(after, ledger)
    return back.select("id", "status", F.col("stale_since").isNull().alias("intact"))


@query(
    """select user_id as "group", least(3, sum(case when seen = 0 then 1 else 0 end)) as streak from (select user_id, max(case when event_type = 'purchase' then 1 else 0 end)
 over (partition by user_id order by ts desc, event_id desc rows unbounded preceding) as seen from events) group by user_id"""
)
def backoff_streak(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events")
    found = C.silent_streak(runs, "user_id", [F.desc("ts"), F.desc("event_id")], F.col("event_type") == "purchase")
    return found.select(F.col("user_id").alias("group"), "streak")


@query(
    """select user_id, least(3, sum(case when seen = 0 then 1 else 0 end)) as streak, cast(case when least(3, sum(case when seen = 0 then 1 else 0 end)) >= 3 then 0
 else floor(10 / pow(2, least(3, sum(case when seen = 0 then 1 else 0 end)))) end as integer) as cap from (select user_id, max(case when event_type = 'purchase' then 1 else 0 end)
 over (partition by user_id order by ts desc, event_id desc rows unbounded preceding) as seen from events) group by user_id"""
)
def effective_caps(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events")
    found = C.silent_streak(runs, "user_id", [F.desc("ts"), F.desc("event_id")], F.col("event_type") == "purchase")
    return found.withColumn("cap", C.effective_cap(F.lit(10), F.col("streak"), F.lit(False)))


@query(
    sql(
        "alias",
        """select a.id, exists (select 1 from alias b where b.entity_id = a.canonical_id) as chained from alias a
where canonical_id not in (select p_partkey from part)""",
    )
)
def alias_orphans(spark: SparkSession, d: str) -> DataFrame:
    return C.alias_orphans(X.alias(spark, d), X.plain_ent(spark, d))


@query(sql("alias", "select a.id, p.p_partkey as entity from alias a join part p on lower(p.p_name) = a.name_key where p.p_partkey <> a.canonical_id"))
def alias_shadows(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").selectExpr("p_partkey as id", "p_name as name")
    return C.alias_shadows(X.alias(spark, d), part, F.lower("name"))


@query(
    sql(
        "alias",
        """, c as (select lower(p_name) as k, min(p_partkey) as class_id, count(*) as n from part group by 1)
select a.id, class_id, n - (p_partkey is not null)::int as links from alias a join c on k = a.name_key left join part on p_partkey = canonical_id and lower(p_name) = a.name_key
where n > (p_partkey is not null)::int""",
    )
)
def alias_shadow_classes(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").selectExpr("p_partkey as id", "p_name as name")
    return C.alias_shadow_classes(X.alias(spark, d), part, F.lower("name"))


@query(
    sql(
        "edge",
        """, ends as (select id, from_id as missing from edge where active union all select id, to_id from edge where active)
select missing, count(distinct id) as edges from ends where missing not in (select doc_id from documents union select p_partkey from part) group by missing""",
    )
)
def stranded_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "documents").selectExpr("doc_id as id").union(table(spark, d, "part").select("p_partkey")).distinct()
    return C.stranded_edges(X.edge(spark, d), nodes)


@query(
    """select s_nationkey % 3 as model, cast(ceil(sum(length(s_name)) / 4.0) as bigint) as tokens, case s_nationkey % 3 when 2 then null else
 round((ceil(sum(length(s_name)) / 4.0) * (case s_nationkey % 3 when 0 then 1.5 else 3.0 end) + count(*) * 63 * 4.0) / 1000000, 6) end as usd from supplier group by s_nationkey % 3"""
)
def recheck_cost(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "supplier").groupBy((F.col("s_nationkey") % 3).alias("model")).agg(
        F.sum(F.length("s_name")).alias("input_chars"), F.count("*").alias("candidates")
    )
    prices = spark.createDataFrame([(0, 1.5, 4.0), (1, 3.0, 4.0)], "model int, input_price double, output_price double")
    return C.cost_estimate(calls, prices)


@query('select cast(cast(ts as date) as varchar) as day, count(*) as calls, cast(greatest(0, 200 - count(*)) as bigint) as "left" from events group by 1')
def daily_calls(spark: SparkSession, d: str) -> DataFrame:
    return S.daily_calls(table(spark, d, "events"))


@query(
    """select s.conv_id as session, case when o is null then 'new' when not same then 'changed' when o >= lines then 'up_to_date' else 'resume' end as action,
 cast(case when o is null or not same then 0 when o >= lines then lines else greatest(0, o - 40) end as bigint) as from_line from
 (select conv_id, count(*) as lines, case when conv_id % 4 = 0 then null when conv_id % 4 = 1 then count(*) else 3 end as o, conv_id % 5 <> 0 as same from conversations group by conv_id) s"""
)
def import_watermark(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "conversations").selectExpr("conv_id as session", "turn as line", "text as value")
    sizes = lines.groupBy("session").agg(F.count("*").alias("lines"))
    hashes = files.prefix_hash(lines, F.lit(1 << 40)).drop("lines")
    sessions = sizes.join(hashes, "session")
    ledger = sessions.filter("session % 4 <> 0").select(
        "session",
        F.when(F.col("session") % 4 == 1, F.col("lines")).otherwise(3).alias("line_offset"),
        F.when(F.col("session") % 5 != 0, F.col("prefix_hash")).otherwise("other").alias("ledger_hash"),
    )
    return S.resume_plan(sessions, ledger)


@query(
    """select conv_id as session, count(*) as lines, sha256(string_agg(text, chr(10) order by turn) || chr(10)) as prefix_hash from conversations where turn < 3 group by conv_id"""
)
def prefix_hashes(spark: SparkSession, d: str) -> DataFrame:
    return files.prefix_hash(table(spark, d, "conversations").selectExpr("conv_id as session", "turn as line", "text as value"), F.lit(3))


@query(
    """with m as (select conv_id * 10 as id, conv_id, 0 as a, 2 as b from conversations group by conv_id)
select m.id, min(turn) as first, max(turn) as last, substr(string_agg(text, chr(10) order by turn), 1, 500) as excerpt from m join conversations c on c.conv_id = m.conv_id and turn between a and b group by m.id"""
)
def provenance_excerpts(spark: SparkSession, d: str) -> DataFrame:
    units = X.sess(spark, d)
    memories_ = units.select((F.col("session") * 10).alias("id"), "session", F.lit(0).alias("first"), F.lit(2).alias("last")).distinct()
    return S.provenance(memories_, units)


@query()
def packed_sessions(spark: SparkSession, d: str) -> DataFrame:
    return S.packed_units(X.sess(spark, d), 2000)


@query("select c_custkey % 500 as key, max(c_custkey) as kept from customer group by 1")
def upsert_new(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select((F.col("c_custkey") % 500).alias("key"), F.col("c_custkey").alias("kept"))
    return merged(rows.filter("kept < 500"), rows.filter("kept >= 500"), ["key"])


@query(
    """with recursive lines as (select conv_id as session, turn as line, role, trim(text) as text from conversations) select session, line, role, text from lines
where role in ('user', 'assistant') and text <> '' and not starts_with(text, '<command-')"""
)
def transcript_units(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "conversations").select(
        F.col("conv_id").alias("session"),
        F.col("turn").alias("line"),
        F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message"))).alias("value"),
    )
    return files.transcript_units(made)


@query(
    """with old as (select p_brand as name, count(*) as occurrences, max(p_partkey) as latest, case when max(p_partkey) % 3 = 0 then 'rejected' else 'proposed' end as status
 from part where p_partkey % 2 = 0 group by p_brand),
new as (select case when p_partkey % 50 = 1 then p_brand || ' ' || p_size else p_brand end as name, count(*) as occurrences, max(p_partkey) as latest from part where p_partkey % 2 = 1 group by 1)
select coalesce(old.name, new.name) as name, case when old.name is null then new.occurrences when new.name is null or status = 'rejected' then old.occurrences else old.occurrences + new.occurrences end as occurrences,
 case when old.name is null then new.latest when new.name is null or status = 'rejected' then old.latest else greatest(old.latest, new.latest) end as latest, coalesce(status, 'proposed') as status
from old full join new on old.name = new.name"""
)
def upsert_conditional(spark: SparkSession, d: str) -> DataFrame:
    """Counters of proposals: a second batch adds to those that were not rejected; only touched buckets are written again."""
    store = Store(spark, f"{shared_dir(spark)}/tarn/store-{uuid.uuid4().hex}")
    held = store.buckets("proposals", "name string, occurrences long, latest long, status string", ["name"], 16)
    name = F.when(F.col("p_partkey") % 50 == 1, F.concat_ws(" ", "p_brand", "p_size")).otherwise(F.col("p_brand"))
    batches = table(spark, d, "part").withColumn("name", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(name))
    for odd in (0, 1):
        counts = batches.filter(F.col("p_partkey") % 2 == odd).groupBy("name").agg(F.count("*").alias("occurrences"), F.max("p_partkey").alias("latest"))
        status = F.when((F.col("latest") % 3 == 0) & F.lit(not odd), "rejected").otherwise("proposed")
        more = {"occurrences": F.col("old.occurrences") + F.col("new.occurrences"), "latest": F.greatest("old.latest", "new.latest")}
        held.upsert(counts.withColumn("status", status), ["name"], more, F.col("old.status") != "rejected")
    return store.read("proposals")
