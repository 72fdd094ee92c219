"""Queries on runs over the whole store, with scripted providers in place of models."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.checkpoints import shared_dir
from tarn.operators import embedding as E
from tarn.operators import index_pass as I
from tarn.operators import recheck as H
from tarn.operators import runs as O
from tarn.operators import vocabulary as U
from tarn.plans import fixtures as X
from tarn.plans import recall_queries
from tarn.plans.fixtures import SIM, sql
from tarn.plans.listing_queries import CHUNK, chunks, decisions, now
from tarn.plans.registry import Registry
from tarn.plans.store_queries import DUP, LEAK, STALE
from tarn.sources.ledger import Ledger
from tarn.sources.store import Store
from tarn.tables import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

CHECKED_AT = "case doc_id % 5 when 0 then null when 1 then timestamp '2024-05-20 00:00:00' else timestamp '2024-01-01 00:00:00' end"
MADE_UP = "words that stand in neither of the two"


def _ledger(spark: SparkSession, name: str, schema: str) -> Ledger:
    return Ledger(spark, f"{shared_dir(spark)}/tarn/{name}-{uuid.uuid4().hex}", schema)


def judged(q: dict) -> dict:
    """Fails for every 13th length; claims a contradiction for two of three candidates, for one of them with a quote of its own making."""
    if len(q["content"]) % 13 == 0:
        return {"error": "no answer"}
    said = [
        {"candidate": k, "relation": "Contradictory" if len(c) % 3 < 2 else "complementary", "reason": f"length {len(c)}", "new_quote": q["content"][:60], "old_quote": c[:60] if len(c) % 3 == 0 else MADE_UP}
        for k, c in enumerate(q["candidates"], 1)
    ]
    return {"reply": said, "input_tokens": len(q["content"]), "output_tokens": 63 * len(said), "usd": 0.001}


RECHECK = f""", due as (select m.* from act m join documents on doc_id = id where coalesce({CHECKED_AT}, timestamp '2000-01-01') < timestamp '2024-06-01' - interval 30 day),
near as (select b.id, b.text as new, a.id as candidate, a.text as old, {SIM} as similarity from due b join act a
  on a.content_hash <> b.content_hash and a.root_id <> b.root_id and a.id <> b.id and abs(a.id - b.id) not in (1, 2, 5)),
pair as (select *, {{canon}}(new) as cn, {{canon}}(old) as co from (select *, row_number() over (partition by id order by similarity desc, candidate) as rank from near where similarity >= 0.5) where rank <= 20),
asked as (select *, length(old) % 3 < 2 as claim from pair where length(new) % 13 <> 0),
found as (select id, candidate, 'length ' || length(old) as reason, similarity from asked where length(old) % 3 = 0
  and length({{canon}}(substr(new, 1, 60))) >= 15 and length({{canon}}(substr(old, 1, 60))) >= 15 and contains(cn, {{canon}}(substr(new, 1, 60))) and contains(co, {{canon}}(substr(old, 1, 60))))
"""


def _with_canon(body: str) -> str:
    """``{canon}(x)`` is white space as one space and lower case."""
    out = body
    while "{canon}(" in out:
        at = out.rindex("{canon}(")
        depth, end = 1, at + len("{canon}(")
        while depth:
            depth += {"(": 1, ")": -1}.get(out[end], 0)
            end += 1
        out = f"{out[:at]}lower(trim(regexp_replace({out[at + 8 : end - 1]}, '\\s+', ' ', 'g'))){out[end:]}"
    return out


RECHECK = _with_canon(RECHECK)


def _recheck(spark: SparkSession, d: str) -> tuple[DataFrame, Ledger]:
    """All that is due as one page."""
    beliefs = X.mem(spark, d).withColumnRenamed("text", "content").withColumn("last_rechecked_at", F.expr(CHECKED_AT.replace("doc_id", "id")))
    answered = beliefs.select(F.col("id").alias("a"), (F.col("id") + 5).alias("b"))
    ledger = _ledger(spark, "recheck", H.OUTCOMES)
    return H.recheck_run("r", beliefs, answered, decisions(spark, d), H.scripted(judged), ledger, now(), window=1 << 40, texts=X.plain_mem(spark, d).filter("status = 'active'").select("id", "content")), ledger


@query(sql("mem act", RECHECK + "select id, candidate, reason, round(similarity, 6) as similarity from found"))
def recheck_findings(spark: SparkSession, d: str) -> DataFrame:
    _, ledger = _recheck(spark, d)
    return H.possible(ledger, "r").select("id", "candidate", "reason", F.round("similarity", 6).alias("similarity"))


@query(
    sql(
        "mem act",
        RECHECK
        + """, n as (select id, any_value(length(new)) as chars, count(*) as candidates, count_if(claim) as claimed from asked group by id)
select (select count(*) from due) as "window", count(*) as calls, coalesce(sum(claimed), 0)::bigint as claimed, (select count(*) from found) as possible,
 coalesce(sum(chars), 0)::bigint as input_tokens, coalesce(sum(63 * candidates), 0)::bigint as output_tokens, round(count(*) * 0.001, 6)::double as usd,
 (select count(distinct id) from pair where length(new) % 13 = 0) as remaining, case when (select count(*) from pair where length(new) % 13 = 0) > 0 then 'cap' end as stopped_by from n""",
    )
)
def recheck_totals(spark: SparkSession, d: str) -> DataFrame:
    row, _ = _recheck(spark, d)
    return row.drop("run").withColumn("usd", F.round("usd", 6))


def extracted(item: dict) -> dict:
    """Up to two words with a capital, and that the one is near the other."""
    names = re.findall("[A-Z][a-z]{3,}", item["text"])[:2]
    links = [{"subject": names[0], "predicate": "near", "confidence": 0.9, "object": names[1]}] if len(set(names)) == 2 else []
    return {"entities": [{"name": n, "type": "term"} for n in names], "links": links}


def flaky(batch: list[dict]) -> list[dict]:
    """Some items fail each on its own, and a run of beliefs one after the other."""
    down = lambda i: i["id"] % 41 == 5 or (i["kind"] == "memory" and 100 <= i["id"] % 800 < 112)
    return [{"error": f"no answer for {i['id']}"} if down(i) else extracted(i) for i in batch]


def _index(spark: SparkSession, d: str) -> Ledger:
    """A run with a provider that fails, then one with a provider that doesn't."""
    beliefs = X.plain_mem(spark, d).withColumnRenamed("asserted_at", "created_at")
    parts = chunks(spark, d).selectExpr(
        "id", "content", "'talk ' || document as title", "cast(null as string) as heading", "place as chunk_index", "session_id as session", "timestamp '2024-01-01' as created_at"
    )
    ledger = _ledger(spark, "index", I.OUTCOMES)
    for run, extract in (("a", flaky), ("b", lambda batch: [extracted(i) for i in batch])):
        I.index_pass(run, beliefs, parts, extract, ledger, wave=WAVE, lane=LANE, batch=BATCH)
    return ledger


WAVE, LANE, BATCH = 512, 64, 8
DENSE = """length(regexp_replace(content, '[^0-9=+\\-*/^√∫∑∈≤≥→±²³()<>|\\\\]', '', 'g'))::double / greatest(1, length(regexp_replace(content, '[^0-9=+\\-*/^√∫∑∈≤≥→±²³()<>|\\\\]', '', 'g')) + length(regexp_replace(content, '[^\\p{L}]', '', 'g'))) >= 0.25
 and length(regexp_replace(content, '\\s+', '', 'g')) >= 40"""
INDEX = f""", {CHUNK},
it as (select false as later, 'memory' as kind, id, text as content, false as skip, asserted_at as created_at, 0 as chunk_index, text as name from act
 union all select true, 'chunk', id, content, coalesce({DENSE}, false), timestamp '2024-01-01', place, 'talk ' || document || ' › #' || (place + 1) from chunk where session_id is null),
one as (select *, row_number() over (order by later, created_at, chunk_index, id) - 1 as place, not skip and (id % 41 = 5 or (kind = 'memory' and id % 800 between 100 and 111)) as down from it),
isl as (select *, place // {LANE} as lane, place // {BATCH} as bat, sum((not down)::int) over (partition by place // {LANE} order by place) as island from one),
cnt as (select *, sum(down::int) over (partition by lane, island order by place) as streak from isl),
trip as (select lane, min(bat) as bat, min(place) as place from cnt where streak >= {I.BREAKER} group by lane),
first as (select c.*, c.place = trip.place as tripped from cnt c left join trip using (lane)
 where c.bat <= coalesce(trip.bat, c.bat) and c.place // {WAVE} <= coalesce((select min(place) from trip) // {WAVE}, c.place // {WAVE})),
both_runs as (select 'a' as run, place, kind, id, content, skip, down, name, later from first
 union all select 'b', row_number() over (order by later, created_at, chunk_index, id) - 1, kind, id, content, skip, false, name, later from it
  where not exists (select 1 from first f where f.kind = it.kind and f.id = it.id and not f.down)),
ents as (select *, regexp_extract_all(content, '[A-Z][a-z]{{3,}}')[1:2] as names, case when later then place - min(case when later then place end) over (partition by run) else place end + 1 as nth from both_runs)
"""


@query(
    sql(
        "mem act",
        INDEX
        + """select run, place, case when down then 'error' when not skip and len(names) > 0 then 'success' else 'info' end as level, kind, id,
 '[' || nth || '] ' || kind || ' ' || case when length(name) > 64 then substr(name, 1, 61) || '...' else name end || ' → ' || case when down then 'failed: no answer for ' || id when skip then 'skipped (math-dense)'
  when len(names) = 0 then 'no entities' else array_to_string(names, ', ') || case when len(list_distinct(names)) = 2 then ' (+1 relationship)' else '' end end as message from ents
union all select 'a', min(place), 'error', null, null, 'stopped after 5 consecutive failures' from first where tripped having count(*) > 0""",
    )
)
def index_events(spark: SparkSession, d: str) -> DataFrame:
    ledger = _index(spark, d)
    return I.events(ledger, "a").withColumn("run", F.lit("a")).unionByName(I.events(ledger, "b").withColumn("run", F.lit("b")))


@query(
    sql(
        "mem act",
        INDEX
        + """, nm as (select distinct run, kind, id, unnest(names) as name from ents where not skip and not down),
ok as (select *, lower(name) as key from nm where length(name) <= 40),
 edg as (select id as from_id, key as to_name, 'mention' as relation from ok union select null, lower(names[1]) || '>' || lower(names[2]), 'near' from ents
  where not skip and not down and len(list_distinct(names)) = 2 and lower(names[1]) <> lower(names[2]) and length(names[1]) <= 40 and length(names[2]) <= 40)
select relation, count(*) as edges, count(distinct to_name) as ends from edg group by relation""",
    )
)
def index_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges that both runs wrote, by relation, and how many entities or pairs of entities they lead to."""
    ledger = _index(spark, d)
    none = spark.createDataFrame([], "id long, name string, canonical_id long, from_id long, to_id long, relation string, active boolean")
    types, predicates = spark.createDataFrame([("term",)], "type string"), spark.createDataFrame([("near",)], "predicate string")
    _, edges = I.graph(ledger, "", none.select("id", "name"), none.select("canonical_id", "name"), none, types, predicates)
    ends = F.when(F.col("relation") == "mention", F.array("to_id")).otherwise(F.array("from_id", "to_id"))
    return edges.groupBy("relation").agg(F.count("*").alias("edges"), F.countDistinct(ends).alias("ends"))


OP = """case o_orderkey % 29 when 3 then 'add' when 5 then 'approve' when 7 then 'dismiss' when 11 then 'status' when 13 then 'delete' when 17 then 'seed' when 19 then 'status' when 23 then 'approve' else 'propose' end"""
VALUE = "case o_orderkey % 29 when 3 then 'said by ' || o_orderkey when 11 then 'disabled' when 19 then case when o_orderkey % 2 = 0 then 'disabled' else 'active' end end"
EVENTS = f"""ev as (select o_orderkey as seq, case when o_custkey % 2 = 0 then 'entity_type' else 'predicate' end as kind, 'name ' || (o_custkey % 150) as name, {OP} as op, {VALUE} as value,
 case when o_custkey % 2 = 0 and o_custkey % 5 > 0 then p.p_name end as entity, case when o_custkey % 2 = 1 then p.p_name end as from_name, case when o_custkey % 2 = 1 then r.p_name end as to_name, o_custkey as source
 from orders join part p on p.p_partkey = 1 + o_orderkey % 40 join part r on r.p_partkey = 1 + o_orderkey % 37)"""
FOLD = f"""with recursive {EVENTS},
e as (select *, row_number() over (partition by kind, name order by seq) as n from ev),
fold as (select kind, name, 0::bigint as n, null::varchar as tier, null::varchar as status, null::varchar as description, 0::bigint as occurrences, 0::bigint as seq, null::varchar as op, null::varchar as why, 0 as life
  from (select distinct kind, name from e)
 union all select f.kind, f.name, e.n,
  case when e.op = 'seed' and tier is null then 'system' when e.op = 'propose' and tier is null then 'proposed' when e.op = 'add' then 'user' when e.op = 'approve' and tier = 'proposed' then 'user'
   when e.op = 'delete' and tier = 'user' and status = 'disabled' then null else tier end,
  case when e.op = 'seed' and tier is null or e.op = 'propose' and tier is null or e.op = 'add' or e.op = 'approve' and tier = 'proposed' then 'active' when e.op = 'dismiss' and tier = 'proposed' then 'dismissed'
   when e.op = 'status' and tier in ('system', 'user') then e.value when e.op = 'delete' and tier = 'user' and status = 'disabled' then null else status end,
  case when e.op = 'add' then e.value when e.op = 'delete' and tier = 'user' and status = 'disabled' then null else description end,
  case when e.op = 'delete' and tier = 'user' and status = 'disabled' then 0 when e.op = 'propose' and tier is null then 1 when e.op = 'propose' and tier = 'proposed' and status = 'active' then occurrences + 1 else occurrences end,
  e.seq, e.op, case when e.op in ('approve', 'dismiss') and coalesce(tier, '') <> 'proposed' then 'no pending proposal' when e.op in ('status', 'delete') and tier is null or e.op = 'status' and tier = 'proposed' then 'no such entry'
   when e.op = 'delete' and tier = 'system' then 'system entries can only be disabled' when e.op = 'delete' and tier = 'proposed' then 'proposals are approved or dismissed'
   when e.op = 'delete' and status <> 'disabled' then 'only disabled entries can be deleted' end,
  case when e.op = 'propose' and tier is null then life + 1 else life end
 from fold f join e on e.kind = f.kind and e.name = f.name and e.n = f.n + 1)
"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    # no other part has a key that a remainder by 40 or 37 leads to (down to -38 for keys below 0), so these are few whatever the table's size
    part = F.broadcast(table(spark, d, "part").select("p_partkey", "p_name").filter(F.col("p_partkey").between(-38, 40)))
    rows = table(spark, d, "orders").selectExpr("*", "1 + o_orderkey % 40 as p", "1 + o_orderkey % 37 as r")
    rows = rows.join(part.select(F.col("p_partkey").alias("p"), F.col("p_name").alias("one")), "p").join(part.select(F.col("p_partkey").alias("r"), F.col("p_name").alias("two")), "r")
    return rows.selectExpr(
        "o_orderkey as seq", "case when o_custkey % 2 = 0 then 'entity_type' else 'predicate' end as kind", "'name ' || (o_custkey % 150) as name", f"{OP} as op", f"{VALUE} as value",
        "case when o_custkey % 2 = 0 and o_custkey % 5 > 0 then one end as entity", "case when o_custkey % 2 = 1 then one end as from_name", "case when o_custkey % 2 = 1 then two end as to_name",
        "o_custkey as source", "0.9D as confidence",
    )


@query(FOLD + "select kind, name, tier, status, description, occurrences from (select *, max(n) over (partition by kind, name) as last from fold) where n = last and tier is not null")
def schema_registry(spark: SparkSession, d: str) -> DataFrame:
    return U.registry(U.folded(_events(spark, d)))


@query(FOLD + "select kind, name, seq, op, why from fold where why is not null")
def schema_refusals(spark: SparkSession, d: str) -> DataFrame:
    return U.refusals(U.folded(_events(spark, d)))


APPROVED = r""", app as (select kind, name, n, seq as approved, life from fold where op = 'approve' and why is null),
st as (select f.*, lag(tier) over (partition by kind, name order by n) as was, lag(status) over (partition by kind, name order by n) as had from fold f),
ex as (select app.kind, app.name, approved, e.seq, entity, from_name, to_name, source, coalesce(regexp_replace(lower(trim(entity)), '\s+', ' ', 'g'), lower(from_name) || '|' || lower(to_name)) as which
 from app join st on st.kind = app.kind and st.name = app.name and st.life = app.life and st.n < app.n and st.op = 'propose' and (st.was is null or st.was = 'proposed' and st.had = 'active')
 join e on e.kind = st.kind and e.name = st.name and e.n = st.n where entity is not null or from_name is not null),
one as (select * from ex qualify row_number() over (partition by kind, name, approved, which order by seq) = 1),
kept as (select * from one qualify row_number() over (partition by kind, name, approved order by seq) <= 20)"""


@query(FOLD + APPROVED + "select kind, name, approved, seq, entity, from_name, to_name, source from kept")
def approved_examples(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d)
    return U.approved_examples(U.folded(events), events).drop("confidence")


@query(
    FOLD
    + APPROVED
    + """, live as (select c_custkey as id from customer where c_custkey % 4 <> 0),
own as (select distinct lower(p_name) as k from part where p_partkey % 2 = 0),
fresh as (select distinct which as k from kept join live on id = source where kind = 'entity_type'),
men as (select kind, name, approved, count(*) as entities from kept join live on id = source where kind = 'entity_type' group by all),
lnk as (select kind, name, approved, count(*) as edges from kept where kind = 'predicate' and lower(from_name) in (from own union from fresh) and lower(to_name) in (from own union from fresh) group by all)
select coalesce(men.kind, lnk.kind) as kind, coalesce(men.name, lnk.name) as name, coalesce(men.approved, lnk.approved) as approved, coalesce(entities, 0) as entities, coalesce(edges, 0) as edges
from men full join lnk on false"""
)
def approved_links(spark: SparkSession, d: str) -> DataFrame:
    """How many mentions and links each approval brought; half of the parts are known entities, three of four sources still stand."""
    events = _events(spark, d)
    entities = table(spark, d, "part").filter("p_partkey % 2 = 0").selectExpr("p_partkey as id", "p_name as name")
    none = spark.createDataFrame([], "canonical_id long, name string, from_id long, to_id long, relation string, active boolean")
    alive = table(spark, d, "customer").filter("c_custkey % 4 <> 0").selectExpr("c_custkey as id")
    return U.materialised(U.approved_examples(U.folded(events), events), entities, none, none, alive)[2]


RUNS = f""", {DUP}, {LEAK}, {STALE},
des as (select doc_id as incoming, doc_id + 1 as candidate, case when doc_id % 80 = 7 then doc_id - doc_id % 3 end as root, doc_id % 3 = 0 as open from documents where doc_id % 40 = 7),
blocked as (select incoming as id from des where open union select candidate from des where open),
ret as (select id, min(pass) as pass from (select id, 1 as pass from leak union all select id, 2 from dup) where id not in (from blocked) group by id),
heads as (select root_id, count(*) as heads, list(id order by version desc, asserted_at desc, id desc) as ids from act group by root_id having count(*) > 1 and root_id not in (select root from des where root is not null)),
acts as (select 'retire' as kind, case pass when 1 then 'replaces_leak' else 'duplicate_content' end as class, id as subject, row_number() over (partition by pass = 1 order by pass, id) <= case pass when 1 then 10 else 5 end as surfaced, true as can from ret
 union all select 'question', 'stale_without_edge', id, row_number() over (order by id) <= 10, false from orphan
 union all select 'conflict', 'multi_head', ids[1], true, true from (select ids, row_number() over (order by heads desc, root_id) as place from heads) where place <= least(2, 20 - (select count(*) from des where open)))
"""


def _reconciled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, Ledger]:
    decided = table(spark, d, "documents").filter("doc_id % 40 = 7").selectExpr(
        "doc_id as incoming", "array(doc_id + 1) as candidates", "case when doc_id % 80 = 7 then 'reconcile:lineage:' || (doc_id - doc_id % 3) end as key",
        "case when doc_id % 3 <> 0 then timestamp '2024-05-01' end as resolved_at",
    )
    past = spark.createDataFrame([(2, False), (1, True)], "started_at int, acted boolean")
    ledger = _ledger(spark, "reconcile", O.ACTIONS)
    rows = _ledger(spark, "reconcile-runs", O.RUN)
    return (*O.reconcile("r", X.plain_mem(spark, d), X.rep(spark, d), decided, past, ledger, rows, now(), 0.0, apply=True), ledger)


@query(sql("mem act rep", RUNS + "select kind, class, subject::varchar as subject, surfaced, surfaced and can as applied from acts"))
def reconcile_actions(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d)[3].read().select("kind", "class", "subject", "surfaced", "applied")


@query(
    sql(
        "mem act rep",
        RUNS
        + """select (select count(*) from act) as scanned, count_if(kind = 'retire' and surfaced)::bigint as retired, count_if(kind = 'question')::bigint as questions, count_if(kind = 'conflict')::bigint as conflicts,
 count_if(kind = 'retire' and not surfaced)::bigint as held_retire, count_if(kind = 'question' and not surfaced)::bigint as held_question, ((select count(*) from heads) - count_if(kind = 'conflict'))::bigint as held_conflict,
 (select count(*) from act where id not in (select subject from acts where kind = 'retire' and surfaced)) as active_after from acts""",
    )
)
def reconcile_run(spark: SparkSession, d: str) -> DataFrame:
    row, after, _, _ = _reconciled(spark, d)
    left = after.filter("status = 'active'").agg(F.count("*").alias("active_after"))
    return row.drop("run", "mode", "status").withColumn("one", F.lit(1)).join(left.withColumn("one", F.lit(1)), "one").drop("one")


POSSIBLE = f""", fnd as (select l_orderkey * 10 + l_linenumber as found, l_orderkey as id, l_partkey as candidate, l_shipdate as found_at from lineitem where l_linenumber <= 2 and l_orderkey <> l_partkey),
ans as (select found, min(seq) as seq, min_by(decision, seq) as decision from (select found, found % 7 as seq, case when found % 2 = 0 then 'approved' else 'rejected' end as decision from fnd where id % 3 = 0
 union all select found, found % 5, 'rejected' from fnd where id % 9 = 0 and found % 7 <> found % 5) group by found)"""


def _possible(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found = table(spark, d, "lineitem").filter("l_linenumber <= 2 and l_orderkey <> l_partkey").selectExpr(
        "l_orderkey * 10 + l_linenumber as found", "l_orderkey as id", "l_partkey as candidate", "l_shipdate as found_at", "'r' as reason"
    )
    answers = found.filter("id % 3 = 0").selectExpr("found", "found % 7 as seq", "case when found % 2 = 0 then 'approved' else 'rejected' end as decision")
    return found, answers.unionByName(found.filter("id % 9 = 0 and found % 7 <> found % 5").selectExpr("found", "found % 5 as seq", "'rejected' as decision"))


@query(
    sql(
        "mem act",
        POSSIBLE
        + f"""select * from (select f.found, f.id, f.candidate, round({SIM}, 6) as similarity, row_number() over (order by found_at desc, f.found)::integer as place
 from fnd f join act a on a.id = f.id join act b on b.id = f.candidate where f.found not in (select found from ans)) where place <= 50""",
    )
)
def possible_contradictions(spark: SparkSession, d: str) -> DataFrame:
    found, answers = _possible(spark, d)
    rows = O.possible_contradictions(found, answers, X.mem(spark, d).withColumnRenamed("text", "content"))
    return rows.select("found", "id", "candidate", F.round("similarity", 6).alias("similarity"), "place")


@query(
    sql(
        "mem",
        POSSIBLE
        + """select id as a, candidate as b, decision, decision = 'approved' as raised from ans join fnd using (found)""",
    )
)
def possible_answers(spark: SparkSession, d: str) -> DataFrame:
    conflicts, pairs, _ = O.answered(*_possible(spark, d))
    raised = conflicts.select(F.col("incoming").alias("a"), F.explode("candidates").alias("b"), F.lit(True).alias("raised")).distinct()
    return pairs.join(raised, ["a", "b"], "left").withColumn("raised", F.coalesce("raised", F.lit(False)) & (F.col("decision") == "approved"))


@query(recall_queries.ORACLES["hash_embed"].replace("h % 64", "h % 32"))
def reembedded(spark: SparkSession, d: str) -> DataFrame:
    """A store of one provider's vectors after the change to another."""
    store = Store(spark, f"{shared_dir(spark)}/tarn/store-{uuid.uuid4().hex}")
    docs = table(spark, d, "documents").selectExpr("doc_id as id", "text", "cast(null as array<double>) as embedding")
    store.write("documents", docs)
    E.guard(store, E.Provider(32, "before", lambda texts: [[0.0] * 32] * len(texts)))
    E.reembed(store, {"documents": "text"}, E.offline(32), pages=4)
    E.guard(store, E.offline(32))
    made = store.read("documents").select(F.col("id").alias("doc_id"), F.posexplode("embedding").alias("idx", "value")).filter("value <> 0")
    return made.select("doc_id", F.col("idx").cast("long").alias("idx"), F.round("value", 6).alias("value"))
