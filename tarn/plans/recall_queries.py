"""Retrieval queries: arms, fusion, candidates, evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.checkpoints import persisted
from tarn.functions import vectors as V
from tarn.operators import retrieval as R
from tarn.plans import fixtures as X
from tarn.plans.fixtures import SIM, sql
from tarn.plans.registry import Registry
from tarn.tables import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

VEC_ARM = f"""vsim as (select b.qid, a.src, a.id, {SIM} as similarity from act a, q b),
vec as (select * from (select *, row_number() over (partition by qid order by similarity desc, src, id) as rank from vsim) where rank <= 50)"""
KW_ARM = """qu as (select qid, unnest(units) as unit, generate_subscripts(units, 1) as pos from (select qid, regexp_extract_all(lower(text), '-?"[^"]*"|[^\\s"]+') as units from q)),
qc as (select qid, unit, sum(case when unit = 'or' then 1 else 0 end) over (partition by qid order by pos) as clause from qu),
qn as (select distinct qid, clause, unit like '-%' as negated, regexp_extract_all(unit, '[\\p{L}\\p{M}\\p{N}]+') as needed from qc where unit <> 'or'),
flat as (select src, id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+'), ' ') || ' ' as flat from act),
qt as (select distinct qid, unnest(needed) as term from qn where not negated),
ok as (select distinct qn.qid, src, id from qn, flat where len(needed) > 0 group by qn.qid, clause, src, id
 having bool_and(contains(flat, ' ' || array_to_string(needed, ' ') || ' ') <> negated) and bool_or(not negated)),
kwhit as (select ok.qid, ok.src, ok.id, count(*) as score from ok join toks t on t.src = ok.src and t.id = ok.id join qt on qt.qid = ok.qid and qt.term = t.term group by 1, 2, 3),
kw as (select * from (select qid, src, id, score, row_number() over (partition by qid order by score desc, src, id) as rank from kwhit) where rank <= 50)"""
ENT_ARM = f"""anc as (select * from (select qid, canonical, distance, row_number() over (partition by qid order by distance, canonical) as rank from
    (select b.qid, a.id as canonical, round(1 - {SIM}, 9) as distance from ent a, q b where {SIM} >= 0.6)) where rank <= 10),
enthit as (select qid, 'memory' as src, from_id as id, count(distinct canonical) as score from anc join edge on to_id = canonical and active and relation = 'mention'
    join act m on m.id = from_id group by 1, 2, 3),
enta as (select * from (select *, row_number() over (partition by qid order by score desc, src, id) as rank from enthit) where rank <= 50)"""
FUSE = """fused as (select qid, src, id, round(sum(w), 9) as rrf_score from (
    select qid, src, id, 1.0::double / (60 + rank) as w from vec union all select qid, src, id, 2.0::double / (60 + rank) from kw {ent}) group by 1, 2, 3)
select qid, src, id, rrf_score, cast(rank as integer) as rank from (select *, row_number() over (partition by qid order by rrf_score desc, src, id) as rank from fused)
where rank <= 10"""


def _arms(*parts: str) -> str:
    return ", " + ", ".join(parts)


@query(sql("mem act q", _arms(VEC_ARM) + "select qid, id, round(similarity, 6) as similarity, cast(rank as integer) as rank from vec"))
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.vector_arm(X.active(spark, d), X.q(spark, d)).select("qid", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(sql("mem act toks q", _arms(KW_ARM) + "select qid, id, score, cast(rank as integer) as rank from kw"))
def keyword_match(spark: SparkSession, d: str) -> DataFrame:
    return R.keyword_arm(X.active(spark, d).drop("vec"), X.q(spark, d)).select("qid", "id", "score", "rank")


@query(sql("mem act q ent edge", _arms(ENT_ARM) + "select qid, canonical, round(distance, 6) as distance from anc"))
def entity_anchor(spark: SparkSession, d: str) -> DataFrame:
    entities = X.ent(spark, d).select("id", F.col("id").alias("canonical"), "vec")
    return R.entity_anchors(entities, X.q(spark, d)).withColumn("distance", F.round("distance", 6))


@query(sql("mem act q ent edge", _arms(ENT_ARM) + "select qid, src, id, score, cast(rank as integer) as rank from enta"))
def entity_ranking(spark: SparkSession, d: str) -> DataFrame:
    entities = X.ent(spark, d).select("id", F.col("id").alias("canonical"), "vec")
    return R.entity_arm(R.entity_anchors(entities, X.q(spark, d)), X.edge(spark, d), X.active(spark, d).select("src", "id"))


@query(sql("mem act toks q", _arms(VEC_ARM, KW_ARM, FUSE.format(ent=""))))
def recall_two_arm(spark: SparkSession, d: str) -> DataFrame:
    rows = X.active(spark, d)
    return R.recall(rows.select("src", "id", "text"), rows, X.q(spark, d), use=("vector", "keyword"))


@query(
    sql(
        "mem act toks q ent edge",
        _arms(VEC_ARM, KW_ARM, ENT_ARM, FUSE.format(ent="union all select qid, src, id, 0.5::double / (60 + rank) from enta")),
    )
)
def recall_hybrid(spark: SparkSession, d: str) -> DataFrame:
    rows = X.active(spark, d)
    entities = X.ent(spark, d).select("id", F.col("id").alias("canonical"), "vec")
    return R.recall(rows.select("src", "id", "text"), rows, X.q(spark, d), entities, X.edge(spark, d))


#: Beliefs and the turns of conversations in one ranking; of turns that belong to a session, those of session 3.
SOURCES = f"""with recursive {X.CTE["mem"]},
act as (select src, id, text, vec from mem where status = 'active' union all select 'chunk', 10000000 + conv_id * 1000 + turn, text, e.embedding
 from conversations join embeddings e on e.vec_id = (conv_id * 1000 + turn) % (select count(*) from embeddings) where conv_id % 3 <> 0 or conv_id = 3),
{X.CTE["toks"]}, {X.CTE["q"]}"""


@query(SOURCES + _arms(VEC_ARM, KW_ARM, FUSE.format(ent="")))
def recall_sources(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").selectExpr("conv_id * 1000 + turn as id", "'chunk' as src", "text", "case when conv_id % 3 = 0 then conv_id end as session")
    turns = R.in_session(X.with_vectors(turns, spark, d, "id"), F.lit(3)).withColumn("id", F.col("id") + 10_000_000)
    rows = X.active(spark, d).select("src", "id", "text", "vec").unionByName(turns.select("src", "id", "text", "vec"))
    return R.recall(rows.drop("vec"), rows.drop("text"), X.q(spark, d), use=("vector", "keyword"))


def single(spark: SparkSession, d: str) -> Callable[[SparkSession, str], DataFrame]:
    """recall_hybrid for one query, over a store whose beliefs and keyword index are written once, here."""
    rows = persisted(X.active(spark, d), "beliefs")
    entities = persisted(X.ent(spark, d).select("id", F.col("id").alias("canonical"), "vec"), "entities")
    index = R.keyword_index(rows)
    query_ = persisted(X.q(spark, d).orderBy("qid").limit(1), "query")
    return lambda s, d: R.recall(rows.select("src", "id", "text"), rows, query_, entities, X.edge(s, d), index=index)


@query(
    sql(
        "mem q",
        f""", day as (select b.qid, a.src, a.id, {SIM} as similarity from mem a, q b where a.status = 'active' and cast(a.asserted_at + interval 1 hour as date) = date '2024-01-01')
select qid, id, round(similarity, 6) as similarity, cast(rank as integer) as rank from (select *, row_number() over (partition by qid order by similarity desc, src, id) as rank from day) where rank <= 10""",
    )
)
def recall_on_day(spark: SparkSession, d: str) -> DataFrame:
    hits = R.recall_on_day(X.active(spark, d), X.q(spark, d), "2024-01-01", "Europe/Berlin")
    return hits.select("qid", "id", F.round("similarity", 6).alias("similarity"), "rank")


DEDUP = f""", near as (select b.id as qid, a.id, {SIM} as similarity from act a, mem b where b.id % 10 = 3 and b.id % 7 <> 3 and a.content_hash <> b.content_hash),
top as (select *, row_number() over (partition by qid order by similarity desc, id) as rank from near)
select qid, id, round(similarity, 6) as similarity, cast(rank as integer) as rank from top where rank <= 5 and similarity >= 0.5"""


@query(
    sql(
        "mem act q",
        f""", near as (select b.qid, a.id, {SIM} as similarity from act a, q b where a.content_hash <> sha256(b.text)),
top as (select *, row_number() over (partition by qid order by similarity desc, id) as rank from near)
select qid, id, round(similarity, 6) as similarity, cast(rank as integer) as rank from top where rank <= 5 and similarity >= 0.5""",
    )
)
def dedup_candidates(spark: SparkSession, d: str) -> DataFrame:
    incoming = X.q(spark, d).select("qid", "vec", F.sha2("text", 256).alias("content_hash"))
    return R.dedup_candidates(X.active(spark, d), incoming).withColumn("similarity", F.round("similarity", 6))


@query(
    sql(
        "mem act",
        f""", near as (select b.id as qid, a.id, {SIM} as similarity from act a join act b on a.content_hash <> b.content_hash and a.root_id <> b.root_id and a.id <> b.id),
kept as (select * from near where similarity >= 0.5 and abs(qid - id) <> 5),
top as (select *, row_number() over (partition by qid order by similarity desc, id) as rank from kept)
select qid, id, round(similarity, 6) as similarity, cast(rank as integer) as rank from top where rank <= 20""",
    )
)
def recheck_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = X.active(spark, d)
    due = rows.select(F.col("id").alias("qid"), "vec", "content_hash", "root_id")
    answered = rows.select(F.col("id").alias("a"), (F.col("id") + 5).alias("b"))
    found = R.recheck_pairs(rows, due, answered)
    return found.select("qid", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    sql(
        "mem act toks q",
        _arms(VEC_ARM, KW_ARM, FUSE.format(ent="").replace("select qid, src, id, rrf_score", ", hits as (select qid, src, id, rrf_score", 1))
        + """), rel as (select distinct q.qid, a.id from q join act a on contains(lower(trim(regexp_replace(a.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(q.text, '\\s+', ' ', 'g'))))),
truth as (select qid, count(*) as total from rel group by qid),
got as (select h.qid, min(rank) as first, sum(case when rank <= 1 then 1 else 0 end) as a1, sum(case when rank <= 5 then 1 else 0 end) as a5, sum(case when rank <= 10 then 1 else 0 end) as a10
  from hits h join rel r on r.qid = h.qid and r.id = h.id group by h.qid)
select count(*) as queries, round(avg(coalesce(1.0::double / first, 0)), 6) as mrr, round(avg(coalesce(a1, 0)::double / total), 6) as recall_at_1,
 round(avg(coalesce(a5, 0)::double / total), 6) as recall_at_5, round(avg(coalesce(a10, 0)::double / total), 6) as recall_at_10 from truth left join got on got.qid = truth.qid""",
    )
)
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows, queries = X.active(spark, d), X.q(spark, d)
    hits = R.recall(rows.select("src", "id", "text"), rows, queries, use=("vector", "keyword"))
    relevant = R.quotes_in(rows.select("id", "text"), queries.select("qid", F.col("text").alias("quote")), least=1)
    return R.evaluate(hits, relevant)


@query(
    """with recursive t as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as toks, regexp_extract_all(lower(text), '[a-z0-9]+') as all_toks from documents),
w as (select distinct unnest(toks) as tok from t),
f(tok, i, h) as (select tok, 1, 2166136261::bigint from w union all
  select tok, i + 1, (xor(h, ascii(substr(tok, i, 1))::bigint) * 16777619) % 4294967296 from f where i <= length(tok)),
hh as (select tok, h from f where i = length(tok) + 1),
c as (select doc_id, h % 64 as idx, sum(case when h % 2 = 0 then 1 else -1 end) as v from (select doc_id, unnest(all_toks) as tok from t) x join hh using (tok) group by 1, 2),
n as (select doc_id, sqrt(sum(v * v)) as norm from c group by 1)
select c.doc_id, cast(idx as bigint) as idx, round(v / norm, 6) as value from c join n using (doc_id) where norm > 0 and v <> 0"""
)
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    made = V.with_embeddings(docs, "text", 64).select("doc_id", F.posexplode("embedding").alias("idx", "value"))
    return made.filter("value <> 0").select("doc_id", F.col("idx").cast("long").alias("idx"), F.round("value", 6).alias("value"))


@query(
    sql(
        "sess",
        """select session, line, 2.0::double as score, substr(text, 1, 160) as snippet from (select *, row_number() over (partition by session order by line desc) as n
from sess where contains(lower(text), 'the')) where n = 1 order by session limit 20""",
    )
)
def session_search(spark: SparkSession, d: str) -> DataFrame:
    return R.session_search(X.sess(spark, d), "the")


@query(
    sql(
        "mem act toks q",
        _arms(VEC_ARM, KW_ARM, FUSE.format(ent="").replace("select qid, src, id, rrf_score", ", hits as (select qid, src, id, rrf_score", 1))
        + """), b as (select h.qid, h.id, h.rank, sum(least(length(a.text), 300)) over (partition by h.qid order by h.rank) as used from hits h join act a on a.id = h.id)
select qid, id, rank, cast(used as bigint) as used from b where used <= 1000 or rank = 1""",
    )
)
def budget_block(spark: SparkSession, d: str) -> DataFrame:
    rows = X.active(spark, d)
    hits = R.recall(rows.select("src", "id", "text"), rows, X.q(spark, d), use=("vector", "keyword"))
    return R.budget_block(hits.join(rows.select("id", "text"), "id"), 300, 1000).select("qid", "id", "rank", F.col("used").cast("long").alias("used"))
