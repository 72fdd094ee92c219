"""Entity-graph and entity-resolution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import entities as N
from tarn.operators import graph as G
from tarn.plans import fixtures as X
from tarn.plans.fixtures import sql
from tarn.plans.registry import Registry
from tarn.tables import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query(
    sql(
        "edge doc_of",
        """, c as (select to_id, count(*) as mentions, count(distinct edge.from_id) as sources, count(distinct document) as documents from edge left join doc_of on doc_of.from_id = edge.from_id where active and relation = 'mention' group by to_id)
select p_partkey as id, coalesce(mentions, 0) as mentions, coalesce(sources, 0) as sources, coalesce(documents, 0) as documents from part left join c on to_id = p_partkey""",
    )
)
def entity_list(spark: SparkSession, d: str) -> DataFrame:
    return G.entity_list(X.plain_ent(spark, d), X.edge(spark, d), X.doc_of(spark, d)).select("id", "mentions", "sources", "documents")


@query(sql("edge", "select p_partkey as id, count(edge.id) as mentions from part left join edge on to_id = p_partkey and active and relation = 'mention' group by 1 order by mentions desc, 1 limit 75"))
def known_entities(spark: SparkSession, d: str) -> DataFrame:
    return G.known_entities(X.plain_ent(spark, d), X.edge(spark, d)).select("id", "mentions")


@query(sql("edge doc_of", "select document, to_id, count(*) as weight from edge join doc_of on doc_of.from_id = edge.from_id where active and relation = 'mention' group by 1, 2"))
def graph_rollup(spark: SparkSession, d: str) -> DataFrame:
    return G.document_rollup(X.edge(spark, d), X.doc_of(spark, d))


@query(
    sql(
        "rep typed edge doc_of",
        """select cast(from_id as varchar) as from_id, cast(to_id as varchar) as to_id, relation, cast(null as bigint) as weight from rep where active and from_id not in (select from_id from doc_of)
union all select cast(from_id as varchar), cast(to_id as varchar), relation, null from typed where active
union all select 'document:' || document, cast(to_id as varchar), 'mention', count(*) from rep join doc_of on doc_of.from_id = rep.from_id where active and relation = 'mention' group by document, to_id""",
    )
)
def graph_view(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_edges(X.rep(spark, d), X.doc_of(spark, d), X.typed(spark, d))


@query(sql("typed", "select from_id, to_id, string_agg(distinct relation, ', ') as relations, count(*) as n from typed where active group by 1, 2"))
def parallel_predicates(spark: SparkSession, d: str) -> DataFrame:
    return G.parallel_predicates(X.typed(spark, d))


RELATED = sql(
    "edge typed",
    """, m as (select distinct from_id, to_id from edge where active and relation = 'mention'),
sh as (select a.to_id as target, b.to_id as other, count(*) as shared from m a join m b on a.from_id = b.from_id and a.to_id <> b.to_id group by 1, 2),
st as (select target, other, count(*) as links, max(confidence) as confidence from (select from_id as target, to_id as other, confidence from typed where active union all select to_id, from_id, confidence from typed where active)
 where target in (select p_partkey from part) and target <> other group by 1, 2),
c as (select to_id as other, count(*) as mentions from m group by 1),
names as (select p_partkey as id, p_name as name from part),
r as (select coalesce(sh.target, st.target) as target, coalesce(sh.other, st.other) as other, coalesce(links, 0) as links, confidence, coalesce(shared, 0) as shared
 from sh full outer join st on sh.target = st.target and sh.other = st.other),
o as (select r.*, name, coalesce(mentions, 0) as mentions, count(*) over (partition by target) as total,
 row_number() over (partition by target order by (links > 0) desc, shared desc, coalesce(mentions, 0) desc, name, r.other) as place from r join names on names.id = r.other left join c on c.other = r.other)
select target, other, links, shared, mentions, total, cast(place as integer) as place from o where place <= 50""",
)


@query(RELATED)
def related_entities(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").selectExpr("p_partkey as id", "p_name as name")
    found = G.related_entities(part.select("id"), part, X.edge(spark, d), X.typed(spark, d))
    return found.select("target", "other", "links", "shared", "mentions", "total", "place")


@query(RELATED)
def related_entities_all(spark: SparkSession, d: str) -> DataFrame:
    """The name that related_entities had over every part while it took some of them."""
    return related_entities(spark, d)


@query(
    """with vocab as (select 'entity_type' as kind, lower(p_type) as name from part union select 'predicate', x from (values ('located_in'), ('part_of'), ('knows')) v(x)),
used as (select 'entity_type' as kind, lower(p_type) as name from part where p_partkey % 3 = 0 union all select 'predicate', 'located_in' from supplier union all select 'predicate', 'part_of' from nation)
select vocab.kind, vocab.name, coalesce(n, 0) as uses from vocab left join (select kind, name, count(*) as n from used group by 1, 2) u on u.kind = vocab.kind and u.name = vocab.name"""
)
def schema_usage(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.lit("entity_type").alias("kind"), F.lower("p_type").alias("name"), "p_partkey")
    own = spark.createDataFrame([("predicate", x) for x in ("located_in", "part_of", "knows")], "kind string, name string")
    typed = X.typed(spark, d).select(F.lit("predicate").alias("kind"), F.col("relation").alias("name"))
    used = part.filter("p_partkey % 3 = 0").select("kind", "name").unionByName(typed)
    return G.vocabulary_usage(part.select("kind", "name").distinct().unionByName(own), used)


@query(
    """select 'entity_type' as kind, name, count(*) as occurrences from (select regexp_replace(regexp_replace(lower(trim(p_brand || ' ' || p_size % 3)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as name from part)
group by name having count(*) >= 2"""
)
def schema_proposals(spark: SparkSession, d: str) -> DataFrame:
    examples = table(spark, d, "part").selectExpr("'entity_type' as kind", "p_brand || ' ' || p_size % 3 as name")
    known = spark.createDataFrame([("entity_type", "person")], "kind string, name string")
    return G.proposals(examples, known)


@query(
    """with raw as (select l_orderkey as source, l_linenumber as pos, trim(p_name) as name, lower(p_type) as type from lineitem join part on p_partkey = l_partkey),
kept as (select * from raw where type <> 'promo' and length(name) <= 40 and len(regexp_split_to_array(trim(name), '\\s+')) <= 5 and length(regexp_replace(name, '[^\\p{L}]', '', 'g')) >= 2
 and not regexp_matches(name, '[=^√∫∑∏∈∉≤≥≠→±≈∞′²³]|\\\\(frac|sqrt|int|sum)|[0-9]\\s*[+\\-*/·×:^]\\s*[0-9]|\\b[a-zA-Z][''′]?\\s*\\([^)]*\\)')), one as (select *, row_number() over (partition by source, lower(name), type order by pos) as n from kept),
p as (select *, row_number() over (partition by source order by pos, name, type) as place from one where n = 1)
select source, pos, name, type, cast(place as integer) as place from p where place <= 5"""
)
def extracted_entities(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").selectExpr("p_partkey as l_partkey", "p_name as name", "p_type as type")
    raw = table(spark, d, "lineitem").join(part, "l_partkey").selectExpr("l_orderkey as source", "l_linenumber as pos", "name", "type")
    types = part.select(F.lower("type").alias("type")).distinct().filter("type <> 'promo'")
    return G.extracted_entities(raw, types)


@query(
    """with own as (select regexp_replace(lower(trim(p_name)), '\\s+', ' ', 'g') as k, min(p_partkey) as e from part where p_partkey % 2 = 0 group by 1),
al as (select lower(p_name) as k, min(p_partkey) as e from part where p_partkey % 2 = 1 group by 1), n as (select distinct '@' || upper(p_name) as name from part union select s_name from supplier),
k as (select name, regexp_replace(regexp_replace(lower(trim(name)), '^@', ''), '\\s+', ' ', 'g') as k from n)
select k.name, coalesce(own.e, al.e) as entity, case when own.e is not null then 'name' when al.e is not null then 'alias' else 'new' end as how from k left join own on own.k = k.k left join al on al.k = k.k"""
)
def resolve_names(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").selectExpr("p_partkey as id", "p_name as name")
    names = part.select(F.concat(F.lit("@"), F.upper("name")).alias("name")).union(table(spark, d, "supplier").select("s_name")).distinct()
    return G.resolve_names(names, part.filter("id % 2 = 0"), part.filter("id % 2 = 1").withColumnRenamed("id", "canonical_id"))


ENTS = """e as (select ent.id, name, entity_type, vec, regexp_replace(regexp_replace(lower(trim(name)), '^@', ''), '\\s+', ' ', 'g') as nkey,
 regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', '', 'g') as mkey, list_filter(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}.]+'), lambda t: t <> '') as toks,
 regexp_matches(trim(name), '^[^\\p{L}\\p{N}]') as punct, length(regexp_replace(name, '[^\\p{Lu}]', '', 'g')) as caps, coalesce(mentions, 0) as mentions
 from ent left join (select to_id, count(*) as mentions from edge where active and relation = 'mention' group by to_id) on to_id = ent.id),
reps as (select nkey, min(id) as rep from e group by nkey),
blocks as (select distinct rep, key from (select rep, 'p:' || substr(mkey, 1, 3) as key from e join reps on rep = e.id union all select rep, 't:' || unnest(toks) from e join reps on rep = e.id)),
pairs as (select distinct x.rep as a, y.rep as b from blocks x join blocks y on x.key = y.key and x.rep < y.rep
 union all select rep, e.id from e join reps on reps.nkey = e.nkey where e.id <> rep)"""
JUDGED = """j as (select p.a, p.b, case when x.mkey = y.mkey and length(x.mkey) < 3 then 'short_key' when x.mkey = y.mkey and x.punct <> y.punct then 'punctuation' when x.mkey = y.mkey then 'same_key'
 when (case when len(x.toks) <= len(y.toks) then len(x.toks) >= 2 and len(y.toks) - len(x.toks) <= 2 and contains('|' || array_to_string(y.toks, '|') || '|', '|' || array_to_string(x.toks, '|') || '|')
  else len(y.toks) >= 2 and len(x.toks) - len(y.toks) <= 2 and contains('|' || array_to_string(x.toks, '|') || '|', '|' || array_to_string(y.toks, '|') || '|') end) then 'phrase'
 when levenshtein(x.mkey, y.mkey) <= case when least(length(x.mkey), length(y.mkey)) >= 8 then 2 else 1 end then 'edit' else 'different' end as reason,
 levenshtein(x.mkey, y.mkey) as dist, least(length(x.mkey), length(y.mkey)) as shorter, round(list_cosine_similarity(x.vec::double[], y.vec::double[]), 9) as sim
 from pairs p join e x on x.id = p.a join e y on y.id = p.b),
s as (select *, case reason when 'short_key' then 0.6 when 'punctuation' then 0.7 when 'same_key' then 1.0 when 'phrase' then 0.75 when 'edit' then 0.6 + 0.15 * greatest(0.0, 1 - dist / shorter) else 0.0 end as base from j),
judged as (select a, b, case when reason = 'same_key' then 'auto' when base > 0 then 'review' else 'reject' end as verdict,
 round(case when reason <> 'same_key' and base > 0 and sim >= 0.8 then least(0.95, base + 0.1) else base end, 6) as score, reason from s)"""


def _entities(spark: SparkSession, d: str) -> DataFrame:
    counts = X.edge(spark, d).filter("active and relation = 'mention'").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("mentions"))
    return N.prepared(X.ent(spark, d).join(counts, "id", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0))))


@query(sql("ent edge", f", {ENTS} select a, b from pairs"))
def merge_key_blocks(spark: SparkSession, d: str) -> DataFrame:
    return N.block_pairs(_entities(spark, d))


@query(sql("ent edge", f", {ENTS}, {JUDGED} select a, b, verdict, cast(score as double) as score, reason from judged"))
def judge_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _entities(spark, d)
    return N.judge(N.block_pairs(rows), rows)


def _folds(spark: SparkSession, d: str) -> DataFrame:
    rows = _entities(spark, d)
    return N.folds(N.judge(N.block_pairs(rows), rows), rows)


PICK = """und as (select a, b from judged where verdict = 'auto' union select b, a from judged where verdict = 'auto'),
reach(node, other) as (select a, a from und union select r.node, u.b from reach r join und u on u.a = r.other),
comp as (select node, min(other) as component from reach group by node),
best as (select component, node as canonical from (select component, node, row_number() over (partition by component order by mentions desc, length(name) desc, caps desc, node) as n from comp join e on e.id = node) where n = 1),
fold as (select node as source, canonical from comp join best using (component) where node <> canonical)"""


@query(sql("ent edge", f", {ENTS}, {JUDGED}, {PICK} select source, canonical from fold"))
def pick_canonical(spark: SparkSession, d: str) -> DataFrame:
    return _folds(spark, d)


@query(
    sql(
        "ent edge",
        f""", {ENTS}, {JUDGED}, {PICK}, moved as (select *, coalesce(canonical, to_id) as now, row_number() over (partition by from_id, coalesce(canonical, to_id), relation
  order by canonical is not null, active desc, to_id) as n from (select distinct from_id, to_id, relation, active from edge) left join fold on source = to_id)
select from_id, case when canonical is not null and n > 1 then to_id else now end as to_id, relation, active and not (canonical is not null and n > 1) as active from moved""",
    )
)
def fold_repoint(spark: SparkSession, d: str) -> DataFrame:
    edges = N.fold_edges(X.edge(spark, d).drop("id").distinct(), _folds(spark, d))
    return edges.select("from_id", "to_id", "relation", "active")


@query(sql("edge", "select distinct from_id, to_id, relation, active from edge"))
def fold_revert(spark: SparkSession, d: str) -> DataFrame:
    return N.unfold_edges(N.fold_edges(X.edge(spark, d).drop("id").distinct(), _folds(spark, d)))


@query(
    sql(
        "ent edge",
        f""", {ENTS}, {JUDGED} select j.a, j.b, cast(score as double) as score, reason, least(x.mentions, y.mentions) as impact from judged j join e x on x.id = j.a join e y on y.id = j.b
where verdict = 'review' and (j.a + j.b) % 10 <> 0 order by impact desc, score desc, j.a, j.b limit 50""",
    )
)
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = _entities(spark, d)
    judged = N.judge(N.block_pairs(rows), rows)
    return N.review_queue(judged, rows, judged.filter("(a + b) % 10 = 0").select("a", "b"))


@query(
    """with recursive al as (select p_partkey as source, cast(floor(p_partkey / 2) as bigint) as canonical from part where p_partkey > 1),
r(source, stop) as (select source, canonical from al union all select r.source, al.canonical from r join al on al.source = r.stop)
select source, min(stop) as canonical from r group by source"""
)
def alias_chase(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").filter("p_partkey > 1").selectExpr("p_partkey as source", "cast(floor(p_partkey / 2) as long) as canonical")
    return N.alias_chain(rows)


@query(
    """with x as (select l_orderkey as from_id, l_partkey as to_id, 'mention' as relation from lineitem where l_linenumber <= 2) select from_id, to_id, relation from x
union all select distinct l_orderkey, l_partkey, 'mention' from lineitem where l_linenumber > 2 and (l_orderkey, l_partkey) not in (select from_id, to_id from x)"""
)
def add_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey as from_id", "l_partkey as to_id", "'mention' as relation", "l_linenumber")
    return G.add_edges_if_absent(rows.filter("l_linenumber <= 2").drop("l_linenumber"), rows.filter("l_linenumber > 2").drop("l_linenumber"))
