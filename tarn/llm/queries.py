"""Registered queries of the training-data operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import ann, decontaminate, hard_negatives, harmonic, language, licenses, manifest, near_dup, packing, pii, secrets, token_count, toxicity
from tarn.llm.common import surrogate_key, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document lies in its source, the one thing that holds documents."""
    return licenses.scan(table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "doc_id"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(table(spark, sf_dir, "documents"), surrogate_key(spark))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic.harmonic_packing(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh vec_id are wrong by one, as the contract has it."""
    rows = table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(moved, F.col("vec_id") % 100 == 0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_token_count,
        op3_license_scan,
        op4_pii_surrogates,
        op5_decontamination,
        op6_language_id,
        op7_best_fit_packing,
        op8_toxicity,
        op9_nearest_neighbours,
        op10_near_duplicates,
        op11_harmonic_packing,
        op12_hard_negatives,
        op13_merkle_manifest,
    )
}



def _leaf(n_chars: str) -> str:
    fields = (f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", n_chars, "text"))
    return f"sha256({' || '.join(fields)})"


#: One level of both trees, and one step on the way from a leaf to a root.
_LEVEL = """
    select lang, level + 1, rank // 2, (size + 1) // 2, sha256(string_agg(hash, '' order by rank))
    from {0} where size > 1 group by lang, level, rank // 2, size"""
_STEP = """
    select w.lang, w.place, w.doc_id, w.leaf, w.level + 1, w.spot // 2, (w.size + 1) // 2, w.proof || coalesce(s.hash, ''),
        sha256(case when w.spot % 2 = 1 then s.hash || w.fold else w.fold || coalesce(s.hash, '') end)
    from {0} w left join {1} s on s.lang is not distinct from w.lang and s.level = w.level and s.rank = xor(w.spot, 1)
    where w.size > 1"""

ORACLES: dict[str, str] = {
    "op12_hard_negatives": """
with named as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where label is not null and embedding is not null and vec_id is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.v, c.v)::bigint as score
    from (select distinct * from named where vec_id % 100 = 0) a join named c on c.vec_id <> a.vec_id and len(a.v) = len(c.v)
), positives as (
    select * from scored where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
), ranked as (
    select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
        row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id)::integer as rank
    from positives p join scored n on n.anchor_id = p.anchor_id and not n.same
        and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 10
""",
    "op13_merkle_manifest": f"""
with recursive bits(i, c, k) as (
    select i, i, 0 from range(256) t(i)
    union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8
), crc as (
    select list(c order by i) as tab from bits where k = 8
), leaves as (
    select doc_id, lang, {_leaf("n_chars")} as leaf, {_leaf("(n_chars + 1)")} as moved,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)),
            lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 as marked
    from documents, crc
), placed as (
    select *, count(*) over (partition by lang) as size,
        row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as rank from leaves
), tree(lang, level, rank, size, hash) as (
    select lang, 0, rank, size, leaf from placed union all {_LEVEL.format("tree")}
), tops as (
    select lang as name, hash, row_number() over (order by lang nulls first) - 1 as rank, count(*) over () as size from tree where size = 1
), top_tree(lang, level, rank, size, hash) as (
    select 0, 0, rank, size, hash from tops union all {_LEVEL.format("top_tree")}
), walk(lang, place, doc_id, leaf, level, spot, size, proof, fold) as (
    select lang, rank, doc_id, leaf, 0, rank, size, '', case when marked then moved else leaf end from placed union all {_STEP.format("walk", "tree")}
), top_walk(lang, place, doc_id, leaf, level, spot, size, proof, fold) as (
    select 0, t.hash, w.doc_id, w.leaf, 0, t.rank, t.size, w.proof, w.fold
    from walk w join tops t on t.name is not distinct from w.lang where w.size = 1
    union all {_STEP.format("top_walk", "top_tree")}
)
select w.doc_id, w.leaf, w.place as subroot, r.hash as root, sha256(w.proof) as proof_sha256, w.fold as folded_root, w.fold = r.hash as verified
from top_walk w, (select hash from top_tree where size = 1) r where w.size = 1
""",
}
