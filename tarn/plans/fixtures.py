"""Store-like views over the given tables, as DataFrames and as DuckDB common table expressions of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.tables import table

SIM = "round(list_cosine_similarity(a.vec::double[], b.vec::double[]), 9)"

CTE = {
    "mem": """mem as (select d.doc_id as id, 'memory' as src, d.text, sha256(d.text) as content_hash,
        case when d.doc_id % 7 = 3 then 'stale' else 'active' end as status, d.doc_id - d.doc_id % 3 as root_id,
        cast(d.doc_id % 3 + 1 as integer) as version, timestamp '2024-01-01 00:00:00' + d.doc_id * interval 1 minute as asserted_at,
        e.embedding as vec from documents d join embeddings e on e.vec_id = d.doc_id % (select count(*) from embeddings))""",
    "act": "act as (select * from mem where status = 'active')",
    "q": "q as (select b.item_id as qid, b.text, e.embedding as vec from benchmark b join embeddings e on e.vec_id = b.item_id)",
    "ent": """ent as (select p_partkey as id, case p_partkey % 5 when 0 then upper(p_name) when 1 then replace(p_name, ' ', '-')
        when 2 then '@' || p_name else p_name end as name, lower(p_type) as entity_type, e.embedding as vec
        from part join embeddings e on e.vec_id = p_partkey % (select count(*) from embeddings))""",
    "edge": """edge as (select l_orderkey as from_id, l_partkey as to_id, case when l_linenumber % 4 = 3 then 'about' else 'mention' end as relation, l_returnflag <> 'R' as active,
        l_orderkey * 10 + l_linenumber as id from lineitem)""",
    "rep": """rep as (select doc_id + 1 as from_id, doc_id as to_id, 'replaces' as relation, doc_id % 5 <> 0 as active
        from documents where doc_id % 3 < 2)""",
    "typed": """typed as (select s_suppkey as from_id, 100000 + s_nationkey as to_id, 'located_in' as relation,
        least(1.0, greatest(0.0, s_acctbal / 10000)) as confidence, s_acctbal >= 0 as active from supplier
        union all select 100000 + n_nationkey, 200000 + n_regionkey, 'part_of', 1.0, true from nation)""",
    "doc_of": "doc_of as (select o_orderkey as from_id, o_custkey as document from orders)",
    "seg": """seg as (select user_id as recording, epoch(ts) as start, epoch(ts) + value as "end", event_type as speaker, event_id from events)""",
    "sess": "sess as (select conv_id as session, turn as line, role, text from conversations)",
    "alias": """alias as (select p_partkey as id, p_partkey * 3 as canonical_id, p_partkey + 1 as entity_id, lower(p_name) as name_key from part)""",
    "toks": """toks as (select src, id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}]+')) as term from act)""",
}


def sql(names: str, body: str) -> str:
    """``body`` with the named views before it."""
    return "with recursive " + ",\n".join(CTE[n] for n in names.split()) + "\n" + body if names else body


#: Vectors that are broadcast; more are shuffled.
FEW_VECTORS = 50_000


def with_vectors(rows: DataFrame, spark: SparkSession, d: str, key: str) -> DataFrame:
    """``rows`` with the vector that their key takes. Never are the rows broadcast, however small their files are: they grow, and are read often."""
    vectors = table(spark, d, "embeddings")
    n = vectors.count()
    own = vectors.select("vec_id", F.col("embedding").alias("vec"))
    own = F.broadcast(own) if n <= FEW_VECTORS else own.hint("merge")
    return rows.withColumn("vec_id", F.expr(f"{key} % {n}")).join(own, "vec_id").drop("vec_id")


def mem(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.lit("memory").alias("src"), "text", F.sha2("text", 256).alias("content_hash"),
        F.expr("case when doc_id % 7 = 3 then 'stale' else 'active' end").alias("status"), F.expr("doc_id - doc_id % 3").alias("root_id"),
        F.expr("cast(doc_id % 3 + 1 as int)").alias("version"), F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, doc_id)").alias("asserted_at"),
    )
    return with_vectors(rows, spark, d, "id")


def plain_mem(spark: SparkSession, d: str) -> DataFrame:
    """mem without its vectors: no join."""
    return table(spark, d, "documents").selectExpr(
        "doc_id as id", "text as content", "sha2(text, 256) as content_hash", "case when doc_id % 7 = 3 then 'stale' else 'active' end as status",
        "doc_id - doc_id % 3 as root_id", "cast(doc_id % 3 + 1 as int) as version",
        "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, doc_id) as asserted_at", "cast(null as timestamp) as stale_since",
    )


def active(spark: SparkSession, d: str) -> DataFrame:
    return mem(spark, d).filter("status = 'active'")


def q(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return rows.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec")), "qid")


def ent(spark: SparkSession, d: str) -> DataFrame:
    name = """case p_partkey % 5 when 0 then upper(p_name) when 1 then replace(p_name, ' ', '-') when 2 then '@' || p_name else p_name end"""
    rows = table(spark, d, "part").selectExpr("p_partkey as id", f"{name} as name", "lower(p_type) as entity_type")
    return with_vectors(rows, spark, d, "id")


def plain_ent(spark: SparkSession, d: str) -> DataFrame:
    name = """case p_partkey % 5 when 0 then upper(p_name) when 1 then replace(p_name, ' ', '-') when 2 then '@' || p_name else p_name end"""
    return table(spark, d, "part").selectExpr("p_partkey as id", f"{name} as name", "lower(p_type) as entity_type")


def edge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey as from_id", "l_partkey as to_id", "case when l_linenumber % 4 = 3 then 'about' else 'mention' end as relation",
        "l_returnflag <> 'R' as active", "l_orderkey * 10 + l_linenumber as id",
    )


def rep(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter("doc_id % 3 < 2")
    return rows.selectExpr("doc_id + 1 as from_id", "doc_id as to_id", "'replaces' as relation", "doc_id % 5 <> 0 as active")


def typed(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "supplier").selectExpr(
        "s_suppkey as from_id", "cast(100000 + s_nationkey as long) as to_id", "'located_in' as relation",
        "least(1.0D, greatest(0.0D, s_acctbal / 10000)) as confidence", "s_acctbal >= 0 as active",
    )
    two = table(spark, d, "nation").selectExpr(
        "cast(100000 + n_nationkey as long) as from_id", "cast(200000 + n_regionkey as long) as to_id", "'part_of' as relation", "1.0D as confidence", "true as active"
    )
    return one.unionByName(two)


def doc_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey as from_id", "o_custkey as document")


def seg(spark: SparkSession, d: str) -> DataFrame:
    at = "unix_micros(cast(ts as timestamp)) / 1000000D"
    return table(spark, d, "events").selectExpr("user_id as recording", f"{at} as start", f"{at} + value as end", "event_type as speaker", "event_id")


def sess(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").selectExpr("conv_id as session", "turn as line", "role", "text")


def alias(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey as id", "p_partkey * 3 as canonical_id", "p_partkey + 1 as entity_id", "lower(p_name) as name_key")
