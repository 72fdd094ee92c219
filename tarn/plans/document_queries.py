"""Document, text-function, link and recording queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.operators import documents as D
from tarn.operators import recordings as A
from tarn.operators import retrieval as R
from tarn.plans import fixtures as X
from tarn.plans.fixtures import sql
from tarn.plans.registry import Registry
from tarn.streaming.jobs import event_counts
from tarn.tables import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(
    """with u as (select page_id, regexp_replace(trim(url), '#.*$', '') as u from pages), p as (select page_id, split_part(u, '?', 1) as base,
 list_filter(string_split(case when contains(u, '?') then substr(u, strpos(u, '?') + 1) else '' end, '&'), lambda x: x <> '' and not regexp_matches(lower(x), '^(utm_[^=]*|fbclid|gclid|gbraid|wbraid|msclkid|mc_(cid|eid)|igshid|ref|ref_src|s_kwcid|_hs(enc|mi))(=|$)')) as kept from u)
select page_id, lower(regexp_extract(base, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*')) || case when regexp_matches(base, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*$') then '/' else regexp_replace(base, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '') end || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as url from p"""
)
def normalize_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.normalize_url(F.col("url")).alias("url"))


@query(
    """with b as (select page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '/+$', '') as b from pages)
select page_id, case when not contains(b, '/') then b else translate(regexp_replace(regexp_extract(b, '[^/]+$'), '\\.[A-Za-z0-9]{1,5}$', ''), '-_', '  ') end as title from b"""
)
def url_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.url_title(F.col("url")).alias("title"))


def _secret() -> str:
    """The shapes of secrets one after the other; no text of the fixture has one inside an assignment's value."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    out = "text"
    value = r"""("[^"\n]{8,}"|'[^'\n]{8,}'|[^\s"',;]{8,})"""
    for pattern, to in (*((p, T.REDACTED) for p in T.SECRETS), (T.SECRET_NAME + value, f"\\1\\2{T.REDACTED}"), (T.CREDENTIALS, f"\\1:{T.REDACTED}@")):
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(to)}, 'g')"
    return out


SECRET = _secret()


@query(f"select doc_id, sha256({SECRET}) as redacted from documents")
def redact_assignments(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.sha2(T.redact(F.col("text")), 256).alias("redacted"))


@query(
    """with m as (select doc_id, length(regexp_replace(text, '[^0-9=+\\-*/^√∫∑∈≤≥→±²³()<>|\\\\]', '', 'g')) as m, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) as l,
 length(regexp_replace(text, '\\s+', '', 'g')) as n from documents) select doc_id, round(m::double / greatest(1, m + l), 6) as density, m::double / greatest(1, m + l) >= 0.25 and n >= 40 as mathematical from m"""
)
def math_density(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return _docs(spark, d).select("doc_id", F.round(T.math_density(text), 6).alias("density"), T.is_mathematical(text).alias("mathematical"))


@query(
    """select item_id, doc_id from benchmark b join documents d on length(lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g')))) >= 15
 and contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g'))))"""
)
def quote_verify(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("quote"))
    found = R.quotes_in(_docs(spark, d).select(F.col("doc_id").alias("id"), "text"), items)
    return found.select(F.col("qid").alias("item_id"), F.col("id").alias("doc_id"))


@query("select doc_id, cast(ceil(length(text) / 4.0) as bigint) as tokens, case when length(text) > 80 then substr(text, 1, 80) || '...' else text end as short, sha256(text) || '#p2' as hash from documents")
def text_scalars(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return _docs(spark, d).select("doc_id", T.token_estimate(text).alias("tokens"), T.ellipsis(text, 80).alias("short"), T.content_hash(text, "#p2").alias("hash"))


@query(
    """select p_partkey, regexp_replace(lower(p_name || ' v' || p_size), '[^\\p{L}\\p{N}]+', '', 'g') as merge_key, regexp_replace(regexp_replace(lower(trim('@' || p_name)), '^@', ''), '\\s+', ' ', 'g') as name_key,
 array_to_string(list_filter(regexp_split_to_array(lower(p_name || ' v' || p_size), '[^\\p{L}\\p{N}.]+'), lambda t: regexp_matches(t, '[0-9]')), ',') as versions, length(regexp_replace(p_brand, '[^\\p{Lu}]', '', 'g')) as capitals from part"""
)
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" v"), "p_size")
    return table(spark, d, "part").select(
        "p_partkey",
        T.merge_key(name).alias("merge_key"),
        T.name_key(F.concat(F.lit("@"), "p_name")).alias("name_key"),
        F.array_join(T.version_tokens(name), ",").alias("versions"),
        T.capitals(F.col("p_brand")).cast("long").alias("capitals"),
    )


@query(
    """select o_orderkey, case when o_orderkey >= 3600 then (o_orderkey // 3600) || ':' || lpad(((o_orderkey % 3600) // 60)::varchar, 2, '0') || ':' || lpad((o_orderkey % 60)::varchar, 2, '0')
 else (o_orderkey // 60) || ':' || lpad((o_orderkey % 60)::varchar, 2, '0') end as clock from orders"""
)
def clock_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", T.clock(F.col("o_orderkey")).alias("clock"))


CHUNKED = """old as (select doc_id as document, unnest(string_split(text, chr(10))) as content, unnest(range(len(string_split(text, chr(10))))) as chunk_index from documents),
new as (select document, content, chunk_index from old where (document + chunk_index) % 5 <> 0 union all select document, 'added ' || document, 1000 from (select distinct document from old))"""


@query(
    f"""with {CHUNKED}, o as (select *, row_number() over (partition by document, content order by chunk_index) as n from old), w as (select *, row_number() over (partition by document, content order by chunk_index) as n from new)
select coalesce(o.document, w.document) as document, case when w.n is null then 'doom' when o.n is null then 'fresh' else 'keep' end as action, o.chunk_index as old_index, w.chunk_index as new_index
from o full outer join w on o.document = w.document and o.content = w.content and o.n = w.n"""
)
def chunk_reuse_plan(spark: SparkSession, d: str) -> DataFrame:
    old = _docs(spark, d).select(F.col("doc_id").alias("document"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    old = old.withColumn("chunk_index", F.col("chunk_index").cast("long"))
    added = old.select("document").distinct().select("document", F.lit(1000).cast("long").alias("chunk_index"), F.concat(F.lit("added "), "document").alias("content"))
    new = old.filter("(document + chunk_index) % 5 <> 0").unionByName(added)
    return D.reuse_plan(old, new)


INGEST = """known as (select case when doc_id % 3 = 0 then 'upload://f' || doc_id || '.md' else '/notes/f' || doc_id || '.md' end as path, sha256(text) as content_hash from documents where doc_id % 2 = 0),
inc as (select case doc_id % 5 when 0 then 'upload://f' || doc_id || '.md' when 1 then 'https://x.example/f' || doc_id || '.md' else '/notes/f' || doc_id || '.md' end as path, case when doc_id % 7 = 0 then sha256(text || 'x') else sha256(text) end as content_hash from documents)"""


@query(
    f"""with {INGEST}, h as (select content_hash, bool_or(starts_with(path, 'upload://')) as up from known group by 1), n as (select lower(regexp_extract(path, '[^/]+$')) as base, bool_or(starts_with(path, 'upload://')) as up, bool_or(not starts_with(path, 'upload://')) as linked from known group by 1)
select i.path, case when k.path is not null and k.content_hash = i.content_hash then 'unchanged' when k.path is not null then 'updated' when not starts_with(i.path, 'upload://') and coalesce(h.up, false) then 'converted'
 when not starts_with(i.path, 'upload://') and not starts_with(i.path, 'https://') and coalesce(n.up, false) then 'converted' when starts_with(i.path, 'upload://') and (h.content_hash is not null or coalesce(n.linked, false)) then 'exists' else 'added' end as outcome
from inc i left join known k on k.path = i.path left join h on h.content_hash = i.content_hash left join n on n.base = lower(regexp_extract(i.path, '[^/]+$'))"""
)
def ingest_outcome(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    known = docs.filter("doc_id % 2 = 0").selectExpr(
        "case when doc_id % 3 = 0 then 'upload://f' || doc_id || '.md' else '/notes/f' || doc_id || '.md' end as path", "sha2(text, 256) as content_hash"
    )
    incoming = docs.selectExpr(
        "case doc_id % 5 when 0 then 'upload://f' || doc_id || '.md' when 1 then 'https://x.example/f' || doc_id || '.md' else '/notes/f' || doc_id || '.md' end as path",
        "case when doc_id % 7 = 0 then sha2(text || 'x', 256) else sha2(text, 256) end as content_hash",
    )
    return D.ingest_outcomes(incoming, known)


PATHS = """paths as (select '/home/' || source || '/' || lang || '/' || doc_id || '.md' as path, doc_id from documents)"""
ROOTS = """roots as (select distinct '/home/' || source as root from documents union select distinct '/home/' || source || '/' || lang from documents union select '/none')"""


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(F.concat(F.lit("/home/"), "source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), "doc_id")


@query(f"with {PATHS}, {ROOTS} select root, count(path) as documents from roots left join paths on starts_with(path, root || '/') group by root")
def prefix_documents(spark: SparkSession, d: str) -> DataFrame:
    one = _docs(spark, d).select(F.concat(F.lit("/home/"), "source").alias("root")).distinct()
    two = _docs(spark, d).select(F.concat(F.lit("/home/"), "source", F.lit("/"), "lang").alias("root")).distinct()
    return D.under_roots(_paths(spark, d), one.union(two).union(spark.createDataFrame([("/none",)], "root string")))


@query(f"with {PATHS} select doc_id, path from paths where starts_with(path, '/home/src1/')")
def folder_documents(spark: SparkSession, d: str) -> DataFrame:
    return D.in_folder(_paths(spark, d), "/home/src1").select("doc_id", "path")


@query(
    f"""with {PATHS} select path, case when doc_id % 4 = 0 then 'missing' when doc_id % 4 = 1 then 'fresh' else 'changed' end as change from paths where doc_id % 4 < 2 or doc_id % 3 = 0"""
)
def missing_files(spark: SparkSession, d: str) -> DataFrame:
    paths = _paths(spark, d)
    seen = paths.filter("doc_id % 4 <> 0").withColumn("mtime", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, if(doc_id % 3 = 0, 2, -2))"))
    return D.file_changes(paths.filter("doc_id % 4 <> 1"), seen, F.lit("2024-01-01").cast("timestamp"))


@query()
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return D.chunks(_docs(spark, d).selectExpr("doc_id as id", "text"), "text")


@query()
def article_markdown(spark: SparkSession, d: str) -> DataFrame:
    return D.articles(table(spark, d, "pages").selectExpr("page_id as id", "html"))


TURN = """g as (select *, case when lag(speaker) over w is distinct from speaker or start - lag("end") over w > 2 then 1 else 0 end as new from seg window w as (partition by recording order by start, "end", speaker)),
t as (select *, sum(new) over (partition by recording order by start, "end", speaker) as turn from g),
turns as (select recording, turn, min(speaker) as speaker, min(start) as start, max("end") as "end" from t group by 1, 2)"""


@query(sql("seg", f""", {TURN} select recording, cast(turn as bigint) as turn, speaker, round(start, 3) as start, round("end", 3) as "end" from turns"""))
def turn_sessionize(spark: SparkSession, d: str) -> DataFrame:
    out = A.turns(X.seg(spark, d))
    return out.select("recording", "turn", "speaker", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query(sql("seg", "select recording, speaker, row_number() over (partition by recording order by min(start), speaker) as label from seg group by recording, speaker"))
def speaker_labels(spark: SparkSession, d: str) -> DataFrame:
    return A.relabelled(X.seg(spark, d)).withColumn("label", F.col("label").cast("long"))


@query(
    sql(
        "seg",
        """, b as (select recording, speaker, round(sum("end" - start), 6) as seconds, round(max("end" - start), 6) as longest from seg group by 1, 2), w as (select recording, sum(seconds) as total, max(seconds) as biggest from b group by 1)
select b.recording, speaker, round(seconds, 3) as seconds, round(longest, 3) as longest from b join w using (recording) where seconds >= least(8.0, 0.1 * total) and seconds >= 0.05 * biggest""",
    )
)
def speaker_roster(spark: SparkSession, d: str) -> DataFrame:
    out = A.roster(X.seg(spark, d))
    return out.select("recording", "speaker", F.round("seconds", 3).alias("seconds"), F.round("longest", 3).alias("longest"))


@query(
    sql(
        "seg",
        f""", {TURN}, words as (select recording, start + 1.5 as at_, event_id as word from seg)
select word, coalesce((select speaker from turns t where t.recording = w.recording and t.start <= w.at_ order by t.start desc limit 1), (select speaker from turns t where t.recording = w.recording order by t.start limit 1)) as speaker from words w""",
    )
)
def asof_speaker(spark: SparkSession, d: str) -> DataFrame:
    seg = X.seg(spark, d)
    words = seg.select("recording", (F.col("start") + 1.5).alias("start"), F.col("event_id").alias("word"))
    return A.asof_turns(words, A.turns(seg)).select("word", "speaker")


OVERLAP = sql(
    "seg",
    """, iv as (select recording, event_id as id, start as s, start + 3600 as e from seg)
select iv.recording, iv.id, round(sum(greatest(0.0, least(iv.e, seg."end") - greatest(iv.s, seg.start))), 3) as seconds from iv join seg on seg.recording = iv.recording group by 1, 2""",
)


@query(OVERLAP)
def overlap_speech(spark: SparkSession, d: str) -> DataFrame:
    seg = X.seg(spark, d)
    intervals = seg.selectExpr("recording", "event_id as id", "start", "start + 3600 as end")
    return A.overlap_seconds(intervals, seg).withColumn("seconds", F.round("seconds", 3))


@query(OVERLAP)
def overlap_speech_all(spark: SparkSession, d: str) -> DataFrame:
    """The name that overlap_speech had over all events while it took some of them."""
    return overlap_speech(spark, d)


@query(
    sql(
        "sess",
        """, r as (select session as recording, line as chunk, length(text) - length(replace(text, ' ', '')) + 1 as words, 8.0 + line as speech from sess),
x as (select *, words / speech as rate, row_number() over (partition by recording order by words / speech) as n, count(*) over (partition by recording) as c from r),
m as (select recording, rate as median from x where n = c // 2 + 1 and c >= 3)
select x.recording, chunk, round(rate, 6) as rate, round(median, 6) as median from x join m using (recording) where rate < 0.5 * median""",
    )
)
def suspect_median(spark: SparkSession, d: str) -> DataFrame:
    rates = X.sess(spark, d).selectExpr("session as recording", "line as chunk", "length(text) - length(replace(text, ' ', '')) + 1 as words", "8.0D + line as speech")
    return A.suspect_chunks(rates)


@query(
    sql(
        "seg",
        """, c as (select recording, event_id // 100 as section, speaker, count(*) as n, min(start) as first from seg group by 1, 2, 3)
select recording, section, speaker from (select *, row_number() over (partition by recording, section order by n desc, first) as k from c) where k = 1""",
    )
)
def dominant_speaker(spark: SparkSession, d: str) -> DataFrame:
    spoken = X.seg(spark, d).withColumn("at", F.col("start"))
    return A.dominant_speakers(spoken, F.floor(F.col("event_id") / 100))


@query()
def speech_packing(spark: SparkSession, d: str) -> DataFrame:
    return A.packed_speech(X.seg(spark, d).select("recording", "start", "end"), 7200.0, 1800.0)


@query(
    """select page_id, case when octet_length(encode(html)) > 10485760 then 'too_large' when length(html) = 0 then 'empty' when octet_length(encode(html)) > 3000 and length(regexp_replace(html, '<[^>]*>', '', 'g')) < 800 then 'thin' else 'ok' end as outcome from pages"""
)
def link_outcomes(spark: SparkSession, d: str) -> DataFrame:
    chars = F.length(F.regexp_replace("html", "<[^>]*>", ""))
    size = F.octet_length("html")
    pages = table(spark, d, "pages")
    # a smaller bound than in production, as the fixture's pages are small
    scaled = F.when(size > 3000, F.lit(D.LARGE_HTML + 1)).otherwise(size)
    return pages.select("page_id", D.link_outcome(scaled, chars, F.lit("text/html")).alias("outcome"))


@query("select event_type, cast(date_trunc('hour', ts) as timestamp) as hour, count(*) as n from events group by 1, 2")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    return event_counts(table(spark, d, "events")).select("event_type", F.col("window.start").alias("hour"), "n")


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def event_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
