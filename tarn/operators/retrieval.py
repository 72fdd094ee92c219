"""Hybrid retrieval: vector, keyword and entity rankings, fused by reciprocal rank. All work on batches of queries.

Rows are (src, id, vec) and (src, id, text); queries (qid, text, vec). Ties in a ranking go by (src, id).
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tarn.checkpoints import bounded, persisted
from tarn.functions.vectors import nearest

POOL, ANCHORS, K, LIMIT = 50, 10, 60, 10
ANCHOR_SIMILARITY = 0.60
WEIGHTS = {"vector": 1.0, "keyword": 2.0, "entity": 0.5}


def ranked(rows: DataFrame, by: list[Column], most: int, partition: str = "qid") -> DataFrame:
    """The first ``most`` rows of each partition with their rank; Spark limits them before the shuffle."""
    place = F.row_number().over(Window.partitionBy(partition).orderBy(*by))
    return rows.withColumn("rank", place).filter(F.col("rank") <= most)


def vector_arm(rows: DataFrame, queries: DataFrame | pa.Table, pool: int = POOL) -> DataFrame:
    """One ranking over all sources: (qid, src, id, similarity, rank)."""
    return ranked(nearest(rows, queries, pool), [F.desc(F.round("similarity", 9)), F.asc("src"), F.asc("id")], pool)


#: Terms of the keyword arm, of any script.
TERM = r"[\p{L}\p{M}\p{N}]+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def postings(rows: DataFrame) -> DataFrame:
    """Rows (src, id, text) -> (term, src, id, tf), the index of the keyword arm. Stored, it serves every call."""
    each = rows.select("src", "id", F.explode(terms(F.col("text"))).alias("term"))
    return each.groupBy("term", "src", "id").agg(F.count("*").alias("tf"))


@dataclass(frozen=True)
class KeywordIndex:
    """Stored postings (term, cls, src, id, tf), sorted by term and class of tf, and how many there are of each (term, cls, n).

    A class is a power of two that tf reaches, so all rows of a class have a larger tf than any of a lower one.
    """

    postings: DataFrame
    stats: DataFrame


def keyword_index(rows: DataFrame) -> KeywordIndex:
    """The index of rows (src, id, text), written once; a term of very many rows lies in several files."""
    classed = postings(rows).withColumn("cls", F.floor(F.log2("tf")).cast("int")).select("term", "cls", "src", "id", "tf")
    made = persisted(classed.repartitionByRange("term", "cls", "src", "id").sortWithinPartitions("term", "cls"), "postings")
    counts = made.groupBy("term", "cls").agg(F.count("*").alias("n"))
    return KeywordIndex(made, persisted(counts.repartitionByRange("term").sortWithinPartitions("term"), "stats"))


def _indexed(postings_: DataFrame) -> KeywordIndex:
    """Postings as they are, with their counts still to be made."""
    classed = postings_.withColumn("cls", F.floor(F.log2("tf")).cast("int"))
    return KeywordIndex(classed, classed.groupBy("term", "cls").agg(F.count("*").alias("n")))


def query_units(queries: DataFrame) -> DataFrame:
    """(qid, clause, negated, needed: terms): words and quoted phrases; "-" excludes one; OR stands between clauses."""
    units = F.regexp_extract_all(F.lower("text"), F.lit(r'-?"[^"]*"|[^\s"]+'), 0)
    split = queries.select("qid", F.posexplode(units).alias("pos", "unit"))
    clause = F.sum((F.col("unit") == "or").cast("int")).over(Window.partitionBy("qid").orderBy("pos"))
    split = split.withColumn("clause", clause).filter("unit <> 'or'")
    return split.select("qid", "clause", F.col("unit").startswith("-").alias("negated"), terms(F.col("unit")).alias("needed")).filter("size(needed) > 0").distinct()


#: Queries, and their units, that are held against the index by their own numbers; of more, everything stays in tables.
FEW, MOST_UNITS = 4096, 100_000
#: Terms that are looked up in the index's files by name.
BY_NAME = 1000
CLAUSES = "array<struct<needed: array<string>, asked: array<struct<negated: boolean, phrase: string>>>>"


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows that the driver has, as a relation of the plan itself."""
    shape = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(shape.names, r, strict=True)) for r in rows], to_arrow_schema(shape)), shape)


def units_here(queries: DataFrame) -> list[tuple]:
    """query_units() of queries that are few, by one projection: (qid, clause, negated, needed)."""
    units = F.regexp_extract_all(F.lower("text"), F.lit(r'-?"[^"]*"|[^\s"]+'), 0)
    read = F.transform(units, lambda u: F.struct((u == "or").alias("or"), F.startswith(u, F.lit("-")).alias("negated"), terms(u).alias("needed")))
    out = []
    for row in queries.select("qid", read.alias("units")).collect():
        clause = 0
        for u in row["units"] or []:
            clause += u["or"]
            if u["needed"] and not u["or"]:
                out.append((row["qid"], clause, u["negated"], u["needed"]))
    return out


def keyword_arm(rows: DataFrame, queries: DataFrame, pool: int = POOL, index: KeywordIndex | DataFrame | None = None, few: bool = False) -> DataFrame:
    """Rows that hold all words and phrases of a clause of the query and none it excludes: (qid, src, id, score, rank).

    The score counts the query's terms in the row. ``index``: the stored keyword_index() of the rows, or their postings(); without
    one, the postings of the queries' terms are made here. A clause's candidates are the rows with its rarest term; only they are
    held against its other terms, and only rows of queries with phrases or exclusions are read. Of a query of one word, those
    classes of tf are read that hold its first ``pool`` rows. A query without a term that is wanted has no rows. ``few``: the
    queries are known to be at most FEW.
    """
    index = _indexed(index) if isinstance(index, DataFrame) else index
    few = few or queries.limit(FEW + 1).count() <= FEW
    units = units_here(queries) if few else None
    if units is None or len(units) > MOST_UNITS:
        return _keyword_arm_of_many(rows, persisted(query_units(queries), "units"), pool, index.postings.drop("cls") if index else None)
    return _keyword_arm_of_few(rows, units, queries.schema["qid"].dataType.simpleString(), pool, index)


def _keyword_arm_of_few(rows: DataFrame, units: list[tuple], qid: str, pool: int, index: KeywordIndex | None) -> DataFrame:
    """One plan: what is rare and what has to be read is known beforehand from the terms' counts."""
    spark = rows.sparkSession
    clauses: dict = defaultdict(lambda: defaultdict(lambda: (set(), [])))
    for q, clause, negated, unit in units:
        needed, asked = clauses[q][clause]
        if not negated:
            needed.update(unit)
        if negated or len(unit) > 1:
            asked.append({"negated": negated, "phrase": f" {' '.join(unit)} "})
    names = sorted({t for of in clauses.values() for needed, _ in of.values() for t in needed})
    shared = lambda found, schema: F.broadcast(local(spark, found, schema))

    def named(df: DataFrame) -> DataFrame:
        return df.filter(F.col("term").isin(names)) if len(names) <= BY_NAME else df.join(shared([(n,) for n in names], "term string"), "term", "left_semi")

    if index is None:
        each = named(rows.select("src", "id", F.explode(terms(F.col("text"))).alias("term"))).groupBy("term", "src", "id").agg(F.count("*").alias("tf"))
        held = persisted(each.withColumn("cls", F.floor(F.log2("tf")).cast("int")), "postings")
        counts = held.groupBy("term", "cls").agg(F.count("*").alias("n"))
    else:
        held, counts = named(index.postings), named(index.stats)
    classes: dict[str, dict[int, int]] = defaultdict(dict)
    for r in counts.collect():  # a few classes a term
        classes[r["term"]][r["cls"]] = r["n"]
    many = {t: sum(c.values()) for t, c in classes.items()}

    one, rarest, wanted, of_query, strict = [], set(), [], [], set()
    for q, of in clauses.items():
        live = [(needed, asked) for needed, asked in of.values() if needed and all(t in many for t in needed)]
        every = {t for needed, _ in of.values() for t in needed}
        if not live:
            continue
        if len(every) == 1 and not any(asked for _, asked in live):
            (term,) = every
            one.append((q, term, _least_class(classes[term], pool)))
            continue
        rarest |= {(q, min(needed, key=lambda t: (many[t], t))) for needed, _ in live}
        wanted += [(q, t) for t in sorted(every)]
        of_query.append((q, [{"needed": sorted(needed), "asked": asked} for needed, asked in live]))
        if any(asked for _, asked in live):
            strict.add(q)
    single = held.join(shared(one, f"qid {qid}, term string, least int"), "term").filter("cls >= least").select("qid", "src", "id", F.col("tf").alias("score"))
    found = None
    if of_query:
        pairs = held.join(shared(sorted(rarest), f"qid {qid}, term string"), "term").select("qid", "src", "id").distinct()
        looked = pairs.join(shared(wanted, f"qid {qid}, term string"), "qid")
        hits = looked.join(held.select("term", "src", "id", "tf"), ["term", "src", "id"]).groupBy("qid", "src", "id")
        held_by = hits.agg(F.sum("tf").alias("score"), F.collect_set("term").alias("held")).join(shared(of_query, f"qid {qid}, clauses {CLAUSES}"), "qid")
        full = lambda c: F.size(F.array_except(c["needed"], "held")) == 0
        held_by = held_by.filter(F.exists("clauses", full))
        if strict:
            flat = F.concat(F.lit(" "), F.array_join(terms(F.col("text")), " "), F.lit(" ")).alias("flat")
            asking = F.exists("clauses", lambda c: F.size(c["asked"]) > 0)
            right = F.forall("c.asked", lambda a: F.contains(F.col("flat"), a["phrase"]) != a["negated"])
            each = held_by.filter(asking).withColumn("c", F.explode("clauses")).filter(full(F.col("c")))
            read = each.join(rows.select("src", "id", flat), ["src", "id"]).filter(right).select("qid", "src", "id", "score").distinct()
            found = held_by.filter(~asking).select("qid", "src", "id", "score").unionByName(read)
        else:
            found = held_by.select("qid", "src", "id", "score")
    found = single if found is None else found.unionByName(single) if one else found
    return ranked(found, [F.desc("score"), F.asc("src"), F.asc("id")], pool).select("qid", "src", "id", "score", "rank")


def _least_class(counts: dict[int, int], pool: int) -> int:
    """The lowest class that can hold one of the first ``pool`` rows of a term."""
    seen = 0
    for cls in sorted(counts, reverse=True):
        seen += counts[cls]
        if seen >= pool:
            return cls
    return min(counts)


def _keyword_arm_of_many(rows: DataFrame, units: DataFrame, pool: int, index: DataFrame | None) -> DataFrame:
    index = index if index is not None else persisted(postings(rows), "postings")
    wanted = units.filter("not negated").select("qid", "clause", F.explode("needed").alias("term")).distinct()
    every = bounded(persisted(wanted.select("term").distinct(), "terms"))
    counts = index.join(every, "term").groupBy("term").agg(F.count("*").alias("n"))
    of = wanted.join(counts, "term", "left").groupBy("qid", "clause")
    rarest = of.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("r"), F.count("*").alias("terms"))
    rarest = persisted(rarest.filter("r.n > 0").select("qid", "clause", F.col("r.term").alias("term"), "terms"), "rarest")
    pairs = persisted(index.join(bounded(rarest), "term").select("qid", "clause", "terms", "src", "id"), "pairs")
    looked = pairs.select("qid", "src", "id").distinct().join(wanted.select("qid", "term").distinct(), "qid")
    hits = persisted(index.join(bounded(persisted(looked, "looked")), ["term", "src", "id"]).select("qid", "src", "id", "term", "tf"), "hits")
    held = pairs.join(hits.drop("tf"), ["qid", "src", "id"]).join(wanted, ["qid", "clause", "term"])
    full = held.groupBy("qid", "clause", "terms", "src", "id").agg(F.count("*").alias("n")).filter("n = terms")
    full = full.select("qid", "clause", "src", "id")
    strict = units.filter("negated or size(needed) > 1").select("qid", "clause", "negated", F.concat(F.lit(" "), F.array_join("needed", " "), F.lit(" ")).alias("phrase"))
    if not strict.isEmpty():
        asked = strict.groupBy("qid", "clause").agg(F.collect_list(F.struct("negated", "phrase")).alias("asked"))
        full = persisted(full.join(asked, ["qid", "clause"], "left"), "full")
        read = bounded(persisted(full.filter("asked is not null").select("src", "id").distinct(), "read"))
        texts = rows.select("src", "id", "text").join(read, ["src", "id"]).select("src", "id", F.concat(F.lit(" "), F.array_join(terms(F.col("text")), " "), F.lit(" ")).alias("flat"))
        right = F.forall("asked", lambda a: F.contains(F.col("flat"), a["phrase"]) != a["negated"])
        full = full.join(texts, ["src", "id"], "left").filter(F.col("asked").isNull() | right)
    score = hits.groupBy("qid", "src", "id").agg(F.sum("tf").alias("score"))
    found = score.join(full.select("qid", "src", "id").distinct(), ["qid", "src", "id"])
    return ranked(found, [F.desc("score"), F.asc("src"), F.asc("id")], pool).select("qid", "src", "id", "score", "rank")


def entity_anchors(
    entities: DataFrame, queries: DataFrame | pa.Table, least: float = ANCHOR_SIMILARITY, most: int = ANCHORS
) -> DataFrame:
    """``entities`` (canonical, id, vec: entities and their aliases) -> nearest canonicals: (qid, canonical, distance)."""
    near = nearest(entities.select(F.lit("entity").alias("src"), F.col("canonical").alias("id"), "vec"), queries, most, least, once=True)
    by = near.select("qid", F.col("id").alias("canonical"), F.round(1 - F.col("similarity"), 9).alias("distance"))
    return ranked(by, [F.asc("distance"), F.asc("canonical")], most).drop("rank")


def entity_arm(anchors: DataFrame, edges: DataFrame, live: DataFrame, pool: int = POOL, few: bool = False) -> DataFrame:
    """Sources by how many anchors their active mentions reach; ``live`` (src, id): (qid, src, id, score, rank).

    ``few``: the queries are known to be few, and so are their anchors.
    """
    active = edges.filter("active and relation = 'mention'").select("from_id", F.col("to_id").alias("canonical"))
    hits = active.join(F.broadcast(anchors) if few else bounded(persisted(anchors, "anchors")), "canonical").join(live, F.col("from_id") == live.id)
    found = hits.groupBy("qid", "src", "id").agg(F.countDistinct("canonical").alias("score"))
    return ranked(found, [F.desc("score"), F.asc("src"), F.asc("id")], pool)


def fuse(arms: dict[str, DataFrame], limit: int = LIMIT, k: int = K, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Sum of weight / (k + rank) over the arms; arms that are left out don't count: (qid, src, id, rrf_score, rank)."""
    every = None
    for name, arm in arms.items():
        part = arm.select("qid", "src", "id", (F.lit(weights[name]) / (k + F.col("rank"))).alias("part"))
        every = part if every is None else every.unionByName(part)
    summed = every.groupBy("qid", "src", "id").agg(F.round(F.sum("part"), 9).alias("rrf_score"))
    return ranked(summed, [F.desc("rrf_score"), F.asc("src"), F.asc("id")], limit)


def in_session(chunks: DataFrame, session: Column | None = None) -> DataFrame:
    """Chunks (…, session) that recall may see: those of no session and those of the given one."""
    return chunks.filter(F.col("session").isNull() if session is None else F.col("session").isNull() | (F.col("session") == session))


def recall(
    texts: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    entities: DataFrame | None = None,
    edges: DataFrame | None = None,
    limit: int = LIMIT,
    pool: int = POOL,
    use: tuple[str, ...] = ("vector", "keyword", "entity"),
    index: KeywordIndex | DataFrame | None = None,
    k: int = K,
    weights: dict[str, float] = WEIGHTS,
    anchor_similarity: float = ANCHOR_SIMILARITY,
) -> DataFrame:
    """The fused ranking of the arms in ``use``. Rows may come from several sources (beliefs, chunks); see in_session()."""
    held = queries.select("qid", "text", "vec").limit(FEW + 1).toArrow()
    if few := len(held) <= FEW:  # then each arm knows them without a job of its own
        queries = queries.sparkSession.createDataFrame(held, queries.select("qid", "text", "vec").schema)
    points = held if few else queries
    arms = {}
    if "vector" in use:
        arms["vector"] = vector_arm(vectors, points, pool)
    if "keyword" in use:
        arms["keyword"] = keyword_arm(texts, queries, pool, index, few)
    if "entity" in use and entities is not None and edges is not None:
        arms["entity"] = entity_arm(entity_anchors(entities, points, anchor_similarity), edges, texts.select("src", "id"), pool, few)
    return fuse(arms, limit, k, weights)


def with_provenance(hits: DataFrame, texts: DataFrame, snippet: int = 160) -> DataFrame:
    """Text and title joined last, so that no wide column crosses the shuffles before."""
    return hits.join(texts, ["src", "id"]).withColumn("snippet", F.substring("text", 1, snippet)).drop("text")


def recall_on_day(rows: DataFrame, queries: DataFrame, day: str, zone: str, limit: int = LIMIT) -> DataFrame:
    """Beliefs asserted on that calendar day of the zone, by similarity; chunks take no part."""
    on = rows.filter(F.to_date(F.from_utc_timestamp("asserted_at", zone)) == F.lit(day).cast("date"))
    return ranked(nearest(on, queries, limit), [F.desc(F.round("similarity", 9)), F.asc("src"), F.asc("id")], limit)


def dedup_candidates(rows: DataFrame, incoming: DataFrame, most: int = 5, least: float = 0.5) -> DataFrame:
    """``most`` nearest active rows of another hash, and of those the ones similar enough, in this order."""
    other = nearest(rows.withColumn("src", F.lit("")), incoming, most, unlike="content_hash")
    return ranked(other, [F.desc(F.round("similarity", 9)), F.asc("id")], most).filter(F.round("similarity", 9) >= least).select("qid", "id", "similarity", "rank")


def recheck_pairs(
    rows: DataFrame, due: DataFrame, answered: DataFrame, most: int = 20, least: float = 0.5, spare: int = 40
) -> DataFrame:
    """Per due belief the ``most`` nearest of at least ``least``, without itself, its hash, its lineage and answered pairs.

    ``answered`` (a, b) counts in both directions. ``spare`` nearest more are fetched for answered pairs to take; beliefs with
    more answered pairs than that fetch as many more.
    """
    both = persisted(answered.select(F.col("a").alias("qid"), F.col("b").alias("id")).union(answered.select("b", "a")).distinct(), "answered")
    unlike = ("content_hash", "root_id")

    def kept(due: DataFrame, more: int) -> DataFrame:
        near = nearest(rows, due, most + more, least, unlike=unlike, others=True)
        return near.join(both, ["qid", "id"], "left_anti").select("qid", "src", "id", "similarity")

    often = persisted(both.groupBy("qid").agg(F.count("*").alias("n")).filter(F.col("n") > spare), "often")
    found = kept(due.join(often, "qid", "left_anti"), spare)
    longest = often.agg(F.max("n")).first()[0]
    if longest:
        found = found.unionByName(kept(due.join(often, "qid", "left_semi"), longest))
    return ranked(found, [F.desc(F.round("similarity", 9)), F.asc("id")], most)


def evaluate(hits: DataFrame, relevant: DataFrame, cutoffs: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """``hits`` (qid, id, rank) against ``relevant`` (qid, id): mean recall at each cutoff and mean reciprocal rank."""
    truth = relevant.groupBy("qid").agg(F.countDistinct("id").alias("total"))
    found = hits.join(relevant.distinct(), ["qid", "id"]).groupBy("qid").agg(
        F.min("rank").alias("first"), *(F.sum((F.col("rank") <= c).cast("int")).alias(f"at_{c}") for c in cutoffs)
    )
    joined = truth.join(found, "qid", "left")
    share = lambda c: F.round(F.avg(F.coalesce(F.col(f"at_{c}"), F.lit(0)) / F.col("total")), 6)
    return joined.agg(
        F.count("*").alias("queries"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        *(share(c).alias(f"recall_at_{c}") for c in cutoffs),
    )


def quotes_in(sources: DataFrame, quotes: DataFrame, least: int = 15) -> DataFrame:
    """``sources`` (id, text) and ``quotes`` (qid, quote) of at least ``least`` characters -> (qid, id) where the quote stands.

    White space and case don't count. A quote's inner words stand whole in a source, so its longest one proposes the sources
    and only those are compared; quotes of fewer than three words, which have none, are compared with every source.
    """
    canon = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    words = F.split("quote", " ")
    inner = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.struct(F.length(w), w.alias("w")))
    asked = quotes.select("qid", canon(F.col("quote")).alias("quote")).filter(F.length("quote") >= least)
    asked = persisted(asked.withColumn("seed", F.array_max(inner)["w"]), "quotes")
    flat = persisted(sources.select("id", canon(F.col("text")).alias("flat")), "sources")
    seeded, short = bounded(asked.filter("seed is not null")), asked.filter("seed is null").drop("seed")
    found = flat.withColumn("seed", F.explode(F.array_distinct(F.split("flat", " ")))).join(seeded, "seed").filter(F.contains(F.col("flat"), F.col("quote")))
    found = found.select("qid", "id")
    if not short.isEmpty():
        found = found.unionByName(flat.join(bounded(short), F.contains(F.col("flat"), F.col("quote"))).select("qid", "id"))
    return found


def session_search(messages: DataFrame, phrase: str, limit: int = 20, snippet: int = 160) -> DataFrame:
    """Best message of each session that holds the phrase, latest first among equals."""
    hits = messages.filter(F.contains(F.lower("text"), F.lit(phrase.lower())))
    best = hits.groupBy("session").agg(F.max_by(F.struct("line", "text"), "line").alias("best"))
    out = best.select("session", F.col("best.line").alias("line"), F.lit(2.0).alias("score"), F.substring("best.text", 1, snippet).alias("snippet"))
    return out.orderBy(F.desc("score"), "session").limit(limit)


def budget_block(hits: DataFrame, each: int, total: int) -> DataFrame:
    """Hits in rank order while their characters (at most ``each`` a hit) fit; the first is always kept."""
    size = F.least(F.length("text"), F.lit(each))
    used = F.sum(size).over(Window.partitionBy("qid").orderBy("rank"))
    return hits.withColumn("used", used).filter((F.col("used") <= total) | (F.col("rank") == 1)).drop("text")
