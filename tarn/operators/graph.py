"""Entity graph: rollups, listings, related entities, the vocabulary, and validation of extracted entities.

Edges are (from_id: belief or chunk, to_id: entity, relation, active, confidence); entities (id, name, entity_type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.checkpoints import bounded, persisted
from tarn.functions.text import name_key, plausible_name, schema_name

CONFIDENT = 0.7
MOST_EXTRACTED = 5


def entity_list(entities: DataFrame, edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Mentions, distinct sources and distinct documents per entity; ``documents`` (from_id, document)."""
    active = edges.filter("active and relation = 'mention'")
    counted = active.join(documents, "from_id", "left").groupBy("to_id").agg(
        F.count("*").alias("mentions"), F.countDistinct("from_id").alias("sources"), F.countDistinct("document").alias("documents")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return entities.join(counted, entities.id == counted.to_id, "left").select("id", "name", "entity_type", zero("mentions"), zero("sources"), zero("documents"))


def known_entities(entities: DataFrame, edges: DataFrame, most: int = 75) -> DataFrame:
    """The ``most`` entities of the most mentions, for prompts; ones without a mention come last."""
    counted = edges.filter("active and relation = 'mention'").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("mentions"))
    rows = entities.join(counted, "id", "left").select("id", "name", F.coalesce("mentions", F.lit(0)).alias("mentions"))
    return rows.orderBy(F.desc("mentions"), "id").limit(most)


def document_rollup(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges document -> entity with the number of mentions as weight."""
    mentions = edges.filter("active and relation = 'mention'")
    return mentions.join(documents, "from_id").groupBy("document", "to_id").agg(F.count("*").alias("weight"))


def graph_edges(edges: DataFrame, documents: DataFrame, typed: DataFrame) -> DataFrame:
    """All edges of the drawn graph: belief edges, typed entity edges, and the document rollup."""
    own = edges.filter("active").join(documents, "from_id", "left_anti")
    shape = lambda df, src, dst, rel, w: df.select(
        src.cast("string").alias("from_id"), dst.cast("string").alias("to_id"), rel.alias("relation"), w.cast("long").alias("weight")
    )
    rolled = document_rollup(edges, documents)
    return (
        shape(own, F.col("from_id"), F.col("to_id"), F.col("relation"), F.lit(None))
        .unionByName(shape(typed.filter("active"), F.col("from_id"), F.col("to_id"), F.col("relation"), F.lit(None)))
        .unionByName(shape(rolled, F.concat(F.lit("document:"), F.col("document")), F.col("to_id"), F.lit("mention"), F.col("weight")))
    )


def parallel_predicates(typed: DataFrame) -> DataFrame:
    """Predicates between an ordered pair as one edge."""
    joined = F.array_join(F.array_sort(F.collect_set("relation")), ", ")
    return typed.filter("active").groupBy("from_id", "to_id").agg(joined.alias("relations"), F.count("*").alias("n"))


#: Mentions from which on a source is heavy: its pairs are never made.
HEAVY = 1000


def related_entities(
    targets: DataFrame, entities: DataFrame, edges: DataFrame, typed: DataFrame, limit: int = 50, entity_type: str | None = None, aliases: DataFrame | None = None, heavy: int = HEAVY
) -> DataFrame:
    """Entities linked with each target by stated links or shared sources, stated ones first: the first ``limit`` of each target.

    (target, other, name, links, outgoing, incoming, confidence, shared, mentions, total, truncated, place, and aliases, in order, if given:
    canonical_id, name). ``entities`` (id, name, entity_type if one is asked for). Sources of more than ``heavy`` mentions don't make pairs.
    Their entities fall into classes, those of the same heavy sources; of a class only the first ``limit`` + 1 others can have a
    place by heavy sources alone, as all of a class share as many of those with a target.
    """
    mentions = edges.filter("active and relation = 'mention'").select("from_id", "to_id").distinct()
    asked = targets.select(F.col("id").alias("target"))
    named = entities.filter(F.col("entity_type") == entity_type) if entity_type else entities
    counts = mentions.groupBy(F.col("to_id").alias("other")).agg(F.count("*").alias("mentions"))
    named = named.select(F.col("id").alias("other"), "name").join(counts, "other", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))
    large = mentions.groupBy("from_id").agg(F.count("*").alias("n")).filter(F.col("n") > heavy).select("from_id")
    if some := not large.isEmpty():
        large = persisted(large, "heavy")
    light = mentions.join(bounded(large), "from_id", "left_anti") if some else mentions
    of = light.join(asked.withColumn("to_id", F.col("target")), "to_id").select("from_id", "target")
    shared = of.join(light, "from_id").filter("to_id <> target").groupBy("target", F.col("to_id").alias("other")).agg(F.count("*").alias("shared"))
    links = typed.filter("active")
    ends = links.select(F.col("from_id").alias("target"), F.col("to_id").alias("other"), "confidence", F.lit(1).alias("outgoing")).union(links.select("to_id", "from_id", "confidence", F.lit(0)))
    stated = ends.join(asked, "target").filter("target <> other").groupBy("target", "other").agg(
        F.count("*").alias("links"), F.sum("outgoing").alias("outgoing"), F.max("confidence").alias("confidence")
    )
    rows = shared.join(stated, ["target", "other"], "full_outer")
    if some:
        rows, more = _with_heavy(rows, asked, named, mentions.join(bounded(large), "from_id", "left_semi"), limit)
    rows = rows.join(named, "other")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = rows.select("target", "other", "name", zero("links"), zero("outgoing"), (zero("links") - zero("outgoing")).alias("incoming"), "confidence", zero("shared"), "mentions", *(["by_heavy"] if some else []))
    order = Window.partitionBy("target").orderBy(F.desc(F.col("links") > 0), F.desc("shared"), F.desc("mentions"), "name", "other")
    whole = Window.partitionBy("target")
    if some:
        rows = rows.withColumn("total", F.count_if(~F.col("by_heavy")).over(whole)).join(more, "target", "left")
        rows = rows.withColumn("total", F.col("total") + F.coalesce("reached", F.lit(0))).drop("reached", "by_heavy")
    else:
        rows = rows.withColumn("total", F.count("*").over(whole))
    rows = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).withColumn("truncated", F.greatest(F.lit(0), F.col("total") - limit))
    if aliases is None:
        return rows
    listed = aliases.groupBy(F.col("canonical_id").alias("other")).agg(F.sort_array(F.collect_list("name")).alias("aliases"))
    return rows.join(listed, "other", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def _with_heavy(rows: DataFrame, asked: DataFrame, named: DataFrame, mentions: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with what heavy sources add: to ``shared``, and as others of their own; and how many others these reach: (target, reached)."""
    of = persisted(mentions.groupBy("to_id").agg(F.sort_array(F.collect_set("from_id")).alias("sources")).select("to_id", F.xxhash64("sources").alias("cls"), "sources"), "classes")
    parts = of.select("cls", "sources").distinct().select("cls", F.explode("sources").alias("source"))
    pairs = persisted(parts.join(parts.withColumnRenamed("cls", "with"), "source").groupBy("cls", "with").agg(F.count("*").alias("heavy")), "class-pairs")
    members = of.select(F.col("to_id").alias("other"), F.col("cls").alias("with")).join(named, "other")
    first = F.row_number().over(Window.partitionBy("with").orderBy(F.desc("mentions"), "name", "other"))
    tops = members.withColumn("n", first).filter(F.col("n") <= limit + 1).select("with", "other")
    own = asked.join(of.select(F.col("to_id").alias("target"), "cls"), "target")
    reach = own.join(pairs, "cls")
    made = reach.join(tops, "with").filter("target <> other").select("target", "other")
    every = rows.join(made, ["target", "other"], "full_outer")
    at = every.join(own, "target", "left").join(of.select(F.col("to_id").alias("other"), F.col("cls").alias("with")), "other", "left").join(pairs, ["cls", "with"], "left")
    out = at.withColumn("shared", F.coalesce("shared", F.lit(0)) + F.coalesce("heavy", F.lit(0))).withColumn("by_heavy", F.col("heavy").isNotNull())
    sizes = members.groupBy("with").agg(F.count("*").alias("n"))
    reached = reach.join(sizes, "with").groupBy("target").agg(F.sum("n").alias("n"))
    itself = named.select(F.col("other").alias("target"), F.lit(1).alias("itself"))
    more = reached.join(itself, "target", "left").select("target", (F.col("n") - F.coalesce("itself", F.lit(0))).alias("reached"))
    return out.drop("cls", "with", "heavy"), more


def vocabulary_usage(vocabulary: DataFrame, used: DataFrame) -> DataFrame:
    """Use counts of every vocabulary entry (kind, name), zero where there is none; ``used`` (kind, name)."""
    counts = used.groupBy("kind", "name").agg(F.count("*").alias("uses"))
    return vocabulary.join(counts, ["kind", "name"], "left").select("kind", "name", F.coalesce("uses", F.lit(0)).alias("uses"))


def proposals(examples: DataFrame, vocabulary: DataFrame, least: int = 2) -> DataFrame:
    """Names proposed at least so often that normalise to something new: (kind, name, occurrences)."""
    named = examples.select("kind", schema_name(F.col("name")).alias("name")).filter("name <> '' and name <> 'mention'")
    return named.join(vocabulary, ["kind", "name"], "left_anti").groupBy("kind", "name").agg(F.count("*").alias("occurrences")).filter(F.col("occurrences") >= least)


def extracted_entities(raw: DataFrame, types: DataFrame) -> DataFrame:
    """``raw`` (source, pos, name, type) -> at most five plausible entities a source of known types, first ones first."""
    kept = raw.select("source", "pos", F.trim("name").alias("name"), F.lower(F.trim("type")).alias("type")).filter((F.col("name") != "") & plausible_name(F.col("name")))
    kept = kept.join(bounded(types.select("type")), "type", "left_semi")
    first = F.row_number().over(Window.partitionBy("source", F.lower("name"), "type").orderBy("pos"))
    kept = kept.withColumn("n", first).filter("n = 1").drop("n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("pos", "name", "type"))).filter(F.col("place") <= MOST_EXTRACTED)


def extracted_links(raw: DataFrame, entities: DataFrame, predicates: DataFrame) -> DataFrame:
    """``raw`` (source, pos, subject, predicate, confidence, object) -> at most five links between kept entities.

    An unknown predicate, or a confidence below 0.7, leaves a mere mention.
    """
    known = entities.select("source", F.lower("name").alias("key")).distinct()
    rows = raw.select(
        "source", "pos", F.lower(F.trim("subject")).alias("subject"), F.lower(F.trim("predicate")).alias("predicate"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence"), F.lit(0.0)))).alias("confidence"), F.lower(F.trim("object")).alias("object"),
    ).filter("subject <> object")
    for end in ("subject", "object"):
        rows = rows.join(known.withColumnRenamed("key", end), ["source", end], "left_semi")
    rows = rows.join(bounded(predicates.select("predicate", F.lit(True).alias("known"))), "predicate", "left")
    sure = F.coalesce("known", F.lit(False)) & (F.col("confidence") >= CONFIDENT)
    rows = rows.withColumn("relation", F.when(sure, F.col("predicate")).otherwise("mention"))
    first = F.row_number().over(Window.partitionBy("source", "subject", "relation", "object").orderBy("pos"))
    rows = rows.withColumn("n", first).filter("n = 1").drop("n", "known")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("pos", "subject", "object"))).filter(F.col("place") <= MOST_EXTRACTED)


def resolve_names(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entity of each name: by its key, else by an alias, else none: (name, entity, how)."""
    own = entities.groupBy(name_key(F.col("name")).alias("key")).agg(F.min("id").alias("by_name"))
    other = aliases.groupBy(name_key(F.col("name")).alias("key")).agg(F.min("canonical_id").alias("by_alias"))
    rows = names.select("name", name_key(F.col("name")).alias("key")).join(own, "key", "left").join(other, "key", "left")
    how = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_alias").isNotNull(), "alias").otherwise("new")
    return rows.select("name", F.coalesce("by_name", "by_alias").alias("entity"), how.alias("how"))


def add_edges_if_absent(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with those of ``new`` that are not there yet, active or not."""
    key = ["from_id", "to_id", "relation"]
    return edges.unionByName(new.dropDuplicates(key).join(edges, key, "left_anti"))


def json_view(rows: DataFrame, group: str, order: Column, fields: list[str]) -> DataFrame:
    """Rows of a group as one JSON array."""
    return rows.groupBy(group).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("_"), F.struct(*fields).alias("v")))), lambda s: s["v"])).alias("rows"))
