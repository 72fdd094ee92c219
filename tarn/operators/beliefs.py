"""Belief store: exact and near duplicates, version lineages, conflicts and their resolutions, all as new rows or flags.

Beliefs are (id, content, content_hash, status, root_id, version, asserted_at, stale_since), edges (from_id, to_id, relation,
active). Nothing is destroyed: rows go stale, edges inactive, and each decision's row says how to take it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import json_array


def exact_duplicates(beliefs: DataFrame) -> DataFrame:
    """Active beliefs whose hash an older active one has: (id, keeper)."""
    order = Window.partitionBy("content_hash").orderBy("asserted_at", "id")
    active = beliefs.filter("status = 'active' and content_hash is not null")
    return active.withColumn("keeper", F.first("id").over(order)).filter("id <> keeper").select("id", "keeper")


def save_outcomes(incoming: DataFrame, beliefs: DataFrame, candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What saving a batch does: merged, added, versioned or conflict.

    ``candidates`` (id, candidate) and ``verdicts`` (id, candidate, label: identical, contradictory, else complementary).
    A batch is consistent with the store as it was; within it the first of equal hashes stands.
    """
    first = Window.partitionBy("content_hash").orderBy("id")
    rows = incoming.withColumn("twin", F.first("id").over(first))
    known = beliefs.filter("status = 'active'").select("content_hash").distinct().withColumn("known", F.lit(True))
    judged = candidates.join(verdicts, ["id", "candidate"], "left").groupBy("id").agg(
        F.min(F.when(F.col("label") == "identical", F.col("candidate"))).alias("parent"),
        F.sort_array(F.collect_set(F.when(F.col("label") == "contradictory", F.col("candidate")))).alias("against"),
    )
    joined = rows.join(known, "content_hash", "left").join(judged, "id", "left")
    outcome = (
        F.when(F.col("known") | (F.col("twin") != F.col("id")), "merged")
        .when(F.size(F.coalesce("against", F.array().cast("array<long>"))) > 0, "conflict")
        .when(F.col("parent").isNotNull(), "versioned")
        .otherwise("added")
    )
    return joined.select("id", outcome.alias("outcome"), "parent", "against")


def parse_verdicts(replies: DataFrame) -> DataFrame:
    """(id, candidates array, reply) -> (id, candidate, label, reason); candidates are numbered from 1 in the reply."""
    shape = "array<struct<candidate:int, relation:string, reason:string>>"
    rows = replies.select("id", "candidates", F.explode(F.from_json(json_array(F.col("reply")), shape)).alias("v"))
    relation = F.lower("v.relation")
    label = F.when(relation.contains("ident"), "identical").when(relation.contains("contra"), "contradictory").otherwise("complementary")
    return rows.select("id", F.get("candidates", F.col("v.candidate") - 1).alias("candidate"), label.alias("label"), F.col("v.reason").alias("reason")).filter("candidate is not null")


def new_versions(beliefs: DataFrame, children: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """``children`` (id, parent, content) as new versions: (beliefs after, new replaces edges child -> parent)."""
    parents = beliefs.select(F.col("id").alias("parent"), "root_id", F.col("version").alias("of"))
    made = children.join(parents, "parent")
    rows = made.select(
        "id", "content", F.sha2("content", 256).alias("content_hash"), F.lit("active").alias("status"), "root_id",
        (F.col("of") + 1).cast("int").alias("version"), now.alias("asserted_at"), F.lit(None).cast("timestamp").alias("stale_since"),
    )
    gone = made.select(F.col("parent").alias("id"), F.lit(True).alias("gone")).distinct()
    after = beliefs.join(gone, "id", "left").withColumn("stale_since", F.when(F.col("gone") & (F.col("status") == "active"), now).otherwise(F.col("stale_since")))
    after = after.withColumn("status", F.when(F.col("gone"), "stale").otherwise(F.col("status"))).drop("gone")
    edges = made.select(F.col("id").alias("from_id"), F.col("parent").alias("to_id"), F.lit("replaces").alias("relation"), F.lit(True).alias("active"))
    return after.unionByName(rows), edges


def history(beliefs: DataFrame, ids: DataFrame) -> DataFrame:
    """All versions of the lineages that hold the ids, newest first: (asked, id, version, status, place)."""
    roots = ids.select(F.col("id").alias("asked")).join(beliefs.select(F.col("id").alias("asked"), "root_id"), "asked")
    rows = roots.join(beliefs.select("root_id", "id", "version", "status"), "root_id")
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("version"), F.desc("id")))
    return rows.withColumn("place", place).select("asked", "id", "version", "status", "place")


def without_lineages(beliefs: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Beliefs and edges after deleting the whole lineages of the ids."""
    roots = beliefs.join(ids, "id", "left_semi").select("root_id").distinct()
    gone = beliefs.join(roots, "root_id", "left_semi").select("id")
    left = edges.join(gone, edges.from_id == gone.id, "left_anti")
    return beliefs.join(roots, "root_id", "left_anti"), left.join(gone, left.to_id == gone.id, "left_anti")


def resolve_conflicts(conflicts: DataFrame, beliefs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decided conflicts (id, incoming, candidates, action, winner) -> (beliefs after, new edges, decisions with prior lineage).

    keep_new: the candidates go stale, the incoming one becomes the version after the head of the first candidate's
    lineage. keep_existing: the incoming one goes stale. keep_both: a ``distinct`` edge to each candidate.
    """
    heads = beliefs.groupBy("root_id").agg(F.max("version").alias("head"))
    known = beliefs.select("id", "root_id", "version")
    first = conflicts.withColumn("primary", F.coalesce("winner", F.element_at("candidates", 1)))
    first = first.join(known.select(F.col("id").alias("primary"), F.col("root_id").alias("to_root")), "primary", "left")
    first = first.join(heads.withColumnRenamed("root_id", "to_root"), "to_root", "left")
    first = first.join(known.select(F.col("id").alias("incoming"), F.col("root_id").alias("prior_root_id"), F.col("version").alias("prior_version")), "incoming", "left")
    stale = first.filter("action = 'keep_new'").select(F.explode("candidates").alias("id")).union(
        first.filter("action = 'keep_existing'").select("incoming")
    )
    moved = first.filter("action = 'keep_new'").select(F.col("incoming").alias("id"), "to_root", "head")
    after = beliefs.join(stale.distinct().withColumn("gone", F.lit(True)), "id", "left").join(moved, "id", "left")
    stops = F.col("gone") & (F.col("status") == "active")
    after = after.select(
        "id", "content", "content_hash", F.when(stops, "stale").otherwise(F.col("status")).alias("status"),
        F.coalesce("to_root", "root_id").alias("root_id"),
        F.coalesce(F.col("head") + 1, F.col("version")).cast("int").alias("version"), "asserted_at",
        F.when(stops, now).otherwise(F.col("stale_since")).alias("stale_since"),
    )
    relation = F.when(F.col("action") == "keep_new", "replaces").when(F.col("action") == "keep_both", "distinct")
    edges = first.withColumn("relation", relation).filter("relation is not null")
    edges = edges.select(F.col("incoming").alias("from_id"), F.explode("candidates").alias("to_id"), "relation", F.lit(True).alias("active"))
    decisions = first.select("id", "incoming", "candidates", "action", "prior_root_id", "prior_version", now.alias("resolved_at"))
    return after, edges, decisions


def revert_conflicts(decisions: DataFrame, beliefs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Beliefs and edges as before the decisions; a row that went stale at another time is left alone."""
    stale = decisions.filter("action = 'keep_new'").select(F.explode("candidates").alias("id"), "resolved_at").union(
        decisions.filter("action = 'keep_existing'").select("incoming", "resolved_at")
    )
    moved = decisions.filter("action = 'keep_new'").select(F.col("incoming").alias("id"), "prior_root_id", "prior_version")
    back = beliefs.join(stale.distinct(), "id", "left").join(moved, "id", "left")
    ours = F.col("resolved_at").isNotNull() & (F.col("stale_since") == F.col("resolved_at"))
    rows = back.select(
        "id", "content", "content_hash", F.when(ours, "active").otherwise(F.col("status")).alias("status"),
        F.coalesce("prior_root_id", "root_id").alias("root_id"), F.coalesce("prior_version", "version").alias("version"), "asserted_at",
        F.when(ours, F.lit(None).cast("timestamp")).otherwise(F.col("stale_since")).alias("stale_since"),
    )
    made = decisions.select(F.col("incoming").alias("from_id"), F.explode("candidates").alias("to_id")).distinct()
    kept = edges.join(made.withColumn("made", F.lit(True)), ["from_id", "to_id"], "left")
    return rows, kept.filter("made is null or relation not in ('replaces', 'distinct')").drop("made")


def replaces_leaks(beliefs: DataFrame, edges: DataFrame) -> DataFrame:
    """Active beliefs that an active one replaces: (id)."""
    replaced = edges.filter("active and relation = 'replaces'").select("from_id", "to_id")
    active = beliefs.filter("status = 'active'").select("id")
    held = replaced.join(active, replaced.from_id == active.id, "left_semi")
    return active.join(held, active.id == held.to_id, "left_semi").distinct()


def stale_without_edge(beliefs: DataFrame, edges: DataFrame) -> DataFrame:
    """Stale beliefs that nothing replaces: (id)."""
    replaced = edges.filter("active and relation = 'replaces'").select(F.col("to_id").alias("id"))
    return beliefs.filter("status = 'stale'").select("id").join(replaced, "id", "left_anti")


def multi_head(beliefs: DataFrame) -> DataFrame:
    """Lineages with several active versions: (root_id, heads, ids in order)."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("version", "id"))), lambda s: s["id"].cast("string")), ",")
    return beliefs.filter("status = 'active'").groupBy("root_id").agg(F.count("*").alias("heads"), ids.alias("ids")).filter("heads > 1")


def due(beliefs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Active beliefs not checked for so many days, never checked ones first."""
    quiet = F.col("last_rechecked_at").isNull() | (F.col("last_rechecked_at") < now - F.make_interval(days=F.lit(days)))
    return beliefs.filter((F.col("status") == "active") & quiet).orderBy(F.asc_nulls_first("last_rechecked_at"), "id")
