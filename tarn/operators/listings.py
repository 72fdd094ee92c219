"""Lookups, scopes and listings over beliefs, chunks, documents and entities, and checks before an entity changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.text import name_key


def passages(ids: DataFrame, beliefs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Content of each id, be it a belief's or a chunk's (a belief's first): (id, content), null where there is none."""
    both = beliefs.select("id", "content", F.lit(0).alias("_arm")).unionByName(chunks.select("id", "content", F.lit(1).alias("_arm")))
    found = both.join(ids.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min_by("content", F.struct("_arm", "content")).alias("content"))
    return ids.select("id").distinct().join(found, "id", "left")


def in_session(session_id: Column, session: Column) -> Column:
    """Rows of no session or of this one; without a session, rows of none."""
    return session_id.isNull() | F.coalesce(session_id == session, F.lit(False))


def asks(prompt: Column) -> Column:
    """Whether a prompt is to be recalled for: not empty, a command or a shell line."""
    bare = F.regexp_replace(F.coalesce(prompt, F.lit("")), r"^\s+", "")
    return (bare != "") & ~F.startswith(bare, F.lit("/")) & ~F.startswith(bare, F.lit("!"))


def list_documents(documents: DataFrame, needle: str, most: int = 50) -> DataFrame:
    """Documents (title, path, …) with the needle in title or path in any case, at most ``most``, and a row of how many ``more``."""
    key = needle.strip().lower()
    matched = documents.filter(F.lower("title").contains(key) | F.lower("path").contains(key)) if key else documents
    shown = matched.orderBy("title", "path").limit(most).select("title", "path", F.lit(None).cast("long").alias("more"))
    rest = matched.agg((F.count("*") - most).alias("more")).filter("more > 0")
    return shown.unionByName(rest.select(F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("path"), "more"))


def mean_length(beliefs: DataFrame) -> DataFrame:
    """Rounded mean of the active beliefs' lengths, 0 without any: (chars)."""
    mean = F.floor(F.coalesce(F.avg(F.length("content")), F.lit(0.0)) + 0.5)
    return beliefs.filter("status = 'active'").agg(mean.cast("long").alias("chars"))


def entity_merges(merges: DataFrame, entities: DataFrame) -> DataFrame:
    """All merges, newest first, with their canonical's present name: (id, canonical_id, canonical_name, source_name, live)."""
    named = merges.join(entities.select(F.col("id").alias("canonical_id"), F.col("name").alias("canonical_name")), "canonical_id", "left")
    return named.orderBy(F.desc("created_at"), "id").select(
        "id", "canonical_id", F.coalesce("canonical_name", F.lit("(removed)")).alias("canonical_name"), "source_name", F.col("reverted_at").isNull().alias("live")
    )


def settled_pairs(decisions: DataFrame, entities: DataFrame, most: int = 50) -> DataFrame:
    """The latest pairs that were found distinct: (id, incoming_name, candidate_name, decided_by)."""
    latest = decisions.filter("resolution = 'keep_both'").orderBy(F.desc("resolved_at"), "id").limit(most)
    latest = latest.withColumn("candidate", F.get("candidates", F.lit(0)))
    for side in ("incoming", "candidate"):
        latest = latest.join(entities.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name")), side, "left")
    gone = F.lit("(gone)")
    return latest.select(
        "id", F.coalesce("incoming_name", gone).alias("incoming_name"), F.coalesce("candidate_name", gone).alias("candidate_name"),
        F.coalesce("decided_by", F.lit("human")).alias("decided_by"),
    )


def document_chunks(documents: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks of the documents with the entities that each mentions: (document, place, id, entity), entity null without any."""
    own = chunks.join(documents.select("document").distinct(), "document", "left_semi")
    mentions = edges.filter("active and relation = 'mention'").select(F.col("from_id").alias("id"), F.col("to_id").alias("entity"))
    return own.join(mentions, "id", "left").select("document", "place", "id", "entity")


def wiped_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges that stay when the index is built anew: no mentions, none with an entity at an end."""
    left = edges.filter("relation <> 'mention'")
    for end in ("from_id", "to_id"):
        left = left.join(entities.select(F.col("id").alias(end)), end, "left_anti")
    return left


def to_index_anew(beliefs: DataFrame, chunks: DataFrame) -> DataFrame:
    """What an index built anew reads: active beliefs, and chunks of no session: (src, id)."""
    rows = beliefs.filter("status = 'active'").select(F.lit("memory").alias("src"), "id")
    return rows.unionByName(chunks.filter("session_id is null").select(F.lit("chunk").alias("src"), "id"))


def rename_verdicts(patches: DataFrame, entities: DataFrame, aliases: DataFrame, types: DataFrame) -> DataFrame:
    """``patches`` (id, name, entity_type; null: as it is) -> (id, verdict: ok, unknown, type, empty, taken or alias).

    A name is taken by another entity's own name; an alias of another entity takes it too. Checked in that order.
    """
    key = name_key(F.col("name"))
    own = entities.groupBy(key.alias("key")).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    folded = aliases.groupBy(F.col("name_key").alias("key")).agg(F.min("canonical_id").alias("alias_low"), F.max("canonical_id").alias("alias_high"))
    there = entities.select("id", F.lit(True).alias("there")).distinct()
    allowed = types.select(F.col("type").alias("entity_type"), F.lit(True).alias("allowed")).distinct()
    rows = patches.withColumn("key", key).join(there, "id", "left").join(allowed, "entity_type", "left")
    rows = rows.join(own, "key", "left").join(folded, "key", "left")
    verdict = (
        F.when(F.col("there").isNull(), "unknown")
        .when(F.col("entity_type").isNotNull() & F.col("allowed").isNull(), "type")
        .when(F.col("name").isNotNull() & (F.trim("name") == ""), "empty")
        .when((F.col("low") != F.col("id")) | (F.col("high") != F.col("id")), "taken")
        .when((F.col("alias_low") != F.col("id")) | (F.col("alias_high") != F.col("id")), "alias")
        .otherwise("ok")
    )
    return rows.select("id", verdict.alias("verdict"))


def delete_verdicts(ids: DataFrame, entities: DataFrame, merges: DataFrame) -> DataFrame:
    """(id, verdict, folds): ``folded`` while a merge into the entity is in force, which a deletion would make final."""
    live = merges.filter("reverted_at is null").groupBy(F.col("canonical_id").alias("id")).agg(F.count("*").alias("folds"))
    there = entities.select("id", F.lit(True).alias("there")).distinct()
    rows = ids.select("id").join(live, "id", "left").join(there, "id", "left")
    verdict = F.when(F.col("folds").isNotNull(), "folded").when(F.col("there").isNull(), "unknown").otherwise("ok")
    return rows.select("id", verdict.alias("verdict"), F.coalesce("folds", F.lit(0)).alias("folds"))


def to_refetch(listed: DataFrame, cached: DataFrame) -> DataFrame:
    """Items (id, edited) whose latest edit is not in the cache."""
    newest = listed.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("edited")))).filter("_n = 1").drop("_n")
    return newest.join(cached.select("id", "edited"), ["id", "edited"], "left_anti")


def stable(files: DataFrame, now: Column, settle: float = 2.0) -> DataFrame:
    """Files (…, modified) that have been left alone for ``settle`` seconds."""
    return files.filter(F.unix_micros(now) - F.unix_micros("modified") >= F.lit(int(settle * 1e6)))
