"""The queue of conflicts: what is undecided and how close its sides are, what was decided, and merging into a new belief.

Decisions are (id, incoming, candidates, resolution: null, supersede, keep_both or merge, winner, decided_by, created_at,
resolved_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.vectors import cosine


def pending(decisions: DataFrame, beliefs: DataFrame) -> DataFrame:
    """Undecided conflicts, a row a candidate, newest first: (id, incoming, candidate, place, similarity).

    Similarity comes from the stored vectors, null where a side has none.
    """
    rows = decisions.filter("resolution is null").select("id", "incoming", "created_at", F.posexplode("candidates").alias("place", "candidate"))
    for side in ("incoming", "candidate"):
        rows = rows.join(beliefs.select(F.col("id").alias(side), F.col("vec").alias(f"{side}_vec")), side, "left")
    near = rows.withColumn("similarity", cosine(F.col("incoming_vec"), F.col("candidate_vec")))
    return near.orderBy(F.desc("created_at"), "id", "place").select("id", "incoming", "candidate", "place", "similarity")


def settled(decisions: DataFrame) -> DataFrame:
    """Decided conflicts, latest first: (id, outcome, decided_by). A superseding decision is told by the winner's side."""
    side = F.when(F.col("winner").eqNullSafe(F.col("incoming")), "keep_new").otherwise("keep_existing")
    outcome = F.when(F.col("resolution") == "supersede", side).otherwise(F.col("resolution"))
    rows = decisions.filter("resolution is not null").orderBy(F.desc("resolved_at"), "id")
    return rows.select("id", outcome.alias("outcome"), F.coalesce("decided_by", F.lit("human")).alias("decided_by"))


def unqueued(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pairs (a, b) that no conflict, decided or not, has as incoming and candidate, either way round."""
    owned = decisions.select("incoming", F.explode("candidates").alias("candidate"))
    owned = owned.select(F.least("incoming", "candidate").alias("_low"), F.greatest("incoming", "candidate").alias("_high"))
    rows = pairs.withColumn("_low", F.least("a", "b")).withColumn("_high", F.greatest("a", "b"))
    return rows.join(owned, ["_low", "_high"], "left_anti").drop("_low", "_high")


def merge_conflicts(decided: DataFrame, beliefs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """``decided`` (id, incoming, candidates, made, content): (beliefs after, new replaces edges).

    The new belief ``made`` follows the head of the first candidate's lineage and replaces all sides, which go stale.
    Of several merges into one lineage, each counts on from the head in the order of ``made``.
    """
    heads = beliefs.groupBy("root_id").agg(F.max("version").alias("head"))
    primary = beliefs.select(F.col("id").alias("primary"), "root_id").join(heads, "root_id")
    rows = decided.withColumn("primary", F.coalesce(F.try_element_at("candidates", F.lit(1)), "incoming")).join(primary, "primary", "left")
    nth = F.row_number().over(Window.partitionBy("root_id").orderBy("made"))
    rows = rows.withColumn("root_id", F.coalesce("root_id", "made")).withColumn("version", (F.coalesce("head", F.lit(0)) + nth).cast("int"))
    new = rows.select(
        F.col("made").alias("id"), "content", F.sha2("content", 256).alias("content_hash"), F.lit("active").alias("status"), "root_id", "version",
        now.alias("asserted_at"), F.lit(None).cast("timestamp").alias("stale_since"),
    )
    edges = rows.select(F.col("made").alias("from_id"), F.explode(F.array_union(F.array("incoming"), "candidates")).alias("to_id"))
    gone = edges.select(F.col("to_id").alias("id"), F.lit(True).alias("gone")).distinct()
    stops = F.col("gone") & (F.col("status") == "active")
    after = beliefs.join(gone, "id", "left").withColumn("stale_since", F.when(stops, now).otherwise(F.col("stale_since")))
    after = after.withColumn("status", F.when(stops, "stale").otherwise(F.col("status"))).drop("gone")
    return after.unionByName(new), edges.withColumn("relation", F.lit("replaces")).withColumn("active", F.lit(True))


def revert_merges(decided: DataFrame, beliefs: DataFrame, edges: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Merges of the time ``at`` taken back: sides are active again, the new belief is stale, what it replaced is not."""
    made = decided.select(F.col("made").alias("id"), F.lit(True).alias("is_made")).distinct()
    sides = decided.select(F.explode(F.array_union(F.array("incoming"), "candidates")).alias("id"), F.lit(True).alias("is_side")).distinct()
    rows = beliefs.join(made, "id", "left").join(sides, "id", "left")
    back = F.col("is_side") & (F.col("stale_since") == at)
    stops = F.col("is_made") & (F.col("status") == "active")
    status = F.when(back, "active").when(stops, "stale").otherwise(F.col("status"))
    since = F.when(back, F.lit(None).cast("timestamp")).when(stops, at).otherwise(F.col("stale_since"))
    rows = rows.withColumn("_since", since).withColumn("status", status).withColumn("stale_since", F.col("_since")).drop("_since", "is_made", "is_side")
    left = edges.join(made.withColumnRenamed("id", "from_id"), "from_id", "left")
    left = left.withColumn("active", F.col("active") & ~(F.coalesce("is_made", F.lit(False)) & (F.col("relation") == "replaces")))
    return rows, left.drop("is_made")
