"""Reconcile runs: what a run finds, shows and does, kept in a ledger; one applying run at a time; and the contradictions that wait for an answer.

A run's actions are one part of the ledger, so a run that is begun again ends with the actions it had. An applying run holds a lease;
one whose holder died lapses after ``STALE_SECONDS``, and the run that takes it over marks the dead one as aborted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.vectors import cosine
from tarn.operators import beliefs as B
from tarn.operators import reconcile as C
from tarn.sources.ledger import Ledger

STALE_SECONDS = 30 * 60
#: The classes whose findings have a cap of their own, and how a conflict names its lineage.
LINEAGE = "reconcile:lineage:"
ACTIONS = "run string, kind string, class string, subject string, reason string, integrity boolean, surfaced boolean, applied boolean, staled_at timestamp, others array<long>, key string"
RUN = "run string, mode string, status string, scanned long, retired long, questions long, conflicts long, held_retire long, held_question long, held_conflict long"


class RunGoing(Exception):
    """Another applying run is live."""


def effective_caps(runs: DataFrame) -> dict[str, int]:
    """Each kind's cap after the silence so far: ``runs`` (started_at, acted: whether anybody answered), newest first."""
    one = runs.withColumn("all", F.lit(1))
    streak = C.silent_streak(one, "all", [F.desc("started_at")], F.col("acted")).first()
    n = F.lit(streak["streak"] if streak else 0)
    kinds = runs.sparkSession.createDataFrame(list(C.CAPS.items()), "kind string, cap int")
    return {r["kind"]: r["cap"] for r in kinds.select("kind", C.effective_cap(F.col("cap"), n, F.lit(False)).alias("cap")).collect()}


def retirable(beliefs: DataFrame, edges: DataFrame, blocked: DataFrame) -> DataFrame:
    """Beliefs to retire, a leak before a duplicate, none that a pending conflict decides: (kind, class, subject, reason, integrity, pass)."""
    shape = lambda df, place, cls, why, integrity: df.select(
        F.lit("retire").alias("kind"), F.lit(cls).alias("class"), F.col("id").alias("subject"), why.alias("reason"), F.lit(integrity).alias("integrity"), F.lit(place).alias("pass")
    )
    rows = shape(B.replaces_leaks(beliefs, edges), 1, "replaces_leak", F.lit("replaced but still current"), True)
    rows = rows.unionByName(shape(B.exact_duplicates(beliefs), 2, "duplicate_content", F.concat(F.lit("same text as "), F.col("keeper")), False))
    first = F.row_number().over(Window.partitionBy("subject").orderBy("pass"))
    return rows.join(blocked, "subject", "left_anti").withColumn("n", first).filter("n = 1").drop("n")


def questions(beliefs: DataFrame, edges: DataFrame) -> DataFrame:
    """What is only asked about: beliefs that went stale without a trail."""
    return B.stale_without_edge(beliefs, edges).select(
        F.lit("question").alias("kind"), F.lit("stale_without_edge").alias("class"), F.col("id").alias("subject"), F.lit("retired, but nothing replaced it").alias("reason"),
        F.lit(True).alias("integrity"), F.lit(3).alias("pass"),
    )


def entity_questions(aliases: DataFrame, entities: DataFrame, merges: DataFrame, key: Column) -> DataFrame:
    """What broke in the folding of entities, by alias or merge; none is repaired by a guess."""
    orphans = C.alias_orphans(aliases, entities).select("id", F.lit("entity_alias_orphan").alias("class"), F.when(F.col("chained"), "its entity was folded itself").otherwise("its entity is gone").alias("reason"), F.lit(4).alias("pass"))
    shadows = C.alias_shadow_classes(aliases, entities, key).select("id", F.lit("entity_alias_shadow").alias("class"), F.lit("folded, but still an entity").alias("reason"), F.lit(5).alias("pass"))
    broken = C.unfinished_merges(merges, entities).select("id", F.lit("entity_merge_incomplete").alias("class"), F.lit("its source was never absorbed").alias("reason"), F.lit(6).alias("pass"))
    every = orphans.unionByName(shadows.distinct()).unionByName(broken)
    return every.select(F.lit("question").alias("kind"), "class", F.col("id").alias("subject"), "reason", F.lit(True).alias("integrity"), "pass")


def lineages(beliefs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Lineages with several heads that were never raised: (root_id, heads, subject: the newest, others)."""
    ids = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("version", "asserted_at", "id")))), lambda s: s["id"])
    found = beliefs.filter("status = 'active'").groupBy("root_id").agg(F.count("*").alias("heads"), ids.alias("ids")).filter("heads > 1")
    raised = C.raised_lineages(decisions, LINEAGE).select(F.col("root").cast("long").alias("root_id"))
    return found.join(raised, "root_id", "left_anti").select("root_id", "heads", F.get("ids", F.lit(0)).alias("subject"), F.slice("ids", 2, F.size("ids")).alias("others"))


def reconcile(
    run: str, beliefs: DataFrame, edges: DataFrame, decisions: DataFrame, past: DataFrame, ledger: Ledger, rows: Ledger, now: Column, clock: float, apply: bool = False, more: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the run's row, beliefs after, conflicts that it raised: incoming, candidates, key).

    ``decisions`` (incoming, candidates, key, resolved_at); ``past`` as for effective_caps(); ``ledger`` (of ACTIONS) and ``rows`` (of RUN)
    keep the run; ``clock``: the same time as ``now``, in seconds; ``more``: further findings, as those of entity_questions(). A dry run
    changes nothing and reports lineages as questions.
    """
    spark = beliefs.sparkSession
    if apply:
        holder = ledger.holder("reconcile")
        if not ledger.lease("reconcile", run, clock, STALE_SECONDS):
            raise RunGoing(f"run {holder} is going")
        if holder and holder != run and not rows.has(holder):  # it never ended, and its lease lapsed
            rows.put(holder, spark.createDataFrame([(holder, "apply", "aborted", *[None] * 7)], RUN))
    caps = effective_caps(past)
    blocked = C.blocklist(decisions)
    found = retirable(beliefs, edges, blocked).unionByName(questions(beliefs, edges))
    found = found.unionByName(more) if more is not None else found
    table = spark.createDataFrame([(k, i, C.INTEGRITY_CAP if i else caps[k]) for k in ("retire", "question") for i in (False, True)], "kind string, integrity boolean, cap int")
    shown = C.capped(found, table, spark.createDataFrame([], "subject long")).withColumn("others", F.lit(None).cast("array<long>")).withColumn("key", F.lit(None).cast("string"))
    pending = decisions.filter("resolved_at is null").count()
    raised = lineages(beliefs, decisions)
    take = C.open_places(F.lit(pending), F.lit(caps["conflict"]))
    first = raised.orderBy(F.desc("heads"), "root_id").limit(C.QUEUE_CEILING).withColumn("place", F.row_number().over(Window.orderBy(F.desc("heads"), "root_id")))  # at most a queue
    asked = first.filter(F.col("place") <= take).select(
        F.lit("conflict" if apply else "question").alias("kind"), F.lit("multi_head").alias("class"), "subject", F.concat(F.col("heads"), F.lit(" versions are current")).alias("reason"),
        F.lit(False).alias("integrity"), F.lit(True).alias("surfaced"), "others", F.concat(F.lit(LINEAGE), F.col("root_id")).alias("key"),
    )
    every = shown.drop("pass").unionByName(asked)
    applied = F.lit(apply) & F.col("surfaced") & F.col("kind").isin("retire", "conflict")
    staled = F.when(applied & (F.col("kind") == "retire"), now)
    acts = every.select(
        F.lit(run).alias("run"), "kind", "class", F.col("subject").cast("string").alias("subject"), "reason", "integrity", "surfaced", applied.alias("applied"), staled.alias("staled_at"), "others", "key"
    )
    acts = ledger.put(f"{run}-actions", acts)
    after, _ = C.apply_run(beliefs, acts.withColumn("subject", F.col("subject").cast("long")).withColumn("surfaced", F.col("applied")), now)
    conflicts = acts.filter("kind = 'conflict'").select(F.col("subject").cast("long").alias("incoming"), F.col("others").alias("candidates"), "key")
    n = lambda c: F.count_if(c)
    kind = lambda k: (F.col("kind") == k) & (F.col("class") != "multi_head")
    counted = acts.agg(
        n(kind("retire") & F.col("applied")).alias("retired"), n(kind("question")).alias("questions"), n(F.col("kind") == "conflict").alias("conflicts"),
        n(kind("retire") & ~F.col("surfaced")).alias("held_retire"), n(kind("question") & ~F.col("surfaced")).alias("held_question"), n(F.col("class") == "multi_head").alias("taken"),
    )
    scanned, heads = beliefs.filter("status = 'active'").count(), raised.count()
    row = counted.select(
        F.lit(run).alias("run"), F.lit("apply" if apply else "dry_run").alias("mode"), F.lit("success").alias("status"), F.lit(scanned).cast("long").alias("scanned"), "retired", "questions", "conflicts",
        "held_retire", "held_question", (F.lit(heads) - F.col("taken")).alias("held_conflict"),
    )
    row = rows.put(run, row)
    if apply:
        ledger.release("reconcile", run)
    return row, after, conflicts


def possible_contradictions(found: DataFrame, answers: DataFrame, beliefs: DataFrame, most: int = 50) -> DataFrame:
    """Findings without an answer whose both sides still stand, newest first: (found, id, candidate, …, similarity, place).

    ``found`` (found: its number, run, id, candidate, reason, new_quote, old_quote, found_at); ``answers`` (found, seq, decision).
    """
    open_ = found.join(answers.select("found").distinct(), "found", "left_anti")
    for side in ("id", "candidate"):
        live = beliefs.filter("status = 'active'").select(F.col("id").alias(side), F.col("content").alias(f"{side}_content"), F.col("vec").alias(f"{side}_vec"))
        open_ = open_.join(live, side)
    near = open_.withColumn("similarity", cosine(F.col("id_vec"), F.col("candidate_vec"))).drop("id_vec", "candidate_vec")
    first = near.orderBy(F.desc("found_at"), "found").limit(most)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("found_at"), "found")))  # at most ``most`` rows


def answered(found: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What answers do: (conflicts of approved ones: incoming, candidates, reason; pairs that are settled: a, b, decision; refused: found, seq).

    The first answer to a finding counts; later ones, and answers to what was never found, are refused.
    """
    nth = F.row_number().over(Window.partitionBy("found").orderBy("seq"))
    rows = answers.withColumn("nth", nth).join(found.select("found", "id", "candidate", "reason"), "found", "left")
    good = rows.filter((F.col("nth") == 1) & F.col("id").isNotNull() & F.col("decision").isin("approved", "rejected"))
    conflicts = good.filter("decision = 'approved'").select(F.col("id").alias("incoming"), F.array("candidate").alias("candidates"), "reason")
    pairs = good.select(F.col("id").alias("a"), F.col("candidate").alias("b"), "decision")
    return conflicts, pairs, rows.join(good.select("found", "seq"), ["found", "seq"], "left_anti").select("found", "seq")
