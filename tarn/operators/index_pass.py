"""The index pass: entities and links out of every item that was not indexed yet, by an injected function, once an item.

Items are dealt by their place into waves and, within a wave, into lanes; lanes of a wave run at once, the items of a lane one batch
after another. A lane stops after ``BREAKER`` failures in a row, and the pass after a wave with such a lane: what was not reached
stays pending. Waves are worked on in rounds, one job and one part of a ledger each: 1, 1, 2, 4… and at most ``ROUND`` waves at once, so
the jobs of a run don't grow with its waves. What a round's later waves found beside one with a stopped lane is not kept: those calls, at most as
many as were made before and as a round has, are made again by a later run. Items that any run indexed or skipped are not asked about
again, failed and pending ones are, and a run that is cut off goes on at its first round that is not complete. The graph is written from
the ledger afterwards, in one step, so tasks never race for an entity.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.checkpoints import persisted
from tarn.functions.text import is_mathematical, name_key
from tarn.operators.graph import add_edges_if_absent, extracted_entities, extracted_links, resolve_names
from tarn.operators.paging import placed
from tarn.sources.ledger import Ledger

BREAKER = 5
WAVE, LANE, BATCH = 1024, 64, 8
#: The most waves of a round, a power of two.
ROUND = 128
ENTITY, LINK = "struct<name: string, type: string>", "struct<subject: string, predicate: string, confidence: double, object: string>"
OUTCOMES = f"""run string, wave long, lane long, place long, kind string, id long, nth long, label string, outcome string, error string,
    tripped boolean, entities array<{ENTITY}>, links array<{LINK}>"""

#: A batch of items (id, kind, text, title) -> for each: entities and links, or error. Raising fails the whole batch.
Extract = Callable[[list[dict]], list[dict]]


def items(beliefs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Active beliefs (id, content, status, created_at), then chunks of no session (id, content, title, heading, chunk_index, session, created_at).

    ``skip`` marks chunks that are mostly formulas: nothing can be extracted from them.
    """
    short = lambda c: F.when(F.length(c) > 64, F.concat(F.substring(c, 1, 61), F.lit("..."))).otherwise(c)
    own = beliefs.filter("status = 'active'").select(
        F.lit("memory").alias("kind"), "id", "content", F.lit(None).cast("string").alias("title"), F.lit(False).alias("skip"), "created_at",
        F.lit(0).cast("long").alias("chunk_index"), short(F.col("content")).alias("label"),
    )
    name = F.concat("title", F.lit(" › "), F.coalesce("heading", F.concat(F.lit("#"), F.col("chunk_index") + 1)))
    parts = chunks.filter("session is null").select(
        F.lit("chunk").alias("kind"), "id", "content", "title", is_mathematical(F.col("content")).alias("skip"), "created_at",
        F.col("chunk_index").cast("long").alias("chunk_index"), short(name).alias("label"),
    )
    return own.unionByName(parts)


def _lane(run: str, extract: Extract, batch: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def visit(frame: pd.DataFrame) -> pd.DataFrame:
        rows, failures = frame.sort_values("place").to_dict("records"), 0
        out: list[dict] = []
        for start in range(0, len(rows), batch):
            if failures == BREAKER:
                break
            part = rows[start : start + batch]
            asked = [r for r in part if not r["skip"]]
            try:
                got = extract([{"id": r["id"], "kind": r["kind"], "text": r["content"] or "", "title": r["title"]} for r in asked]) if asked else []
            except Exception as error:  # whatever the provider raises is these items' failure, and is recorded
                got = [{"error": str(error) or type(error).__name__}] * len(asked)
            told = iter(got)
            for r in part:
                found = {} if r["skip"] else next(told)
                failed = found.get("error") is not None
                if failures < BREAKER:  # once it trips, the rest of the batch changes nothing
                    failures = failures + 1 if failed else 0
                out.append(
                    {c: r[c] for c in ("wave", "lane", "place", "kind", "id", "nth", "label")}
                    | {"run": run, "outcome": "failed" if failed else "skipped" if r["skip"] else "indexed", "error": found.get("error"), "tripped": failed and failures == BREAKER}
                    | {"entities": found.get("entities", []), "links": found.get("links", [])}
                )
        names = "run wave lane place kind id nth label outcome error tripped entities links".split()
        return pd.DataFrame(out, columns=names)

    return visit


def pending(found: DataFrame, ledger: Ledger, run: str) -> DataFrame:
    """Items that no other run indexed or skipped."""
    others = [p for p in ledger.parts() if not p.startswith(f"{run}-wave-")]
    done = ledger.get(*others).filter("outcome in ('indexed', 'skipped')").select("kind", "id").distinct()
    return found.join(done, ["kind", "id"], "left_anti")


def round_of(wave: Column, most: int = ROUND) -> Column:
    """The round of a wave: waves 0, 1, 2-3, 4-7… up to ``most``, then as many in each."""
    digits = F.length(F.bin(wave))
    return F.when(wave == 0, 0).when(wave < most, digits).otherwise(F.lit(most.bit_length() - 1) + F.floor(wave / most)).cast("int")


def rounds(waves: int, most: int = ROUND) -> list[int]:
    """The first wave of each round."""
    starts = [0, *(1 << k for k in range(most.bit_length() - 1)), *range(most, waves, most)]
    return [s for s in starts if s < waves]


def index_pass(
    run: str, beliefs: DataFrame, chunks: DataFrame, extract: Extract, ledger: Ledger, wave: int = WAVE, lane: int = LANE, batch: int = BATCH
) -> DataFrame:
    """One run, or the rest of one that was cut off: (run, status, total, memories, chunks, failed). ``wave`` and ``lane`` are multiples of ``batch``.

    status: success, warning (some failed), error (all failed), interrupted (the breaker), or idle: nothing was pending.
    """
    ordered = pending(items(beliefs, chunks), ledger, run).withColumn("later", F.col("kind") == "chunk")
    todo = placed(ordered, ["later", "created_at", "chunk_index", "id"])
    todo = todo.withColumn("wave", F.expr(f"place div {wave}")).withColumn("lane", F.expr(f"place div {lane}"))
    todo = persisted(todo.withColumn("round", round_of(F.col("wave"))), "items", "round")
    total, first = todo.agg(F.count("*"), F.count_if(F.col("kind") == "memory")).first()
    nth = F.when(F.col("later"), F.col("place") - first).otherwise(F.col("place")) + 1
    for k, start in enumerate(rounds(-(-total // wave))):
        name = f"{run}-wave-{start:06d}"
        if not ledger.has(name):
            own = todo.filter(F.col("round") == k).withColumn("nth", nth)
            told = own.groupBy("lane").applyInPandas(_lane(run, extract, batch), OUTCOMES)
            if k > 1:  # of several waves, those up to the first that stops
                told = persisted(told, "round")
                last = told.filter("tripped").agg(F.min("wave")).first()[0]
                told = told if last is None else told.filter(F.col("wave") <= last)
            ledger.put(name, told)
        if not ledger.get(name).filter("tripped").isEmpty():
            break
    rows = ledger.read(f"{run}-wave-")
    finished = F.col("outcome") != "failed"
    counts = rows.agg(
        F.count_if(finished & (F.col("kind") == "memory")).alias("memories"), F.count_if(finished & (F.col("kind") == "chunk")).alias("chunks"),
        F.count_if(~finished).alias("failed"), F.coalesce(F.bool_or("tripped"), F.lit(False)).alias("tripped"),
    )
    some = F.col("memories") + F.col("chunks") > 0
    status = F.when(F.lit(total == 0), "idle").when(F.col("tripped"), "interrupted").when(F.col("failed") == 0, "success").when(some, "warning").otherwise("error")
    out = counts.select(F.lit(run).alias("run"), status.alias("status"), F.lit(total).cast("long").alias("total"), "memories", "chunks", "failed")
    return persisted(out, "run")


def events(ledger: Ledger, run: str) -> DataFrame:
    """The run's log, an event an item and one for the breaker: (place, level, kind, id, message)."""
    rows = persisted(ledger.read(f"{run}-wave-"), "events")
    names = F.array_join(F.transform("entities", lambda e: e["name"]), ", ")
    n = F.size("links")
    links = F.when(n > 0, F.concat(F.lit(" (+"), n, F.when(n == 1, " relationship)").otherwise(" relationships)"))).otherwise("")
    what = (
        F.when(F.col("outcome") == "failed", F.concat(F.lit("failed: "), "error"))
        .when(F.col("outcome") == "skipped", "skipped (math-dense)")
        .when(F.size("entities") == 0, "no entities")
        .otherwise(F.concat(names, links))
    )
    level = F.when(F.col("outcome") == "failed", "error").when(F.size("entities") > 0, "success").otherwise("info")
    message = F.concat(F.lit("["), "nth", F.lit("] "), "kind", F.lit(" "), "label", F.lit(" → "), what)
    told = rows.select("place", level.alias("level"), "kind", "id", message.alias("message"))
    stop = rows.filter("tripped").select("place", F.lit("error").alias("level"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("id"),
        F.lit(f"stopped after {BREAKER} consecutive failures").alias("message")).orderBy("place").limit(1)
    return told.unionByName(stop)


def graph(
    ledger: Ledger, prefix: str, entities: DataFrame, aliases: DataFrame, edges: DataFrame, types: DataFrame, predicates: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """What the runs under ``prefix`` found, written into the graph: (entities that are new: id, name, type; edges after).

    Names resolve by key, then by alias; the rest become entities whose ids count on from the largest. Each item mentions its
    entities; links between them are edges of their predicate, or mentions where the predicate is unknown or unsure.
    """
    rows = ledger.read(prefix).filter("outcome = 'indexed'")
    raw = rows.select(F.col("id").alias("source"), F.posexplode("entities").alias("pos", "e")).select("source", "pos", "e.name", "e.type")
    kept = persisted(extracted_entities(raw, types), "kept")
    said = rows.select(F.col("id").alias("source"), F.posexplode("links").alias("pos", "l")).select("source", "pos", "l.*")
    links = extracted_links(said, kept, predicates)
    told = persisted(kept.groupBy("name").agg(F.min("type").alias("type")), "names")
    by_name = persisted(resolve_names(told.select("name"), entities, aliases), "resolved")
    key = name_key(F.col("name"))
    fresh = by_name.filter("entity is null").join(told, "name").groupBy(key.alias("key")).agg(F.min("name").alias("name"), F.min_by("type", "name").alias("type"))
    last = entities.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = persisted(placed(fresh, ["key"]).select((F.col("place") + last + 1).alias("id"), "key", "name", "type"), "new-entities")
    ids = by_name.select("name", "entity", key.alias("key")).join(new.select("key", F.col("id").alias("made")), "key", "left")
    ids = persisted(ids.select(F.lower("name").alias("lower"), F.coalesce("entity", "made").alias("entity")).groupBy("lower").agg(F.min("entity").alias("entity")), "ids")
    mentions = kept.select("source", F.lower("name").alias("lower")).join(ids, "lower").select(F.col("source").alias("from_id"), F.col("entity").alias("to_id"), F.lit("mention").alias("relation"))
    ends = links.join(ids.select(F.col("lower").alias("subject"), F.col("entity").alias("from_id")), "subject")
    ends = ends.join(ids.select(F.col("lower").alias("object"), F.col("entity").alias("to_id")), "object").select("from_id", "to_id", "relation")
    made = mentions.unionByName(ends).withColumn("active", F.lit(True))
    return new.drop("key"), add_edges_if_absent(edges.select("from_id", "to_id", "relation", "active"), made)
