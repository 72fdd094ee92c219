"""The re-check of beliefs for contradictions with what came after them: pages of calls under a budget, and what they found.

A run takes the beliefs that are due, those that waited longest first. A page is the beliefs that failed before and the next ones,
``window`` in all; each has its nearest neighbours that nobody judged yet. The page's calls are made in the tasks by an injected
function; a page is one part of a ledger, so a run that is cut off and begun again under its name makes no call of a finished
page again and ends with the same rows. Nothing but the totals of a page goes through the driver.

Without a budget a run is one page. With one it goes on until nothing is due or the money is spent: a belief is asked about if what
was billed on earlier pages and the estimates of those before it in its page stay below the budget.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.checkpoints import bounded, persisted, tidy
from tarn.functions.text import json_array, quote_found
from tarn.operators.paging import placed, running
from tarn.operators.retrieval import recheck_pairs
from tarn.sources.ledger import Ledger

WINDOW, NEIGHBOURS, LEAST, QUIET_DAYS = 200, 20, 0.5, 30
#: Subjects of one vector that share the texts of their candidates; texts that are sent at a time.
TOGETHER, TEXTS = 32, 1_000_000
#: Characters in a token and tokens in one candidate's verdict, for estimates.
TOKEN, VERDICT = 4, 63
FINDING = "struct<candidate: long, reason: string, new_quote: string, old_quote: string, similarity: double>"
OUTCOMES = f"""run string, page int, id long, place long, outcome string, input_tokens long, output_tokens long, usd double, claimed int,
    error string, findings array<{FINDING}>"""
RUN = """run string, `window` long, calls long, claimed long, possible long, input_tokens long, output_tokens long, usd double, remaining long,
    stopped_by string"""


class OutOfCredit(Exception):
    """No later call can succeed."""


#: A batch of questions (id, content, candidates: texts in order) -> an answer each: reply, input_tokens, output_tokens, usd (or None), or error.
Ask = Callable[[list[dict]], list[dict]]


def due_beliefs(beliefs: DataFrame, now: Column, days: int = QUIET_DAYS) -> DataFrame:
    """Active beliefs with a vector that were never checked, or not for so many days."""
    quiet = F.col("last_rechecked_at").isNull() | (F.col("last_rechecked_at") < now - F.make_interval(days=F.lit(days)))
    return beliefs.filter((F.col("status") == "active") & F.col("vec").isNotNull() & quiet)


def near_pairs(beliefs: DataFrame, subjects: DataFrame, settled: DataFrame) -> DataFrame:
    """Candidates of the subjects without any text: (qid, id, similarity, rank).

    ``settled`` (a, b): pairs that were answered, found or queued as conflicts, either way round.
    """
    active = beliefs.filter("status = 'active'")
    due = subjects.select(F.col("id").alias("qid"), "vec", "content_hash", "root_id")
    return recheck_pairs(active.select("id", F.lit("").alias("src"), "vec", "content_hash", "root_id"), due, settled, NEIGHBOURS, LEAST)


def _listed(subjects: DataFrame, near: DataFrame) -> DataFrame:
    """(qid, place, held, listed: rank, id, similarity) of the subjects that have any, stored. Those with the same ``held`` share texts.

    Subjects of one vector have much the same candidates: up to ``TOGETHER`` of them share one copy of each text until they are read.
    """
    own = subjects.select(F.col("id").alias("qid"), "place", F.xxhash64("vec").alias("of"))
    parts = F.ceil(F.count("*").over(Window.partitionBy("of")) / TOGETHER)
    own = own.withColumn("held", F.xxhash64("of", F.pmod(F.xxhash64("qid"), parts))).drop("of")
    listed = near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "similarity"))).alias("listed"))
    return persisted(own.join(listed, "qid"), "listed")


def _wanted(listed: DataFrame) -> DataFrame:
    """(held, id) of the texts that have to be sent."""
    return listed.select("held", F.explode(F.array_append("listed.id", F.col("qid"))).alias("id")).distinct()


def _filled(texts: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of _listed() with their texts: (id, content, place, candidates: rank, id, content, similarity)."""
    wanted = bounded(persisted(_wanted(listed), "wanted"))
    held = texts.select("id", "content").join(wanted, "id").groupBy("held").agg(F.collect_list(F.struct("id", "content")).alias("texts"))
    text = lambda i: F.get(F.filter("texts", lambda t: t["id"] == i), F.lit(0))["content"].alias("content")
    candidates = F.transform("listed", lambda c: F.struct(c["rank"].alias("rank"), c["id"].alias("id"), text(c["id"]), c["similarity"].alias("similarity")))
    return listed.join(held, "held").select(F.col("qid").alias("id"), text(F.col("qid")), "place", candidates.alias("candidates"))


def with_texts(beliefs: DataFrame, subjects: DataFrame, near: DataFrame) -> DataFrame:
    """The subjects that have any, with the pairs of near_pairs() in order: (id, content, place, candidates: id, content, similarity). A row holds up to NEIGHBOURS whole texts: read it once, store it nowhere."""
    return _filled(beliefs.filter("status = 'active'"), _listed(subjects, near))


def _in_waves(texts: DataFrame, subjects: DataFrame, near: DataFrame) -> Iterator[DataFrame]:
    """with_texts() in parts that send about ``TEXTS`` texts each, so that what lies on disk at a time doesn't grow with the page."""
    listed = _listed(subjects, near)
    waves = max(1, math.ceil(_wanted(listed).count() / TEXTS))
    for wave in range(waves):
        yield _filled(texts, listed.filter(F.pmod("held", F.lit(waves)) == wave))


def estimate(input_price: float, output_price: float) -> Column:
    """USD of asking about a belief; prices are per million tokens."""
    text = F.aggregate("candidates", F.length("content").cast("long"), lambda s, c: s + F.length(c["content"]))
    return (F.ceil(text / TOKEN) * input_price + F.size("candidates") * VERDICT * output_price) / 1e6


def answers(asked: DataFrame, ask: Ask) -> DataFrame:
    """(id, content, candidates) -> those and (reply, input_tokens, output_tokens, usd, error), by calls of a batch in the tasks.

    A call that raises fails its batch; one for which credit is missing fails it with the error ``credit``.
    """

    names = ("reply", "input_tokens", "output_tokens", "usd", "error")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("candidates")
            flat, ends = lists.flatten().field("content").to_pylist(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            rows = zip(batch.column("id").to_pylist(), batch.column("content").to_pylist(), [0, *ends], ends, strict=False)
            questions = [{"id": i, "content": c, "candidates": flat[a:b]} for i, c, a, b in rows]
            try:
                got = ask(questions)
            except OutOfCredit:
                got = [{"error": "credit"}] * len(questions)
            except Exception as error:  # whatever the provider raises is this batch's failure, and is recorded
                got = [{"error": str(error) or type(error).__name__}] * len(questions)
            told = [pa.array([g.get(n) for g in got], k) for n, k in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], [*batch.schema.names, *names])

    asked = asked.select("id", "content", "candidates")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
    return asked.mapInArrow(run, f"{shape}, reply string, input_tokens long, output_tokens long, usd double, error string")


def findings(replies: DataFrame) -> DataFrame:
    """(id, content, candidates, reply, what the call took, error) -> (id, claimed, findings, what the call took, error): contradictions
    that were claimed, and those whose quotes are real; null for calls with an error.

    An item that isn't an object, or names no candidate, decides nothing. The texts stay in the tasks that hold them.
    """
    shape = "candidate string, relation string, reason string, new_quote string, old_quote string"
    text = lambda c: F.coalesce(c, F.lit(""))

    def said(item: Column) -> Column:
        return F.when(item.startswith("{"), F.from_json(item, shape))

    def claim(v: Column) -> Column:
        number = v["candidate"].try_cast("double")
        named = (number == F.floor(number)) & (number >= 1) & (number <= F.size("candidates"))
        return F.coalesce(named & F.contains(F.lower(v["relation"]), F.lit("contra")), F.lit(False))

    def named(v: Column) -> Column:
        return F.struct(v.alias("v"), F.get("candidates", v["candidate"].try_cast("double").cast("int") - 1).alias("of"))

    def real(c: Column) -> Column:
        return quote_found(F.col("content"), text(c["v"]["new_quote"])) & quote_found(c["of"]["content"], text(c["v"]["old_quote"]))

    def found(c: Column) -> Column:
        v, of = c["v"], c["of"]
        return F.struct(of["id"].alias("candidate"), text(v["reason"]).alias("reason"), v["new_quote"].alias("new_quote"), v["old_quote"].alias("old_quote"), of["similarity"].alias("similarity"))

    # a row stays one: its items never take copies of its texts along
    items = F.coalesce(F.from_json(json_array(F.col("reply")), "array<string>"), F.array().cast("array<string>"))
    claims = F.transform(F.filter(F.transform(items, said), claim), named)
    rows = replies.select("id", "content", "input_tokens", "output_tokens", "usd", "error", claims.alias("claims"))
    well = lambda c: F.when(F.col("error").isNull(), c)
    real_ones = F.transform(F.filter("claims", real), found).cast(f"array<{FINDING}>")
    return rows.select("id", well(F.size("claims")).alias("claimed"), well(real_ones).alias("findings"), "input_tokens", "output_tokens", "usd", "error")


def settled_pairs(answered: DataFrame, decisions: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b) of pairs that were answered, are or were queued as conflicts, or were found by earlier pages."""
    queued = decisions.select(F.col("incoming").alias("a"), F.explode("candidates").alias("b"))
    own = found.select(F.col("id").alias("a"), F.explode("findings.candidate").alias("b"))
    return answered.select("a", "b").unionByName(queued).unionByName(own)


def _page(
    run: str, page: int, subjects: DataFrame, beliefs: DataFrame, texts: DataFrame, settled: DataFrame, ask: Ask, left: float | None, prices: tuple[float, float]
) -> DataFrame:
    """The outcome of each belief of the page: no_candidates, unasked (beyond the budget), failed or checked."""
    near = persisted(near_pairs(beliefs, subjects, settled), "neighbours")
    if left is None:
        asked = _in_waves(texts, subjects, near)
    else:
        asked = [running(_filled(texts, _listed(subjects, near)), ["place"], before=estimate(*prices)).filter(F.col("before") < left)]
    told = reduce(DataFrame.unionByName, [persisted(findings(answers(some, ask)), "answers") for some in asked])  # each call once, whatever reads it
    known = near.select(F.col("qid").alias("id"), F.lit(True).alias("has")).distinct()
    rows = subjects.select("id", "place").join(known, "id", "left").join(told, "id", "left")
    outcome = (
        F.when(F.col("has").isNull(), "no_candidates")
        .when(F.col("error").isNotNull(), "failed")
        .when(F.col("findings").isNull(), "unasked")
        .otherwise("checked")
    )
    price = F.coalesce("usd", (F.col("input_tokens") * prices[0] + F.col("output_tokens") * prices[1]) / 1e6)
    return rows.select(
        F.lit(run).alias("run"), F.lit(page).alias("page"), "id", "place", outcome.alias("outcome"), "input_tokens", "output_tokens",
        price.alias("usd"), "claimed", "error", "findings",
    )


def recheck_run(
    run: str,
    beliefs: DataFrame,
    answered: DataFrame,
    decisions: DataFrame,
    ask: Ask,
    ledger: Ledger,
    now: Column,
    window: int = WINDOW,
    budget: float | None = None,
    prices: tuple[float, float] = (0.0, 0.0),
    texts: DataFrame | None = None,
) -> DataFrame:
    """One run, or the rest of one that was cut off: its row (RUN). The ledger (of OUTCOMES) holds what became of each belief.

    ``beliefs`` (id, content, content_hash, root_id, status, vec, asserted_at, last_rechecked_at), ``answered`` (a, b), ``decisions``
    (incoming, candidates). ``texts`` (id, content): where the beliefs' texts are read from, if not from the beliefs. stopped_by: budget, credit, failed (a page without an answer), unpriced (calls without a price),
    aborted (a mark ``<run>-stop``), cap (the page was the run, and more is due), or null.
    """
    spark = beliefs.sparkSession
    texts = beliefs.filter("status = 'active'").select("id", "content") if texts is None else texts
    waiting = due_beliefs(beliefs, now).select("id", "content_hash", "root_id", "vec", "asserted_at", "last_rechecked_at")  # without texts
    due = persisted(placed(waiting, ["last_rechecked_at", "asserted_at", "id"]), "due")
    total, spent, cursor, page, stopped = due.count(), 0.0, 0, 0, None
    while True:
        outcomes = ledger.read(f"{run}-page-")
        last = f"{run}-page-{page - 1:06d}"
        failed = ledger.get(last).filter("outcome = 'failed'").select("id") if page else None
        again = due.join(failed, "id", "left_semi") if page else due.limit(0)
        n_again = failed.count() if page else 0
        fresh = min(window - n_again, total - cursor)
        if n_again + fresh == 0:
            break
        if ledger.marked(f"{run}-stop"):
            stopped = "aborted"
            break
        name = f"{run}-page-{page:06d}"
        if not ledger.has(name):
            subjects = persisted(again.unionByName(due.filter(F.col("place").between(cursor, cursor + fresh - 1))), "page")
            settled = settled_pairs(answered, decisions, outcomes)
            with tidy(spark):
                ledger.put(name, _page(run, page, subjects, beliefs, texts, settled, ask, None if budget is None else budget - spent, prices))
        seen = ledger.get(name).agg(
            *(F.count_if(F.col("outcome") == o).alias(o) for o in ("checked", "failed", "unasked", "no_candidates")),
            F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"), F.count_if(F.col("error") == "credit").alias("credit"),
        ).first()
        cursor, page, spent = cursor + fresh, page + 1, spent + seen["usd"]
        if seen["credit"]:
            stopped = "credit"
        elif seen["unasked"]:
            stopped = "budget"
        elif budget is not None and seen["failed"] and not seen["checked"]:
            stopped = "failed"
        elif budget is not None and seen["checked"] and not spent:
            stopped = "unpriced"
        if stopped or budget is None:
            break
    rows = ledger.read(f"{run}-page-")
    done = rows.filter("outcome in ('checked', 'no_candidates')")
    totals = rows.agg(
        F.count_if(F.col("outcome") == "checked").alias("calls"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("claimed", "input_tokens", "output_tokens", "usd")),
        F.coalesce(F.sum(F.size("findings")), F.lit(0)).alias("possible"),
    ).first()
    remaining = total - done.select("id").distinct().count()
    stopped = stopped or ("cap" if remaining else None)
    made = (run, total, totals["calls"], totals["claimed"], totals["possible"], totals["input_tokens"], totals["output_tokens"], totals["usd"], remaining, stopped)
    return spark.createDataFrame([made], RUN)


def possible(ledger: Ledger, run: str) -> DataFrame:
    """What a run found: (id, candidate, reason, new_quote, old_quote, similarity)."""
    return ledger.read(f"{run}-page-").select("id", F.inline("findings"))


def stamped(beliefs: DataFrame, ledger: Ledger, run: str, now: Column) -> DataFrame:
    """Beliefs with the time of the check where the run finished one."""
    done = ledger.read(f"{run}-page-").filter("outcome in ('checked', 'no_candidates')").select("id", F.lit(True).alias("_done")).distinct()
    return beliefs.join(done, "id", "left").withColumn("last_rechecked_at", F.when(F.col("_done"), now).otherwise(F.col("last_rechecked_at"))).drop("_done")


def scripted(reply: Callable[[dict], dict]) -> Ask:
    """A provider that answers each question on its own, for tests and queries: reply items as objects become JSON."""

    def ask(questions: list[dict]) -> list[dict]:
        found = [reply(q) for q in questions]
        return [f | {"reply": json.dumps(f["reply"])} if "reply" in f else f for f in found]

    return ask
