"""The registry of entity types and predicates: a state machine for each name, folded over ordered events.

Events (seq, kind, name, op, value) are: seed (the system's own entries), propose (a model's suggestion), add (value: a description), approve,
dismiss, status (value: active or disabled) and delete. A name has a tier (system, user, proposed) and a status (active, disabled,
dismissed). Events come by the million for a hot name, so they are dealt by ranges of (kind, name, seq), whatever the names: a range's
first and last name may go on in its neighbours, and of those it is told first where each state that a name can begin in leads to. With that,
two rows a range, the state that each range begins in is known, and all ranges are folded at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.checkpoints import persisted
from tarn.functions.text import name_key
from tarn.operators.graph import add_edges_if_absent, resolve_names
from tarn.operators.paging import placed

#: Examples that a proposal keeps, the first ones of different names or ends.
MOST_EXAMPLES = 20
#: Events in a range.
RANGE = 250_000
KEY = ["kind", "name"]
ORDER = [*KEY, "seq", "op", "value"]
#: (tier, condition): the status, or OTHER for one that the machine doesn't know.
OTHER = "other"
STATES = [(None, None), *((t, c) for t in ("system", "user") for c in ("active", "disabled", "dismissed", OTHER, None)), ("proposed", "active"), ("proposed", "dismissed")]
OPS = ["seed", "propose", "add", "approve", "dismiss", "delete"]
VALUES = ["active", "disabled", "dismissed"]
SYMBOLS = [*((o, None) for o in OPS), *(("status", c) for c in (*VALUES, OTHER, None)), (None, None)]
WHYS = [
    None, "no pending proposal", "no such entry", "system entries can only be disabled", "proposals are approved or dismissed", "only disabled entries can be deleted"
]


def _step(state: tuple, symbol: tuple) -> tuple[tuple, str | None, bool, bool]:
    """After an event: the state, why it was refused, whether it made a proposal, whether it counts as one."""
    (tier, condition), (op, value) = state, symbol
    if op == "seed" and tier is None:
        return ("system", "active"), None, False, False
    if op == "propose":
        born = tier is None
        return ("proposed", "active") if born else state, None, born, born or state == ("proposed", "active")
    if op == "add":
        return ("user", "active"), None, False, False
    if op in ("approve", "dismiss"):
        if tier != "proposed":
            return state, WHYS[1], False, False
        return ("user", "active") if op == "approve" else ("proposed", "dismissed"), None, False, False
    if op in ("status", "delete") and tier is None or op == "status" and tier == "proposed":
        return state, WHYS[2], False, False
    if op == "status":
        return (tier, value), None, False, False
    if op == "delete":
        why = WHYS[3] if tier == "system" else WHYS[4] if tier == "proposed" else WHYS[5] if condition not in ("disabled", None) else None
        return (state, why, False, False) if why else ((None, None), None, False, False)
    return state, None, False, False


_ALL = [[_step(s, e) for s in STATES] for e in SYMBOLS]
NEXT = [[STATES.index(r[0]) for r in row] for row in _ALL]
WHY = np.array([[WHYS.index(r[1]) for r in row] for row in _ALL])
BORN = np.array([[r[2] for r in row] for row in _ALL])
COUNTED = np.array([[r[3] for r in row] for row in _ALL])


def _walk(symbols: list[int], state: int) -> list[int]:
    """The state before each event, and the one after all."""
    out = [state]
    for e in symbols:
        state = NEXT[e][state]
        out.append(state)
    return out


def _leads(symbols: np.ndarray, run: int = 1000) -> tuple[list[int], list[int]]:
    """Where each state leads, and how many proposals are made on the way; walks that have met go on as one, looked at after each ``run`` of events."""
    ends, born = list(range(len(STATES))), [0] * len(STATES)
    for lo in range(0, len(symbols), run):
        part = symbols[lo : lo + run]
        walks = {s: _walk(part.tolist(), s) for s in set(ends)}
        made = {s: int(BORN[part, w[:-1]].sum()) for s, w in walks.items()}
        ends, born = [walks[s][-1] for s in ends], [n + made[s] for s, n in zip(ends, born, strict=True)]
    return ends, born


def _sorted(events: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The events in order, each one's symbol, and where each name's begin (and where the last one's end)."""
    events = events.take(pc.sort_indices(events, [(c, "ascending") for c in ORDER], null_placement="at_start"))
    op, value = (events.column(c).combine_chunks() for c in ("op", "value"))
    of_op = pc.index_in(op, pa.array(OPS)).to_numpy(zero_copy_only=False)
    of_value = pc.fill_null(pc.index_in(value, pa.array(VALUES)), len(VALUES)).to_numpy(zero_copy_only=False) + pc.is_null(value).to_numpy(zero_copy_only=False)
    status = pc.fill_null(pc.equal(op, "status"), False).to_numpy(zero_copy_only=False)
    symbols = np.where(status, len(OPS) + of_value, np.where(np.isnan(of_op.astype(float)), len(SYMBOLS) - 1, of_op)).astype(np.int64)
    new = np.zeros(len(events), bool)
    new[:1] = True
    for c in KEY:
        codes = events.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return events, symbols, np.append(np.flatnonzero(new), len(events))


def _edges(events: pa.Table) -> pa.Table:
    """Of the range's first and last name: where each state leads, and how many proposals are made on the way."""
    part = events.column("_range")[0].as_py()
    events, symbols, first = _sorted(events)
    rows = []
    for k in sorted({0, len(first) - 2}):
        ends, born = _leads(symbols[first[k] : first[k + 1]])
        rows.append({c: events.column(c)[int(first[k])].as_py() for c in KEY} | {"_range": part, "at": k, "ends": ends, "born": born})
    return pa.Table.from_pylist(rows, pa.schema([*(events.schema.field(c) for c in KEY), ("_range", pa.int32()), ("at", pa.int32()), ("ends", pa.list_(pa.int32())), ("born", pa.list_(pa.int64()))]))


def _begins(edges: list) -> dict[int, tuple[int, int]]:
    """Of each range: the state that its first name begins in, and the number of proposals before."""
    begins, name, state, born = {}, None, 0, 0
    for r in sorted(edges, key=lambda r: (r["_range"], r["at"])):
        if name != (r["kind"], r["name"]):
            name, state, born = (r["kind"], r["name"]), 0, 0
        if r["at"] == 0:
            begins[r["_range"]] = (state, born)
        state, born = r["ends"][state], born + r["born"][state]
    return begins


def _fold(begins: dict[int, tuple[int, int]]) -> Callable[[pa.Table], pa.Table]:
    def visit(events: pa.Table) -> pa.Table:
        part = events.column("_range")[0].as_py()
        events, symbols, first = _sorted(events)
        before, after, life = (np.zeros(len(events), np.int64) for _ in range(3))
        for k, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            state, lives = begins[part] if k == 0 else (0, 0)
            walk = _walk(symbols[lo:hi].tolist(), state)
            before[lo:hi], after[lo:hi] = walk[:-1], walk[1:]
            life[lo:hi] = lives + np.cumsum(BORN[symbols[lo:hi], before[lo:hi]])
        why, names = WHY[symbols, before], list(zip(*STATES, strict=True))
        told = {
            "tier": pa.array(names[0], pa.string()).take(pa.array(after)), "condition": pa.array(names[1], pa.string()).take(pa.array(after)),
            "why": pa.array(WHYS, pa.string()).take(pa.array(why)), "life": pa.array(life), "counted": pa.array(COUNTED[symbols, before]),
            "wiped": pa.array((symbols == OPS.index("delete")) & (why == 0)), "place": pa.array((part << 32) + np.arange(len(events))),
        }
        events = events.select([*ORDER])
        return pa.table([*events.columns, *told.values()], [*events.column_names, *told])

    return visit


def folded(events: DataFrame, rows: int = RANGE) -> DataFrame:
    """The events with what they did to their name, about ``rows`` in a task: (kind, name, seq, op, value, tier and condition after it,
    why: the reason if it was refused, life: the number of proposals made so far, counted: whether it counts as one, wiped, place)."""
    spark = events.sparkSession
    narrow = events.select(*ORDER)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), narrow.count() // rows + 1)
    dealt = persisted(narrow.repartitionByRange(parts, *ORDER).withColumn("_range", F.spark_partition_id()), "event-ranges")
    shape = [f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema]
    edges = dealt.groupBy("_range").applyInArrow(_edges, ", ".join([*shape[:2], "_range int, at int, ends array<int>, born array<long>"]))
    begins = _begins(edges.collect())  # two rows a range
    told = "tier string, condition string, why string, life long, counted boolean, wiped boolean, place long"
    return persisted(dealt.groupBy("_range").applyInArrow(_fold(begins), ", ".join([*shape[: len(ORDER)], told])), "states")


def registry(states: DataFrame) -> DataFrame:
    """(kind, name, tier, status, description, occurrences) of the entries there are."""
    text = F.when(F.col("op") == "add", F.col("value"))
    lives = states.groupBy(*KEY, "life").agg(
        F.max("place").alias("place"), F.max_by(F.struct("tier", "condition"), "place").alias("last"), F.bool_or("wiped").alias("wiped"), F.count_if("counted").alias("n"),
        F.max_by("value", F.when((F.col("op") == "status") & F.col("why").isNull(), F.col("place"))).alias("status"),
        F.max(F.when((F.col("op") == "add") | F.col("wiped"), F.struct("place", text.alias("text")))).alias("text"),
    )
    last = lives.groupBy(*KEY).agg(F.max_by(F.struct("last", "status", "wiped", "n"), "place").alias("s"), F.max("text").alias("text"))
    status = F.when(F.col("s.last.condition") == OTHER, F.col("s.status")).otherwise(F.col("s.last.condition"))
    n = F.when(F.col("s.wiped"), 0).otherwise(F.col("s.n")).cast("long")
    return last.filter("s.last.tier is not null").select(*KEY, "s.last.tier", status.alias("status"), F.col("text.text").alias("description"), n.alias("occurrences"))


def refusals(states: DataFrame) -> DataFrame:
    """(kind, name, seq, op, why) of acts that the state did not allow; they change nothing."""
    return states.filter("why is not null").select(*KEY, "seq", "op", "why")


def approved_examples(states: DataFrame, events: DataFrame) -> DataFrame:
    """What each approval had to go by: the first MOST_EXAMPLES different examples of its proposal.

    ``events`` with, for proposals, entity or from_name and to_name, confidence and source. Result: (kind, name, approved: seq of the
    approval, seq, entity, from_name, to_name, confidence, source).
    """
    given = events.filter("op = 'propose' and (entity is not null or from_name is not null and to_name is not null)")
    which = F.coalesce(name_key(F.col("entity")), F.concat_ws("|", F.lower("from_name"), F.lower("to_name")))
    given = given.select(*KEY, "seq", "entity", "from_name", "to_name", "confidence", "source", which.alias("which"))
    # a life has at most one approval, after all that counts for it
    approvals = states.filter("op = 'approve' and why is null").select(*KEY, "life", F.col("seq").alias("approved"))
    asked = states.filter("counted").select(*KEY, "life", "seq").join(approvals, [*KEY, "life"]).drop("life")
    held = given.join(asked, [*KEY, "seq"]).groupBy(*KEY, "approved", "which").agg(
        F.min_by(F.struct("seq", "entity", "from_name", "to_name", "confidence", "source"), "seq").alias("e")
    )
    place = F.row_number().over(Window.partitionBy(*KEY, "approved").orderBy("e.seq"))
    return held.withColumn("place", place).filter(F.col("place") <= MOST_EXAMPLES).select(*KEY, "approved", "e.*")


def materialised(examples: DataFrame, entities: DataFrame, aliases: DataFrame, edges: DataFrame, alive: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Approved examples in the graph: (new entities: id, name, type; edges after; linked: kind, name, approved, entities, edges).

    ``alive`` (id): active beliefs and chunks. An entity needs a source that still stands; a link needs two ends that are known,
    and never makes them.
    """
    examples = persisted(examples, "examples")  # read five times
    seen = examples.filter("kind = 'entity_type' and entity is not null").join(alive.select(F.col("id").alias("source")), "source", "left_semi")
    names = persisted(resolve_names(seen.select(F.col("entity").alias("name")).distinct(), entities, aliases).withColumn("key", name_key(F.col("name"))), "names")
    kinds = seen.groupBy(name_key(F.col("entity")).alias("key")).agg(F.min_by(F.struct(F.col("entity").alias("name"), F.col("name").alias("type")), F.struct("approved", "seq")).alias("f"))
    last = entities.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = names.filter("entity is null").select("key").distinct().join(kinds, "key")
    new = persisted(placed(fresh, ["key"]).select((F.col("place") + last + 1).alias("id"), "key", "f.name", "f.type"), "new")
    ids = names.select(F.col("name").alias("entity"), F.col("entity").alias("known"), "key").join(new.select("key", "id"), "key", "left")
    mentions = seen.join(ids.select("entity", F.coalesce("known", "id").alias("to_id")), "entity")
    every = entities.select("id", "name").unionByName(new.select("id", "name"))
    links = examples.filter("kind = 'predicate' and from_name is not null and to_name is not null")
    for end in ("from", "to"):
        at = resolve_names(links.select(F.col(f"{end}_name").alias("name")).distinct(), every, aliases)
        links = links.join(at.select(F.col("name").alias(f"{end}_name"), F.col("entity").alias(f"{end}_id")), f"{end}_name")
    links = links.filter("from_id is not null and to_id is not null")
    made = mentions.select(F.col("source").alias("from_id"), "to_id", F.lit("mention").alias("relation")).unionByName(
        links.select("from_id", "to_id", F.col("name").alias("relation"))
    )
    after = add_edges_if_absent(edges.select("from_id", "to_id", "relation", "active"), made.withColumn("active", F.lit(True)))
    count = lambda df, name: df.groupBy(*KEY, "approved").agg(F.count("*").alias(name))
    linked = count(mentions, "entities").join(count(links, "edges"), [*KEY, "approved"], "full_outer").na.fill(0, ["entities", "edges"])
    return new.drop("key"), after, linked
