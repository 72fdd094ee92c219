"""Ledgers, running sums, and runs that are cut off and begun again."""

import datetime
import math
import os
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import vectors as V
from tarn.operators import embedding as E
from tarn.operators import entities as N
from tarn.operators import graph as G
from tarn.operators import index_pass as I
from tarn.operators import recheck as H
from tarn.operators import recordings as A
from tarn.operators import runs as O
from tarn.operators.paging import placed, running
from tarn.sources.ledger import Ledger
from tarn.sources.store import Store


def broken(path):
    """As a writer leaves it that is killed: the data is there, the sign that it is complete is not."""
    os.remove(path / "_SUCCESS")


def noted(folder, ids):
    """Calls as files that tasks leave, one an id and call."""
    for i in ids:
        (folder / f"{i}-{uuid.uuid4().hex}").touch()


def calls(folder):
    return sorted(int(p.name.split("-")[0]) for p in folder.iterdir())


# ledgers and sums


def test_ledger_parts(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), "x long")
    assert ledger.parts() == [] and ledger.read().collect() == []
    rows = spark.range(3).select(F.col("id").alias("x"))
    assert ledger.put("b-1", rows).count() == 3
    assert ledger.put("b-1", rows.limit(1)).count() == 3  # written once
    ledger.put("a-1", rows.limit(1))
    assert ledger.parts() == ["a-1", "b-1"] and ledger.read("b").count() == 3
    broken(tmp_path / "l" / "b-1")
    assert ledger.parts() == ["a-1"] and not ledger.has("b-1")
    assert ledger.put("b-1", rows.limit(2)).count() == 2  # made anew
    assert not ledger.marked("r") and (ledger.mark("r") or ledger.marked("r"))


def test_lease(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), "x long")
    assert ledger.lease("run", "one", 0, 1800) and ledger.lease("run", "one", 10, 1800)
    assert not ledger.lease("run", "two", 1799, 1800)
    assert ledger.lease("run", "two", 1800, 1800)  # the first one's holder is taken for dead
    ledger.release("run", "one")
    assert not ledger.lease("run", "three", 1801, 1800)
    ledger.release("run", "two")
    assert ledger.lease("run", "three", 1802, 1800)


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 2]), rng.randrange(-5, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, at int, v long").repartition(7)
    got = {r.id: (r.total, r.n) for r in running(df, ["at", "id"], total=F.col("v"), n=F.lit(1)).collect()}
    total = 0
    for n, (i, _, v) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))):
        assert got[i] == (total, n)
        total += v
    assert placed(df.limit(0), ["id"]).collect() == []


# re-check runs


BELIEFS = "id long, content string, content_hash string, root_id long, status string, vec array<double>, asserted_at timestamp, last_rechecked_at timestamp"
NOW = datetime.datetime(2024, 6, 1)


def store(seed, n=60):
    rng, random_ = np.random.default_rng(seed), random.Random(seed)
    rows = []
    for i in range(n):
        content = f"belief number {i} of the store says that thing {random_.randrange(9)} is so" + "!" * random_.randrange(30)
        checked = random_.choice([None, None, datetime.datetime(2024, 5, 20), datetime.datetime(2024, 1, 1 + random_.randrange(20))])
        vec = None if i % 17 == 3 else [float(x) for x in rng.normal(size=3)]
        rows.append((i, content, f"h{i // 2 if i % 10 == 0 else i}", i - i % 3, "stale" if i % 11 == 4 else "active", vec, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i), checked))
    return rows


def reply(q):
    if len(q["content"]) % 7 == 0:
        return {"error": "no answer"}
    said = [
        {"candidate": k, "relation": "contradictory" if len(c) % 2 else "complementary", "reason": "r", "new_quote": q["content"][:30], "old_quote": c[:30] if len(c) % 5 else "of its own making, all of it"}
        for k, c in enumerate(q["candidates"], 1)
    ] + [7, {"candidate": 99, "relation": "contradictory"}]
    return {"reply": said, "input_tokens": len(q["content"]), "output_tokens": 10, "usd": 0.01 * (1 + len(q["content"]) % 3)}


def one_after_another(rows, window, budget, prices, queued, answered):
    """The same run by plain loops."""
    due = [r for r in rows if r[4] == "active" and r[5] is not None and (r[7] is None or r[7] < NOW - datetime.timedelta(days=30))]
    due.sort(key=lambda r: (r[7] is not None, r[7] or NOW, r[6], r[0]))
    active = [r for r in rows if r[4] == "active" and r[5] is not None]
    settled = {frozenset(p) for p in queued + answered}
    checked, found, spent, asked_ids, stopped = set(), [], 0.0, [], None
    while True:
        page = [r for r in due if r[0] not in checked][:window]
        if not page:
            break
        before, est, new_found, n_calls, unasked = spent, 0.0, [], 0, False
        for r in page:
            near = []
            for c in active:
                sim = sum(x * y for x, y in zip(r[5], c[5], strict=True)) / math.sqrt(sum(x * x for x in r[5]) * sum(x * x for x in c[5]))
                if c[0] != r[0] and c[2] != r[2] and c[3] != r[3] and frozenset((r[0], c[0])) not in settled and round(sim, 9) >= 0.5:
                    near.append((-round(sim, 9), c[0], c))
            near = [c for _, _, c in sorted(near)[:20]]
            if not near:
                checked.add(r[0])
                continue
            price = (math.ceil((len(r[1]) + sum(len(c[1]) for c in near)) / 4) * prices[0] + 63 * len(near) * prices[1]) / 1e6
            if budget is not None and est >= budget - before:
                unasked = True
                continue
            est += price
            asked_ids.append(r[0])
            got = reply({"content": r[1], "candidates": [c[1] for c in near]})
            if "error" in got:
                continue
            n_calls += 1
            spent += got["usd"]
            checked.add(r[0])
            new_found += [(r[0], c[0]) for c, v in zip(near, got["reply"], strict=False) if v["relation"] == "contradictory" and v["old_quote"] in c[1]]
        found += new_found
        settled |= {frozenset(p) for p in new_found}
        failed = [r for r in page if r[0] not in checked]
        if unasked:
            stopped = "budget"
        elif budget is not None and failed and not n_calls:
            stopped = "failed"
        if stopped or budget is None:
            break
    remaining = len([r for r in due if r[0] not in checked])
    return sorted(found), sorted(asked_ids), len(due), round(spent, 6), remaining, stopped or ("cap" if remaining else None)


@pytest.mark.parametrize(("window", "budget"), [(15, 1000.0), (12, None), (10, 0.35)])
def test_recheck_like_one_after_another(spark, tmp_path, window, budget):
    rows, prices = store(21), (900.0, 50.0)
    queued, answered = [(1, 2), (5, 30)], [(7, 8), (40, 9)]
    folder = tmp_path / "calls"
    folder.mkdir()

    def ask(batch, folder=folder):
        noted(folder, [q["id"] for q in batch])
        return H.scripted(reply)(batch)

    beliefs = spark.createDataFrame(rows, BELIEFS)
    decisions = spark.createDataFrame([(a, [b]) for a, b in queued], "incoming long, candidates array<long>")
    pairs = spark.createDataFrame(answered, "a long, b long")
    ledger = Ledger(spark, str(tmp_path / "ledger"), H.OUTCOMES)

    def go():
        return H.recheck_run("r", beliefs, pairs, decisions, ask, ledger, F.lit(NOW), window, budget, prices).first()

    row = go()
    found, asked, due, spent, remaining, stopped = one_after_another(rows, window, budget, prices, queued, answered)
    got = sorted((r.id, r.candidate) for r in H.possible(ledger, "r").collect())
    assert (got, calls(folder)) == (found, asked)
    assert (row.window, round(row.usd, 6), row.remaining, row.stopped_by) == (due, spent, remaining, stopped)
    if budget == 1000.0:
        # the last page is lost: begun again, only its calls are made again, and the rows are the same
        parts = ledger.parts("r-page-")
        assert len(parts) > 2
        again = ledger.get(parts[-1]).filter("outcome in ('checked', 'failed')").count()
        broken(tmp_path / "ledger" / parts[-1])
        assert go() == row and len(calls(folder)) == len(asked) + again
        assert sorted((r.id, r.candidate) for r in H.possible(ledger, "r").collect()) == found
        after = H.stamped(beliefs, ledger, "r", F.lit(NOW))
        assert after.filter(F.col("last_rechecked_at") == F.lit(NOW)).count() == due - remaining
        ledger.mark("s-stop")
        assert H.recheck_run("s", after, pairs, decisions, ask, ledger, F.lit(NOW), window, budget, prices).first().stopped_by == "aborted"


def test_recheck_stops(spark, tmp_path):
    beliefs = spark.createDataFrame(store(5, 30), BELIEFS)
    none, pairs = spark.createDataFrame([], "incoming long, candidates array<long>"), spark.createDataFrame([], "a long, b long")

    def stop(name, ask, budget):
        return H.recheck_run("r", beliefs, pairs, none, ask, Ledger(spark, str(tmp_path / name), H.OUTCOMES), F.lit(NOW), 5, budget).first().stopped_by

    def dear(batch):
        raise H.OutOfCredit

    def down(batch):
        raise RuntimeError("down")

    assert stop("a", dear, 5.0) == "credit"
    assert stop("b", down, 5.0) == "failed"
    assert stop("c", lambda batch: [{"reply": "no list", "input_tokens": 1, "output_tokens": 1}] * len(batch), 5.0) == "unpriced"
    empty = H.recheck_run("r", beliefs.limit(0), pairs, none, down, Ledger(spark, str(tmp_path / "d"), H.OUTCOMES), F.lit(NOW)).first()
    assert (empty.window, empty.calls, empty.stopped_by) == (0, 0, None)


# index passes


def test_index_pass_stops_and_goes_on(spark, tmp_path):
    beliefs = spark.createDataFrame([(i, f"Text {i}", "active" if i != 3 else "stale", NOW) for i in range(70)], "id long, content string, status string, created_at timestamp")
    formula = "1 + 2 = 3 * 4 / 5 - 6 = 7 ^ 8 + 9 = 10 - 11 * 12 = 13" * 2
    chunks = spark.createDataFrame(
        [(500 + i, formula if i == 4 else f"Chunk {i}", "Title", None, i, "s" if i == 6 else None, NOW) for i in range(20)],
        "id long, content string, title string, heading string, chunk_index int, session string, created_at timestamp",
    )
    folder = tmp_path / "calls"
    folder.mkdir()

    def extract(batch, bad=(), folder=folder):
        noted(folder, [i["id"] for i in batch])
        return [{"error": "down"} if i["id"] in bad else {"entities": [{"name": i["text"].split()[0], "type": "term"}], "links": []} for i in batch]

    ledger = Ledger(spark, str(tmp_path / "ledger"), I.OUTCOMES)
    go = lambda run, f: I.index_pass(run, beliefs, chunks, f, ledger, wave=32, lane=16, batch=4).first()
    bad = {1, 20, *range(35, 60)}
    row = go("a", lambda batch: extract(batch, bad))
    # places 0-31: two fail; 32-63 in two lanes: 36-40 (ids 37-41...) fail one after the other and stop each lane
    assert row.status == "interrupted" and row.total == 69 + 19
    first = ledger.read("a-wave-").collect()
    assert len(ledger.parts("a-wave-")) == 2 and any(r.tripped for r in first)
    seen = {r.id for r in first}
    assert calls(folder) == sorted(seen) and not seen & set(range(500, 520))
    for lane in {r.lane for r in first if r.tripped}:
        held = [r.outcome for r in sorted(first, key=lambda r: r.place) if r.lane == lane]
        assert "failed" * 5 in "".join(held) and len(held) < 16
    assert I.events(ledger, "a").filter("message like 'stopped after 5%'").count() == 1
    # the same run again: nothing is asked
    n = len(calls(folder))
    assert go("a", lambda batch: extract(batch, bad)) == row and len(calls(folder)) == n
    # its second wave is lost: only that is asked again
    lost = ledger.parts("a-wave-")[-1]
    again = ledger.get(lost).count()
    broken(tmp_path / "ledger" / lost)
    assert go("a", lambda batch: extract(batch, bad)) == row and len(calls(folder)) == n + again
    # a provider that works finishes the rest, each item once
    before = calls(folder)
    row = go("b", extract)
    left = {i for i in range(70) if i != 3} - {r.id for r in first if r.outcome != "failed"}
    assert (row.status, row.total, row.memories, row.chunks, row.failed) == ("success", len(left) + 19, len(left), 19, 0)
    now = calls(folder)
    for i in before:
        now.remove(i)
    assert now == sorted(left | {500 + i for i in range(20) if i not in (4, 6)})  # the formulas are skipped without a call
    assert I.events(ledger, "b").filter("message like '%skipped (math-dense)'").count() == 1
    assert go("c", extract).status == "idle"


def test_index_pass_of_raising_provider(spark, tmp_path):
    beliefs = spark.createDataFrame([(i, "x", "active", NOW) for i in range(9)], "id long, content string, status string, created_at timestamp")
    chunks = spark.createDataFrame([], "id long, content string, title string, heading string, chunk_index int, session string, created_at timestamp")

    def down(batch):
        raise RuntimeError("unreachable")

    ledger = Ledger(spark, str(tmp_path), I.OUTCOMES)
    row = I.index_pass("r", beliefs, chunks, down, ledger, wave=8, lane=8, batch=2).first()
    assert (row.status, row.failed) == ("interrupted", 6) and {r.error for r in ledger.read().collect()} == {"unreachable"}
    row = I.index_pass("s", beliefs.limit(3), chunks, down, ledger, wave=8, lane=8, batch=2).first()
    assert (row.status, row.failed) == ("error", 3)


def test_graph_of_a_pass(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), I.OUTCOMES)
    found = [
        (1, [("Ann", "person"), ("Acme", "org"), ("x = y", "org")], [("ann", "works_at", 0.9, "acme"), ("ann", "eats", 0.9, "acme"), ("ann", "works_at", 0.9, "nobody")]),
        (2, [("ann", "person"), ("@Bob", "person"), ("Zed", "alien")], [("Bob", "works_at", 0.2, "ann")]),
    ]
    rows = [("r", 0, 0, k, "memory", i, k + 1, "l", "indexed", None, False, e, l) for k, (i, e, l) in enumerate(found)]
    ledger.put("r-wave-000000", spark.createDataFrame(rows, I.OUTCOMES))
    entities = spark.createDataFrame([(7, "Acme")], "id long, name string")
    aliases = spark.createDataFrame([(8, "bob")], "canonical_id long, name string")
    edges = spark.createDataFrame([(1, 7, "mention", False)], "from_id long, to_id long, relation string, active boolean")
    kinds = spark.createDataFrame([("person",), ("org",)], "type string"), spark.createDataFrame([("works_at",)], "predicate string")
    new, after = I.graph(ledger, "r", entities, aliases, edges, *kinds)
    assert [tuple(r) for r in new.collect()] == [(8, "Ann", "person")]
    got = sorted((r.from_id, r.to_id, r.relation, r.active) for r in after.collect())
    # an inactive edge stays as it is; a link of an unknown predicate is a mention between the two
    assert got == sorted([(1, 7, "mention", False), (1, 8, "mention", True), (2, 8, "mention", True), (8, 7, "works_at", True), (8, 7, "mention", True)])


# similarity joins by cells


def test_near_cells_of_clustered_vectors(spark, monkeypatch):
    """Exact, and most pairs of cells don't meet where the vectors are clustered."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    points = (centres[rng.integers(12, size=600)] + 0.1 * rng.normal(size=(600, 16))).tolist() + [[0.0] * 16]
    rows = spark.createDataFrame([("m", i, v) for i, v in enumerate(points)], "src string, id long, vec array<double>")
    queries = rows.select(F.col("id").alias("qid"), "vec")
    monkeypatch.setattr(V, "BLOCK", 100)
    shares = []

    def counted(*a, real=V.near_cells):
        found = real(*a)
        shares.append(len(found) / (len(a[1]) * len(a[2])))
        return found

    monkeypatch.setattr(V, "near_cells", counted)
    for least in (0.5, 0.9):
        got = {(r.qid, r.id) for r in V.nearest(rows, queries, 700, least, block=10, others=True).collect()}
        unit = np.array(points[:-1])
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        q, r = np.nonzero(np.round(unit @ unit.T, 9) >= least)
        assert got == {(a, b) for a, b in zip(q.tolist(), r.tolist(), strict=True) if a != b}
    assert all(s < 0.35 for s in shares) and len(shares) == 2


# reconcile runs


LINE = "id long, content string, content_hash string, status string, root_id long, version int, asserted_at timestamp, stale_since timestamp"


def test_reconcile_runs(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, f"t{i}", f"h{i % 12}", "active", i, 1, day + datetime.timedelta(minutes=i), None) for i in range(30)]  # 12 to 29 repeat older ones
    rows += [(100 + i, "x", f"x{i}", "active", 500 + i // 2, i % 2, day, None) for i in range(8)]  # four lineages of two heads
    rows += [(200, "y", "y", "stale", 200, 1, day, day)]
    beliefs = spark.createDataFrame(rows, LINE)
    edges = spark.createDataFrame([(0, 1, "replaces", True)], "from_id long, to_id long, relation string, active boolean")
    decisions = spark.createDataFrame([(20, [21], None, None), (100, [101], "reconcile:lineage:500", day)], "incoming long, candidates array<long>, key string, resolved_at timestamp")
    never = spark.createDataFrame([], "started_at int, acted boolean")
    ledger, runs = Ledger(spark, str(tmp_path / "a"), O.ACTIONS), Ledger(spark, str(tmp_path / "b"), O.RUN)

    def go(run, apply=True, past=never, clock=0.0):
        return O.reconcile(run, beliefs, edges, decisions, past, ledger, runs, F.lit(NOW), clock, apply)

    row, after, conflicts = go("dry", False)
    assert (row.first().retired, row.first().conflicts, conflicts.count()) == (0, 0, 0)
    assert after.exceptAll(beliefs).count() == 0
    dry = ledger.read("dry-actions")
    assert dry.filter("class = 'multi_head' and kind = 'question'").count() == 3
    row, after, conflicts = go("one")
    acts = {(r["class"], int(r.subject)): r for r in ledger.read("one-actions").collect()}
    # the leak comes first; 20 and 21 belong to a pending conflict; ten duplicates fit
    done = {s for (c, s), r in acts.items() if r.applied and r.kind == "retire"}
    assert done == {1, *[i for i in range(12, 30) if i not in (20, 21)][:10]}
    assert {s for (c, s) in acts if c == "duplicate_content"} == {i for i in range(12, 30) if i not in (20, 21)}
    assert acts["stale_without_edge", 200].surfaced and not acts["stale_without_edge", 200].applied
    assert {r.id for r in after.filter(F.col("stale_since") == F.lit(NOW)).collect()} == done
    assert sorted((r.incoming, r.candidates, r.key) for r in conflicts.collect()) == [(103 + 2 * k, [102 + 2 * k], f"reconcile:lineage:{501 + k}") for k in range(3)]
    assert (row.first().retired, row.first().held_retire, row.first().conflicts, row.first().held_conflict) == (11, 6, 3, 0)
    # begun again it is the same run; three silent runs before it leave only what has a cap of its own
    assert go("one")[0].first() == row.first()
    silent = spark.createDataFrame([(k, False) for k in range(3)] + [(-1, True)], "started_at int, acted boolean")
    row, after, _ = go("two", past=silent)
    assert (row.first().retired, row.first().conflicts, row.first().held_question) == (1, 0, 0)


def test_one_live_run(spark, tmp_path):
    beliefs = spark.createDataFrame([], LINE)
    edges = spark.createDataFrame([], "from_id long, to_id long, relation string, active boolean")
    decisions = spark.createDataFrame([], "incoming long, candidates array<long>, key string, resolved_at timestamp")
    past = spark.createDataFrame([], "started_at int, acted boolean")
    ledger, runs = Ledger(spark, str(tmp_path / "a"), O.ACTIONS), Ledger(spark, str(tmp_path / "b"), O.RUN)
    assert ledger.lease("reconcile", "dead", 0, O.STALE_SECONDS)  # a run that was killed
    go = lambda run, clock: O.reconcile(run, beliefs, edges, decisions, past, ledger, runs, F.lit(NOW), clock, True)
    with pytest.raises(O.RunGoing):
        go("next", 1799.0)
    assert go("next", 1800.0)[0].first().status == "success"
    assert {(r.run, r.status) for r in runs.read().collect()} == {("dead", "aborted"), ("next", "success")}
    assert ledger.holder("reconcile") is None


def test_entity_questions(spark):
    aliases = spark.createDataFrame([(1, 10, 99, "ann"), (2, 77, 98, "bob"), (3, 10, 97, "cyd")], "id long, canonical_id long, entity_id long, name_key string")
    entities = spark.createDataFrame([(10, "Ann Lee"), (11, "cyd")], "id long, name string")
    merges = spark.createDataFrame([(5, 11, None), (6, 12, None), (7, 10, "x")], "id long, source_id long, reverted_at string")
    got = {(r["class"], r.subject) for r in O.entity_questions(aliases, entities, merges, F.lower("name")).collect()}
    assert got == {("entity_alias_orphan", 2), ("entity_alias_shadow", 3), ("entity_merge_incomplete", 5)}


def test_answers_to_possible_contradictions(spark):
    found = spark.createDataFrame([(1, 10, 20, "r", 5), (2, 11, 21, "r", 6), (3, 12, 22, "r", 7)], "found long, id long, candidate long, reason string, found_at int")
    answers = spark.createDataFrame([(1, 5, "approved"), (1, 9, "rejected"), (2, 1, "rejected"), (9, 1, "approved")], "found long, seq long, decision string")
    conflicts, pairs, refused = O.answered(found, answers)
    assert [tuple(r) for r in conflicts.collect()] == [(10, [20], "r")]
    assert sorted(map(tuple, pairs.collect())) == [(10, 20, "approved"), (11, 21, "rejected")]
    assert sorted(map(tuple, refused.collect())) == [(1, 9), (9, 1)]
    beliefs = spark.createDataFrame([(12, "a", "active", [1.0, 0.0]), (22, "b", "active", None)], "id long, content string, status string, vec array<double>")
    assert [(r.found, r.similarity, r.place) for r in O.possible_contradictions(found, answers, beliefs).collect()] == [(3, None, 1)]
    assert O.possible_contradictions(found, answers, beliefs.withColumn("status", F.lit("stale"))).count() == 0


# embeddings


def test_reembedding(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = [(i, f"text {i}" if i % 7 else None, [1.0, 2.0] if i % 3 else None) for i in range(60)]
    store.write("beliefs", spark.createDataFrame(rows, "id long, content string, embedding array<double>"))
    folder = tmp_path / "calls"
    folder.mkdir()

    def provider(name, bad=(), dims=2, folder=folder):
        def embed(texts):
            numbers = [int(t.split()[1]) if t else 0 for t in texts]
            if set(numbers) & set(bad):
                raise RuntimeError("down")
            noted(folder, numbers)
            return [[float(n)] * dims for n in numbers]

        return E.Provider(dims, name, embed)

    old, new, other = provider("old"), provider("new"), provider("other")
    E.guard(store, old)
    E.guard(store, old)
    with pytest.raises(E.WrongSpace):
        E.guard(store, new)
    E.guard(store, new, tolerate=True)
    with pytest.raises(ValueError, match="numbers"):
        E.reembed(store, {"beliefs": "content"}, provider("wide", dims=3))
    with pytest.raises(Exception, match="down"):
        E.reembed(store, {"beliefs": "content"}, provider("new", bad=[33]), pages=6)
    with pytest.raises(E.WrongSpace) as refused:
        E.guard(store, old)  # some vectors are missing, whoever asks
    assert refused.value.unfinished
    before = calls(folder)
    assert store.read("beliefs").filter("embedding = array(1d, 2d)").count() == 40  # as it was
    assert E.reembed(store, {"beliefs": "content"}, new, pages=6) == {"outcome": "reembedded", "from": "old", "to": "new", "rows": {"beliefs": 60}}
    # each text once over both, but for those of the page that failed
    page = {r.id: r.p for r in spark.range(60).select("id", F.pmod(F.xxhash64("id"), F.lit(6)).alias("p")).collect()}
    twice = list(calls(folder))
    for i in range(60):
        twice.remove(i if i % 7 else 0)
    assert len(before) > 0 and {i for i in twice if i} <= {i for i in page if page[i] == page[33]}
    assert all(r.embedding == [float(r.id if r.id % 7 else 0)] * 2 for r in store.read("beliefs").collect())
    E.guard(store, new)
    assert E.reembed(store, {"beliefs": "content"}, new)["outcome"] == "up-to-date"
    # a change that is not finished can turn to another provider
    with pytest.raises(Exception, match="down"):
        E.reembed(store, {"beliefs": "content"}, provider("third", bad=[33]), pages=6)
    assert E.reembed(store, {"beliefs": "content"}, other, pages=6)["from"] == "new"
    E.guard(store, other)
    with pytest.raises(Exception, match="something else"):
        E.embedded(store.read("beliefs").drop("embedding"), "content", E.Provider(4, "x", old.embed)).collect()


# voices


def test_voice_matches_like_one_after_another(spark):
    rng = np.random.default_rng(17)
    base = rng.normal(size=(6, 5))
    voices = [(d, f"s{k}", 20.0 if k else 5.0, (base[rng.integers(6)] + 0.35 * rng.normal(size=5)).tolist()) for d in range(12) for k in range(6)]
    prints = [(f"n{k % 5}", (base[k % 6] + 0.3 * rng.normal(size=5)).tolist()) for k in range(14)]
    sim = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    want = []
    for d in range(12):
        pairs = {}
        for doc, s, seconds, v in voices:
            for n, p in prints:
                if doc == d and seconds >= 10 and sim(v, p) >= 0.8:
                    pairs[s, n] = max(pairs.get((s, n), 0), sim(v, p))
        taken = set()
        for (s, n), x in sorted(pairs.items(), key=lambda i: (-i[1], i[0])):
            if not {s, n} & taken:
                taken |= {s, n}
                want.append((d, s, n, x))
    found = A.voice_matches(spark.createDataFrame(voices, "document long, speaker string, seconds double, vec array<double>"), spark.createDataFrame(prints, "name string, vec array<double>"))
    assert sorted((r.document, r.speaker, r.name, r.similarity) for r in found.collect()) == sorted(want) and len(want) > 15


# related entities


@pytest.mark.parametrize("heavy", [3, 12, 10_000])
def test_related_entities_of_heavy_sources(spark, heavy):
    """The same rows whether pairs of large sources are made or not."""
    rng = random.Random(23)
    edges = {(s, 100 + rng.randrange(40)) for s in range(30) for _ in range(rng.randrange(1, 6))} | {(50 + s, 100 + e) for s in range(3) for e in range(40) if e % (s + 2)}
    typed = [(100 + rng.randrange(40), 100 + rng.randrange(40), rng.random(), rng.random() < 0.8) for _ in range(30)]
    kinds = {100 + e: "person" if e % 3 else "place" for e in range(38)}  # two entities are gone
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    entities = frame([(e, f"e{e % 7}", k) for e, k in kinds.items()], "id long, name string, entity_type string")
    mentions = frame([(a, b, "mention", True) for a, b in edges] + [(1, 101, "mention", False), (1, 102, "about", True)], "from_id long, to_id long, relation string, active boolean")
    links = frame(typed, "from_id long, to_id long, confidence double, active boolean")
    aliases = frame([(101, "b"), (101, "a")], "canonical_id long, name string")
    for kind in (None, "person"):
        want = []
        sources = {e: {a for a, b in edges if b == e} for e in range(100, 140)}
        for t in kinds:
            found = []
            for o, k in kinds.items():
                stated = [(a == t) for a, b, _, on in typed if on and {a, b} == {t, o} and a != b]
                both = len(sources[t] & sources[o])
                if o != t and (both or stated) and kind in (None, k):
                    found.append((not stated, -both, -len(sources[o]), f"e{o % 7}", o, sum(stated), len(stated)))
            want += [(t, o, n, out, n - out, -b, len(found), max(0, len(found) - 5), p) for p, (_, b, _, _, o, out, n) in enumerate(sorted(found)[:5], 1)]
        rows = G.related_entities(entities.select("id"), entities, mentions, links, 5, kind, aliases, heavy).collect()
        assert sorted((r.target, r.other, r.links, r.outgoing, r.incoming, r.shared, r.total, r.truncated, r.place) for r in rows) == sorted(want)
        assert all(r.aliases == (["a", "b"] if r.other == 101 else []) for r in rows)


def test_a_source_of_very_many_mentions(spark):
    """One source with 30,000 mentions: far from its square of rows."""
    edges = spark.range(30_000).selectExpr("0L as from_id", "id as to_id", "'mention' as relation", "true as active")
    entities = spark.range(30_000).selectExpr("id", "'n' || id % 10 as name")
    links = spark.createDataFrame([], "from_id long, to_id long, confidence double, active boolean")
    rows = G.related_entities(entities.select("id"), entities, edges, links)
    got = rows.agg(F.count("*").alias("n"), F.min("total").alias("total"), F.min("shared").alias("shared")).first()
    assert (got.n, got.total, got.shared) == (30_000 * 50, 29_999, 1)


# crowded blocks of names


def test_crowded_blocks_lose_no_likely_pair(spark):
    rng = random.Random(29)
    first = ["".join(rng.choice("abc") for _ in range(rng.randrange(2, 8))) for _ in range(160)]
    names = [f"{f} {rng.choice(['smith', 'Smith', 'smiht', 'smith jr', 'q smith'])}" for f in first] + ["smith", "Smith!", "al smith", "al b smith", "al b c d smith"] + ["x1", "x2", "x-1", "x 1"]
    rows = [(i, n, rng.choice(["person", "org"]), 1, [1.0, rng.random()]) for i, n in enumerate(names)]
    entities = N.prepared(spark.createDataFrame(rows, "id long, name string, entity_type string, mentions long, vec array<double>"))
    found = []
    for crowded in (10_000, 5):
        judged = N.judge(N.block_pairs(entities, crowded), entities).filter("verdict <> 'reject'")
        found.append(sorted(map(tuple, judged.collect())))
    assert found[0] == found[1] and len(found[0]) > 50 and {v[4] for v in found[0]} >= {"phrase", "edit", "same_key"}


def test_a_token_of_very_many_names(spark):
    rows = spark.range(20_000).selectExpr("id", "substring(sha2(cast(id as string), 256), 1, 14) || ' smith' as name", "'person' as entity_type", "1L as mentions", "array(1d) as vec")
    assert N.block_pairs(N.prepared(rows)).count() < 200_000  # of 200 million
