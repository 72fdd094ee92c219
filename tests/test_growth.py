"""What has to grow no faster than the input."""

import random
import tracemalloc
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.checkpoints import shared_dir
from tarn.functions import vectors as V
from tarn.functions.text import quote_found
from tarn.llm import decontaminate, language, near_dup, packing, pii
from tarn.operators import index_pass as I
from tarn.operators import recheck as H
from tarn.operators import reconcile as C
from tarn.operators import runs as O
from tarn.operators import vocabulary as U
from tarn.plans import fixtures as X
from tarn.plans import run_queries as R
from tarn.sources.ledger import Ledger

# the schema's registry


def one_event_after_another(events):
    """The registry and the refusals by a plain loop."""
    held, refused = {}, []
    for seq, kind, name, op, value in sorted(events):
        tier, status, text, n = held.get((kind, name), (None, None, None, 0))
        why = None
        if op == "seed" and tier is None:
            tier, status = "system", "active"
        elif op == "propose" and tier is None:
            tier, status, n = "proposed", "active", 1
        elif op == "propose" and (tier, status) == ("proposed", "active"):
            n += 1
        elif op == "add":
            tier, status, text = "user", "active", value
        elif op in ("approve", "dismiss") and tier != "proposed":
            why = "no pending proposal"
        elif op == "approve":
            tier, status = "user", "active"
        elif op == "dismiss":
            status = "dismissed"
        elif op in ("status", "delete") and tier is None or op == "status" and tier == "proposed":
            why = "no such entry"
        elif op == "status":
            status = value
        elif op == "delete" and tier != "user":
            why = "system entries can only be disabled" if tier == "system" else "proposals are approved or dismissed"
        elif op == "delete" and status != "disabled":
            why = "only disabled entries can be deleted"
        elif op == "delete":
            tier, status, text, n = None, None, None, 0
        held[kind, name] = (tier, status, text, n)
        refused += [(kind, name, seq, op, why)] if why else []
    return sorted((*k, *v) for k, v in held.items() if v[0]), sorted(refused)


def test_registry_of_a_hot_name_is_folded_in_ranges(spark):
    rng = random.Random(8)
    ops = ["seed", "propose", "propose", "add", "approve", "dismiss", "status", "status", "delete", "delete"]
    events = []
    for seq in range(3000):
        op = rng.choice(ops if seq % 7 else ["propose"])
        value = rng.choice(["active", "disabled", "disabled", "hidden"]) if op == "status" else f"said {seq}" if op == "add" else None
        events.append((seq, "predicate", "hot" if rng.random() < 0.9 else f"cold {rng.randrange(40)}", op, value))
    df = spark.createDataFrame(events, "seq long, kind string, name string, op string, value string")
    states = U.folded(df, rows=100)
    ranges = states.filter("name = 'hot'").select(F.shiftright("place", 32).alias("r")).distinct().count()
    assert ranges > 10  # no task holds a whole name
    entries, refused = one_event_after_another(events)
    got = sorted((tuple(r) for r in U.registry(states).select("kind", "name", "tier", "status", "description", "occurrences").collect()), key=lambda r: r[:2])
    assert got == entries
    assert sorted(tuple(r) for r in U.refusals(states).collect()) == refused
    assert U.registry(U.folded(df.limit(0))).collect() == []


def test_walks_of_a_range_go_on_as_one_once_they_met(monkeypatch):
    """Of 20,000 events, all but the first thousand are walked once instead of from each of the 13 states."""
    rng, steps, walk = random.Random(4), [], U._walk
    symbols = np.array([rng.randrange(len(U.SYMBOLS)) for _ in range(20_000)])
    want = [np.array(walk(symbols.tolist(), s)) for s in range(len(U.STATES))]
    monkeypatch.setattr(U, "_walk", lambda part, s: steps.append(len(part)) or walk(part, s))
    events = pa.table({"kind": ["k"] * len(symbols), "name": ["hot"] * len(symbols), "seq": range(len(symbols)), "_range": pa.array([0] * len(symbols), pa.int32())})
    monkeypatch.setattr(U, "_sorted", lambda e: (e, symbols, np.array([0, len(symbols)])))
    (row,) = U._edges(events).to_pylist()
    assert row["ends"] == [w[-1] for w in want] and row["born"] == [U.BORN[symbols, w[:-1]].sum() for w in want]
    assert sum(steps) <= len(symbols) + 12 * 1000
    still = np.array([U.SYMBOLS.index(("propose", None))] * 2500)  # walks that never meet
    want = [np.array(walk(still.tolist(), s)) for s in range(len(U.STATES))]
    assert U._leads(still) == ([w[-1] for w in want], [U.BORN[still, w[:-1]].sum() for w in want])


def test_events_of_the_registry_take_few_parts_however_many_there_are(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    parts, orders = spark.read.parquet(f"{src}/part.parquet"), spark.read.parquet(f"{src}/orders.parquet")
    more = parts.withColumn("p_partkey", F.col("p_partkey") + 1_000_000)
    parts.unionByName(more).write.parquet(f"{tmp_path}/part.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the table were larger than any threshold
    try:
        rows = R._events(spark, str(tmp_path))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        got = rows.select("seq", "entity", "from_name", "to_name").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    named = {r.p_partkey: r.p_name for r in parts.collect()}
    want = []
    for r in orders.collect():
        one, two = named.get(1 + r.o_orderkey % 40), named.get(1 + r.o_orderkey % 37)
        if one is not None and two is not None:
            odd = r.o_custkey % 2
            want.append((r.o_orderkey, None if odd or not r.o_custkey % 5 else one, one if odd else None, two if odd else None))
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_approved_examples_of_a_hot_name(spark):
    """A proposal whose examples lie in many ranges: the first 20 different ones of the life that was approved."""
    events = [(i, "entity_type", "hot", "propose", None, f"Entity {i % 45}") for i in range(1, 400)]
    events += [(400, "entity_type", "hot", "approve", None, None), (401, "entity_type", "hot", "status", "disabled", None), (402, "entity_type", "hot", "delete", None, None)]
    events += [(403 + i, "entity_type", "hot", "propose", None, f"Later {i % 3}") for i in range(100)] + [(600, "entity_type", "hot", "approve", None, None)]
    df = spark.createDataFrame(events, "seq long, kind string, name string, op string, value string, entity string")
    none = F.lit(None).cast("string")
    df = df.withColumn("from_name", none).withColumn("to_name", none).withColumn("confidence", F.lit(0.9)).withColumn("source", F.col("seq"))
    states = U.folded(df, rows=30)
    got = sorted((r.approved, r.seq, r.entity) for r in U.approved_examples(states, df).collect())
    assert got == [(400, i, f"Entity {i}") for i in range(1, 21)] + [(600, 403 + i, f"Later {i}") for i in range(3)]
    assert U.refusals(states).collect() == []
    entities = spark.createDataFrame([(7, "Entity 3")], "id long, name string")
    rest = spark.createDataFrame([], "canonical_id long, name string, from_id long, to_id long, relation string, active boolean")
    linked = U.materialised(U.approved_examples(states, df), entities, rest, rest, df.select(F.col("seq").alias("id")).filter("id % 2 = 0"))[2]
    assert sorted((r.approved, r.entities, r.edges) for r in linked.collect()) == [(400, 10, 0), (600, 1, 0)]


# index passes


def test_jobs_of_an_index_pass_do_not_grow_with_its_waves(spark, tmp_path):
    assert I.rounds(300, 128) == [0, 1, 2, 4, 8, 16, 32, 64, 128, 256] and I.rounds(0) == [] and I.rounds(3) == [0, 1, 2]
    waves = spark.range(600).select("id", I.round_of(F.col("id"), 128).alias("k")).groupBy("k").agg(F.min("id").alias("first")).orderBy("k").collect()
    assert [(r.k, r.first) for r in waves] == list(enumerate(I.rounds(600, 128)))
    now = F.lit("2024-06-01").cast("timestamp")
    beliefs = spark.range(400).select("id", F.concat(F.lit("Text "), F.col("id")).alias("content"), F.lit("active").alias("status"), now.alias("created_at"))
    chunks = spark.createDataFrame([], "id long, content string, title string, heading string, chunk_index int, session string, created_at timestamp")
    ledger = Ledger(spark, str(tmp_path), I.OUTCOMES)

    def extract(bad):
        return lambda batch: [{"error": "down"} if i["id"] in bad else {"entities": [], "links": []} for i in batch]

    # 100 waves of 4; the lane of wave 20 (ids 80-95, of the round of waves 16-31) stops at its fifth failure
    go = lambda run, bad: I.index_pass(run, beliefs, chunks, extract(bad), ledger, wave=8, lane=8, batch=2).first()
    row = go("a", {*range(160, 167), 250})
    seen = {r.id for r in ledger.read("a-wave-").collect()}
    assert row.status == "interrupted" and seen == set(range(166)) and len(ledger.parts("a-wave-")) == 6
    row = go("b", ())
    left = {i for i in range(400)} - set(range(160))
    assert (row.status, row.total, row.memories) == ("success", len(left), len(left)) and len(ledger.parts("b-wave-")) == 6
    assert sorted(r.id for r in ledger.read("b-wave-").collect()) == sorted(left)


# packing


def test_runs_are_encoded_some_at_a_time(monkeypatch):
    made = packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    texts = pa.array([" ".join(f"run{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(9000)), "one, two", None])
    want = [x for t in texts.to_pylist() for x in [*made.library.encode(t or "", add_special_tokens=False).ids, 0]]
    asked = []

    class Library:
        def encode_batch_fast(self, runs, add_special_tokens):
            asked.append(len(runs))
            return library.encode_batch_fast(runs, add_special_tokens=add_special_tokens)

    library, made.library = made.library, Library()
    ids, first = made.texts(texts)
    assert ids.tolist() == want and len(first) == 4
    assert max(asked) <= 4096 and len(asked) > 1


# personal data


def test_personal_data_is_replaced_in_slices_of_texts():
    """Peak of what a worker holds for a batch of 13 MB of text beyond the batch and its result, whose slices go on as they are made."""
    rng = random.Random(2)
    texts = [" ".join(f"word{rng.randrange(3000)}" for _ in range(300)) + f" mail a{i}@example.org" for i in range(5200)]
    ids, none = pa.array(range(len(texts)), pa.int64()), pa.nulls(len(texts), pa.list_(pa.struct([("kind", pa.string()), ("form", pa.string()), ("attempt", pa.int32())])))
    row = pa.StructArray.from_arrays([ids], ["_"])
    two = pa.RecordBatch.from_arrays([ids, pa.array(texts)], ["doc_id", "text"])
    four = pa.RecordBatch.from_arrays([ids, row, pa.array(texts), none], ["doc_id", "row", "text", "special"])
    del texts
    for work in (lambda: pii._found(iter([two])), lambda: pii._rewrite(b"key", {}, iter([four]))):
        tracemalloc.start()
        rows = sum(b.num_rows for b in work())
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == 5200 and peak < 6e6


# entities


@pytest.mark.parametrize("few", [0, 1 << 30])
def test_rows_are_not_broadcast_to_their_vectors(spark, monkeypatch, few):
    """Parts lie in so small files that Spark would send all of them through the driver, once for each use."""
    monkeypatch.setattr(X, "FEW_VECTORS", few)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = X.ent(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sent = [line for line in plan.splitlines() if "BroadcastExchange" in line]
    assert len(sent) == (1 if few else 0)
    if few:  # the vectors' side: what comes under the exchange
        assert "part.parquet" not in plan[plan.index("BroadcastExchange") :]


# the pipeline


def test_slices_of_texts_take_little_memory():
    """Peak of the arrays that a worker holds for a batch of 6.5 MB of text."""
    rng = random.Random(1)
    texts = [" ".join(f"word{rng.randrange(3000)}" for _ in range(300)) for _ in range(2600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    items = decontaminate.Items.of([1], [texts[0]])
    for work in (lambda: decontaminate._keep(items, 0.5, 1, iter([batch])), lambda: near_dup._sign(iter([batch])), lambda: near_dup._sets(iter([batch]))):
        tracemalloc.start()
        rows = sum(b.num_rows for b in work())
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows >= len(texts) - 1 and peak < 40e6


def test_language_is_told_in_slices_of_texts():
    rng = random.Random(3)
    texts = [" ".join(f"word{rng.randrange(3000)}" for _ in range(300)) for _ in range(1300)]
    none, matrix = pa.nulls(len(texts), pa.bool_()), np.log(np.full((language.BUCKETS, 2), 0.5, np.float32))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), none], ["doc_id", "text", "held_out"])
    language.letters()
    tracemalloc.start()
    assert sum(b.num_rows for b in language._score(["de", "en"], matrix, iter([batch]))) == len(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6


# vectors


def like_brute_force(rows, queries, k, least):
    want = []
    for qid, x, h, root in queries:
        found = [(-round(float(x @ y), 9), src, i) for src, i, y, g, r in rows if g != h and r != root and i != qid]
        want += [(qid, src, i) for s, src, i in sorted(f for f in found if -f[0] >= least)[:k]]
    return sorted(want)


@pytest.mark.parametrize("hot", ["nothing", "a vector", "a text"])
def test_vectors_that_repeat_are_compared_once(spark, monkeypatch, hot):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(30, 4))
    points = points / np.sqrt((points**2).sum(axis=1))[:, None]
    vec = lambda i: points[0 if hot == "a vector" and i % 3 else i % 30]
    text = lambda i: f"h{0 if hot == 'a text' and i % 7 else i % 200}"
    made = [("s" if i % 4 else "t", i, vec(i), text(i), str(i // 3)) for i in range(400)]
    rows = spark.createDataFrame([(s, i, v.tolist(), h, r) for s, i, v, h, r in made], "src string, id long, vec array<double>, content_hash string, root_id string")
    queries = rows.select(F.col("id").alias("qid"), "vec", "content_hash", "root_id")
    compared = []
    met = V._met
    monkeypatch.setattr(V, "_met", lambda r, q, s: (compared.append((r.count(), q.count())), met(r, q, s))[1])
    got = V.nearest(rows, queries, 6, 0.5, block=10, unlike=("content_hash", "root_id"), others=True)
    assert sorted((r.qid, r.src, r.id) for r in got.collect()) == like_brute_force(made, [(i, v, h, r) for _, i, v, h, r in made], 6, 0.5)
    assert compared[0] == (len({tuple(v) for _, _, v, _, _ in made}),) * 2
    if hot != "a text":
        assert all(r <= 30 and q <= 30 for r, q in compared)


def test_scores_of_a_task_take_little_memory():
    rng = np.random.default_rng(6)
    block = lambda n: pa.array(list(rng.normal(size=(n, 8))), pa.list_(pa.float64()))
    queries = pa.table([pa.array(range(5000)), block(5000)], ["qid", "vec"])
    rows = pa.table([pa.array([""] * 9000), pa.array(range(9000)), block(9000)], ["src", "id", "vec"])
    tracemalloc.start()
    assert V.Search(5, None, False, False).block(queries, rows).num_rows == 25000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6  # all scores at once: 360 MB, three times over


# re-check runs


def test_no_stored_table_of_a_recheck_holds_candidates_texts(spark, tmp_path):
    """Each belief has up to 20 candidates: stored with their texts, they took many times the space of the store."""
    now = F.lit("2024-06-01").cast("timestamp")
    beliefs = spark.range(40).select(
        "id", F.concat(F.lit("a long text of belief number "), F.col("id")).alias("content"), F.concat(F.lit("h"), F.col("id")).alias("content_hash"), F.col("id").alias("root_id"),
        F.lit("active").alias("status"), F.array(F.lit(1.0), F.col("id") / 100).alias("vec"), now.alias("asserted_at"), F.lit(None).cast("timestamp").alias("last_rechecked_at"),
    )
    none, pairs = spark.createDataFrame([], "incoming long, candidates array<long>"), spark.createDataFrame([], "a long, b long")
    tables = Path(shared_dir(spark)) / "tarn"
    tables.mkdir(exist_ok=True)
    before = set(tables.iterdir())
    ask = H.scripted(lambda q: {"reply": [{"candidate": 2, "relation": "contradictory", "new_quote": q["content"], "old_quote": q["candidates"][1]}], "input_tokens": 1, "output_tokens": 1, "usd": 0.1})
    row = H.recheck_run("r", beliefs, pairs, none, ask, Ledger(spark, str(tmp_path), H.OUTCOMES), now, window=100).first()
    assert (row.calls, row.claimed, row.possible, row.remaining) == (40, 40, 40, 0)
    made = {p.name.split("-")[0]: spark.read.parquet(str(p)).columns for p in set(tables.iterdir()) - before if p.name.split("-")[0] in ("neighbours", "answers")}
    assert set(made) == {"neighbours", "answers"} and not {"content", "candidates", "texts"} & {c for columns in made.values() for c in columns}


def test_subjects_of_one_vector_share_their_candidates_texts(spark, tmp_path):
    """Each is asked about with its own candidates' texts, and no table that a re-check stores holds a text."""
    now = F.lit("2024-06-01").cast("timestamp")
    beliefs = spark.range(40).select(
        "id", F.concat(F.lit("text "), F.col("id")).alias("content"), F.concat(F.lit("h"), F.col("id")).alias("content_hash"), F.col("id").alias("root_id"),
        F.lit("active").alias("status"), F.array(F.lit(1.0), F.col("id") % 4 / 100).alias("vec"), now.alias("asserted_at"), F.lit(None).cast("timestamp").alias("last_rechecked_at"),
    )
    subjects = beliefs.withColumn("place", F.col("id"))
    near = H.near_pairs(beliefs, subjects, spark.createDataFrame([], "a long, b long"))
    asked = H.with_texts(beliefs, subjects, near)
    rows = asked.collect()
    assert len(rows) == 40 and all(r.content == f"text {r.id}" and len(r.candidates) == 20 for r in rows)
    assert all(c.content == f"text {c.id}" and c.id != r.id for r in rows for c in r.candidates)
    assert [[c.id for c in r.candidates] for r in rows] == [[c.id for c in sorted(r.candidates, key=lambda c: c.rank)] for r in rows]
    tables = Path(shared_dir(spark)) / "tarn"
    before = set(tables.iterdir())
    none, pairs = spark.createDataFrame([], "incoming long, candidates array<long>"), spark.createDataFrame([], "a long, b long")
    H.recheck_run("r", beliefs, pairs, none, H.scripted(lambda q: {"reply": []}), Ledger(spark, str(tmp_path), H.OUTCOMES), now, window=100)
    assert not {"content", "candidates", "texts"} & {c for p in set(tables.iterdir()) - before for c in spark.read.parquet(str(p)).columns}


# shadowed aliases


def test_shadow_classes_tell_all_pairs(spark):
    entities = spark.createDataFrame([(i, f"Name {i % 4}") for i in range(40)] + [(99, "Alone")], "id long, name string")
    aliases = spark.createDataFrame([(i, (i * 7) % 50, f"name {i % 5}") for i in range(60)] + [(70, 99, "alone")], "id long, canonical_id long, name_key string")
    key = F.lower("name")
    pairs = C.alias_shadows(aliases, entities, key).groupBy("id").count().collect()
    classes = C.alias_shadow_classes(aliases, entities, key).collect()
    assert sorted((r.id, r.links) for r in classes) == sorted((r["id"], r["count"]) for r in pairs)
    assert all(r.class_id == r.id % 5 for r in classes) and len(classes) == 48


def test_shadows_of_one_name_are_spread_over_tasks(spark):
    """Small tables of a file each met in one task, whatever the number of pairs."""
    key = F.lower("name")
    entities = spark.range(9000).selectExpr("id", "if(id % 3000 = 1, null, if(id < 8995, 'Hot', concat('n', id))) as name").coalesce(1)
    aliases = spark.range(5000).selectExpr("id", "if(id % 1000 = 2, null, id * 3) as canonical_id", "if(id < 4990, 'hot', concat('n', id + 4000)) as name_key").coalesce(1)
    pairs = C.alias_shadows(aliases, entities, key)
    met = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] > 0 for r in met) > 1
    plain = aliases.join(entities.select(key.alias("name_key"), F.col("id").alias("entity")), "name_key").filter("entity <> canonical_id").select("id", "entity")
    marks = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("id", "entity").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("entity", "id"))).first()
    assert pairs.columns == plain.columns and marks(pairs) == marks(plain)


def test_questions_on_entities_make_no_pairs(spark, monkeypatch):
    aliases = spark.createDataFrame([(1, 10, 20, "a"), (2, 11, 21, "b"), (3, 12, 22, "c")], "id long, canonical_id long, entity_id long, name_key string")
    entities = spark.createDataFrame([(10, "A"), (11, "x"), (12, "y"), (13, "b"), (14, "b")], "id long, name string")
    merges = spark.createDataFrame([], "id long, source_id long, reverted_at timestamp")
    monkeypatch.setattr(C, "alias_shadows", None)
    asked = O.entity_questions(aliases, entities, merges, F.lower("name")).collect()
    assert [(r["class"], r["subject"]) for r in asked] == [("entity_alias_shadow", 2)]


# vectors and texts of large re-checks


def test_a_vector_is_sent_once_to_all_cells_of_a_part(spark, monkeypatch):
    """Where cells keep nothing apart, each vector was sent once for each cell."""
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([("m", i, v) for i, v in enumerate(rng.normal(size=(900, 8)).tolist())], "src string, id long, vec array<double>")
    monkeypatch.setattr(V, "BLOCK", 60)
    asked, given, near = V._dealt(rows, rows.select(F.col("id").alias("qid"), "vec"), 0.5)
    assert len(near) == 60 and near.mean() > 0.5
    assert asked.count() <= 5 * 900 and given.count() <= 5 * 900
    pairs = asked.select("q_id", "q_part", "r_part").join(given.select("id", "q_part", "r_part"), ["q_part", "r_part"])
    assert pairs.count() == pairs.select("q_id", "id").distinct().count()


@pytest.mark.parametrize("least", [None, 0.2, 0.9])
@pytest.mark.parametrize("tile", [(256, 4096), (7, 30)])
def test_scores_in_single_precision_lose_nothing(monkeypatch, least, tile):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(V, "TILE", tile)
    points = rng.normal(size=(300, 5)).astype(np.float32)
    points[::3] = points[0] + rng.normal(size=(100, 5)) * 1e-7
    points[7] = 0
    block = pa.array(points.tolist(), pa.list_(pa.float32()))
    kinds = pa.array([str(i % 9) for i in range(300)])
    queries = pa.table([pa.array(range(300)), block, kinds], ["qid", "vec", "kind"])
    rows = pa.table([pa.array(["s"] * 300), pa.array(range(300)), block, kinds], ["src", "id", "vec", "kind"])
    search = V.Search(6, least, False, True)
    plain = pa.Table.from_batches(list(search.over(queries, rows.to_batches())))

    def best(found):  # rows of equal similarity are told apart later
        out = {}
        for q, i, s in zip(found["qid"].to_pylist(), found["id"].to_pylist(), found["similarity"].to_pylist(), strict=True):
            out.setdefault(q, []).append((-round(s, 9), i))
        return {q: sorted(x)[:6] for q, x in out.items()}

    assert best(search.block(queries, rows)) == best(plain)


def test_findings_copy_no_texts(spark):
    """An item's row took the texts of all candidates along."""
    replies = spark.createDataFrame(
        [
            (1, "one  two three FOUR five six", [(7, "seven eight nine ten eleven", 0.9), (8, "x", 0.8)],
             '[{"candidate": 1, "relation": "contra", "new_quote": "one two Three four", "old_quote": "EIGHT nine ten"}, {"candidate": 1, "relation": "CONTRA", "new_quote": "one two three four", "old_quote": "made up by itself"}, 5]', None),
            (2, "text", [(9, "y", 0.7)], "no list", None),
            (3, "text", [(9, "y", 0.7)], None, "down"),
        ],
        "id long, content string, candidates array<struct<id: long, content: string, similarity: double>>, reply string, error string",
    ).selectExpr("*", "1L as input_tokens", "2L as output_tokens", "0.5D as usd")
    found = H.findings(replies)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r for r in found.collect()}
    assert [f.candidate for f in got[1].findings] == [] and got[1].claimed == 2  # a quote of fewer than 15 characters
    assert (got[2].claimed, got[2].findings, got[3].claimed, got[3].findings, got[3].error) == (0, [], None, None, "down")


def test_quotes_as_by_one_form_of_the_whole_text(spark):
    letters = ["a", "B", "σ", "Σ", "İ", "K", "k", "é", " ", "  ", "\n", " ", "1", "-"]
    rng = random.Random(4)
    made = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rows = []
    for _ in range(400):
        text = made(40)
        at = rng.randrange(20)
        part = text[at : at + rng.randrange(3, 20)]
        rows += [(text, part), (text, part.upper()), (text, part.lower()), (text, part.replace(" ", "\t ")), (text, made(6)), (text, None), (None, part), (text, "")]
    canon = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    plain = (F.length(canon(F.col("quote"))) >= 4) & F.contains(canon(F.col("text")), canon(F.col("quote")))
    df = spark.createDataFrame(rows, "text string, quote string").select(plain.alias("a"), quote_found(F.col("text"), F.col("quote"), 4).alias("b"))
    assert df.filter("not (a <=> b)").count() == 0 and df.filter("a").count() > 400


def test_texts_are_sent_in_waves(spark, tmp_path, monkeypatch):
    now = F.lit("2024-06-01").cast("timestamp")
    beliefs = spark.range(60).select(
        "id", F.concat(F.lit("a long text of belief number "), F.col("id")).alias("content"), F.concat(F.lit("h"), F.col("id")).alias("content_hash"), F.col("id").alias("root_id"),
        F.lit("active").alias("status"), F.array(F.lit(1.0), F.col("id") % 30 / 100).alias("vec"), now.alias("asserted_at"), F.lit(None).cast("timestamp").alias("last_rechecked_at"),
    )
    none, pairs = spark.createDataFrame([], "incoming long, candidates array<long>"), spark.createDataFrame([], "a long, b long")
    ask = H.scripted(lambda q: {"reply": [{"candidate": 2, "relation": "contradictory", "new_quote": q["content"], "old_quote": q["candidates"][1]}], "input_tokens": 1, "output_tokens": 1, "usd": 0.1})
    sent = []
    filled = H._filled
    monkeypatch.setattr(H, "_filled", lambda texts, listed: (sent.append(H._wanted(listed).count()), filled(texts, listed))[1])
    got = []
    for most in (10**6, 100):
        monkeypatch.setattr(H, "TEXTS", most)
        ledger = Ledger(spark, str(tmp_path / str(most)), H.OUTCOMES)
        row = H.recheck_run("r", beliefs, pairs, none, ask, ledger, now, window=100).first()
        assert (row.calls, row.claimed, row.possible, row.remaining) == (60, 60, 60, 0)
        got.append(sorted((r.id, r.candidate) for r in H.possible(ledger, "r").collect()))
    assert got[0] == got[1] and len(sent) > 4 and max(sent[1:]) < sent[0] == sum(sent[1:])


def test_rows_of_a_recheck_go_to_python_in_small_batches(spark, tmp_path):
    """10,000 rows with the texts of 20 candidates each lay in a batch, on both sides."""
    now = F.lit("2024-06-01").cast("timestamp")
    beliefs = spark.range(40).select(
        "id", F.repeat(F.concat(F.lit("text "), F.col("id")), F.lit(20_000)).alias("content"), F.concat(F.lit("h"), F.col("id")).alias("content_hash"), F.col("id").alias("root_id"),
        F.lit("active").alias("status"), F.array(F.lit(1.0), F.lit(0.5)).alias("vec"), now.alias("asserted_at"), F.lit(None).cast("timestamp").alias("last_rechecked_at"),
    )
    none, pairs = spark.createDataFrame([], "incoming long, candidates array<long>"), spark.createDataFrame([], "a long, b long")
    folder = tmp_path / "calls"
    folder.mkdir()

    def ask(questions):
        (folder / f"{questions[0]['id']}").write_text(str(len(questions)))
        return [{"reply": "[]", "input_tokens": 1, "output_tokens": 1, "usd": 0.0}] * len(questions)

    row = H.recheck_run("r", beliefs, pairs, none, ask, Ledger(spark, str(tmp_path / "ledger"), H.OUTCOMES), now, window=100).first()
    sizes = [int(p.read_text()) for p in folder.iterdir()]
    assert row.calls == sum(sizes) == 40 and max(sizes) <= 4  # a row holds 2.9 MB
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
