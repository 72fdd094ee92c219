"""Small cases with known answers, and operations that undo each other."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.functions.vectors import fnv1a, hash_embed, nearest
from tarn.operators import beliefs as B
from tarn.operators import conflicts as K
from tarn.operators import documents as D
from tarn.operators import entities as N
from tarn.operators import graph as G
from tarn.operators import listings as L
from tarn.operators import reconcile as C
from tarn.operators import replies as P
from tarn.operators import recordings as A
from tarn.operators import retrieval as R
from tarn.operators import sessions as S
from tarn.operators.components import components
from tarn.plans import document_queries, graph_queries
from tarn.sources import files
from tarn.sources.store import Store, checked, merged
from tarn.streaming import jobs

DATA = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_fnv_and_hash_embedding():
    assert fnv1a("abc") == 440920331
    assert hash_embed("", 8).sum() == 0
    assert abs((hash_embed("a b c", 64) ** 2).sum() - 1) < 1e-12


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://Ex.COM/A?utm_source=x&b=2#top", "http://ex.com/A?b=2"),
        ("https://ex.com/?gclid=1", "https://ex.com/"),
        ("https://ex.com/p", "https://ex.com/p"),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, T.normalize_url(F.col("u")), u=url) == want


def test_redact(spark):
    text = "key sk-abcdefghijklmnopqrstu, password = hunter2hunter2 and https://me:secretpw@host/x"
    assert one(spark, T.redact(F.col("t")), t=text) == "key [redacted], password = [redacted] and https://me:[redacted]@host/x"
    assert one(spark, T.secret_hits(F.col("t")), t=text) == 3


@pytest.mark.parametrize(
    "text, want",
    [
        ("npm_abcdefghijklmnop1234 x", "[redacted] x"),
        ("Authorization: Bearer abcdefghijklmnop.qrs", "Authorization: [redacted]"),
        ('DB_CREDENTIALS="two words here"', "DB_CREDENTIALS=[redacted]"),
        ("my_token: 'short'", "my_token: 'short'"),
        ('"api_key": "sk-abcdefghijklmnopqrst"', '"api_key": "[redacted]"'),
        ("eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJ ok", "[redacted] ok"),
        ("token=abc", "token=abc"),
    ],
)
def test_redact_shapes(spark, text, want):
    assert one(spark, T.redact(F.col("t")), t=text) == want


@pytest.mark.parametrize("name, want", [("C++", False), ("CI/CD", True), ("TCP/IP", True), ("C++ Builder", True), ("10/2 ab", False), ("a = b c", False), ("g'(2) ab", False), ("Łódź", True), ("x", False), ("one two three four five six", False)])
def test_plausible_names(spark, name, want):
    assert one(spark, T.plausible_name(F.col("t")), t=name) is want


@pytest.mark.parametrize("query, want", [("ref=a&x=1", "?x=1"), ("gbraid=1&wbraid=2&S_KWCID=3", ""), ("dclid=1&yclid=2", "?dclid=1&yclid=2"), ("utm_x.y=1", "")])
def test_tracking_parameters(spark, query, want):
    assert one(spark, T.normalize_url(F.col("t")), t=f"https://a.com/p?{query}") == f"https://a.com/p{want}"
    assert one(spark, T.normalize_url(F.col("t")), t="HTTPS://A.com#x") == "https://a.com/"


def test_run_due(spark):
    def due(hours, idle, indexing=False):
        return one(spark, C.run_due(F.expr("try_cast(h as double)"), F.expr("try_cast(i as double)"), F.lit(indexing)), h=str(hours), i=str(idle))

    assert [due(49, 0), due(37, 0), due(21, 11), due(21, 9), due(19, 60), due("never", 11), due(49, 0, True)] == [True, False, True, False, False, True, False]
    assert [one(spark, C.startup_due(F.expr("try_cast(h as double)")), h=h) for h in ("never", "36", "35")] == [True, True, False]


def test_mentions_only(spark):
    edges = spark.createDataFrame([("b", 1, "mention", True), ("b", 2, "about", True), ("c", 1, "mention", False), ("c", 2, "mention", True)], "from_id string, to_id long, relation string, active boolean")
    names = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, name string")
    assert [(r.id, r.mentions) for r in G.known_entities(names, edges).collect()] == [(1, 1), (2, 1), (3, 0)]
    docs = spark.createDataFrame([("b", 7), ("c", 7)], "from_id string, document long")
    assert sorted((r.to_id, r.weight) for r in G.document_rollup(edges, docs).collect()) == [(1, 1), (2, 1)]


def test_components_past_the_broadcast(spark):
    links = [(100, i) for i in range(101, 400)] + [(i, i + 1) for i in range(30)] + [(399, 1000 + i) for i in range(50)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), few=10, hub=20).collect()}
    assert found == {i: 0 for i in range(31)} | {i: 100 for i in (*range(100, 400), *range(1000, 1050))}


def test_citations_and_names(spark):
    assert one(spark, T.keep_citations(F.col("t"), F.lit(2)), t="a [1] b [3] c [2] [0]") == "a [1] b  c [2] "
    assert one(spark, T.schema_name(F.col("t")), t="  Works At (Co.) ") == "works_at_co"
    assert one(spark, T.plausible_name(F.col("t")), t="f(x)") is False
    assert one(spark, T.plausible_name(F.col("t")), t="Ada Lovelace") is True


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 140)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chunking():
    assert D.chunk_text("  ") == []
    assert D.chunk_text("short") == ["short"]
    long = "\n\n".join("word " * 60 for _ in range(20))
    parts = D.chunk_text(long)
    assert len(parts) > 1 and all(len(p) <= D.TARGET + D.OVERLAP + 1 for p in parts)
    assert all(len(p) <= 50 for p in D.chunk_text("x" * 500, 40, 50, 0))
    made = D.chunk_markdown("intro\n# A\ntext\n```\n# not a heading\n```\n## B\nmore\n# C\n\n")
    assert [p for p, _ in made] == ["", "A", "A > B"]
    assert "# not a heading" in made[1][1] and made[2][1] == "A > B\n\nmore"
    points = D.chunk_outline("CHAPTER  ONE\n1. DEFINITION 3. Let there be points\n2) second point is long enough\n and goes on\n3. O czym\nŚREDNIA\nText under it")
    assert points == [
        ("CHAPTER ONE > 1. DEFINITION 3.", "CHAPTER ONE > 1. DEFINITION 3.\n\n1. DEFINITION 3. Let there be points"),
        ("CHAPTER ONE > 2.", "CHAPTER ONE > 2.\n\n2) second point is long enough\n and goes on"),
        ("CHAPTER ONE > 3.", "CHAPTER ONE > 3.\n\n3. O czym"), ("ŚREDNIA", "ŚREDNIA\n\nText under it"),
    ]
    assert D.chunk_outline("1. a point that is long\nmore") == [("1.", "1.\n\n1. a point that is long\nmore")]
    assert [p for p, _ in D.chunk_outline("tiny\n1. a point that is long")] == ["1."] and D.chunk_outline("tiny") == [("", "tiny")]


def test_reading_order(spark):
    left = [(1, 10.0, 700.0 - 20 * i, 100.0, f"l{i}") for i in range(5)]
    right = [(1, 400.0, 700.0 - 20 * i, 100.0, f"r{i}") for i in range(5)]
    items = [("a", *x) for x in right + left] + [("b", 1, 10.0, 650.0, 50.0, "other")]
    rows = D.reading_order(spark.createDataFrame(items, "document string, page int, x double, y double, w double, text string"), 600.0)
    got = [(r.document, r.text) for r in rows.orderBy("document", "line").collect()]
    assert got == [("a", f"l{i}") for i in range(5)] + [("a", f"r{i}") for i in range(5)] + [("b", "other")]


def test_article():
    html = "<head><title>x</title></head><nav>menu</nav><article><h1>T</h1><p>a <b>b</b></p><script>no</script><ul><li>i</li></ul></article><p>out</p>"
    assert D.article_text(html) == "# T\n\na b\n\n- i"


def test_keyword_phrases_alternatives_and_scripts(spark):
    texts = ["red apple pie", "apple red", "zażółć gęślą", "za gl", "日本 語", "cherry", "Red, APPLE! red"]
    rows = spark.createDataFrame([("m", i, t) for i, t in enumerate(texts)], "src string, id long, text string")
    asked = ['"red apple"', "red apple", "zażółć", "日本", "cherry OR apple pie", 'apple -"red apple"', "-red", '"apple red" or "gl"', "well-read or cherry"]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid long, text string")
    want = {0: {0, 6}, 1: {0, 1, 6}, 2: {2}, 3: {4}, 4: {5, 0}, 5: {1}, 7: {1, 3, 6}, 8: {5}}
    for index in (None, R.postings(rows)):
        got = {}
        for r in R.keyword_arm(rows, queries, index=index).collect():
            got.setdefault(r.qid, {})[r.id] = (r.score, r["rank"])
        assert {q: set(x) for q, x in got.items()} == want
        assert got[1] == {6: (3, 1), 0: (2, 2), 1: (2, 3)}


def test_nearest_by_blocks_like_broadcast(spark, monkeypatch):
    rng = random.Random(31)
    made = [("m", i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)], f"h{i % 7}") for i in range(200)] + [("m", 500, [0.0] * 4, "z"), ("m", 501, None, "z")]
    rows = spark.createDataFrame(made, "src string, id long, vec array<double>, h string")
    queries = rows.select(F.col("id").alias("qid"), "vec", "h")
    monkeypatch.setattr("tarn.functions.vectors.BLOCK", 60)
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    for options in ({}, {"unlike": "h", "others": True}, {"once": True}, {"least": 0.5}):
        got = [{(r.qid, r.id, round(r.similarity, 9)) for r in nearest(rows, queries, 5, block=b, **options).collect()} for b in (1000, 10)]
        want = set()
        for q in made:
            near = [] if not q[2] or not any(q[2]) else [(-round(cosine(q[2], r[2]), 9), r[1]) for r in made if r[2] and any(r[2])]
            near = [x for x in near if not options.get("others") or (x[1] != q[1] and made[x[1]][3] != q[3])]
            near = [x for x in near if -x[0] >= options.get("least", -2)]
            want |= {(q[1], i, -s) for s, i in sorted(near)[:5]}
        assert got == [want, want]


def test_dedup_candidates_beside_copies(spark):
    rows = [(i, [1.0, 0.0], "own", i, "s") for i in range(8)] + [(10 + i, [1.0, 0.1 * i], f"h{i}", i, "s") for i in range(1, 6)]
    rows = spark.createDataFrame(rows, "id long, vec array<double>, content_hash string, root_id long, src string")
    incoming = spark.createDataFrame([(1, [1.0, 0.0], "own")], "qid long, vec array<double>, content_hash string")
    assert [r.id for r in R.dedup_candidates(rows, incoming).orderBy("rank").collect()] == [11, 12, 13, 14, 15]


def test_anchors_beside_many_aliases(spark):
    made = [(1, [1.0, 0.001 * i]) for i in range(90)] + [(k, [1.0, 0.1 * k]) for k in range(2, 7)]
    entities = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(made)], "canonical long, id long, vec array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vec array<double>")
    assert [r.canonical for r in R.entity_anchors(entities, queries).orderBy("distance").collect()] == [1, 2, 3, 4, 5, 6]


def test_recheck_with_many_answered_pairs(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.01 * i], f"h{i}", i, "s") for i in range(40)], "id long, vec array<double>, content_hash string, root_id long, src string")
    due = rows.filter("id = 0").select(F.col("id").alias("qid"), "vec", "content_hash", "root_id")
    answered = spark.createDataFrame([(0, i) for i in range(1, 30)], "a long, b long")
    assert [r.id for r in R.recheck_pairs(rows, due, answered, most=3, spare=5).orderBy("rank").collect()] == [30, 31, 32]


def test_quotes_in_like_brute_force(spark):
    rng = random.Random(33)
    texts = [" ".join(rng.choice(["ab", "cd", "Ab", "abcd", "x\ty"]) for _ in range(12)) for _ in range(60)]
    quotes = [" ".join(t.split()[2:7])[1:] for t in texts[:10]] + ["cd ab", "bcd", "", "never seen in them"]
    flat = lambda t: " ".join(t.split()).lower()
    want = {(q, i) for q, x in enumerate(quotes) for i, t in enumerate(texts) if len(flat(x)) >= 2 and flat(x) in flat(t)}
    sources = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = [(r.qid, r.id) for r in R.quotes_in(sources, spark.createDataFrame(list(enumerate(quotes)), "qid long, quote string"), 2).collect()]
    assert set(got) == want and len(got) == len(want)


def test_in_session(spark):
    chunks = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "id long, session string")
    assert [r.id for r in R.in_session(chunks).collect()] == [1]
    assert [r.id for r in R.in_session(chunks, F.lit("a")).orderBy("id").collect()] == [1, 2]


def test_keyword_negation_and_abstention(spark):
    rows = spark.createDataFrame([("m", 1, "red apple"), ("m", 2, "red pear"), ("m", 3, "green")], "src string, id long, text string")
    queries = spark.createDataFrame([(1, "red -pear"), (2, "blue"), (3, "")], "qid long, text string")
    assert [(r.qid, r.id) for r in R.keyword_arm(rows, queries).collect()] == [(1, 1)]


def test_fuse_weights(spark):
    arm = lambda *ids: spark.createDataFrame([(1, "m", i, k + 1) for k, i in enumerate(ids)], "qid long, src string, id long, rank int")
    got = [r.id for r in R.fuse({"vector": arm(1, 2), "keyword": arm(2)}).orderBy("rank").collect()]
    assert got == [2, 1]


def test_judge(spark):
    names = ["GPT-4", "GPT-5", "React.js", "react", "New York City", "New York", "Straße", "strasse", "Jon Smithson", "John Smithson", "Ann", "ann"]
    rows = spark.createDataFrame([(i, n, "thing", 1, [1.0, float(i)]) for i, n in enumerate(names)], "id long, name string, entity_type string, mentions long, vec array<double>")
    ready = N.prepared(rows)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, len(names), 2)], "a long, b long")
    got = {r.a: (r.verdict, r.reason) for r in N.judge(pairs, ready).collect()}
    assert got[0] == ("reject", "version")
    assert got[2] == ("reject", "extension")
    assert got[4] == ("review", "phrase")
    assert got[8] == ("review", "edit")
    assert got[10] == ("auto", "same_key")


def test_fold_and_unfold(spark):
    edges = spark.createDataFrame([(1, 10, "mention", True), (1, 11, "mention", True), (2, 11, "mention", False)], "from_id long, to_id long, relation string, active boolean")
    folded = N.fold_edges(edges, spark.createDataFrame([(11, 10)], "source long, canonical long"))
    assert sorted((r.from_id, r.to_id, r.active) for r in folded.collect()) == [(1, 10, True), (1, 11, False), (2, 10, False)]
    assert sorted(map(tuple, N.unfold_edges(folded).collect())) == sorted(map(tuple, edges.collect()))


def test_verdicts(spark):
    replies = spark.createDataFrame([(1, [7, 8], 'Sure: [{"candidate": 2, "relation": "Contradicts", "reason": "r"}] ok')], "id long, candidates array<long>, reply string")
    assert [(r.candidate, r.label) for r in B.parse_verdicts(replies).collect()] == [(8, "contradictory")]


def test_related_to_all_like_brute_force(spark):
    of = {}
    for r in spark.read.parquet(f"{DATA}/lineitem.parquet").filter("l_returnflag <> 'R' and l_linenumber % 4 <> 3").select("l_orderkey", "l_partkey").distinct().collect():
        of.setdefault(r.l_orderkey, set()).add(r.l_partkey)
    shared, mentions = {}, {}
    for parts in of.values():
        for a in parts:
            mentions[a] = mentions.get(a, 0) + 1
            for b in parts - {a}:
                shared.setdefault(a, {}).setdefault(b, 0)
                shared[a][b] += 1
    parts = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey", "p_name").collect()}
    # links of suppliers lead to places, which are no parts
    want = set()
    for a, others in shared.items():
        known = [b for b in others if b in parts]
        order = sorted(known, key=lambda b: (-others[b], -mentions[b], parts[b], b))[:50]
        want |= {(a, b, 0, others[b], mentions[b], len(known), k) for k, b in enumerate(order, 1) if a in parts}
    found = graph_queries.related_entities_all(spark, DATA)
    assert {tuple(r) for r in found.collect()} == want and len({w[0] for w in want}) > 100
    assert "strategy=broadcast" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_extracted_links(spark):
    raw = [(1, 0, "Ada", "knows", 0.9, "Bob"), (1, 1, "Ada", "likes", 0.9, "Bob"), (1, 2, "Ada", "knows", 0.2, "Bob"), (1, 3, "Ada", "knows", 0.9, "Ada"), (1, 4, "Ada", "knows", 0.9, "Eve")]
    raw = spark.createDataFrame(raw, "source long, pos int, subject string, predicate string, confidence double, object string")
    known = spark.createDataFrame([(1, "Ada"), (1, "Bob")], "source long, name string")
    got = G.extracted_links(raw, known, spark.createDataFrame([("knows",)], "predicate string")).collect()
    assert sorted((r.pos, r.relation) for r in got) == [(0, "knows"), (1, "mention")]


def test_dedup_candidates_beside_copies_again(spark):
    rows = [("m", i, [1.0, 0.0], "own") for i in range(30)] + [("m", 100 + i, [1.0, 0.1 * i], f"h{i}") for i in range(1, 8)]
    rows = spark.createDataFrame([*rows, ("m", 99, [1.0, 0.0], None)], "src string, id long, vec array<double>, content_hash string")
    incoming = spark.createDataFrame([(1, [1.0, 0.0], "own"), (2, [1.0, 0.0], "new")], "qid long, vec array<double>, content_hash string")
    found = sorted((r.qid, r["rank"], r.id) for r in R.dedup_candidates(rows, incoming).collect())
    assert found == [(1, k, 100 + k) for k in range(1, 6)] + [(2, k + 1, k) for k in range(5)]


def test_anchors_beside_many_aliases_again(spark):
    rows = [(i, 1, [1.0, 0.001 * i]) for i in range(90)] + [(100 + k, k, [1.0, 0.02 * k + 0.1]) for k in range(2, 14)]
    entities = spark.createDataFrame(rows, "id long, canonical long, vec array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, vec array<double>")
    found = R.entity_anchors(entities.repartition(3), queries).orderBy("distance").collect()
    assert [r.canonical for r in found] == list(range(1, 11)) and found[0].distance == 0


def test_recordings(spark):
    words = spark.createDataFrame([(1, float(i * 10), "end." if i % 13 == 12 else "w") for i in range(40)], "recording long, start double, word string")
    cut = A.sections(words).orderBy("section").collect()
    assert [r.start for r in cut] == [0.0, 130.0, 260.0, 390.0]
    speech = spark.createDataFrame([(1, 0.0, 30.0), (1, 31.0, 59.0), (1, 60.0, 70.0), (1, 90.0, 95.0)], "recording long, start double, end double")
    assert [(r.start, r.end) for r in A.packed_speech(speech).orderBy("chunk").collect()] == [(0.0, 59.0), (60.0, 70.0), (90.0, 95.0)]
    chunks = spark.createDataFrame([(1, 0, 0.0, 40.0)], "recording long, chunk int, start double, end double")
    said = spark.createDataFrame([(1, 10.0, "x")], "recording long, start double, word string")
    assert [r.seconds for r in A.truncated_chunks(chunks, said, speech).collect()] == [29.0]
    voices = [("d", "s1", 20.0, [1.0, 0.0]), ("d", "s2", 20.0, [0.9, 0.1]), ("d", "s3", 5.0, [1.0, 0.0])]
    voices = spark.createDataFrame(voices, "document string, speaker string, seconds double, vec array<double>")
    prints = spark.createDataFrame([("Ann", [1.0, 0.0])], "name string, vec array<double>")
    assert [(r.speaker, r.name) for r in A.voice_matches(voices, prints).collect()] == [("s1", "Ann")]
    rows = spark.createDataFrame([("0:10 · S1", "0:10 · S1\n\nhi"), ("0:20 · S2", "x")], "heading_path string, content string")
    assert A.renamed_speaker(rows, "S1", "Ann").first()["content"] == "0:10 · Ann\n\nhi"


def test_overlaps_like_brute_force(spark):
    rng = random.Random(3)
    said = [(r, 1.7e9 + s, 1.7e9 + s + rng.uniform(-5, 4000)) for r in range(3) for s in [rng.uniform(0, 40000) for _ in range(60)]]
    asked = [(r, i, 1.7e9 + s, 1.7e9 + s + rng.choice([0, -3, 10, 3600, 20000])) for r in range(4) for i, s in enumerate(rng.uniform(-9000, 50000) for _ in range(50))]
    made = spark.createDataFrame(asked, "recording long, id long, start double, end double")
    found = A.overlap_seconds(made, spark.createDataFrame(said, "recording long, start double, end double"))
    want = {(r, i): sum(max(0, min(e, y) - max(s, x)) for q, x, y in said if q == r) for r, i, s, e in asked}
    got = {(r.recording, r.id): r.seconds for r in found.collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("slice" in line for line in plan.splitlines() if "Join" in line)


def test_overlaps_of_all_events(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    rows = document_queries.overlap_speech_all(spark, DATA)
    part = {(r.recording, r.id): r.seconds for r in document_queries.overlap_speech(spark, DATA).collect()}
    every = {(r.recording, r.id): r.seconds for r in rows.collect()}
    assert len(every) == events.select("event_id").distinct().count() and all(every[k] == v for k, v in part.items())


def test_sessions(spark):
    long = "a" * 30_000
    assert len(one(spark, S.shortened(F.col("t")), t=long)) == 14_400 + 4_800 + 7
    lines = [("s", 0, '{"type":"user","message":{"role":"user","content":"hello"}}'), ("s", 1, "not json"), ("s", 2, '{"type":"user","isMeta":true,"message":{"role":"user","content":"x"}}'),
             ("s", 3, '{"type":"assistant","message":{"role":"assistant","content":[{"type":"text","text":"hi"},{"type":"tool_use"}]}}'), ("s", 4, '{"type":"user","message":{"role":"user","content":"<command-name>x"}}')]
    got = files.transcript_units(spark.createDataFrame(lines, "session string, line long, value string")).collect()
    assert sorted((r.line, r.text) for r in got) == [(0, "hello"), (3, "hi")]


def test_agent_notes(spark):
    notes = [("a/x.md", "---\nname: N\nmetadata:\n  type: feedback\n---\nbody"), ("a/MEMORY.md", "index"), ("a/y.md", "# T\n## S1\none\n## S2\n\n"), ("a/z.md", "# Only\nrest")]
    got = files.agent_notes(spark.createDataFrame(notes, "path string, text string")).collect()
    assert sorted((r.name, r.memory_type, r.content) for r in got) == [("N", "preference", "body"), ("Only", "fact", "rest"), ("S1", "fact", "one")]


def test_discovered(spark):
    now = datetime.datetime(2024, 6, 1)
    name = "/p/123e4567-e89b-12d3-a456-42661417400{}.jsonl"
    rows = [(name.format(i), now - datetime.timedelta(hours=h)) for i, h in enumerate((0, 1, 2, 24 * 20))] + [("/p/notes.jsonl", now - datetime.timedelta(hours=1))]
    got = files.discovered(spark.createDataFrame(rows, "path string, mtime timestamp"), F.lit(now)).collect()
    assert [r.path for r in got] == [name.format(1), name.format(2)]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    store.upsert("t", rows, ["id"])
    store.upsert("t", spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"), ["id"])
    assert sorted(map(tuple, store.read("t").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    old = merged(rows, spark.createDataFrame([(2, "z")], "id long, v string"), ["id"], "old")
    assert sorted(map(tuple, old.collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="status must be"):
        checked(spark.createDataFrame([("odd",)], "status string")).collect()


def test_folder_stream_equals_batch(spark, tmp_path):
    root, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    root.mkdir()
    (root / "a.md").write_text("# A\nfirst")
    jobs.watch_folder(spark, str(root), store, str(tmp_path / "cp")).awaitTermination()
    (root / "b.txt").write_text("second")
    (root / "c.bin").write_text("other")
    jobs.watch_folder(spark, str(root), store, str(tmp_path / "cp")).awaitTermination()
    batch = D.chunks(files.extracted(files.folder(spark, str(root))).selectExpr("path as id", "text"))
    assert sorted(map(tuple, store.read("chunks").collect())) == sorted(map(tuple, batch.collect()))
    assert batch.count() == 2


def test_upsert_stream(spark, tmp_path):
    schema = "id long, v string"
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.json(str(tmp_path / "in/x"))
    store = Store(spark, str(tmp_path / "store"))
    source = spark.readStream.schema(schema).json(str(tmp_path / "in/*"))
    jobs.apply_stream(source, lambda b: b.filter("id > 1"), store, "t", ["id"], str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r) for r in store.read("t").collect()] == [(2, "b")]


def test_pending_conflicts_without_vectors(spark):
    decisions = spark.createDataFrame([(1, 1, [2, 3], None, 5)], "id int, incoming int, candidates array<int>, resolution string, created_at int")
    beliefs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None)], "id int, vec array<double>")
    rows = K.pending(decisions, beliefs).collect()
    assert [(r.candidate, r.place, r.similarity and round(r.similarity, 6)) for r in rows] == [(2, 0, 0.707107), (3, 1, None)]


def test_unqueued_either_way_round(spark):
    decisions = spark.createDataFrame([(1, [2]), (5, [4])], "incoming int, candidates array<int>")
    pairs = spark.createDataFrame([(2, 1), (1, 2), (4, 5), (1, 3)], "a int, b int")
    assert [tuple(r) for r in K.unqueued(pairs, decisions).collect()] == [(1, 3)]


def test_merges_count_on_and_are_taken_back(spark):
    now = F.lit("2024-01-02").cast("timestamp")
    shape = "id int, content string, content_hash string, status string, root_id int, version int, asserted_at timestamp, stale_since timestamp"
    old = datetime.datetime(2023, 1, 1)
    beliefs = spark.createDataFrame([(i, f"t{i}", "h", "stale" if i == 3 else "active", 1, i, old, old if i == 3 else None) for i in (1, 2, 3)], shape)
    decided = spark.createDataFrame([(1, 2, [1, 3], 10, "a"), (2, 1, [], 11, "b")], "id int, incoming int, candidates array<int>, made int, content string")
    after, edges = K.merge_conflicts(decided, beliefs, now)
    assert {(r.id, r.status, r.root_id, r.version) for r in after.collect()} == {
        (1, "stale", 1, 1), (2, "stale", 1, 2), (3, "stale", 1, 3), (10, "active", 1, 4), (11, "active", 1, 5)
    }
    assert {(r.from_id, r.to_id) for r in edges.collect()} == {(10, 2), (10, 1), (10, 3), (11, 1)}
    back, left = K.revert_merges(decided, after, edges, now)
    assert {(r.id, r.status) for r in back.collect()} == {(1, "active"), (2, "active"), (3, "stale"), (10, "stale"), (11, "stale")}
    assert not left.filter("active").count()


def test_model_replies_that_decide_nothing(spark):
    said = spark.createDataFrame([(1, [7, 8], '[{"verdict": "keep_existing", "existing": 9}]'), (2, [7], None), (3, [7], "[1]"), (4, [], '[{"verdict": "keep_existing"}]')], "id int, candidates array<int>, reply string")
    assert [tuple(r) for r in P.resolutions(said).orderBy("id").collect()] == [
        (1, "keep_existing", 7, ""), (2, "unsure", None, "unparseable reply"), (3, "unsure", None, "unparseable reply"), (4, "keep_existing", None, "")
    ]
    said = spark.createDataFrame([(1, 2, '{"verdict": "same", "confidence": "NaN"}'), (1, 3, "no"), (1, 4, None)], "a int, b int, reply string")
    assert [tuple(r) for r in P.entity_verdicts(said).collect()] == [(1, 2, "same", 0.0, "")]


def test_documents_without_a_match_or_a_needle(spark):
    docs = spark.createDataFrame([(f"T{i}", "p") for i in range(3)], "title string, path string")
    assert L.list_documents(docs, "zzz").count() == 0
    assert {tuple(r) for r in L.list_documents(docs, " ", 2).collect()} == {("T0", "p", None), ("T1", "p", None), (None, None, 1)}
    assert L.mean_length(docs.selectExpr("title as content", "'stale' as status")).first().chars == 0
