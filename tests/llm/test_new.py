"""Harmonic packing, hard negatives and the Merkle manifest against brute force, and on odd input."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarn.llm import hard_negatives, harmonic, language, manifest, packing
from tests.llm.test_llm import ODD, SCHEMA, table

# harmonic packing


def check_packing(rows, documents, capacity=harmonic.LENGTH, padded=0):
    """``documents``: ids of each doc_id, with the separator."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(documents)
    for doc_id, ids in documents.items():
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for held in by_sequence.values():
        held.sort(key=lambda r: r.offset)
        n = sum(r.length for r in held)
        assert [r.offset for r in held] == [sum(r.length for r in held[:k]) for k in range(len(held))]
        assert n <= capacity and n & (n - 1) == 0
    return by_sequence


@pytest.mark.parametrize("tokenizer", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_harmonic_packing_like_the_library(spark, tokenizer):
    rng = random.Random(11)
    parts = ["Hello", " world", "'s", "don't", "  ", "\n", "123", "中文", "😀", "é", "<|endoftext|>", "!?", "token", "ization", ", ", "A.b "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(3000))) for _ in range(120)] + ODD
    path = public_tokenizers.path(tokenizer)
    library = Tokenizer.from_file(path)
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    found = harmonic.harmonic_packing(table(spark, texts).repartition(3), path).collect()
    sequences = check_packing(found, want)
    total = sum(map(len, want.values()))
    assert len(sequences) <= -(-total // harmonic.LENGTH) + 3 * 11  # a worker ends with at most 11 shorter ones
    full = [s for s in sequences.values() if sum(r.length for r in s) == harmonic.LENGTH]
    assert sum(len({r.length for r in s}) == 1 for s in full) >= 0.8 * len(full)


def test_harmonic_cuts():
    sizes = np.array([1, 2047, 2048, 2049, 3 * 2048 + 5, 0])
    owner, start, length = harmonic.cut(sizes, 2048)
    for k, n in enumerate(sizes):
        mine = owner == k
        assert length[mine].sum() == n and start[mine].tolist() == (np.cumsum(length[mine]) - length[mine]).tolist()
        assert length[mine].tolist() == [2048] * (n // 2048) + [1 << b for b in range(10, -1, -1) if n % 2048 >> b & 1]


def test_harmonic_odd_input(spark):
    found = harmonic.harmonic_packing(table(spark, [None, "", "x"], ids=[None, None, 4]).coalesce(1)).collect()
    assert sorted((r.doc_id is None, r.start, r.length) for r in found) == [(False, 0, 2), (True, 0, 1), (True, 0, 1)]
    assert len({r.sequence_id for r in found}) == 1  # four tokens
    assert harmonic.harmonic_packing(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        harmonic.harmonic_packing(table(spark, ["x"]), length=100)
    again = [harmonic.harmonic_packing(table(spark, ["a b c"] * 300).coalesce(2)).collect() for _ in range(2)]
    assert again[0] == again[1]
    assert len({r.sequence_id for r in again[0]}) <= -(-300 * 4 // 2048) + 2 * 11


def test_packing_by_another_tokenizer(spark):
    """A tokenizer that keeps white space and cases gets whole texts."""
    texts = ["Hello  World", "a.b, C", None]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in packing.pieces(table(spark, texts), path, with_ids=True).collect():
        assert r.ids == [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]


# hard negatives


VECTORS = "vec_id long, embedding array<float>, label int, rank int, number long, place string"


def mined_by_force(rows):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v], g) for i, v, g in rows if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {(i, tuple(v), g) for i, v, g in whole if i % 100 == 0}
    out = []
    for i, v, g in anchors:
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, h) for j, w, h in whole if j != i and len(w) == len(v)]
        scored.sort(key=lambda x: (-x[0], x[1]))
        for s, j, _ in [x for x in scored if x[2] == g][:5]:
            fits = [x for x in scored if x[2] != g and 30 * s <= 100 * x[0] <= 90 * s][:10]
            out += [(i, j, k, x[1], s, x[0]) for k, x in enumerate(fits, 1)]
    return sorted(out)


def vectors_table(spark, rows):
    return spark.createDataFrame([(i, v, g, 1, 2, "x") for i, v, g in rows], VECTORS)


@pytest.mark.parametrize("wave_bytes", [hard_negatives.WAVE_BYTES, 8 * 6 * 2])
def test_hard_negatives_like_brute_force(spark, wave_bytes):
    rng = np.random.default_rng(12)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0.2, 0.5, 6)], int(rng.integers(3))) for i in range(900)]
    rows += [(2000 + i, rows[7][1], 1) for i in range(40)] + [(3000, rows[7][1], 2)]  # a common vector, ties
    rows += [(4000, None, 1), (4100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (4200, [float("nan")] * 6, 1), (4300, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(4400, [0.5, 0.5], 1), (4401, [0.5, 0.25], 1), (4402, [0.4, 0.25], 2), (4500, [], 1), (4600, [float("inf")] * 6, 0)]
    found = hard_negatives.hard_negatives(vectors_table(spark, rows).repartition(5), F.col("vec_id") % 100 == 0, wave_bytes=wave_bytes)
    assert sorted(map(tuple, found.collect())) == mined_by_force(rows)


def test_hard_negatives_beyond_float64(spark):
    """Components whose products pass 2^53."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(1e5, 3e4, 3)], int(rng.integers(2))) for i in range(120)]
    found = hard_negatives.hard_negatives(vectors_table(spark, rows), F.col("vec_id") % 100 == 0)
    assert max(r[4] for r in mined_by_force(rows)) > 1 << 50
    assert sorted(map(tuple, found.collect())) == mined_by_force(rows)


def test_hard_negatives_odd_input(spark):
    anchors = F.col("vec_id") % 100 == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS), anchors).collect() == []
    assert hard_negatives.hard_negatives(vectors_table(spark, [(1, [1.0], 1), (2, [1.0], 1)]), anchors).collect() == []
    rows = [(0, [1.0], 1), (0, [1.0], 1), (0, [2.0], 1), (3, [1.0], 1), (4, [0.5], 2), (4, [0.5], 2)]
    got = sorted(map(tuple, hard_negatives.hard_negatives(vectors_table(spark, rows), anchors).collect()))
    # equal anchors once, another row of the same id on its own; repeated negatives count each
    assert got == sorted([(0, 3, 1, 4, 65536, 32768), (0, 3, 2, 4, 65536, 32768), (0, 3, 1, 4, 131072, 65536), (0, 3, 2, 4, 131072, 65536)])


def test_best_keeps_smaller_ids():
    scores = np.array([[3, 5, 5, 5, 1], [0, 0, 0, 0, 0]])
    got = hard_negatives.best(scores, np.array([10, 11, 12, 13, 14]), 2)
    assert got[1].tolist() == [[11, 12], [10, 11]]
    assert hard_negatives.products(np.array([[2.0**40]]), np.array([[2.0**20 + 1]])).tolist() == [[2**60 + 2**40]]


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    values = [row[0], row[3], row[2], None if row[4] is None else row[4] + more, row[1]]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def walk(levels, place):
    for level in levels[:-1]:
        first = place // 2 * 2
        yield "".join(level[first:place]), "".join(level[place + 1 : first + 2])
        place //= 2


def manifest_by_force(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = levels_of([leaf_of(r) for r in groups[g]])
    top = levels_of([trees[g][-1][0] for g in order])
    root, out = top[-1][0], []
    for k, g in enumerate(order):
        for place, r in enumerate(groups[g]):
            marked = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            path = [*walk(trees[g], place), *walk(top, k)]
            again = leaf_of(r, 1) if marked else leaf_of(r)
            for before, after in path:
                again = sha(before, again, after)
            out.append((r[0], leaf_of(r), trees[g][-1][0], root, sha(*(x for pair in path for x in pair)), again, again == root))
    return sorted(out, key=repr)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key string, `group` string, size long, hash string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "k", "g", 1, "h") for r in rows], DOCUMENTS)


@pytest.mark.parametrize(("bucket", "levels"), [(manifest.BUCKET, manifest.LEVELS), (4, 2)])
def test_manifest_like_brute_force(spark, bucket, levels):
    rng = random.Random(13)
    langs = ["en"] * 12 + ["de", "fr", None, "", "Ω", "z-1"]
    ids = [rng.choice([rng.randrange(300), rng.randrange(-(1 << 63), 1 << 63), 1 << 40 | rng.randrange(40), None, 7]) for _ in range(700)]
    rows = [(i, rng.choice(["a", "", None, "é😀" * 50]), rng.choice(langs), rng.choice(["s", None]), rng.choice([3, None, -1])) for i in ids]
    rows += [rows[0]] * 60 + [(5, "x" * 100_000, "alone", "s", 1)]
    found = manifest.manifest(documents(spark, rows), bucket=bucket, levels=levels)
    got = sorted(map(tuple, found.collect()), key=repr)
    assert got == manifest_by_force(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_manifest_odd_input(spark):
    assert manifest.manifest(documents(spark, [])).collect() == []
    for rows in ([(1, "a", "en", "s", 1)], [(None, None, None, None, None)], [(1, "a", "en", "s", 1)] * 5):
        assert sorted(map(tuple, manifest.manifest(documents(spark, rows)).collect())) == manifest_by_force(rows)


def test_ranks_of_clumped_keys(spark):
    keys = [f"{k:016x}" for k in [*range(500), *(1 << 60 | k for k in range(300)), (1 << 63) + 5]]
    rows = spark.createDataFrame([("g", k, 2 if n % 3 else 1) for n, k in enumerate(keys)], "`group` string, key string, n long")
    got = {r.key: r["rank"] for r in manifest.ranked(rows.repartition(3), bucket=10).collect()}
    at = 0
    for n, k in enumerate(keys):
        assert got[k] == at
        at += 2 if n % 3 else 1
    assert len(got) == len(keys)


def test_tables_of_arrow_are_whole():
    packer = harmonic.Packer(8, 5)
    rows = pa.RecordBatch.from_arrays([pa.array([4, 2, 2, 1, 1, 1])], ["length"])
    assert packer.add(rows).num_rows == 0
    last = packer.close()
    assert last.column("sequence_id").to_pylist() == [5, 5, 5, 6, 6, 7]
    assert last.column("offset").to_pylist() == [0, 4, 6, 0, 1, 0]


# language ID


@pytest.mark.parametrize("doc_id", ["cast(1 as long)", "cast(null as long)", "id % 20", "id"])
def test_language_of_much_repeated_ids(spark, doc_id):
    """60,000 rows of few ids, or of none, are learnt beside a hundred of another language."""
    many = spark.range(60_000).selectExpr(f"{doc_id} as doc_id", "'the thing with other weather ' || id as text", "'en' as lang")
    few = spark.range(100).selectExpr("1000000 + id as doc_id", "'schon die ung eine schule ' || id as text", "'de' as lang")
    found = language.identify(many.unionByName(few)).groupBy("lang_pred", F.col("doc_id") >= 1_000_000).count().collect()
    got = {(r.lang_pred, bool(r[1])): r["count"] for r in found}
    assert got == {("en", False): 60_000, ("de", True): 100}
