"""Near-duplicate documents by min-max hashing, with every link confirmed on whole shingle sets.

1. A pass over the texts gives each document the digest of its set of five-word shingles and, under each of ``PERMS``
   permutations, both the smallest and the largest value: two signature values for one hash evaluation. Runs of
   ``ROWS`` values are hashed into ``BANDS`` band keys.
2. Equal sets are one class, whatever their number; only the class's smallest doc_id goes on.
3. Classes that share a band key are candidates. No bucket is ever expanded into all its pairs. First each class is
   compared with one leader of its buckets. In buckets where more than one component is left, the sketches (one byte
   per signature value) of the members outside the bucket's largest component are compared with all members of other
   components, in blocks of bounded size, which Spark deals out, and a spanning forest of likely pairs is confirmed. Of
   what is still apart then, the members that sketches do not rule out meet once more with their whole sets, in blocks
   bounded by shingles, and a spanning forest of the links is returned. So pairs are compared within tasks but never
   become rows. Nothing is capped.

What can be lost of a pair at the threshold of 0.75: all bands miss it with a probability of (1 - 0.75 ** 4) ** 32 = 5e-6
for large sets (for small ones the minimum and maximum of one permutation are not independent: 2e-5 at 6 of 8 shingles,
1e-4 at 3 of 4), and, if it is not found through a leader, fewer than ``AGREE`` of 128 sketch bytes agree with one of
about 5e-7. More similar pairs are lost less often. Everything else is exact.

Defined cases: null and empty texts, or ones without words, have an empty set, link with nothing and are kept; with fewer
than five words the whole sequence is the one shingle; texts of any length are taken whole, their shingles hashed
``STEP`` at a time; rows that repeat a doc_id are taken each by its own text; rows without a doc_id link with nothing,
have no component and are kept; an empty table gives no rows; extra columns are not looked at. keep_one() goes by row:
there rows without a doc_id are compared too, and of rows equal in everything one stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import SLICE, bounded, persisted, slices
from tarn.llm.words import grams, mixed, raw, words
from tarn.operators.components import components

WORDS = 5
PERCENT = 75
PERMS = 64
ROWS, BANDS = 4, 32
#: Of 2 * PERMS sketch bytes, so many agree at least: at 0.75, 96 do with a standard deviation of under 4.9.
AGREE = 72
#: Members of a bucket in one part of a block, and shingles of their whole sets.
BLOCK = 512
BLOCK_SHINGLES = 2_000_000
#: Members from which on a bucket is large.
HOT = 2000
_RANDOM = np.random.Generator(np.random.PCG64(7))
MULTIPLY = _RANDOM.integers(1, 1 << 63, PERMS, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RANDOM.integers(0, 1 << 63, PERMS, np.uint64)
BAND = _RANDOM.integers(1, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
BAND_ADD = _RANDOM.integers(1, 1 << 63, BANDS, np.uint64)
STEP = 1 << 13


def shingle_sets(batch: pa.RecordBatch, text: int = 1) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    found, first = grams(words(*raw(batch.column(text))), WORDS, whole=True)
    return [np.unique(found[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest and largest value under each permutation, side by side."""
    low = np.full(PERMS, 0xFFFFFFFF, np.uint32)
    high = np.zeros(PERMS, np.uint32)
    for i in range(0, len(shingles), STEP):
        values = (shingles[None, i : i + STEP] * MULTIPLY[:, None] + ADD[:, None]) >> np.uint64(32)
        values = values.astype(np.uint32)
        low, high = np.minimum(low, values.min(axis=1)), np.maximum(high, values.max(axis=1))
    return np.stack([low, high], axis=1).ravel()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=SLICE):
        sizes, digests, signatures = [], [], []
        for shingles in shingle_sets(batch):
            sizes.append(len(shingles))
            digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
            signatures.append(signature(shingles) if len(shingles) else np.zeros(2 * PERMS, np.uint32))
        table = np.array(signatures, np.uint64).reshape(-1, BANDS, ROWS)
        bands = mixed((table * BAND).sum(axis=2) + BAND_ADD).view(np.int64)
        sketches = (mixed(table.reshape(len(sizes), -1)) & np.uint64(0xFF)).astype(np.uint8)
        offsets = np.arange(0, bands.size + 1, BANDS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array([s.tobytes() for s in sketches], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel())),
            ],
            ["doc_id", "n_shingles", "digest", "sketch", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=SLICE):
        found = shingle_sets(batch)
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in found]))).astype(np.int32)
        flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "shingles"]
        )


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    of = lambda k: sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"set_{k}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    every = F.size("set_a") + F.size("set_b") - both
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(both * 100 >= every * PERCENT).select("a", "b").distinct()


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of each group, of batches sorted by their first ``keys`` columns; list columns as arrays."""
    block, held = None, []
    for batch in batches:
        columns = []
        for c in batch.columns:
            if pa.types.is_list(c.type):
                at, flat = c.offsets.to_numpy(), c.values.to_numpy()
                columns.append([flat[x:y] for x, y in zip(at[:-1], at[1:], strict=True)])
            else:
                columns.append(c.to_pylist())
        for row in zip(*columns, strict=True):
            if row[:keys] != block:
                if held:
                    yield held
                block, held = row[:keys], []
            held.append(row)
    if held:
        yield held


def _sides(rows: list[tuple]) -> tuple[list[tuple], int]:
    """Rows of a block, those of its first part before ``left``; left is 0 if the block is of one part."""
    rows = sorted(rows, key=lambda r: (r[3], r[4]))
    return rows, sum(r[3] == 0 for r in rows) % len(rows)


def _alike(rows: list[tuple], left: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row i, rows j of other components whose sketches don't rule the threshold out, and how many bytes agree."""
    comps = np.array([r[5] for r in rows])
    sketches = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(len(rows), -1)
    for i in range(left or len(rows)):
        j = np.arange(max(left, i + 1), len(rows))
        j = j[comps[j] != comps[i]]
        same = (sketches[j] == sketches[i]).sum(axis=1)
        near = same >= AGREE
        if near.any():
            yield i, j[near], same[near]


class _Union(dict):
    def top(self, x: int) -> int:
        while x in self:
            x = self[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        if x != y:
            self[max(x, y)] = min(x, y)
        return x != y


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=_PAIRS)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (key, one, two, side, doc_id, component, sketch) -> likely links that would join their components."""
    for rows in _groups(batches, 3):
        rows, left = _sides(rows)
        found = [(-int(n), i, int(k)) for i, j, same in _alike(rows, left) for k, n in zip(j, same, strict=True)]
        comps = _Union()
        tree = [(rows[i][4], rows[j][4]) for _, i, j in sorted(found) if comps.join(rows[i][5], rows[j][5])]
        if tree:
            yield _pairs([(min(p), max(p)) for p in tree])


def _undecided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks as before, the members that may be linked with one of another component, without sketches."""
    for rows in _groups(batches, 3):
        rows, left = _sides(rows)
        keep: set[int] = set()
        for i, j, _ in _alike(rows, left):
            keep.add(i)
            keep.update(j.tolist())
        if keep:
            columns = list(zip(*(rows[k][:6] for k in sorted(keep)), strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "one", "two", "side", "doc_id", "component"]
            )


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (key, one, two, side, doc_id, component, shingles) -> links, by whole sets, that join their components.

    One row at a time is held against all others: its shingles are marked, and the marks that each set holds are counted.
    Rows of the most frequent component need no turn of their own.
    """
    for rows in _groups(batches, 3):
        rows, left = _sides(rows)
        comps = np.array([r[5] for r in rows])
        sizes = np.array([len(r[6]) for r in rows])
        _, flat = np.unique(np.concatenate([r[6] for r in rows]), return_inverse=True)
        first = np.cumsum(sizes) - sizes
        values, count = np.unique(comps, return_counts=True)
        large = values[count.argmax()]
        marks, union, links = np.zeros(flat.max() + 1, np.int32), _Union(), []
        for i in np.flatnonzero(comps != large):
            own = flat[first[i] : first[i] + sizes[i]]
            marks[own] = 1
            both = np.add.reduceat(marks[flat], first)
            marks[own] = 0
            near = (both * 100 >= (sizes + sizes[i] - both) * PERCENT) & (comps != comps[i])
            links += [(rows[i][4], rows[j][4]) for j in np.flatnonzero(near) if union.join(int(comps[i]), int(comps[j]))]
        if links:
            yield _pairs([(min(p), max(p)) for p in links])


def _blocks(crowded: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, dealt into blocks.

    Each member outside its bucket's largest component meets each member of the others in one block. Parts of members
    outside it are numbered from 0, those of the largest from -1 down.
    """
    named = crowded.join(labels, crowded.doc_id == labels.node, "left").select(
        "key", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component")
    )
    held = named.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    whole = held.groupBy("key").agg(
        F.count("*").alias("components"),
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        F.max(F.struct("n", "s", "component")).alias("large"),
    )

    def parts(n: Column, s: Column) -> Column:
        return F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES)).cast("long")

    mixed_up = whole.filter("components > 1").select(
        "key",
        F.col("large.component").alias("large"),
        parts(F.col("n") - F.col("large.n"), F.col("s") - F.col("large.s")).alias("few"),
        parts(F.col("large.n"), F.col("large.s")).alias("many"),
    )
    placed = named.join(mixed_up, "key").withColumn("outside", F.col("component") != F.col("large"))
    own = F.when(F.col("outside"), F.pmod(F.xxhash64("doc_id"), F.col("few"))).otherwise(-1 - F.pmod(F.xxhash64("doc_id"), F.col("many")))
    zero = F.lit(0).cast("long")
    others = F.when(F.col("outside"), F.sequence(-F.col("many"), F.col("few") - 1)).otherwise(F.sequence(zero, F.col("few") - 1))
    placed = placed.select("key", "doc_id", "component", own.alias("own"), F.explode(others).alias("other"))
    one, two = F.greatest("own", "other"), F.least("own", "other")
    return placed.join(sketches, "doc_id").select(
        "key", one.alias("one"), two.alias("two"), F.when(F.col("own") == one, 0).otherwise(1).alias("side"), "doc_id", "component", "sketch"
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    signed = persisted(
        narrow.mapInArrow(_sign, "doc_id long, n_shingles long, digest binary, sketch binary, bands array<long>"), "signed"
    )
    usable = signed.filter("doc_id is not null and digest is not null")
    leaders = persisted(usable.groupBy("digest").agg(F.min("doc_id").alias("leader")), "leaders")
    classes = usable.join(leaders, "digest").filter("doc_id = leader").select("doc_id", "n_shingles", "sketch", "bands").distinct()
    banded = classes.select("doc_id", "n_shingles", F.explode("bands").alias("key"))
    buckets = persisted(banded.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("leader")).filter("n > 1"), "buckets")
    # large buckets are few, and find their members where they are; the others meet theirs by a shuffle
    hot, cold = (buckets.filter(side).drop("n") for side in (F.col("n") > HOT, F.col("n") <= HOT))
    hot = bounded(hot)
    met = banded.join(hot.select("key"), "key", "left_anti").join(cold, "key").unionByName(banded.join(hot, "key"))
    crowded = persisted(met, "crowded")
    involved = bounded(persisted(crowded.select("doc_id").distinct(), "involved"))
    held = narrow.join(involved, "doc_id", "left_semi")
    again = bounded(persisted(usable.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again"))
    if not again.isEmpty():
        held = held.join(again, "doc_id", "left_anti").union(held.join(again, "doc_id", "left_semi").distinct())
    sets = persisted(held.mapInArrow(_sets, "doc_id long, shingles array<long>"), "sets")
    sketches = classes.join(involved, "doc_id", "left_semi").select("doc_id", "sketch")
    stars = crowded.filter("doc_id <> leader").groupBy("doc_id").agg(F.min("leader").alias("a"))
    links = persisted(_confirmed(stars.select("a", F.col("doc_id").alias("b")), sets), "links")
    labels = components(links)
    block = ("key", "one", "two")
    likely = _blocks(crowded, labels, sketches).repartition(*block).sortWithinPartitions(*block)
    likely = persisted(likely.mapInArrow(_forest, "a long, b long").distinct(), "likely")
    if not likely.isEmpty():
        links = links.union(persisted(_confirmed(likely, sets), "links"))
        labels = components(links)
        open_ = _blocks(crowded, labels, sketches).repartition(*block).sortWithinPartitions(*block)
        kinds = "key long, one long, two long, side int, doc_id long, component long"
        open_ = persisted(open_.mapInArrow(_undecided, kinds), "undecided").join(sets, "doc_id")
        open_ = open_.select("key", "one", "two", "side", "doc_id", "component", "shingles")
        last = open_.repartition(*block).sortWithinPartitions(*block).mapInArrow(_exact, "a long, b long").distinct()
        last = persisted(last, "links")
        if not last.isEmpty():
            labels = components(links.union(last))
    found = signed.select("doc_id", "n_shingles", "digest").join(leaders, "digest", "left")
    out = found.join(labels, found.leader == labels.node, "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "leader", "doc_id")).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that have a near duplicate in their group which comes before them.

    The one of the smallest doc_id stays, of several of those the first row; rows without a doc_id come last.
    """
    row = next(c for k in range(len(docs.columns) + 1) if (c := f"row_{k}") not in docs.columns)
    rows = persisted(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(rows, row, text_col).select(F.col("doc_id").alias(row), "component_id")
    ids = rows.select(row, F.col(id_col).alias("id"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", row)
    first = groups.join(ids, row).groupBy("component_id").agg(F.min(place).alias("first")).select(F.col(f"first.{row}"))
    gone = groups.select(row).join(first, row, "left_anti")
    return rows.join(bounded(persisted(gone, "gone")), row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
