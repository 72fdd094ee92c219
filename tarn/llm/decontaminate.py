"""Benchmark decontamination: common n-grams find candidates, Smith-Waterman alignment of words scores them.

Words are runs of letters and digits in lower case. One pass over the texts finds where ``GRAM``-word runs of the items
stand in them. Every common run is a seed, however rare or frequent it is: the stretch of the text that an alignment through
it can reach is compared with the item, first by the words they have in common, which bounds the score from above, and, if that
suffices, by alignment. A document is contaminated if the alignment has at least ``THRESHOLD`` of the score of the item with
itself. Alignments without GRAM matching words in a row aren't found. Items go in blocks of at most ``BLOCK_WORDS`` words; a
block's index is what is broadcast. Items of equal text are one class, scored once: results name its smallest item_id and how
many ``copies`` it has, and item_classes() tells the members.

Defined cases: texts that are null, empty or without words match nothing, items likewise; an item of fewer than GRAM words
is one run; texts of any length are searched whole, items of any length in a block of their own; repeated rows are taken
each on their own; rows without a doc_id are scored like any others; a class without any item_id has a null one; equal
alignments are reported at their first place; an empty table of either kind gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import SLICE, persisted, slices
from tarn.llm.words import PLAIN, STEP, Words, grams, mixed, raw, words

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5
BLOCK_WORDS = 2_000_000
BATCH_CELLS = 4_000_000
#: Words of stretches that are compared with items' words at a time.
BATCH_WORDS = 1_000_000


@dataclass
class Items:
    """A block of items: their words, their runs' hashes in order, each with its item and its place in it, and their distinct words."""

    ids: list
    first: np.ndarray
    hashes: np.ndarray
    runs: np.ndarray
    item: np.ndarray
    place: np.ndarray
    maybe: np.ndarray
    own: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list[str]) -> Items:
        w = words(*raw(pa.array(texts, pa.string())), PLAIN)
        runs, first = grams(w, GRAM, whole=True)
        item = np.repeat(np.arange(len(ids)), np.diff(first))
        place = np.arange(len(runs)) - first[item]
        order = np.argsort(runs, kind="stable")
        maybe = np.zeros(1 << 20, bool)
        maybe[runs >> np.uint64(44)] = True
        own, times = np.unique(cls.owned(np.repeat(np.arange(len(ids)), np.diff(w.first)), w.hashes), return_counts=True)
        return cls(ids, w.first, w.hashes, runs[order], item[order], place[order], maybe, own, times)

    @staticmethod
    def owned(item: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Hash of a word as a word of that item."""
        return mixed(hashes + (item.astype(np.uint64) + np.uint64(1)) * STEP[0])

    def hits(self, found: np.ndarray) -> np.ndarray:
        """Which of the hashes are runs of an item."""
        at = np.flatnonzero(self.maybe[found >> np.uint64(44)])
        if not len(at) or not len(self.runs):
            return at[:0]
        k = np.minimum(np.searchsorted(self.runs, found[at]), len(self.runs) - 1)
        return at[self.runs[k] == found[at]]


def align(one: list[np.ndarray], two: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignments of one[k] with two[k]: score, and where it begins and ends in two[k].

    All pairs advance together, an antidiagonal of their tables a step.
    """
    n, m = max(map(len, one)), max(map(len, two))
    a = np.zeros((len(one), n), np.uint64)
    b = np.ones((len(two), m + 2 * n), np.uint64)  # paddings never match
    for k, (x, y) in enumerate(zip(one, two, strict=True)):
        a[k, : len(x)], b[k, n : n + len(y)] = x, y
    shape = (len(one), n + 1)
    low = [np.zeros(shape, np.int32) for _ in range(2)]  # the two antidiagonals before, by place in one
    begin = [np.zeros(shape, np.int32) for _ in range(2)]
    best, start, end = (np.zeros(len(one), np.int32) for _ in range(3))
    place = np.arange(1, n + 1)
    flipped = b[:, ::-1]
    for d in range(2, n + m + 1):
        # cell i of the antidiagonal stands for place i of one and place d - i of two
        lo, hi = m + 2 * n - (n + d - 2), m + 2 * n - (n + d - 2) + n
        other = flipped[:, lo - 1 : hi - 1]
        j = d - place
        inside = (j >= 1) & (j <= m)
        step = np.where(a == other, MATCH, MISMATCH)
        diagonal = low[0][:, :-1] + step
        up, left = low[1][:, :-1] + GAP, low[1][:, 1:] + GAP
        score = np.maximum(np.maximum(diagonal, up), np.maximum(left, 0))
        score = np.where(inside, score, 0)
        came = np.where(low[0][:, :-1] > 0, begin[0][:, :-1], j - 1)
        came = np.where(score == diagonal, came, np.where(score == up, begin[1][:, :-1], begin[1][:, 1:]))
        low = [low[1], np.concatenate((np.zeros((len(one), 1), np.int32), score), axis=1)]
        begin = [begin[1], np.concatenate((np.zeros((len(one), 1), np.int32), came), axis=1)]
        top = score.argmax(axis=1)
        value = score[np.arange(len(one)), top]
        better = value > best
        best, start = np.where(better, value, best), np.where(better, came[np.arange(len(one)), top], start)
        end = np.where(better, j[top], end)
    return best, start, end


def _stretches(
    items: Items, w: Words, owner: np.ndarray, place: np.ndarray, run: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, begin, end) of the words that alignments through the seeds can reach, merged per item.

    An alignment that reaches the threshold has at most 2 * (1 - threshold) as many gaps as the item has words.
    """
    lo, hi = np.searchsorted(items.runs, run), np.searchsorted(items.runs, run, "right")
    count = hi - lo
    text, at = np.repeat(owner, count), np.repeat(place, count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    item, begin = items.item[k], at - items.place[k]
    order = np.lexsort((begin, item, text))
    text, item, begin = text[order], item[order], begin[order]
    length = np.diff(items.first)[item]
    reach = np.floor(MATCH * length * (1 - threshold) / -GAP + 1e-9).astype(np.int64)
    begin, end = begin - reach, begin + length + reach
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > end[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(text))[: len(head)] - 1
    text, item, begin, end = text[head], item[head], begin[head], end[tail]
    return text, item, np.maximum(begin, 0) + w.first[text], np.minimum(end + w.first[text], w.first[text + 1])


def _enough(items: Items, w: Words, item: np.ndarray, begin: np.ndarray, end: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the stretches hold so many of their item's words that an alignment can reach the threshold."""
    out = np.zeros(len(item), bool)
    size = end - begin
    sums = np.cumsum(size)
    lo = 0
    while lo < len(item):
        hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + BATCH_WORDS, "right")))
        n = size[lo:hi]
        which = np.repeat(np.arange(hi - lo), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + begin[lo:hi][which]
        keys = Items.owned(item[lo:hi][which], w.hashes[at])
        k = np.minimum(np.searchsorted(items.own, keys), len(items.own) - 1)
        right = items.own[k] == keys
        pairs, times = np.unique(which[right] * len(items.own) + k[right], return_counts=True)
        common = np.bincount(pairs // len(items.own), np.minimum(times, items.times[pairs % len(items.own)]), minlength=hi - lo)
        out[lo:hi] = common >= threshold * np.diff(items.first)[item[lo:hi]] - 1e-9
        lo = hi
    return out


def _aligned(items: Items, threshold: float, w: Words) -> dict[tuple[int, int], tuple]:
    """Of each text and item with an alignment that reaches the threshold: minus its score, first word, word after its last."""
    found, first = grams(w, GRAM, whole=True)
    at = items.hits(found)
    owner = np.searchsorted(first, at, "right") - 1
    text, item, begin, end = _stretches(items, w, owner, at - first[owner], found[at], threshold)
    enough = _enough(items, w, item, begin, end, threshold)
    todo = list(zip(*(x[enough].tolist() for x in (text, item, begin, end)), strict=True))
    todo.sort(key=lambda x: x[2] - x[3])
    best: dict[tuple[int, int], tuple] = {}
    while todo:
        n = max(1, BATCH_CELLS // (64 * (todo[0][3] - todo[0][2] + 64)))
        part, todo = todo[:n], todo[n:]
        own = [items.hashes[items.first[i] : items.first[i + 1]] for _, i, _, _ in part]
        scores, starts, ends = align(own, [w.hashes[b:e] for _, _, b, e in part])
        for (t, i, b, _), s, x, y, o in zip(part, scores, starts, ends, own, strict=True):
            share = float(s) / (MATCH * len(o))
            if share >= threshold and (-share, b + x) < best.get((t, i), (0.0, 0))[:2]:
                best[t, i] = (-share, b + x, b + y)
    return best


def _score(items: Items, copies: list[int], threshold: float, kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> the best alignment of each text and item, if it reaches the threshold."""
    for batch in slices(batches, most=SLICE):
        data, offsets = raw(batch.column(1))
        w = words(data, offsets, PLAIN)
        rows = sorted(_aligned(items, threshold, w).items())
        points = [data[offsets[t] : offsets[t + 1]] for (t, _), _ in rows]
        place = [
            (len(p[: w.start[x] - offsets[t]].tobytes().decode()), len(p[: w.end[y - 1] - offsets[t]].tobytes().decode()))
            for ((t, _), (_, x, y)), p in zip(rows, points, strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array([t for (t, _), _ in rows], pa.int64())),
                pa.array([items.ids[i] for (_, i), _ in rows], kind),
                pa.array([-s for _, (s, _, _) in rows], pa.float64()),
                pa.array([b for b, _ in place], pa.int64()),
                pa.array([e for _, e in place], pa.int64()),
                pa.array([copies[i] for (_, i), _ in rows], pa.int64()),
            ],
            ["doc_id", "item_id", "score", "start", "end", "copies"],
        )


def _keep(items: Items, threshold: float, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose text, column number ``at``, holds no item."""
    for batch in slices(batches, text=at, most=SLICE):
        w = words(*raw(batch.column(at)), PLAIN)
        kept = np.ones(batch.num_rows, bool)
        kept[[t for t, _ in _aligned(items, threshold, w)]] = False
        yield batch.filter(pa.array(kept))


def item_classes(benchmark: DataFrame) -> DataFrame:
    """(item_id, class_id): items of equal text have the smallest item_id of theirs."""
    first = benchmark.groupBy("text").agg(F.min("item_id").alias("class_id"))
    return benchmark.select("item_id", "text").join(first, "text").select("item_id", "class_id")


def _blocks(benchmark: DataFrame, most: int) -> Iterator[pa.Table]:
    """Distinct items (item_id, text, copies), in blocks of about ``most`` words."""
    text = F.col("text").cast("string").alias("text")
    distinct = benchmark.select("item_id", text).filter("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"), F.count("*").alias("copies"))
    distinct = persisted(distinct.withColumn("n", F.size(F.split("text", r"\s+"))), "items")
    blocks = (distinct.agg(F.sum("n")).first()[0] or 0) // most + 1
    for k in range(blocks):
        yield distinct.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).select("item_id", "text", "copies").toArrow()


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document and distinct item that it holds: doc_id, item_id, score, start and end in code points, copies."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    doc_kind, item_kind = narrow.schema[0].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, score double, start long, end long, copies long"
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, block_words):
        shared = spark.sparkContext.broadcast((Items.of(block.column(0).to_pylist(), block.column(1).to_pylist()), block.column(2).to_pylist()))
        kind = block.schema.field(0).type
        out = out.union(narrow.mapInArrow(lambda b, s=shared, k=kind: _score(*s.value, threshold, k, b), schema))
    return out


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS, text_col: str = "text"
) -> DataFrame:
    """The documents that hold no item of the benchmark; each row is decided by its own text, in one pass."""
    at = docs.columns.index(text_col)
    out = docs
    for block in _blocks(benchmark, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(Items.of(block.column(0).to_pylist(), block.column(1).to_pylist()))
        out = out.mapInArrow(lambda b, s=shared: _keep(s.value, threshold, at, b), docs.schema)
    return out
