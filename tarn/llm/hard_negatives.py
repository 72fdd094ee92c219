"""Hard negatives by blocked matrix products: a wave of anchors against every row, in two passes.

Components become whole numbers, so inner products are exact in float64 as long as they stay below 2^53; rows that could
pass that are multiplied as Python integers. Anchors are dealt into waves of at most ``WAVE_BYTES``, which bounds what is
broadcast at once, and each wave meets all rows where they lie, in blocks of both sides: the first pass keeps each anchor's
best ``POSITIVES`` rows of its label, task by task, and these merge into its positives; the second finds, for each anchor and
positive, the best ``NEGATIVES`` rows of other labels whose scores lie in the window that the positive's score sets. Both are
lists of a fixed length that merge in any order, so no row of a hot label, and no common vector, is dealt to one task.

Defined cases: rows whose id, label, vector or any component is null, or one not finite, take no part; rows of different lengths
have no score, so they never meet; ties go to the smaller id; rows with the anchor's own id are no candidates of it; anchors equal in
id, label and vector are one anchor, other repeated rows count each; a negative positive_score leaves an empty window; a score beyond
64 bits raises an error; an empty table, or one without anchors, gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import persisted

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A positive's window: 30 positive_score <= 100 negative_score <= 90 positive_score.
LOW, HIGH, OF = 30, 90, 100
#: Bytes of anchors in a wave (as float64), and rows of a block on either side.
WAVE_BYTES = 32 << 20
ANCHOR_BLOCK, ROW_BLOCK = 256, 4096
EXACT = 1 << 53
_NONE = np.iinfo(np.int64).min + 1
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors.astype(np.float64))


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact, as int64."""
    reach = np.abs(anchors).max(initial=0) * np.abs(rows).sum(axis=1)
    large = ~(reach < EXACT)
    if not large.any():
        return (anchors @ rows.T).astype(np.int64)
    out = (anchors @ np.where(large[:, None], 0, rows).T).astype(np.int64)
    exact = [[sum(int(x) * int(y) for x, y in zip(a, r, strict=True)) for r in rows[large]] for a in anchors]
    out[:, large] = np.array(exact, object).astype(np.int64)
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of each line, ties to the smaller id; ``_NONE`` stands for no row."""
    ids = np.broadcast_to(ids, scores.shape)
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, [scores.shape[1] - k]]
        above = scores > kth
        # of those level with the k-th the smallest ids, as ids go up from left to right
        level = scores == kth
        keep = above | (level & (level.cumsum(axis=1) <= k - above.sum(axis=1, keepdims=True)))
        at = np.nonzero(keep)[1].reshape(len(scores), k)
        scores, ids = np.take_along_axis(scores, at, axis=1), np.take_along_axis(ids, at, axis=1)
    return scores, ids


def merged(old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    scores, ids = (np.concatenate(x, axis=1) for x in zip(old, new, strict=True))
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)


class Wave:
    """Anchors of one length: numbers within the wave, ids, labels and vectors; later each one's positives."""

    def __init__(self, number: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.number, self.ids, self.labels, self.vectors = number, ids, labels, whole(vectors)
        self.scores = np.full((len(ids), POSITIVES), _NONE)

    def windows(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each place of a positive, by anchor: the least and the greatest score of its negatives."""
        score = self.scores.astype(object)
        least, most = -(-LOW * score // OF), HIGH * score // OF
        low = np.where(self.scores == _NONE, 1, least).astype(np.int64)
        high = np.where(self.scores == _NONE, 0, most).astype(np.int64)
        return list(zip(low.T, high.T, strict=True))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """Lengths of the lists, and a matrix of those lists (of one length) whose places are given."""
    size, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(size) - size
    return size, lambda at: flat[begin[at, None] + np.arange(size[at[0]])]


def _blocks(waves: dict[int, Wave], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, anchors, ids, labels, scores) of each block of rows with each block of anchors of its length; ids ascend."""
    for batch in batches:
        size, vectors = _lists(batch.column(2))
        for length in np.unique(size):
            if (wave := waves.get(int(length))) is None:
                continue
            own = np.flatnonzero(size == length)
            ids = batch.column(0).to_numpy()[own]
            order = np.argsort(ids, kind="stable")
            own, ids = own[order], ids[order]
            labels = batch.column(1).to_numpy()[own]
            for i in range(0, len(own), ROW_BLOCK):
                at = slice(i, i + ROW_BLOCK)
                rows = whole(vectors(own[at]))
                for a in range(0, len(wave.ids), ANCHOR_BLOCK):
                    of = slice(a, a + ANCHOR_BLOCK)
                    yield int(length), of, ids[at], labels[at], products(wave.vectors[of], rows)


def _nothing(wave: Wave, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((len(wave.ids), k), _NONE), np.zeros((len(wave.ids), k), np.int64)


def _positives(waves: dict[int, Wave], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, vector) -> number of the anchor, positive_id, score: the best of this task."""
    found = {length: _nothing(w, POSITIVES) for length, w in waves.items()}
    for length, of, ids, labels, scores in _blocks(waves, batches):
        w, (held, places) = waves[length], found[length]
        fit = (labels == w.labels[of, None]) & (ids != w.ids[of, None])
        held[of], places[of] = merged((held[of], places[of]), best(np.where(fit, scores, _NONE), ids, POSITIVES), POSITIVES)
    for length, (scores, ids) in found.items():
        line, place = np.nonzero(scores != _NONE)
        if len(line):
            yield pa.RecordBatch.from_arrays(
                [pa.array(waves[length].number[line]), pa.array(ids[line, place]), pa.array(scores[line, place])], ["number", "positive_id", "positive_score"]
            )


def _negatives(waves: dict[int, Wave], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, vector) -> number of the anchor, place of its positive, negative_id, score: the best of this task."""
    windows = {length: w.windows() for length, w in waves.items()}
    found = {length: [_nothing(w, NEGATIVES) for _ in range(POSITIVES)] for length, w in waves.items()}
    for length, of, ids, labels, scores in _blocks(waves, batches):
        other = labels != waves[length].labels[of, None]
        for (low, high), (held, places) in zip(windows[length], found[length], strict=True):
            fit = other & (scores >= low[of, None]) & (scores <= high[of, None])
            held[of], places[of] = merged((held[of], places[of]), best(np.where(fit, scores, _NONE), ids, NEGATIVES), NEGATIVES)
    for length, of_places in found.items():
        for place, (scores, ids) in enumerate(of_places):
            line, at = np.nonzero(scores != _NONE)
            if len(line):
                columns = [waves[length].number[line], np.full(len(line), place, np.int32), ids[line, at], scores[line, at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["number", "place", "negative_id", "negative_score"])


def usable(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """Rows (id, label, vector) that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite))


def _wave(anchors: pa.Table) -> dict[int, Wave]:
    number, ids, labels = (anchors.column(c).to_numpy() for c in ("number", "id", "label"))
    size, vectors = _lists(anchors.column("vector").combine_chunks())
    return {int(n): Wave(*(x[size == n] for x in (number, ids, labels)), vectors(np.flatnonzero(size == n))) for n in np.unique(size)}


def _mined(rows: DataFrame, anchors: pa.Table) -> DataFrame:
    """One wave's result."""
    spark, waves = rows.sparkSession, _wave(anchors)
    shared = spark.sparkContext.broadcast(waves)
    found = rows.mapInArrow(lambda batches: _positives(shared.value, batches), "number long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = persisted(found.withColumn("place", place - 1).filter(F.col("place") < POSITIVES), "positives")
    known = chosen.toArrow()  # at most POSITIVES rows an anchor of the wave
    at, places, scores = (known.column(c).to_numpy() for c in ("number", "place", "positive_score"))
    for w in waves.values():
        line = np.full(len(anchors), -1)
        line[w.number] = np.arange(len(w.number))
        own = line[at] >= 0
        w.scores[line[at[own]], places[own]] = scores[own]
    again = spark.sparkContext.broadcast(waves)
    found = rows.mapInArrow(lambda batches: _negatives(again.value, batches), "number long, place int, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("number", "place").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= NEGATIVES)
    names = spark.createDataFrame(anchors.select(["number", "id"]))
    joined = ranked.join(chosen, ["number", "place"]).join(names, "number")
    return joined.select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", wave_bytes: int = WAVE_BYTES
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score; ``is_anchor`` is about ``vectors``."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, label_col, vector_col)
    marked = usable(vectors.filter(is_anchor), id_col, label_col, vector_col)
    anchors = persisted(marked.distinct(), "anchors")
    size = anchors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("length")).first()
    most = max(1, wave_bytes // (8 * max(1, size["length"])))
    waves = -(-size["n"] * 4 // (3 * most))  # three quarters full on average, so that none overflows
    dealt = persisted(anchors.withColumn("wave", F.pmod(F.xxhash64("id", "label", "vector"), F.lit(max(1, waves)))), "waves")
    out = spark.createDataFrame([], OUT)
    for wave in range(waves):
        own = dealt.filter(F.col("wave") == wave).drop("wave").toArrow()
        for start in range(0, len(own), most):
            part = own.slice(start, most)
            if len(part):
                found = _mined(rows, part.append_column("number", pa.array(np.arange(len(part)))))
                out = out.unionByName(persisted(found, "mined") if waves > 1 else found)
    return out
