"""Toxicity by class-conditional Kneser-Ney models of the characters of words.

Spark counts, for each class, the runs of up to ``ORDER`` characters inside the words (begun by ^, closed by $) of all
labelled rows. A class's probability of a character after its history is its discounted share of the run, interpolated
with the probability after the history without its first character. That lower part both classes share: it is Kneser-Ney
all the way down, from the continuation counts of all runs. A class that has not seen the history takes the shared part in
full, so an expression that one class alone uses weighs all along. After a history, a character that no labelled row has
there takes the ratio of what the classes leave to the shared part; a history that neither class has seen weighs nothing.

A word's log-likelihood ratio of toxic and ordinary is the sum over its characters. A text is judged by such ratios,
normalised by length: that of all its words, by their number; that of the ``WINDOW`` words in a row where it is largest; and,
as toxic texts are ordinary but for some words, that of a text with a share ``MIX`` of toxic words to an ordinary one, by the
number of words and by its root. Logistic regression calibrates these four as a score.

The language models learn from the labelled rows outside the calibration fold, whose rows (at most ``CALIBRATION``, those
with the smallest hash of their id) fit the regression. The table of ratios grows with the corpus: up to ``BROADCAST``
rows it is broadcast, and beyond that the distinct words are joined to it. Ratios are whole numbers, so both ways give the
same scores.

Defined cases: a null text counts as empty, and an empty one has features of 0; texts of any length are scored whole, in
batches bounded by bytes; labels other than 0 and 1, null labels and labels of unknown documents teach nothing; a document
with several labels is learnt with each, one whose id repeats with each of its rows; rows without a doc_id teach nothing
and are scored; without labels of both kinds every score is 0.5; repeated rows are scored each on their own; an empty table
gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import bounded, persisted, slices
from tarn.llm.words import PLAIN, STEP, Words, mixed, raw, words
from tarn.operators.components import looked_up

DISCOUNT = 0.75
ORDER = 7
WINDOW = 12
MIX = 0.02
#: Ratios are kept as whole numbers of 1 / UNIT, so that sums don't depend on their order.
UNIT = 1 << 20
CALIBRATION = 20_000
BROADCAST = 12_000_000
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 4
BEGIN, END = ord("^"), ord("$")
#: Stands for any character that was not seen after a history; it is in no word.
OTHER = 0


def run_keys(points: np.ndarray, place: np.ndarray, other: bool = False) -> np.ndarray:
    """Hash of the up to ORDER characters that end at each one; ``place``: how many stand before it in its word.

    ``other``: with OTHER in the place of the last.
    """
    out = (np.full_like(points, OTHER) if other else points).astype(np.uint64) * STEP[0]
    for k in range(1, ORDER):
        out[k:] += np.where(place[k:] >= k, points[:-k].astype(np.uint64) * STEP[k], np.uint64(0))
    return mixed(out)


def spelled(data: np.ndarray, w: Words, example: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code point, place in the word, word number) of ^, characters and $ of the words numbered by ``example``."""
    runs = [data[w.start[e] : w.end[e]].tobytes().decode("utf-8", "replace").lower() for e in example]
    joined = "".join(f"^{r}$" for r in runs)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, runs), np.int64, len(runs)) + 2
    first = np.cumsum(sizes) - sizes
    return points, np.arange(len(points)) - np.repeat(first, sizes), np.repeat(np.arange(len(runs)), sizes)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> (run, toxic count, ordinary count)."""
    for batch in slices(batches, most=6 << 20):
        data, at = raw(batch.column(1))
        w = words(data, at, PLAIN)
        toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(float)[np.repeat(np.arange(len(at) - 1), np.diff(w.first))]
        _, example, which = np.unique(w.hashes, return_index=True, return_inverse=True)
        both = np.bincount(which, minlength=len(example)).astype(float)
        bad = np.bincount(which, toxic, minlength=len(example))
        points, place, word = spelled(data, w, example)
        inner = place > 0
        distinct, first, which = np.unique(run_keys(points, place)[inner], return_index=True, return_inverse=True)
        n = np.bincount(which, both[word[inner]], minlength=len(distinct))
        t = np.bincount(which, bad[word[inner]], minlength=len(distinct))
        text = points.tobytes()
        ends = np.flatnonzero(inner)[first]
        begins = ends - np.minimum(place[ends], ORDER - 1)
        runs = [text[4 * b : 4 * e + 4].decode("utf-32-le") for b, e in zip(begins, ends, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(runs, pa.string()), pa.array(t.astype(np.int64)), pa.array((n - t).astype(np.int64))], ["run", "t", "o"]
        )


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, ratio) -> (key, ratio)."""
    for batch in batches:
        runs = batch.column(0).to_pylist()
        points = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        ends = np.cumsum(sizes)
        place = np.arange(len(points)) - np.repeat(ends - sizes, sizes)
        keys = run_keys(points, place)[ends - 1] if len(runs) else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(1)], ["key", "ratio"])


def shared(runs: DataFrame) -> DataFrame:
    """``runs`` (run) -> (gram, rest): Kneser-Ney probability of each shorter run's last character after the others.

    It comes from continuation counts, in how many different runs a gram stands with one more character before it, is
    discounted, and is interpolated with that of the gram without its first character, down to the even distribution.
    """
    longer = runs.select(F.explode(F.expr("transform(sequence(2, length(run)), k -> right(run, k))")).alias("s")).distinct()
    grams = longer.groupBy(F.expr("right(s, length(s) - 1)").alias("gram")).agg(F.count("*").alias("n"))
    grams = persisted(grams.select("gram", "n", F.length("gram").alias("k"), F.expr("left(gram, length(gram) - 1)").alias("h")), "grams")
    after = grams.groupBy("k", "h").agg(F.sum("n").alias("whole"), F.count("*").alias("kinds"))
    # a share of its own, and a share of what lies below
    split = [((F.col("n") - DISCOUNT) / F.col("whole")).alias("own"), (DISCOUNT * F.col("kinds") / F.col("whole")).alias("left")]
    grams = persisted(grams.join(after, ["k", "h"]).select("k", "gram", F.expr("right(gram, length(gram) - 1)").alias("low"), *split), "shares")
    even = 1.0 / (grams.filter("k = 1").count() + 1)
    level = grams.filter("k = 1").select("gram", (F.col("own") + F.col("left") * even).alias("rest"))
    found = level
    for k in range(2, ORDER):
        below = level.select(F.col("gram").alias("low"), F.col("rest").alias("lower"))
        level = grams.filter(F.col("k") == k).join(below, "low").select("gram", (F.col("own") + F.col("left") * F.col("lower")).alias("rest"))
        level = persisted(level, "level")
        found = found.unionByName(level)
    return found


def ratios(rows: DataFrame) -> DataFrame:
    """``rows`` (toxic, text) -> (key, ratio): log-likelihood ratio of the last character of a run after the others, times ``UNIT``.

    All runs that the rows hold, and each of their histories followed by OTHER.
    """
    runs = rows.mapInArrow(_counts, "run string, t long, o long").groupBy("run").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    runs = runs.select("t", "o", "run", F.expr("left(run, length(run) - 1)").alias("h"), F.expr("right(run, length(run) - 1)").alias("gram"))
    runs = persisted(runs, "runs")
    seen = lambda c: F.sum((F.col(c) > 0).cast("long"))
    before = runs.groupBy("h").agg(F.sum("t").alias("ct"), F.sum("o").alias("co"), seen("t").alias("kt"), seen("o").alias("ko"))
    before = persisted(before, "histories")

    def left(whole: str, kinds: str) -> Column:
        return F.when(F.col(whole) > 0, DISCOUNT * F.col(kinds) / F.col(whole)).otherwise(F.lit(1.0))

    def given(count: str, whole: str, kinds: str) -> Column:
        own = F.when(F.col(count) > 0, (F.col(count) - DISCOUNT) / F.col(whole)).otherwise(F.lit(0.0))
        return own + left(whole, kinds) * F.col("rest")

    def ratio(toxic: Column, ordinary: Column) -> Column:
        return F.round(F.log(toxic / ordinary) * UNIT).cast("long").alias("ratio")

    found = runs.join(before, "h").join(shared(runs), "gram").select("run", ratio(given("t", "ct", "kt"), given("o", "co", "ko")))
    other = before.select(F.concat("h", F.lit(chr(OTHER))).alias("run"), ratio(left("ct", "kt"), left("co", "ko")))
    return found.unionByName(other).mapInArrow(_keyed, "key long, ratio long")


FEATURES = ("mean", "top", "share", "root")


def mixture(value: np.ndarray) -> np.ndarray:
    """Of words' ratios, those of ordinary language with a share MIX of toxic to ordinary language alone."""
    return np.round(np.log1p(MIX * np.expm1(value / UNIT)) * UNIT).astype(np.int64)


def _features(value: np.ndarray, mix: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """FEATURES of each text, from whole numbers; fewer than WINDOW words count as a window all the same."""
    size = np.diff(first)
    total, mixed_ = (np.concatenate(([0], np.cumsum(x))) for x in (value, mix))
    whole, share = (x[first[1:]] - x[first[:-1]] for x in (total, mixed_))
    owner = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(np.arange(len(value)) + WINDOW <= first[1:][owner])
    top = whole.copy()
    top[size >= WINDOW] = np.iinfo(np.int64).min
    np.maximum.at(top, owner[at], total[at + WINDOW] - total[at])
    n = np.maximum(size, 1)
    return [whole / n / UNIT, top / WINDOW / UNIT, share / n / UNIT, share / np.sqrt(n) / UNIT]


class Table:
    """Ratios by key, as sorted arrays with a map of the keys that may be there."""

    def __init__(self, key: np.ndarray, ratio: np.ndarray) -> None:
        order = np.argsort(key)
        self.key, self.ratio = key[order], ratio[order].astype(np.int32)
        self.maybe = np.zeros(1 << 24, bool)
        self.maybe[self._cell(self.key)] = True

    @staticmethod
    def _cell(key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)

    def put(self, key: np.ndarray, out: np.ndarray) -> None:
        """Ratios of the keys that are there."""
        at = np.flatnonzero(self.maybe[self._cell(key)])
        if len(at) and len(self.key):
            k = np.minimum(np.searchsorted(self.key, key[at]), len(self.key) - 1)
            right = self.key[k] == key[at]
            out[at[right]] = self.ratio[k[right]]


def _scored(table: Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, mark, text) -> (doc_id, mark, features)."""
    for batch in slices(batches, text=2, most=2 << 20):
        data, at = raw(batch.column(2))
        w = words(data, at, PLAIN)
        _, example, which = np.unique(w.hashes, return_index=True, return_inverse=True)
        points, place, word = spelled(data, w, example)
        value = np.zeros(len(points))
        table.put(run_keys(points, place, other=True), value)
        table.put(run_keys(points, place), value)
        value[place == 0] = 0
        value = np.bincount(word, value, minlength=len(example)).astype(np.int64)
        found = _features(value[which], mixture(value)[which], w.first)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, found)], [*batch.schema.names[:2], *FEATURES])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) -> (row, place, hash) of each word."""
    for batch in slices(batches, most=2 << 20):
        data, at = raw(batch.column(1))
        w = words(data, at, PLAIN)
        owner = np.repeat(np.arange(len(at) - 1), np.diff(w.first))
        columns = [batch.column(0).take(pa.array(owner)), pa.array(np.arange(len(owner)) - w.first[owner]), pa.array(w.hashes.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["row", "place", "word"])


def _spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (hash, word), once a batch."""
    for batch in slices(batches, text=0, most=2 << 20):
        data, at = raw(batch.column(0))
        w = words(data, at, PLAIN)
        hashes, example = np.unique(w.hashes, return_index=True)
        runs = [data[w.start[e] : w.end[e]].tobytes().decode("utf-8", "replace").lower() for e in example]
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(runs, pa.string())], ["word", "spelled"])


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, word) -> (hash, key of a run of it, and with OTHER for the last character)."""
    for batch in slices(batches, most=1 << 20):
        data, at = raw(batch.column(1))
        whole = Words(at[:-1], at[1:], np.arange(len(at)), np.zeros(0, np.uint64))
        points, place, word = spelled(data, whole, np.arange(len(at) - 1))
        inner = place > 0
        keys = [pa.array(run_keys(points, place, other)[inner].view(np.int64)) for other in (False, True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(word[inner])), *keys], ["word", "key", "other"])


def _mixtures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, ratio) -> the same with the mixture's."""
    for batch in batches:
        mix = pa.array(mixture(batch.column(1).to_numpy()))
        yield pa.RecordBatch.from_arrays([*batch.columns, mix], ["a", "value", "mix"])


def _joined(rows: DataFrame, table: DataFrame) -> DataFrame:
    """As _scored, for tables that are not broadcast: distinct words are joined to the table, and the texts' words to those.

    All sums are of whole numbers, so both ways give the same scores to the last bit.
    """
    rows = persisted(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    distinct = rows.select("text").mapInArrow(_spellings, "word long, spelled string").dropDuplicates(["word"])
    keys = distinct.mapInArrow(_word_keys, "word long, key long, other long")
    rest = table.select(F.col("key").alias("other"), F.col("ratio").alias("rest"))
    value = keys.join(table, "key", "left").join(rest, "other", "left").groupBy(F.col("word").alias("a"))
    value = value.agg(F.sum(F.coalesce("ratio", "rest", F.lit(0))).alias("value")).mapInArrow(_mixtures, "a long, value long, mix long")
    value = persisted(value.select("a", F.struct("value", "mix").alias("up")), "words")
    tokens = persisted(rows.select("row", "text").mapInArrow(_tokens, "row long, place long, word long"), "tokens")
    tokens = looked_up(tokens, "word", value, "of", few=False).select("row", "place", "of.value", "of.mix")
    run = F.sum("value").over(Window.partitionBy("row").orderBy("place").rowsBetween(1 - WINDOW, 0))
    ends = F.max(F.when(F.col("place") >= WINDOW - 1, F.col("run")))
    n, whole, share = F.count("*").cast("double"), F.sum("value").cast("double"), F.sum("mix").cast("double")
    found = tokens.withColumn("run", run).groupBy("row").agg(
        (whole / n / UNIT).alias("mean"),
        (F.coalesce(ends, F.sum("value")).cast("double") / WINDOW / UNIT).alias("top"),
        (share / n / UNIT).alias("share"),
        (share / F.sqrt(n) / UNIT).alias("root"),
    )
    return rows.join(found, "row", "left").select("doc_id", "mark", *(F.coalesce(f, F.lit(0.0)).alias(f) for f in FEATURES))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression, intercept first, by Newton's method with step halving."""
    scale = x.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(x)), x / scale])

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w)).sum() + ridge / 2 * w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (y - p) - ridge * w)
        while np.abs(step).max() > 1e-9 and loss(w + step) > loss(w):
            step /= 2
        w = w + step
    return np.concatenate((w[:1], w[1:] / scale))


def fold(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(CALIBRATE).cast("long"))


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast: int = BROADCAST
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = labels.filter("toxic in (0, 1)").select(F.col("doc_id"), F.col("toxic").cast("int").alias("mark"), fold("doc_id").alias("fold"))
    marked = persisted(marked.filter(F.col("fold") != HELD_OUT).distinct(), "marked")
    learnt = narrow.join(bounded(marked.filter(F.col("fold") != CALIBRATE)), "doc_id")
    table = persisted(ratios(learnt.select("mark", "text")), "ratios")

    if table.limit(broadcast + 1).count() <= broadcast:
        found = table.toArrow()
        shared = spark.sparkContext.broadcast(
            Table(found.column("key").to_numpy().view(np.uint64), found.column("ratio").to_numpy())
        )
        kind = narrow.schema["doc_id"].dataType.simpleString()

        def features(rows: DataFrame) -> DataFrame:
            schema = f"doc_id {kind}, mark int, " + ", ".join(f"{f} double" for f in FEATURES)
            return rows.select("doc_id", "mark", "text").mapInArrow(lambda b: _scored(shared.value, b), schema)
    else:

        def features(rows: DataFrame) -> DataFrame:
            return _joined(rows.select("doc_id", "mark", "text"), table)

    sample = marked.filter(F.col("fold") == CALIBRATE).orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(CALIBRATION)
    fit = features(narrow.join(F.broadcast(sample), "doc_id")).select("mark", *FEATURES).toPandas().sort_values(["mark", *FEATURES])
    w = np.zeros(1 + len(FEATURES))
    if fit["mark"].nunique() == 2:
        w = logistic(fit[list(FEATURES)].to_numpy(), fit["mark"].to_numpy())
    linear = sum((F.col(f) * float(k) for f, k in zip(FEATURES, w[1:], strict=True)), F.lit(float(w[0])))
    scored = features(narrow.withColumn("mark", F.lit(None).cast("int"))).withColumn("score", 1 / (1 + F.exp(-linear)))
    return scored.select(
        "doc_id",
        (fold("doc_id") == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
