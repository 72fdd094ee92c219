"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes a space, and runs of 1 to ``ORDERS`` characters are hashed into
``BUCKETS`` cells. The model is a matrix of log probabilities, BUCKETS x languages, whose size does not depend on the
corpus (256 KB a language: some 2000 languages fit an executor of 3 GB); it is broadcast, and each batch of texts is scored as
sparse rows of cell numbers. All languages count as equally likely beforehand. The model is learnt from a sample of labelled
rows: those of the up to ``PER_LANG`` ids of the smallest hashes in each language. Which ids these are is found by counting distinct
hashes in cells, so no text is shuffled and a language with most of the rows is no hot task.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing could be learnt;
equal scores go to the first language in order; repeated rows are taken each on their own (a sampled id that repeats
teaches with each of its rows, however many); rows without an id are one id; texts of any length are scored whole, in batches bounded
by bytes; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import SLICE, slices, texts

ORDERS = 3
BITS = 16
BUCKETS = 1 << BITS
PER_LANG = 5000
SMOOTH = 0.5
UNKNOWN = "und"
#: A document whose best language has less of the posterior than this is not of a known language.
LEAST = 0.5
#: Ids a language that may be in the sample, as a multiple of those taken, and cells that their hashes are counted in.
SPARE, CELLS = 4, 4096
_STEP = np.random.Generator(np.random.PCG64(6)).integers(1, 1 << 63, ORDERS, np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def letters() -> np.ndarray:
    """Each letter's code point, 32 for all others."""
    found = np.full(sys.maxunicode + 1, 32, np.uint32)
    for i in range(sys.maxunicode + 1):
        if unicodedata.category(chr(i))[0] == "L":
            found[i] = i
    return found


def cells(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(cell, text number) of every n-gram that holds a letter, texts in order."""
    joined = "".join(f" {t}{' ' * (ORDERS - 1)}" for t in found)
    joined = joined.lower() if len(joined) == len(joined.lower()) else "".join(c.lower()[0] for c in joined)
    points = letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    owner = np.repeat(np.arange(len(found)), [len(t) + ORDERS for t in found])
    n = max(0, len(points) - ORDERS + 1)
    out, owners = [], []
    state, letter = np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(ORDERS):
        state = state + points[k : k + n] * _STEP[k]
        letter = letter | (points[k : k + n] != 32)
        mixed = (state ^ (state >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        own = letter & (owner[:n] == owner[k : k + n])
        out.append((mixed[own] >> np.uint64(64 - BITS)).astype(np.int32))
        owners.append(owner[:n][own])
    return np.concatenate(out), np.concatenate(owners)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, cell, n)."""
    held: dict[str, np.ndarray] = {}
    for batch in slices(batches, most=SLICE):
        langs, found = batch.column(0).to_pylist(), texts(batch)
        at, owner = cells(found)
        for lang in set(langs):
            own = np.array([x == lang for x in langs])
            total = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
            total += np.bincount(at[own[owner]], minlength=BUCKETS)
    for lang, total in held.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "cell", "n"]
        )


def sampled(rows: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """The rows (doc_id, text, lang) whose ids have the smallest hashes of their language: as many whole cells as hold ``per_lang``."""
    known = rows.filter("lang is not null").withColumn("at", F.coalesce(F.xxhash64("doc_id"), F.lit(0)))
    count = known.groupBy("lang").agg(F.approx_count_distinct("at", 0.02).alias("n"))
    reach = F.broadcast(count.select("lang", F.least(F.lit(1.0), SPARE * per_lang / F.col("n")).alias("reach")))
    # xxhash64 is even over the longs, so a hash's place among all tells how many distinct ones are likely below it
    placed = known.join(reach, "lang").withColumn("cell", F.floor((F.col("at") / 2.0**64 + 0.5) / F.col("reach") * CELLS))
    held = placed.filter(F.col("cell") <= CELLS).select("lang", "cell", "at").distinct().groupBy("lang", "cell").agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.partitionBy("lang").orderBy("cell"))
    # a language's first cell is taken whatever it holds, so none is lost
    fits = (F.col("below") <= per_lang) | (F.col("below") == F.col("n"))
    last = held.withColumn("below", below).filter(fits).groupBy("lang").agg(F.max("cell").alias("last"))
    return placed.join(F.broadcast(last), "lang").filter("cell <= last").select("doc_id", "text", "lang")


def learn(rows: DataFrame, per_lang: int = PER_LANG) -> tuple[list[str], np.ndarray]:
    """``rows`` (doc_id, text, lang) -> languages in order, and their log probabilities by cell."""
    kept = sampled(rows, per_lang).filter("text is not null")
    counts = kept.select("lang", "text").mapInArrow(_counts, "lang string, cell int, n long")
    found = counts.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    names = found.column("lang").to_pylist()
    langs = sorted(set(names))
    place = {lang: k for k, lang in enumerate(langs)}
    matrix = np.full((BUCKETS, len(langs)), SMOOTH)
    matrix[found.column("cell").to_numpy(), [place[x] for x in names]] += found.column("n").to_numpy()
    return langs, np.log(matrix / matrix.sum(axis=0)).astype(np.float32)


def _score(langs: list[str], matrix: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=SLICE):
        found = texts(batch)
        total = np.zeros((len(found), max(1, len(langs))))
        at, owner = cells(found)
        seen = np.bincount(owner, minlength=len(found)) > 0
        for k in range(len(langs)):
            total[:, k] = np.bincount(owner, matrix[at, k], minlength=len(found))
        share = np.exp(total - total.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = total.argmax(axis=1)
        sure = seen & bool(langs)
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(k) for k in (0, 2)),
                pa.array([langs[b] if s else UNKNOWN for b, s in zip(best, sure, strict=True)], pa.string()),
                pa.array(np.where(sure, share[np.arange(len(found)), best], 0.0)),
            ],
            ["doc_id", "held_out", "lang_pred", "score"],
        )


def held_out(doc_id: str | Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _model(docs: DataFrame, learn_from: DataFrame | None, id_col: str, text_col: str) -> tuple[list[str], Broadcast]:
    train = (learn_from if learn_from is not None else docs).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    langs, matrix = learn(train.filter(~held_out("doc_id")))
    return langs, docs.sparkSession.sparkContext.broadcast(matrix)


def identify(docs: DataFrame, learn_from: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (its share of the posterior)."""
    langs, shared = _model(docs, learn_from, id_col, text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held_out")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    return rows.mapInArrow(lambda batches: _score(langs, shared.value, batches), out)


def keep_known(
    docs: DataFrame, wanted: tuple[str, ...] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents of a language that is ``wanted`` (default: of any that was learnt), with at least that score.

    Each row is decided by its own text, in one pass. Where no row says its language, nothing can be rejected but texts
    without a letter.
    """
    langs, shared = _model(docs, None, id_col, text_col)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=at, most=SLICE):
            text = batch.column(at).cast(pa.string())
            if langs:
                none = pa.nulls(len(text), pa.bool_())
                scored = next(_score(langs, shared.value, iter([pa.RecordBatch.from_arrays([none, text, none], ["doc_id", "text", "held_out"])])))
                pred, score = scored.column(2).to_pylist(), scored.column(3).to_numpy()
                kept = np.array([p != UNKNOWN and (wanted is None or p in wanted) for p in pred], bool) & (score >= least)
            else:
                kept = np.isin(np.arange(len(text)), cells([t or "" for t in text.to_pylist()])[1])
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(keep, docs.schema)
