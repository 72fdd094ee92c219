"""Harmonic packing of token sequences: classes of pieces whose lengths are the capacity divided by a whole number.

A piece of class k is as long as the k-th part of a sequence, and a sequence of class k holds exactly k of them. Documents
may be cut, so each is cut into lengths of the classes 1, 2, 4, ... (those parts of a power of two that leave nothing over):
whole sequences first, then at most one piece of each further class, as the binary digits of the rest tell. A worker holds
one open sequence a class, closes it at its k-th piece, and needs nothing from any other worker: the packing is one pass
over the documents without a shuffle. What a worker holds open at its end (under one sequence a class) is joined
longest first; lengths that divide each other leave no gaps, so this makes full sequences and then, from the last tokens,
one sequence for each binary digit of their number. Every sequence is full or as long as a power of two: nothing is padded.

Defined cases: a null or empty text is one piece that holds the separator only; texts of any length are encoded whole and
cut; repeated rows and rows without doc_id are packed like any others; equal lengths go in the order of their rows; an
empty table gives no rows; extra columns are not looked at. Two runs over the same files give the same sequences; other
partitions of the input give others, with no padding either.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import slices
from tarn.llm.packing import ids_of

LENGTH = 2048
SEPARATOR = 1
OUT = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces, documents in order, each one's longest first."""
    bits = 1 << np.arange(capacity.bit_length() - 2, -1, -1)
    rest = sizes % capacity
    held = (rest[:, None] & bits) > 0
    whole = sizes // capacity
    count = whole + held.sum(axis=1)
    owner = np.repeat(np.arange(len(sizes)), count)
    length = np.full(len(owner), capacity, np.int64)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    length[place >= whole[owner]] = np.broadcast_to(bits, held.shape)[held]
    ends = np.cumsum(length)
    return owner, ends - length - np.repeat(np.cumsum(sizes) - sizes, count), length


class Packer:
    """One worker's open sequences: pieces come in as Arrow rows with ``length``, and go out with their sequence and offset."""

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.sequence, self.open = capacity, first, []

    def _placed(self, rows: pa.RecordBatch, sequence: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
        for name, values in (("sequence_id", sequence), ("offset", offset)):
            rows = rows.append_column(name, pa.array(values, pa.int64()))
        return rows

    def add(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        """The rows whose sequences are complete now."""
        rows = pa.concat_batches([*self.open, rows])
        lengths = rows.column("length").to_numpy()
        order = np.argsort(-lengths, kind="stable")
        lengths, first, count = np.unique(-lengths[order], return_index=True, return_counts=True)
        length = -lengths
        k = self.capacity // length  # pieces in a sequence of the class
        place = np.arange(len(order)) - np.repeat(first, count)
        closed = place < np.repeat(count // k * k, count)
        begin = self.sequence + np.cumsum(count // k) - count // k
        self.sequence += int((count // k).sum())
        sequence = np.repeat(begin, count) + place // np.repeat(k, count)
        offset = place % np.repeat(k, count) * np.repeat(length, count)
        self.open = [rows.take(pa.array(np.sort(order[~closed])))]
        return self._placed(rows.take(pa.array(order[closed])), sequence[closed], offset[closed])

    def close(self) -> pa.RecordBatch | None:
        """What is left, longest first: full sequences, then one for each binary digit of the last tokens."""
        if not self.open or not len(self.open[0]):
            return None
        lengths = self.open[0].column("length").to_numpy()
        order = np.argsort(-lengths, kind="stable")
        begin = np.cumsum(lengths[order]) - lengths[order]
        total, sequence, offset = int(lengths.sum()), np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        full = total // self.capacity
        ends = [self.capacity * (i + 1) for i in range(full)]
        for bit in range(self.capacity.bit_length() - 2, -1, -1):
            if total >> bit & 1:
                ends.append((ends[-1] if ends else 0) + (1 << bit))
        at = np.searchsorted(ends, begin, side="right")
        sequence, offset = self.sequence + at, begin - np.array([0, *ends])[at]
        return self._placed(self.open[0].take(pa.array(order)), sequence, offset)


def _pack(path: str, separator: int, capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = ids_of(path, separator)
    packer = Packer(capacity, TaskContext.get().partitionId() << 33)
    for batch in slices(batches, most=2 << 20):
        ids, first = found.texts(batch.column(1))
        sizes = np.diff(first)
        owner, start, length = cut(sizes, capacity)
        begin = first[owner] + start
        crc = [zlib.crc32(ids[b : b + n].astype("<u4", copy=False)) for b, n in zip(begin, length, strict=True)]
        columns = [batch.column(0).take(pa.array(owner)), *(pa.array(x, pa.int64()) for x in (start, length, crc, sizes[owner]))]
        yield packer.add(pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]))
    if (last := packer.close()) is not None:
        yield last


def harmonic_packing(
    docs: DataFrame,
    tokenizer: str | None = None,
    length: int = LENGTH,
    separator: int = SEPARATOR,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. ``length`` is a power of two."""
    if length < 2 or length & (length - 1):
        raise ValueError("sequences have to be as long as a power of two")
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = OUT.format(narrow.schema["doc_id"].dataType.simpleString())
    return narrow.mapInArrow(lambda batches: _pack(path, separator, length, batches), out)
