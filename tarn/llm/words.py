"""Words of whole texts and their 64-bit hashes, for a batch of texts at once.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z taken as lower case. All work is on byte arrays, so a
batch costs a few passes of numpy whatever the number of its texts; null texts count as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEED = 20240229
_RANDOM = np.random.Generator(np.random.PCG64(SEED))
#: A random odd number for each byte and each place in a word; words beyond PLACES bytes take another factor per turn.
PLACES = 1 << 12
BYTE = _RANDOM.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _RANDOM.integers(1, 1 << 63, PLACES, np.uint64) * np.uint64(2) + np.uint64(1)
STEP = _RANDOM.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUE = BYTE[LOWER]
VALUE[SPACE] = 0
#: The same with A-Z kept apart from a-z.
EXACT = np.where(SPACE, np.uint64(0), BYTE)
#: For words of letters and digits only, as VALUE: other ASCII bytes separate words too.
PLAIN = VALUE.copy()
PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each text begins (one more entry than texts)."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    size = int(at[-1] - at[0]) if len(column) else 0
    found = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if size else np.zeros(0, np.uint8)
    return found, at - at[0]


@dataclass
class Words:
    """Words of a batch in order; text k holds the words first[k]:first[k + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def words(data: np.ndarray, at: np.ndarray, value: np.ndarray = VALUE, tails: bytes = b"") -> Words:
    """``value``: a number for each byte, 0 for those between words. ``tails``: such a byte at a word's end, after an ASCII letter, is a word of its own."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(at), np.int64), np.zeros(0, np.uint64))
    inside = (value != 0)[data]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    cut[1:n] |= ~inside[:-1]
    start = np.flatnonzero(inside & cut[:n])
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    cut[1:n] |= ~inside[1:]
    end = np.flatnonzero(inside & cut[1:]) + 1
    if tails:
        last = end - 1
        before = data[np.maximum(last - 1, 0)] | 0x20
        tail = np.isin(data[last], np.frombuffer(tails, np.uint8)) & (last > start) & (before >= 97) & (before <= 122)
        cuts = last[tail]
        start, end = np.sort(np.concatenate((start, cuts))), np.sort(np.concatenate((end, cuts)))
    first = np.searchsorted(start, at)
    if not len(start):
        return Words(start, end, first, np.zeros(0, np.uint64))
    place = np.arange(n, dtype=np.int64)
    place[start[0] :] -= np.repeat(start, np.diff(np.append(start, n)))
    values = value[data]
    values *= PLACE[place & (PLACES - 1)]
    if (end - start).max() > PLACES:
        turn = (place // PLACES).astype(np.uint64)
        values *= turn * np.uint64(2) + np.uint64(1)
    return Words(start, end, first, mixed(np.add.reduceat(values, start)))


def grams(w: Words, n: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word runs inside each text, and where each text's runs begin.

    ``whole``: a text of 1 to n - 1 words has one run, its whole sequence.
    """
    count = np.diff(w.first)
    runs = np.maximum(count - n + 1, 0)
    if whole:
        runs = np.where((count > 0) & (count < n), 1, runs)
    first = np.concatenate(([0], np.cumsum(runs)))
    total = int(first[-1])
    if not total:
        return np.zeros(0, np.uint64), first
    begin = np.arange(total, dtype=np.int64) + np.repeat(w.first[:-1] - first[:-1], runs)
    if not whole or (count[count > 0] >= n).all():
        out = np.zeros(total, np.uint64)
        for k in range(n):
            out += w.hashes[begin + k] * STEP[k]
        return mixed(out), first
    last = np.repeat(w.first[1:], runs)
    out = np.zeros(total, np.uint64)
    for k in range(n):
        held = begin + k < last
        out += np.where(held, w.hashes[np.minimum(begin + k, len(w.hashes) - 1)] * STEP[k], STEP[32 + k])
    return mixed(out), first
