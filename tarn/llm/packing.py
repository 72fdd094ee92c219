"""Best-fit packing of token sequences, improved by swaps.

A pass over the texts cuts each document's ids into pieces. Spark deals the pieces into shards of about ``SHARD`` at
random, whatever document they come from; a shard is packed by best fit, longest first, and then improved by local search:
bins, the least filled first, give pieces to others by moves and by exchanges of one for one, two for one and one for two,
each the one that leaves the other bin fullest and each increasing the squared fill, until no bin of the shard can give
anything, or the shard has as few bins as its length allows. All bins that are not full then meet in new shards, as long as
that empties any and their length allows fewer. A piece as long as a sequence is one by itself.

Defined cases: a null or empty text is one piece that holds the separator only; texts of any length are encoded whole and
cut; repeated rows and rows without doc_id are packed like any others; pieces of equal length go by their number, and equal
exchanges to the bin that holds the shorter piece, then the lower number; an empty table gives no rows; extra columns are
not looked at.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarn.llm.common import SLICE, persisted, slices
from tarn.llm.words import EXACT, VALUE, raw, words

LENGTH = 2048
SEPARATOR = 0
SHARD = 20_000
#: How a tokenizer folds and splits texts whose runs can be encoded one by one.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Bins filled to less than these shares of their capacity meet again across shards: first the emptiest, then all that are not full.
SHARES = (7 / 8, 1)
PIECES = "uid long, doc_id {}, piece int, start long, length long, ids_crc32 long"


class Ids:
    """Token ids of whole texts, each distinct run of characters encoded by the library once.

    The tokenizer lower-cases, splits at white space and between letters and points, and never looks across such a
    place; so runs are told apart by a hash that folds A-Z, and a point or comma after a letter is a run of its own.
    Up to ``KEPT`` runs are kept. A tokenizer of any other kind gets each text whole.
    """

    KEPT, AT_ONCE = 1_200_000, 4096

    def __init__(self, path: str, separator: int = SEPARATOR) -> None:
        self.library, self.separator = Tokenizer.from_file(path), separator
        made = [x and json.loads(x.__getstate__()) for x in (self.library.normalizer, self.library.pre_tokenizer, self.library.post_processor)]
        self.by_runs = made == [NORMALIZER, PRE_TOKENIZER, None]
        self._reset()

    def _reset(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes in order, and each one's place below
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _add(self, hashes: np.ndarray, runs: list[bytes]) -> None:
        ids = []
        for low in range(0, len(runs), self.AT_ONCE):  # what the library gives for a run takes far more space than its ids
            part = [r.decode("utf-8", "replace") for r in runs[low : low + self.AT_ONCE]]
            ids += [one.ids for one in self.library.encode_batch_fast(part, add_special_tokens=False)]
        at = np.searchsorted(self.known, hashes)
        self.slot = np.insert(self.slot, at, np.arange(len(self.size), len(self.size) + len(ids), dtype=np.int32))
        self.known = np.insert(self.known, at, hashes)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(size) - size))
        self.size, self.flat = np.concatenate((self.size, size)), np.concatenate((self.flat, flat))

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each text's closed by the separator, and where each begins."""
        if not self.by_runs:
            whole = [t.ids for t in self.library.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable([*t, self.separator] for t in whole), np.uint32)
            return ids, np.concatenate(([0], np.cumsum([len(t) + 1 for t in whole], dtype=np.int64)))
        data, at = raw(column)
        marked = bool((data[:-1][data[1:] == ord("|")] == ord("<")).any())  # special tokens tell cases apart
        w = words(data, at, EXACT if marked else VALUE, tails=b".,")
        distinct, example, which = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.KEPT:
            self._reset()
        place = np.searchsorted(self.known, distinct)
        fresh = np.ones(len(distinct), bool)
        inside = place < len(self.known)
        fresh[inside] = self.known[place[inside]] != distinct[inside]
        if fresh.any():
            self._add(distinct[fresh], [data[w.start[e] : w.end[e]].tobytes() for e in example[fresh]])
        row = self.slot[np.searchsorted(self.known, distinct)][which]
        closing = np.arange(len(at) - 1) + w.first[1:]  # with a separator after each text's runs
        length = np.zeros(len(which) + len(closing), np.int64)
        shift = np.zeros(len(length), np.int64)
        runs = np.ones(len(length), bool)
        runs[closing] = False
        length[runs], length[closing] = self.size[row], 1
        ends = np.cumsum(length)
        shift[runs] = self.begin[row]
        shift += length - ends
        shift[closing] = -ends[closing] + 1
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(shift, length)
        out = self.flat[place] if len(self.flat) else np.zeros(len(place), np.uint32)
        out[ends[closing] - 1] = self.separator
        return out, np.concatenate(([0], ends[closing]))


@cache
def ids_of(path: str, separator: int = SEPARATOR) -> Ids:
    return Ids(path, separator)


def _cut(path: str, length: int, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = ids_of(path)
    uid = TaskContext.get().partitionId() << 33
    for batch in slices(batches, most=SLICE):
        ids, first = found.texts(batch.column(1))
        size = np.diff(first)
        pieces = -(-size // length)
        owner = np.repeat(np.arange(len(size)), pieces)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * length
        held = np.minimum(length, size[owner] - start)
        begin = first[owner] + start
        parts = [ids[b : b + n] for b, n in zip(begin, held, strict=True)]
        columns = [
            pa.array(uid + np.arange(len(owner))),
            batch.column(0).take(pa.array(owner)),
            pa.array(piece, pa.int32()),
            pa.array(start),
            pa.array(held),
            pa.array([zlib.crc32(p.astype("<u4", copy=False)) for p in parts], pa.int64()),
        ]
        names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
            names.append("ids")
        uid += len(owner)
        yield pa.RecordBatch.from_arrays(columns, names)


def pieces(
    docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece; ``uid`` numbers the pieces, ``with_ids`` adds the ids themselves."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = PIECES.format(narrow.schema["doc_id"].dataType.simpleString()) + (", ids array<int>" if with_ids else "")
    return narrow.mapInArrow(lambda batches: _cut(path, length, with_ids, batches), schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, longest items first, each into the fullest bin that can take it."""
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces, bins = 0, []
    for item in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[item]
        fitting = spaces >> n << n
        if fitting:
            space = (fitting & -fitting).bit_length() - 1
            at = by_space[space].pop()
            if not by_space[space]:
                spaces ^= 1 << space
            bins[at].append(item)
        else:
            space, at = capacity, len(bins)
            bins.append([item])
        if space > n:
            by_space[space - n].append(at)
            spaces |= 1 << (space - n)
    return bins


class Search:
    """Local search over bins. A bin can take length in exchange for items of length ``y`` (0: a move): x if y < x <= y + its space.

    ``singles`` and ``pairs`` hold, for every sum of y and space (the ceiling), heaps of those y over all bins that are not
    full. The exchange that leaves the other bin fullest is at the lowest ceiling from x on whose least y is below x, so it
    is found without looking at the bins. Entries of a bin that has changed since are dropped when they come up.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int) -> None:
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.space = [capacity - sum(lengths[i] for i in b) for b in bins]
        self.version = [0] * len(bins)
        self.singles: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
        self.pairs: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
        self.least_single = np.full(capacity + 1, capacity + 1)
        self.least_pair = np.full(capacity + 1, capacity + 1)
        self.at: list[tuple[list[int], list[int]]] = [([], [])] * len(bins)
        for b in range(len(bins)):
            self._enter(b)

    def sums(self, b: int) -> list[int]:
        """Lengths of two items together, each once."""
        held = sorted(self.lengths[i] for i in self.bins[b])
        once = sorted(set(held))
        found = {x + y for k, x in enumerate(once) for y in once[k + 1 :]} | {2 * x for x, y in pairwise(held) if x == y}
        return sorted(found)

    def _enter(self, b: int) -> None:
        space = self.space[b]
        if not space or not self.bins[b]:
            self.at[b] = ([], [])
            return
        ones, twos = {0, *(self.lengths[i] for i in self.bins[b])}, self.sums(b)
        for ys, heaps, least in ((ones, self.singles, self.least_single), (twos, self.pairs, self.least_pair)):
            for y in ys:
                heapq.heappush(heaps[y + space], (y, b, self.version[b]))
                if y < least[y + space]:
                    least[y + space] = y
        self.at[b] = ([y + space for y in ones], [y + space for y in twos])

    def _leave(self, b: int) -> None:
        self.version[b] += 1
        for ceilings, heaps, least in zip(self.at[b], (self.singles, self.pairs), (self.least_single, self.least_pair), strict=True):
            for t in ceilings:
                heap = heaps[t]
                while heap and heap[0][2] != self.version[heap[0][1]]:
                    heapq.heappop(heap)
                least[t] = heap[0][0] if heap else self.capacity + 1
        self.at[b] = ([], [])

    def _items(self, b: int, total: int, n: int) -> list[int]:
        """n items of the bin with that total length."""
        own = sorted(self.bins[b], key=lambda i: (self.lengths[i], i))
        if n == 1:
            return [next(i for i in own if self.lengths[i] == total)]
        other: dict[int, int] = {}
        for i in own:
            if (j := other.get(total - self.lengths[i])) is not None:
                return [j, i]
            other.setdefault(self.lengths[i], i)
        raise ValueError("no such items")

    def _best(self, a: int) -> tuple[int, list[int], list[int]] | None:
        """(other bin, items out, items back) that leaves the other bin fullest, and fuller than bin a was."""
        ones, best, chosen = sorted({self.lengths[i] for i in self.bins[a]}), self.space[a], None
        ways = [(x, 1, heaps, least, back) for x in ones for heaps, least, back in ((self.singles, self.least_single, 1), (self.pairs, self.least_pair, 2))]
        ways += [(x, 2, self.singles, self.least_single, 1) for x in self.sums(a)]
        for x, n, heaps, least, back in ways:
            fitting = np.flatnonzero(least[x : x + best] < x)
            if len(fitting):
                best = int(fitting[0])
                chosen = (x, n, heaps[x + best][0], back)
                if not best:
                    break
        if chosen is None:
            return None
        x, n, (y, b, _), back = chosen
        return b, self._items(a, x, n), self._items(b, y, back) if y else []

    def _empty(self, a: int) -> bool:
        """Changes bin a as long as that increases the squared fill; whether it did at all."""
        changed = False
        self._leave(a)
        while self.bins[a] and (found := self._best(a)):
            b, out, back = found
            self._leave(b)
            gone, came = set(out), set(back)
            self.bins[a] = [i for i in self.bins[a] if i not in gone] + back
            self.bins[b] = [i for i in self.bins[b] if i not in came] + out
            moved = sum(self.lengths[i] for i in out) - sum(self.lengths[i] for i in back)
            self.space[a] += moved
            self.space[b] -= moved
            self._enter(b)
            changed = True
        self._enter(a)
        return changed

    def run(self) -> None:
        excess = len(self.bins) - -(-sum(self.lengths[i] for b in self.bins for i in b) // self.capacity)
        changed = True
        while changed and excess > 0:
            changed = False
            for a in sorted((b for b in range(len(self.bins)) if self.bins[b] and self.space[b]), key=lambda b: (-self.space[b], b)):
                if excess > 0 and self.bins[a] and self._empty(a):
                    changed = True
                    excess -= not self.bins[a]


def pack(lengths: list[int], capacity: int = LENGTH) -> list[list[int]]:
    """Bins of item numbers: best fit, then the swaps."""
    bins = best_fit(lengths, capacity)
    if bins:
        search = Search(bins, lengths, capacity)
        search.run()
        bins = [b for b in search.bins if b]
    return bins


def _pack(capacity: int, round_: int, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("uid")
    bins = pack(rows.column("length").to_pylist(), capacity)
    shard = rows.column("shard")[0].as_py()
    sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    fill = np.zeros(len(rows), np.int64)
    lengths = rows.column("length").to_numpy()
    for k, items in enumerate(bins):
        sequence[items] = round_ << 54 | shard << 24 | k
        held = lengths[items]
        offset[items] = np.cumsum(held) - held
        fill[items] = held.sum()
    out = rows.drop_columns(["shard"])
    for name, values in (("sequence_id", sequence), ("offset", offset), ("fill", fill)):
        out = out.append_column(name, pa.array(values))
    return out


def _shards(rows: DataFrame, size: int, capacity: int, round_: int) -> DataFrame:
    shards = max(1, round(rows.count() / size))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(shards)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = f"{kinds}, sequence_id long, offset long, fill long"
    return dealt.groupBy("shard").applyInArrow(lambda t: _pack(capacity, round_, t), out)


def _bins(rows: DataFrame, capacity: int) -> tuple[int, int]:
    """Number of bins, and the fewest that their length allows."""
    found = rows.agg(F.countDistinct("sequence_id").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    return found["n"], -(-found["length"] // capacity)


def best_fit_packing(
    docs: DataFrame,
    tokenizer: str | None = None,
    length: int = LENGTH,
    shard: int = SHARD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = persisted(pieces(docs, tokenizer, length, id_col=id_col, text_col=text_col), "pieces")
    whole = found.filter(F.col("length") == length)
    out = whole.withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    round_ = 1
    packed = persisted(_shards(found.filter(F.col("length") < length), shard, length, round_), "packed")
    for share in SHARES:
        while True:
            under = F.col("fill") < length * share
            poor = packed.filter(under)
            n, least = _bins(poor, length)
            if n <= least:
                break
            round_ += 1
            again = persisted(_shards(poor.drop("sequence_id", "offset", "fill"), shard, length, round_), "packed")
            if _bins(again, length)[0] >= n:
                break
            packed = persisted(packed.filter(~under).unionByName(again), "packed")
    out = out.unionByName(packed.drop("fill"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
