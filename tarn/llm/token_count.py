"""Token counts of byte-level BPE by finite-state transducers.

Two machines, both deterministic, both with emissions on their transitions:

* the *splitter* reads classes of characters and emits where words of the BPE pattern begin. Texts are laid end to end
  and cut into chunks; a chunk's state map (state before -> state after) is found for all chunks at once, the maps are
  composed by a parallel prefix scan, and a second pass from the known states collects what is emitted;
* the *counter* reads the bytes of a word and emits by how much the word's token count changes. Its states are compiled
  on demand from the merge list, as what the next bytes can depend on is bounded by the longest token: the last token
  of each prefix that a later token could still reach back to.

Counts are those of the tokenizers library for the same file, special strings in a text counting as one token each.
Null texts count as empty: 0 bytes, 0 tokens. Empty tables give empty results; rows are counted each on its own.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tarn.llm.common import slices

#: Classes of characters; the letters that can follow an apostrophe have their own.
SPACE, WHITE, LETTER, NUMBER, OTHER, APOSTROPHE, ONE, RV, E, L, STOP = range(11)
#: States: nothing open; in a run of letters, numbers, others; white space of one or more, the last a space or not;
#: after an apostrophe that begins a word, and after it and r or v, or l.
FREE, IN_L, IN_N, IN_O, W1S, W1W, WNS, WNW, APO, APO_RV, APO_L = range(11)
#: Emissions: a word begins here, one began at the character before.
HERE, BEFORE = 1, 2
STATES = CLASSES = 11

LETTERS = (LETTER, ONE, RV, E, L)


def _open(c: int) -> int:
    """State after the first character of a word."""
    if c in LETTERS:
        return IN_L
    return {SPACE: W1S, WHITE: W1W, NUMBER: IN_N, OTHER: IN_O, APOSTROPHE: APO}[c]


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) by state and class."""
    to, out = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)
    for s in range(STATES):
        for c in range(STOP):
            kind = IN_L if c in LETTERS else IN_N if c == NUMBER else IN_O if c in (OTHER, APOSTROPHE) else -1
            after, emit = _open(c), HERE
            if s in (IN_L, IN_N, IN_O) and kind == s:
                after, emit = s, 0
            elif s in (W1S, W1W, WNS, WNW):
                if c in (SPACE, WHITE):
                    after, emit = (WNS if c == SPACE else WNW), 0
                else:
                    split = BEFORE if s in (WNS, WNW) else 0
                    joined = s in (W1S, WNS)
                    after, emit = (kind, split) if joined else (after, split | HERE)
            elif s == APO:
                if c in (ONE, RV, L):
                    after, emit = {ONE: FREE, RV: APO_RV, L: APO_L}[c], 0
                elif kind == IN_O:
                    after, emit = IN_O, 0
            elif s in (APO_RV, APO_L):
                if c == (E if s == APO_RV else L):
                    after, emit = FREE, 0
                elif kind == IN_L:
                    after, emit = IN_L, BEFORE
                else:
                    emit = BEFORE | HERE
            to[s, c], out[s, c] = after, emit
        to[s, STOP], out[s, STOP] = FREE, BEFORE if s in (APO_RV, APO_L) else 0
    return to, out


NEXT, EMIT = _splitter()


@cache
def classes() -> np.ndarray:
    """Class of every code point. STOP is no character's: it stands after each text."""
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        c = unicodedata.category(chr(i))[0]
        if c in "LN":
            kinds[i] = LETTER if c == "L" else NUMBER
    white = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    kinds[white] = WHITE
    for chars, k in ((" ", SPACE), ("'", APOSTROPHE), ("stmd", ONE), ("rv", RV), ("e", E), ("l", L)):
        kinds[[ord(x) for x in chars]] = k
    return kinds


STEPS, SETTLE = 512, 32
#: The low byte of an open place of the counter counts from here; tokens hold under 100 bytes that could be tokens.
ZERO = 128


def prefix_maps(maps: np.ndarray) -> np.ndarray:
    """maps[i] composed after all before it, by doubling: log2(chunks) vector steps."""
    maps, reach = maps.copy(), 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    return maps


def word_starts(kinds: np.ndarray) -> np.ndarray:
    """Places at which words begin, for classes of characters that end with STOP."""
    n = len(kinds)
    lanes = max(1, -(-n // STEPS))
    padded = np.full(lanes * STEPS, STOP, np.uint8)
    padded[:n] = kinds
    by_step = np.ascontiguousarray(padded.reshape(lanes, STEPS).T)
    flat_next, flat_emit = NEXT.ravel(), EMIT.ravel()
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[None], lanes, 0)
    for step in by_step[:SETTLE]:
        maps = flat_next[maps * np.uint8(CLASSES) + step[:, None]]
    one = (maps == maps[:, :1]).all(axis=1)  # of these chunks one state is left, whatever came before
    rest, state = maps[~one], maps[one, 0]
    for step in by_step[SETTLE:]:
        rest = flat_next[rest * np.uint8(CLASSES) + step[~one, None]]
        state = flat_next[state * np.uint8(CLASSES) + step[one]]
    maps[~one], maps[one] = rest, state[:, None]
    maps = prefix_maps(maps)
    state = np.zeros(lanes, np.uint8)
    state[1:] = maps[:-1, FREE]
    emitted = np.empty((STEPS, lanes), np.uint8)
    for k, step in enumerate(by_step):
        at = state * np.uint8(CLASSES) + step
        emitted[k], state = flat_emit[at], flat_next[at]
    emitted = emitted.T.ravel()[:n]
    here = (emitted & HERE).astype(bool)
    here[:-1] |= (emitted[1:] & BEFORE).astype(bool)
    return np.flatnonzero(here)


@cache
def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of bytes in vocabulary files of this kind: printable Latin-1 as itself, others from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Counter(dict):
    """word -> tokens, by the counting transducer; as a dict it keeps up to ``KEPT`` words that it has counted."""

    KEPT = 400_000
    COMPILED = 150_000

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"] for t in model["added_tokens"]}
        spelled = lambda token: bytes(alphabet[c] for c in token)
        self.special = sorted(special)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        self.merge = {(spelled(a), spelled(b)): rank for rank, (a, b) in enumerate(merges)}
        tokens = [spelled(t) for t in model["model"]["vocab"] if t not in special]
        #: Prefixes of tokens as numbers, 0 the empty one: (prefix, byte) -> longer prefix, and prefix -> token.
        self.grow: dict[int, int] = {}
        self.token: dict[int, bytes] = {}
        for t in tokens:
            node = 0
            for byte in t:
                node = self.grow.setdefault(node << 8 | byte, len(self.grow) + 1)
            self.token[node] = t
        self.made = {a + b: (a, b) for a, b in self.merge}
        self.valid: dict[int, bool] = {}
        self.edges: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        self._reset()

    def _reset(self) -> None:
        #: A state holds every place at which a later token may still begin, as one number each: the prefix of tokens
        #: read since, the last token before it (0: none), and how many tokens stand before it, less those of the whole.
        self.states: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        self.arcs: dict[int, tuple[int, int]] = {}
        self._id((ZERO,))

    def _id(self, state: tuple[int, ...]) -> int:
        found = self.ids.setdefault(state, len(self.states))
        if found == len(self.states):
            self.states.append(state)
        return found

    def encode(self, word: bytes) -> list[bytes]:
        """Plain BPE: the lowest merge first, leftmost among equals."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranks = [self.merge.get(p, 1 << 60) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 60:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """Parts that stand at that end of the token while BPE builds it, each with the rank of the merge that takes it."""
        key = (token, side)
        if key not in self.edges:
            parts, taken = [], 1 << 60
            while True:
                parts.append((token, taken))
                if token not in self.made:
                    break
                pair = self.made[token]
                token, taken = pair[side], self.merge[pair]
            self.edges[key] = parts
        return self.edges[key]

    def _crossed(self, last: bytes, token: bytes) -> bool:
        """Whether BPE merges a part of one with a part of the other before it has built both."""
        for p, p_taken in self._edge(last, 1):
            for q, q_taken in self._edge(token, 0):
                rank = self.merge.get((p, q))
                if rank is not None and rank < p_taken and rank <= q_taken:
                    return True
        return False

    def _follows(self, last: int, token: int) -> bool:
        """Whether BPE can put ``token`` right after ``last`` (0: at the beginning)."""
        key = last << 24 | token
        found = self.valid.get(key)
        if found is None:
            if len(self.valid) > 1_000_000:
                self.valid.clear()
            a, b = self.token.get(last), self.token[token]
            found = self.valid[key] = not self._crossed(a, b) if a else self.encode(b) == [b]
        return found

    def _compile(self, at: int, byte: int) -> tuple[int, int]:
        """Subset construction: move every open place on by the byte; one of them completes the new last token."""
        still, token, change = [], 0, 0
        for place in self.states[at]:
            node = self.grow.get(place >> 32 << 8 | byte)
            if node:
                if not token and node in self.token and self._follows(place >> 8 & 0xFFFFFF, node):
                    token, change = node, (place & 0xFF) - ZERO + 1
                still.append(place & 0xFFFFFFFF | node << 32)
        if not token:
            raise ValueError("a byte is not in the vocabulary")
        to = self._id((*(x - change for x in still), token << 8 | ZERO))
        self.arcs[at << 8 | byte] = (to, change)
        return to, change

    def count(self, word: bytes) -> int:
        if len(self.states) > self.COMPILED:
            self._reset()
        at = total = 0
        known = self.arcs.get
        for byte in word:
            at, change = known(at << 8 | byte) or self._compile(at, byte)
            total += change
        return total

    def __missing__(self, word: str) -> int:
        if len(self) >= self.KEPT:
            self.clear()
        n = self.count(word.encode("utf-8", "replace"))
        if len(word) < 64:
            self[word] = n
        return n

    def count_texts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        totals = np.zeros(len(texts), np.int64)
        pieces, owner = [], []
        for k, t in enumerate(texts):
            parts = [t]
            for s in self.special:
                if s in t:
                    parts = [x for p in parts for x in p.split(s)]
            totals[k] += len(parts) - 1
            for p in parts:
                if p:
                    pieces.append(p)
                    owner.append(k)
        if not pieces:
            return totals
        joined = "\U0010ffff".join(pieces) + "\U0010ffff"
        kinds = classes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = np.cumsum([len(p) + 1 for p in pieces])
        kinds[ends - 1] = STOP
        starts = word_starts(kinds)
        if not len(starts):
            return totals
        piece = np.searchsorted(ends, starts, "right")
        stops = np.append(starts[1:], len(joined))
        stops = np.minimum(stops, ends[piece] - 1)
        words = [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        counts = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        np.add.at(totals, np.asarray(owner)[piece], counts)
        return totals


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def _count(path: str, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = counter(path)
    for batch in slices(batches):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        sizes = pc.binary_length(batch.column(1)).fill_null(0).cast(pa.int64())
        tokens = pa.array(found.count_texts(texts), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), sizes, tokens, pc.greater(tokens, limit)],
            [batch.schema.names[0], "n_bytes", "n_tokens", "over_limit"],
        )


def count_tokens(
    docs: DataFrame,
    tokenizer: str | None = None,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: UTF-8 bytes, tokens, and whether they are more than ``limit``."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    narrow = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("text"))
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long, over_limit boolean"
    return narrow.mapInArrow(lambda batches: _count(path, limit, batches), schema)
