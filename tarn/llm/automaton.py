"""Byte automata for many rules at once.

Rules are small trees made with ``lit``, ``cls``, ``seq``, ``alt``, ``opt``, ``star`` and ``plus``. Each rule's
leftmost, greedy search is determinised by subset construction over ordered thread lists; the rules run side by side
as one machine, which is minimised and laid out as transition arrays. Its transitions say which rules' matches
have just ended; a small reversed automaton of the rule then finds where such a match began.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field
from functools import cached_property

MATCH = -1


def cls(chars: str) -> tuple:
    return ("cls", frozenset(chars.encode()))


def lit(text: str, any_case: bool = False) -> tuple:
    return seq(*(cls(c.lower() + c.upper() if any_case and c in string.ascii_letters else c) for c in text))


def seq(*parts: tuple) -> tuple:
    return ("seq", parts)


def alt(*parts: tuple) -> tuple:
    return ("alt", parts)


def opt(part: tuple) -> tuple:
    return ("opt", part)


def star(part: tuple) -> tuple:
    return ("star", part)


def plus(part: tuple) -> tuple:
    return seq(part, star(part))


def at_least(part: tuple, n: int) -> tuple:
    return seq(*[part] * n, star(part))


def reverse(tree: tuple) -> tuple:
    kind, body = tree
    if kind == "cls":
        return tree
    if kind == "seq":
        return (kind, tuple(reverse(p) for p in reversed(body)))
    return (kind, tuple(reverse(p) for p in body) if kind == "alt" else reverse(body))


@dataclass
class Nfa:
    """State i reads a byte of ``reads[i]`` and goes on with ``after[i]``, a list of states in order of preference."""

    reads: list[frozenset[int]] = field(default_factory=list)
    after: list[tuple[int, ...]] = field(default_factory=list)
    first: tuple[int, ...] = ()

    @classmethod
    def of(cls_, tree: tuple) -> Nfa:
        nfa = cls_()
        nfa.first = nfa._add(tree, (MATCH,))
        return nfa

    def _add(self, tree: tuple, then: tuple[int, ...]) -> tuple[int, ...]:
        """Entry states of ``tree`` followed by ``then``."""
        kind, body = tree
        if kind == "cls":
            self.reads.append(body)
            self.after.append(then)
            return (len(self.reads) - 1,)
        if kind == "seq":
            for part in reversed(body):
                then = self._add(part, then)
            return then
        if kind == "alt":
            return _unique(s for part in body for s in self._add(part, then))
        if kind == "opt":
            return _unique((*self._add(body, then), *then))
        low = len(self.reads)  # star: what ends the body may enter it again
        hook = -2 - low
        entry = self._add(body, (hook,))
        loop = _unique((*entry, *then))
        for i in range(low, len(self.reads)):
            if hook in self.after[i]:
                self.after[i] = _unique(x for s in self.after[i] for x in (loop if s == hook else (s,)))
        return loop


def _unique(states) -> tuple[int, ...]:
    return tuple(dict.fromkeys(states))


class Search:
    """Deterministic leftmost-greedy search of one rule, one byte at a time.

    A state is the ordered tuple of live threads; threads after MATCH are dropped, and no new start is tried while a
    match is open. A rule must keep matching from its first match to its last byte; others are refused.
    """

    def __init__(self, tree: tuple) -> None:
        self.nfa = Nfa.of(tree)
        if MATCH in self.nfa.first:
            raise ValueError("a rule must not match the empty string")
        self.start = self.nfa.first
        self.known: dict = {}

    def step(self, state: tuple[int, ...], byte: int) -> tuple[tuple[int, ...], bool]:
        """The next state, and whether a match ended just before this byte."""
        key = (state, byte)
        if key not in self.known:
            self.known[key] = self._step(state, byte)
        return self.known[key]

    def _step(self, state: tuple[int, ...], byte: int) -> tuple[tuple[int, ...], bool]:
        nfa, out = self.nfa, []
        for s in state:
            if s != MATCH and byte in nfa.reads[s]:
                for x in nfa.after[s]:
                    if x not in out:
                        out.append(x)
        if MATCH in out:
            return tuple(out[: out.index(MATCH) + 1]), False
        if MATCH in state:
            if out:
                raise ValueError("a rule must match at every byte once it has matched")
            return self.step(self.start, byte)[0], True
        return _unique((*out, *self.start)), False


@dataclass
class Machine:
    """Minimised product of the searches. ``rows[s][byte]`` is the next state, or ``size + k`` for ``events[k]``."""

    rows: list[list[int]]
    events: list[tuple[int, int]]
    open: list[int]

    @property
    def size(self) -> int:
        return len(self.rows)

    @classmethod
    def of(cls_, trees: list[tuple]) -> Machine:
        searches = [Search(t) for t in trees]
        groups: dict[tuple, int] = {}
        group = [
            groups.setdefault(tuple(b in r for s in searches for r in s.nfa.reads), len(groups)) for b in range(256)
        ]
        samples = [group.index(g) for g in range(len(groups))]
        ids = {tuple(s.start for s in searches): 0}
        queue, table = list(ids), []
        for state in queue:
            row = []
            for byte in samples:
                steps = [s.step(x, byte) for s, x in zip(searches, state, strict=True)]
                to = tuple(x for x, _ in steps)
                if to not in ids:
                    ids[to] = len(ids)
                    queue.append(to)
                row.append((ids[to], sum(ended << k for k, (_, ended) in enumerate(steps))))
            table.append(row)
        still_open = [sum((MATCH in x) << k for k, x in enumerate(state)) for state in queue]
        block = _minimise(table, still_open)
        first = {b: i for i, b in reversed(list(enumerate(block)))}
        order = sorted(first, key=first.get)
        place = {b: k for k, b in enumerate(order)}
        events: dict[tuple[int, int], int] = {}
        rows = []
        for b in order:
            short = [
                place[block[to]] if not ended else len(order) + events.setdefault((place[block[to]], ended), len(events))
                for to, ended in table[first[b]]
            ]
            rows.append([short[g] for g in group])
        return cls_(rows, list(events), [still_open[first[b]] for b in order])


def _minimise(table: list[list[tuple[int, int]]], still_open: list[int]) -> list[int]:
    """Block of each state: states of a block cannot be told apart by what they report."""
    block = [0] * len(table)
    while True:
        keys: dict[tuple, int] = {}
        fresh = [
            keys.setdefault((block[i], still_open[i], tuple((block[t], e) for t, e in row)), len(keys))
            for i, row in enumerate(table)
        ]
        if len(keys) == len(set(block)):
            return fresh
        block = fresh


class Backward:
    """Lazily determinised reversed rule: the earliest start of a match that ends at a given place."""

    def __init__(self, tree: tuple) -> None:
        self.nfa = Nfa.of(reverse(tree))

    @cached_property
    def cache(self) -> dict:
        return {}

    def start(self, data: bytes, end: int, floor: int) -> int:
        state, found = frozenset(self.nfa.first), end
        for i in range(end - 1, floor - 1, -1):
            key = (state, data[i])
            to = self.cache.get(key)
            if to is None:
                to = frozenset(x for s in state if s != MATCH and data[i] in self.nfa.reads[s] for x in self.nfa.after[s])
                self.cache[key] = to
            if not to:
                break
            if MATCH in to:
                found = i
            state = to
        return found
