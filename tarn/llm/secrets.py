"""Secret scan: all rules in one byte pass over each whole text.

Null texts count as empty; empty texts and tables give zero counts and the digest of the empty string; repeated rows are
scanned each on its own; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tarn.llm.automaton import Backward, Machine, alt, at_least, cls, lit, opt, plus, seq, star

ALNUM = string.ascii_letters + string.digits
QUOTE = opt(cls("\"'"))


@dataclass(frozen=True)
class Rule:
    """``tree`` finds a match; it counts if ``check`` matches the whole of it."""

    kind: str
    tree: tuple
    check: re.Pattern


#: The first three are the base kinds, in the order in which kinds at one place are listed.
RULES = (
    Rule(
        "assign",
        seq(
            alt(*(lit(w, any_case=True) for w in ("password", "passwd", "secret", "token", "apikey", "api_key"))),
            QUOTE,
            star(cls(" ")),
            cls(":="),
            star(cls(" ")),
            QUOTE,
            plus(cls(ALNUM + "+/_.=-")),
        ),
        re.compile(rb"""(?s)[A-Za-z_]+["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}"""),
    ),
    Rule("access", seq(lit("AKIA"), plus(cls(string.ascii_uppercase + string.digits))), re.compile(rb"(?s).{18,}")),
    Rule("hex", at_least(cls("0123456789abcdef"), 16), re.compile(rb"(?s).{16,}")),
    Rule("code_host", seq(lit("gh"), cls("oprsu"), lit("_"), plus(cls(ALNUM))), re.compile(rb"(?s).{40,}")),
    Rule("chat", seq(lit("xox"), cls("abprs"), lit("-"), plus(cls(ALNUM + "-"))), re.compile(rb"(?s).{15,}")),
    Rule("cloud_key", seq(lit("AIza"), plus(cls(ALNUM + "_-"))), re.compile(rb"(?s).{39,}")),
    Rule(
        "private_key",
        seq(lit("-----BEGIN "), star(cls(string.ascii_uppercase + " ")), lit("PRIVATE KEY-----")),
        re.compile(rb"(?s).+"),
    ),
    Rule(
        "signed_token",
        seq(lit("eyJ"), plus(cls(ALNUM + "_-")), lit("."), plus(cls(ALNUM + "_-")), lit("."), plus(cls(ALNUM + "_-"))),
        re.compile(rb"(?s).{40,}"),
    ),
)
BASE = 3

SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.machine = Machine.of([r.tree for r in rules])
        self.back = [Backward(r.tree) for r in rules]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(end, bit mask of rules) of every match, in one pass over the bytes."""
        rows, size, events = self.machine.rows, self.machine.size, self.machine.events
        state, found = 0, []
        for i, byte in enumerate(data):
            state = rows[state][byte]
            if state >= size:
                state, ended = events[state - size]
                found.append((i, ended))
        if left := self.machine.open[state]:
            found.append((len(data), left))
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes, in order, of the matches that pass their rule's check."""
        last, out = [0] * len(self.rules), []
        for end, mask in self.ends(data):
            for k, rule in enumerate(self.rules):
                if mask >> k & 1:
                    start = self.back[k].start(data, end, last[k])
                    last[k] = end
                    if rule.check.fullmatch(data, start, end):
                        out.append((start, k, end))
        return sorted(out)


@cache
def scanner() -> Scanner:
    return Scanner()


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or data.isascii():
        return spans
    at, points, seen = {}, 0, 0
    for place in sorted({x for s, _, e in spans for x in (s, e)}):
        points += len(data[seen:place].decode("utf-8", "replace"))
        at[place], seen = points, place
    return [(at[s], k, at[e]) for s, k, e in spans]


def _scan(found: Scanner, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data in batch.column(1).cast(pa.binary()).to_pylist():
            spans = in_code_points(data, found.spans(data)) if data else []
            named = [f"{found.rules[k].kind}:{s}:{e}" for s, k, e in spans]
            base = ",".join(n for n, (_, k, _) in zip(named, spans, strict=True) if k < BASE)
            counts = [sum(k == i for _, k, _ in spans) for i in range(BASE)]
            rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(named)))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            [batch.schema.names[0], "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, digest of their spans, and all spans (code points)."""
    narrow = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(scanner())  # its size depends on the rules alone
    return narrow.mapInArrow(lambda batches: _scan(shared.value, batches), f"{id_col} {dict(docs.dtypes)[id_col]}, {SCHEMA}")
