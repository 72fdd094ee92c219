"""Merkle manifest of a dataset: ranks by a radix trie, and hash trees reduced by the digits of the ranks.

A row's place in its group is found without a sort of the group. Its key is a string of hex digits that sorts as the row does;
histograms of the keys' next ``DIGITS`` digits, one level after another and only below prefixes that hold more than ``BUCKET`` rows,
count what lies before each prefix, and rows of one prefix are ranked among themselves. The rank's digits in base ``FANOUT`` are the
path of the row in its group's tree, so a node is keyed by the rank without its last digits. A task reduces the nodes that share
all but their last ``LEVELS`` digits; its result is one node of the next round, until a group has one. The way back hands each
block the siblings of the node it became. All groups, and the groups' own tree above them, go through the same rounds.

Defined cases: ids sort as signed numbers, null ones first, equal ones by their leaf; equal rows are counted, not compared, and get
places of their own; null and empty texts differ in the leaf; texts of any length are hashed whole in the JVM; a null id is
never tampered with; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable, Iterator
from itertools import batched, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import bounded, persisted

FANOUT = 2
LEVELS = 12
DIGITS = 3
BUCKET = 10_000
TAMPERED = 7
OUT = "doc_id {}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def h(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def field(value: Column) -> Column:
    """The value's bytes behind their number; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct rows (group, doc_id, key, leaf, tampered: null if as it was) and their number ``n``."""
    doc_id = F.col(id_col)
    hashed = lambda n_chars: F.sha2(F.concat(*map(field, (doc_id, F.col("source"), F.col("lang"), n_chars, F.col(text_col)))), 256)
    marked = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    lang = F.col("lang").cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), lang), F.lit("-")).alias("group"),  # sorts as the language, null first
        doc_id.alias("doc_id"),
        hashed(F.col("n_chars")).alias("leaf"),
        F.when(marked & F.col("n_chars").isNotNull(), hashed(F.col("n_chars") + 1)).alias("tampered"),
    )
    # the sign bit turned, so that negative ids come first; nulls before all
    number = F.lpad(F.lower(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63))))), 16, "0")
    key = F.concat(F.coalesce(number, F.lit("-" * 16)), "leaf")
    return rows.groupBy("group", "doc_id", "leaf", "tampered").agg(F.count("*").alias("n")).withColumn("key", key)


def ranked(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``rows`` (group, key, n, ...; a written table) with ``rank``: how many come before in the group, in order of key."""
    ends = rows.agg(F.min("key").alias("least"), F.max("key").alias("most"), F.max(F.length("key")).alias("size")).first()
    least, most = ends["least"] or "", ends["most"] or ""
    depth = len(os.path.commonprefix([least, most]))
    rows = rows.withColumn("base", F.lit(0).cast("long")).withColumn("prefix", F.substring("key", 1, depth))
    done = None
    while True:
        depth += DIGITS
        longer = rows.withColumn("next", F.substring("key", 1, depth))
        held = longer.groupBy("group", "prefix", "next").agg(F.sum("n").alias("held"), F.count("*").alias("rows"))
        digits = persisted(held.withColumn("before", _before("held", "next")).drop("prefix", "held"), "digits")
        open_ = (F.col("rows") > bucket) & F.lit(depth < (ends["size"] or 0))
        more = not digits.filter(open_).isEmpty()
        placed = longer.join(bounded(digits, 500_000), ["group", "next"]).withColumn("base", F.col("base") + F.col("before"))
        placed = placed.withColumn("prefix", F.col("next")).withColumn("open", open_).drop("next", "before", "rows")
        placed = persisted(placed, "placed") if more else placed
        closed = placed.filter(~F.col("open")).withColumn("rank", F.col("base") + _before("n", "key")).drop("base", "prefix", "open")
        done = closed if done is None else done.unionByName(closed)
        if not more:
            return done
        rows = placed.filter("open").drop("open")


def _before(what: str, order: str) -> Column:
    """Sum over the rows of the same group and prefix that come before."""
    window = Window.partitionBy("group", "prefix").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(what).over(window), F.lit(0))


class Block:
    """Nodes of a tree that share all but their last digits, in order, reduced by ``levels`` levels."""

    def __init__(self, hashes: list[str], levels: int, fanout: int = FANOUT) -> None:
        self.levels, self.fanout = [hashes], fanout
        for _ in range(levels):
            last = self.levels[-1]
            self.levels.append([h("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])

    def siblings(self, place: int) -> Iterator[tuple[str, str]]:
        """Siblings before and after the node's ancestors, level by level."""
        for level in self.levels[:-1]:
            first = place // self.fanout * self.fanout
            yield "".join(level[first:place]), "".join(level[place + 1 : first + self.fanout])
            place //= self.fanout


def folded(leaf: str, path: Iterable[tuple[str, str]]) -> str:
    for before, after in path:
        leaf = h(before + leaf + after)
    return leaf


def height(n: int, fanout: int = FANOUT) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def steps(n: int, round_: int, levels: int) -> int:
    """How many levels that round reduces in a group of n leaves."""
    return max(0, min(levels, height(n) - round_ * levels))


def blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """By longest common prefix: the rank without its last ``levels`` digits."""
    return nodes.withColumn("block", F.expr(f"rank div {FANOUT**levels}"))


def tree(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """``nodes`` (group, size: leaves of the group, rank, hash; a written table) and the rounds above; in the last each group has one node."""
    rounds = [nodes]
    most = nodes.agg(F.max("size")).first()[0] or 0
    for round_ in range(max(1, -(-height(most) // levels))):
        low = blocks(rounds[-1].select("group", "size", "rank", "hash"), levels)
        up = low.groupBy("group", "block").applyInArrow(_up(round_, levels), "group string, size long, rank long, hash string")
        rounds.append(persisted(up, "nodes"))
    return rounds


def _block(rows: pa.Table, round_: int, levels: int) -> Block:
    return Block(rows.column("hash").to_pylist(), steps(rows.column("size")[0].as_py(), round_, levels))


def _up(round_: int, levels: int) -> Callable[[pa.Table], pa.Table]:
    def reduce(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        group, size, at = (rows.column(c)[0].as_py() for c in ("group", "size", "block"))
        return pa.table({"group": [group], "size": [size], "rank": [at], "hash": _block(rows, round_, levels).levels[-1]})

    return reduce


def _down(round_: int, levels: int, last: Callable[[pa.Table, Block, dict], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def hand(rows: pa.Table, top: pa.Table) -> pa.Table:
        rows, own = rows.sort_by("rank"), top.to_pylist()[0]
        block = _block(rows, round_, levels)
        if not round_:
            return last(rows, block, own)
        at = own.pop("block")
        ranks = range(at * FANOUT**levels, at * FANOUT**levels + len(rows))
        held = [own | {"path": [*chain(*block.siblings(k)), *own["path"]], "rank": r} for k, r in enumerate(ranks)]
        return pa.Table.from_pylist(held)

    return hand


def proofs(rounds: list[DataFrame], above: DataFrame, last: Callable[[pa.Table, Block, dict], pa.Table], out: str, levels: int = LEVELS) -> DataFrame:
    """Back down from ``above`` (group, path: siblings before and after, in turn, on the group's way to the root, ...) to the leaves.

    ``last`` makes the result of a block of leaves from its rows in order of rank, the block, and the row above it.
    """
    above = above.withColumn("rank", F.lit(0).cast("long"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in above.schema.fields)
    for round_ in range(len(rounds) - 2, -1, -1):
        low = blocks(rounds[round_], levels).groupBy("group", "block")
        high = above.withColumnRenamed("rank", "block").groupBy("group", "block")
        above = low.cogroup(high).applyInArrow(_down(round_, levels, last), kinds if round_ else out)
        above = persisted(above, "paths") if round_ else above
    return above


def manifest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = persisted(leaves(docs, id_col, text_col), "leaves")
    sizes = persisted(rows.groupBy("group").agg(F.sum("n").alias("size")), "sizes")
    sized = ranked(rows, bucket).join(bounded(sizes, 500_000), "group")
    places = F.explode(F.sequence("rank", F.col("rank") + F.col("n") - 1)).alias("rank")
    nodes = persisted(sized.select("group", "size", places, F.col("leaf").alias("hash"), "doc_id", "tampered"), "leaf-nodes")
    rounds = tree(nodes, levels)
    tops = rounds[-1].select(F.lit("").alias("group"), F.lower(F.hex("group")).alias("key"), F.lit(1).cast("long").alias("n"), F.col("group").alias("name"), "hash")
    tops = ranked(persisted(tops, "tops"), bucket).withColumn("size", F.lit(sizes.count()).cast("long"))
    upper = tree(persisted(tops.select("group", "size", "rank", "hash", "name"), "top-nodes"), levels)
    found = upper[-1].first()
    if found is None:
        return spark.createDataFrame([], OUT.format(kind))
    root = found["hash"]

    def subroots(rows: pa.Table, block: Block, own: dict) -> pa.Table:
        paths = [[*chain(*block.siblings(k)), *own["path"]] for k in range(len(rows))]
        return pa.table({"group": rows.column("name"), "path": pa.array(paths, pa.list_(pa.string())), "subroot": rows.column("hash")})

    def verdicts(rows: pa.Table, block: Block, own: dict) -> pa.Table:
        rest = list(batched(own["path"], 2))
        proof, again = [], []
        for k, (leaf, other) in enumerate(zip(rows.column("hash").to_pylist(), rows.column("tampered").to_pylist(), strict=True)):
            path = [*block.siblings(k), *rest]
            proof.append(h("".join(chain(*path))))
            again.append(folded(other or leaf, path))
        same = lambda x: pa.array([x] * len(rows), pa.string())
        columns = [rows.column("doc_id"), rows.column("hash"), same(own["subroot"]), same(root), proof, again, [a == root for a in again]]
        return pa.table(dict(zip(("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"), columns, strict=True)))

    start = spark.createDataFrame([("", [])], "group string, path array<string>")
    paths = persisted(proofs(upper, start, subroots, "group string, path array<string>, subroot string", levels), "lang-paths")
    return proofs(rounds, paths, verdicts, OUT.format(kind), levels)
