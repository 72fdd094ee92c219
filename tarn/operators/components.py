"""Connected components of a table of links, by repeated contraction.

Each round points every node at the smallest of itself and its neighbours, follows those pointers a few steps and maps
nodes and links by them; links inside one node vanish. Chains shrink by a constant factor a round, stars in one. Groups
are only ever reduced with min(), which Spark pre-aggregates. A join never brings all rows of a hub to one task: a round's
pointers are broadcast while they are few, and beyond that those of hubs are, which are few again (each takes ``HUB`` rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.checkpoints import bounded, persisted

JUMPS = 2
#: Rows of one key from which on they are joined where they are.
HUB = 100_000
FEW = 1_000_000


def looked_up(rows: DataFrame, by: str, pointers: DataFrame, name: str, few: bool, hub: int = HUB) -> DataFrame:
    """``rows`` with ``name``, where column ``by`` points (null: nowhere), by ``pointers`` (a, up), one row per ``a``.

    ``few``: the pointers have been counted, and few enough to broadcast.
    """
    to = pointers.select(F.col("a").alias(by), F.col("up").alias(name))
    if few:
        return rows.join(F.broadcast(to), by, "left")
    hubs = persisted(rows.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") > hub).select(by), "hubs")
    if hubs.isEmpty():
        return rows.join(to, by, "left")
    hubs = bounded(hubs)
    near = bounded(persisted(to.join(hubs, by, "left_semi"), "hub-pointers"))
    rest = rows.join(hubs, by, "left_anti").join(to, by, "left")
    return rest.unionByName(rows.join(hubs, by, "left_semi").join(near, by, "left"))


def components(links: DataFrame, few: int = FEW, hub: int = HUB) -> DataFrame:
    """``links`` (a, b) -> (node, component): the smallest node reachable. Repeated links and links to self are fine."""
    edges = persisted(
        links.select("a", "b").union(links.select("b", "a")).filter("a <> b").dropDuplicates(["a", "b"]), "edges"
    )
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    while not edges.isEmpty():
        parent = persisted(edges.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("up")), "parents")
        small = parent.limit(few + 1).count() <= few
        for _ in range(JUMPS):
            parent = persisted(looked_up(parent, "up", parent, "top", small, hub).select("a", F.col("top").alias("up")), "parents")
        known = looked_up(labels, "component", parent, "up", small, hub)
        labels = persisted(known.select("node", F.coalesce("up", "component").alias("component")), "labels")
        moved = looked_up(looked_up(edges, "a", parent, "u", small, hub), "b", parent, "v", small, hub)
        edges = persisted(moved.select(F.col("u").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct(), "edges")
    return labels
