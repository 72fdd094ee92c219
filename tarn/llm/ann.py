"""Approximate nearest neighbours by inner product, on robust-pruned directed graphs.

Equal vectors become one node with their smallest ids (as many as a result can hold), so a very common vector is one
node. Spark deals the nodes into shards of about ``SHARD`` by a hash of the vector. Each shard's graph is built in batches of
points near each other: greedy searches through what is there propose neighbours, and pruning keeps those that no kept one
is nearer to by the factor ``ALPHA``, which leaves diverse edges. Inner product becomes distance by one more coordinate that
gives all vectors the same norm. The graphs are a table and so are the queries: each block of queries meets each shard in a
task, a beam search runs there, and the best of all shards are ranked by the exact inner product of the original vectors in
double precision. On 51,282 vectors without clusters (the larger check table) a search sees under 10 % of its shard's nodes.

Defined cases: vectors that are null, zero, hold null or non-finite components or have not the most frequent length take no
part; ties go to the smaller vec_id; with fewer than k others a query gets all; an empty table gives no rows; a vec_id
that repeats is found once for each distinct vector of it and never by itself; extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import persisted

K = 20
SHARD = 100_000
DEGREE, SLACK = 24, 48
BUILD_BEAM, BEAM = 32, 160
MATES = 12
EXPAND = 2
ALPHA = 1.2
QUERY_BLOCK = 100_000
#: Queries that take a step at a time; points that walk together while the graph is built, and how many nodes each opens.
STEP = 256
GROUP, GROUP_EXPAND = 128, 2
RANDOM_FIRST = 2000


def lifted(vectors: np.ndarray) -> np.ndarray:
    """With one more coordinate, so that all norms are equal and nearness is order of inner product."""
    square = (vectors.astype(np.float64) ** 2).sum(axis=1)
    return np.column_stack([vectors, np.sqrt(np.maximum(square.max() - square, 0))]).astype(np.float32)


def beam_search(
    points: np.ndarray, norm: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """Nodes and squared distances (without the query's own norm) of each query's beam, nearest first, -1: none; nodes seen in all.

    Each query walks its own way; all take a step together. The last row of ``edges`` stands for no node.
    """
    n, rows = len(points), np.arange(len(queries))
    seen = np.zeros((len(queries), n + 1), bool)
    seen[:, [entry, n]] = True
    ids = np.full((len(queries), beam), n, np.int32)
    far = np.full((len(queries), beam), np.inf, np.float32)
    done = np.ones((len(queries), beam), bool)
    ids[:, 0], far[:, 0], done[:, 0] = entry, norm[entry] - 2 * queries @ points[entry], False
    out_ids, out_far, total = ids.copy(), far.copy(), len(queries)
    while len(rows):
        first = np.argsort(done, axis=1, kind="stable")[:, :EXPAND]  # the beam is in order of distance
        at = np.where(np.take_along_axis(done, first, axis=1), n, np.take_along_axis(ids, first, axis=1))
        np.put_along_axis(done, first, True, axis=1)
        near = edges[at].reshape(len(rows), -1)
        near = np.where(near < 0, n, near)
        if EXPAND > 1:
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        fresh = ~seen[rows[:, None], near]
        q, c = np.nonzero(fresh)
        new = near[q, c]
        seen[rows[q], new] = True
        total += len(new)
        distance = np.full(near.shape, np.inf, np.float32)
        distance[q, c] = norm[new] - 2 * np.einsum("kd,kd->k", points[new], queries[rows[q]])
        far = np.concatenate([far, distance], axis=1)
        ids = np.concatenate([ids, np.where(fresh, near, n)], axis=1)
        done = np.concatenate([done, ~fresh], axis=1)
        keep = np.argsort(far, axis=1, kind="stable")[:, :beam]
        far, ids, done = (np.take_along_axis(x, keep, axis=1) for x in (far, ids, done))
        live = ~done.all(axis=1)
        if not live.all():
            ended = rows[~live]
            out_ids[ended], out_far[ended] = ids[~live], far[~live]
            rows, far, ids, done = rows[live], far[live], ids[live], done[live]
    return np.where(out_ids == n, -1, out_ids), out_far, total


def groups(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of the points in groups of at most ``size`` that lie near each other: by the nearest of some of them."""
    n = len(points)
    if n <= size:
        return [np.arange(n)]
    pivots = points[np.random.Generator(np.random.PCG64(9)).permutation(n)[: max(2, n // size)]]
    norm = (pivots**2).sum(axis=1)
    cell = np.concatenate([(norm - 2 * points[i : i + (1 << 12)] @ pivots.T).argmin(axis=1) for i in range(0, n, 1 << 12)])
    order = np.argsort(cell, kind="stable")
    return [order[i : i + size] for i in range(0, n, size)]


def group_search(
    points: np.ndarray, norm: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int
) -> tuple[np.ndarray, int]:
    """Nodes of the beam of each query, -1: none; nodes seen. For queries near each other.

    They walk together: a node that one of them comes to is held against all, as one product of matrices.
    """
    seen, done = np.zeros(len(points), bool), np.zeros(len(points) + 1, bool)
    done[-1] = True
    ids = np.full((len(queries), beam), -1, np.int32)
    far = np.full((len(queries), beam), np.inf, np.float32)
    new, total = np.array([entry], np.int32), 0
    while len(new):
        seen[new] = True
        total += len(new)
        distance = norm[new] - 2 * queries @ points[new].T
        near = (distance < far[:, -1:]).any(axis=0)
        new, distance = new[near], distance[:, near]
        far = np.concatenate([far, distance], axis=1)
        ids = np.concatenate([ids, np.broadcast_to(new, distance.shape)], axis=1)
        if far.shape[1] > beam:
            keep = np.argpartition(far, beam - 1, axis=1)[:, :beam]
            far, ids = np.take_along_axis(far, keep, axis=1), np.take_along_axis(ids, keep, axis=1)
        order = np.argsort(far, axis=1)
        far, ids = np.take_along_axis(far, order, axis=1), np.take_along_axis(ids, order, axis=1)
        new = new[:0]
        while not len(new):
            open_ = ~done[ids]
            pick = np.unique(ids[open_ & (open_.cumsum(axis=1) <= GROUP_EXPAND)])
            if not len(pick):
                break
            done[pick] = True
            new = np.unique(edges[pick])
            new = new[new >= 0]
            new = new[~seen[new]]
    return ids, total


def robust_prune(points: np.ndarray, own: np.ndarray, proposed: np.ndarray, degree: int) -> np.ndarray:
    """At most ``degree`` neighbours of each node ``own`` out of those proposed (-1: none)."""
    p = points[own]
    c = points[np.maximum(proposed, 0)]
    to_own = ((c - p[:, None]) ** 2).sum(axis=2)
    alive = (proposed >= 0) & (proposed != own[:, None])
    norm = (c**2).sum(axis=2)
    between = norm[:, :, None] + norm[:, None, :] - 2 * c @ c.transpose(0, 2, 1)
    rows, out = np.arange(len(own)), np.full((len(own), degree), -1, np.int64)
    for k in range(degree):
        distance = np.where(alive, to_own, np.inf)
        best = distance.argmin(axis=1)
        found = np.isfinite(distance[rows, best])
        if not found.any():
            break
        out[found, k] = proposed[rows, best][found]
        alive &= ~(ALPHA**2 * between[rows, best] <= to_own) & found[:, None]
        alive[rows, best] = False
        alive &= proposed != np.where(found, proposed[rows, best], -2)[:, None]
    return out


def build(points: np.ndarray) -> tuple[np.ndarray, int]:
    """Edges (node x SLACK, -1: none) and the entry node."""
    n = len(points)
    norm = (points**2).sum(axis=1)
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((n, SLACK), -1, np.int32)
    order = np.random.Generator(np.random.PCG64(9)).permutation(n)
    order = order[order != entry]
    # a random part first, in growing batches, so that edges lead everywhere; then what lies together in one batch
    batches, begin = [], 0
    while begin < min(len(order), RANDOM_FIRST):
        batches.append(order[begin : begin + min(begin + 1, GROUP)])
        begin += len(batches[-1])
    if begin < len(order):
        rest = order[begin:]
        near = groups(points[rest], GROUP)
        batches += [rest[near[k]] for k in np.random.Generator(np.random.PCG64(8)).permutation(len(near))]
    for batch in batches:
        found, _ = group_search(points, norm, edges, entry, points[batch], BUILD_BEAM)
        mates = min(len(batch), MATES)
        own = norm[batch] - 2 * points[batch] @ points[batch].T
        found = np.concatenate([found, batch[np.argpartition(own, mates - 1, axis=1)[:, :mates]]], axis=1)
        chosen = robust_prune(points, batch, found, DEGREE)
        edges[batch, :DEGREE] = chosen
        source, target = np.repeat(batch, DEGREE), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by_target = np.argsort(target, kind="stable")
        source, target = source[by_target], target[by_target]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        held = (edges[nodes] >= 0).sum(axis=1)
        wide = np.full((len(nodes), SLACK + int(count.max(initial=0))), -1, np.int64)
        wide[:, :SLACK] = np.sort(edges[nodes], axis=1)[:, ::-1]
        place = np.arange(len(source)) - np.repeat(first, count) + np.repeat(held, count)
        wide[np.repeat(np.arange(len(nodes)), count), place] = source
        full = held + count > SLACK
        edges[nodes[~full]] = wide[~full, :SLACK]
        for i in range(0, int(full.sum()), STEP):
            at = np.flatnonzero(full)[i : i + STEP]
            width = int((held[at] + count[at]).max())
            edges[nodes[at]] = -1
            edges[nodes[at], :DEGREE] = robust_prune(points, nodes[at], wide[at, :width], DEGREE)
    return edges, entry


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _index(rows: pa.Table) -> pa.Table:
    """(shard, vector, members) -> the same with place in the shard, neighbours and whether it is the entry."""
    edges, entry = build(lifted(_matrix(rows.column("vector"))))
    place = np.arange(len(rows))
    size = (edges >= 0).sum(axis=1)
    neighbours = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), edges[edges >= 0])
    for name, values in (("place", pa.array(place, pa.int32())), ("neighbours", neighbours), ("entry", pa.array(place == entry))):
        rows = rows.append_column(name, values)
    return rows


def _search(k: int, beam: int, key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
    """Best k ids of one shard for each query of a block: (query_id, vec_id, score)."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(queries) and len(rows):
        rows = rows.sort_by("place")
        own = _matrix(rows.column("vector"))
        points = lifted(own)
        norm = (points**2).sum(axis=1)
        lists = rows.column("neighbours").combine_chunks()
        edges = np.full((len(rows) + 1, SLACK), -1, np.int32)
        edges[:-1][np.arange(SLACK) < np.diff(lists.offsets.to_numpy())[:, None]] = lists.flatten().to_numpy()
        entry = int(np.flatnonzero(rows.column("entry").to_numpy())[0])
        members = rows.column("members").combine_chunks()
        first, member = members.offsets.to_numpy() - members.offsets[0].as_py(), members.flatten().to_numpy()
        ids, vectors = queries.column("query_id").to_numpy(), _matrix(queries.column("vector"))
        raised = np.column_stack([vectors, np.zeros(len(vectors))]).astype(np.float32)
        for start in range(0, len(raised), STEP):
            found, _, _ = beam_search(points, norm, edges, entry, raised[start : start + STEP], beam)
            for i, nodes in enumerate(found, start):
                nodes = nodes[nodes >= 0]
                scores = own[nodes].astype(np.float64) @ vectors[i].astype(np.float64)
                if len(nodes) > k + 1:  # a node is at most one query itself
                    near = scores >= np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    nodes, scores = nodes[near], scores[near]
                size = first[nodes + 1] - first[nodes]
                at = np.arange(size.sum()) + np.repeat(first[nodes] - np.cumsum(size) + size, size)
                hits, scores = member[at], np.repeat(scores, size)
                other = hits != ids[i]
                hits, scores = hits[other], scores[other]
                best = np.lexsort((hits, -scores))[:k]
                out.append((np.full(len(best), ids[i]), hits[best], scores[best]))
    kinds = (np.int64, np.int64, np.float64)
    columns = [np.concatenate([o[c] for o in out] or [np.zeros(0)]).astype(t) for c, t in enumerate(kinds)]
    return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, vector) that take part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = vectors.filter(F.col("vector").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    kept = kept.filter("vec_id is not null")
    size = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return kept.filter(F.size("vector") == (size["n"] if size else 0))


def index(vectors: DataFrame, k: int = K, shard: int = SHARD) -> DataFrame:
    """Rows (vec_id, vector) -> the graphs of all shards, one row per distinct vector."""
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = vectors.select("vec_id", "vector").withColumn("rank", first).filter(F.col("rank") <= k + 1)
    nodes = few.groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("members"))
    nodes = persisted(nodes, "nodes")
    shards = -(-nodes.count() // shard) or 1
    dealt = nodes.select(F.pmod(F.xxhash64("vector"), F.lit(shards)).alias("shard"), "vector", "members")
    kinds = f"shard long, vector {nodes.schema['vector'].dataType.simpleString()}, members array<long>"
    graph = dealt.groupBy("shard").applyInArrow(_index, f"{kinds}, place int, neighbours array<int>, entry boolean")
    return persisted(graph, "graph")


def nearest(
    vectors: DataFrame, is_query: Column, k: int = K, beam: int = BEAM, shard: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for each row where ``is_query`` holds."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), is_query.alias("query"))
    rows = persisted(usable(rows), "usable")
    graph = index(rows, k, shard)
    queries = persisted(rows.filter("query").select(F.col("vec_id").alias("query_id"), "vector").dropDuplicates(["query_id"]), "queries")
    shards = graph.agg(F.max("shard")).first()[0]
    if shards is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = -(-queries.count() // QUERY_BLOCK) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("shard", every(shards))
    held = graph.withColumn("block", every(blocks - 1))
    key = ["shard", "block"]
    found = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(
        lambda g, q, r: _search(k, beam, g, q, r), "query_id long, vec_id long, score double"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
