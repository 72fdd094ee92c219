"""Vectors: cosine similarity, and the offline embedding by token hashes."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from tarn.checkpoints import persisted

TOKEN = "[a-z0-9]+"
#: Rows and queries in a block, where queries are dealt as a table; scores that a task holds at a time.
BLOCK, SCORES = 20_000, 4 << 20
#: Of parts of cells: the most rows, the most numbers in their vectors; queries and rows whose scores a task holds at a time.
PART, POINTS, TILE = 1 << 16, 1 << 23, (256, 4096)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Similarity; null for zero vectors."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


@lru_cache(1 << 18)
def fnv1a(token: str) -> int:
    h = 2166136261
    for c in token:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


def hash_embed(text: str, dims: int) -> np.ndarray:
    """Signed counts of token hashes, of norm 1 (all zero without tokens)."""
    out = np.zeros(dims)
    for token, n in Counter(re.findall(TOKEN, text.lower())).items():
        h = fnv1a(token)
        out[h % dims] += n if h & 1 == 0 else -n
    norm = np.sqrt((out**2).sum())
    return out / norm if norm else out


def with_embeddings(rows: DataFrame, text: str, dims: int = 1024, name: str = "embedding") -> DataFrame:
    """``rows`` (any columns) with the offline embedding of their text."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [hash_embed(t or "", dims) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(made, pa.list_(pa.float64()))], [*batch.schema.names, name]
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(embed, f"{kinds}, `{name}` array<double>")


def nearest(
    rows: DataFrame,
    queries: DataFrame | pa.Table,
    k: int,
    least: float | None = None,
    block: int = 4096,
    unlike: str | tuple[str, ...] = (),
    once: bool = False,
    others: bool = False,
) -> DataFrame:
    """(qid, src, id, similarity) of the k most similar rows (src, id, vec) of each query (qid, vec); few queries may come as an Arrow table.

    Up to ``block`` queries are broadcast to where the rows are. More are dealt as a table: blocks of queries meet blocks of
    rows in tasks, so that no vector goes through the driver; with ``least``, only blocks whose cells are near enough meet. There,
    vectors that repeat are compared once (see _by_classes()). Either way a task keeps only its own k best of a query,
    whatever the number of its rows. ``least`` keeps those of at least that similarity, before the limit; ``unlike`` those
    with another value than the query's in each of those columns of both (null is neither); ``once`` takes the best row of
    each (src, id) only; ``others`` leaves out the row whose id is the query's.
    """
    unlike = (unlike,) if isinstance(unlike, str) else unlike
    here = isinstance(queries, pa.Table)
    for c in unlike:
        rows, queries = rows.filter(F.col(c).isNotNull()), queries.filter(pc.is_valid(queries.column(c)) if here else F.col(c).isNotNull())
    rows = rows.select("src", "id", "vec", *(F.col(c).cast("string") for c in unlike)).filter("vec is not null")
    if here:
        queries = queries.filter(pc.is_valid(queries.column("vec")))
        held = pa.table([queries.column("qid"), queries.column("vec"), *(queries.column(c).cast(pa.string()) for c in unlike)], ["qid", "vec", *unlike])
        kind, block = from_arrow_type(held.schema.field("qid").type), len(held)
    else:
        queries = queries.select("qid", "vec", *(F.col(c).cast("string") for c in unlike)).filter("vec is not null")
        held, kind = queries.limit(block + 1).toArrow(), queries.schema["qid"].dataType
    schema = f"qid {kind.simpleString()}, src string, id {rows.schema['id'].dataType.simpleString()}, similarity double"
    search = Search(k, least, once, others)
    if not len(held):
        return rows.sparkSession.createDataFrame([], schema)
    if len(held) <= block:
        shared = rows.sparkSession.sparkContext.broadcast(held)
        found = rows.mapInArrow(lambda batches: search.over(shared.value, batches), schema)
    elif once:
        found = _met(rows, queries, search)
    else:
        return _by_classes(rows, queries, k, least, unlike, others).select("qid", "src", "id", "similarity")
    return _best(found, k, least, once)


def _best(found: DataFrame, k: int, least: float | None, once: bool = False) -> DataFrame:
    if once:
        found = found.groupBy("qid", "src", "id").agg(F.max("similarity").alias("similarity"))
    if least is not None:
        found = found.filter(F.round("similarity", 9) >= least)
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("similarity", 9)), "src", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


def _met(rows: DataFrame, queries: DataFrame, search: Search) -> DataFrame:
    """What the tasks keep where blocks of queries (qid, vec, values…) meet blocks of rows (src, id, vec, values…)."""
    names, parts = queries.columns, ["q_part", "r_part"]
    asked, given, near = _dealt(rows, queries, search.least)
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, src string, id {rows.schema['id'].dataType.simpleString()}, similarity double"

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        cells = None if near is None else (near, q.column("cell").to_numpy(), r.column("cell").to_numpy())
        drop = parts if near is None else [*parts, "cell"]
        return search.block(q.drop_columns(drop).rename_columns(names), r.drop_columns(drop), cells)

    return asked.groupBy(*parts).cogroup(given.groupBy(*parts)).applyInArrow(meet, schema)


#: Rows looked at beyond the k asked for, as ``unlike`` leaves some out; rounds of four times as many each before single rows are compared.
SPARE, ROUNDS = 16, 3


def _by_classes(rows: DataFrame, queries: DataFrame, k: int, least: float | None, unlike: tuple[str, ...], others: bool) -> DataFrame:
    """The k best (qid, src, id, similarity) of each query, where rows and queries of equal vectors are classes and only classes are compared.

    Of each class of queries the nearest classes of rows are taken until they hold ``need`` rows, those of equal similarity together.
    Queries that find k among these rows, or had all classes, are done: no row left out could come before. The rest takes more classes
    and at last is compared row by row. Of a class only its first rows in order count: ``need`` of each value of ``unlike[0]``, as
    those after them come behind k others for any query that wants the value, and 2 * ``need`` in all.
    """
    first, rest = [f"u{n}" for n in range(len(unlike))][:1], [f"u{n}" for n in range(len(unlike))][1:]
    row_places, row_classes = _classes(rows, "r_class")
    query_places, query_classes = _classes(queries, "q_class")
    for n, c in enumerate(unlike):  # values as numbers; a query's value that no row has is unlike all
        values = persisted(row_places.select(c).distinct().withColumn(f"u{n}", F.monotonically_increasing_id()), "values")
        row_places, query_places = row_places.join(values, c).drop(c), query_places.join(values.withColumnRenamed(f"u{n}", f"q_u{n}"), c, "left").drop(c)
    same = Window.partitionBy("r_class", *first)
    row_places = row_places.withColumn("nth", F.row_number().over(same.orderBy("src", "id"))).withColumn("n_same", F.count("*").over(same))
    row_places, query_places = persisted(row_places, "row-places"), persisted(query_places, "query-places")
    points = row_classes.select(F.lit("").alias("src"), F.col("r_class").alias("id"), "vec")
    done, open_, need = [], query_places, k + SPARE
    for _ in range(ROUNDS):
        asked = query_classes.withColumnRenamed("q_class", "qid").join(open_.select(F.col("q_class").alias("qid")).distinct(), "qid", "left_semi")
        near = _best(_met(points, asked.select("qid", "vec"), Search(need, least, False, False)), need, least)
        near = near.select(F.col("qid").alias("q_class"), F.col("id").alias("r_class"), "similarity", F.round("similarity", 9).alias("level"))
        heads = row_places.filter(F.col("nth") <= need).withColumn("place", F.row_number().over(Window.partitionBy("r_class").orderBy("src", "id")))
        # values after the first may leave out of its ``need`` rows more than can be spared
        lost = F.lit(False)
        for c in rest:
            lost |= (F.col("n_same") > need) & (F.count("*").over(Window.partitionBy("r_class", *first, c)) >= SPARE)
        heads = persisted(heads.withColumn("lost", lost), "heads")
        size = heads.groupBy("r_class").agg(F.count("*").alias("n"), F.max("lost").alias("lost"))
        by, peers = Window.partitionBy("q_class"), Window.partitionBy("q_class", "level")
        near = near.join(size, "r_class").withColumn("cut", F.col("lost") | (F.col("n") > 2 * need))
        before = F.sum("n").over(by.orderBy(F.desc("level"))) - F.sum("n").over(peers)  # the running sum holds all peers
        whole = (F.count("*").over(by) < need) | (F.col("level") > F.min("level").over(by))
        certain = ~F.max("cut").over(peers) | ((F.count("*").over(peers) == 1) & ~F.col("lost"))
        near = persisted(near.withColumn("kept", whole & certain & (before < need)), "near-classes")
        more = near.groupBy("q_class").agg(F.max(~F.col("kept") | F.col("cut")).alias("more"))
        hits = near.filter("kept").select("q_class", "r_class", "similarity").join(heads.filter(F.col("place") <= 2 * need).drop("nth", "n_same", "place", "lost"), "r_class")
        hits = hits.drop("r_class").join(open_, "q_class")
        for n in range(len(unlike)):
            hits = hits.filter(F.col(f"q_u{n}").isNull() | (F.col(f"q_u{n}") != F.col(f"u{n}")))
        if others:
            hits = hits.filter(F.col("qid") != F.col("id"))
        # a query has one class, so that its rows lie together already
        order = Window.partitionBy("q_class", "qid").orderBy(F.desc(F.round("similarity", 9)), "src", "id")
        hits = hits.select("q_class", "qid", "src", "id", "similarity").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        hits = persisted(hits, "hits")
        full = hits.filter(F.col("rank") == k).select("q_class", "qid")
        left = persisted(open_.join(more.filter("more"), "q_class", "left_semi").join(full, ["q_class", "qid"], "left_anti"), "open")
        if left.isEmpty():
            done.append(hits)
            break
        done.append(hits.join(left, ["q_class", "qid"], "left_anti"))
        open_, need = left, 4 * need
    else:
        asked = queries.join(open_.select("qid").distinct(), "qid", "left_semi").select(queries.columns)
        done.append(_best(_met(rows, asked, Search(k, least, False, others)), k, least))
    return reduce(DataFrame.unionByName, [d.select("qid", "src", "id", "similarity") for d in done])


def _classes(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` without vec, with the number of its vector's class; (number, vec) of the classes."""
    held = persisted(df.withColumn("point", F.sha2(F.to_json(F.struct("vec")), 256)), "points")
    made = persisted(held.groupBy("point").agg(F.first("vec").alias("vec")).withColumn(name, F.monotonically_increasing_id()), "classes")
    return held.drop("vec").join(made.select("point", name), "point").drop("point"), made.select(name, "vec")


#: Rows that pivots are chosen from, and the most pivots; a cell holds about a quarter of a block.
SAMPLE, PIVOTS = 4096, 1024


def pivots(points: np.ndarray, most: int) -> np.ndarray:
    """Unit vectors out of ``points``, each the farthest from those before it."""
    chosen, near = [0], points @ points[0]
    while len(chosen) < min(most, len(points)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, points @ points[chosen[-1]])
        if near.min() > 1 - 1e-12:
            break
    return points[chosen]


def near_cells(centres: np.ndarray, of: dict[int, float], against: dict[int, float], least: float) -> list[tuple[int, int]]:
    """Pairs of cells that can hold vectors of at least that cosine: by the triangle inequality on angles, with each cell's radius."""
    between = np.arccos(np.clip(centres @ centres.T, -1, 1))
    most = np.arccos(np.clip(least, -1, 1)) + 1e-6
    return [(a, b) for a, ra in of.items() for b, rb in against.items() if between[a, b] - ra - rb <= most]


def chain(centres: np.ndarray) -> list[int]:
    """The centres in an order in which near ones follow each other."""
    left, order = np.ones(len(centres), bool), [0]
    for _ in range(len(centres) - 1):
        left[order[-1]] = False
        order.append(int(np.where(left, centres @ centres[order[-1]], -np.inf).argmax()))
    return order


def filled(order: list[int], sizes: dict[int, int], most: int) -> dict[int, list[int]]:
    """The parts of about ``most`` rows that each cell goes to, filled in that order; large cells go to several."""
    out, at = {}, 0
    for cell in order:
        if n := sizes.get(cell, 0):
            out[cell] = list(range(at // most, (at + n - 1) // most + 1)) if n > most else [at // most]
            at += n
    return out


def _dealt(rows: DataFrame, queries: DataFrame, least: float | None) -> tuple[DataFrame, DataFrame, np.ndarray | None]:
    """Both sides with ``q_part`` and ``r_part``: a query's row and a row share a pair of them exactly once, if they can be near enough.

    Vectors lie in cells, those of the nearest pivot. Parts hold as many cells as a task can take, so that a vector is sent once for
    all cells of a part; which of them can hold near ones (by query's and row's ``cell``) comes third. Zero vectors, which are near nothing, go.
    """
    n = rows.count()
    # names of its own, as the queries may come from the rows
    own = queries.select(F.col("qid").alias("q_id"), *(F.col(c).alias(f"q_{c}") for c in queries.columns[1:])).withColumnRenamed("q_vec", "vec")
    most = min(PIVOTS, 4 * n // BLOCK)
    if least is None or most < 2:  # all blocks meet
        n_rows, n_queries = (max(1, -(-k // BLOCK)) for k in (n, queries.count()))
        every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
        part = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k))
        return own.withColumn("q_part", part("q_id", n_queries)).withColumn("r_part", every(n_rows)), rows.withColumn("r_part", part("id", n_rows)).withColumn("q_part", every(n_queries)), None
    sample = rows.select("vec", F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE).select("vec").toArrow()
    points = _unit(sample.column("vec").combine_chunks())
    points = points[np.isfinite(points).all(axis=1)]
    centres = pivots(points, most) if len(points) else np.zeros((1, 1))

    def cells(df: DataFrame) -> tuple[DataFrame, dict[int, float], dict[int, int]]:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit = _unit(batch.column(batch.schema.get_field_index("vec")))
                live = np.isfinite(unit).all(axis=1)
                cosine_ = unit[live] @ centres.T
                own = batch.filter(pa.array(live)).append_column("cell", pa.array(cosine_.argmax(axis=1).astype(np.int32)))
                yield own.append_column("angle", pa.array(np.arccos(np.clip(cosine_.max(axis=1, initial=-1), -1, 1))))

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        placed = persisted(df.mapInArrow(place, f"{kinds}, cell int, angle double"), "cells")
        found = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()  # at most PIVOTS
        return placed.drop("angle"), {r["cell"]: r["radius"] for r in found}, {r["cell"]: r["n"] for r in found}

    (asked, q_radius, q_size), (given, r_radius, r_size) = cells(own), cells(rows)
    near = np.zeros((len(centres), len(centres)), bool)
    for pair in near_cells(centres, q_radius, r_radius, least):
        near[pair] = True
    # few parts, as a vector is sent once for each part it meets, but enough for all cores
    order, cores = chain(centres), max(1, rows.sparkSession.sparkContext.defaultParallelism)
    largest, fewest = max(1024, min(PART, POINTS // centres.shape[1])), math.ceil(math.sqrt(3 * cores))
    q_parts, r_parts = (filled(order, size, min(largest, max(1, -(-sum(size.values()) // fewest)))) for size in (q_size, r_size))
    met = {(a, b) for q, r in np.argwhere(near).tolist() for a in q_parts.get(q, ()) for b in r_parts.get(r, ())}

    def dealt(df: DataFrame, key: str, its: str, its_parts: dict[int, list[int]], others: str, pairs: set[tuple[int, int]]) -> DataFrame:
        of: dict[int, list[int]] = {}
        for a, b in sorted(pairs):
            of.setdefault(a, []).append(b)
        to = df.sparkSession.createDataFrame(list(its_parts.items()), "cell int, parts array<long>")
        meets = df.sparkSession.createDataFrame(list(of.items()), f"{its} long, others array<long>")
        placed = df.join(F.broadcast(to), "cell").withColumn(its, F.get("parts", F.pmod(F.xxhash64(key), F.size("parts")).cast("int"))).drop("parts")
        return placed.join(F.broadcast(meets), its).withColumn(others, F.explode("others"))

    q_names = ["q_id", "vec", *(c for c in own.columns if c not in ("q_id", "vec"))]
    asked = dealt(asked, "q_id", "q_part", q_parts, "r_part", met).select(*q_names, "cell", "q_part", "r_part")
    given = dealt(given, "id", "r_part", r_parts, "q_part", {(b, a) for a, b in met}).select(*rows.columns, "cell", "r_part", "q_part")
    return asked, given, near


@dataclass
class Search:
    """The k best rows of each query among the rows of one task."""

    k: int
    least: float | None
    once: bool
    others: bool

    def block(self, queries: pa.Table, rows: pa.Table, cells: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> pa.Table:
        """``cells``: which cells of queries and rows can hold near ones, and the queries' and rows' cells."""
        kinds = [queries.schema.field("qid").type, rows.schema.field("src").type, rows.schema.field("id").type, pa.float64()]
        schema = pa.schema(list(zip(("qid", "src", "id", "similarity"), kinds, strict=True)))
        if self.once:
            return pa.Table.from_batches(list(self.over(queries, rows.to_batches(10_000))), schema)
        if not len(queries) or not len(rows):
            return schema.empty_table()
        return pa.Table.from_batches(list(self.close(queries.combine_chunks(), rows.combine_chunks(), cells)), schema)

    def close(self, queries: pa.Table, rows: pa.Table, cells: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        """over() for all rows of a task at once.

        Scores in single precision, some queries and rows at a time, propose pairs; what may reach a query's floor (the least similarity, or
        its k-th best so far) with the most that rounding can take away is kept, and scored in double precision.
        """
        one, other = (_unit(_chunk(t.column("vec"))) for t in (queries, rows))
        fast, points = one.astype(np.float32), other.astype(np.float32)
        slack = np.float32((one.shape[1] + 8) * 2.0**-23)
        values = []
        for mine, its in zip(queries.columns[2:], rows.columns[3:], strict=True):
            known = pc.unique(mine)
            values.append((_codes(mine, known), _codes(its, known)))
        if self.others:
            values.append((np.arange(len(queries)), _codes(rows.column("id"), _chunk(queries.column("qid")))))
        groups = [(np.arange(len(one)), None)]
        if cells is not None:
            near, q_cell, r_cell = cells
            groups = [(np.flatnonzero(q_cell == c), np.flatnonzero(near[c][r_cell])) for c in np.unique(q_cell)]
        for own, theirs in groups:
            whole = theirs is None or len(theirs) == len(other)
            against = points if whole else points[theirs]
            for low in range(0, len(own), TILE[0]):
                q = own[low : low + TILE[0]]
                floor = np.full(len(q), -np.inf if self.least is None else self.least - 1e-9 - slack, np.float32)
                held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
                n_held = 0
                for start in range(0, len(against), TILE[1]):
                    score = fast[q] @ against[start : start + TILE[1]].T
                    at = np.flatnonzero(score >= floor[:, None])
                    if len(at) > score.size // 16 and score.shape[1] > self.k:  # many: their k-th best is a floor
                        number = np.arange(start, start + score.shape[1]) if whole else theirs[start : start + score.shape[1]]
                        for mine, its in values:
                            score[mine[q][:, None] == its[number][None, :]] = -np.inf
                        score = np.nan_to_num(score, copy=False, nan=-np.inf)
                        edge = np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]
                        floor = np.maximum(floor, edge - 2 * slack)
                        at = np.flatnonzero((score >= floor[:, None]) & np.isfinite(score))
                    a, b = np.divmod(at, score.shape[1])
                    found = a, (b + start if whole else theirs[b + start]), score.ravel()[at]
                    for mine, its in values:
                        fit = mine[q[found[0]]] != its[found[1]]
                        found = tuple(x[fit] for x in found)
                    held.append(found)
                    n_held += len(found[0])
                    if n_held > 2 * self.k * len(q) + 10_000:
                        a, b, s = (np.concatenate(x) for x in zip(*held, strict=True))
                        floor = np.maximum(floor, _edges(a, s, self.k, len(q)) - 2 * slack)
                        fit = s >= floor[a]
                        held, n_held = [(a[fit], b[fit], s[fit])], int(fit.sum())
                a, b, s = (np.concatenate(x) for x in zip(*held, strict=True))
                fit = np.isfinite(s) & (s >= np.maximum(floor, _edges(a, s, self.k, len(q)) - 2 * slack)[a])
                a, b = a[fit], b[fit]
                exact = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", one[q[a[i : i + TILE[1]]]], other[b[i : i + TILE[1]]]) for i in range(0, len(a), TILE[1]))])
                fit = exact >= _edges(a, exact, self.k, len(q))[a] - 1e-9
                if self.least is not None:
                    fit &= exact >= self.least - 1e-9
                if fit.any():
                    b = pa.array(b[fit])
                    yield pa.RecordBatch.from_arrays([_chunk(queries.column("qid")).take(pa.array(q[a[fit]])), _chunk(rows.column("src")).take(b), _chunk(rows.column("id")).take(b), pa.array(exact[fit])], ["qid", "src", "id", "similarity"])

    def over(self, queries: pa.Table, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``queries`` (qid, vec, values…), batches (src, id, vec, values…) -> (qid, src, id, similarity)."""
        qids = queries.column("qid").combine_chunks()
        unit = _unit(queries.column("vec").combine_chunks())
        values = [c.combine_chunks() for c in queries.columns[2:]]
        known = [pc.unique(v) for v in values]
        own = [pc.index_in(v, n).to_numpy() for v, n in zip(values, known, strict=True)]
        held, n_held = [], 0
        for whole in batches:
            if not whole.num_rows or not len(unit):
                continue
            points = _unit(whole.column(2)).T
            alike = [pc.index_in(value, names).fill_null(-1).to_numpy(zero_copy_only=False) for value, names in zip(whole.columns[3:], known, strict=True)]
            itself = pc.index_in(qids, whole.column(1)).fill_null(-1).to_numpy(zero_copy_only=False) if self.others else None
            step = max(1, SCORES // whole.num_rows)
            for low in range(0, len(unit), step):
                batch, part = whole, slice(low, low + step)
                score = np.nan_to_num(unit[part] @ points, copy=False, nan=-np.inf)
                for its, mine in zip(alike, own, strict=True):
                    score[mine[part, None] == its[None, :]] = -np.inf
                if self.others:
                    score[itself[part, None] == np.arange(batch.num_rows)] = -np.inf
                if self.once:
                    batch, score = _best_of_each(batch, score)
                n = min(self.k, score.shape[1])
                edge = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n]
                floor = edge - 1e-9 if self.least is None else np.maximum(edge - 1e-9, self.least - 1e-9)
                q, at = np.nonzero((score >= floor[:, None]) & np.isfinite(score))
                held.append((q + low, batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), score[q, at]))
                n_held += len(q)
            if not self.once and n_held > 4 * self.k * len(unit) + 100_000:
                held = [self._trimmed(held)]
                n_held = len(held[0][0])
        if held:
            q, src, ids, score = self._trimmed(held) if not self.once else self._joined(held)
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), src, ids, pa.array(score)], ["qid", "src", "id", "similarity"])

    @staticmethod
    def _joined(held: list[tuple]) -> tuple:
        q, src, ids, score = zip(*held, strict=True)
        return np.concatenate(q), pa.concat_arrays(src), pa.concat_arrays(ids), np.concatenate(score)

    def _trimmed(self, held: list[tuple]) -> tuple:
        """The k best of each query, and what equals the last of them."""
        q, src, ids, score = self._joined(held)
        order = np.lexsort((-score, q))
        first = np.searchsorted(q[order], np.arange(q.max(initial=-1) + 2))
        last = np.minimum(first[:-1] + self.k, first[1:]) - 1
        kept = np.flatnonzero(score >= score[order][last][q] - 1e-9)
        at = pa.array(kept)
        return q[kept], src.take(at), ids.take(at), score[kept]


def _chunk(column: pa.ChunkedArray) -> pa.Array:
    made = column.combine_chunks()
    return pa.concat_arrays(made.chunks) if isinstance(made, pa.ChunkedArray) else made


def _codes(column: pa.ChunkedArray, known: pa.Array) -> np.ndarray:
    return pc.index_in(_chunk(column), known).fill_null(-1).to_numpy(zero_copy_only=False)


def _edges(of: np.ndarray, score: np.ndarray, k: int, n: int) -> np.ndarray:
    """The k-th best score of each of n; -inf where there are fewer."""
    order = np.lexsort((-score, of))
    first = np.searchsorted(of[order], np.arange(n + 1))
    full = first[1:] - first[:-1] >= k
    out = np.full(n, -np.inf, score.dtype)
    out[full] = score[order[first[:-1][full] + k - 1]]
    return out


def _unit(column: pa.Array) -> np.ndarray:
    """Vectors of norm 1; nan for zero vectors."""
    points = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return points / np.sqrt((points**2).sum(axis=1))[:, None]


def _best_of_each(batch: pa.RecordBatch, score: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    """The first row of each (src, id), and the queries' best scores of all its rows."""
    codes = [batch.column(k).dictionary_encode("encode").indices.to_numpy().astype(np.int64) for k in (0, 1)]
    which = codes[0] * (codes[1].max() + 1) + codes[1]
    order = np.argsort(which, kind="stable")
    head = np.flatnonzero(np.diff(which[order], prepend=-1))
    return batch.take(pa.array(order[head])), np.maximum.reduceat(score[:, order], head, axis=1)
