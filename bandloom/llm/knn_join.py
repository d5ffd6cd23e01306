"""Exact top-k search by inner product: a k-nearest-neighbour join over Voronoi cells.

An inner product becomes a distance by one more coordinate: with M the largest norm of all, a candidate x
stands at (x, sqrt(M^2 - |x|^2)) and a query q at (q, 0), so the squared distance is |q|^2 + M^2 - 2 q.x, and the
nearest candidates are those of the highest scores. Pivots, a bounded sample of the candidates, cut both tables into
cells. From summaries of the cells alone (how far queries lie from their pivot at most, and the k + 1 smallest
distances of candidates) follows, for each cell of queries, a bound on the distance of any query's last neighbour, and
by the triangle inequality the ring around each other pivot that can hold a neighbour. A candidate goes to the groups
of queries whose ring it lies in, and nowhere else; each pair of a group and a block of a cell is solved in one task by
integer scores; the best of all blocks are the answer.

Nothing is approximate: the rings are widened by far more than rounding, and scores are whole numbers, by a product in
doubles where that is exact and by Python's integers otherwise.

Bounds: at most ``PIVOTS`` pivots, so summaries and rings are bounded by their square whatever the tables; a task holds
about ``DATA_BLOCK`` candidates and ``QUERY_BLOCK`` queries, as cells beyond them are cut by hash. Of equal vectors only
the k + 1 smallest ids can be anybody's neighbour, so a hot vector is that many rows, cut down before the shuffle;
equal query vectors are solved once.

Edge cases: vectors that are null or hold nulls or non-finite numbers take no part; a shorter vector is filled up with
zeros, an empty one scores 0; equal scores are ordered by id, null ids last; a null id asks nothing; rows that repeat an
id are rows of their own, of which a query leaves out one, itself; components beyond a long are its ends, and so are
scores; fewer candidates than k are all returned; empty tables give an empty table; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

PIVOTS, QUERY_BLOCK, DATA_BLOCK = 256, 65_536, 65_536
#: Of the largest norm, how much rings are widened: rounding of distances stays below 1e-7 of it.
SLACK = 1e-6
LEAST, MOST = -(2**63) + 1, 2**63 - 1
FOUND = "query_id long, rank int, vec_id long, score long"


def whole(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component as a long; null for vectors that are null or hold nulls or non-finite numbers."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda v: F.floor(v.cast("double") * scale)))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of longs, shorter ones filled up with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values, sizes = np.asarray(lists.flatten(), np.int64), np.asarray(lists.value_lengths(), np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def packed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    n, each = len(rows), rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(each)), pa.py_buffer(np.ascontiguousarray(rows))])


def unpacked(column: pa.ChunkedArray, kind: np.dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


class Space:
    """Pivots and how vectors lie to them. ``top``: the largest squared norm of all."""

    def __init__(self, pivots: np.ndarray, width: int, most: int, top: float):
        self.width, self.most, self.top = width, most, top * (1 + 1e-12)
        self.kind = np.dtype("<i4" if most < 2**31 else "<i8")
        at = pivots.astype(float)
        self.pivots = np.hstack([at, np.sqrt(np.maximum(self.top - np.square(at).sum(axis=1), 0))[:, None]])
        self.slack = SLACK * np.sqrt(self.top) + 1e-300
        #: Whether scores are exact in doubles.
        self.exact = width * most * most < 2**53

    def between(self) -> np.ndarray:
        """Distances of pivots."""
        return np.linalg.norm(self.pivots[:, None] - self.pivots[None], axis=2)

    def nearest(self, rows: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance of each row."""
        at = rows.astype(float)
        norm = np.square(at).sum(axis=1)
        last = np.zeros(len(at)) if query else np.sqrt(np.maximum(self.top - norm, 0))
        at = np.hstack([at, last[:, None]])
        square = np.square(at).sum(axis=1)[:, None] + np.square(self.pivots).sum(axis=1) - 2 * at @ self.pivots.T
        cell = square.argmin(axis=1)
        return cell.astype(np.int32), np.linalg.norm(at - self.pivots[cell], axis=1)


def placed(rows: DataFrame, space: Space, query: bool) -> DataFrame:
    """id, vec (bytes), cell, dist of rows (id, vec array of longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in common.small_batches(batch, max(1, min(4096, (1 << 23) // space.width))):
                x = matrix(b.column(1), space.width)
                cell, dist = space.nearest(x, query)
                yield pa.RecordBatch.from_arrays([b.column(0), packed(x.astype(space.kind)), pa.array(cell), pa.array(dist)], names=["id", "vec", "cell", "dist"])

    return rows.select("id", "vec").mapInArrow(run, "id long, vec binary, cell int, dist double")


class Rings:
    """Which candidates may matter to which groups of queries, from the cells' summaries.

    ``nearest``: by cell, the k + 1 smallest distances of its candidates; ``sizes``, ``reach``: how many candidates a cell
    has and their largest distance; ``asked``, ``spread``: the same of queries.
    """

    def __init__(self, space: Space, k: int, nearest: dict[int, list[float]], sizes: np.ndarray, reach: np.ndarray, asked: np.ndarray, spread: np.ndarray, query_block: int, data_block: int):
        apart, cells = space.between(), np.flatnonzero(asked)
        some = [(j, d) for j, ds in nearest.items() for d in ds]
        j, d = np.array([x[0] for x in some]), np.array([x[1] for x in some])
        bound = np.full(len(asked), np.inf)
        for i in cells:
            if len(some) >= k:
                bound[i] = spread[i] + np.partition(apart[i, j] + d, k - 1)[k - 1]
        wide = (spread + bound + space.slack)[:, None]
        low, high = apart - wide, apart + wide
        self.group = np.full(len(asked), -1)
        members: list[list[int]] = []
        left = sorted(cells, key=lambda i: (-asked[i], i))
        while left:  # cells of few queries that lie together are one group
            own, room = [left[0]], query_block - asked[left[0]]
            for i in sorted(left[1:], key=lambda i: (apart[left[0], i], i)):
                if asked[i] <= room:
                    own.append(i)
                    room -= asked[i]
            self.group[own] = len(members)
            members.append(own)
            left = [i for i in left if i not in set(own)]
        self.low = np.array([low[own].min(axis=0) for own in members])
        self.high = np.array([high[own].max(axis=0) for own in members])
        #: Parts of a group, and of a cell of candidates, by hash.
        self.parts = np.array([-(-int(asked[own].sum()) // query_block) for own in members])
        self.blocks = -(-sizes // data_block)
        self.first_part = np.concatenate([[0], np.cumsum(self.parts)])
        self.first_block = np.concatenate([[0], np.cumsum(self.blocks)])
        least = np.array([min(nearest.get(c, [np.inf])) for c in range(len(sizes))])
        #: By group, the cells whose candidates its ring can hold.
        self.meets = (self.low <= reach) & (self.high >= least) & (sizes > 0)

    def key(self, part: np.ndarray | int, block: np.ndarray | int) -> np.ndarray:
        return np.asarray(part, np.int64) * int(self.first_block[-1]) + block


def dealt(rows: DataFrame, rings: Rings) -> DataFrame:
    """Candidates (id, vec, cell, dist) with the key of each group's part and cell's block that they go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, dist, hashed = (np.asarray(b.column(i)) for i in (2, 3, 4))
            block = rings.first_block[cell] + hashed % rings.blocks[cell]
            for g in range(len(rings.parts)):
                take = np.flatnonzero((dist >= rings.low[g][cell]) & (dist <= rings.high[g][cell]))
                if len(take):
                    part = b.take(pa.array(take))
                    for p in range(rings.first_part[g], rings.first_part[g + 1]):
                        yield pa.RecordBatch.from_arrays([pa.array(rings.key(p, block[take])), part.column(0), part.column(1)], names=["key", "id", "vec"])

    return rows.select("id", "vec", "cell", "dist", F.xxhash64("vec", "id").alias("h")).mapInArrow(run, "key long, id long, vec binary")


def asking(rows: DataFrame, rings: Rings) -> DataFrame:
    """Queries (id, vec, cell) with the key of each block of candidates that their group meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [np.concatenate([np.arange(rings.first_block[c], rings.first_block[c + 1]) for c in np.flatnonzero(rings.meets[g])] or [np.zeros(0, np.int64)]) for g in range(len(rings.parts))]
        for b in batches:
            cell, hashed = (np.asarray(b.column(i)) for i in (2, 3))
            group = rings.group[cell]
            part = rings.first_part[group] + hashed % rings.parts[group]
            for g in np.unique(group):
                take = np.flatnonzero(group == g)
                own = b.take(pa.array(take))
                for block in cells[g]:
                    yield pa.RecordBatch.from_arrays([pa.array(rings.key(part[take], block)), own.column(0), own.column(1)], names=["key", "id", "vec"])

    return rows.select("id", "vec", "cell", F.xxhash64("vec").alias("h")).mapInArrow(run, "key long, id long, vec binary")


def best(ids: np.ndarray, missing: np.ndarray, x: np.ndarray, q: np.ndarray, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, row of x and score of the k best of each row of q: by score, then id, missing ids last."""
    rank = np.lexsort((ids, missing))
    x = x[rank].astype(float if exact else object)
    own, at, scores = [], [], []
    step = max(1, (1 << 22) // max(1, len(x)))
    for lo in range(0, len(q), step):
        got = q[lo : lo + step].astype(x.dtype) @ x.T
        got = got.astype(np.int64) if exact else np.clip(got, LEAST, MOST).astype(np.int64)
        if got.shape[1] > k:
            keep = got >= np.partition(got, got.shape[1] - k, axis=1)[:, got.shape[1] - k, None]
        else:
            keep = np.ones(got.shape, bool)
        row, col = np.nonzero(keep)
        score = got[row, col]
        order = np.lexsort((col, -score, row))
        row, col, score = row[order], col[order], score[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        row, col, score = row[nth < k], col[nth < k], score[nth < k]
        own.append(row + lo)
        at.append(rank[col])
        scores.append(score)
    return np.concatenate(own), np.concatenate(at), np.concatenate(scores)


def solver(space: Space, k: int):
    """A task: the candidates and queries of a key to the queries' k best."""
    names = ["query", "id", "score", "same"]
    schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("same", pa.bool_())])

    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        if not data.num_rows or not queries.num_rows:
            return schema.empty_table()
        x, q = (unpacked(t["vec"], space.kind, space.width) for t in (data, queries))
        missing = np.asarray(data["id"].is_null())
        own, at, score = best(np.asarray(data["id"].fill_null(0)), missing, x, q, k, space.exact)
        same = np.concatenate([(x[at[i : i + 65536]] == q[own[i : i + 65536]]).all(axis=1) for i in range(0, len(at), 65536)])
        return pa.Table.from_arrays([queries["id"].take(pa.array(own)), data["id"].take(pa.array(at)), pa.array(score), pa.array(same)], names=names)

    return run


def knn_join(candidates: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates (id, vec) of every query (id, vec), vectors being arrays of longs.

    A query's own row, the candidate of its id and vector, is left out once.
    """
    spark = candidates.sparkSession
    candidates, queries = (t.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<long>").alias("vec")).filter("vec is not null") for t in (candidates, queries))
    queries = queries.filter("id is not null")
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    largest = lambda v: F.greatest(F.abs(F.coalesce(F.array_max(v).cast("decimal(20,0)"), F.lit(0))), F.abs(F.coalesce(F.array_min(v).cast("decimal(20,0)"), F.lit(0))))
    facts = lambda t: t.agg(F.max(F.size("vec")), F.max(largest(F.col("vec"))), F.max(square(F.col("vec")))).first()
    of, asked = facts(candidates), facts(queries)
    if of[0] is None or asked[0] is None:
        return spark.createDataFrame([], FOUND)
    some = candidates.orderBy(F.xxhash64("id", "vec"), "id").limit(pivots).select("vec").collect()
    width = max(of[0], asked[0], 1)
    at = np.unique(np.array([[*r["vec"], *[0] * (width - len(r["vec"]))] for r in some], np.int64), axis=0)
    space = Space(at, width, int(max(of[1], asked[1])), float(max(of[2], asked[2])))
    first = Window.partitionBy("vec").orderBy(F.col("id").asc_nulls_last())
    reduced = common.written(placed(candidates, space, False).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).drop("n"), "knn-candidates")
    asks = placed(queries, space, True)
    distinct = asks.groupBy("vec").agg(F.min(F.struct("cell", "dist")).alias("at")).select(F.monotonically_increasing_id().alias("id"), "vec", "at.cell", "at.dist")
    distinct = common.written(distinct, "knn-queries")
    rings = summaries(reduced, distinct, space, k, query_block, data_block)
    found = dealt(reduced, rings).groupBy("key").cogroup(asking(distinct, rings).groupBy("key")).applyInArrow(solver(space, k + 1), "query long, id long, score long, same boolean")
    top = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    lists = found.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score", "same"))).alias("best"))
    by_vector = distinct.join(lists.withColumnRenamed("query", "id"), "id").select("vec", "best")
    own = F.array_position(F.transform("best", lambda b: b["same"] & b["id"].eqNullSafe(F.col("id"))), True)
    rest = F.slice(F.filter("best", lambda b, i: i != own.cast("int") - 1), 1, k)
    out = asks.select("id", "vec").join(by_vector, "vec").select(F.col("id").alias("query_id"), F.posexplode(rest).alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))


def summaries(reduced: DataFrame, distinct: DataFrame, space: Space, k: int, query_block: int, data_block: int) -> Rings:
    """The cells' summaries, of a few rows a cell, and the rings that follow."""
    near = Window.partitionBy("cell").orderBy("dist")
    nearest: dict[int, list[float]] = {}
    for r in reduced.select("cell", "dist", F.row_number().over(near).alias("n")).filter(F.col("n") <= k + 1).collect():
        nearest.setdefault(r["cell"], []).append(r["dist"])
    n = len(space.pivots)
    held = []
    for t in (reduced, distinct):
        sizes, reach = np.zeros(n, np.int64), np.zeros(n)
        for r in t.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("far")).collect():
            sizes[r["cell"]], reach[r["cell"]] = r["n"], r["far"]
        held += [sizes, reach]
    return Rings(space, k + 1, nearest, *held, query_block, data_block)


def op11_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The contract's columns: for every vec_id divisible by 100 its ten best of all other rows."""
    rows = common.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), whole(F.col("embedding"), 1024.0).alias("vec"))
    return knn_join(rows, rows.filter(F.col("id") % 100 == 0), 10)


SQL = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.r <> c.r),
  n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS k FROM s)
  SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM n WHERE k <= 10"""
