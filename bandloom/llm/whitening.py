"""Whitening of embeddings by an exact scatter matrix in residue numbers.

Vectors of whole numbers are deduplicated, and a one is put behind each, so one scatter matrix holds the sums of
products, the sums and the number of vectors. Every task multiplies its vectors modulo several primes below 2^20: with
residues around 0 and at most 2^14 rows at a time, products and sums stay below 2^53, so a plain product of matrices of
doubles is exact. Residues are summed by Spark, and the Chinese remainder theorem gives the whole numbers, for which
enough primes are taken beforehand: their product exceeds twice the number of rows times the square of the largest
component. The covariance is then n * sums of products less the product of sums, in whole numbers, which no mean's
rounding can spoil, over n^2; its eigenvectors come from a double decomposition, and their eigenvalues from the quotient
of the exact matrix, whose error is the square of the vectors' error. Eigenvalues far below the largest are decomposed
again without it, in a block cut exactly from the same matrix, so they are right too; the rank says which are 0.

Bounds: the driver sees the upper half of one matrix for each prime, whatever the number of rows; a task holds 2^14 rows.

Edge cases: vectors that are null or hold nulls or non-finite numbers are dropped; shorter ones are filled up with zeros;
equal vectors count once, rows that repeat are all returned; null ids are ids like others; components beyond a long are
its ends; a deviation beyond a long is null; eigenvalues below 1e-28 of the largest come from vectors that doubles no
longer hold well; a component whose eigenvalue is 0 has
no whitened value, which is null, explains 0, or null where the trace is 0, and takes no part in the identity's error,
which is null if all are such; empty tables give an empty table; other columns aren't read. Of equal eigenvalues any
basis may come, the same for all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .knn_join import matrix, whole

#: Residues lie within half of a prime, so a product of two and a sum of ``ROWS`` products stay below 2^53.
PRIMES_BELOW, ROWS = 1 << 20, 1 << 14


def primes(product: int) -> list[int]:
    """The largest primes below ``PRIMES_BELOW`` whose product exceeds the number."""
    found, reached, at = [], 1, PRIMES_BELOW
    while reached <= product:
        at -= 1
        if all(at % k for k in range(2, math.isqrt(at) + 1)):
            found.append(at)
            reached *= at
    return found


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Of each number modulo p, the one nearest to 0."""
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r).astype(float)


def partial_scatter(blocks: Iterator[np.ndarray], moduli: list[int]) -> np.ndarray | None:
    """By prime, the scatter of the blocks' rows modulo it; None without rows."""
    total = None
    for x in blocks:
        if len(x):
            new = np.stack([np.mod((r := residues(x, p)).T @ r, p) for p in moduli])
            total = new if total is None else np.mod(total + new, np.array(moduli, float)[:, None, None])
    return total


def restored(parts: list[int], moduli: list[int]) -> int:
    """The whole number around 0 that has these remainders."""
    value, product = 0, 1
    for r, p in zip(parts, moduli, strict=True):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if value > product // 2 else value


def scatter(vectors: DataFrame, width: int, largest: int, rows: int) -> list[list[int]]:
    """The exact scatter matrix of the vectors (vec, arrays of longs) with a one behind each: sums of products, sums, and how many.

    ``largest``: of any component's absolute value; ``rows``: how many vectors there are at most.
    """
    moduli = primes(2 * max(rows, 1) * max(largest, 1) ** 2)
    upper = np.triu_indices(width + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[np.ndarray]:
            for batch in batches:
                for b in common.small_batches(batch, max(1, min(ROWS, (1 << 23) // (width + 1)))):
                    yield np.hstack([matrix(b.column(0), width), np.ones((b.num_rows, 1), np.int64)])

        total = partial_scatter(blocks(), moduli)
        for m, part in enumerate(total if total is not None else ()):
            for at in range(0, len(upper[0]), 1 << 16):
                i, j = (u[at : at + (1 << 16)].astype(np.int32) for u in upper)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), m, np.int32)), pa.array(i), pa.array(j), pa.array(part[i, j].astype(np.int64))], names=["m", "i", "j", "part"])

    sums = vectors.select("vec").mapInArrow(run, "m int, i int, j int, part long").groupBy("i", "j").pivot("m", list(range(len(moduli)))).agg(F.sum("part"))
    out = [[0] * (width + 1) for _ in range(width + 1)]
    for row in sums.toLocalIterator():
        i, j, *parts = row
        out[i][j] = out[j][i] = restored([r % p for r, p in zip(parts, moduli, strict=True)], moduli)
    return out


def rank(exact: np.ndarray) -> int:
    """Of a matrix of whole numbers: its rank modulo two primes below 2^31, the larger; elimination there has no rounding."""
    return max(rank_modulo(exact, p) for p in (2**31 - 1, 2**31 - 19))


def rank_modulo(exact: np.ndarray, p: int) -> int:
    a, done = (exact % p).astype(np.int64), 0
    for column in range(len(a)):
        at = np.flatnonzero(a[done:, column])
        if len(at):
            a[[done, done + at[0]]] = a[[done + at[0], done]]
            a[done] = a[done] * pow(int(a[done, column]), -1, p) % p
            a[done + 1 :] = (a[done + 1 :] - a[done + 1 :, column, None] * a[done]) % p
            done += 1
    return done


def lengthened(v: np.ndarray) -> np.ndarray:
    """Vectors within the unit ball as whole numbers, 2^62 for 1."""
    return np.array([int(x) for x in np.rint(v.ravel() * 2.0**62)], object).reshape(v.shape)


def quotient(exact: np.ndarray, v: np.ndarray) -> float:
    """v'Av / v'v of a matrix of whole numbers, worked out in whole numbers."""
    at = lengthened(v)
    return int(at @ (exact @ at)) / int(at @ at)


#: Eigenvalues below this share of a block's largest are decomposed again without those above, where their rounding would drown them.
GRADE = 1e-6


def eigenvectors(exact: np.ndarray, square: int, most: int, live: int) -> np.ndarray:
    """Unit eigenvectors of the ``most`` largest eigenvalues of a matrix of whole numbers over ``square``, of which ``live`` aren't 0."""
    width = len(exact)
    basis, found = np.eye(width), np.zeros((width, 0))
    block = np.array([[int(x) / square for x in row] for row in exact])
    while True:
        values, vectors = np.linalg.eigh(block)
        values, vectors = values[::-1], vectors[:, ::-1]
        # the last block's small ones may be noise of zeros, in any order
        sure = int((values >= GRADE * values[0]).sum()) if values[0] > 0 else len(values)
        sure = len(values) if found.shape[1] + sure >= live else sure
        found = np.hstack([found, basis @ vectors[:, :sure]])
        if found.shape[1] >= most:
            return found[:, :most].T / np.linalg.norm(found[:, :most].T, axis=1, keepdims=True)
        basis = np.linalg.qr(np.hstack([found, basis @ vectors[:, sure:]]))[0][:, found.shape[1] :]
        whole_basis = lengthened(basis)
        inner = whole_basis.T @ exact @ whole_basis
        block = np.array([[int(x) / (square << 124) for x in row] for row in inner])


@dataclass
class Whitening:
    """n vectors with the sums ``sums``; unit ``components`` by falling eigenvalue, whose ``values`` are 0 where nothing varies."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: list[float]
    trace: float
    largest: int

    @classmethod
    def of(cls, table: list[list[int]], most: int, largest: int) -> Whitening:
        width, n = len(table) - 1, table[-1][-1]
        sums = table[-1][:width]
        exact = np.array([[n * table[i][j] - sums[i] * sums[j] for j in range(width)] for i in range(width)], object).reshape(width, width)
        square, most = n * n or 1, min(most, width)
        components, values = np.zeros((most, width)), [0.0] * most
        live = min(most, rank(exact))
        if most:
            found = eigenvectors(exact, square, most, live)
            components, values[:live] = found, [quotient(exact, v) / square for v in found[:live]]
        return cls(n, sums, components, values, sum(int(exact[i, i]) for i in range(width)) / square, largest)

    def project(self, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """Each row's deviation, and its values on the components, NaN where nothing varies."""
        n, spread = max(self.n, 1), self.n * self.largest + max(map(abs, self.sums), default=0)
        exact = len(self.sums) * spread**2 < 2**63
        off = n * x.astype(np.int64 if exact else object) - np.array(self.sums, np.int64 if exact else object)
        deviation = [int(d) if d < 2**63 else None for d in (off * off).sum(axis=1)]
        centred = (off / n).astype(float)
        values = np.array([e or np.nan for e in self.values])
        return deviation, centred @ self.components.T / np.sqrt(values)


def projected(rows: DataFrame, white: Whitening, width: int, deviations: bool = True) -> DataFrame:
    """``rows`` (id, vec) as id, deviation and whitened, an array with a null where a component doesn't vary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in common.small_batches(batch, max(1, min(4096, (1 << 22) // max(width, 1)))):
                deviation, out = white.project(matrix(b.column(1), width))
                offsets = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)) if out.shape[1] else pa.array([0] * (b.num_rows + 1), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(out.ravel(), from_pandas=True))], names=["id", "deviation", "whitened"])

    return rows.select("id", "vec").mapInArrow(run, "id long, deviation long, whitened array<double>")


def fitted(rows: DataFrame, most: int = 4) -> tuple[Whitening, DataFrame, int]:
    """The whitening of the distinct vectors of ``rows`` (vec, arrays of longs), these vectors, and their width."""
    ends = lambda f: F.coalesce(f("vec").cast("decimal(20,0)"), F.lit(0))
    width, largest, n = rows.agg(F.max(F.size("vec")), F.max(F.greatest(F.abs(ends(F.array_max)), F.abs(ends(F.array_min)))), F.count("*")).first()
    width = width or 0
    filled = F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("vec")))
    distinct = common.written(rows.select(filled.alias("vec")).distinct(), "whitening-fit")
    table = scatter(distinct, width, int(largest or 0), n)
    return Whitening.of(table, most, int(largest or 0)), distinct, width


def identity_error(white: Whitening, distinct: DataFrame, width: int) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance less the identity."""
    live = [k for k, e in enumerate(white.values) if e]
    if not live:
        return None
    values = projected(distinct.select(F.lit(None).cast("long").alias("id"), "vec"), white, width).select(*(F.col("whitened")[k].alias(f"w{k}") for k in live))
    pairs = [(a, b) for a in live for b in live if a <= b]
    one = values.agg(*(F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs)).first()
    return max(abs(c - (a == b)) for c, (a, b) in zip(one, pairs, strict=True))


def whiten(rows: DataFrame, most: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of ``rows`` (id, vec: arrays of longs, null: dropped), a row for each of the first ``most`` components."""
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<long>").alias("vec")).filter("vec is not null")
    white, distinct, width = fitted(rows, most)
    error = identity_error(white, distinct, width)
    explained = F.array(*(F.lit(e / white.trace if white.trace else None).cast("double") for e in white.values))
    out = projected(rows, white, width).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), F.lit(white.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """The contract's columns: each embedding's first four whitened components."""
    return whiten(common.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), whole(F.col("embedding"), 256.0).alias("vec")), 4)
