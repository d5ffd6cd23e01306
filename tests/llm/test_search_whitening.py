"""Top-k search and whitening against brute force in whole numbers."""

from fractions import Fraction

import duckdb
import numpy as np
import pytest

from bandloom.llm import knn_join as K
from bandloom.llm import whitening as W


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"id long, vec array<long>{extra}")


def brute_top(data, queries, k):
    """Rows (query, rank, id, score), sorted; each query leaves out one row of its id and vector."""
    out = []
    for q, v in queries:
        if q is None or v is None:
            continue
        rest = [(i, x) for i, x in data if x is not None]
        if (q, v) in rest:
            rest.remove((q, v))
        scored = sorted((-max(min(sum(a * b for a, b in zip(v, x, strict=False)), K.MOST), K.LEAST), i is None, i or 0) for i, x in rest)[:k]
        out += [(q, n + 1, None if missing else i, -s) for n, (s, missing, i) in enumerate(scored)]
    return sorted(out, key=str)


def made(frame):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in frame.collect()), key=str)


def clustered(seed, n, groups=12, dim=6, far=4000):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-far, far, (groups, dim))
    return [(i, (centres[rng.integers(groups)] + rng.integers(-9, 10, dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed,query_block,data_block,pivots", [(1, 65536, 65536, 256), (2, 7, 20, 16), (3, 1, 1, 5), (4, 10, 1000, 1)])
def test_top_k_equals_brute_force(spark, seed, query_block, data_block, pivots):
    rows = clustered(seed, 160)
    rng = np.random.default_rng(seed)
    rows += [(i, rows[rng.integers(10)][1]) for i in range(160, 200)]  # copies
    frame = table(spark, rows).repartition(3)
    queries = [r for r in rows if r[0] % 9 == 0]
    got = K.knn_join(frame, frame.filter("id % 9 = 0"), 4, pivots, query_block, data_block)
    assert made(got) == brute_top(rows, queries, 4)


def test_top_k_edges(spark):
    big = 2**62
    rows = [(0, [1, 2]), (0, [1, 2]), (0, [5, -1]), (3, [1, 2]), (3, None), (None, [1, 2]), (6, [4]), (9, []), (12, [0, 0, 7]), (1, [1, 2]), (2, [2, 1])]
    frame = table(spark, rows)
    asked = [r for r in rows if r[0] is not None and r[0] % 3 == 0]
    assert made(K.knn_join(frame, frame.filter("id % 3 = 0"), 3, data_block=2)) == brute_top(rows, asked, 3)
    assert made(K.knn_join(frame, frame.filter("id % 3 = 0"), 100)) == brute_top(rows, asked, 100)
    rows = [(0, [big, -big]), (1, [big, big]), (2, [-big, 3]), (3, [1, 1]), (4, [2**63 - 1, 5]), (6, [7, 7])]
    frame = table(spark, rows)
    assert made(K.knn_join(frame, frame.filter("id % 3 = 0"), 4)) == brute_top(rows, [r for r in rows if r[0] % 3 == 0], 4)
    nothing = frame.filter("id < 0")
    assert made(K.knn_join(nothing, frame, 4)) == [] and made(K.knn_join(frame, nothing, 4)) == []
    assert K.knn_join(nothing, nothing, 4).dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


def test_a_hot_vector_is_cut_down_and_rings_leave_cells_out(spark):
    rows = clustered(5, 300) + [(1000 + i, [1, 2, 3, 4, 5, 6]) for i in range(150)]
    frame = table(spark, rows).repartition(3)
    queries = [r for r in rows if r[0] % 50 == 0]
    assert made(K.knn_join(frame, frame.filter("id % 50 = 0"), 5, 32)) == brute_top(rows, queries, 5)
    x = np.array([v for _, v in rows])
    space = K.Space(np.unique(x[:40], axis=0), 6, int(abs(x).max()), float(np.square(x).sum(axis=1).max()))
    data, distinct = (K.placed(frame.filter(f), space, q).withColumnRenamed("id", "id") for f, q in (("true", False), ("id % 50 = 0", True)))
    rings = K.summaries(data, distinct, space, 5, 2, 65536)
    sent, whole = K.dealt(data, rings).count(), len(rows) * int(rings.parts.sum())
    assert sent < 0.9 * whole  # only what a ring can hold is replicated
    assert K.dealt(data, rings).groupBy("id").count().filter("count > 1").count() > 0


def test_top_k_of_the_given_vectors(spark, data):
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{data}/embeddings.parquet'")
    assert made(K.op11_exact_top_k(spark, data)) == sorted(c.sql(K.SQL).fetchall(), key=str)


def test_vectors_that_take_no_part(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25], 1), (100, [0.1, None], 1), (200, None, 1), (1, [nan, 0.0], 1), (2, [inf, 0.0], 2), (3, [0.5, 0.3], 2), (None, [0.1, 0.1], 2), (300, [3e38, -3e38], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, vec int").selectExpr("*", "vec AS cell", "'x' AS id").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = made(K.op11_exact_top_k(spark, str(tmp_path)))
    assert {r[0] for r in got} == {0, 300} and {r[2] for r in got} == {0, 3, None, 300}
    assert [r for r in got if r[0] == 0][-1][2:] == (None, 512 * 102 - 256 * 102)
    white = W.op12_embedding_whitening(spark, str(tmp_path)).collect()
    assert {r["vec_id"] for r in white} == {0, 3, None, 300} and {r["n"] for r in white} == {4}
    assert [r["explained"] for r in white if r["vec_id"] == 0][0] == pytest.approx(1)


def brute_whitening(rows):
    """n, deviation by row, and the exact covariance in fractions."""
    width = max(len(v) for _, v in rows)
    x = [tuple([*v, *[0] * (width - len(v))]) for _, v in rows]
    fit = sorted(set(x))
    n = len(fit)
    sums = [sum(v[d] for v in fit) for d in range(width)]
    cov = [[sum((Fraction(v[a]) - Fraction(sums[a], n)) * (Fraction(v[b]) - Fraction(sums[b], n)) for v in fit) / n for b in range(width)] for a in range(width)]
    return n, [sum((n * v[d] - sums[d]) ** 2 for d in range(width)) for v in x], cov, [[v[d] - sums[d] / n for d in range(width)] for v in x]


@pytest.mark.parametrize("seed,scale", [(1, 200), (2, 10**6), (3, 10**9)])
def test_whitening_equals_brute_force(spark, seed, scale):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(60, 5)) * [9, 5, 3, 2, 1] * scale / 9 + scale * 3).astype(int)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, x[0].tolist()), (101, x[0].tolist()), (101, x[0].tolist())]
    n, deviations, cov, centred = brute_whitening(rows)
    got = W.whiten(table(spark, rows).repartition(4)).orderBy("vec_id", "component").collect()
    assert len(got) == 4 * len(rows) and {r["n"] for r in got} == {n} == {60}
    assert [r["deviation"] for r in got[::4]] == [d if d < 2**63 else None for d in deviations]
    values, vectors = np.linalg.eigh(np.array(cov, float))
    expected = np.array(centred) @ vectors[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    found = np.array([r["whitened"] for r in sorted(got[:-8], key=lambda r: (r["vec_id"], r["component"]))]).reshape(-1, 4)
    expected = expected[:-2]  # the repeated row's come in any order
    assert sorted(r["whitened"] for r in got[-8:])[::2] == sorted(r["whitened"] for r in got[-8:])[1::2]
    assert np.allclose(found * np.sign((found * expected).sum(axis=0)), expected, atol=1e-7)
    assert np.allclose([r["explained"] for r in got[:4]], values[::-1][:4] / values.sum(), rtol=1e-9)
    assert all(r["identity_error"] < 1e-9 for r in got)


def test_small_eigenvalues_beside_a_huge_one(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-50, 50, (80, 4)) * np.array([1, 1, 3, 9])
    rows = [(i, [int(v[0]) + 10**13 * (i % 7), *map(int, v[1:])]) for i, v in enumerate(x)]
    got = W.whiten(table(spark, rows)).orderBy("vec_id", "component").collect()
    _, _, cov, _ = brute_whitening(rows)
    trace = float(sum(cov[i][i] for i in range(4)))
    rest = np.array([[float(cov[a][b] - cov[a][0] * cov[0][b] / cov[0][0]) for b in (1, 2, 3)] for a in (1, 2, 3)])
    assert np.allclose([r["explained"] for r in got[1:4]], np.linalg.eigvalsh(rest)[::-1] / trace, rtol=1e-4)
    assert all(r["identity_error"] < 1e-4 for r in got)


def test_whitening_edges(spark):
    assert W.whiten(table(spark, [])).count() == 0 and W.whiten(table(spark, [(1, None)])).count() == 0
    assert W.whiten(table(spark, [(1, [])])).count() == 0  # no dimension, no component
    one = W.whiten(table(spark, [(1, [3, 4]), (2, [3, 4]), (None, [3, 4])])).collect()
    assert len(one) == 6 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in one)
    line = W.whiten(table(spark, [(i, [i, 2 * i, 7]) for i in range(9)], )).orderBy("vec_id", "component").collect()
    assert [(r["whitened"] is None, r["explained"]) for r in line[:3]] == [(False, pytest.approx(1)), (True, 0), (True, 0)]
    assert line[0]["identity_error"] < 1e-9
    ragged = W.whiten(table(spark, [(1, [5]), (2, [5, 0]), (3, []), (4, [1, 1])])).collect()
    assert {r["n"] for r in ragged} == {3}
    huge = W.whiten(table(spark, [(1, [2**63 - 1, 0]), (2, [-(2**63), 5]), (3, [0, 9])])).orderBy("vec_id", "component").collect()
    assert len(huge) == 6 and huge[0]["deviation"] is None and huge[0]["explained"] == pytest.approx(1)
    clash = table(spark, [(1, [1, 2], 5, 6), (2, [2, 1], 5, 6), (3, [4, 9], 5, 6)], ", deviation int, whitened int")
    assert W.whiten(clash).count() == 6


def test_residues_restore_whole_numbers():
    moduli = W.primes(2 * 10**30)
    for value in (0, 1, -1, 10**30, -(10**30), 123456789012345678901234567890):
        assert W.restored([value % p for p in moduli], moduli) == value
    x = np.random.default_rng(0).integers(-(2**40), 2**40, (3000, 3))
    total = W.partial_scatter([x[:1000], x[1000:]], W.primes(2 * 3000 * 2**80))
    exact = x.astype(object).T @ x.astype(object)
    assert all(W.restored([int(t[i, j]) for t in total], W.primes(2 * 3000 * 2**80)) == exact[i, j] for i in range(3) for j in range(3))
