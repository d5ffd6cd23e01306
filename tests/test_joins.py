"""As-of and range joins and products of blocks against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.operators import inversion as V
from bandloom.operators import joins as J


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def plain_asof(left, right, strict, within):
    out = []
    for i, k, t in left:
        fit = [] if k is None or t is None else [r for r in right if r[1] == k and r[2] is not None and (r[2] < t or (r[2] == t and not strict))]
        best = max(fit, key=lambda r: (r[2], r[0])) if fit else None
        out.append((i, k, t, None if best is None or (within is not None and t - best[2] > within) else best[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("strict,within,width", [(False, None, 10), (True, None, 3), (False, 4, 1), (True, 7, 1000)])
def test_asof(spark, strict, within, width):
    rng = random.Random(width)
    make = lambda n: [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(60)])) for i in range(n)]
    left, right = make(150), make(120)
    a, b = (spark.createDataFrame(x, "id int, key string, at int").repartition(3) for x in (left, right))
    found = J.asof(a, b, ["key"], "at", {"other": "id"}, ties=["id"], strict=strict, within=within, width=width)
    assert rows_of(found) == plain_asof(left, right, strict, within)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)


def test_asof_of_times_clashing_names_and_nothing(spark):
    at = dt.datetime(2024, 1, 1, 12)
    left = spark.createDataFrame([(1, "a", at + dt.timedelta(days=9)), (2, "a", at - dt.timedelta(days=1))], "__t int, __own string, at timestamp")
    right = spark.createDataFrame([(7, "a", at), (8, "a", at)], "id int, __own string, at timestamp")
    assert rows_of(J.asof(left, right, ["__own"], "at", {"r": "id", "r_at": "at"}, ties=["id"]).select("__t", "r", "r_at")) == [(1, 8, at), (2, None, None)]
    assert rows_of(J.asof(left, right, ["__own"], "at", {"r": "id"}, within=float(J.DAY)).select("__t", "r")) == [(1, None), (2, None)]
    assert J.asof(left, right.filter("false"), ["__own"], "at", {"r": "id"}).select("r").collect() == [(None,), (None,)]
    assert J.asof(left.filter("false"), right, ["__own"], "at", {"r": "id"}).count() == 0
    numbers = spark.createDataFrame([(1, "a", float("nan")), (2, "a", 3.0)], "id int, k string, at double")
    assert rows_of(J.asof(numbers, numbers, ["k"], "at", {"r": "id"}).select("id", "r")) == [(1, None), (2, 2)]


def test_a_hot_key_is_cut_into_slices(spark):
    left = spark.range(3000).select("id", F.lit("hot").alias("k"), (F.col("id") * 7 % 3000).alias("at"))
    right = spark.range(300).select(F.col("id").alias("rid"), F.lit("hot").alias("k"), (F.col("id") * 10).alias("at"))
    found = J.asof(left, right, ["k"], "at", {"rid": "rid"}, width=100)
    assert found.filter("rid = floor(at / 10)").count() == 3000
    assert "Window" in plan_of(found) and "__s" in plan_of(found)


@pytest.mark.parametrize("hot,width", [(1_000_000, 5.0), (3, 2.0), (1, 50.0)])
def test_range_join(spark, hot, width):
    rng = random.Random(hot)
    points = [(i, rng.choice([None, rng.uniform(-20, 60), float(rng.randrange(40))]), rng.choice(["a", "b", None])) for i in range(120)] + [(500 + i, 7.0, "a") for i in range(30)]
    spans = [(i, (a := rng.choice([None, float(rng.randrange(-10, 40))])), None if a is None else a + rng.choice([-3, 0, 0.5, 2, 5, 33, 1000]), rng.choice(["a", "b", None])) for i in range(60)]
    p, s = spark.createDataFrame(points, "pid int, at double, k string").repartition(3), spark.createDataFrame(spans, "sid int, a double, b double, k string")
    met = [(i, j, ks == kp) for i, a, b, ks in spans for j, at, kp in points if a is not None and at is not None and a <= at < b]
    found = J.range_join(p, s.withColumnRenamed("k", "sk"), "at", "a", "b", width=width, hot=hot)
    assert sorted((r["sid"], r["pid"]) for r in found.collect()) == sorted((i, j) for i, j, _ in met)
    keyed = J.range_join(p, s, "at", "a", "b", width=width, by=["k"], hot=hot)
    same = {(i, k) for i, *_, k in spans} and [(i, j) for i, a, b, ks in spans for j, at, kp in points if None not in (a, at, ks) and ks == kp and a <= at < b]
    assert sorted((r["sid"], r["pid"]) for r in keyed.collect()) == sorted(same)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    assert J.range_join(p, s.filter("false"), "at", "a", "b", width=width, by=["k"]).count() == 0


def test_a_span_stands_in_two_cells_at_most(spark):
    spans = spark.range(400).selectExpr("id", "cast(id AS double) * 1.7 AS a", "cast(id AS double) * 1.7 + 0.001 * id * id AS b").filter("a < b")
    level = J.span_level(F.col("b") - F.col("a"), 0.7)
    cell = lambda c: F.floor(F.col(c) / (0.7 * F.pow(F.lit(2.0), level)))
    assert spans.select((cell("b") - cell("a")).alias("n")).agg(F.max("n")).first()[0] == 1


def test_block_product(spark):
    rng = np.random.default_rng(1)
    a, b = {g: rng.normal(size=(9, 7)) for g in "xy"}, {g: rng.normal(size=(7, 4)) for g in "xy"}
    left = spark.createDataFrame([(g, i, row.tolist()) for g, m in a.items() for i, row in enumerate(m)], "g string, i int, row array<double>")
    right = spark.createDataFrame([(g, j, col.tolist()) for g, m in b.items() for j, col in enumerate(m.T)], "g string, j int, col array<double>")
    for size in (1, 3, 7, 50):
        got = J.block_product(J.blocks(left, "row", size), J.blocks(right, "col", size), ["g"], ["i"], "j").collect()
        assert len(got) == 72 and all(math.isclose(r["value"], (a[r["g"]] @ b[r["g"]])[r["i"], r["j"]], abs_tol=1e-12) for r in got)
    assert J.blocks(spark.createDataFrame([("x", 1, []), ("x", 2, None)], left.schema), "row", 3).count() == 0


@pytest.mark.parametrize("p,q,n", [(6, 6, 6), (3, 8, 5), (7, 5, 5), (2, 4, 4), (4, 9, 1)])
def test_common_factors_rebuild_both_matrices(p, q, n):
    rng = np.random.default_rng(p * q)
    a, b = rng.normal(size=(11, p, n)), rng.normal(size=(11, q, n))
    f = V.gsvd_many(a, b)
    together = lambda vectors, values: np.einsum("mki,mk,mkj->mij", vectors, values, f["x"])
    assert np.allclose(together(f["u"], f["alpha"]), a) and np.allclose(together(f["v"], f["beta"]), b)
    assert np.allclose(f["alpha"] ** 2 + f["beta"] ** 2, 1) and (np.diff(f["alpha"], axis=1) <= 1e-12).all()
    assert np.allclose(f["w"] @ f["x"], np.eye(n)) and np.allclose(np.einsum("mki,mkj->mij", f["u"], f["u"]), np.eye(p))
    if p <= q:
        one = V.gsvd(a[0], b[0])
        assert np.allclose(one[0], f["alpha"][0]) and np.allclose(one[1], f["beta"][0])


def test_stacked_regularisation_equals_one_by_one():
    rng = np.random.default_rng(2)
    a, b, d = rng.normal(size=(20, 6, 6)), rng.normal(size=(20, 8, 6)), rng.normal(size=(20, 6)) * 3
    f = V.gsvd_many(a, b)
    single = [V.reg_map(f["alpha"][i], f["beta"][i], f["u"][i], d[i], np.ones(6)) for i in range(20)]
    assert np.allclose(V.reg_maps_stacked(f["alpha"], f["beta"], f["u"], d, np.ones(6)), single)


def test_regularisation_of_many_rows_holds_few_at_once():
    import tracemalloc

    rng = np.random.default_rng(3)
    f, d = V.gsvd_many(rng.normal(size=(3000, 6, 6)), rng.normal(size=(3000, 6, 6))), rng.normal(size=(3000, 6)) * 3
    tracemalloc.start()
    stacked = V.reg_maps_stacked(f["alpha"], f["beta"], f["u"], d, np.ones(6))
    same = V.reg_maps(np.arange(1.0, 7), np.ones(6), np.eye(6), d, np.full(6, 0.1))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20 << 20
    for i in (0, 63, 64, 2999):
        assert stacked[i] == V.reg_maps_stacked(f["alpha"][i : i + 1], f["beta"][i : i + 1], f["u"][i : i + 1], d[i : i + 1], np.ones(6))[0]
        assert same[i] == V.reg_map(np.arange(1.0, 7), np.ones(6), np.eye(6), d[i], np.full(6, 0.1))


def test_pairs_of_any_shape_and_none(spark):
    rows = [(1, [[1.0, 0.0], [0.0, 2.0]], [[1.0, 0.0], [0.0, 1.0]]), (2, [[3.0]], [[2.0]]), (3, None, [[1.0]]), (4, [[1.0, 2.0]], [[1.0]]), (5, [[1.0, None]], [[1.0, 2.0]]), (6, [[1.0, 2.0], [1.0]], [[1.0, 2.0]]), (7, [], []), (8, [[4.0]], [[0.0]])]
    got = {r["id"]: r for r in V.gsvd_frame(spark.createDataFrame(rows, "id int, a array<array<double>>, b array<array<double>>").coalesce(1), ["id"]).collect()}
    assert len(got) == 8 and got[2]["alpha"] == [pytest.approx(3 / math.sqrt(13))] and got[1]["alpha"] == [pytest.approx(2 / math.sqrt(5)), pytest.approx(1 / math.sqrt(2))]
    assert all(got[i]["alpha"] is None and got[i]["x"] is None for i in (3, 4, 5, 6, 7)) and got[8]["alpha"] == [0.0]


def test_exploded_sides_of_a_range_join_are_not_broadcast(spark):
    spans = spark.range(50).selectExpr("id AS sid", "explode(sequence(0, 22)) AS k").selectExpr("sid", "k * 1D AS a", "k + 1D AS b")
    points = spark.range(50).selectExpr("id AS sid", "explode(sequence(0, 199)) AS i").selectExpr("sid", "i * 23D / 200 AS at")
    found = J.range_join(points, spans, "at", "a", "b", width=1.0, by=["sid"])
    plan = plan_of(found).partition("Initial Plan")[2] or plan_of(found)
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 2  # both with the hot cells alone
    assert found.count() == 50 * 200


@pytest.mark.parametrize("hot,together", [(10, 4), (10, 1), (50, 7), (10**6, 512)])
def test_range_join_of_points_together(spark, hot, together):
    rng = random.Random(together)
    points = [(i, rng.choice([None, math.nan, rng.uniform(-20, 60), float(rng.randrange(40))]), rng.choice(["a", "b", None])) for i in range(150)] + [(500 + i, 7.0, "a") for i in range(40)]
    spans = [(i, (a := rng.choice([None, float(rng.randrange(-10, 40))])), None if a is None else a + rng.choice([-3, 0, 0.5, 2, 5, 33, 1000]), rng.choice(["a", "b", None])) for i in range(80)] + [(900 + i, 6.0, 8.0, "a") for i in range(40)]
    p, s = spark.createDataFrame(points, "pid int, at double, k string").repartition(3), spark.createDataFrame(spans, "sid int, a double, b double, k string")
    met = [(i, j, ks, kp, at) for i, a, b, ks in spans for j, at, kp in points if a is not None and at is not None and a <= at < b]
    found = J.range_join(p, s.withColumnRenamed("k", "sk"), "at", "a", "b", width=3.0, hot=hot, together=together)
    rows = found.select("sid", "pid", "sk", "k", "at").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(met, key=str) and len(met) > 2000
    keyed = J.range_join(p, s, "at", "a", "b", width=3.0, by=["k"], hot=hot, together=together)
    assert sorted((r["sid"], r["pid"]) for r in keyed.collect()) == sorted((i, j) for i, j, ks, kp, _ in met if ks is not None and ks == kp)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    assert J.range_join(p, s.filter("false"), "at", "a", "b", width=3.0, by=["k"], together=together).count() == 0


def test_range_views_takes_few_bytes_a_row(spark, tmp_path):
    from bandloom.plans import catalogue

    events = spark.range(12_000).selectExpr("id * 7919 % 12000 AS event_id", "timestamp_micros(1704067200000000 + id * 1800000) AS ts", "CASE WHEN id % 3 = 0 THEN 'error' ELSE 'view' END AS event_type", "cast(id * 37 % 10007 AS double) / 100 AS value")
    events.write.parquet(str(tmp_path / "events.parquet"))
    found = catalogue.range_views(spark, str(tmp_path))
    found.write.parquet(str(tmp_path / "found"))
    read = spark.read.parquet(str(tmp_path / "found"))
    views, errors = events.filter("event_type = 'view'").alias("v"), events.filter("event_type = 'error'").alias("e")
    inside = F.expr("v.ts >= e.ts AND unix_micros(v.ts) < unix_micros(e.ts) + floor(e.value * 60000000)")
    plain = errors.join(views, inside).select(F.col("e.event_id").alias("span_id"), F.col("v.event_id").alias("event_id"), F.col("v.value").alias("value"))
    seen = lambda rows: rows.agg(F.count("*"), F.sum(F.xxhash64("span_id", "event_id", "value").cast("decimal(38,0)"))).first()
    assert seen(read) == seen(plain) and read.count() > 4_000_000
    assert sum(x.stat().st_size for x in (tmp_path / "found").glob("*.parquet")) < 1.2 * read.count()  # 2.3 when points met spans one by one
