"""Student's distribution in the plan against the same on the driver and known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.functions import student
from bandloom.operators import summaries as Q


def test_gamma(spark):
    z = [0.5, 1.0, 1.5, 2.0, 7.25, 100.0, 12345.5]
    got = spark.createDataFrame([(v,) for v in z], "z double").select("z", student.lgamma(F.col("z")).alias("g")).collect()
    assert all(r["g"] == pytest.approx(math.lgamma(r["z"]), rel=1e-11, abs=1e-11) for r in got)


def test_tails(spark):
    cases = [(t, df) for t in (-40.0, -3.0, -0.5, -1e-9, 0.0, 0.2, 1.0, 2.5, 12.0, 300.0) for df in (1.0, 1.7, 2.0, 5.0, 30.0, 999.0, 1e6)]
    got = spark.createDataFrame(cases, "t double, df double").select("t", "df", student.less(F.col("t"), F.col("df")).alias("p"), student.two_sided(F.col("t"), F.col("df")).alias("q")).collect()
    for r in got:
        assert r["p"] == pytest.approx(Q.student_less(r["t"], r["df"]), rel=1e-8, abs=1e-12)
        assert r["q"] == pytest.approx(2 * min(r["p"], 1 - r["p"]), rel=1e-6, abs=1e-12)
    exact = {(1.0, 1.0): 0.75, (1.0, 2.0): 0.5 + 1 / (2 * math.sqrt(3)), (0.0, 5.0): 0.5}  # closed forms
    assert all(r["p"] == pytest.approx(exact[r["t"], r["df"]], rel=1e-12) for r in got if (r["t"], r["df"]) in exact)
    odd = spark.createDataFrame([(None, 3.0), (float("nan"), 3.0), (1.0, None), (1.0, 0.0), (float("inf"), 3.0)], "t double, df double")
    assert [r["q"] for r in odd.select(student.two_sided(F.col("t"), F.col("df")).alias("q")).collect()] == [None, None, None, None, 0.0]


def test_pairs_and_paired(spark):
    rng = np.random.default_rng(5)
    values = {"a": rng.normal(0, 1, 30), "b": rng.normal(0.4, 3, 12), "c": rng.normal(5, 1, 50), "one": np.array([1.0]), "same": np.array([2.0, 2.0])}
    rows = spark.createDataFrame([(g, i, float(v)) for g, x in values.items() for i, v in enumerate(x)] + [(None, 1, 2.0), ("a", 99, None), ("a", 98, float("nan"))], "g string, k int, v double")
    got = {(r["a"], r["b"]): r for r in Q.welch_pairs(rows, "g", "v").collect()}
    assert len(got) == 10
    one = Q.welch(rows.filter("NOT isnan(v)"), "g", "v", "a", "b").first()
    assert (got["a", "b"]["t"], got["a", "b"]["df"]) == pytest.approx((one["t"], one["df"]), rel=1e-12)
    assert got["a", "b"]["p_less"] == pytest.approx(Q.student_less(one["t"], one["df"]), rel=1e-9) and got["a", "c"]["p_two"] < 1e-20
    assert got["one", "same"]["t"] is None and got["one", "same"]["p_two"] is None
    pair = Q.paired(rows, ["k"], "g", "v", "a", "b").first()
    d = values["a"][:12] - values["b"]
    t = d.mean() / (d.std(ddof=1) / math.sqrt(12))
    assert (pair["n"], pair["t"], pair["correlation"]) == (12, pytest.approx(t), pytest.approx(np.corrcoef(values["a"][:12], values["b"])[0, 1]))
    assert pair["p_less"] == pytest.approx(Q.student_less(t, 11), rel=1e-9)
    assert Q.welch_pairs(rows.limit(0), "g", "v").count() == 0 and Q.paired(rows.limit(0), ["k"], "g", "v", "a", "b").first()["n"] == 0
