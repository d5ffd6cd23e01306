"""Kept sketches against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.operators import sketches


def test_sketches_merge_and_become_exact(spark):
    rng = np.random.default_rng(1)
    values = {"wide": rng.lognormal(0, 3, 60_000), "ties": np.repeat([1.0, 2.0, 9.0], 12_000), "few": rng.normal(size=11), "one": np.array([5.0])}
    rows = spark.createDataFrame([(g, i % 5, float(v)) for g, x in values.items() for i, v in enumerate(x)] + [("few", 1, None), ("few", 2, float("nan")), ("none", 1, None)], "g string, day int, v double").repartition(4)
    days = sketches.sketched(rows, ["g", "day"], "v")
    whole = sketches.merged(days, ["g"]).cache()
    shares = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.5001, "e": 0.99, "f": 1.0}
    got = {r["g"]: r for r in sketches.exact(rows, whole, ["g"], "v", shares).collect()}
    assert set(got) == set(values)
    for g, x in values.items():
        assert [got[g][n] for n in shares] == pytest.approx([float(np.quantile(x, p)) for p in shares.values()], rel=1e-12)
    near = {r["g"]: r for r in sketches.exact(rows, whole, ["g"], "v", shares, nearest=True).collect()}
    assert all(near[g][n] == np.sort(x)[round(p * (len(x) - 1))] for g, x in values.items() for n, p in shares.items())
    rough = {r["g"]: r["q"] for r in whole.select("g", sketches.estimate(0.9).alias("q")).collect()}
    assert abs((values["wide"] <= rough["wide"]).mean() - 0.9) < 4 * sketches.rank_error()
    assert whole.filter("g = 'wide'").select(F.length("sketch")).first()[0] < 150_000
    inside = whole.select("g").join(rows, "g")
    assert sketches.exact(inside.limit(0), whole.limit(0), ["g"], "v", shares).count() == 0


def test_sketches_of_other_rows_are_an_error(spark):
    rows = spark.range(50_000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    whole = sketches.merged(sketches.sketched(rows, ["g"], "v"), ["g"])
    with pytest.raises(Exception, match="bracket"):
        sketches.exact(rows.withColumn("v", F.col("v") + 30_000), whole, ["g"], "v", {"m": 0.5}).collect()
