"""Solvers in SQL text and on the command line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.operators import calibration as C
from bandloom.operators import inversion as V
from bandloom.operators import selection as S
from bandloom.operators import sql_functions as B


@pytest.fixture(scope="module")
def mine(spark, tmp_path_factory):
    """A user's module, sent to the workers."""
    path = tmp_path_factory.mktemp("user") / "solver_of_mine.py"
    path.write_text("import numpy as np\n\n\ndef doubled(dn, edn):\n    return {'dem': dn * 2, 'many': np.isfinite(dn).sum(axis=1)}\n")
    spark.sparkContext.addPyFile(str(path))
    return "solver_of_mine:doubled"


PX = "frame_id string, y int, x int, dn array<double>, edn array<double>"


def px(spark, n=12):
    rng = np.random.default_rng(0)
    rows = [(f"f{i % 3}", i // 6, i % 6, [float(v) for v in rng.uniform(5, 500, 6)], [float(v) for v in rng.uniform(1, 9, 6)]) for i in range(n)]
    return spark.createDataFrame([*rows, ("f0", 9, 0, None, None), ("f0", 9, 1, [1.0] * 5, [1.0] * 6), ("f0", 9, 2, [1.0, None, 1.0, 1.0, 1.0, 1.0], [1.0] * 6)], PX)


def test_sql_equals_the_solver(spark):
    rows = px(spark)
    rows.createOrReplaceTempView("some_pixels")
    B.register_solver(spark, "solved_in_sql", C.default())
    by_sql = {(r["frame_id"], r["y"], r["x"]): r["s"] for r in spark.sql("SELECT frame_id, y, x, solved_in_sql(dn, edn) AS s FROM some_pixels").collect()}
    plain = {(r["frame_id"], r["y"], r["x"]): r for r in V.solve_dem(rows, C.default()).collect()}
    assert by_sql.keys() == plain.keys() and sum(r["valid"] for r in plain.values()) == 12
    for k, r in plain.items():
        assert by_sql[k]["valid"] == r["valid"] and all(np.allclose(by_sql[k][c], r[c], rtol=1e-9) for c in V.OUTPUTS)
    B.register_bins(spark, "bins_in_sql", C.default(), V.Options(batch=5))
    for given in ("TABLE(some_pixels)", "TABLE(some_pixels) PARTITION BY frame_id"):
        got = spark.sql(f"SELECT * FROM bins_in_sql({given})").collect()
        assert len(got) == 15 * 24
        for r in got:
            one = plain[r["frame_id"], r["y"], r["x"]]
            assert r["valid"] == one["valid"] and np.isclose(r["dem"], one["dem"][r["bin"]], rtol=1e-9) and r["logt"] == C.default().logt[r["bin"]]


def test_solvers_by_name(spark, mine):
    px(spark).createOrReplaceTempView("some_pixels")
    B.register_user_solver(spark, "doubled_in_sql", mine, "dem array<double>, many long")
    got = spark.sql("SELECT dn, doubled_in_sql(dn, edn) AS s FROM some_pixels").collect()
    assert sorted(r["s"]["many"] for r in got) == [0, 0, 5] + [6] * 12
    assert all(r["s"]["dem"] == [2 * v for v in r["dn"]] for r in got if r["s"]["many"] == 6)
    for wrong in ("nowhere", "json:nothing", ":x"):
        with pytest.raises(ValueError):
            B.register_user_solver(spark, "wrong", wrong, "a double")
    with pytest.raises(ImportError):
        B.named("no_such_module:f")


def test_pixels_are_numbered_in_order(spark):
    rows = px(spark, 60).repartition(5)
    got = S.indexed(rows).orderBy("index").select("frame_id", "y", "x", "index").collect()
    keys = sorted((r["frame_id"], r["y"], r["x"]) for r in rows.collect())
    assert [tuple(r)[:3] for r in got] == keys and [r["index"] for r in got] == list(range(63))
    some = S.evenly_spaced(S.indexed(rows), "index", None, 7).orderBy("index").collect()
    assert [r["index"] for r in some] == [k * 62 // 6 for k in range(7)]


def test_command_line_options(spark, tmp_path, capsys, mine):
    from bandloom import __main__ as M

    px(spark, 30).filter(F.size("dn") == 6).write.parquet(str(tmp_path / "px"))
    assert M.main(["solve", str(tmp_path / "px"), str(tmp_path / "one"), "--parquet", "--idx", "1"])["pixels"] == 10
    assert spark.read.parquet(str(tmp_path / "one/solution")).select("frame_id").distinct().collect() == [("f1",)]
    assert M.main(["solve", str(tmp_path / "px"), str(tmp_path / "few"), "--parquet", "--idx", "all", "--max-samples", "8"])["pixels"] == 8
    assert M.main(["solve", str(tmp_path / "px"), str(tmp_path / "own"), "--parquet", "--solver", mine, "--outputs", "dem array<double>"])["pixels"] == 31
    assert spark.read.parquet(str(tmp_path / "own/solution")).columns == ["y", "x", "dem", "frame_id"]
    with pytest.raises(IndexError):
        M.main(["solve", str(tmp_path / "px"), str(tmp_path / "none"), "--parquet", "--idx", "9"])
    capsys.readouterr()
