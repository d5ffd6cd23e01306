"""Calibrations of many instruments against NumPy for each, and files that tasks write."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom import runtime
from bandloom.operators import calibration as C
from bandloom.operators import instruments as N
from bandloom.sources import fits, npz

RANGES = {"a": (5.5, 7.5), "b": (5.2, 7.9)}


@pytest.fixture(scope="module")
def own(spark):
    return spark.createDataFrame([(k, lo, hi, 0.2) for k, (lo, hi) in RANGES.items()], "name string, lo double, hi double, width double")


def matrix(rows, name, nt, nf=6):
    out = np.full((nt, nf), np.nan)
    for r in rows:
        if r["name"] == name:
            out[r["bin"], r["band"]] = r["value"]
    return out


@pytest.mark.parametrize("normalize,jacobian", [("none", False), ("l1", True), ("colmax", False), ("l1", False)])
def test_responses_of_each(own, normalize, jacobian):
    got = N.responses(N.grids(own, 13), ["name"], normalize=normalize, include_jacobian=jacobian).collect()
    for name, (lo, hi) in RANGES.items():
        assert np.allclose(matrix(got, name, 13), C.synthetic(C.grid(13, lo, hi), 6, 0.2, normalize, jacobian), rtol=1e-9)


def test_grids_of_each(own):
    for name, (lo, hi) in RANGES.items():
        rows = N.grids(own, 9).filter(F.col("name") == name).orderBy("bin").collect()
        e = C.edges(C.grid(9, lo, hi))
        assert np.allclose([r["logt"] for r in rows], C.grid(9, lo, hi)) and np.allclose([r["edge_lo"] for r in rows], e[:-1]) and np.allclose([r["temp_hi"] for r in rows], 10 ** e[1:])
    assert N.grids(own, 1).select("logt", "edge_lo").first()["edge_lo"] == pytest.approx(5.45)
    with pytest.raises(ValueError, match="normalisation"):
        N.responses(N.grids(own, 3), ["name"], normalize="l7")


@pytest.mark.parametrize("nt,n_tresp", [(24, 200), (40, 12), (1, 30)])
def test_prepared_and_binned_of_each(own, nt, n_tresp):
    taken = N.samples(own, n_tresp)
    made, binned = N.prepared(own, taken, ["name"], nt).collect(), N.binned(taken, N.equal_bins(own, ["name"], nt), ["name"]).collect()
    for name, (lo, hi) in RANGES.items():
        assert np.allclose(matrix(made, name, nt), C.prepare(*C.sampled(6, lo, hi, n_tresp, nt)).rmatrix, rtol=1e-8)
        assert np.allclose(np.maximum(matrix(binned, name, nt), 1e-30), C.binned(nt, 6, n_tresp, lo, hi, include_jacobian=False)[0], rtol=1e-8, atol=1e-28)
        assert sum(r["n"] for r in binned if r["name"] == name) == n_tresp * 6


def test_tables_of_samples_are_not_broadcast(own):
    taken, bins = N.samples(own), N.equal_bins(own, ["name"], 23)
    at = bins.selectExpr("name", "bin", "centre AS x")
    for frame, hot in ((N.binned(taken, bins, ["name"]), 2), (N.interpolated(taken, at, ["name"]), 0), (N.prepared(own, taken, ["name"]), 0)):
        assert frame._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == hot


def test_the_double_width_and_legacy(own):
    taken = N.samples(own)
    double = N.prepared(own, taken, ["name"], 24, 2).collect()
    assert np.allclose(matrix(double, "a", 24), C.double_jacobian().rmatrix, rtol=1e-8)
    assert np.allclose(matrix(N.legacy(N.grids(own, 24)).collect(), "a", 24), C.legacy(C.grid(24)), rtol=1e-9)


def test_bins_for_steps(spark):
    steps = [None, 0, 1, 13, 15, 40, 42, 106, 107, 108, 500]
    got = spark.createDataFrame([(v,) for v in steps], "n int").select("n", N.bins_for(F.col("n")).alias("b")).collect()
    assert {r["n"]: r["b"] for r in got} == {v: C.bins_for(v) for v in steps}


def test_calibrations_through_files(spark, own, tmp_path):
    taken = N.samples(own, 20)
    npz.write_calibrations(taken, str(tmp_path / "c")).count()
    back = npz.read_calibrations(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, taken.select("name", "i", "band", "logt", "value").collect()))
    np.savez(tmp_path / "c/wrong.npz", other=np.zeros(3))
    with pytest.raises(Exception, match="lacks"):
        npz.read_calibrations(spark, str(tmp_path / "c")).count()


def zipped(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/") + ".npz", body)


def test_names_that_come_twice(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("x/one.npz", b"first")
        z.writestr("y/one.npz", b"second")
        z.writestr("y/two.npz", b"2")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.zip").write_bytes(held.getvalue())
    got = npz.unpack(spark, str(tmp_path / "in"), str(tmp_path / "flat")).collect()
    assert sorted(map(tuple, got)) == [("one.npz", 5), ("two.npz", 1)] and (tmp_path / "flat/one.npz").read_bytes() == b"first"
    zipped(tmp_path / "in/b.zip", z__two=b"other")
    with pytest.raises(ValueError, match="two archives have a two.npz"):
        npz.unpack(spark, str(tmp_path / "in"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_files_appear_whole(tmp_path, monkeypatch):
    runtime.put(str(tmp_path / "deep/a.bin"), b"abc")
    assert (tmp_path / "deep/a.bin").read_bytes() == b"abc" and len(list((tmp_path / "deep").iterdir())) == 1


def test_images_written_by_tasks(spark, tmp_path):
    rng = np.random.default_rng(1)
    images = {("p/a", 94): rng.uniform(size=(7, 4)), ("p/a", 131): rng.uniform(size=(5, 6)), ("b", 94): rng.uniform(size=(1, 1))}
    rows = [(n, w, "2025-01-01T00:00:13", y, x, float(a[y, x])) for (n, w), a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    frame = spark.createDataFrame(rows, "name string, wavelength int, date_obs string, y int, x int, value double").orderBy(F.rand(2))
    assert fits.write_images(frame, str(tmp_path), exptime=2.0).count() == 3
    for (n, w), a in images.items():
        cards, found = fits.image((tmp_path / f"{n}_{w}.fits").read_bytes())
        assert np.array_equal(found, a) and cards["WAVELNTH"] == w and cards["EXPTIME"] == 2.0 and cards["DATE-OBS"].startswith("2025")
