"""The stacks' data source: every layout, what filters leave, and what is read of a file."""

import numpy as np
import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from bandloom.sources import npz, stacks


def cube(h, w, seed=0):
    return np.random.default_rng(seed).integers(0, 1000, (6, h, w)).astype(float)


def pixels(frame):
    """(frame, y, x): values."""
    return {(r["frame_id"], r["y"], r["x"]): (tuple(r["dn"]), None if r["edn"] is None else tuple(r["edn"])) for r in frame.collect()}


def expected(name, a, edn=None):
    return {(name, y, x): (tuple(a[:, y, x]), None if edn is None else tuple(edn[:, y, x])) for y in range(a.shape[1]) for x in range(a.shape[2])}


LAYOUTS = {
    "chw": lambda a: a, "hwc": lambda a: np.ascontiguousarray(np.moveaxis(a, 0, -1)), "column": lambda a: np.asfortranarray(a),
    "columns last": lambda a: np.asfortranarray(np.moveaxis(a, 0, -1)), "short": lambda a: a.astype(np.uint16), "one frame": lambda a: a[None],
}


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_layouts(spark, tmp_path, layout, save):
    a = cube(9, 5)
    save(tmp_path / "a.npz", other=np.arange(3), bands=LAYOUTS[layout](a))
    found = stacks.read(spark, str(tmp_path), pixelsPerTask=10)
    assert pixels(found) == expected("a", a)
    cut = {k: v for k, v in expected("a", a).items() if 3 <= k[1] < 8 and k[2] in (1, 3)}
    assert pixels(stacks.read(spark, str(tmp_path), y=(3, 8), x=(1, 4), frames=["a"]).filter("x <> 2")) == cut
    for pushdown in (False, True):
        again = lambda: stacks.read(spark, str(tmp_path), pushdown=pushdown, pixelsPerTask=10)  # noqa: B023, E731
        assert pixels(again().filter("y >= 3 AND y < 8 AND x IN (1, 3)")) == cut
        assert pixels(again().filter("y > 2 AND y <= 7 AND (x = 1 OR x = 3) AND frame_id = 'a'")) == cut


def test_several_frames_uncertainties_and_flat_arrays(spark, tmp_path):
    a, b = cube(4, 3, 1), cube(4, 3, 2)
    np.savez(tmp_path / "two.npz", stack=np.stack([a, b]))
    np.savez_compressed(tmp_path / "both.npz", edn=b, dn=a)
    np.savez(tmp_path / "row.npz", dn=a, edn=np.arange(6.0))
    np.savez(tmp_path / "flat.npz", data=a.reshape(6, -1).T)
    np.save(tmp_path / "alone.npy", a)
    found = pixels(stacks.read(spark, str(tmp_path), pathGlobFilter="*.np[yz]"))
    ones = np.broadcast_to(np.arange(6.0)[:, None, None], a.shape)
    flat = {("flat", k, 0): (tuple(v), None) for k, v in enumerate(a.reshape(6, -1).T)}
    assert found == expected("two#0", a) | expected("two#1", b) | expected("both", a, b) | expected("row", a, ones) | flat | expected("alone", a)
    assert pixels(stacks.read(spark, str(tmp_path), pushdown=True).filter("frame_id IN ('two#1', 'none')")) == expected("two#1", b)
    assert pixels(stacks.read(spark, str(tmp_path / "two.npz"), unitEdn=True).filter("frame_id = 'two#0'")) == expected("two#0", a, np.ones(a.shape))
    assert stacks.read(spark, str(tmp_path / "nowhere")).count() == 0
    assert stacks.read(spark, str(tmp_path), pushdown=True).filter("y > 100").count() == 0


def test_what_cannot_be_read_is_an_error(spark, tmp_path):
    np.savez(tmp_path / "five.npz", bands=np.zeros((5, 4, 4)))
    with pytest.raises(Exception, match="bands"):
        stacks.read(spark, str(tmp_path)).count()
    np.savez(tmp_path / "five.npz", bands=np.array([{"a": 1}], dtype=object))
    with pytest.raises(Exception, match="no array"):
        stacks.read(spark, str(tmp_path)).count()


def test_filters_reach_the_source(spark, tmp_path):
    np.savez(tmp_path / "a.npz", bands=cube(64, 8))
    np.savez(tmp_path / "b.npz", bands=cube(64, 8, 3))
    kept = {k: v for k, v in expected("b", cube(64, 8, 3)).items() if k[1] >= 60 and k[2] < 2}
    cut = stacks.read(spark, str(tmp_path), pushdown=True, pixelsPerTask=64).filter("frame_id = 'b' AND y >= 60 AND x < 2")
    formatted = cut._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(frame_id)" in formatted and "GreaterThanOrEqual(y,60)" in formatted
    assert "Filter (" not in formatted  # Spark has nothing left to test
    assert cut.rdd.getNumPartitions() == 1 and pixels(cut) == kept
    found = stacks.read(spark, str(tmp_path), pixelsPerTask=64)
    assert found.rdd.getNumPartitions() == 16 and pixels(found.filter("frame_id = 'b' AND y >= 60 AND x < 2")) == kept


def test_a_frame_is_used_many_times(spark, tmp_path):
    a = cube(10, 4)
    np.savez(tmp_path / "a.npz", bands=a)
    found = stacks.read(spark, str(tmp_path))
    assert found.filter("y < 2").count() == 8 and found.count() == 40
    assert found.filter("y < 2").unionByName(found.filter("y > 7")).count() == 16
    assert found.alias("p").join(found.filter("y = 0").alias("q"), "x").count() == 40


class Counting:
    """A file that tells how much was read of it."""

    def __init__(self, path):
        self.f, self.n = open(path, "rb"), 0

    def read(self, n=-1):
        got = self.f.read(n)
        self.n += len(got)
        return got

    def __getattr__(self, name):
        return getattr(self.f, name)


def test_rows_far_down_are_read_alone(tmp_path):
    a = cube(2000, 50)
    np.savez(tmp_path / "a.npz", bands=a)
    f = Counting(tmp_path / "a.npz")
    array = stacks.chosen(stacks.arrays(f), None, 6)[0]
    assert f.n < 10_000  # of 4.8 MB, to plan
    assert np.array_equal(stacks.Rows(f, array, 6).get(0, 1990, 1995), np.moveaxis(a, 0, -1)[1990:1995])
    assert f.n < 10_000 + 5 * 50 * 6 * 8
    np.savez_compressed(tmp_path / "b.npz", bands=np.moveaxis(a, 0, -1).copy())
    f = Counting(tmp_path / "b.npz")
    array = stacks.chosen(stacks.arrays(f), None, 6)[0]
    before, size = f.n, (tmp_path / "b.npz").stat().st_size
    assert np.array_equal(stacks.Rows(f, array, 6).get(0, 0, 100), np.moveaxis(a, 0, -1)[:100])
    assert f.n - before < size / 4  # inflated up to the last row


def test_wanted():
    w = stacks.Wanted()
    assert w.take(D.EqualTo(("y",), 5)) == (stacks.Wanted(y=(5, 6)), True)
    assert w.take(D.In(("x",), (3, 9, None))) == (stacks.Wanted(x=(3, 10)), False)
    assert w.take(D.LessThan(("dn",), 5)) == (w, False) and w.take(D.Not(D.EqualTo(("y",), 5)))[1] is False
    assert w.take(D.EqualTo(("frame_id",), "a"))[0].take(D.In(("frame_id",), ("a", "b")))[0].frames == {"a"}


def test_stacks_written_from_arrow(spark, tmp_path):
    a, b = cube(30, 7, 5), cube(3, 4, 6)
    np.savez(tmp_path / "a.npz", bands=a)
    np.savez(tmp_path / "b.npz", bands=b)
    px = stacks.read(spark, str(tmp_path)).orderBy(F.rand(1))
    for kind, compressed in (("float64", True), ("uint16", False)):
        out = str(tmp_path / f"out-{kind}")
        made = npz.write_stacks(px, out, dtype=kind, compressed=compressed)
        assert {(r["frame_id"], r["written"]) for r in made.collect()} == {("a", True), ("b", True)}
        assert {(r["frame_id"], r["written"]) for r in made.collect()} == {("a", False), ("b", False)}
        with np.load(f"{out}/a.npz") as held:
            assert np.array_equal(held["bands"], a) and held["bands"].dtype == kind
        assert pixels(stacks.read(spark, out)) == expected("a", a) | expected("b", b)
