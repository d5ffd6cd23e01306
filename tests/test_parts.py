"""Readers, selectors, expressions on odd values, records, streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.functions import pixels as P
from bandloom.operators import calibration as C
from bandloom.operators import ingest as I
from bandloom.operators import selection as S
from bandloom.operators import summaries as Q
from bandloom.sources import npz, tables
from bandloom.streaming import assembly


def array(spark, values):
    return spark.createDataFrame([(values,)], "dn array<double>")


def test_odd_counts(spark):
    rows = array(spark, [math.nan, math.inf, -math.inf, -1.0, 0.0, 2.0, None])
    assert rows.select(P.sanitise(F.col("dn")).alias("v")).first()["v"] == [0, 0, 0, 0, 0, 2, 0]
    assert rows.select(P.golden_hygiene(F.col("dn")).alias("v")).first()["v"] == [1, 1, 1, 1, 1, 3, 1]
    unit = F.transform("dn", lambda v: F.lit(1.0))
    assert rows.select(P.valid(F.col("dn"), unit).alias("v")).first()["v"] is False
    assert array(spark, [1.0, 2.0]).select(P.valid(F.col("dn"), unit).alias("v")).first()["v"] is True
    assert array(spark, []).select(P.valid(F.col("dn"), unit).alias("v")).first()["v"] is False
    with pytest.raises(ValueError):
        P.error_model(F.col("dn"), "other")


def test_maps_of_ties_and_nothing(spark):
    rows = spark.createDataFrame([([0.0, 2.0, 2.0],), ([0.0, -1.0, math.nan],), ([1.0, 0.0, 1.0],)], "dem array<double>")
    logt = [5.0, 6.0, 7.0]
    got = rows.select(P.peak_logt(F.col("dem"), logt).alias("p"), P.median_logt(F.col("dem"), logt).alias("m"), P.std_logt(F.col("dem"), logt).alias("s"), P.total_em(F.col("dem")).alias("e")).collect()
    assert [r["p"] for r in got] == [6.0, None, 5.0]
    assert [r["m"] for r in got] == [6.0, None, 5.0]
    assert [r["s"] for r in got] == [0.5, None, 1.0]
    assert got[1]["e"] == 0


def test_sizes_and_selectors(spark):
    assert S.parse_size("256") == (256, 256) and S.parse_size(" 512 x 1024 ") == (512, 1024)
    assert S.parse_index("all") is None and S.parse_index("-1") is None and S.parse_index("3") == 3
    with pytest.raises(ValueError):
        S.parse_size("invalid")
    frames = S.numbered(spark.createDataFrame([("b",), ("a",), ("c",)], "frame_id string"))
    ids = lambda x: sorted(r["frame_id"] for r in S.select_frames(frames, x, 3).collect())
    assert ids(None) == ids(-1) == ["a", "b", "c"] and ids(-2) == ["b"] and ids(slice(0, 2)) == ["a", "b"]
    with pytest.raises(IndexError):
        ids(7)
    for n, most in ((10, 4), (7, 7), (100, 33), (5, 1), (1000, 999)):
        picked = sorted(r["id"] for r in S.evenly_spaced(spark.range(n), "id", n, most).collect())
        assert picked == sorted({k * (n - 1) // (most - 1) for k in range(most)} if most > 1 else {0})


def test_npz(spark, tmp_path):
    (tmp_path / "np").mkdir()
    a, b = npz.test_frame(8), np.abs(npz.test_frame(8, seed=1))
    npz.write_frame(str(tmp_path / "np/20250101_00_00_12.npz"), a, wavelengths=np.array([94, 131, 171, 193, 211, 335]), ts_utc="2025-01-01T00:00:12", quant_meta_json={"bits": 8, "strategy": "p99", "scale_per_band": [1.0], "offset_per_band": [0.0]})
    np.savez(str(tmp_path / "np/b.npz"), dn=np.moveaxis(b, 0, -1), edn=np.moveaxis(b, 0, -1) + 1)
    px = npz.read_pixels(spark, str(tmp_path / "np"))
    assert px.count() == 128 and px.filter("frame_id = 'b' AND edn IS NOT NULL").count() == 64
    row = px.filter("frame_id = '20250101_00_00_12' AND y = 3 AND x = 5").first()
    np.testing.assert_allclose(row["dn"], a[:, 3, 5])
    assert npz.read_pixels(spark, str(tmp_path / "np"), crop=(2, 3)).count() == 12
    with pytest.raises(Exception, match="a crop of"):
        npz.read_pixels(spark, str(tmp_path / "np"), crop=(9, 9)).count()
    frame = npz.with_quantisation(npz.read_frames(spark, str(tmp_path / "np"))).orderBy("frame_id").first()
    assert (frame["height"], frame["width"], frame["n_bands"]) == (8, 8, 6) and frame["quant"]["bits"] == 8 and frame["wavelengths"][0] == 94
    assert npz.listing(spark, str(tmp_path / "nowhere")).count() == 0
    assert S.check_one_shape(px) == (8, 8)
    np.savez(str(tmp_path / "np/bad.npz"), bands=np.zeros((3, 4, 4)))
    with pytest.raises(Exception, match="bands"):
        npz.read_pixels(spark, str(tmp_path / "np")).count()
    assert npz.read_pixels(spark, str(tmp_path / "np"), tolerant=True).count() == 128
    tables.write_pixels(px, str(tmp_path / "px"))
    assert spark.read.parquet(str(tmp_path / "px")).filter("frame_id = 'b'").count() == 64
    files = npz.listing(spark, str(tmp_path / "np"))
    made = tables.build_manifest(files).collect()
    assert [r["filepath"] for r in made] == sorted(r["filepath"] for r in made)
    expected = spark.createDataFrame([(r["filepath"], r["hash_sha256"].upper()) for r in made] + [("gone", "00")], "filepath string, hash_sha256 string")
    assert sorted(r["ok"] for r in tables.verify_hashes(files, expected).collect()) == [False, True, True, True]


def test_layouts():
    for shape, kind in (((6, 4, 5), "CHW"), ((4, 5, 6), "HWC"), ((2, 6, 4, 5), "FCHW"), ((2, 4, 5, 6), "FHWC"), ((9, 6), "NC"), ((64, 64), None), ((64, 64, 3), None)):
        assert npz.layouts(shape, 6) == kind
    assert npz.to_frames(np.zeros((6, 4, 5))).shape == (1, 4, 5, 6)
    with pytest.raises(ValueError):
        npz.to_frames(np.zeros((64, 64)))


def test_records(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("BANDLOOM_RUN_DIR", raising=False)
    made = tables.run_dir(str(tmp_path), "baseline", "tag")
    assert made.parent.name == "baseline" and made.name.endswith("_tag")
    monkeypatch.setenv("BANDLOOM_RUN_DIR", str(made))
    with pytest.raises(FileExistsError):
        tables.run_dir(str(tmp_path), "baseline")
    rows = spark.createDataFrame([("a", 1, 2.0)], "stamp string, frames int, seconds double")
    for _ in range(2):
        tables.append_rows(rows, str(tmp_path / "bench"))
    assert spark.read.csv(str(tmp_path / "bench"), header=True).count() == 2
    solution = spark.createDataFrame([("f", 0, 0, [1.0], 2.0)], "frame_id string, y int, x int, dem array<double>, chisq double")
    tables.write_solution(solution, str(tmp_path / "run"), meta={"nt": 1})
    assert tables.read_solution(spark, str(tmp_path / "run")).first()["dem"] == [1.0] and tables.read_meta(spark, str(tmp_path / "run")) == {"nt": 1}
    both = tables.union_rows([rows, rows.withColumn("tile", F.lit(3))])
    assert sorted(r["tile"] or 0 for r in both.collect()) == [0, 3]
    tables.write_atomic(str(tmp_path / "card.md"), tables.run_card("Run", {"nt": 24}))
    assert "| nt | 24 |" in (tmp_path / "card.md").read_text()
    assert tables.names_digest(["b", "a"]) == tables.names_digest(["a", "b"])


def test_summaries(spark):
    dem = [[1.0] * 4] * 7 + [[1.0, 1.0, 1.0, math.nan]]
    checks = Q.basic_checks(spark.createDataFrame([(v[:1], 1.0) for v in dem[:7]] + [([math.nan], 2.0)], "dem array<double>, chisq double")).first()
    assert checks["finite_frac"] == checks["positive_frac"] == 7 / 8 and checks["chisq_median"] == 1.0
    a = spark.createDataFrame([(0, 1.0), (1, math.nan), (2, 3.0)], "k int, value double")
    b = spark.createDataFrame([(0, 1.0), (1, math.nan), (3, 3.0)], "k int, value double")
    r = Q.compare(a, b, ["k"]).first()
    assert (r["n"], r["n_one_sided"], r["all_close"], r["within"]) == (4, 2, False, 0.5)
    assert Q.compare(a, a, ["k"]).first()["all_close"] is True
    ranks = Q.nearest_rank(spark.createDataFrame([("g", float(i)) for i in range(37)], "g string, v double"), ["g"], "v").first()
    assert (ranks["p50"], ranks["p95"], ranks["count"]) == (18.0, 34.0, 37)
    assert abs(Q.student_less(-1.6880, 45.818) - 0.04911) < 1e-4 and abs(Q.student_less(-3.7608, 45.199) - 0.0002424) < 1e-6
    assert abs(Q.student_less(0, 9) - 0.5) < 1e-12


def test_slices_and_buckets(spark):
    span = spark.sql("SELECT timestamp'2025-01-01 00:00:00' AS start, timestamp'2025-01-01 00:25:00' AS stop UNION ALL SELECT timestamp'2025-01-02', timestamp'2025-01-02'")
    got = I.time_slices(span, 10).orderBy("t0").collect()
    assert len(got) == 3 and str(got[-1]["t1"]) == "2025-01-01 00:25:00"
    row = spark.sql("SELECT timestamp'2025-01-01 23:59:59.9' AS timestamp_utc")
    assert I.bucketed(row, 12).first()["bucket"] == "23_59_48" and I.bucketed(row, 7).first()["d8"] == "20250101"
    scales = I.quantise_scales(spark.createDataFrame([(0, -1.0), (1, 10.0)], "band int, v double"), "band", "v", 8, "max")
    assert {r["band"]: r["scale"] for r in scales.collect()} == {0: 1 / 255, 1: 10 / 255}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = "timestamp_utc,bucket_12s,wavelength,filepath,filesize_bytes,hash_md5,exptime,naxis1,naxis2\n"
    lines = [f"2025-01-01T00:00:0{s}.000Z,,{w},f{s}_{w},,,,," for s in (1, 3) for w in (94, 131)] + ["2025-01-01T00:00:25.000Z,,94,lone,,,,,", "2025-01-01T01:00:00.000Z,,94,late,,,,,"]
    (tmp_path / "in/a.csv").write_text(head + "\n".join(lines) + "\n")
    sets = assembly.complete_bandsets(assembly.manifest_stream(spark, str(tmp_path / "in")), [94, 131])
    q = sets.writeStream.format("memory").queryName("sets").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("sets").collect()
    assert [(r["w94"], r["w131"]) for r in got] == [("f1_94", "f1_131")]

    spark.createDataFrame([("f", 0, 0, [5.0] * 6, [2.0] * 6)], "frame_id string, y int, x int, dn array<double>, edn array<double>").write.parquet(str(tmp_path / "px"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "px")).schema).parquet(str(tmp_path / "px"))
    out = str(tmp_path / "out")
    assembly.solve_stream(stream, C.default(8), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(f"{out}/0").first()["valid"] is True


def test_fits(spark, tmp_path):
    from bandloom.sources import fits

    (tmp_path / "raw/deep").mkdir(parents=True)
    rng = np.random.default_rng(4)
    images = {}
    for w, shape in ((94, (5, 6)), (131, (4, 7))):
        images[w] = rng.uniform(0, 9, shape)
        fits.write(str(tmp_path / f"raw/deep/{w}.fits"), images[w], wavelnth=w, exptime=2.5, date_obs="2025-01-01T00:00:13")
    (tmp_path / "raw/bad.fits").write_bytes(b"nothing")
    rows = fits.catalogue(spark, str(tmp_path / "raw")).collect()
    assert sorted((r["wavelength"], r["naxis1"], r["naxis2"], r["exptime"], str(r["timestamp_utc"])) for r in rows) == [(94, 6, 5, 2.5, "2025-01-01 00:00:13"), (131, 7, 4, 2.5, "2025-01-01 00:00:13")]
    with pytest.raises(Exception, match="header"):
        fits.catalogue(spark, str(tmp_path / "raw"), tolerant=False).count()
    sets = I.pivoted(I.first_per_band(I.bucketed(fits.catalogue(spark, str(tmp_path / "raw")))), [131, 94])
    px = {(r["y"], r["x"]): r for r in fits.pixels_of_sets(spark, str(tmp_path / "raw"), sets, [131, 94]).collect()}
    assert len(px) == 4 * 6 and px[0, 0]["frame_id"] == "20250101_00_00_12"
    np.testing.assert_allclose(px[3, 5]["dn"], [images[131][3, 5], images[94][3, 5]])
    gone = sets.withColumn("w94", F.lit("nowhere"))
    assert fits.pixels_of_sets(spark, str(tmp_path / "raw"), gone, [131, 94], tolerant=True).count() == 0
    with pytest.raises(Exception, match="lacks a file"):
        fits.pixels_of_sets(spark, str(tmp_path / "raw"), gone, [131, 94]).count()
    assert fits.value("'it''s'  / c") == "it's" and fits.value("1.5D3 / c") == 1500.0 and fits.value("T") is True


def test_command_line(spark, tmp_path, capsys):
    from bandloom import runtime
    from bandloom.__main__ import main

    (tmp_path / "np").mkdir()
    npz.write_frame(str(tmp_path / "np/a.npz"), np.abs(npz.test_frame(8)) * 100 + 1)
    made = main(["solve", str(tmp_path / "np"), str(tmp_path / "one"), "--nt", "8", "--crop", "4x5"])
    assert made == {"pixels": 20, "valid": 20}
    main(["solve", str(tmp_path / "np"), str(tmp_path / "two"), "--nt", "8", "--crop", "4x5"])
    told = main(["compare", str(tmp_path / "one"), str(tmp_path / "two"), "--report", str(tmp_path / "card")])
    assert told["passed"] is True and sorted(told["arrays"]) == ["chisq", "dem", "dn_reg", "edem"]
    assert "PASS dem: 160 values" in (tmp_path / "card.txt").read_text() and (tmp_path / "card.json").exists()
    np.savez(str(tmp_path / "cal.npz"), tresp=C.sampled(nt=9)[0], tresp_logt=C.sampled(nt=9)[1], temps=C.sampled(nt=9)[2])
    main(["solve", str(tmp_path / "np"), str(tmp_path / "own"), "--crop", "4x5", "--calibration", str(tmp_path / "cal.npz")])
    assert tables.read_meta(spark, str(tmp_path / "own"))["nt"] == 9
    assert main(["compare", str(tmp_path / "own"), str(tmp_path / "one")])["passed"] is False
    golden = main(["golden", str(tmp_path / "np"), str(tmp_path / "gold"), "--size", "4", "--nt", "8"])
    assert golden["pixels"] == 16 and golden["fallback"] is False and golden["em_mean"] > 0
    assert len(tables.read_meta(spark, str(tmp_path / "gold"))["r_scale"]) == 6
    assert any(x["worker"] == "driver" and x["done_tasks"] > 0 for x in main(["workers"])["workers"])
    main(["maps", str(tmp_path / "one"), str(tmp_path / "maps")])
    assert spark.read.parquet(str(tmp_path / "maps")).filter("median IS NOT NULL").count() == 20
    sections = runtime.Sections(spark)
    with sections("a"):
        spark.range(3).count()
    with pytest.raises(ZeroDivisionError), sections("b"):
        1 / 0  # noqa: B018
    assert [r["status"] for r in sections.frame().collect()] == ["ok", "failed"]
    assert runtime.time_query(spark, lambda: spark.range(5), 2).count() == 2


def test_calibration_files(spark, tmp_path):
    tresp, logt, temps = C.sampled(nt=7)
    (tmp_path / "cal").mkdir()
    for name, value in (("tresp", tresp), ("tresp_logt", logt)):
        np.save(str(tmp_path / f"cal/{name}.npy"), value)
    np.savez(str(tmp_path / "rest.npz"), TEMPS=np.log10(temps))
    got = npz.read_calibration(spark, str(tmp_path / "cal"), str(tmp_path / "rest.npz"))
    for a, b in zip(got, (tresp, logt, temps), strict=True):
        np.testing.assert_allclose(a, b)
    made = C.complete(None, None, None)
    assert made[0].shape == (50, 6) and len(made[2]) == 51
    np.testing.assert_allclose(made[0].sum(axis=0), 1, rtol=1e-9)
    assert C.synthetic(np.array([6.0])).shape == (1, 6)
    uneven = np.array([5.5, 5.9, 6.0, 7.0])
    np.testing.assert_allclose(C.synthetic(uneven, normalize="none"), C.synthetic(uneven, normalize="none", include_jacobian=False) * 0.5)
    for bad in ((np.zeros((3, 5)), np.arange(3.0), np.array([1e5, 1e6])), (tresp * np.nan, logt, temps), (-tresp, logt, temps), (tresp, logt[::-1], temps)):
        with pytest.raises(ValueError):
            C.complete(*bad)


def test_stacks_and_headers(spark, tmp_path):
    rng = np.random.default_rng(2)
    frames = rng.uniform(0, 9, (2, 6, 4, 5))
    (tmp_path / "np").mkdir()
    np.savez(str(tmp_path / "np/two.npz"), stack=frames)
    found = npz.read_frames(spark, str(tmp_path / "np")).orderBy("frame_id").collect()
    assert [(x["frame_id"], x["height"], x["width"], x["has_calibration"]) for x in found] == [("two#0", 4, 5, False), ("two#1", 4, 5, False)]
    px = npz.read_pixels(spark, str(tmp_path / "np"), unit_edn=True)
    assert px.first()["edn"] == [1.0] * 6
    first = npz.write_stacks(px, str(tmp_path / "out")).collect()
    again = npz.write_stacks(px, str(tmp_path / "out")).collect()
    assert [x["written"] for x in first] == [True] * 2 and [x["written"] for x in again] == [False] * 2
    np.testing.assert_allclose(np.load(str(tmp_path / "out/two#1.npz"))["bands"], frames[1])


def test_inputs(spark):
    rows = spark.createDataFrame([([1.0, -1.0],), ([0.0, 0.0],), ([math.nan, 2.0],)], "dn array<double>")
    assert S.check_inputs(rows, 2) == ["1 values aren't finite and become 0", "1 values are negative and become 0", "1 pixels are 0 in all bands"]
    with pytest.raises(ValueError, match="bands"):
        S.check_inputs(rows, 3)
    with pytest.raises(ValueError, match="all counts"):
        S.check_inputs(rows.filter("dn[0] = 0"), 2)
    assert S.check_inputs(rows.limit(0), 2) == []


def test_golden_falls_back_to_least_squares(spark):
    from bandloom.operators import golden, inversion

    px = spark.createDataFrame([("f", 0, x, [float(x + k) for k in range(6)]) for x in range(4)], "frame_id string, y int, x int, dn array<double>")
    cal = C.Calibration(np.full((5, 6), 0.0), np.linspace(5.5, 7.5, 5), np.full(5, 0.5))
    solution, facts = golden.make_golden(px, cal, inversion.Options())
    assert facts["fallback"] and solution.count() == 4 and facts["r_scale"] == [2.5 + k for k in range(6)]


def test_one_pass_solves_writes_and_reports(spark, tmp_path):
    from bandloom.operators import golden, inversion

    rng = np.random.default_rng(3)
    px = spark.createDataFrame([(f"f{x % 2}", 0, x, [float(v) for v in rng.uniform(1, 900, 6)]) for x in range(30)], "frame_id string, y int, x int, dn array<double>").cache()
    px.count()
    store = spark._jsparkSession.sharedState().statusStore()

    def plans() -> dict[int, str]:
        held = store.executionsList()
        return {x.executionId(): x.physicalPlanDescription() for x in map(held.apply, range(held.size()))}

    before = max(plans())
    solution, facts = golden.make_golden(px, C.default(), inversion.Options(), out=str(tmp_path / "golden"))
    assert sum("MapInArrow" in x for k, x in plans().items() if k > before) == 1  # one solve
    again = Q.frame_summary(solution).agg(F.sum("n_pixels"), F.sum("n_valid"), F.min("dem_min"), F.max("dem_max")).first()
    assert tuple(again) == (facts["n_pixels"], facts["n_valid"], facts["dem_min"], facts["dem_max"]) and facts["n_pixels"] == 30
    assert facts["chisq_mean"] == pytest.approx(solution.agg(F.avg("chisq")).first()[0]) and tables.read_meta(spark, str(tmp_path / "golden"), "figures")["n_valid"] == facts["n_valid"]
    empty, facts = golden.make_golden(px.limit(0), C.default(), inversion.Options())
    assert empty.count() == 0 and facts["fallback"]


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_quantiles_of_large_and_small_groups(spark, share):
    rng = np.random.default_rng(5)
    values = {"big": np.round(rng.lognormal(0, 2, 60_000), 3), "ties": np.repeat([1.0, 2.0, 3.0], 20_000), "small": rng.normal(size=7), "one": np.array([4.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x] + [("big", None), ("none", None), (None, 1.0)], "g string, v double").repartition(4)
    got = {x["g"]: x["q"] for x in Q.quantile(rows, ["g"], "v", share, "q").collect()}
    assert set(got) == {*values, None}
    for k, x in values.items():
        assert got[k] == pytest.approx(float(np.quantile(x, share)), rel=1e-12)
    near = {x["g"]: x["q"] for x in Q.quantile(rows, ["g"], "v", share, "q", nearest=True).collect()}
    for k, x in values.items():
        assert near[k] == np.sort(x)[round(share * (len(x) - 1))]
    whole = Q.quantile(rows, [], "v", share, "q").first()["q"]
    assert whole == pytest.approx(float(np.quantile(np.concatenate([*values.values(), [1.0]]), share)), rel=1e-12)
    assert Q.quantile(rows.limit(0), ["g"], "v", share, "q").count() == 0


def test_crops_while_decoding(spark, tmp_path):
    import io

    rng = np.random.default_rng(7)
    for shape in ((6, 5, 4), (5, 4, 6), (3, 6, 5, 4), (3, 5, 4, 6)):
        a = rng.uniform(0, 9, shape).astype(np.float32)
        for save in (np.savez, np.savez_compressed):
            held = io.BytesIO()
            save(held, stack=a, other=np.zeros(3))
            np.testing.assert_array_equal(npz.cropped(held.getvalue(), "stack", 6, (3, 2)), npz.to_frames(a)[:, :3, :2])
            with pytest.raises(ValueError, match="crop"):
                npz.cropped(held.getvalue(), "stack", 6, (6, 2))
    held = io.BytesIO()
    np.savez(held, stack=np.asfortranarray(np.zeros((6, 5, 4))))
    assert npz.cropped(held.getvalue(), "stack", 6, (1, 1)) is None
    import zipfile

    with zipfile.ZipFile(str(tmp_path / "a.zip"), "w") as z:
        z.writestr("x/one.npz", b"1")
    with pytest.raises(Exception, match="digest"):
        npz.unpack(spark, str(tmp_path), str(tmp_path / "flat"), "00").count()
    assert npz.unpack(spark, str(tmp_path), str(tmp_path / "flat")).first()["name"] == "one.npz" and (tmp_path / "flat/one.npz").read_bytes() == b"1"


def test_quantiles_of_many_shares_and_empty_groups(spark, monkeypatch):
    rng = np.random.default_rng(9)
    values = {"big": np.round(rng.lognormal(0, 2, 50_000), 3), "few": rng.normal(size=9), "ties": np.repeat([1.0, 5.0], 15_000)}
    rows = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x] + [("none", None)] * 3, "g string, v double").repartition(4)
    shares = {"a": 0.01, "b": 0.5, "c": 0.5003, "d": 0.999}
    for few in (10_000, 2):  # bounds broadcast, or joined
        monkeypatch.setattr(Q, "FEW_GROUPS", few)
        got = {r["g"]: r for r in Q.quantiles(rows, ["g"], "v", shares, also={"most": F.max("v"), "n": F.count("v")}, empty=True).collect()}
        assert set(got) == {*values, "none"} and tuple(got["none"])[1:] == (None, None, None, None, None, 0)
        for k, x in values.items():
            assert [got[k][n] for n in shares] == pytest.approx([float(np.quantile(x, p)) for p in shares.values()], rel=1e-12) and got[k]["most"] == x.max()
    monkeypatch.setattr(Q, "FEW_GROUPS", 10_000)
    plan = Q.quantiles(rows, ["g"], "v", shares, True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    slow = Q.wallclock(rows.withColumnRenamed("v", "s"), ["g"], "s")
    assert {r["g"]: r["n"] for r in slow.collect()} == {"big": 50_000, "few": 9, "ties": 30_000, "none": 0}


def test_infinite_counts_are_not_quantised(spark):
    rows = spark.createDataFrame([(1, v) for v in (float("inf"), float("nan"), -1.0, None, 4.0)], "band int, v double")
    for strategy in ("p99", "max"):
        scales = I.quantise_scales(rows, "band", "v", 8, strategy)
        assert sorted(r["q"] for r in I.quantise(rows, scales, "band", "v", 8).collect())[:4] == [0, 0, 0, 0]


def test_order_lines_are_added_in_the_tables_order(spark, tmp_path):
    from bandloom.plans import views

    tax = [0.07, 0.06, 0.01, 0.03, 0.08, 0.02, 0.05]
    plain = 0.0
    for v in tax:
        plain += 100 * v
    parts = [spark.createDataFrame([(k, 1, 1.0, 1.0, 0.0, v) for k in range(40)], "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double").coalesce(1) for v in tax]
    one = parts[0]
    for p in parts[1:]:
        one = one.unionByName(p)
    one.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # rows of a line in many tasks
    try:
        rows = views.pxline(spark, str(tmp_path), in_order=True)
        assert {r["dn"][3] for r in rows.collect()} == {plain} and rows.count() == 40
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "collect_list" not in plan
        assert {r["dn"][4] for r in rows.collect()} == {7.0} and {r["dn"][0] for r in views.pxline(spark, str(tmp_path)).collect()} == {7.0}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
