"""``python -m bandloom``: solve frames, make maps, compare solutions, time a query."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import runtime
from .functions import pixels as P
from .operators import calibration as C
from .operators import golden as G
from .operators import inversion as V
from .operators import selection as S
from .operators import sql_functions as B
from .operators import summaries as Q
from .plans import catalogue
from .sources import npz, tables


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="bandloom")
    sub = top.add_subparsers(dest="what", required=True)
    solve = sub.add_parser("solve", help="NPZ stacks or pixels in Parquet to a solution")
    solve.add_argument("source")
    solve.add_argument("out")
    solve.add_argument("--parquet", action="store_true", help="the source has pixels in Parquet")
    solve.add_argument("--crop", type=S.parse_size)
    solve.add_argument("--unit-edn", action="store_true", help="uncertainties of one where a file has none")
    solve.add_argument("--idx", type=S.parse_index, help="all or -1, or the number of one frame in the order of their names")
    solve.add_argument("--max-samples", type=int, help="so many pixels at most, evenly spaced in the order of frame, row and column")
    solve.add_argument("--solver", help="module:function of a solver of your own, of counts and uncertainties")
    solve.add_argument("--outputs", default="dem array<double>", help="what that solver returns")
    golden = sub.add_parser("golden", help="a golden solution: counts raised, responses scaled to them, solved, and least squares where that finds nothing")
    golden.add_argument("source")
    golden.add_argument("out")
    golden.add_argument("--size", type=int, help="a square at the centre of each frame")
    for one in (solve, golden):
        one.add_argument("--calibration", nargs="*", default=[], help="NPZ files or folders of NPY files with responses, log T and edges")
        one.add_argument("--nt", type=int, default=24)
        one.add_argument("--nmu", type=int, default=42)
        one.add_argument("--error-model", choices=P.ERROR_MODELS, default="poisson")
        one.add_argument("--error-a", type=float, default=1.0)
        one.add_argument("--error-b", type=float, default=1.0)
        for flag in ("gloci", "non-pos", "l-emd", "rscl", "emd-int", "emd-ret"):
            one.add_argument(f"--{flag}", action="store_true")
    maps = sub.add_parser("maps", help="temperature maps of a solution")
    maps.add_argument("solution")
    maps.add_argument("out")
    compare = sub.add_parser("compare", help="a solution against a golden one")
    compare.add_argument("solution")
    compare.add_argument("golden")
    compare.add_argument("--rtol", type=float, default=1e-4)
    compare.add_argument("--atol", type=float, default=1e-6)
    compare.add_argument("--report", help="where the report goes, as text and as JSON beside it")
    workers = sub.add_parser("workers", help="what the session's executors have done")
    workers.add_argument("--json", action="store_true")
    bench = sub.add_parser("bench", help="time a registered query")
    bench.add_argument("query", choices=sorted(catalogue.QUERIES))
    bench.add_argument("data")
    bench.add_argument("--repeats", type=int, default=3)
    return top


def options_of(a: argparse.Namespace) -> V.Options:
    return V.Options(nmu=a.nmu, gloci=a.gloci, non_pos=a.non_pos, l_emd=a.l_emd, rscl=a.rscl, emd_int=a.emd_int, emd_ret=a.emd_ret)


def calibration_of(spark: SparkSession, a: argparse.Namespace) -> C.Calibration:
    """The responses of the given files, or the synthetic ones for ``--nt`` bins."""
    return C.prepare(*(npz.read_calibration(spark, *a.calibration) if a.calibration else C.sampled(nt=a.nt)), emd_int=a.emd_int)


def main(argv: list[str] | None = None) -> dict:
    a = parser().parse_args(argv)
    spark = runtime.session()
    if a.what == "solve":
        px = spark.read.parquet(a.source) if a.parquet else npz.read_pixels(spark, a.source, crop=a.crop, unit_edn=a.unit_edn)
        if a.parquet and a.crop:
            px = S.crop_top_left(px, *a.crop)
        if a.idx is not None:
            frames = px.select("frame_id").distinct()
            px = px.join(S.select_frames(S.numbered(frames), a.idx, frames.count()).select("frame_id"), "frame_id", "left_semi")
        if a.max_samples:
            px = S.evenly_spaced(S.indexed(px, "__index"), "__index", None, a.max_samples).drop("__index")
        px = px.withColumn("dn", P.sanitise(F.col("dn")))
        made = P.error_model(F.col("dn"), a.error_model, a.error_a, a.error_b)
        px = px.withColumn("edn", F.coalesce("edn", made) if "edn" in px.columns else made)
        options, cal = options_of(a), calibration_of(spark, a)
        facts = {"nt": len(cal.logt), "nmu": options.steps, "logt": [float(v) for v in cal.logt], **runtime.environment(spark)}
        px = px.select("frame_id", "y", "x", "dn", "edn")
        if a.solver:
            where = a.solver
            B.named(where)  # an error here rather than in a task
            solution = V.solve_with(px, lambda dn, edn: B.named(where)(dn, edn), a.outputs)
        else:
            solution = V.solve_dem(px, cal, options)
        figures = tables.write_solution(solution, a.out, meta=facts)
        out = {"pixels": figures.get("n_pixels"), "valid": figures.get("n_valid")}
    elif a.what == "golden":
        px = npz.read_pixels(spark, a.source)
        if a.size:
            px = S.crop_centre(px, *S.check_one_shape(px), a.size)
        _, facts = G.make_golden(px, calibration_of(spark, a), options_of(a), a.error_model, a.error_a, a.error_b, a.out, runtime.environment(spark))
        out = {"pixels": facts["n_pixels"], "em_mean": facts["em_mean"], "chisq_mean": facts["chisq_mean"], "fallback": facts["fallback"]}
    elif a.what == "maps":
        logt = tables.read_meta(spark, a.solution)["logt"]
        dem = F.col("dem")
        rows = tables.read_solution(spark, a.solution).select("frame_id", "y", "x", P.total_em(dem).alias("em"), P.peak_logt(dem, logt).alias("peak"), P.mean_logt(dem, logt).alias("mean"), P.median_logt(dem, logt).alias("median"), P.std_logt(dem, logt).alias("std"))
        rows.write.partitionBy("frame_id").parquet(a.out)
        out = {"written": a.out}
    elif a.what == "compare":
        made = Q.compare_solutions(tables.read_solution(spark, a.solution), tables.read_solution(spark, a.golden), rtol=a.rtol, atol=a.atol)
        rows = [x.asDict() for x in made.collect()]
        out = {"passed": all(x["passed"] for x in rows), "arrays": {x["array"]: x for x in rows}}
        if a.report:
            tables.write_atomic(f"{a.report}.txt", Q.report(rows, a.rtol, a.atol))
            tables.write_atomic(f"{a.report}.json", json.dumps(out, default=str, indent=1))
    elif a.what == "workers":
        out = {"workers": [x.asDict() for x in runtime.worker_snapshot(spark).collect()]}
    else:
        rows = runtime.time_query(spark, lambda: catalogue.QUERIES[a.query](spark, a.data), a.repeats)
        out = Q.wallclock(rows.withColumn("query", F.lit(a.query)), ["query"], "seconds").first().asDict()
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()
