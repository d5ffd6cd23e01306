"""Golden solutions: counts above 0, responses scaled to them, the solver, and least squares where it finds nothing."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as P
from ..runtime import scratch
from ..sources import tables
from . import inversion as V
from .calibration import Calibration
from .summaries import by_band


def band_means(px: DataFrame, nf: int = 6, least: float = 1e-6) -> np.ndarray:
    """The mean count of each band, of ``least`` at least; one row comes to the driver."""
    found = {x["band"]: x["mean"] for x in by_band(px, nf=nf).collect()}
    return np.array([max(found.get(i) or 0.0, least) for i in range(nf)])


def make_golden(px: DataFrame, cal: Calibration, options: V.Options = V.Options(), error_model: str = "poisson", a: float = 1.0, b: float = 1.0, out: str | None = None, meta: dict | None = None) -> tuple[DataFrame, dict]:
    """The golden solution of the pixels (frame_id, y, x, dn), written to ``out``, and the facts that go with it.

    Counts are clipped at 0 and raised by one, and each band's response is multiplied by the band's mean count. One pass
    solves, writes and finds the figures. If the solver's distribution is 0 everywhere, clipped least squares takes its
    place, with uncertainties of 0. ``meta``: further facts to write with it.
    """
    nf = cal.rmatrix.shape[1]
    spark, out = px.sparkSession, out or scratch(px.sparkSession, "golden")
    raised = px.withColumn("dn", P.golden_hygiene(F.col("dn")))
    means = band_means(raised, nf)
    scaled = replace(cal, rmatrix=cal.rmatrix * means)
    ready = raised.withColumn("edn", P.error_model(F.col("dn"), error_model, a, b)).select("frame_id", "y", "x", "dn", "edn")
    facts = {"r_scale": means.tolist(), "logt": cal.logt.tolist(), "fallback": False}
    write = lambda rows, mode="errorifexists": tables.write_solution(rows, out, meta=facts | (meta or {}), single=False, mode=mode)
    solution = V.solve_dem(ready, scaled, options)
    figures = write(solution)
    if not figures["dem_max"]:
        facts["fallback"] = True
        r = scaled.rmatrix / cal.scale

        def least_squares(dn: np.ndarray, edn: np.ndarray) -> dict[str, np.ndarray]:
            dem, predicted, fit = V.lstsq_clip(dn, r)
            return {"dem": dem, "edem": np.zeros_like(dem), "chisq": fit, "dn_reg": predicted}

        solution = V.solve_with(ready, least_squares, "dem array<double>, edem array<double>, chisq double, dn_reg array<double>", nf).withColumn("valid", F.lit(True))
        figures = write(solution, "overwrite")
    return spark.read.schema(solution.schema).parquet(f"{out}/solution"), facts | figures
