"""Calibrations of many instruments at once: grids, responses and samples as tables with a key for each instrument.

What :mod:`bandloom.operators.calibration` does for one instrument on the driver is here a table operation, so thousands of
instruments, or one calibration a day, are made, binned and interpolated where they lie. ``by`` names the key's columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins as J
from .calibration import SCALE


def bins_for(nmu: Column) -> Column:
    """How many bins go with a number of regularisation steps: six tenths, halves to even, from 8 to 64; 24 without one."""
    return F.when(nmu > 0, F.least(F.greatest(F.bround(0.6 * nmu), F.lit(8.0)), F.lit(64.0))).otherwise(F.lit(24.0)).cast("int")


def grids(instruments: DataFrame, nt: int = 24) -> DataFrame:
    """Instruments (with lo and hi) with bin, logt, edge_lo, edge_hi, temp_lo, temp_hi: evenly spaced centres from lo to hi, and edges half a step around them."""
    step = (F.col("hi") - F.col("lo")) / (nt - 1) if nt > 1 else F.lit(0.1)
    rows = instruments.select("*", F.explode(F.sequence(F.lit(0), F.lit(nt - 1))).alias("bin")).withColumn("logt", F.col("lo") + F.col("bin") * step)
    rows = rows.withColumn("edge_lo", F.col("lo") - step / 2 + F.col("bin") * step).withColumn("edge_hi", F.col("lo") - step / 2 + (F.col("bin") + 1) * step)
    return rows.withColumn("temp_lo", F.pow(F.lit(10.0), "edge_lo")).withColumn("temp_hi", F.pow(F.lit(10.0), "edge_hi"))


def banded(rows: DataFrame, nf: int) -> DataFrame:
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(nf - 1))).alias("band"))


def gaussian(centre: Column, width: Column) -> Column:
    z = (F.col("logt") - centre) / width
    return F.exp(-0.5 * z * z)


def responses(grid: DataFrame, by: list[str], nf: int = 6, width: Column | None = None, normalize: str = "none", include_jacobian: bool = False) -> DataFrame:
    """The grid with band and value: Gaussians at 10 to 90 % of the range, times the bin's width where asked, normalised by instrument and band (``l1``, ``colmax``, ``none``)."""
    centre = F.col("lo") + (F.col("hi") - F.col("lo")) * (0.1 + 0.8 * F.col("band") / max(nf - 1, 1))
    value = gaussian(centre, F.col("width") if width is None else width)
    rows = banded(grid, nf).withColumn("value", value * (F.col("edge_hi") - F.col("edge_lo")) if include_jacobian else value)
    one = Window.partitionBy(*by, "band")
    if normalize not in ("none", "l1", "colmax"):
        raise ValueError(f"unknown normalisation {normalize!r}")
    return rows if normalize == "none" else rows.withColumn("value", F.col("value") / ((F.sum if normalize == "l1" else F.max)("value").over(one) + 1e-12))


def legacy(grid: DataFrame, nf: int = 6) -> DataFrame:
    """The grid with band and value: Gaussians of width 0.2 at 5.7 to 7.3."""
    return banded(grid, nf).withColumn("value", gaussian(5.7 + 1.6 * F.col("band") / max(nf - 1, 1), F.lit(0.2)))


def samples(instruments: DataFrame, n_tresp: int = 200, nf: int = 6) -> DataFrame:
    """Instruments with i, band, logt and value of their finely sampled responses."""
    step, span = (F.col("hi") - F.col("lo")) / (n_tresp - 1), (F.col("hi") - F.col("lo") - 0.4) / max(nf - 1, 1)
    rows = banded(instruments.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_tresp - 1))).alias("i")), nf).withColumn("logt", F.col("lo") + F.col("i") * step)
    return rows.withColumn("value", gaussian(F.col("lo") + 0.2 + F.col("band") * span, F.lit(0.15)) + 1e-30)


def equal_bins(instruments: DataFrame, by: list[str], n: int) -> DataFrame:
    """``by``, bin, from, to and centre of n equal bins of each instrument's range; the last one holds its end."""
    w = (F.col("hi") - F.col("lo")) / n
    rows = instruments.select(*by, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    to = F.col("lo") + (F.col("bin") + 1) * w
    return rows.select(*by, "bin", (F.col("lo") + F.col("bin") * w).alias("from"), F.when(F.col("bin") == n - 1, F.greatest(to, F.col("hi")) * (1 + 1e-12)).otherwise(to).alias("to"), (F.col("lo") + (F.col("bin") + 0.5) * w).alias("centre"))


def interpolated(taken: DataFrame, points: DataFrame, by: list[str], log: bool = True) -> DataFrame:
    """``points`` (by, bin, x) with band and value: linear between the samples (by, band, logt, value) around x, clamped beyond them; ``log``: in the logarithm of the value."""
    y = F.log10(F.greatest("value", F.lit(1e-300))) if log else F.col("value")
    one = Window.partitionBy(*by, "band").orderBy("x")
    pieces = taken.select(*by, "band", F.col("logt").alias("x"), y.alias("y")).select("*", F.lead("x").over(one).alias("x2"), F.lead("y").over(one).alias("y2"))
    ends = pieces.groupBy(*by, "band").agg(F.min_by("y", "x").alias("first"))
    asked = points.join(J.shuffled(ends), by)
    found = J.asof(asked, pieces, [*by, "band"], "x", {"x1": "x", "y1": "y", "x2": "x2", "y2": "y2"}, width=1e6)
    share = F.when(F.col("x2").isNull(), F.lit(0.0)).otherwise((F.col("x") - F.col("x1")) / (F.col("x2") - F.col("x1")))
    value = F.when(F.col("x1").isNull(), F.col("first")).otherwise(F.col("y1") + F.when(share == 0, F.lit(0.0)).otherwise((F.col("y2") - F.col("y1")) * share))
    return found.select(*by, "bin", "band", (F.pow(F.lit(10.0), value) if log else value).alias("value"))


def binned(taken: DataFrame, bins: DataFrame, by: list[str], width: float = 0.1) -> DataFrame:
    """``by``, bin, band, n and value: the mean of the samples (by, band, logt, value) in each bin (by, bin, from, to, centre), by a join on ranges; an empty bin takes the value between the samples around its centre."""
    met = J.range_join(taken.select(*by, "band", "logt", "value"), bins, "logt", "from", "to", width=width, by=by)
    means = met.groupBy(*by, "bin", "band").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    between = interpolated(taken, bins.select(*by, "bin", F.col("centre").alias("x")), by, log=False)
    return between.join(J.shuffled(means), [*by, "bin", "band"], "left").select(*by, "bin", "band", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", "value").alias("value"))


def prepared(instruments: DataFrame, taken: DataFrame, by: list[str], nt: int = 24, jacobians: int = 1) -> DataFrame:
    """``by``, bin, band and value of the matrix that the solver takes: responses at the bins' centres by their logarithms, times the bins' widths in temperature (``jacobians`` times) and the scale."""
    bins = equal_bins(instruments, by, nt)
    at = interpolated(taken, bins.select(*by, "bin", F.col("centre").alias("x")), by)
    w = (F.col("hi") - F.col("lo")) / nt
    rows = at.join(J.shuffled(bins.join(J.shuffled(instruments.select(*by, "lo", "hi")), by).select(*by, "bin", "centre", w.alias("w"))), [*by, "bin"])
    factor = F.pow(F.pow(F.lit(10.0), "centre") * F.col("w") * math.log(10), F.lit(float(jacobians)))
    return rows.select(*by, "bin", "band", (F.col("value") * factor * SCALE).alias("value"))
