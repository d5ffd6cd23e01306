"""Expressions on the ``dn`` and ``edn`` arrays of a pixel.

All of them are JVM expressions: a chain of these stays in one projection above
the scan. NaN is tested before anything is compared, as Spark orders it last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
ERROR_MODELS = ("sqrt_plus", "linear", "constant", "poisson", "unit")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once for a row, not again for each element that a lambda meets."""
    return F.element_at(F.transform(F.array(value), then), 1)


def finite(v: Column) -> Column:
    """False for null, NaN and both infinities."""
    return F.coalesce(~F.isnan(v) & (v < INF) & (v > -INF), F.lit(False))


def sanitise(dn: Column) -> Column:
    """Null, NaN, infinite and negative counts become 0."""
    return F.transform(dn, lambda v: F.when(finite(v) & (v > 0), v).otherwise(F.lit(0.0)))


def shift_up(dn: Column, least: Column) -> Column:
    """Counts less the least of a selection, where that is negative."""
    return F.transform(dn, lambda v: v - F.when(least < 0, least).otherwise(F.lit(0.0)))


def golden_hygiene(dn: Column) -> Column:
    """Counts clipped at 0, plus one."""
    return F.transform(sanitise(dn), lambda v: v + 1.0)


def error_model(dn: Column, model: str, a: float = 1.0, b: float = 1e-6) -> Column:
    """Uncertainties of sanitised counts by a named model; another name is an error."""
    if model == "sqrt_plus":
        return F.transform(dn, lambda v: F.sqrt(v) + b)
    if model == "linear":
        return F.transform(dn, lambda v: a * v + b)
    if model == "constant":
        return F.transform(dn, lambda v: F.lit(float(b)))
    if model == "poisson":
        return F.transform(dn, lambda v: F.sqrt(a * v + b))
    if model == "unit":
        return F.transform(dn, lambda v: F.lit(1.0))
    raise ValueError(f"unknown error model {model!r}; one of {', '.join(ERROR_MODELS)}")


def middle(values: Column) -> Column:
    """The median of an array: the mean of the middle two where their number is even."""
    order, n = F.array_sort(values), F.size(values)
    return (F.element_at(order, F.floor((n + 1) / 2).cast("int")) + F.element_at(order, F.floor(n / 2).cast("int") + 1)) / 2


def error_floor(edn: Column) -> Column:
    """Uncertainties no smaller than a millionth of their median, or 1e-12."""
    return let(F.greatest(F.lit(1e-12), middle(edn) * 1e-6), lambda least: F.transform(edn, lambda v: F.greatest(v, least)))


def valid(dn: Column, edn: Column) -> Column:
    """Whether every count over its (floored) uncertainty is finite and positive; an empty or null array is not."""
    ratio = F.zip_with(dn, error_floor(edn), lambda d, e: F.when(finite(d) & finite(e), d / e))
    return F.coalesce((F.size(dn) > 0) & F.forall(ratio, lambda v: F.coalesce(finite(v) & (v > 0), F.lit(False))), F.lit(False))


def em_loci(dn: Column, response: list[list[float]], bands: list[int]) -> Column:
    """For each temperature bin the least of count over response, over the given bands."""
    bins = [F.array_min(F.array(*(F.element_at(dn, f + 1) / max(row[f], 1e-300) for f in bands))) for row in response]
    return F.array(*bins)


def smooth5(w: Column) -> Column:
    """Five-point centred mean of the inner bins over the largest value, no less than 1e-8.

    The two end bins count for nothing in the sums, and neither do places beyond them.
    """
    n = F.size(w)
    inner = F.transform(w, lambda v, i: F.when((i > 0) & (i < n - 1), v).otherwise(F.lit(0.0)))
    top = F.greatest(F.array_max(w), F.lit(1e-12))

    def means(x: Column) -> Column:
        at = lambda i: F.coalesce(F.try_element_at(x["inner"], i), F.lit(0.0))
        around = lambda i: sum((F.when(i + k > 0, at(F.greatest(i + k, F.lit(1)))).otherwise(F.lit(0.0)) for k in range(-1, 4)), F.lit(0.0))
        return F.transform(w, lambda v, i: F.greatest(around(i) / 5 / x["top"], F.lit(1e-8)))

    return let(F.struct(inner.alias("inner"), top.alias("top")), means)


def forward(dem: Column, response: list[list[float]]) -> Column:
    """Counts that a distribution gives under a response of bins by bands."""
    return F.array(*(sum((F.element_at(dem, t + 1) * row[f] for t, row in enumerate(response)), F.lit(0.0)) for f in range(len(response[0]))))


def back_project(dn: Column, response: list[list[float]]) -> Column:
    """Counts times the transposed response: a projection, not a solution."""
    return F.array(*(sum((F.element_at(dn, f + 1) * v for f, v in enumerate(row)), F.lit(0.0)) for row in response))


def chisq(dn: Column, edn: Column, predicted: Column) -> Column:
    """Mean squared residual in units of the uncertainty."""
    parts = F.zip_with(F.zip_with(dn, predicted, lambda a, b: a - b), edn, lambda r, e: (r / e) * (r / e))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / F.size(dn)


def rescale(dn: Column, predicted: Column) -> Column:
    """Mean ratio of counts to predicted counts."""
    return F.aggregate(F.zip_with(dn, predicted, lambda a, b: a / F.greatest(b, F.lit(1e-300))), F.lit(0.0), lambda s, v: s + v) / F.size(dn)


def times_factor(dem: Column, factor: list[float], divide: bool = False) -> Column:
    """Between a distribution by bin and by temperature: times each bin's factor, or over it."""
    other = F.array(*map(F.lit, factor))
    return F.zip_with(dem, other, (lambda d, f: d / f) if divide else (lambda d, f: d * f))


def resample(values: Column, n_in: int, n_out: int) -> Column:
    """Linear interpolation of an array onto another number of evenly spaced points."""
    out = []
    for i in range(n_out):
        x = i * (n_in - 1) / (n_out - 1) if n_out > 1 else 0.0
        k = min(int(x), max(n_in - 2, 0))
        a, b = F.element_at(values, k + 1), F.element_at(values, min(k + 2, n_in))
        out.append(a + (b - a) * (x - k))
    return F.array(*out)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def positive(dem: Column) -> Column:
    return F.transform(dem, lambda v: F.when(finite(v) & (v > 0), v).otherwise(F.lit(0.0)))


def total_em(dem: Column) -> Column:
    return _sum(positive(dem))


def peak_logt(dem: Column, logt: list[float]) -> Column:
    """The temperature of the first largest bin; null where nothing is positive."""
    d = positive(dem)
    at = F.element_at(F.array(*map(F.lit, logt)), F.array_position(d, F.array_max(d)).cast("int"))
    return F.when(_sum(d) > 0, at)


def mean_logt(dem: Column, logt: list[float]) -> Column:
    """log10 of the mean linear temperature."""
    d = positive(dem)
    warm = _sum(F.zip_with(d, F.array(*(F.lit(10.0**t) for t in logt)), lambda a, t: a * t))
    return F.when(_sum(d) > 0, F.log10(F.try_divide(warm, _sum(d))))


def median_logt(dem: Column, logt: list[float]) -> Column:
    """The first bin at which the running sum reaches half of the total."""
    bins = F.array(*map(F.lit, logt))

    def first(x: Column) -> Column:
        half = x["total"] * 0.5
        at = F.aggregate(
            x["d"],
            F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at")),
            lambda s, v: F.struct((s["sum"] + v).alias("sum"), (s["at"] + F.when(s["sum"] + v >= half, 0).otherwise(1)).cast("int").alias("at")),
            lambda s: s["at"],
        )
        return F.when(x["total"] > 0, F.element_at(bins, F.least(at, F.lit(len(logt) - 1)) + 1))

    return let(positive(dem), lambda d: let(F.struct(d.alias("d"), _sum(d).alias("total")), first))


def std_logt(dem: Column, logt: list[float]) -> Column:
    """Spread in log10 T around the mean of log10 T, which is not the mean map's."""
    t = F.array(*map(F.lit, logt))

    def spread(x: Column) -> Column:
        parts = F.zip_with(x["d"], t, lambda a, v: a * (v - x["mean"]) * (v - x["mean"]))
        return F.when(x["total"] > 0, F.sqrt(F.try_divide(_sum(parts), x["total"])))

    def centred(x: Column) -> Column:
        mean = F.try_divide(_sum(F.zip_with(x["d"], t, lambda a, v: a * v)), x["total"])
        return let(F.struct(x["d"].alias("d"), x["total"].alias("total"), mean.alias("mean")), spread)

    return let(positive(dem), lambda d: let(F.struct(d.alias("d"), _sum(d).alias("total")), centred))
