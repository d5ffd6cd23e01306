"""Student's distribution as column expressions, so tests of many groups need no driver and no Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pixels import let

#: Terms of the continued fraction; it has converged long before for any argument on the side where it is used.
TERMS = 300
TINY = 1e-300


def lgamma(z: Column) -> Column:
    """The logarithm of the gamma function for z > 0: Stirling's series at z + 10, and ten steps back."""
    w = z + 10
    series = (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + 1 / (12 * w) - 1 / (360 * F.pow(w, 3)) + 1 / (1260 * F.pow(w, 5)) - 1 / (1680 * F.pow(w, 7))
    return series - sum((F.log(z + k) for k in range(1, 10)), F.log(z))


def fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, term by term in one array aggregate."""
    away = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))
    d0 = 1 / away(1 - (a + b) * x / (a + 1))

    def step(s: Column, n: Column) -> Column:
        m = F.floor(n / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        term = F.when(n % 2 == 0, even).otherwise(odd)
        d, c = 1 / away(1 + term * s["d"]), away(1 + term / s["c"])
        return let(F.struct(c.alias("c"), d.alias("d")), lambda v: state(v["c"], v["d"], s["h"] * v["d"] * v["c"]))

    return F.aggregate(F.sequence(F.lit(2), F.lit(TERMS)), state(F.lit(1.0), d0, d0), step, lambda s: s["h"])


def beta_share(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function of x in (0, 1), for a, b > 0."""
    swap = x >= (a + 1) / (a + b + 2)
    at = F.struct(F.when(swap, 1 - x).otherwise(x).alias("x"), F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"), swap.alias("swap"))

    def of(v: Column) -> Column:
        front = F.exp(lgamma(v["a"] + v["b"]) - lgamma(v["a"]) - lgamma(v["b"]) + v["a"] * F.log(v["x"]) + v["b"] * F.log1p(-v["x"])) / v["a"]
        return let(front * fraction(v["x"], v["a"], v["b"]), lambda s: F.when(v["swap"], 1 - s).otherwise(s))

    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(let(at, of))


def two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|); null without a t, or degrees of freedom above 0."""
    good = t.isNotNull() & ~F.isnan(t) & (df > 0)
    return F.when(good & (F.abs(t) == float("inf")), F.lit(0.0)).when(good, beta_share(df / (df + t * t), df / 2, F.lit(0.5)))


def less(t: Column, df: Column) -> Column:
    """P(T <= t)."""
    return let(two_sided(t, df), lambda p: F.when(t < 0, p / 2).otherwise(1 - p / 2))
