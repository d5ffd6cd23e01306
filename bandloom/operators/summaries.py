"""Aggregates over solutions, comparisons with golden results, and run statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import student
from ..functions.pixels import finite


def _sum(values: str) -> Column:
    return F.aggregate(F.col(values), F.lit(0.0), lambda s, v: s + v)


def frame_summary(solution: DataFrame) -> DataFrame:
    """frame_id, sums of dem, edem and chisq, mean total of dem and mean chisq over numbers, least and largest dem, valid and all pixels."""
    number = F.when(~F.isnan("chisq"), F.col("chisq"))
    em = _sum("dem")
    return solution.groupBy("frame_id").agg(
        F.sum(em).alias("dem_sum"), F.avg(F.when(~F.isnan(em), em)).alias("em_mean"), F.sum(_sum("edem")).alias("edem_sum"), F.sum(number).alias("chisq_sum"), F.avg(number).alias("chisq_mean"),
        F.min(F.array_min("dem")).alias("dem_min"), F.max(F.array_max("dem")).alias("dem_max"), F.count_if("valid").alias("n_valid"), F.count("*").alias("n_pixels"),
    )


def by_band(px: DataFrame, dn: str = "dn", nf: int = 6) -> DataFrame:
    """band, least, largest and mean count, and how many. One row of aggregates for all bands is made, and then cut into bands."""
    at = lambda i: F.get(dn, F.lit(i))
    one = px.agg(*(f(at(i)).alias(f"{name}{i}") for i in range(nf) for name, f in (("least", F.min), ("largest", F.max), ("mean", F.avg), ("n", F.count))))
    rows = F.array(*(F.struct(F.lit(i).alias("band"), *(F.col(f"{c}{i}").alias(c) for c in ("least", "largest", "mean", "n"))) for i in range(nf)))
    return one.select(F.inline(rows)).filter("n > 0")


#: Of values of a sketch, how far from the rank asked for one can be, as a share of all; groups of fewer rows than that are ranked whole.
SKETCH = 10_000
#: Groups up to which their bounds are collected, a row for each, and broadcast.
FEW_GROUPS = 10_000


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], nearest: bool = False, also: dict[str, Column] | None = None, empty: bool = False) -> DataFrame:
    """``by`` and, under each name of ``shares``, the exact quantile of the group's values that aren't null: between the two nearest ranks, or at rank round(share * (n - 1)), halves to even. ``also``: other aggregates of these rows. ``empty``: groups without values are rows too, with null quantiles.

    Two passes, whatever the number of shares: a bounded sketch brackets each rank; then what lies outside all brackets is
    counted, and only values inside are counted one by one and ranked, about a 2,500th of a large group for each share.
    The first pass runs at once, as its rows, one for each group, decide how the second meets them: up to ``FEW_GROUPS`` are
    broadcast, so no value is shuffled for it, and more are joined.
    """
    off, also = 2 / SKETCH, also or {}
    v = F.col(value)
    edges = [min(max(p + d, 0.0), 1.0) for p in shares.values() for d in (-off, off)]
    some = rows.filter(v.isNotNull())
    first = (rows if empty else some).groupBy(*by).agg(F.count(v).alias("__n"), F.min(v).alias("__min"), F.max(v).alias("__max"), F.percentile_approx(v, edges, SKETCH).alias("__near"), *(c.alias(k) for k, c in also.items()))
    few = first.limit(FEW_GROUPS + 1).collect()
    if len(few) <= FEW_GROUPS:
        first = F.broadcast(rows.sparkSession.createDataFrame(few, first.schema))
    whole = F.col("__n") <= 2 * SKETCH
    edge = lambda i, end, rim: F.when(whole | F.lit(rim), F.col(end)).otherwise(F.col("__near")[i])
    brackets = F.array(*(F.struct(edge(2 * i, "__min", p <= off).alias("lo"), edge(2 * i + 1, "__max", p >= 1 - off).alias("hi")) for i, p in enumerate(shares.values())))
    groups = first.select(*(F.col(k).alias(f"__{k}") for k in by), "__n", brackets.alias("__brackets"), *also)
    return within_brackets(some, groups, by, value, shares, nearest, list(also), empty)


def within_brackets(some: DataFrame, groups: DataFrame, by: list[str], value: str, shares: dict[str, float], nearest: bool = False, also: list[str] = (), empty: bool = False) -> DataFrame:
    """The second pass of :func:`quantiles`. ``groups``: of each group, its keys under names with ``__`` before them, __n, __brackets (an array of lo and hi, which hold each share's rank between them) and ``also``.

    A bracket that doesn't hold its rank is an error, never a wrong value.
    """
    values = some.select(*by, F.col(value).alias("__v"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]
    met = values.join(groups.select(*(f"__{k}" for k in by), "__brackets"), same) if by else values.crossJoin(F.broadcast(groups.select("__brackets")))  # without groups that is one row
    inside = F.exists("__brackets", lambda b: F.col("__v").between(b["lo"], b["hi"]))
    # a value between brackets stands behind the last one below it
    below = F.array_max(F.transform("__brackets", lambda b: F.when(b["hi"] < F.col("__v"), b["hi"])))
    counted = met.groupBy(*by, F.when(inside, F.col("__v")).otherwise(below).alias("__at"), inside.alias("__inside")).agg(F.count("*").alias("__k"))
    order = Window.partitionBy(*by).orderBy(F.col("__at").asc_nulls_first(), F.col("__inside").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("__upto", F.sum("__k").over(order)).withColumn("__before", F.col("__upto") - F.col("__k"))
    joined = ranked.join(groups.drop("__brackets"), same) if by else ranked.crossJoin(F.broadcast(groups.drop("__brackets")))
    at = lambda rank: F.min(F.when(F.col("__inside") & (F.col("__upto") > rank), F.struct("__at", (F.col("__before") <= rank).alias("held"))))
    value_of = lambda c: F.when(F.col(f"{c}.held"), F.col(f"{c}.__at")).otherwise(F.raise_error(F.lit("a bracket doesn't hold its rank; use a larger sketch")).cast("double"))
    rank = {name: F.lit(p) * (F.col("__n") - 1) for name, p in shares.items()}
    ends = {name: (F.bround(x), F.bround(x)) if nearest else (F.floor(x), F.ceil(x)) for name, x in rank.items()}
    keep = [F.first(k).alias(k) for k in also]
    found = joined.groupBy(*by).agg(*(f for name, (lo, hi) in ends.items() for f in (at(lo).alias(f"__a_{name}"), at(hi).alias(f"__b_{name}"), F.first(rank[name] - F.floor(rank[name])).alias(f"__part_{name}"))), *keep)
    between = lambda name: value_of(f"__a_{name}") + (value_of(f"__b_{name}") - value_of(f"__a_{name}")) * F.col(f"__part_{name}")
    found = found.select(*by, *((value_of(f"__a_{name}") if nearest else between(name)).alias(name) for name in shares), *also)
    if not empty:
        return found
    own = found.drop(*also).withColumnsRenamed({k: f"__own_{k}" for k in by})
    on = [F.col(f"__{k}").eqNullSafe(F.col(f"__own_{k}")) for k in by] or F.lit(True)
    return groups.join(own, on, "left").select(*(F.col(f"__{k}").alias(k) for k in by), *shares, *also)


def quantile(rows: DataFrame, by: list[str], value: str, share: float, name: str, nearest: bool = False) -> DataFrame:
    """One of :func:`quantiles`."""
    return quantiles(rows, by, value, {name: share}, nearest)


def scaled_by_band_mean(px: DataFrame, response: DataFrame, dn: str = "dn") -> DataFrame:
    """``response`` (bin, band, value) times each band's mean count, of 1e-6 at least."""
    means = by_band(px, dn).select("band", F.greatest("mean", F.lit(1e-6)).alias("mean"))
    return response.join(means, "band").withColumn("value", F.col("value") * F.col("mean"))


def basic_checks(solution: DataFrame) -> DataFrame:
    """finite_frac, positive_frac (of all values, finite and 0 or more), and the median chisq over numbers."""
    how_many = lambda f: F.sum(F.size(F.filter("dem", f)).cast("double"))
    n = F.sum(F.size("dem"))
    shares = solution.agg(F.try_divide(how_many(finite), n).alias("finite_frac"), F.try_divide(how_many(lambda v: finite(v) & (v >= 0)), n).alias("positive_frac"))
    median = quantile(solution.select(F.when(~F.isnan("chisq"), F.col("chisq")).alias("chisq")), [], "chisq", 0.5, "chisq_median")
    return shares.join(median, how="left")  # one row each


def expectations(solution: DataFrame, most_chisq: float = 10.0) -> DataFrame:
    """Counts of what a solution shouldn't have: values that aren't finite, negative values, and whether the median chisq is high."""
    bad = F.exists("dem", lambda v: ~finite(v))
    negative = F.exists("dem", lambda v: finite(v) & (v < 0))
    median = quantile(solution.select("chisq"), [], "chisq", 0.5, "median").select((F.col("median") > most_chisq).alias("high_chisq"))
    return solution.agg(F.count_if(bad).alias("not_finite"), F.count_if(negative).alias("negative")).join(median, how="left")  # one row each


def compare(computed: DataFrame, golden: DataFrame, keys: list[str], value: str = "value", rtol: float = 1e-4, atol: float = 1e-6) -> DataFrame:
    """One row: how far ``computed`` is from ``golden``, cell by cell, and the worst cell (ties: the first by keys).

    NaN equals NaN. Cells on one side only are counted, and not close.
    """
    c, g = computed.select(*keys, F.col(value).alias("c")), golden.select(*keys, F.col(value).alias("g"))
    both = c.join(g, keys, "full_outer")
    one_sided = F.col("c").isNull() | F.col("g").isNull()
    diff = F.abs(F.col("c") - F.col("g"))
    close = F.when(one_sided, False).otherwise((F.isnan("c") & F.isnan("g")) | F.coalesce(~F.isnan(diff) & (diff <= atol + rtol * F.abs("g")), F.lit(False)))
    err = F.when(~F.isnan(diff), diff)
    worst = F.min(F.struct((-F.coalesce(err, F.lit(-1.0))).alias("e"), *keys))
    rows = both.agg(
        F.count("*").alias("n"), F.count_if(one_sided).alias("n_one_sided"), F.max(err).alias("max_abs_err"), F.avg(err).alias("mean_abs_err"),
        F.max(err / (F.abs("g") + 1e-10)).alias("max_rel_err"), F.corr(F.when(err.isNotNull(), F.col("c")), F.when(err.isNotNull(), F.col("g"))).alias("correlation"),
        F.bool_and(close).alias("all_close"), F.avg(close.cast("double")).alias("within"), worst.alias("w"),
    )
    return rows.select("*", *(F.col(f"w.{k}").alias(f"worst_{k}") for k in keys)).drop("w")


def compare_solutions(computed: DataFrame, golden: DataFrame, keys: tuple[str, ...] = ("frame_id", "y", "x"), arrays: tuple[str, ...] = ("dem", "edem", "chisq", "dn_reg"), rtol: float = 1e-4, atol: float = 1e-6) -> DataFrame:
    """A row for each of ``arrays`` that both sides have: its comparison and whether it passed.

    Pixels are joined once, whole; their arrays are laid side by side in the row, and elements are aggregated where they lie.
    """
    both = [x for x in arrays if x in computed.columns and x in golden.columns]
    if not both:
        raise ValueError("the solutions share no array")

    def packed(rows: DataFrame, name: str) -> DataFrame:
        kinds = dict(rows.dtypes)
        values = [F.coalesce((F.col(x) if kinds[x].startswith("array") else F.array(x)).cast("array<double>"), F.array().cast("array<double>")) for x in both]
        return rows.select(*keys, F.array(*values).alias(name))

    nothing = F.array_repeat(F.array().cast("array<double>"), len(both))
    joined = packed(computed, "c").join(packed(golden, "g"), [*keys], "full_outer").select(F.coalesce("c", nothing).alias("c"), F.coalesce("g", nothing).alias("g"))
    pairs = F.array(*(F.struct(F.lit(x).alias("array"), F.arrays_zip(F.get("c", F.lit(i)).alias("c"), F.get("g", F.lit(i)).alias("g")).alias("z")) for i, x in enumerate(both)))
    cells = joined.select(F.inline(pairs)).select("array", F.inline("z"))
    one_sided = F.col("c").isNull() | F.col("g").isNull()
    diff = F.abs(F.col("c") - F.col("g"))
    close = F.when(one_sided, False).otherwise((F.isnan("c") & F.isnan("g")) | F.coalesce(~F.isnan(diff) & (diff <= atol + rtol * F.abs("g")), F.lit(False)))
    err = F.when(~F.isnan(diff), diff)
    return cells.groupBy("array").agg(
        F.count("*").alias("n"), F.count_if(one_sided).alias("n_one_sided"), F.max(err).alias("max_abs_err"), F.avg(err).alias("mean_abs_err"),
        F.max(err / (F.abs("g") + 1e-10)).alias("max_rel_err"), F.avg(close.cast("double")).alias("within"), F.bool_and(close).alias("passed"),
    )


def report(rows: list[dict], rtol: float, atol: float) -> str:
    """The comparison of solutions as text: a line for each array, and whether all passed."""
    lines = [f"{'PASS' if x['passed'] else 'FAIL'} {x['array']}: {x['n']} values, {x['n_one_sided']} on one side, largest error {x['max_abs_err']}, relative {x['max_rel_err']}, within {x['within']}" for x in sorted(rows, key=lambda x: x["array"])]
    return "\n".join([*lines, f"{'PASS' if all(x['passed'] for x in rows) else 'FAIL'} (rtol {rtol}, atol {atol})", ""])


def nearest_rank(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """count, sum, mean, max and, for each share p, the value at rank round(p * (n - 1)) from 0, halves to even: two passes by :func:`quantiles`."""
    v, names = F.col(value), {f"p{round(p * 100)}": p for p in shares}
    out = quantiles(rows, by, value, names, True, {"count": F.count(v), "sum": F.sum(v), "mean": F.avg(v), "max": F.max(v)})
    return out.select(*by, "count", "sum", "mean", *names, "max")


def task_durations(events: DataFrame) -> DataFrame:
    """task and duration from events that have either ``key`` or ``task``, and ``duration`` or ``start`` and ``stop``."""
    have = set(events.columns)
    first = lambda *names: F.coalesce(*(F.col(n) if n in have else F.lit(None) for n in names), F.lit(None))
    span = F.col("stop") - F.col("start") if {"start", "stop"} <= have else F.lit(None)
    return events.select(first("key", "task").cast("string").alias("task"), F.coalesce(first("duration").cast("double"), span.cast("double")).alias("duration")).filter("task is not null and duration is not null")


def wallclock(rows: DataFrame, by: list[str], seconds: str, pixels: int | None = None) -> DataFrame:
    """n, mean, population deviation and median of seconds, and pixels a second where their number is given."""
    out = quantiles(rows, by, seconds, {"median_s": 0.5}, also={"n": F.count(seconds), "mean_s": F.avg(seconds), "std_s": F.stddev_pop(seconds)}, empty=True).select(*by, "n", "mean_s", "std_s", "median_s")
    return out.withColumn("px_per_s", F.try_divide(F.lit(float(pixels)), F.col("mean_s"))) if pixels else out


def welch(rows: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """One row: sizes, means, Welch's t (a less b) and its degrees of freedom."""
    of = lambda f, g: f(F.when(F.col(group) == g, F.col(value)))
    s = rows.agg(*(of(f, g).alias(f"{name}_{k}") for k, g in (("a", a), ("b", b)) for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))))
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(va + vb))
    df = F.try_divide((va + vb) * (va + vb), va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))
    return s.select("n_a", "n_b", "mean_a", "mean_b", t.alias("t"), df.alias("df"))


def welch_pairs(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Welch's test of each pair of groups: a and b (a first in order), n_a, n_b, mean_a, mean_b, t (a less b), df, p_two (two-sided) and p_less (that a's mean isn't below b's, by chance).

    Groups, of which there are few, meet in one row of their counts, means and variances; values are only aggregated.
    Null groups and values, and NaN, are left out. A pair without a variance has no t.
    """
    good = rows.filter(F.col(group).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))
    stats = good.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    one = stats.agg(F.array_sort(F.collect_list(F.struct("g", "n", "mean", "var"))).alias("all"))
    pairs = F.flatten(F.transform("all", lambda a, i: F.transform(F.slice("all", i + 2, F.size("all")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    both = one.select(F.inline(pairs))
    va, vb = F.col("a.var") / F.col("a.n"), F.col("b.var") / F.col("b.n")
    t = F.try_divide(F.col("a.mean") - F.col("b.mean"), F.sqrt(va + vb))
    df = F.try_divide((va + vb) * (va + vb), va * va / (F.col("a.n") - 1) + vb * vb / (F.col("b.n") - 1))
    out = both.select(F.col("a.g").alias("a"), F.col("b.g").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"), F.col("a.mean").alias("mean_a"), F.col("b.mean").alias("mean_b"), t.alias("t"), df.alias("df"))
    return out.withColumns({"p_two": student.two_sided(F.col("t"), F.col("df")), "p_less": student.less(F.col("t"), F.col("df"))})


def paired(rows: DataFrame, key: list[str], group: str, value: str, a: str, b: str) -> DataFrame:
    """One row: n keys that have both groups (their mean where a key repeats), mean and deviation of the differences a less b, t, df, p_two, p_less, and the correlation of a and b."""
    of = lambda g: F.avg(F.when(F.col(group) == g, F.col(value)))
    both = rows.filter(F.col(group).isin(a, b) & F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*key).agg(of(a).alias("x"), of(b).alias("y")).dropna(subset=["x", "y"])
    d = F.col("x") - F.col("y")
    one = both.agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.corr("x", "y").alias("correlation"))
    one = one.withColumn("t", F.try_divide("mean", F.col("std") / F.sqrt("n"))).withColumn("df", (F.col("n") - 1).cast("double"))
    return one.select("n", "mean", "std", "t", "df", student.two_sided(F.col("t"), F.col("df")).alias("p_two"), student.less(F.col("t"), F.col("df")).alias("p_less"), "correlation")


def student_less(t: float, df: float) -> float:
    """P(T <= t) of Student's distribution, by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or 1e-300)
                c = (1 + num / c) or 1e-300
                h *= c * d
        return h

    tail = front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b
    return tail / 2 if t < 0 else 1 - tail / 2


def section_stats(rows: DataFrame, section: str, value: str) -> DataFrame:
    """By section and, with a null section, over all: n, least, largest, mean and population deviation of the numbers."""
    v = F.when(~F.isnan(value), F.col(value))
    return rows.rollup(section).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("largest"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def snapshot_delta(snapshots: DataFrame, before: str, after: str, key: str = "device", label: str = "label", used: str = "used") -> DataFrame:
    """Change in use of each device that both snapshots have."""
    a = snapshots.filter(F.col(label) == before).select(key, F.col(used).alias("before"))
    b = snapshots.filter(F.col(label) == after).select(key, F.col(used).alias("after"))
    return a.join(b, key).withColumn("delta", F.col("after") - F.col("before"))


def peak_usage(devices: DataFrame, snapshots: DataFrame, key: str = "device", used: str = "used") -> DataFrame:
    """The largest use of each device, 0 for those without a snapshot."""
    peaks = snapshots.groupBy(key).agg(F.max(used).alias("peak"))
    return devices.select(key).distinct().join(peaks, key, "left").withColumn("peak", F.coalesce("peak", F.lit(0)))


def inventory(arrays: DataFrame, kind: str = "backend", size: str = "nbytes") -> DataFrame:
    """How many arrays, how many kinds, and the bytes of those whose size is known."""
    kinds = arrays.groupBy(kind).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    return kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(kind).alias("n_kinds"), F.array_join(F.array_sort(F.collect_list(kind)), ",").alias("kinds"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
