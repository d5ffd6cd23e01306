"""Quantiles from sketches that are kept: made once for each day, merged over days, and exact in one further pass.

A sketch of a group has a bounded size (some 24 bytes for each of ``K``), whatever the group's, and sketches of parts merge
into a sketch of the whole, so a new day costs the day alone. An estimate lies within :func:`rank_error` of its rank with
high probability; :func:`exact` widens that eightfold in deviations, counts what lies outside and ranks what lies inside,
and a bracket that misses all the same is an error, not a wrong value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .summaries import within_brackets

K = 4000


def rank_error(k: int = K) -> float:
    """The published bound of a rank's error, as a share of all values, that 99 of 100 estimates keep."""
    return 2.296 / k**0.9021


def sketched(rows: DataFrame, by: list[str], value: str, k: int = K) -> DataFrame:
    """``by``, n, least, largest and sketch of the group's values that aren't null or NaN."""
    v = F.col(value).cast("double")
    good = rows.filter(v.isNotNull() & ~F.isnan(v))
    return good.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("largest"), F.kll_sketch_agg_double(v, k).alias("sketch"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of larger groups."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("largest").alias("largest"), F.kll_merge_agg_double("sketch").alias("sketch"))


def estimate(share: float) -> Column:
    """The value at about this share, between the least and the largest."""
    return F.kll_sketch_get_quantile_double("sketch", F.lit(share))


def exact(rows: DataFrame, sketches: DataFrame, by: list[str], value: str, shares: dict[str, float], nearest: bool = False, k: int = K) -> DataFrame:
    """``by`` and the exact quantile for each of ``shares`` of the rows that the merged sketches are of: one pass over the values, whatever the number of shares."""
    off = 8 / 2.576 * rank_error(k)
    end = lambda p, rim: F.when((F.col("n") <= k) | F.lit(not 0 < p < 1), F.col(rim)).otherwise(estimate(min(max(p, 0.0), 1.0)))
    brackets = F.array(*(F.struct(end(p - off, "least").alias("lo"), end(p + off, "largest").alias("hi")) for p in shares.values()))
    groups = sketches.select(*(F.col(x).alias(f"__{x}") for x in by), F.col("n").alias("__n"), brackets.alias("__brackets"))
    v = F.col(value).cast("double")
    return within_brackets(rows.withColumn(value, v).filter(v.isNotNull() & ~F.isnan(v)), groups, by, value, shares, nearest)
