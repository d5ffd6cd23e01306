"""The tables at hand read as pixels, manifests, solutions and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BANDS = {"click": 94, "error": 131, "purchase": 171, "signup": 193, "view": 211}
NF = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str, signed: bool = False) -> DataFrame:
    """frame_id, vec_id, y, x, dn: the first six values of each embedding as counts."""
    count = lambda v: 1000.0 * (v.cast("double") if signed else F.abs(v.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    y, x = F.floor(F.col("vec_id") / 32).cast("int"), (F.col("vec_id") % 32).cast("int")
    return rows.select(F.col("label").cast("string").alias("frame_id"), "vec_id", y.alias("y"), x.alias("x"), F.transform(F.slice("embedding", 1, NF), count).alias("dn"))


def pxline(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """frame_id, y, x, dn: order lines summed to six bands, with natural zeros.

    ``in_order``: each line's rows are added in the table's order, so the last digits don't depend on partitions, for what
    stands on them. Rows are ordered in windows, which spill; the order is that of files' names and rows in them.
    """
    rows, keys = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    n, share = F.col("l_quantity"), 1 - F.col("l_discount")
    bands = [n, F.col("l_extendedprice") / 1000, 100 * F.col("l_discount"), 100 * F.col("l_tax"), F.lit(1.0), n * share]
    if in_order:
        order = Window.partitionBy(*keys).orderBy("__file", "__row")
        upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.select(*keys, *(e.alias(f"b{i}") for i, e in enumerate(bands)), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        lines = rows.select(*keys, *(F.sum(f"b{i}").over(upto).alias(f"b{i}") for i in range(NF)), F.lead("__row").over(order).isNull().alias("__last")).filter("__last")
    else:
        lines = rows.groupBy(*keys).agg(*(F.sum(e).alias(f"b{i}") for i, e in enumerate(bands)))
    return lines.select(F.lit("lines").alias("frame_id"), F.col("l_orderkey").alias("y"), F.col("l_linenumber").alias("x"), F.array(*(f"b{i}" for i in range(NF))).alias("dn"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """timestamp_utc, wavelength, filepath, user_id, value: events as raw files."""
    rows = table(spark, sf_dir, "events")
    band = F.create_map(*(F.lit(x) for pair in BANDS.items() for x in pair))[F.col("event_type")]
    return rows.select(F.col("ts").alias("timestamp_utc"), band.alias("wavelength"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("filepath"), "user_id", "value")


def dem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, dem: the positive part of six values of each embedding."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rows.select("vec_id", F.transform(F.slice("embedding", 1, NF), lambda v: F.greatest(v.cast("double"), F.lit(0.0))).alias("dem"))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument, lo, hi, width: a range of temperatures and a width of responses for each supplier."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(key.alias("instrument"), (5.5 + 0.01 * (key % 10)).alias("lo"), (7.3 + F.greatest("s_acctbal", F.lit(0.0)) / 50000).alias("hi"), (0.15 + 0.01 * (key % 5)).alias("width"))


LOGT = [5.5 + 0.4 * i for i in range(NF)]
