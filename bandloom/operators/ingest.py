"""From a manifest of raw frames to complete band sets, and quantised counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pixels import finite
from .summaries import quantile

MANIFEST = T.StructType(
    [
        T.StructField("timestamp_utc", T.TimestampType()),
        T.StructField("bucket_12s", T.StringType()),
        T.StructField("wavelength", T.IntegerType()),
        T.StructField("filepath", T.StringType()),
        T.StructField("filesize_bytes", T.LongType()),
        T.StructField("hash_md5", T.StringType()),
        T.StructField("exptime", T.DoubleType()),
        T.StructField("naxis1", T.IntegerType()),
        T.StructField("naxis2", T.IntegerType()),
    ]
)


def day_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def bucket_of(ts: Column, cadence: int) -> Column:
    """HH_MM_SS of the time within its UTC day, floored to the cadence in seconds."""
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    floor = (F.floor(second / cadence) * cadence).cast("int")
    part = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws("_", part(F.floor(floor / 3600)), part(F.floor(floor / 60) % 60), part(floor % 60))


def bucketed(manifest: DataFrame, cadence: int = 12, ts: str = "timestamp_utc") -> DataFrame:
    return manifest.withColumn("d8", day_of(F.col(ts))).withColumn("bucket", bucket_of(F.col(ts), cadence))


def first_per_band(rows: DataFrame, then: tuple[str, ...] = ()) -> DataFrame:
    """The earliest file (then the first by path, and by the columns of ``then``) of each day, bucket and wavelength."""
    order = Window.partitionBy("d8", "bucket", "wavelength").orderBy("timestamp_utc", "filepath", *then)
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def bandsets(rows: DataFrame, bands: list[int]) -> DataFrame:
    """d8, bucket, n_bands, complete. Wavelengths outside ``bands`` don't count."""
    held = rows.filter(F.col("wavelength").isin(bands)).groupBy("d8", "bucket").agg(F.countDistinct("wavelength").alias("n_bands"))
    return held.withColumn("complete", F.col("n_bands") == len(bands))


def pivoted(first: DataFrame, bands: list[int]) -> DataFrame:
    """d8, bucket and a path column ``w<band>`` for each band; one shuffle, as the bands are given."""
    slots = [F.max(F.when(F.col("wavelength") == w, F.col("filepath"))).alias(f"w{w}") for w in bands]
    return first.groupBy("d8", "bucket").agg(*slots)


def assembled(first: DataFrame, bands: list[int], value: str = "value") -> DataFrame:
    """d8, bucket, a path column ``w<band>`` for each band, n_bands, complete, lacking (bands without a file), values (of each band, null where it has none).

    ``first``: one file a day, bucket and wavelength. One shuffle makes all of it.
    """
    of = lambda w, c: F.max(F.when(F.col("wavelength") == w, F.col(c)))
    rows = first.groupBy("d8", "bucket").agg(*(of(w, "filepath").alias(f"w{w}") for w in bands), F.array(*(of(w, value) for w in bands)).alias("values"))
    lacking = F.filter(F.array(*(F.when(F.col(f"w{w}").isNull(), F.lit(w)) for w in bands)), lambda w: w.isNotNull())
    return rows.withColumn("lacking", lacking).withColumn("n_bands", F.lit(len(bands)) - F.size("lacking")).withColumn("complete", F.size("lacking") == 0).filter("n_bands > 0")


def to_do(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wanted`` whose keys aren't in ``done``."""
    return wanted.join(done, keys, "left_anti")


def present(manifest: DataFrame, files: DataFrame, key: str = "filepath") -> DataFrame:
    """Manifest rows whose file exists."""
    return manifest.join(files, key, "left_semi")


def time_slices(spans: DataFrame, minutes: int) -> DataFrame:
    """Slices [t0, t1) of ``spans`` (start, stop) by so many minutes, the last one clipped."""
    step = F.expr(f"interval {minutes} minutes")
    starts = F.when(F.col("start") < F.col("stop"), F.sequence("start", F.col("stop") - F.expr("interval 1 microsecond"), step)).otherwise(F.array().cast("array<timestamp>"))
    return spans.select("*", F.explode(starts).alias("t0")).withColumn("t1", F.least(F.col("t0") + step, "stop"))


def names_hash(rows: DataFrame, name: str, by: list[str]) -> DataFrame:
    """SHA-256 of each group's sorted names, a line each.

    A group's names meet in one row, as the digest is of one string: groups are a day's files, not a table.
    """
    text = F.concat(F.array_join(F.array_sort(F.collect_list(name)), "\n"), F.lit("\n"))
    return rows.groupBy(*by).agg(F.count("*").alias("n_files"), F.sha2(text, 256).alias("sha256"), F.md5(text).alias("md5"))


def common_shape(frames: DataFrame, by: list[str], height: str = "naxis2", width: str = "naxis1") -> DataFrame:
    """Each row with the smallest height and width in its set, to which all its bands are cut."""
    own = Window.partitionBy(*by)
    return frames.withColumn("crop_h", F.min(height).over(own)).withColumn("crop_w", F.min(width).over(own))


def quantise_scales(values: DataFrame, by: str, value: str, bits: int = 16, strategy: str = "p99") -> DataFrame:
    """band and scale: the 99th percentile (exact, by :func:`summaries.quantile`) or the largest finite value of each band over 2^bits - 1.

    ``p99_approx`` takes the percentile from a bounded sketch, for bands too large to count exactly.
    """
    v = F.col(value)
    clean = F.when(finite(v) & (v > 0), v).otherwise(F.lit(0.0))
    if strategy == "p99":
        hi = quantile(values.select(by, clean.alias("__x")), [by], "__x", 0.99, "hi")
    else:
        hi = values.groupBy(by).agg({"max": F.max(clean), "p99_approx": F.percentile_approx(clean, 0.99, 10_000)}[strategy].alias("hi"))
    return hi.select(by, (F.when(F.col("hi") > 0, F.col("hi")).otherwise(F.lit(1.0)) / float(2**bits - 1)).alias("scale"))


def quantise(values: DataFrame, scales: DataFrame, by: str, value: str, bits: int = 16) -> DataFrame:
    """With ``q``: the value over its band's scale, rounded half to even, within 0 and 2^bits - 1. ``scales`` has a row for each band, tens at most, and is broadcast."""
    v = F.col(value)
    clean = F.when(finite(v) & (v > 0), v).otherwise(F.lit(0.0))
    q = F.least(F.greatest(F.rint(clean / F.col("scale")), F.lit(0.0)), F.lit(float(2**bits - 1)))
    return values.join(F.broadcast(scales), by).withColumn("q", q.cast("long"))


def dequantise(rows: DataFrame, q: str = "q", scale: str = "scale", offset: float = 0.0) -> DataFrame:
    return rows.withColumn("restored", F.col(q) * F.col(scale) + offset)
