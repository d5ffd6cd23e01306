"""Band sets and solutions from streams, beyond what batches do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import inversion
from ..operators.calibration import Calibration
from ..operators.ingest import MANIFEST


def manifest_stream(spark: SparkSession, directory: str) -> DataFrame:
    """Manifest files in CSV as they arrive."""
    return spark.readStream.csv(directory, header=True, schema=MANIFEST)


def complete_bandsets(rows: DataFrame, bands: list[int], cadence: int = 12, late: str = "1 minute") -> DataFrame:
    """bucket_start and the first path of each band, for windows that have all bands, once the watermark has passed them.

    State is one row for each open window.
    """
    slots = [F.min(F.when(F.col("wavelength") == w, F.struct("timestamp_utc", "filepath"))).alias(f"s{w}") for w in bands]
    sets = rows.withWatermark("timestamp_utc", late).filter(F.col("wavelength").isin(bands)).groupBy(F.window("timestamp_utc", f"{cadence} seconds")).agg(*slots)
    whole = sets
    for w in bands:
        whole = whole.filter(F.col(f"s{w}").isNotNull())
    return whole.select(F.col("window.start").alias("bucket_start"), *(F.col(f"s{w}.filepath").alias(f"w{w}") for w in bands))


def solve_stream(px: DataFrame, cal: Calibration, sink: Callable[[DataFrame, int], None], checkpoint: str, options: inversion.Options = inversion.Options()) -> StreamingQuery:
    """Solves each micro-batch of pixels and hands it to ``sink`` with its number, which makes repeats harmless."""
    solved = inversion.solve_dem(px, cal, options)
    return solved.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
