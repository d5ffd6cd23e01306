"""From raw files' records as they arrive to solved band sets, day by day.

Takes what is new in a folder of records (a time, a kind, a file, a count), keeps the first file of each band and time
bucket, assembles sets, solves the complete ones, and says of the others which bands they lack:

* ``<out>/slots``: the first file of each day, bucket and band in each batch, by day and batch;
* ``<out>/sets``: a row for each day and bucket with its files, counts and solution, by day;
* ``<out>/runs``: what each run read and wrote;
* ``<out>/checkpoint``: which source files were taken. It belongs to this folder: move or delete both together.

A batch writes its own partitions of ``slots`` and then the days it touches in ``sets``, which follow from all slots of
those days, so late records reopen their day alone, a set that was incomplete may become whole, and a batch that is run
again after a failure writes the same files. Without new source files a run changes nothing.

Times are wall times, as the records have them, so results don't hang on the session's time zone; where ``schema`` says that
they are instants, they are told in that zone, which the command line sets to UTC.

Edge cases: records without a time or file, or of a kind that no band has, are left out; records that repeat, and ties in
time, are settled by file and then count; counts that are null, negative or not finite make a set invalid, with the
solver's fixed outputs; an empty folder gives no output but the record of the run.
"""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.functions import pixels
from bandloom.operators import calibration, ingest, inversion

from . import common

SLOTS = "timestamp_utc timestamp_ntz, wavelength int, filepath string, value double, bucket string, d8 string, batch long"


@dataclass(frozen=True)
class Settings:
    """The records' schema and columns, the band of each kind, the bucket's seconds, and how sets are solved."""

    schema: str = "event_id long, ts timestamp_ntz, event_type string, value double"
    time: str = "ts"
    kind: str = "event_type"
    file: str = "event_id"
    count: str = "value"
    bands: dict[str, int] = field(default_factory=lambda: {"click": 94, "error": 131, "purchase": 171, "signup": 193, "view": 211})
    cadence: int = 3600
    error_model: str = "poisson"
    error_a: float = 1.0
    error_b: float = 1.0
    nt: int = 24
    nmu: int = 42
    files_per_batch: int = 10_000

    @property
    def wavelengths(self) -> list[int]:
        return sorted(self.bands.values())

    def calibration(self) -> calibration.Calibration:
        return calibration.default(self.nt, len(self.bands))

    def options(self) -> inversion.Options:
        return inversion.Options(nmu=self.nmu)


def slots(rows: DataFrame, s: Settings) -> DataFrame:
    """The first file of each day, bucket and band."""
    band = F.create_map(*(F.lit(x) for pair in s.bands.items() for x in pair))[F.col(s.kind)]
    files = rows.select(F.col(s.time).cast("timestamp_ntz").alias("timestamp_utc"), band.cast("int").alias("wavelength"), F.col(s.file).cast("string").alias("filepath"), F.col(s.count).cast("double").alias("value"))
    return ingest.first_per_band(ingest.bucketed(files.dropna(subset=["timestamp_utc", "wavelength", "filepath"]), s.cadence), ("value",))


def solved(first: DataFrame, s: Settings) -> DataFrame:
    """Sets of first files with their solutions; incomplete ones have none."""
    sets = ingest.assembled(first, s.wavelengths)
    counts = F.when(F.col("complete"), pixels.sanitise(F.col("values")))
    ready = sets.withColumn("dn", counts).withColumn("edn", pixels.error_model(F.col("dn"), s.error_model, s.error_a, s.error_b))
    out = inversion.solve_dem(ready, s.calibration(), s.options())
    return out.withColumns({c: F.when(F.col("complete"), F.col(c)) for c in (*inversion.OUTPUTS, "valid")})


def sets_schema(spark: SparkSession, s: Settings) -> str:
    return solved(spark.createDataFrame([], SLOTS), s).schema


def run(spark: SparkSession, source: str, out: str, s: Settings = Settings()) -> dict:
    """Takes the source's new Parquet files (``source``: a folder or a pattern) until none is left. Returns how many rows were read and written."""
    began, written = time.time(), {"slots": 0, "sets": 0}

    def take(batch: DataFrame, n: int) -> None:
        own = batch.sparkSession
        write(slots(batch, s).withColumn("batch", F.lit(n).cast("long")), f"{out}/slots", "d8", "batch")
        kept = own.read.schema(SLOTS).parquet(f"{out}/slots")
        days = {r["d8"]: r["count"] for r in kept.filter(F.col("batch") == n).groupBy("d8").count().collect()}  # a row for each day of the batch
        if days:
            first = ingest.first_per_band(kept.drop("batch").filter(F.col("d8").isin(list(days))), ("value",))
            write(solved(first, s), f"{out}/sets", "d8")
            written["sets"] += read(own, out, s).filter(F.col("d8").isin(list(days))).count()
        written["slots"] += sum(days.values())
        common.LOG.info("batch %d: %d slots of %d days", n, sum(days.values()), len(days))

    rows = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", s.files_per_batch).parquet(source)
    query = rows.writeStream.foreachBatch(take).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    taken = sum(p["numInputRows"] for p in query.recentProgress)
    return common.record(spark, out, "observations", source, began, taken, written)


def write(rows: DataFrame, path: str, *by: str) -> None:
    """Only the partitions that the rows have are replaced; a large day is split, small ones share a task."""
    rows.hint("rebalance", by[0]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read(spark: SparkSession, out: str, s: Settings = Settings()) -> DataFrame:
    """The sets as they stand."""
    return spark.read.schema(sets_schema(spark, s)).parquet(f"{out}/sets")


def main(argv: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="jobs.observations", description="New records of raw files to solved band sets.")
    parser.add_argument("source", help="folder or pattern of Parquet files of records")
    parser.add_argument("out")
    parser.add_argument("--config", help="JSON file of settings")
    a = parser.parse_args(argv)
    common.logging_to_console()
    s = common.settings(Settings, a.config)
    spark = SparkSession.builder.appName("observations").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(spark, a.source, a.out, s)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
