"""The manifest of delivered texts: sizes and digests, checks, copies, digests of volumes, and sizes by section.

Texts are read once. Everything else follows from the manifest's few columns:

* ``<out>/files``: a row for each text: its id, size in bytes and characters, MD5 and SHA-256, and whether the size is the
  one that the delivery states, by section (language and source);
* ``<out>/copies``: each content that more than one row has: the first id and how many rows;
* ``<out>/volumes``: for each run of ids, the digest of its sorted names and digests, by which two sites compare holdings;
* ``<out>/sections``: count, sum, mean, median, 95th percentile and largest size of each section;
* ``<out>/runs``: what each run read and wrote.

With ``only``, a run takes these languages alone and replaces their sections; the rest follows from all that is held.
Every run replaces what it writes, so running again gives the same.

Edge cases: a null text has no size and digests, is not as stated, is nobody's copy and counts in no section; an empty
one has the size 0; rows that repeat are listed each, and once in a volume; null ids lie in volumes of their own by
digest; a null or empty language or source is null; an empty table gives empty outputs; other columns aren't read.
"""

from __future__ import annotations

import argparse
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.operators import ingest, summaries

from . import common

SECTION = ("lang", "source")
SCHEMAS = {
    "files": "id long, n_bytes long, n_chars long, hash_md5 string, hash_sha256 string, as_stated boolean, lang string, source string",
    "copies": "hash_sha256 string, n_bytes long, first_id long, n_files long, digit string",
    "volumes": "n_files long, sha256 string, md5 string, volume string",
    "sections": "count long, sum double, mean double, p50 double, p95 double, max double, lang string, source string",
}
BY = {"files": SECTION, "copies": ("digit",), "volumes": (), "sections": ("lang",)}


@dataclass(frozen=True)
class Settings:
    """Columns of the texts, ids in a volume, and languages to take (all without any)."""

    id: str = "doc_id"
    text: str = "text"
    stated_chars: str = "n_chars"
    lang: str = "lang"
    source: str = "source"
    volume: int = 1000
    only: list[str] = field(default_factory=list)


def files(texts: DataFrame, s: Settings) -> DataFrame:
    """The manifest's rows."""
    text, stated = F.col(s.text), F.col(s.stated_chars)
    rows = texts.filter(F.col(s.lang).isin(s.only)) if s.only else texts
    raw = F.encode(text, "UTF-8")
    section = [F.when(F.col(c) != "", F.col(c)).alias(name) for c, name in ((s.lang, "lang"), (s.source, "source"))]
    return rows.select(
        F.col(s.id).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.length(text).cast("long").alias("n_chars"), F.md5(raw).alias("hash_md5"), F.sha2(raw, 256).alias("hash_sha256"),
        F.coalesce(F.length(text) == stated, F.lit(False)).alias("as_stated"), *section,
    )


def copies(held: DataFrame) -> DataFrame:
    """Contents of more than one row; sums are made where the rows lie, so a frequent content is one row of a task."""
    same = held.filter("hash_sha256 IS NOT NULL").groupBy("hash_sha256").agg(F.first("n_bytes").alias("n_bytes"), F.min("id").alias("first_id"), F.count("*").alias("n_files"))
    return same.filter("n_files > 1").withColumn("digit", F.substring("hash_sha256", 1, 1))


def volumes(held: DataFrame, size: int) -> DataFrame:
    """A digest for each run of ``size`` ids."""
    run = F.when(F.col("id").isNotNull(), F.floor(F.col("id") / size).cast("string")).otherwise(F.concat(F.lit("none-"), F.coalesce(F.substring("hash_sha256", 1, 3), F.lit(""))))
    line = F.concat_ws(" ", F.coalesce(F.col("id").cast("string"), F.lit("-")), F.coalesce("hash_sha256", F.lit("-")))
    return ingest.names_hash(held.select(run.alias("volume"), line.alias("line")).distinct(), "line", ["volume"])


def sections(held: DataFrame) -> DataFrame:
    return summaries.nearest_rank(held.withColumn("n_bytes", F.col("n_bytes").cast("double")), list(SECTION), "n_bytes")


def write(rows: DataFrame, out: str, name: str, only: list[str] | None = None) -> int:
    """Writes a data set in the order of its schema and returns how many rows. With ``only``, just its own partitions are replaced."""
    columns = [x.split()[0] for x in SCHEMAS[name].split(", ")]
    kept = rows.select(*columns).hint("rebalance", *BY[name])
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if only else "static").partitionBy(*BY[name]).parquet(f"{out}/{name}")
    made = read(rows.sparkSession, out, name)
    return (made.filter(F.col("lang").isin(only)) if only else made).count()


def run(spark: SparkSession, source: str, out: str, s: Settings = Settings()) -> dict:
    """Reads the texts of ``source`` (Parquet) and writes all data sets. Returns how many rows were read and written."""
    began = time.time()
    written = {"files": write(files(spark.read.parquet(source), s), out, "files", s.only)}
    held = read(spark, out, "files")
    for name, made in (("copies", copies(held)), ("volumes", volumes(held, s.volume)), ("sections", sections(held))):
        written[name] = write(made, out, name)
    return common.record(spark, out, "text_manifest", source, began, written["files"], written)


def read(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{out}/{name}")


def main(argv: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="jobs.text_manifest", description="The manifest of delivered texts.")
    parser.add_argument("source", help="Parquet table of texts")
    parser.add_argument("out")
    parser.add_argument("--config", help="JSON file of settings")
    a = parser.parse_args(argv)
    common.logging_to_console()
    s = common.settings(Settings, a.config)
    spark = SparkSession.builder.appName("text_manifest").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(spark, a.source, a.out, s)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
