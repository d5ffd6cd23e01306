"""Manifests, solutions, run records and their files."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterable
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import MANIFEST


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest in CSV with a header, by its fixed schema; nothing is inferred."""
    return spark.read.csv(path, header=True, schema=MANIFEST, timestampFormat="yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]")


def with_time_fallback(manifest: DataFrame, raw: str = "filepath") -> DataFrame:
    """Rows without a time take it from an ISO stamp or ``YYYYMMDD_HH_MM_SS`` in their path."""
    stamp = F.regexp_extract(raw, r"(\d{8})_(\d{2}_\d{2}_\d{2})", 0)
    return manifest.withColumn("timestamp_utc", F.coalesce("timestamp_utc", F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HH_mm_ss"))))


def build_manifest(files: DataFrame) -> DataFrame:
    """filepath, filesize_bytes, hash_md5, hash_sha256 of ``binaryFile`` rows, in the order of their paths."""
    return files.select(F.col("path").alias("filepath"), F.col("length").alias("filesize_bytes"), F.md5("content").alias("hash_md5"), F.sha2("content", 256).alias("hash_sha256")).orderBy("filepath")


def verify_hashes(files: DataFrame, expected: DataFrame) -> DataFrame:
    """filepath and ok; hashes are compared without regard to case. A file that isn't there is not ok."""
    made = build_manifest(files).select("filepath", F.col("hash_sha256").alias("made"))
    return expected.join(made, "filepath", "left").select("filepath", F.coalesce(F.lower("hash_sha256") == F.lower("made"), F.lit(False)).alias("ok"))


def write_pixels(px: DataFrame, path: str, mode: str = "errorifexists", band: int = 256) -> None:
    """Pixels in Parquet by frame, in order within bands of ``band`` rows that a task writes, so frames, crops and columns are pruned when read."""
    px.repartition(F.col("frame_id"), F.floor(F.col("y") / band)).sortWithinPartitions("frame_id", "y", "x").write.mode(mode).partitionBy("frame_id").parquet(path)


def as_float(solution: DataFrame) -> DataFrame:
    """Doubles as floats, for a sink; solving is in double."""
    cast: list[Column] = [F.col(n).cast(t.replace("double", "float")).alias(n) for n, t in solution.dtypes]
    return solution.select(*cast)


def figures_of(solution: DataFrame) -> dict[str, Column]:
    """What a solution's run reports, as aggregates of the columns that it has: pixels, valid ones, least and largest dem, mean total of dem and mean chisq over numbers."""
    total = F.aggregate("dem", F.lit(0.0), lambda s, v: s + v)
    number = lambda c: F.when(~F.isnan(c), c)
    found = {
        "n_pixels": ("frame_id", F.count(F.lit(1))), "n_valid": ("valid", F.count_if("valid")), "dem_min": ("dem", F.min(F.array_min("dem"))), "dem_max": ("dem", F.max(F.array_max("dem"))),
        "em_mean": ("dem", F.avg(number(total))), "chisq_mean": ("chisq", F.avg(number(F.col("chisq")))),
    }
    kinds = dict(solution.dtypes)
    return {k: made for k, (needs, made) in found.items() if needs in kinds and (needs != "dem" or kinds[needs].startswith("array"))}


def observed(rows: DataFrame, figures: dict[str, Column], write: Callable[[DataFrame], None]) -> dict[str, object]:
    """Figures of rows gathered while ``write`` writes them, in the same pass. All null if Spark knows beforehand that there are no rows."""
    seen = Observation()
    write(rows.observe(seen, *(c.alias(k) for k, c in figures.items())))
    try:
        return seen.get
    except (PySparkException, Py4JJavaError):  # the pass was left out, and with it what it reports
        return dict.fromkeys(figures)


def write_solution(solution: DataFrame, path: str, *, meta: dict | None = None, single: bool = True, compression: str = "zstd", mode: str = "errorifexists") -> dict[str, object]:
    """A solution by frame, and its metadata and figures as a JSON row each beside it. Returns :func:`figures_of` what was written; nothing is read or solved again for them."""

    def write(rows: DataFrame) -> None:
        (as_float(rows) if single else rows).write.mode(mode).option("compression", compression).partitionBy("frame_id").parquet(f"{path}/solution")

    found = observed(solution, figures_of(solution), write)
    for name, facts in (("meta", meta), ("figures", found)):
        if meta is not None:
            solution.sparkSession.createDataFrame([(json.dumps(facts, sort_keys=True, default=str),)], "facts string").coalesce(1).write.mode(mode).text(f"{path}/{name}")
    return found


def read_solution(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/solution")


def read_meta(spark: SparkSession, path: str, name: str = "meta") -> dict:
    """The metadata beside a solution, or its ``figures``."""
    return json.loads(spark.read.text(f"{path}/{name}").first()[0])


def stamp() -> str:
    return time.strftime("%Y%m%d_%H%M%S", time.gmtime())


def run_dir(base: str, approach: str, tag: str | None = None, create: bool = True) -> Path:
    """``base/approach/<stamp>_<tag>``; the environment's run folder, if it names one, wins; an existing one is an error."""
    out = Path(os.environ["BANDLOOM_RUN_DIR"]) if os.environ.get("BANDLOOM_RUN_DIR") else Path(base) / approach / (f"{stamp()}_{tag}" if tag else stamp())
    if create:
        out.mkdir(parents=True, exist_ok=False)
    return out


def names_digest(names: Iterable[str]) -> str:
    """SHA-256 of the sorted names, a line each."""
    return hashlib.sha256("".join(f"{n}\n" for n in sorted(names)).encode()).hexdigest()


def append_rows(rows: DataFrame, path: str, form: str = "csv") -> None:
    """Records appended to a folder: concurrent runs don't overwrite each other's parts."""
    rows.coalesce(1).write.mode("append").options(header=True).format(form).save(path)


def union_rows(frames: list[DataFrame]) -> DataFrame:
    """Rows of frames with different columns; what a row lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def run_card(title: str, facts: dict[str, object]) -> str:
    """A run's facts as Markdown."""
    return "\n".join([f"# {title}", "", "| what | value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in facts.items()), ""])


def write_atomic(path: str, text: str) -> None:
    """The text, whole or not at all."""
    part = f"{path}.{os.getpid()}.part"
    with open(part, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
