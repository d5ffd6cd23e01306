"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: What the contracts call white space: the six ASCII white-space bytes, which
#: are also the ones that ``bytes.split()`` splits on.
ASCII_SPACE = "[\\x20\\x09-\\x0D]"


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and, where known, bytes.

    Whole texts travel in these batches, so the default of 10,000 rows would
    let a few long documents fill a worker's memory.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    except Exception:  # noqa: BLE001  (older Spark doesn't know this setting)
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. A folder of this machine's is set only where there is none and all tasks run in this process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="bandloom-checkpoint-"))
    return sc.getCheckpointDir()


_TABLES: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: lineage ends, columns can be pruned. It goes when the driver ends."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written``, and where it lies, for tables that are to be forgotten before."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _TABLES:
        atexit.register(_forget)
    _TABLES.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Removes a written table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if (spark, path) in _TABLES:
        _TABLES.remove((spark, path))


def sweep(spark: SparkSession) -> None:
    """Spark removes shuffled files when the driver's collector finds that nothing refers to them, which may be much later than they end."""
    gc.collect()
    spark._jvm.System.gc()


def _forget() -> None:
    for spark, path in list(_TABLES):
        try:
            forget(spark, path)
        except Exception:  # noqa: BLE001  (the session has ended before)
            return


def strings(column: pa.Array) -> list[str]:
    """The column's texts; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def place_of(names: list[str], name: str | None) -> int | None:
    """Where a column is, as Spark finds it: the case of letters doesn't matter."""
    return next((i for i, x in enumerate(names) if name is not None and x.lower() == name.lower()), None)


def free_prefix(names: list[str]) -> str:
    """What none of the names begins with, for columns of an operator's own."""
    prefix = "__"
    while any(x.lower().startswith(prefix) for x in names):
        prefix += "_"
    return prefix


def small_batches(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def quietly(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task without the cycle collector, which walks millions of remembered strings and lists and finds nothing to free."""

    @functools.wraps(run)
    def quiet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return quiet


def places(found: list) -> list[int]:
    """Where the list has None; few places in long lists, so the list itself looks for them."""
    out, j = [], -1
    try:
        while True:
            j = found.index(None, j + 1)
            out.append(j)
    except ValueError:
        return out


_HELD: dict[str, Callable[[], object]] = {}


def hold(owner: str, clear: Callable[[], object]) -> None:
    """A task tells what this worker is about to remember, and how to forget it; what others have it remember goes.

    Spark keeps Python workers from one stage to the next, and without this a worker would hold the memory of each.
    """
    for other in [k for k in _HELD if k != owner]:
        _HELD.pop(other)()
    _HELD[owner] = clear
