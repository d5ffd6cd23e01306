"""Sessions, timings and facts of a run."""

from __future__ import annotations

import atexit
import os
import platform
import sys
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder's path where all executors can write and read: below the checkpoint folder, or in this machine's temporary folder if all tasks run here. It goes when the driver ends, unless it is to be kept."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="bandloom-")
    path = f"{shared}/{name}-{uuid.uuid4().hex}"
    if not keep:
        if not _SCRATCH:
            atexit.register(_sweep)
        _SCRATCH.append((spark, path))
    return path


def _sweep() -> None:
    for spark, path in _SCRATCH:
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001  (the session has ended before)
            return


def put(path: str, content: bytes) -> None:
    """A file on any store that Arrow knows: under its name only when it is whole, so a task that is killed leaves no half of it."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    store.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(content)
    store.move(part, at)


SECTION = "section string, seconds double, status string"


def session(name: str = "bandloom", **conf: str) -> SparkSession:
    """A session with UTC time, adaptive plans and one BLAS thread in each Python worker; ``conf`` with ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    ours = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.executorEnv.OMP_NUM_THREADS": "1", "spark.executorEnv.OPENBLAS_NUM_THREADS": "1"}
    for k, v in (ours | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    return builder.getOrCreate()


def environment(spark: SparkSession) -> dict[str, str]:
    """Versions, host and the session's settings that shape a run."""
    keys = ("spark.master", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.executor.memory", "spark.sql.execution.arrow.maxRecordsPerBatch")
    return {"python": sys.version.split()[0], "spark": spark.version, "host": platform.node(), "system": platform.platform(), "cpus": str(os.cpu_count()), **{k: spark.conf.get(k, None) or "" for k in keys}}


class Sections:
    """Named spans of a run, each the job group of what runs in it, so the UI and the event log show them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []

    @contextmanager
    def __call__(self, name: str) -> Iterator[None]:
        began, status = time.perf_counter(), "failed"
        self.spark.sparkContext.setJobGroup(name, name)
        try:
            yield
            status = "ok"
        finally:
            self.rows.append((name, time.perf_counter() - began, status))

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, SECTION)


def time_query(spark: SparkSession, make: Callable[[], DataFrame], repeats: int = 3, warm_up: int = 1) -> DataFrame:
    """repeat and seconds of a query whose rows all are made and none kept; warm-ups don't count."""
    out = []
    for i in range(warm_up + repeats):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        if i >= warm_up:
            out.append((i - warm_up, time.perf_counter() - began))
    return spark.createDataFrame(out, "repeat int, seconds double")


WORKERS = "worker string, host string, cores int, active_tasks int, done_tasks int, failed_tasks int, total_tasks int, run_ms long, gc_ms long, input_bytes long, shuffle_read_bytes long, shuffle_write_bytes long, memory_used long, memory_max long"


def worker_snapshot(spark: SparkSession) -> DataFrame:
    """A row for each executor, and the driver: its tasks, time, bytes and storage memory so far, from Spark's own status store."""
    found, rows = spark._jsc.sc().statusStore().executorList(False), []
    for i in range(found.size()):
        x = found.apply(i)
        rows.append((x.id(), x.hostPort(), x.totalCores(), x.activeTasks(), x.completedTasks(), x.failedTasks(), x.totalTasks(), x.totalDuration(), x.totalGCTime(), x.totalInputBytes(), x.totalShuffleRead(), x.totalShuffleWrite(), x.memoryUsed(), x.maxMemory()))
    return spark.createDataFrame(rows, WORKERS)
