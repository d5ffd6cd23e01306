"""What jobs share: their config files, logs and the record of each run."""

from __future__ import annotations

import dataclasses
import json
import logging
import time
from typing import TypeVar

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger("bandloom.jobs")
RUN = "job string, source string, started timestamp, seconds double, rows_read long, rows_written map<string, long>"
S = TypeVar("S")


def settings(kind: type[S], path: str | None) -> S:
    """Settings from a JSON file on the driver; what it doesn't name keeps its default, and a name that isn't known is an error."""
    given = {}
    if path:
        with open(path) as f:
            given = json.load(f)
    unknown = set(given) - {x.name for x in dataclasses.fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**given)


def logging_to_console() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)


def record(spark: SparkSession, out: str, job: str, source: str, began: float, read: int, written: dict[str, int]) -> dict:
    """Appends the run to ``out``/runs, and says it in the log."""
    seconds = time.time() - began
    LOG.info("%s read %d rows of %s and wrote %s to %s in %.1f s", job, read, source, written, out, seconds)
    row = spark.createDataFrame([(job, source, began, seconds, read, written)], RUN.replace("timestamp", "double"))
    row.withColumn("started", F.timestamp_seconds("started")).coalesce(1).write.mode("append").json(f"{out}/runs")
    return {"rows_read": read, "rows_written": written}
