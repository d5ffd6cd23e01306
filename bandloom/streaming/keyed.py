"""Band sets of a stream by keyed state: a set leaves as soon as it is whole, an incomplete one when its time has passed.

State is a row for each open bucket: the first file of each band, and whether the set has left. It goes when the watermark
has passed the bucket's end, and Spark drops rows that come later than that, so a set never leaves twice, and state is
bounded by the buckets between the watermark and now. Repeated rows, and rows of a set that has left, are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Where keyed state lives; the session needs it before the query starts.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OPEN, LEFT = 0, 1


def schema_of(bands: list[int]) -> str:
    return "bucket long, complete boolean, lacking array<int>, " + ", ".join(f"w{w} string" for w in bands)


class Assembler(StatefulProcessor):
    """Rows of a bucket (start in microseconds) to its set."""

    def __init__(self, bands: list[int], cadence: int):
        self.bands, self.cadence = bands, cadence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        slots = ", ".join(f"t{w} long, w{w} string" for w in self.bands)
        self.state = handle.getValueState("slots", f"state int, {slots}")

    def row(self, start: int, slots: dict[int, tuple[int, str]]) -> pd.DataFrame:
        lacking = [w for w in self.bands if w not in slots]
        return pd.DataFrame({"bucket": [start], "complete": [not lacking], "lacking": [lacking], **{f"w{w}": [slots[w][1] if w in slots else None] for w in self.bands}})

    def held(self) -> tuple[int, dict[int, tuple[int, str]]]:
        got = self.state.get() if self.state.exists() else None
        if got is None:
            return OPEN, {}
        pairs = zip(self.bands, got[1::2], got[2::2], strict=True)
        return got[0], {w: (t, f) for w, t, f in pairs if f is not None}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start = int(key[0])
        known = self.state.exists()
        left, slots = self.held()
        if not known:
            self.handle.registerTimer((start + self.cadence * 1_000_000) // 1000)
        for part in rows:
            if left == LEFT:
                continue
            for w, t, f in zip(part["wavelength"], part["at"], part["filepath"], strict=True):
                own = (int(t), f)
                slots[int(w)] = min(slots.get(int(w), own), own)
        if left == OPEN and len(slots) == len(self.bands):
            left = LEFT
            yield self.row(start, slots)
            slots = {}
        flat = [x for w in self.bands for x in slots.get(w, (None, None))]
        self.state.update((left, *flat))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        left, slots = self.held()
        self.state.clear()
        if left == OPEN:
            yield self.row(int(key[0]), slots)

    def close(self) -> None:
        pass


def keyed_bandsets(rows: DataFrame, bands: list[int], cadence: int = 12, late: str = "1 minute") -> DataFrame:
    """bucket_start, complete, lacking and the path of each band, of streamed rows (timestamp_utc, wavelength, filepath).

    Within what a set had when it left, a band's file is the first by time and path. Rows without a time or path, and of
    other bands, are left out. The session needs :data:`PROVIDER`.
    """
    at = F.unix_micros("timestamp_utc")
    start = F.floor(at / (cadence * 1_000_000)) * (cadence * 1_000_000)
    some = rows.filter(F.col("wavelength").isin(bands) & F.col("filepath").isNotNull() & F.col("timestamp_utc").isNotNull()).withWatermark("timestamp_utc", late)
    keyed = some.select("timestamp_utc", start.cast("long").alias("bucket"), F.col("wavelength").cast("int").alias("wavelength"), at.alias("at"), "filepath")
    sets = keyed.groupBy("bucket").transformWithStateInPandas(Assembler(bands, cadence), schema_of(bands), "append", "eventTime")
    return sets.select(F.timestamp_micros("bucket").alias("bucket_start"), "complete", "lacking", *(f"w{w}" for w in bands))


class with_provider:  # noqa: N801
    """The session with keyed state's store while a query runs, and as it was afterwards."""

    def __init__(self, spark: SparkSession):
        self.spark, self.before = spark, {}

    def __enter__(self) -> SparkSession:
        for k, v in PROVIDER.items():
            self.before[k] = self.spark.conf.get(k, None)
            self.spark.conf.set(k, v)
        return self.spark

    def __exit__(self, *_: object) -> None:
        for k, v in self.before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

