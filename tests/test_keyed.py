"""Band sets by keyed state, over several runs of a growing stream."""

import datetime as dt
import random

from bandloom.streaming import keyed

ROWS = "timestamp_utc timestamp, wavelength int, filepath string"
START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def run(spark, folder, bands, late="1 minute"):
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    sets = keyed.keyed_bandsets(stream, bands, 12, late)
    with keyed.with_provider(spark):
        sets.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sorted(((int((r["bucket_start"] - START).total_seconds()), r["complete"], tuple(r["lacking"]), *(r[f"w{w}"] for w in bands)) for r in spark.read.schema(sets.schema).parquet(f"{folder}/out").collect()), key=str)


def put(spark, folder, rows):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_whole_sets_leave_at_once_and_once(spark, tmp_path):
    put(spark, tmp_path, [(at(1), 94, "b"), (at(0), 94, "a"), (at(3), 131, "c"), (at(13), 94, "d"), (at(2), 7, "other"), (None, 94, "x"), (at(2), 131, None)])
    assert run(spark, tmp_path, [94, 131]) == [(0, True, (), "a", "c")]  # though no time has passed
    put(spark, tmp_path, [(at(0), 94, "0"), (at(0), 131, "0"), (at(1), 94, "b")])  # earlier files of a set that has left, and one again
    assert run(spark, tmp_path, [94, 131]) == [(0, True, (), "a", "c")]
    put(spark, tmp_path, [(at(500), 131, "late")])
    assert run(spark, tmp_path, [94, 131]) == [(0, True, (), "a", "c"), (12, False, (131,), "d", None)]
    put(spark, tmp_path, [(at(14), 131, "too late"), (at(0), 94, "too late"), (at(501), 94, "e")])  # what comes behind the watermark opens nothing
    assert run(spark, tmp_path, [94, 131]) == [(0, True, (), "a", "c"), (12, False, (131,), "d", None), (492, True, (), "e", "late")]


def test_any_order_gives_the_same_sets(spark, tmp_path):
    rng = random.Random(3)
    rows = [(at(12 * b + rng.randrange(12)), w, f"{b}-{w}") for b in range(20) for w in (94, 131, 171) if rng.random() < 0.8]
    expected = sorted(((12 * b, len(own) == 3, tuple(w for w in (94, 131, 171) if w not in own), *(own.get(w) for w in (94, 131, 171))) for b in range(20) if (own := {w: f for t, w, f in rows if f.startswith(f"{b}-")})), key=str)
    again = rows + rng.sample(rows, 15)
    rng.shuffle(again)
    for k in range(3):
        put(spark, tmp_path, again[k::3])
    put(spark, tmp_path, [(at(9000), 94, "later")])
    assert run(spark, tmp_path, [94, 131, 171], "10 minutes") == expected
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with keyed.with_provider(spark):
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
