"""The jobs over growing, failing and odd input."""

import datetime as dt
import hashlib
import json
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import common, observations, text_manifest

ROOT = Path(__file__).resolve().parents[2]
RECORDS = "event_id long, ts timestamp_ntz, event_type string, value double, user string"


def sets(spark, out):
    return sorted(map(str, observations.read(spark, str(out)).select("d8", "bucket", "complete", "lacking", "w94", "w131", "w171", "w193", "w211", "values", "chisq", "dem").collect()))


def put(rows, folder, name):
    rows.coalesce(1).write.parquet(f"{folder}/.{name}")
    part = next(Path(f"{folder}/.{name}").glob("part-*.parquet"))
    part.rename(f"{folder}/{name}.parquet")


def test_only_new_files_are_taken_and_days_stay_right(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    first, second = events.filter("event_id % 3 < 2"), events.filter("event_id % 3 = 2").unionByName(events.filter("event_id % 10 = 0"))  # late ones, and some again
    put(first.filter("event_id % 2 = 0"), tmp_path / "in", "a")
    put(first.filter("event_id % 2 = 1"), tmp_path / "in", "b")
    ran = observations.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", observations.Settings(files_per_batch=1))  # two batches that share days
    assert ran["rows_read"] == first.count() and spark.read.parquet(f"{tmp_path}/out/slots").select("batch").distinct().count() == 2
    before = sets(spark, tmp_path / "out")
    put(second, tmp_path / "in", "c")
    ran = observations.run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert ran["rows_read"] == second.count()  # and nothing of the first two files
    observations.run(spark, f"{data}/events.parquet*", f"{tmp_path}/whole")
    whole = sets(spark, tmp_path / "whole")
    assert sets(spark, tmp_path / "out") == whole != before
    ran = observations.run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert ran == {"rows_read": 0, "rows_written": {"slots": 0, "sets": 0}} and sets(spark, tmp_path / "out") == whole
    assert [r["rows_read"] for r in spark.read.json(f"{tmp_path}/out/runs").orderBy("started").collect()] == [first.count(), second.count(), 0]


def test_a_day_that_nothing_new_touches_is_not_written(spark, tmp_path):
    day = lambda d: [(i, dt.datetime(2024, 1, d, 5, i), k, 3.0 + i, "u") for i, k in enumerate(observations.Settings().bands)]
    put(spark.createDataFrame(day(1), RECORDS), tmp_path / "in", "a")
    observations.run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    kept = sorted((tmp_path / "out/sets/d8=20240101").glob("part*"))
    put(spark.createDataFrame(day(2), RECORDS), tmp_path / "in", "b")
    observations.run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert sorted((tmp_path / "out/sets/d8=20240101").glob("part*")) == kept
    assert observations.read(spark, f"{tmp_path}/out").filter("complete AND valid").count() == 2


@pytest.mark.parametrize("fails", ["slots", "sets"])
def test_a_run_that_failed_is_taken_up_again(spark, data, tmp_path, monkeypatch, fails):
    put(spark.read.parquet(f"{data}/events.parquet"), tmp_path / "in", "a")
    write = observations.write

    def once(rows, path, *by):
        write(rows, path, *by)
        if path.endswith(fails):
            raise OSError("the machine went away")

    monkeypatch.setattr(observations, "write", once)
    with pytest.raises(Exception, match="went away"):
        observations.run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    monkeypatch.setattr(observations, "write", write)
    observations.run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    observations.run(spark, f"{tmp_path}/in", f"{tmp_path}/whole")
    assert sets(spark, tmp_path / "out") == sets(spark, tmp_path / "whole")


def test_odd_records(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 5)
    kinds = list(observations.Settings().bands)
    rows = [(1, None, "click", 1.0, "u"), (None, at, "click", 1.0, "u"), (2, at, "other", 1.0, "u"), (3, at, None, 1.0, "u")]
    rows += [(10 + i, at, k, v, "u") for i, (k, v) in enumerate(zip(kinds, [None, float("nan"), float("inf"), -1.0, 5.0], strict=True))]
    rows += [(10, at, kinds[0], 7.0, "u"), (100, at, kinds[4], 8.0, "u"), (20, at + dt.timedelta(hours=1), kinds[0], 8.0, "u")]
    put(spark.createDataFrame(rows, RECORDS), tmp_path / "in", "a")
    assert observations.run(spark, f"{tmp_path}/in", f"{tmp_path}/out")["rows_written"] == {"slots": 6, "sets": 2}
    got = {r["bucket"]: r for r in observations.read(spark, f"{tmp_path}/out").collect()}
    assert (got["05_00_00"]["complete"], got["05_00_00"]["valid"], got["05_00_00"]["w211"], got["05_00_00"]["values"][0]) == (True, False, "100", None)
    assert (got["06_00_00"]["lacking"], got["06_00_00"]["valid"], got["06_00_00"]["dem"]) == ([131, 171, 193, 211], None, None)
    (tmp_path / "empty").mkdir()
    assert observations.run(spark, f"{tmp_path}/empty", f"{tmp_path}/none") == {"rows_read": 0, "rows_written": {"slots": 0, "sets": 0}}
    put(spark.createDataFrame([], RECORDS), tmp_path / "empty", "a")
    assert observations.run(spark, f"{tmp_path}/empty", f"{tmp_path}/none")["rows_written"] == {"slots": 0, "sets": 0}


def test_the_time_zone_of_the_session_changes_nothing(spark, data, tmp_path):
    observations.run(spark, f"{data}/events.parquet*", f"{tmp_path}/utc")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        observations.run(spark, f"{data}/events.parquet*", f"{tmp_path}/west")
        west = sets(spark, tmp_path / "west")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert west == sets(spark, tmp_path / "utc")


TEXTS = "doc_id long, text string, lang string, source string, n_chars long, id int, volume string"


def held(spark, out):
    return {name: sorted(map(str, text_manifest.read(spark, str(out), name).collect())) for name in text_manifest.SCHEMAS}


def test_manifest_equals_plain_python(spark, tmp_path):
    rows = [(i, f"text {i % 7} é", "en" if i % 3 else "de", f"s{i % 2}", 8 if i % 5 else 9, 1, "x") for i in range(40)]
    rows += [(None, None, None, "", 0, 1, "x"), (None, "", "", None, 0, 1, "x"), (5000, "long " * 50_000, "en", "s0", None, 1, "x"), (5000, "long " * 50_000, "en", "s0", None, 1, "x"), (None, "text 1 é", "fr", "s9", 8, 1, "x")]
    spark.createDataFrame(rows, TEXTS).write.parquet(f"{tmp_path}/texts")
    ran = text_manifest.run(spark, f"{tmp_path}/texts", f"{tmp_path}/out")
    assert ran["rows_read"] == len(rows) == ran["rows_written"]["files"]
    digest = lambda t, kind: None if t is None else getattr(hashlib, kind)(t.encode()).hexdigest()
    got = Counter(map(tuple, text_manifest.read(spark, f"{tmp_path}/out", "files").collect()))
    assert got == Counter((i, None if t is None else len(t.encode()), None if t is None else len(t), digest(t, "md5"), digest(t, "sha256"), t is not None and len(t) == n, lang or None, source or None) for i, t, lang, source, n, *_ in rows)
    many = Counter(digest(t, "sha256") for _, t, *_ in rows if t is not None)
    assert {r["hash_sha256"]: r["n_files"] for r in text_manifest.read(spark, f"{tmp_path}/out", "copies").collect()} == {k: n for k, n in many.items() if n > 1}
    lines = {f"{i if i is not None else '-'} {digest(t, 'sha256') or '-'}" for i, t, *_ in rows if i is not None and i < 1000}
    volume = {r["volume"]: r for r in text_manifest.read(spark, f"{tmp_path}/out", "volumes").collect()}
    assert volume["0"]["sha256"] == digest("".join(f"{x}\n" for x in sorted(lines)), "sha256") and volume["5"]["n_files"] == 1
    assert {"none-", f"none-{digest('', 'sha256')[:3]}", f"none-{digest('text 1 é', 'sha256')[:3]}"} <= set(volume)
    sections = {(r["lang"], r["source"]): r for r in text_manifest.read(spark, f"{tmp_path}/out", "sections").collect()}
    assert sections["fr", "s9"]["max"] == 9 and sections["en", "s0"]["max"] == 250_000 and sections[None, None]["count"] == 1


def test_manifest_again_partly_and_empty(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/texts")
    text_manifest.run(spark, f"{tmp_path}/texts", f"{tmp_path}/out")
    first = held(spark, tmp_path / "out")
    text_manifest.run(spark, f"{tmp_path}/texts", f"{tmp_path}/out", text_manifest.Settings(only=["en"]))
    assert held(spark, tmp_path / "out") == first
    docs.withColumn("text", F.when(F.col("lang") == "en", F.upper("text")).otherwise(F.lit("gone"))).write.parquet(f"{tmp_path}/changed")
    text_manifest.run(spark, f"{tmp_path}/changed", f"{tmp_path}/out", text_manifest.Settings(only=["en"]))
    part = held(spark, tmp_path / "out")
    others = lambda x: [r for r in x["files"] if "lang='en'" not in r]
    assert others(part) == others(first) and part != first
    text_manifest.run(spark, f"{tmp_path}/texts", f"{tmp_path}/out")
    assert held(spark, tmp_path / "out") == first
    docs.filter("false").write.parquet(f"{tmp_path}/none")
    text_manifest.run(spark, f"{tmp_path}/none", f"{tmp_path}/out")
    assert not any(held(spark, tmp_path / "out").values())


def test_settings(tmp_path):
    for kind, name in ((observations.Settings, "observations"), (text_manifest.Settings, "text_manifest")):
        assert common.settings(kind, str(ROOT / f"jobs/{name}.json")) == kind() == common.settings(kind, None)
    (tmp_path / "odd.json").write_text(json.dumps({"cadense": 5}))
    with pytest.raises(ValueError, match="cadense"):
        common.settings(observations.Settings, str(tmp_path / "odd.json"))


@pytest.mark.parametrize("job,table", [("observations", "events"), ("text_manifest", "documents")])
def test_command_lines(data, tmp_path, job, table):
    env = os.environ | {"PYTHONPATH": str(ROOT), "PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 --conf spark.sql.warehouse.dir={tmp_path}/w pyspark-shell"}
    call = [sys.executable, "-m", f"jobs.{job}", f"{data}/{table}.parquet" + "*" * (job == "observations"), f"{tmp_path}/out", "--config", str(ROOT / f"jobs/{job}.json")]
    done = subprocess.run(call, env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"{job} read" in done.stderr and (tmp_path / "out/runs").exists()


def test_jobs_keep_to_themselves():
    for path in [*(ROOT / "jobs").glob("*.py")]:
        text = path.read_text()
        assert "bandloom.llm" not in text and "corpus_pipeline" not in text
