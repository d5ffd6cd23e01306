"""The jobs as queries over the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.functions import pixels
from bandloom.plans import solver_sql
from bandloom.plans.catalogue import log_of, log_sum, r
from bandloom.runtime import scratch
from bandloom.sources.tables import union_rows

from . import observations, text_manifest


def twice(spark: SparkSession, run: Callable[..., dict], source: str, name: str) -> str:
    """The folder of two runs over the same source."""
    out = scratch(spark, name, keep=True)
    for _ in range(2):
        run(spark, source, out)
    return out


def job1_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of raw files, to solved sets of their five kinds, hour by hour."""
    s = observations.Settings()
    sets = observations.read(spark, twice(spark, observations.run, f"{sf_dir}/events.parquet*", "job1"), s)
    elogt = F.aggregate("elogt", F.lit(0.0), lambda a, v: a + v)
    return sets.select(
        "d8", "bucket", "n_bands", "complete", F.array_join("lacking", ",").alias("lacking"), *(f"w{w}" for w in s.wavelengths), F.coalesce("valid", F.lit(False)).alias("valid"), r("chisq").alias("chisq"),
        log_of(pixels.total_em(F.col("dem"))).alias("log_em"), log_sum("edem").alias("log_edem"), r(elogt).alias("elogt_sum"),
    )


def observations_sql() -> str:
    s = observations.Settings()
    of = ", ".join(f"max(CASE WHEN w = {w} THEN f END) AS w{w}, max(CASE WHEN w = {w} THEN v END) AS v{w}" for w in s.wavelengths)
    bands = " ".join(f"WHEN '{k}' THEN {w}" for k, w in s.bands.items())
    values = ", ".join(f"CASE WHEN isfinite(v{w}) AND v{w} > 0 THEN v{w} ELSE 0.0 END" for w in s.wavelengths)
    lacking = "concat_ws(',', " + ", ".join(f"CASE WHEN w{w} IS NULL THEN '{w}' END" for w in s.wavelengths) + ")"
    log = lambda v: f"CASE WHEN list_sum({v}) > 0 THEN round(log10(list_sum({v})), 5) END"
    pixels_sql = f"SELECT row_number() OVER (ORDER BY d8, bucket) AS id, d8, bucket, dn, list_transform(dn, lambda v: sqrt(v + 1)) AS edn FROM (SELECT d8, bucket, [{values}] AS dn FROM st WHERE n_bands = {len(s.bands)})"
    return f"""WITH RECURSIVE rw AS (SELECT ts AS t, CASE event_type {bands} END AS w, CAST(event_id AS VARCHAR) AS f, value AS v, strftime(ts, '%Y%m%d') AS d8, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || '_00_00' AS bucket FROM events),
    fs AS (SELECT d8, bucket, w, arg_min(f, (t, f)) AS f, arg_min(v, (t, f)) AS v FROM rw WHERE w IS NOT NULL GROUP BY 1, 2, 3),
    st AS (SELECT d8, bucket, CAST(count(*) AS INTEGER) AS n_bands, {of} FROM fs GROUP BY 1, 2),
    {solver_sql.solution(pixels_sql, s.calibration(), s.options())}
    SELECT st.d8, st.bucket, n_bands, n_bands = {len(s.bands)} AS complete, {lacking} AS lacking, {", ".join(f"w{w}" for w in s.wavelengths)}, coalesce(valid, false) AS valid, round(chisq, 6) AS chisq,
    {log("list_transform(dem, lambda v: greatest(v, 0.0))")} AS log_em, {log("edem")} AS log_edem, round(list_sum(elogt), 6) AS elogt_sum
    FROM st LEFT JOIN px0 ON px0.d8 = st.d8 AND px0.bucket = st.bucket LEFT JOIN sol ON sol.id = px0.id"""


def job2_text_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, with copies, volumes and sections as rows of their own; whole numbers, which not all rows have, as text."""
    out = twice(spark, text_manifest.run, f"{sf_dir}/documents.parquet", "job2")
    sets = [text_manifest.read(spark, out, name).withColumn("dataset", F.lit(name)) for name in text_manifest.SCHEMAS]
    rows = union_rows(sets).withColumn("mean", r("mean", 4))
    return rows.select(*(F.col(c).cast("string").alias(c) if kind in ("bigint", "boolean") else F.col(c) for c, kind in rows.dtypes))


RANKED = "(list(n_bytes ORDER BY n_bytes))[CAST(round_even({} * (count(*) - 1), 0) AS BIGINT) + 1]"
TEXT_MANIFEST_SQL = f"""WITH f AS (SELECT doc_id AS id, CAST(strlen(text) AS BIGINT) AS n_bytes, length(text) AS stated, md5(text) AS hash_md5, sha256(text) AS hash_sha256, coalesce(length(text) = n_chars, false) AS as_stated, nullif(lang, '') AS lang, nullif(source, '') AS source FROM documents),
  l AS (SELECT DISTINCT coalesce(CAST(id // 1000 AS VARCHAR), 'none-' || coalesce(hash_sha256[1:3], '')) AS volume, coalesce(CAST(id AS VARCHAR), '-') || ' ' || coalesce(hash_sha256, '-') AS line FROM f),
  v AS (SELECT volume, count(*) AS n_files, string_agg(line, chr(10) ORDER BY line) || chr(10) AS lines FROM l GROUP BY 1)
SELECT * REPLACE (CAST(id AS VARCHAR) AS id, CAST(n_bytes AS VARCHAR) AS n_bytes, CAST(n_chars AS VARCHAR) AS n_chars, CAST(as_stated AS VARCHAR) AS as_stated, CAST(first_id AS VARCHAR) AS first_id, CAST(n_files AS VARCHAR) AS n_files, CAST(count AS VARCHAR) AS count) FROM (SELECT 'files' AS dataset, id, n_bytes, stated AS n_chars, hash_md5, hash_sha256, as_stated, lang, source, NULL::VARCHAR AS digit, NULL::BIGINT AS first_id, NULL::BIGINT AS n_files, NULL::VARCHAR AS volume, NULL::VARCHAR AS sha256, NULL::VARCHAR AS md5, NULL::BIGINT AS count, NULL::DOUBLE AS sum, NULL::DOUBLE AS mean, NULL::DOUBLE AS p50, NULL::DOUBLE AS p95, NULL::DOUBLE AS max FROM f
UNION ALL BY NAME SELECT 'copies' AS dataset, hash_sha256, min(n_bytes) AS n_bytes, min(id) AS first_id, count(*) AS n_files, hash_sha256[1:1] AS digit FROM f WHERE hash_sha256 IS NOT NULL GROUP BY hash_sha256 HAVING count(*) > 1
UNION ALL BY NAME SELECT 'volumes' AS dataset, volume, n_files, sha256(lines) AS sha256, md5(lines) AS md5 FROM v
UNION ALL BY NAME SELECT 'sections' AS dataset, lang, source, count(*) AS count, CAST(sum(n_bytes) AS DOUBLE) AS sum, round(avg(n_bytes), 4) AS mean, CAST({RANKED.format(0.5)} AS DOUBLE) AS p50, CAST({RANKED.format(0.95)} AS DOUBLE) AS p95, CAST(max(n_bytes) AS DOUBLE) AS max FROM f WHERE n_bytes IS NOT NULL GROUP BY lang, source)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_observations": job1_observations, "job2_text_manifest": job2_text_manifest}
ORACLE_SQL = {"job1_observations": " ".join(observations_sql().split()), "job2_text_manifest": " ".join(TEXT_MANIFEST_SQL.split())}
