"""Queries that go through files: what a writer made is read again, and the SQL says what should be in it.

Files lie in a new folder for each query, where all executors can write.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import calibration as C
from ..operators import ingest as I
from ..operators import instruments as N
from ..operators import inversion as V
from ..operators import selection as S
from ..operators import sketches
from ..runtime import scratch
from ..sources import fits, npz, stacks, tables
from ..streaming import assembly, keyed
from . import catalogue as K
from . import views as W
from .catalogue import query, r


def stacked(spark, d) -> str:
    """The folder of stacks of two frames, of even and odd vectors."""
    path = scratch(spark, "stacks")
    px = W.px(spark, d).withColumn("frame_id", F.concat(F.lit("f"), F.col("vec_id") % 2))
    npz.write_stacks(px, path).count()
    return path


HALVES = f"WITH {K.PB}, hv AS (SELECT 'f' || CAST(vec_id % 2 AS VARCHAR) AS frame_id, y, x, band, round(dn, 6) AS dn FROM pb)"


def filled(px):
    """Pixels that hold something, by band; a stack has zeros where no vector is."""
    return px.filter(F.exists("dn", lambda v: v > 0)).select("frame_id", "y", "x", F.posexplode("dn").alias("band", "dn")).withColumn("dn", r("dn"))


@query(f"{HALVES} SELECT * FROM hv")
def npz_pixels(spark, d):
    return filled(npz.read_pixels(spark, stacked(spark, d)))


@query(f"{HALVES} SELECT * FROM hv WHERE y < 1 AND x < 8")
def npz_crop(spark, d):
    return filled(npz.read_pixels(spark, stacked(spark, d), crop=(1, 8)))


@query(f"{HALVES} SELECT * FROM hv WHERE frame_id = 'f1' AND y BETWEEN 2 AND 9 AND x < 8")
def stack_source_crop(spark, d):
    """A cut of a frame from the data source, by filters that reach it: only its rows' bytes are asked for."""
    path = scratch(spark, "stacks")
    npz.write_stacks(W.px(spark, d).withColumn("frame_id", F.concat(F.lit("f"), F.col("vec_id") % 2)), path, compressed=False).count()
    return filled(stacks.read(spark, path, pushdown=True, pixelsPerTask=64).filter("frame_id = 'f1' AND y BETWEEN 2 AND 9 AND x < 8"))


@query(f"{HALVES} SELECT * FROM hv")
def stack_source(spark, d):
    """Whole frames, compressed, from the data source."""
    return filled(stacks.read(spark, stacked(spark, d)))


@query(f"{HALVES} SELECT frame_id, max(y) + 1 AS height, max(x) + 1 AS width, 6 AS n_bands, false AS has_calibration FROM hv GROUP BY 1")
def npz_shapes(spark, d):
    return npz.read_frames(spark, stacked(spark, d)).select("frame_id", "height", "width", "n_bands", "has_calibration")


@query(f"{HALVES} SELECT DISTINCT frame_id || '.npz' AS name, false AS again FROM hv")
def npz_listing(spark, d):
    """Files by name, none twice; a folder that isn't there has none, and what is there isn't written again."""
    path = stacked(spark, d)
    px = W.px(spark, d).withColumn("frame_id", F.concat(F.lit("f"), F.col("vec_id") % 2))
    again = npz.write_stacks(px, path).select(F.concat("frame_id", F.lit(".npz")).alias("name"), F.col("written").alias("again"))
    files = npz.listing(spark, path).unionByName(npz.listing(spark, f"{path}-none"), allowMissingColumns=True)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name")).join(again, "name")


@query(f"WITH {K.SAMPLES} SELECT CAST(instrument AS VARCHAR) AS name, i, band, round(logt, 9) AS logt, round(log10(value), 6) AS log_value FROM sm")
def npz_calibration(spark, d):
    """Each instrument's responses written to a file of its own, and read from there."""
    path = scratch(spark, "calibration")
    taken = N.samples(W.instruments(spark, d)).withColumn("name", F.col("instrument").cast("string"))
    npz.write_calibrations(taken, path).count()
    return npz.read_calibrations(spark, path).select("name", "i", "band", r("logt", 9).alias("logt"), r(F.log10("value")).alias("log_value"))


CENTRES = f"""WITH {K.SAMPLES}, pt AS (SELECT instrument, CAST(range AS INTEGER) AS bin, lo + (range + 0.5) * ((hi - lo) / 24) AS x, (hi - lo) / 24 AS w FROM ins, range(24)),
    pc AS (SELECT instrument, band, logt, log10(value) AS y, lead(logt) OVER w AS logt2, lead(log10(value)) OVER w AS y2 FROM sm WINDOW w AS (PARTITION BY instrument, band ORDER BY logt)),
    cv AS (SELECT instrument, bin, band, y + (y2 - y) * (x - logt) / (logt2 - logt) + 15 AS v, x + log10(ln(10.0) * w) AS jac FROM pt JOIN pc USING (instrument) WHERE logt <= x AND x < logt2)"""


def calibrated(spark, d, jacobians: int):
    own = W.instruments(spark, d)
    return N.prepared(own, N.samples(own), K.BY, 24, jacobians).select("instrument", "bin", "band", r(F.log10("value")).alias("log_value"))


@query(f"{CENTRES} SELECT instrument, bin, band, round(v + jac, 6) AS log_value FROM cv")
def calibration_default(spark, d):
    return calibrated(spark, d, 1)


@query(f"{CENTRES} SELECT instrument, bin, band, round(v + 2 * jac, 6) AS log_value FROM cv")
def calibration_double(spark, d):
    return calibrated(spark, d, 2)


@query(f"{CENTRES} SELECT instrument, bin, band, round(v, 6) AS log_value FROM cv")
def calibration_by_bin(spark, d):
    return calibrated(spark, d, 0)


@query(f"WITH {K.GRID} SELECT instrument, bin, b AS band, round(exp(-0.5 * pow((logt - (5.7 + 0.32 * b)) / 0.2, 2)), 9) AS value FROM g, (SELECT CAST(range AS INTEGER) AS b FROM range(6))")
def calibration_legacy(spark, d):
    return N.legacy(K.instrument_grids(spark, d)).select("instrument", "bin", "band", r("value", 9).alias("value"))


@query("SELECT o_orderkey AS nmu, CAST(CASE WHEN o_orderkey > 0 THEN least(greatest(round_even(0.6 * o_orderkey, 0), 8), 64) ELSE 24 END AS INTEGER) AS nt FROM orders")
def bins_for_steps(spark, d):
    return W.table(spark, d, "orders").select(F.col("o_orderkey").alias("nmu"), N.bins_for(F.col("o_orderkey")).alias("nt"))


@query(f"WITH {K.DEM} SELECT vec_id, bin, CAST(CAST(dem AS FLOAT) AS DOUBLE) AS dem, 'nt=6' AS said FROM dm")
def solution_files(spark, d):
    """A solution as floats, and its metadata."""
    path = scratch(spark, "solution")
    rows = W.dem_rows(spark, d).select(F.concat(F.lit("f"), F.col("vec_id") % 3).alias("frame_id"), "vec_id", "dem")
    tables.write_solution(rows, path, meta={"nt": W.NF})
    said = F.lit(f"nt={tables.read_meta(spark, path)['nt']}")
    return tables.read_solution(spark, path).select("vec_id", F.posexplode("dem").alias("bin", "dem"), said.alias("said")).withColumn("dem", F.col("dem").cast("double"))


@query(f"WITH {K.PB} SELECT frame_id, y, x, band, round(dn, 6) AS dn FROM pb")
def pixel_files(spark, d):
    path = scratch(spark, "pixels")
    tables.write_pixels(W.px(spark, d).select("frame_id", "y", "x", "dn"), path)
    rows = spark.read.parquet(path).select(F.col("frame_id").cast("string"), "y", "x", F.posexplode("dn").alias("band", "dn"))
    return rows.withColumn("dn", r("dn"))


@query(f"WITH {K.MAN} SELECT filepath, wavelength, date_trunc('second', timestamp_utc) AS timestamp_utc FROM man WHERE wavelength IN (94, 171)")
def manifest_csv(spark, d):
    path = scratch(spark, "manifest")
    stamp = F.date_format(F.date_trunc("second", "timestamp_utc"), "yyyy-MM-dd\'T\'HH:mm:ss")
    given = {"timestamp_utc": stamp, "wavelength": F.col("wavelength"), "filepath": F.col("filepath")}
    W.manifest(spark, d).select(*(given.get(f.name, F.lit(None).cast("string")).alias(f.name) for f in I.MANIFEST)).write.option("header", True).csv(path)
    return tables.read_manifest(spark, path).filter("wavelength IN (94, 171)").select("filepath", "wavelength", "timestamp_utc")


@query(f"WITH {K.MAN} SELECT filepath, CASE WHEN user_id % 2 = 0 THEN timestamp_utc ELSE date_trunc('second', timestamp_utc) END AS timestamp_utc FROM man")
def time_fallback(spark, d):
    """Rows without a time take it from their path."""
    rows = W.manifest(spark, d).withColumn("raw", F.concat(F.lit("x/"), F.date_format("timestamp_utc", "yyyyMMdd_HH_mm_ss"), F.lit("_"), "filepath"))
    rows = rows.withColumn("timestamp_utc", F.when(F.col("user_id") % 2 == 0, F.col("timestamp_utc")))
    return tables.with_time_fallback(rows, "raw").select("filepath", "timestamp_utc")


#: A file for each kind and day: the ids of its events, a line each.
DAYS = "dy AS (SELECT event_type AS kind, event_type || '/' || strftime(ts, '%Y%m%d') || '.npz' AS name, string_agg(CAST(event_id AS VARCHAR), chr(10) ORDER BY event_id) || chr(10) AS body FROM events GROUP BY 1, 2)"


def days(spark, d):
    rows = W.table(spark, d, "events").groupBy(F.col("event_type").alias("kind"), F.date_format("ts", "yyyyMMdd").alias("d8")).agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    body = F.concat(F.array_join(F.transform("ids", lambda x: x.cast("string")), "\n"), F.lit("\n"))
    return rows.select("kind", F.concat("kind", F.lit("/"), "d8", F.lit(".npz")).alias("name"), F.encode(body, "UTF-8").alias("content"))


@query(f"WITH {DAYS} SELECT name, CAST(strlen(body) AS BIGINT) AS size, md5(body) AS md5, sha256(body) AS sha256, kind <> 'view' AS ok FROM dy")
def file_hashes(spark, d):
    """Files' digests, and whether they are the expected ones, in either case."""
    path = scratch(spark, "files")
    npz.write_files(days(spark, d), path).count()
    files = npz.listing(spark, path, recursive=True)
    made = tables.build_manifest(files)
    name = F.concat_ws("/", F.slice(F.split("filepath", "/"), -2, 2))
    wrong = name.startswith("view/")
    checked = tables.verify_hashes(files, made.select("filepath", F.when(wrong, F.lit("00")).otherwise(F.upper("hash_sha256")).alias("hash_sha256")))
    return made.join(checked, "filepath").select(name.alias("name"), F.col("filesize_bytes").alias("size"), F.col("hash_md5").alias("md5"), F.col("hash_sha256").alias("sha256"), "ok")


@query(f"WITH {DAYS} SELECT 'member' AS what, replace(name, '/', '-') AS name, CAST(strlen(body) AS BIGINT) AS length FROM dy UNION ALL SELECT 'file', replace(name, '/', '-'), CAST(strlen(body) AS BIGINT) FROM dy")
def archive_members(spark, d):
    """An archive for each kind with the files of its days, unpacked flat, and listed again from there."""
    path = scratch(spark, "archives")
    rows = days(spark, d).select(F.concat("kind", F.lit(".zip")).alias("archive"), F.concat(F.lit("deep/er/"), F.translate("name", "/", "-")).alias("name"), "content")
    again = rows.select("archive", F.concat(F.lit("deeper/"), F.substring_index("name", "/", -1)).alias("name"), F.encode(F.lit("the first of a name is kept"), "UTF-8").alias("content"))
    npz.write_archives(rows.unionByName(again).unionByName(rows.select("archive", F.lit("readme.txt").alias("name"), "content").dropDuplicates(["archive"])), path).count()
    made = npz.unpack(spark, path, f"{path}/flat")
    done = scratch(spark, "unpacked")
    made.write.parquet(done)
    there = npz.listing(spark, f"{path}/flat").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    return spark.read.parquet(done).select(F.lit("member").alias("what"), "name", "length").unionByName(there.select(F.lit("file").alias("what"), "name", "length"))


@query("SELECT o_orderkey AS k, o_totalprice AS price, CAST(NULL AS VARCHAR) AS status FROM orders UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders")
def union_by_name(spark, d):
    orders = W.table(spark, d, "orders")
    return tables.union_rows([orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price")), orders.select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("k"))])


@query("SELECT event_type AS mode, CAST(count(*) * 2 AS BIGINT) AS n, round(sum(value) * 2, 4) AS seconds FROM events GROUP BY 1")
def run_records(spark, d):
    """Records appended twice, as CSV, and read again."""
    path = scratch(spark, "records")
    rows = W.table(spark, d, "events").select(F.col("event_type").alias("mode"), F.col("value").alias("seconds"))
    for _ in range(2):
        tables.append_rows(rows, path)
    made = spark.read.csv(path, header=True, schema="mode string, seconds double")
    return made.groupBy("mode").agg(F.count("*").alias("n"), r(F.sum("seconds"), 4).alias("seconds"))


@query(f"WITH {K.PB} SELECT vec_id, CAST(count(*) AS INTEGER) AS n FROM pb GROUP BY 1")
def band_check(spark, d):
    return W.px(spark, d).select("vec_id", F.size(S.has_bands(F.col("dn"))).alias("n"))


@query(K.ORACLE_SQL["lstsq_clip"])
def own_solver(spark, d):
    """A solver of the user's own over batches of pixels."""
    response = np.array(K.RESPONSE)

    def mine(dn, edn):
        dem, _, fit = V.lstsq_clip(dn, response)
        return {"em": dem.sum(axis=1), "residual": fit}

    px = W.px(spark, d).select("vec_id", "dn", F.col("dn").alias("edn"))
    return V.solve_with(px, mine, "em double, residual double").select("vec_id", r("em", 4).alias("em"), r("residual", 2).alias("residual"))


@query(K.ORACLE_SQL["solve_dem"])
def stream_solve(spark, d):
    """Pixels that arrive as a stream of files, solved batch by batch, each batch once."""
    path = scratch(spark, "stream")
    K.pixels(spark, d).select("frame_id", "y", "x", "dn", "edn").repartition(3).write.parquet(f"{path}/in")
    schema = spark.read.parquet(f"{path}/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    assembly.solve_stream(stream, C.default(), lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/batch={n}"), f"{path}/checkpoint").awaitTermination()
    return K.flat(spark.read.parquet(f"{path}/out"), K.grid())


@query(
    f"""WITH {K.MAN}, hr AS (SELECT date_trunc('hour', timestamp_utc) AS bucket_start, {", ".join(f"max(CASE WHEN wavelength = {w} THEN 1 END) AS h{w}" for w in W.BANDS.values())} FROM man WHERE wavelength IS NOT NULL GROUP BY 1)
    SELECT bucket_start, {" AND ".join(f"h{w} IS NOT NULL" for w in W.BANDS.values())} AS complete, concat_ws(',', {", ".join(f"CASE WHEN h{w} IS NULL THEN '{w}' END" for w in W.BANDS.values())}) AS lacking FROM hr"""
)
def keyed_bandsets(spark, d):
    """Sets that leave once, whole as soon as they are, else when their time has passed, from files in any order with late and repeated rows."""
    path = scratch(spark, "keyed")
    rows = W.manifest(spark, d).select("timestamp_utc", "wavelength", "filepath")
    day, k = F.dayofmonth("timestamp_utc"), F.xxhash64("filepath")
    # thirds of a month; a tenth comes in the file after its own, a twentieth comes in every file, in no order
    third = F.least(F.floor((day - 1) / 10), F.lit(2)).cast("int")
    own = F.when(F.pmod(k, F.lit(10)) == 0, F.array(third + 1)).when(F.pmod(k, F.lit(20)) == 1, F.sequence(third, F.lit(3))).otherwise(F.array(third))
    later = rows.agg((F.max("timestamp_utc") + F.expr("interval 90 days")).alias("timestamp_utc")).select("timestamp_utc", F.lit(94).alias("wavelength"), F.lit("later").alias("filepath"), F.lit(4).alias("part"))
    parts = rows.withColumn("part", F.explode(own)).unionByName(later)
    for i in range(5):
        parts.filter(F.col("part") == i).drop("part").orderBy(F.xxhash64("filepath")).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema("timestamp_utc timestamp, wavelength int, filepath string").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    sets = keyed.keyed_bandsets(stream, list(W.BANDS.values()), 3600, "25 days")
    with keyed.with_provider(spark):
        sets.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(sets.schema).parquet(f"{path}/out").select("bucket_start", "complete", F.array_join("lacking", ",").alias("lacking"))


@query(
    """WITH v AS (SELECT l_returnflag AS flag, l_extendedprice AS x FROM lineitem)
    SELECT flag, count(*) AS n, round(quantile_cont(x, 0.01), 6) AS p1, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.99), 6) AS p99 FROM v GROUP BY 1"""
)
def stored_sketches(spark, d):
    """Sketches by month, stored, merged over months, and made exact by one pass over the values."""
    path = scratch(spark, "sketches")
    rows = W.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.date_format("l_shipdate", "yyyyMM").alias("month"), F.col("l_extendedprice").alias("x"))
    sketches.sketched(rows, ["flag", "month"], "x").write.partitionBy("month").parquet(path)
    whole = sketches.merged(spark.read.parquet(path), ["flag"])
    made = sketches.exact(rows, whole, ["flag"], "x", {"p1": 0.01, "p50": 0.5, "p99": 0.99})
    return whole.select("flag", "n").join(made, "flag").select("flag", "n", *(r(c).alias(c) for c in ("p1", "p50", "p99")))


IMAGES = [131, 94, 171]
IMG = """im AS (SELECT label, CASE b WHEN 0 THEN 131 WHEN 1 THEN 94 ELSE 171 END AS wavelength, CAST(b AS INTEGER) AS band, CAST(vec_id // 32 AS INTEGER) AS y, CAST(vec_id % 32 AS INTEGER) AS x, 1000.0 * abs(CAST(embedding[b + 1] AS DOUBLE)) AS v
    FROM embeddings, (SELECT range AS b FROM range(3)) WHERE b <> 1 OR vec_id // 32 < 10),
    sz AS (SELECT label, wavelength, max(y) + 1 AS ny, max(x) + 1 AS nx FROM im GROUP BY 1, 2)"""


def fits_files(spark, d) -> str:
    """An image for each label and three bands, one of which has fewer rows, and a file that is none."""
    path = scratch(spark, "fits")
    px = W.px(spark, d).select("frame_id", "y", "x", F.posexplode(F.slice("dn", 1, 3)).alias("band", "value")).filter("band <> 1 OR y < 10")
    number = F.col("frame_id").cast("int")
    images = px.select(F.concat(F.lit("deep/"), "frame_id").alias("name"), F.element_at(F.array(*map(F.lit, IMAGES)), F.col("band") + 1).alias("wavelength"), F.format_string("2025-01-01T%02d:%02d:13", F.floor(number / 60).cast("int"), (number % 60).cast("int")).alias("date_obs"), "y", "x", "value")
    fits.write_images(images, path, exptime=2.5).count()
    npz.write_files(spark.range(1).select(F.lit("bad.fits").alias("name"), F.encode(F.lit("nothing"), "UTF-8").alias("content")), path).count()
    return path


STAMP = "TIMESTAMP '2025-01-01 00:00:13' + to_minutes(CAST(label AS INTEGER))"


@query(f"WITH {IMG} SELECT label || '_' || wavelength || '.fits' AS name, wavelength, {STAMP} AS timestamp_utc, nx AS naxis1, ny AS naxis2, CAST(2.5 AS DOUBLE) AS exptime FROM sz")
def fits_catalogue(spark, d):
    made = fits.catalogue(spark, fits_files(spark, d))
    return made.select(F.element_at(F.split("filepath", "/"), -1).alias("name"), "wavelength", "timestamp_utc", "naxis1", "naxis2", "exptime")


@query(
    f"""WITH {IMG}, cut AS (SELECT label, min(ny) AS h, min(nx) AS w FROM sz GROUP BY 1)
    SELECT strftime({STAMP}, '%Y%m%d_%H_%M_') || '12' AS frame_id, y, x, band, round(v, 6) AS dn FROM im JOIN cut USING (label) WHERE y < h AND x < w AND v > 0"""
)
def fits_pixels(spark, d):
    """Complete sets from the catalogue, cut to their smallest shape, bands in the asked order."""
    path = fits_files(spark, d)
    sets = I.pivoted(I.first_per_band(I.bucketed(fits.catalogue(spark, path))), IMAGES)
    return fits.pixels_of_sets(spark, path, sets, IMAGES).select("frame_id", "y", "x", F.posexplode("dn").alias("band", "dn")).filter("dn > 0").withColumn("dn", r("dn"))


@query(
    f"""{K.FIRST}, hr AS (SELECT date_trunc('hour', timestamp_utc) AS bucket_start, wavelength, arg_min(filepath, (timestamp_utc, filepath)) AS f FROM man WHERE wavelength IS NOT NULL GROUP BY 1, 2)
    SELECT bucket_start, {", ".join(f"max(CASE WHEN wavelength = {w} THEN f END) AS w{w}" for w in W.BANDS.values())} FROM hr GROUP BY 1 HAVING count(*) = {len(W.BANDS)}"""
)
def stream_bandsets(spark, d):
    """Complete sets of bands from a stream of manifest files; a row of a later day lets the watermark pass all others."""
    path = scratch(spark, "stream")
    rows = W.manifest(spark, d).select(*(F.col(f.name) if f.name in ("timestamp_utc", "wavelength", "filepath") else F.lit(None).cast(f.dataType).alias(f.name) for f in I.MANIFEST))
    later = rows.agg((F.max("timestamp_utc") + F.expr("interval 3 days")).alias("timestamp_utc")).select("timestamp_utc", F.lit(94).alias("wavelength"), F.lit("later").alias("filepath"))
    rows.unionByName(later, allowMissingColumns=True).write.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(f"{path}/in")
    sets = assembly.complete_bandsets(assembly.manifest_stream(spark, f"{path}/in"), list(W.BANDS.values()), cadence=3600)
    sets.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(sets.schema).parquet(f"{path}/out")
