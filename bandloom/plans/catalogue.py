"""Every operator as a query over the tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels as P
from ..operators import calibration as C
from ..operators import golden as G
from ..operators import ingest as I
from ..operators import instruments as N
from ..operators import inversion as V
from ..operators import joins as J
from ..operators import selection as S
from ..operators import sql_functions as B
from ..operators import summaries as Q
from ..runtime import scratch
from ..sources import tables
from . import solver_sql as X
from . import views as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

NT = 6
RESPONSE = [[float(v) for v in row] for row in C.synthetic(np.array(W.LOGT), W.NF, 0.6, "none", False)]
FACTOR = [float(v) for v in C.jacobian(np.array(W.LOGT), np.full(NT, 0.4)) / 1e6]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = " ".join(sql.split())
        return f

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def cells(rows: DataFrame, array: Column | str, keys: list[str], value: str = "value", at: str = "band", digits: int = 6) -> DataFrame:
    """A row for each value of the array."""
    return rows.select(*keys, F.posexplode(array).alias(at, value)).withColumn(value, r(value, digits))


# -- SQL forms of the views -----------------------------------------------------

PB = """pb AS (SELECT CAST(label AS VARCHAR) AS frame_id, vec_id, CAST(vec_id // 32 AS INTEGER) AS y, CAST(vec_id % 32 AS INTEGER) AS x, b AS band,
  1000.0 * abs(CAST(embedding[b + 1] AS DOUBLE)) AS dn, 1000.0 * CAST(embedding[b + 1] AS DOUBLE) AS raw
  FROM embeddings, (SELECT CAST(range AS INTEGER) AS b FROM range(6)))"""
PX = """px AS (SELECT CAST(label AS VARCHAR) AS frame_id, vec_id, CAST(vec_id // 32 AS INTEGER) AS y, CAST(vec_id % 32 AS INTEGER) AS x FROM embeddings)"""
LB = """ln AS (SELECT l_orderkey AS y, l_linenumber AS x, sum(l_quantity) AS b0, sum(l_extendedprice / 1000) AS b1, sum(100 * l_discount) AS b2, sum(100 * l_tax) AS b3,
  CAST(count(*) AS DOUBLE) AS b4, sum(l_quantity * (1 - l_discount)) AS b5 FROM lineitem GROUP BY 1, 2),
  lb AS (SELECT y, x, CAST(0 AS INTEGER) AS band, b0 AS dn FROM ln UNION ALL SELECT y, x, 1, b1 FROM ln UNION ALL SELECT y, x, 2, b2 FROM ln
  UNION ALL SELECT y, x, 3, b3 FROM ln UNION ALL SELECT y, x, 4, b4 FROM ln UNION ALL SELECT y, x, 5, b5 FROM ln)"""
MAN = """man AS (SELECT ts AS timestamp_utc, CAST(CASE event_type WHEN 'click' THEN 94 WHEN 'error' THEN 131 WHEN 'purchase' THEN 171 WHEN 'signup' THEN 193 WHEN 'view' THEN 211 END AS INTEGER) AS wavelength,
  'f' || CAST(event_id AS VARCHAR) AS filepath, user_id, value FROM events),
  mb AS (SELECT *, strftime(timestamp_utc, '%Y%m%d') AS d8, CAST((hour(timestamp_utc) * 3600 + minute(timestamp_utc) * 60 + CAST(floor(second(timestamp_utc)) AS BIGINT)) // 3600 AS INTEGER) AS h FROM man),
  mk AS (SELECT * EXCLUDE (h), lpad(CAST(h AS VARCHAR), 2, '0') || '_00_00' AS bucket FROM mb)"""
DEM = """dm AS (SELECT vec_id, b AS bin, greatest(CAST(embedding[b + 1] AS DOUBLE), 0.0) AS dem, 5.5 + 0.4 * b AS logt FROM embeddings, (SELECT CAST(range AS INTEGER) AS b FROM range(6)))"""
RESP = "rsp(bin, band, value) AS (VALUES " + ", ".join(f"({t}, {f}, CAST({v!r} AS DOUBLE))" for t, row in enumerate(RESPONSE) for f, v in enumerate(row)) + ")"
FAC = "fac(bin, f) AS (VALUES " + ", ".join(f"({t}, CAST({v!r} AS DOUBLE))" for t, v in enumerate(FACTOR)) + ")"

KEY = ["vec_id"]

# -- ingest ---------------------------------------------------------------------


def man(spark: SparkSession, d: str) -> DataFrame:
    return I.bucketed(W.manifest(spark, d), 3600)


@query(f"WITH {MAN} SELECT filepath, d8, bucket FROM mk")
def manifest_bucket(spark, d):
    return man(spark, d).select("filepath", "d8", "bucket")


@query(f"WITH {MAN} SELECT d8, bucket, wavelength, filepath FROM (SELECT *, row_number() OVER (PARTITION BY d8, bucket, wavelength ORDER BY timestamp_utc, filepath) AS k FROM mk) WHERE k = 1")
def manifest_first_per_group(spark, d):
    return I.first_per_band(man(spark, d)).select("d8", "bucket", "wavelength", "filepath")


SETS = f"WITH {MAN}, st AS (SELECT d8, bucket, count(DISTINCT wavelength) AS n_bands FROM mk WHERE wavelength IS NOT NULL GROUP BY 1, 2)"


@query(f"{SETS} SELECT d8, bucket, n_bands FROM st WHERE n_bands = 5")
def bandset_complete(spark, d):
    return I.bandsets(man(spark, d), list(W.BANDS.values())).filter("complete").select("d8", "bucket", "n_bands")


@query(f"{SETS} SELECT d8, bucket, n_bands FROM st WHERE n_bands < 5")
def bandset_incomplete(spark, d):
    return I.bandsets(man(spark, d), list(W.BANDS.values())).filter("not complete").select("d8", "bucket", "n_bands")


FIRST = f"WITH {MAN}, fs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d8, bucket, wavelength ORDER BY timestamp_utc, filepath) AS k FROM mk) WHERE k = 1)"


@query(f"{FIRST} SELECT d8, bucket, " + ", ".join(f"max(CASE WHEN wavelength = {w} THEN filepath END) AS w{w}" for w in W.BANDS.values()) + " FROM fs GROUP BY 1, 2")
def bandset_pivot(spark, d):
    return I.pivoted(I.first_per_band(man(spark, d)), list(W.BANDS.values()))


@query(f"WITH {MAN} SELECT DISTINCT d8, bucket FROM mk WHERE (d8, bucket) NOT IN (SELECT d8, bucket FROM mk WHERE user_id % 7 = 0)")
def todo_antijoin(spark, d):
    rows = man(spark, d)
    return I.to_do(rows.select("d8", "bucket").distinct(), rows.filter("user_id % 7 = 0").select("d8", "bucket").distinct(), ["d8", "bucket"])


@query(f"WITH {MAN} SELECT filepath, wavelength, d8 FROM mk WHERE filepath IN (SELECT 'f' || CAST(o_orderkey AS VARCHAR) FROM orders)")
def manifest_semijoin(spark, d):
    files = W.table(spark, d, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("filepath"))
    return I.present(man(spark, d), files).select("filepath", "wavelength", "d8")


@query(
    """WITH sp AS (SELECT user_id, min(ts) AS start, max(ts) AS stop FROM events GROUP BY 1),
    sl AS (SELECT user_id, start, stop, start + to_minutes(CAST(1440 * k AS INTEGER)) AS t0 FROM sp, (SELECT range AS k FROM range(0, 400)))
    SELECT user_id, t0, least(t0 + INTERVAL 1440 MINUTE, stop) AS t1 FROM sl WHERE t0 < stop"""
)
def time_slices(spark, d):
    spans = W.table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"))
    return I.time_slices(spans, 1440).select("user_id", "t0", "t1")


@query(
    f"""WITH {MAN} SELECT d8, count(*) AS n_files, sha256(string_agg(filepath, chr(10) ORDER BY filepath) || chr(10)) AS sha256,
    md5(string_agg(filepath, chr(10) ORDER BY filepath) || chr(10)) AS md5 FROM mk GROUP BY 1"""
)
def manifest_hash(spark, d):
    return I.names_hash(man(spark, d), "filepath", ["d8"])


@query("SELECT DISTINCT 'f' || CAST(event_id // 3 AS VARCHAR) AS filepath FROM events")
def distinct_files(spark, d):
    return W.table(spark, d, "events").select(F.concat(F.lit("f"), F.floor(F.col("event_id") / 3).cast("string")).alias("filepath")).distinct()


@query("SELECT o_orderkey, o_custkey, min(CAST(o_orderkey % 11 + 5 AS INTEGER)) OVER (PARTITION BY o_custkey) AS crop_h, min(CAST(o_orderkey % 13 + 5 AS INTEGER)) OVER (PARTITION BY o_custkey) AS crop_w FROM orders")
def common_shape_crop(spark, d):
    rows = W.table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 11 + 5).cast("int").alias("naxis2"), (F.col("o_orderkey") % 13 + 5).cast("int").alias("naxis1"))
    return I.common_shape(rows, ["o_custkey"]).select("o_orderkey", "o_custkey", "crop_h", "crop_w")


def quant_sql(top: str, bits: int) -> str:
    return f"""WITH {LB}, sc AS (SELECT band, {top} AS hi FROM lb GROUP BY 1), s2 AS (SELECT band, (CASE WHEN hi > 0 THEN hi ELSE 1.0 END) / {2**bits - 1}.0 AS scale FROM sc)
    SELECT y, x, lb.band, CAST(least(greatest(round_even(dn / scale, 0), 0), {2**bits - 1}) AS BIGINT) AS q, round(CAST(least(greatest(round_even(dn / scale, 0), 0), {2**bits - 1}) AS BIGINT) * scale, 6) AS restored FROM lb JOIN s2 USING (band)"""


def quantised(spark, d, bits, strategy):
    rows = W.pxline(spark, d, in_order=True).select("y", "x", F.posexplode("dn").alias("band", "dn"))
    out = I.dequantise(I.quantise(rows, I.quantise_scales(rows, "band", "dn", bits, strategy), "band", "dn", bits))
    return out.select("y", "x", "band", "q", r("restored").alias("restored"))


@query(quant_sql("quantile_cont(dn, 0.99)", 8))
def quantise_p99(spark, d):
    return quantised(spark, d, 8, "p99")


@query(quant_sql("max(dn)", 16))
def quantise_max(spark, d):
    return quantised(spark, d, 16, "max")


# -- selection ------------------------------------------------------------------


@query(f"WITH {PX} SELECT frame_id, y, x FROM px WHERE y < 8 AND x < 16")
def crop_top_left(spark, d):
    return S.crop_top_left(W.px(spark, d), 8, 16).select("frame_id", "y", "x")


@query(f"WITH {PX} SELECT frame_id, y, x FROM px WHERE y BETWEEN 4 AND 11 AND x BETWEEN 12 AND 19")
def crop_center(spark, d):
    return S.crop_centre(W.px(spark, d), 16, 32, 8).select("frame_id", "y", "x")


@query(f"WITH {PX}, fr AS (SELECT frame_id, CAST(row_number() OVER (ORDER BY frame_id) - 1 AS INTEGER) AS frame_idx FROM (SELECT DISTINCT frame_id FROM px)) SELECT px.frame_id, frame_idx, vec_id FROM px JOIN fr USING (frame_id) WHERE frame_idx IN (0, 2)")
def select_frames(spark, d):
    rows = W.px(spark, d)
    frames = S.numbered(rows.select("frame_id").distinct())
    return rows.join(S.select_frames(frames, [0, 2], 3), "frame_id").select("frame_id", "frame_idx", "vec_id")


@query("WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT vec_id FROM embeddings, n WHERE vec_id IN (SELECT CAST(k * (n - 1) // 99 AS BIGINT) FROM range(100) t(k), n)")
def linspace_sample(spark, d):
    rows = W.table(spark, d, "embeddings").select("vec_id")
    return S.evenly_spaced(rows, "vec_id", None, 100)


@query(f"WITH {PX} SELECT frame_id, CAST(y // 4 AS INTEGER) AS tile_y, CAST(x // 8 AS INTEGER) AS tile_x, count(*) AS n FROM px GROUP BY ALL")
def tile_assign(spark, d):
    return S.tiled(W.px(spark, d), 4, 8).groupBy("frame_id", "tile_y", "tile_x").agg(F.count("*").alias("n"))


@query(f"WITH {PX} SELECT frame_id, max(y) + 1 AS height, max(x) + 1 AS width, count(*) AS n FROM px GROUP BY 1")
def frame_shapes(spark, d):
    return S.frame_shapes(W.px(spark, d))


@query(f"WITH {PB} SELECT vec_id, band, round(CASE WHEN raw > 0 THEN raw ELSE 0 END, 6) AS value FROM pb")
def sanitise(spark, d):
    return cells(W.px(spark, d, signed=True), P.sanitise(F.col("dn")), KEY)


@query(
    f"""WITH {PB}, ch AS (SELECT vec_id, band, CASE WHEN vec_id % 9 = 0 THEN 0.0 WHEN vec_id % 11 = band THEN 'NaN'::DOUBLE ELSE raw END AS v FROM pb WHERE vec_id % 13 <> 1 OR band < 5),
    px AS (SELECT vec_id, bool_and(v = 0) AS zero, count(*) AS n FROM ch GROUP BY 1)
    SELECT (SELECT count(*) FROM px) AS n_pixels, count(*) FILTER (isnan(v)) AS n_not_finite, count(*) FILTER (NOT isnan(v) AND v < 0) AS n_negative, (SELECT count(*) FILTER (zero) FROM px) AS n_all_zero, (SELECT count(*) FILTER (n <> 6) FROM px) AS n_other_bands FROM ch"""
)
def input_checks(spark, d):
    short = F.when(F.col("vec_id") % 13 == 1, F.slice("dn", 1, 5)).otherwise(F.col("dn"))
    return S.input_checks(spoilt(W.px(spark, d, signed=True)).withColumn("dn", short))


def spoilt(rows: DataFrame) -> DataFrame:
    """Pixels of zeros and single values that aren't numbers, among the others."""
    k = F.col("vec_id")
    return rows.withColumn("dn", F.transform("dn", lambda v, i: F.when(k % 9 == 0, F.lit(0.0)).when(k % 11 == i, F.lit(float("nan"))).otherwise(v)))


@query(f"WITH {PB} SELECT vec_id, band, round(greatest(raw, 0) + 1, 6) AS value FROM pb")
def golden_hygiene(spark, d):
    return cells(W.px(spark, d, signed=True), P.golden_hygiene(F.col("dn")), KEY)


@query(f"WITH {PB}, lo AS (SELECT least(min(raw), 0) AS lo FROM pb) SELECT vec_id, band, round(raw - lo, 6) AS value FROM pb, lo")
def min_shift(spark, d):
    rows = W.px(spark, d, signed=True)
    least = rows.agg(F.min(F.array_min("dn")).alias("least"))
    return cells(rows.crossJoin(F.broadcast(least)), P.shift_up(F.col("dn"), F.col("least")), KEY)


for _model, _sql in (("sqrt_plus", "sqrt(dn) + 0.5"), ("linear", "0.1 * dn + 0.5"), ("constant", "0.5"), ("poisson", "sqrt(0.1 * dn + 0.5)"), ("unit", "1.0")):

    def _errors(spark, d, model=_model):
        return cells(W.px(spark, d), P.error_model(F.col("dn"), model, 0.1, 0.5), KEY)

    query(f"WITH {PB} SELECT vec_id, band, round(CAST({_sql} AS DOUBLE), 6) AS value FROM pb", f"err_{_model}")(_errors)


FLOORED = f"{LB}, md AS (SELECT y, x, median(dn) AS m FROM lb GROUP BY 1, 2), fl AS (SELECT lb.*, greatest(dn, greatest(1e-12, 1e-6 * m)) AS e FROM lb JOIN md USING (y, x))"


@query(f"WITH {FLOORED} SELECT y, x, band, round(e, 9) AS value FROM fl")
def error_floor(spark, d):
    rows = W.pxline(spark, d)
    return rows.select("y", "x", F.posexplode(P.error_floor(F.col("dn"))).alias("band", "value")).withColumn("value", r("value", 9))


@query(f"WITH {LB} SELECT y, x, bool_and(dn > 0) AS valid FROM lb GROUP BY 1, 2")
def validity(spark, d):
    return W.pxline(spark, d).select("y", "x", P.valid(F.col("dn"), P.error_model(F.col("dn"), "unit")).alias("valid"))


# -- calibration ------------------------------------------------------------------

INS = "ins AS (SELECT s_suppkey AS instrument, 5.5 + 0.01 * (s_suppkey % 10) AS lo, 7.3 + greatest(s_acctbal, 0.0) / 50000 AS hi, 0.15 + 0.01 * (s_suppkey % 5) AS width FROM supplier)"
GRID = f"{INS}, g AS (SELECT *, CAST(range AS INTEGER) AS bin, (hi - lo) / 23 AS step, lo + range * ((hi - lo) / 23) AS logt FROM ins, range(24))"
GAUSS = f"{GRID}, rs AS (SELECT *, b AS band, exp(-0.5 * pow((logt - (lo + (hi - lo) * (0.1 + 0.8 * b / 5))) / width, 2)) AS value FROM g, (SELECT CAST(range AS INTEGER) AS b FROM range(6)))"
BY = ["instrument"]


def instrument_grids(spark: SparkSession, d: str) -> DataFrame:
    return N.grids(W.instruments(spark, d), 24)


@query(f"WITH {GRID} SELECT instrument, bin, round(logt, 9) AS logt FROM g")
def grid_logt(spark, d):
    return instrument_grids(spark, d).select("instrument", "bin", r("logt", 9).alias("logt"))


@query(f"WITH {GRID} SELECT instrument, bin, round(lo - step / 2 + bin * step, 9) AS edge_lo, round(lo - step / 2 + (bin + 1) * step, 9) AS edge_hi, round(pow(10, lo - step / 2 + bin * step), 2) AS temp_lo FROM g")
def grid_edges(spark, d):
    return instrument_grids(spark, d).select("instrument", "bin", r("edge_lo", 9).alias("edge_lo"), r("edge_hi", 9).alias("edge_hi"), r("temp_lo", 2).alias("temp_lo"))


def response_query(spark: SparkSession, d: str, **how: object) -> DataFrame:
    return N.responses(instrument_grids(spark, d), BY, **how).select("instrument", "bin", "band", r("value", 9).alias("value"))


@query(f"WITH {GAUSS} SELECT instrument, bin, band, round(value, 9) AS value FROM rs")
def resp_gauss(spark, d):
    return response_query(spark, d)


@query(f"WITH {GAUSS} SELECT instrument, bin, band, round(value / (sum(value) OVER (PARTITION BY instrument, band) + 1e-12), 9) AS value FROM rs")
def resp_l1(spark, d):
    return response_query(spark, d, normalize="l1")


@query(f"WITH {GAUSS} SELECT instrument, bin, band, round(value / (max(value) OVER (PARTITION BY instrument, band) + 1e-12), 9) AS value FROM rs")
def resp_colmax(spark, d):
    return response_query(spark, d, normalize="colmax")


@query(f"WITH {GAUSS}, rj AS (SELECT instrument, bin, band, value * step AS value FROM rs) SELECT instrument, bin, band, round(value / (sum(value) OVER (PARTITION BY instrument, band) + 1e-12), 9) AS value FROM rj")
def resp_l1_jacobian(spark, d):
    return response_query(spark, d, normalize="l1", include_jacobian=True)


SAMPLES = f"{INS}, sm AS (SELECT instrument, lo, hi, i, b AS band, lo + i * ((hi - lo) / 199) AS logt, exp(-0.5 * pow((lo + i * ((hi - lo) / 199) - (lo + 0.2 + b * ((hi - lo - 0.4) / 5))) / 0.15, 2)) + 1e-30 AS value FROM ins, (SELECT CAST(range AS INTEGER) AS i FROM range(200)), (SELECT CAST(range AS INTEGER) AS b FROM range(6)))"


@query(
    f"""WITH {SAMPLES}, bn AS (SELECT instrument, CAST(range AS INTEGER) AS bin, lo + range * ((hi - lo) / 23) AS a, lo + (range + 1) * ((hi - lo) / 23) AS b, range = 22 AS last FROM ins, range(23))
    SELECT instrument, bin, band, count(*) AS n, round(avg(value), 9) AS value FROM sm JOIN bn USING (instrument) WHERE logt >= a AND (logt < b OR last) GROUP BY 1, 2, 3"""
)
def resp_binned(spark, d):
    """Samples in bins of each instrument, by a join on ranges."""
    own = W.instruments(spark, d)
    return N.binned(N.samples(own), N.equal_bins(own, BY, 23), BY).select("instrument", "bin", "band", "n", r("value", 9).alias("value"))


@query(
    f"""WITH {SAMPLES}, pt AS (SELECT instrument, CAST(range AS INTEGER) AS bin, least(greatest(lo - 0.05 + range * 0.17, lo), hi) AS x FROM ins, range(14)),
    pc AS (SELECT instrument, band, logt, log10(value) AS y, lead(logt) OVER w AS logt2, lead(log10(value)) OVER w AS y2 FROM sm WINDOW w AS (PARTITION BY instrument, band ORDER BY logt))
    SELECT instrument, bin, band, round(y + CASE WHEN logt2 IS NULL THEN 0 ELSE (y2 - y) * (x - logt) / (logt2 - logt) END, 6) AS log_value
    FROM pt JOIN pc USING (instrument) WHERE logt <= x AND (x < logt2 OR logt2 IS NULL)"""
)
def resp_interp(spark, d):
    """Responses at points between the samples, and beyond them, by an as-of join."""
    own = W.instruments(spark, d)
    points = own.select("instrument", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("bin"), "lo").select("instrument", "bin", (F.col("lo") - 0.05 + F.col("bin") * 0.17).alias("x"))
    return N.interpolated(N.samples(own), points, BY).select("instrument", "bin", "band", r(F.log10("value")).alias("log_value"))


@query(f"WITH {PB}, {RESP}, mn AS (SELECT band, greatest(avg(dn), 1e-6) AS m FROM pb GROUP BY 1) SELECT rsp.bin, rsp.band, round(value * m, 6) AS value FROM rsp JOIN mn ON mn.band = rsp.band")
def band_mean_scale(spark, d):
    response = spark.createDataFrame([(t, f, v) for t, row in enumerate(RESPONSE) for f, v in enumerate(row)], "bin int, band int, value double")
    return Q.scaled_by_band_mean(W.px(spark, d), response).select("bin", "band", r("value").alias("value"))


# -- parts of the inversion ---------------------------------------------------------


@query(f"WITH {PB}, {RESP} SELECT vec_id, rsp.bin, round(min(dn / greatest(value, 1e-300)), 4) AS value FROM pb JOIN rsp ON rsp.band = pb.band WHERE pb.band IN (0, 2, 3) GROUP BY 1, 2")
def em_loci(spark, d):
    return cells(W.px(spark, d), P.em_loci(F.col("dn"), RESPONSE, [0, 2, 3]), KEY, at="bin", digits=4)


@query(
    f"""WITH {PB}, top AS (SELECT vec_id, greatest(max(dn), 1e-12) AS m FROM pb GROUP BY 1),
    sm AS (SELECT vec_id, band, coalesce(sum(CASE WHEN band BETWEEN 1 AND 4 THEN dn ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY band ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) / 5 AS s FROM pb)
    SELECT sm.vec_id, band AS bin, round(greatest(s / m, 1e-8), 9) AS value FROM sm JOIN top USING (vec_id)"""
)
def smooth5(spark, d):
    rows = W.px(spark, d)
    return rows.select("vec_id", F.posexplode(P.smooth5(F.col("dn"))).alias("bin", "value")).withColumn("value", r("value", 9))


FORWARD = f"{DEM}, {RESP}, fw AS (SELECT vec_id, rsp.band, sum(dem * value) AS p FROM dm JOIN rsp ON rsp.bin = dm.bin GROUP BY 1, 2)"


def forwarded(spark, d) -> DataFrame:
    dem = W.dem_rows(spark, d)
    both = W.px(spark, d).select("vec_id", "dn").join(dem, "vec_id")
    return both.withColumn("p", P.forward(F.col("dem"), RESPONSE))


@query(f"WITH {FORWARD} SELECT vec_id, band, round(p, 6) AS value FROM fw")
def forward_project(spark, d):
    return cells(W.dem_rows(spark, d), P.forward(F.col("dem"), RESPONSE), KEY)


@query(f"WITH {PB}, {RESP} SELECT vec_id, rsp.bin, round(sum(dn * value), 4) AS value FROM pb JOIN rsp ON rsp.band = pb.band GROUP BY 1, 2")
def project_response(spark, d):
    return cells(W.px(spark, d), P.back_project(F.col("dn"), RESPONSE), KEY, at="bin", digits=4)


@query(f"WITH {PB}, {FORWARD} SELECT pb.vec_id, round(sum(pow((dn - p) / (0.1 * dn + 0.5), 2)) / 6, 4) AS chisq FROM pb JOIN fw ON fw.vec_id = pb.vec_id AND fw.band = pb.band GROUP BY 1")
def chisq(spark, d):
    edn = P.error_model(F.col("dn"), "linear", 0.1, 0.5)
    return forwarded(spark, d).select("vec_id", r(P.chisq(F.col("dn"), edn, F.col("p")), 4).alias("chisq"))


@query(f"WITH {PB}, {FORWARD} SELECT pb.vec_id, round(avg(dn / greatest(p + 1, 1e-300)), 6) AS ratio FROM pb JOIN fw ON fw.vec_id = pb.vec_id AND fw.band = pb.band GROUP BY 1")
def rescale_rscl(spark, d):
    more = F.transform("p", lambda v: v + 1)
    return forwarded(spark, d).select("vec_id", r(P.rescale(F.col("dn"), more)).alias("ratio"))


@query(f"WITH {DEM}, {FAC} SELECT vec_id, dm.bin, round(dem * f, 6) AS emd, round(dem * f / f, 6) AS back FROM dm JOIN fac ON fac.bin = dm.bin")
def emd_dem_convert(spark, d):
    rows = W.dem_rows(spark, d).withColumn("emd", P.times_factor(F.col("dem"), FACTOR))
    rows = rows.select("vec_id", F.posexplode(F.arrays_zip("emd", P.times_factor(F.col("emd"), FACTOR, divide=True).alias("back"))).alias("bin", "z"))
    return rows.select("vec_id", "bin", r("z.emd").alias("emd"), r("z.back").alias("back"))


@query(
    f"""WITH {DEM}, pt AS (SELECT CAST(range AS INTEGER) AS bin, range * 5.0 / 10 AS x, CAST(least(floor(range * 5.0 / 10), 4) AS INTEGER) AS k FROM range(11))
    SELECT a.vec_id, pt.bin, round(a.dem + (b.dem - a.dem) * (x - k), 6) AS value FROM pt JOIN dm a ON a.bin = k JOIN dm b ON b.bin = k + 1 AND b.vec_id = a.vec_id"""
)
def channel_resample(spark, d):
    return cells(W.dem_rows(spark, d), P.resample(F.col("dem"), 6, 11), KEY, at="bin")


# -- the inversion --------------------------------------------------------------------


def pixels(spark: SparkSession, d: str) -> DataFrame:
    rows = W.px(spark, d).withColumn("dn", P.sanitise(F.col("dn")))
    return rows.withColumn("edn", P.error_model(F.col("dn"), "poisson", 1.0, 1.0))


def solver_options(options: dict[str, object]) -> tuple[C.Calibration, V.Options]:
    return C.prepare(*C.sampled(), emd_int=True) if options.get("emd_int") else C.default(), V.Options(**options)


def solved(spark: SparkSession, d: str, **options: object) -> DataFrame:
    return V.solve_dem(pixels(spark, d), *solver_options(options))


def grid() -> list[float]:
    return [float(v) for v in C.default().logt]


PIXELS = "SELECT vec_id AS id, CAST(label AS VARCHAR) AS frame_id, CAST(vec_id // 32 AS INTEGER) AS y, CAST(vec_id % 32 AS INTEGER) AS x, dn, list_transform(dn, lambda v: sqrt(v + 1)) AS edn FROM (SELECT *, list_transform(embedding[1:6], lambda v: 1000.0 * abs(CAST(v AS DOUBLE))) AS dn FROM embeddings)"


def log_of(total: Column) -> Column:
    """The logarithm, rounded, of sums that go over many powers of ten."""
    return F.when(total > 0, r(F.log10(total), 5))


def log_sum(values: str) -> Column:
    return log_of(F.aggregate(values, F.lit(0.0), lambda s, v: s + v))


def flat(solution: DataFrame, logt: list[float]) -> DataFrame:
    """Scalars of a solution: a row for each pixel."""
    elogt = F.aggregate("elogt", F.lit(0.0), lambda s, v: s + v)
    return solution.select("frame_id", "y", "x", "valid", r("chisq").alias("chisq"), log_of(P.total_em(F.col("dem"))).alias("log_em"), r(P.median_logt(F.col("dem"), logt)).alias("median_logt"), log_sum("edem").alias("log_edem"), r(elogt).alias("elogt_sum"))


def flat_sql(options: dict[str, object]) -> str:
    logt = X.doubles(C.default().logt)
    log = lambda v: f"CASE WHEN list_sum({v}) > 0 THEN round(log10(list_sum({v})), 5) END"
    return f"""WITH RECURSIVE {X.solution(PIXELS, *solver_options(options))},
    ps AS (SELECT id, list_transform(dem, lambda v: greatest(v, 0.0)) AS d FROM sol)
    SELECT frame_id, y, x, valid, round(chisq, 6) AS chisq, {log("d")} AS log_em,
    CASE WHEN list_sum(d) > 0 THEN round(({logt})[list_min(list_filter(range(1, len(d) + 1), lambda i: list_sum(d[1:i]) >= 0.5 * list_sum(d)))], 6) END AS median_logt,
    {log("edem")} AS log_edem, round(list_sum(elogt), 6) AS elogt_sum FROM sol JOIN ps USING (id) JOIN px0 USING (id)"""


for _name, _options in (("solve_dem", {}), ("solve_dem_gloci", {"gloci": True}), ("solve_dem_emd", {"emd_int": True, "emd_ret": True}), ("solve_dem_nonpos", {"non_pos": True}), ("solve_dem_lemd", {"l_emd": True, "emd_int": True}), ("solve_dem_rscl", {"rscl": True})):

    def _solve(spark, d, options=_options):
        return flat(solved(spark, d, **options), grid())

    query(flat_sql(_options), _name)(_solve)


@query(
    f"""WITH RECURSIVE {X.solution(PIXELS, *solver_options({}))}, tt AS (SELECT id, list_sum(dem) AS em FROM sol WHERE valid)
    SELECT id AS vec_id, CAST(t - 1 AS INTEGER) AS bin, round(dem[t] / em, 4) + 0.0 AS dem, round(edem[t] / em, 4) AS edem, round(elogt[t], 6) AS elogt FROM sol JOIN tt USING (id), (SELECT range AS t FROM range(1, 25)) WHERE valid"""
)
def solve_bins(spark, d):
    """Each bin's distribution, uncertainty and resolution, the first two over the pixel's total."""
    rows = V.solve_dem(pixels(spark, d), C.default()).filter("valid").withColumn("em", F.aggregate("dem", F.lit(0.0), lambda s, v: s + v))
    rows = rows.select("vec_id", "em", F.posexplode(F.arrays_zip("dem", "edem", "elogt")).alias("bin", "z"))
    return rows.select("vec_id", "bin", (r(F.col("z.dem") / F.col("em"), 4) + 0.0).alias("dem"), r(F.col("z.edem") / F.col("em"), 4).alias("edem"), r("z.elogt").alias("elogt"))


def named_for(rows: DataFrame) -> tuple[str, str]:
    """A view of the rows and a function's name, neither used before."""
    key = uuid.uuid4().hex
    rows.createOrReplaceTempView(f"px_{key}")
    return f"px_{key}", f"f_{key}"


@query(f"WITH RECURSIVE {X.solution(PIXELS, *solver_options({}))} SELECT id AS vec_id, valid, round(chisq, 6) AS chisq, CASE WHEN list_sum(edem) > 0 THEN round(log10(list_sum(edem)), 5) END AS log_edem, round(list_sum(elogt), 6) AS elogt_sum FROM sol")
def sql_solver(spark, d):
    """The solver as a function in SQL text."""
    px, f = named_for(pixels(spark, d))
    B.register_solver(spark, f, C.default())
    total = "aggregate({}, 0D, (s, v) -> s + v)".format
    return spark.sql(f"SELECT vec_id, s.valid, round(s.chisq, 6) AS chisq, CASE WHEN {total('s.edem')} > 0 THEN round(log10({total('s.edem')}), 5) END AS log_edem, round({total('s.elogt')}, 6) AS elogt_sum FROM (SELECT vec_id, {f}(dn, edn) AS s FROM {px})")


def clipped(dn: np.ndarray, edn: np.ndarray) -> dict[str, np.ndarray]:
    """A solver as users write them, which is found by its name."""
    dem, _, fit = V.lstsq_clip(dn, np.array(RESPONSE))
    return {"em": dem.sum(axis=1), "residual": fit}


def sql_user_solver(spark, d):
    """A solver of the user's own, by its name, as a function in SQL text."""
    px, f = named_for(W.px(spark, d))
    B.register_user_solver(spark, f, f"{__name__}:clipped", "em double, residual double")
    return spark.sql(f"SELECT vec_id, round(s.em, 4) AS em, round(s.residual, 2) AS residual FROM (SELECT vec_id, {f}(dn, dn) AS s FROM {px})")


def table_function_bins(spark, d):
    """Pixels to their bins by a function that takes a table."""
    px, f = named_for(pixels(spark, d).withColumn("x", F.col("vec_id").cast("int")))
    B.register_bins(spark, f, C.default())
    return spark.sql(
        f"""SELECT CAST(x AS BIGINT) AS vec_id, bin, round(dem / em, 4) + 0.0 AS dem, round(edem / em, 4) AS edem, round(elogt, 6) AS elogt
        FROM (SELECT *, sum(dem) OVER (PARTITION BY x) AS em FROM {f}(TABLE(SELECT frame_id, y, x, dn, edn FROM {px}) PARTITION BY frame_id) WHERE valid)"""
    )


query(ORACLE_SQL["solve_bins"])(table_function_bins)


@query(
    f"""WITH RECURSIVE {X.solution(PIXELS, *solver_options({}))}
    SELECT count(*) AS n_pixels, count(*) FILTER (valid) AS n_valid, round(min(list_min(dem)) / max(list_max(dem)), 4) + 0.0 AS least, round(log10(max(list_max(dem))), 5) AS log_dem_max, round(log10(avg(list_sum(dem))), 5) AS log_em_mean, round(avg(chisq), 6) AS chisq_mean FROM sol"""
)
def observed_solve(spark, d):
    """Figures of a solution that one pass solved, wrote and reported."""
    found = tables.write_solution(solved(spark, d).select("frame_id", "y", "x", *V.OUTPUTS, "valid"), scratch(spark, "observed"))
    one = spark.createDataFrame([tuple(found[k] for k in ("n_pixels", "n_valid", "dem_min", "dem_max", "em_mean", "chisq_mean"))], "n_pixels long, n_valid long, dem_min double, dem_max double, em_mean double, chisq_mean double")
    return one.select("n_pixels", "n_valid", (r(F.col("dem_min") / F.col("dem_max"), 4) + 0.0).alias("least"), r(F.log10("dem_max"), 5).alias("log_dem_max"), r(F.log10("em_mean"), 5).alias("log_em_mean"), r("chisq_mean").alias("chisq_mean"))


LINES = f"SELECT row_number() OVER (ORDER BY y, x) AS id, y, x, [b0, b1, b2, b3, b4, b5] AS dn, list_transform([b0, b1, b2, b3, b4, b5], lambda v: sqrt(v + 1)) AS edn FROM ln"


@query(
    f"""WITH RECURSIVE {LB}, {X.solution(LINES, *solver_options({}))}, ps AS (SELECT id, list_sum(list_transform(dem, lambda v: greatest(v, 0.0))) AS em FROM sol)
    SELECT px0.y, px0.x, valid, round(chisq, 6) AS chisq, CASE WHEN em > 0 THEN round(log10(em), 5) END AS log_em, CASE WHEN list_sum(edem) > 0 THEN round(log10(list_sum(edem)), 5) END AS log_edem
    FROM sol JOIN ps USING (id) JOIN px0 USING (id)"""
)
def solve_lines(spark, d):
    """The inversion over many pixels, all outputs, dealt out evenly first: they come from an aggregate."""
    rows = W.pxline(spark, d).withColumn("edn", P.error_model(F.col("dn"), "poisson", 1.0, 1.0))
    return V.solve_dem(V.spread(rows), C.default(), V.Options()).select("y", "x", "valid", r("chisq").alias("chisq"), log_of(P.total_em(F.col("dem"))).alias("log_em"), log_sum("edem").alias("log_edem"))


@query(f"WITH RECURSIVE {X.solution(PIXELS, *solver_options({}))} SELECT id AS vec_id, CAST(f - 1 AS INTEGER) AS band, round(dn_reg[f], 4) AS dn_reg, round(dn_reg[f], 4) AS predicted, round(chisq, 4) AS chisq FROM sol, (SELECT range AS f FROM range(1, 7)) WHERE valid")
def solver_selfcheck(spark, d):
    """The solver's predicted counts, and these and chisq made again from the returned distribution by expressions."""
    cal = C.default()
    response = [[float(v) / cal.scale for v in row] for row in cal.rmatrix]
    rows = V.solve_dem(pixels(spark, d).select("vec_id", "dn", "edn", F.col("dn").alias("dn0"), F.col("edn").alias("edn0")), cal).filter("valid")
    rows = rows.withColumn("p", P.forward(F.col("dem"), response))
    rows = rows.select("vec_id", P.chisq(F.col("dn0"), F.col("edn0"), F.col("p")).alias("chisq"), F.posexplode(F.arrays_zip("dn_reg", "p")).alias("band", "z"))
    return rows.select("vec_id", "band", r("z.dn_reg", 4).alias("dn_reg"), r("z.p", 4).alias("predicted"), r("chisq", 4).alias("chisq"))


def by_batch(rows: DataFrame, schema: str, many: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """A function of the counts of a batch of pixels, stacked, with a column for each of ``schema`` after the id."""
    import pyarrow as pa

    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            dn = np.asarray(b.column(1).flatten(), float).reshape(-1, W.NF)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in many(dn))], names=names)

    return rows.select("vec_id", "dn").mapInArrow(run, schema)


SIGMA = [float(v) for v in np.linalg.svd(np.array(RESPONSE), compute_uv=False)]
MU = [float(v) for v in np.geomspace(min(SIGMA) ** 2 * 1e-4, max(SIGMA), 500)]


@query(
    f"""WITH {PB}, mu AS (SELECT m FROM (SELECT unnest({X.doubles(MU)}) AS m)), sg(band, s) AS (VALUES {", ".join(f"({k}, CAST({v!r} AS DOUBLE))" for k, v in enumerate(SIGMA))}),
    ms AS (SELECT vec_id, m, sum(pow(m * dn / 1000 / (s * s + m), 2)) AS fit FROM pb JOIN sg USING (band), mu GROUP BY 1, 2)
    SELECT vec_id, round(log10(arg_min(m, (abs(fit - 6 * 0.1 * 0.1), m))), 6) AS log_mu FROM ms GROUP BY 1"""
)
def dem_reg_map(spark, d):
    sigma, err = np.array(SIGMA), np.full(W.NF, 0.1)
    out = by_batch(W.px(spark, d), "vec_id long, mu double", lambda dn: [V.reg_maps(sigma, np.ones(W.NF), np.eye(W.NF), dn / 1000, err)])
    return out.select("vec_id", r(F.log10("mu")).alias("log_mu"))


@query(f"WITH RECURSIVE {X.gsvd_largest(RESPONSE, PIXELS)} SELECT id AS vec_id, round(sqrt(s2[1] / (1 + s2[1])), 9) AS alpha, round(sqrt(s2[6] / (1 + s2[6])), 9) AS least_alpha, round(1 / sqrt(1 + s2[1]), 9) AS beta, round(1 / sqrt(1 + s2[6]), 9) AS most_beta FROM sv")
def gsvd(spark, d):
    def many(dn):
        alpha, beta = V.gsvd_values(np.array(RESPONSE)[None] * (1 + dn[:, None, :] / 1000), np.eye(W.NF))
        return [alpha.max(axis=1), alpha.min(axis=1), beta.min(axis=1), beta.max(axis=1)]

    out = by_batch(W.px(spark, d), "vec_id long, alpha double, least_alpha double, beta double, most_beta double", many)
    return out.select("vec_id", *(r(c, 9).alias(c) for c in ("alpha", "least_alpha", "beta", "most_beta")))


def pairs(rows: DataFrame) -> DataFrame:
    """vec_id, d and two matrices of a pixel's own: a, its responses over its uncertainties (6 by 6), and b (7 by 6), which is wide and falls to no simple case."""
    dn = lambda i: F.get("dn", i)
    err = lambda f: F.sqrt(dn(f) + 1)
    a = F.array(*(F.array(*(F.lit(RESPONSE[t][f]) / err(F.lit(f)) for t in range(NT))) for f in range(W.NF)))
    b = F.array(*(F.array(*(1 + dn(F.lit(t)) / 1000 if t == i else F.lit(-0.5 if t == i + 1 else 0.0) for t in range(NT))) for i in range(NT)), F.array(*(F.lit(0.1 * (t + 1)) for t in range(NT))))
    return rows.select("vec_id", a.alias("a"), b.alias("b"), F.array(*(dn(F.lit(f)) / err(F.lit(f)) for f in range(W.NF))).alias("d"), "dn")


@query(
    f"""WITH {PB}, {RESP}, ix AS (SELECT CAST(range AS INTEGER) AS j FROM range(6))
    SELECT 'a' AS matrix, vec_id, pb.band AS i, bin AS j, round(value / sqrt(dn + 1), 6) AS value FROM pb JOIN rsp USING (band)
    UNION ALL SELECT 'b', vec_id, pb.band, j, round(CASE WHEN j = pb.band THEN 1 + dn / 1000 WHEN j = pb.band + 1 THEN -0.5 ELSE 0.0 END, 6) FROM pb, ix
    UNION ALL SELECT 'b', vec_id, 6, j, round(0.1 * (j + 1), 6) FROM pb, ix WHERE pb.band = 0"""
)
def gsvd_factors(spark, d):
    """Both matrices of each pixel, put together again from their common factors."""
    made = V.gsvd_frame(pairs(W.px(spark, d)), ["vec_id"])
    k = F.sequence(F.lit(0), F.size("alpha") - 1)

    def rebuilt(vectors: str, values: str) -> Column:
        """Sums over the factors: a row for each row of the matrix."""
        one = lambda i, j: F.aggregate(k, F.lit(0.0), lambda s, n: s + F.get(F.get(vectors, n), i) * F.get(values, n) * F.get(F.get("x", n), j))
        size = lambda c: F.sequence(F.lit(0), F.size(F.get(c, 0)) - 1)
        return F.transform(size(vectors), lambda i: F.transform(size("x"), lambda j: one(i, j)))

    both = [made.select(F.lit(name).alias("matrix"), "vec_id", F.posexplode(rebuilt(vectors, values)).alias("i", "row")) for name, vectors, values in (("a", "u", "alpha"), ("b", "v", "beta"))]
    return both[0].unionByName(both[1]).select("matrix", "vec_id", "i", F.posexplode("row").alias("j", "value")).withColumn("value", r(F.col("value") + 0.0))


OWN_PAIR = f"""px0 AS ({{pixels}}), rm AS (SELECT {X.doubles(np.array(RESPONSE).T)} AS r),
    i1 AS (SELECT id, list_transform(range(1, 7), lambda f: list_append(list_transform(range(1, 7), lambda t: r[f][t] / sqrt(dn[f] + 1) / (1 + dn[t] / 1000)), dn[f] / sqrt(dn[f] + 1))) AS y FROM px0, rm)"""


@query(
    f"""WITH RECURSIVE {OWN_PAIR.format(pixels="SELECT vec_id AS id, list(dn ORDER BY band) AS dn FROM (SELECT vec_id, CAST(b AS INTEGER) AS band, 1000.0 * abs(CAST(embedding[b + 1] AS DOUBLE)) AS dn FROM embeddings, (SELECT range AS b FROM range(6))) GROUP BY 1")},
    {X.rotated("q1", "i1", 6, 6)}, {X.spectrum("p1", "q1", 6, 6, 500)}
    SELECT id AS vec_id, round(log10({X.chosen("6.0")}), 6) AS log_mu FROM p1"""
)
def gsvd_reg_map(spark, d):
    """The regularisation that each pixel's own decomposition chooses for its counts."""
    rows = pairs(W.px(spark, d))
    weights = F.array(*(F.array(*(1 + F.get("dn", t) / 1000 if t == i else F.lit(0.0) for t in range(NT))) for i in range(NT)))
    made = V.gsvd_frame(rows.withColumn("b", weights), ["vec_id", "d"])
    return reg_mapped(made).select("vec_id", r(F.log10("mu")).alias("log_mu"))


def reg_mapped(made: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for b in batches:
            n = b.num_rows
            alpha, beta, d = (np.asarray(b.column(i).flatten()).reshape(n, -1) for i in (1, 2, 4))
            u = np.asarray(b.column(3).flatten().flatten()).reshape(n, alpha.shape[1], -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(V.reg_maps_stacked(alpha, beta, u, d, np.ones(d.shape[1])))], names=["vec_id", "mu"])

    return made.select("vec_id", "alpha", "beta", "u", "d").mapInArrow(run, "vec_id long, mu double")


@query(
    """WITH rs AS (SELECT CAST(label AS VARCHAR) AS frame_id, t, f, avg(abs(CAST(embedding[6 + t * 6 + f + 1] AS DOUBLE))) AS v FROM embeddings, (SELECT range AS t FROM range(6)), (SELECT range AS f FROM range(6)) GROUP BY 1, 2, 3),
    dm AS (SELECT CAST(label AS VARCHAR) AS frame_id, vec_id, b AS t, greatest(CAST(embedding[b + 1] AS DOUBLE), 0.0) AS dem FROM embeddings, (SELECT range AS b FROM range(6)))
    SELECT frame_id, vec_id, CAST(f AS INTEGER) AS band, round(1000 * sum(dem * v), 6) AS value FROM dm JOIN rs USING (frame_id, t) GROUP BY 1, 2, 3"""
)
def forward_by_frame(spark, d):
    """Predicted counts with a response for each frame, a table by frame, band and block of bins."""
    rows = W.table(spark, d, "embeddings").select(F.col("label").cast("string").alias("frame_id"), "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    mean = rows.groupBy("frame_id").agg(*(F.avg(F.abs(F.get("e", F.lit(6 + k)))).alias(f"m{k}") for k in range(36)))
    by_band = F.array(*(F.struct(F.lit(f).alias("band"), F.array(*(F.col(f"m{t * 6 + f}") for t in range(6))).alias("values")) for f in range(6)))
    responses = J.blocks(mean.select("frame_id", F.inline(by_band)).withColumnRenamed("values", "bins"), "bins", 2)
    dem = J.blocks(rows.select("frame_id", "vec_id", F.transform(F.slice("e", 1, 6), lambda v: F.greatest(v, F.lit(0.0))).alias("dem")), "dem", 2)
    return J.block_product(dem, responses, ["frame_id"], ["vec_id"], "band").select("frame_id", "vec_id", "band", r(1000 * F.col("value")).alias("value"))


@query(
    """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view')
    SELECT p.event_id, CASE WHEN max(v.ts) >= p.ts - INTERVAL 2 DAY THEN CAST(arg_max(v.event_id, (v.ts, v.event_id)) AS VARCHAR) END AS view_id, CASE WHEN max(v.ts) >= p.ts - INTERVAL 2 DAY THEN arg_max(v.value, (v.ts, v.event_id)) END AS view_value
    FROM p LEFT JOIN v ON v.user_id = p.user_id AND v.ts < p.ts GROUP BY p.event_id, p.ts"""
)
def asof_views(spark, d):
    """For each purchase the user's last view before it, two days back at most."""
    rows = W.table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    found = J.asof(rows.filter("event_type = 'purchase'"), rows.filter("event_type = 'view'"), ["user_id"], "ts", {"view_id": "event_id", "view_value": "value"}, ties=["event_id"], strict=True, within=2 * J.DAY)
    return found.select("event_id", F.col("view_id").cast("string"), "view_value")


@query(
    """WITH s AS (SELECT event_id AS span_id, ts AS a, ts + to_microseconds(CAST(floor(value * 60000000) AS BIGINT)) AS b FROM events WHERE event_type = 'error'), v AS (SELECT event_id, ts, value FROM events WHERE event_type = 'view')
    SELECT span_id, event_id, value FROM s JOIN v ON v.ts >= a AND v.ts < b"""
)
def range_views(spark, d):
    """All views in the minutes that follow each error, as many as its value says."""
    rows = W.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    spans = rows.filter("event_type = 'error'").select(F.col("event_id").alias("span_id"), F.col("ts").alias("a"), F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") * 60_000_000)).alias("b"))
    views = rows.filter("event_type = 'view'").select("event_id", "ts", "value")
    return J.range_join(views, spans, "ts", "a", "b", width=10 * 60_000_000.0, hot=J.TASK, together=512).select("span_id", "event_id", "value")


PINV = [[float(v) for v in row] for row in np.linalg.pinv(np.array(RESPONSE))]


@query(
    f"""WITH rm AS (SELECT {X.doubles(np.array(RESPONSE).T)} AS r, {X.doubles(np.array(PINV).T)} AS inv), px0 AS ({PIXELS}),
    ls AS (SELECT id, dn, r, list_transform(inv, lambda v: greatest(list_inner_product(v, dn), 0.0)) AS dem FROM px0, rm)
    SELECT id AS vec_id, round(list_sum(dem), 4) AS em, round(list_sum(list_transform(range(1, 7), lambda f: pow(dn[f] - list_inner_product(dem, r[f]), 2))), 2) AS residual FROM ls"""
)
def lstsq_clip(spark, d):
    def many(dn):
        dem, _, fit = V.lstsq_clip(dn, np.array(RESPONSE))
        return [dem.sum(axis=1), fit]

    out = by_batch(W.px(spark, d), "vec_id long, em double, residual double", many)
    return out.select("vec_id", r("em", 4).alias("em"), r("residual", 2).alias("residual"))


query(ORACLE_SQL["lstsq_clip"])(sql_user_solver)

# -- temperature maps -------------------------------------------------------------------

TOTAL = f"{DEM}, tt AS (SELECT vec_id, sum(dem) AS em FROM dm GROUP BY 1)"
MAPS = {
    "em": (P.total_em, "round(em, 6)"),
    "peak": (P.peak_logt, "CASE WHEN em > 0 THEN round((SELECT min(logt) FROM dm b WHERE b.vec_id = tt.vec_id AND b.dem = (SELECT max(dem) FROM dm c WHERE c.vec_id = tt.vec_id)), 6) END"),
    "mean": (P.mean_logt, "CASE WHEN em > 0 THEN round(log10((SELECT sum(dem * pow(10, logt)) FROM dm b WHERE b.vec_id = tt.vec_id) / em), 6) END"),
    "median": (P.median_logt, "CASE WHEN em > 0 THEN round((SELECT min(logt) FROM cs b WHERE b.vec_id = tt.vec_id AND run >= 0.5 * em), 6) END"),
    "std": (P.std_logt, "CASE WHEN em > 0 THEN round((SELECT sqrt(sum(dem * pow(logt - m, 2)) / sum(dem)) FROM dm b JOIN mu USING (vec_id) WHERE b.vec_id = tt.vec_id), 6) END"),
}
RUNNING = f"{TOTAL}, cs AS (SELECT vec_id, logt, sum(dem) OVER (PARTITION BY vec_id ORDER BY bin) AS run FROM dm), mu AS (SELECT vec_id, sum(dem * logt) / sum(dem) AS m FROM dm GROUP BY 1 HAVING sum(dem) > 0)"


def _map(k: str) -> Column:
    f = MAPS[k][0]
    return r(f(F.col("dem")) if k == "em" else f(F.col("dem"), W.LOGT))


for _k, (_f, _sql) in MAPS.items():

    def _one(spark, d, k=_k):
        return W.dem_rows(spark, d).select("vec_id", _map(k).alias("value"))

    query(f"WITH {RUNNING} SELECT vec_id, {_sql} AS value FROM tt", f"temp_{_k}")(_one)


@query(f"WITH {RUNNING} SELECT vec_id, " + ", ".join(f"{sql} AS {k}" for k, (_, sql) in MAPS.items()) + " FROM tt")
def temp_all(spark, d):
    return W.dem_rows(spark, d).select("vec_id", *(_map(k).alias(k) for k in MAPS))


# -- summaries --------------------------------------------------------------------------


@query(f"WITH {DEM}, v AS (SELECT vec_id, sum(dem) AS s, min(dem) AS lo, max(dem) AS hi FROM dm GROUP BY 1) SELECT CAST(label AS VARCHAR) AS frame_id, round(sum(s), 4) AS dem_sum, round(avg(s), 6) AS em_mean, round(sum(s * 0.1), 4) AS edem_sum, round(avg(hi), 6) AS chisq_mean, round(min(lo), 6) AS dem_min, round(max(hi), 6) AS dem_max, count(*) AS n_pixels FROM v JOIN embeddings USING (vec_id) GROUP BY 1")
def frame_summary(spark, d):
    rows = W.px(spark, d).select("vec_id", "frame_id").join(W.dem_rows(spark, d), "vec_id")
    rows = rows.select("frame_id", "dem", F.transform("dem", lambda v: v * 0.1).alias("edem"), F.array_max("dem").alias("chisq"), F.lit(True).alias("valid"))
    return Q.frame_summary(rows).select("frame_id", r("dem_sum", 4).alias("dem_sum"), r("em_mean").alias("em_mean"), r("edem_sum", 4).alias("edem_sum"), r("chisq_mean").alias("chisq_mean"), r("dem_min").alias("dem_min"), r("dem_max").alias("dem_max"), "n_pixels")


@query(f"WITH {LB} SELECT band, round(min(dn), 6) AS least, round(max(dn), 6) AS largest, round(avg(dn), 6) AS mean, count(*) AS n FROM lb GROUP BY 1")
def band_minmax(spark, d):
    return Q.by_band(W.pxline(spark, d)).select("band", r("least").alias("least"), r("largest").alias("largest"), r("mean").alias("mean"), "n")


SPOILT = f"{PB}, ch AS (SELECT vec_id, band, CASE WHEN vec_id % 9 = 0 THEN 0.0 WHEN vec_id % 11 = band THEN 'NaN'::DOUBLE ELSE raw END AS raw FROM pb), v AS (SELECT vec_id, bool_or(isnan(raw)) AS bad, min(CASE WHEN NOT isnan(raw) THEN raw END) AS lo, max(CASE WHEN NOT isnan(raw) THEN raw END) AS c FROM ch GROUP BY 1)"


def spoilt_solution(spark, d) -> DataFrame:
    number = F.array_max(F.filter("dn", lambda v: ~F.isnan(v)))
    return spoilt(W.px(spark, d, signed=True)).select(F.col("dn").alias("dem"), number.alias("chisq"))


@query(f"WITH {SPOILT} SELECT round(avg(CASE WHEN isnan(raw) THEN 0.0 ELSE 1.0 END), 9) AS finite_frac, round(avg(CASE WHEN NOT isnan(raw) AND raw >= 0 THEN 1.0 ELSE 0.0 END), 9) AS positive_frac, (SELECT round(median(c), 6) FROM v) AS chisq_median FROM ch")
def basic_checks(spark, d):
    return Q.basic_checks(spoilt_solution(spark, d)).select(r("finite_frac", 9).alias("finite_frac"), r("positive_frac", 9).alias("positive_frac"), r("chisq_median").alias("chisq_median"))


@query(f"WITH {SPOILT} SELECT count(*) FILTER (bad) AS not_finite, count(*) FILTER (lo < 0) AS negative, median(c) > 10 AS high_chisq FROM v")
def output_expectations(spark, d):
    return Q.expectations(spoilt_solution(spark, d))


CMP = f"{DEM}, cg AS (SELECT vec_id, bin, dem AS g, dem + 1e-3 * (vec_id % 7) AS c FROM dm), er AS (SELECT *, abs(c - g) AS e, abs(c - g) <= 1e-6 + 1e-4 * abs(g) AS close FROM cg)"


def compared(spark, d) -> DataFrame:
    golden = W.dem_rows(spark, d).select("vec_id", F.posexplode("dem").alias("bin", "value"))
    return Q.compare(golden.withColumn("value", F.col("value") + 1e-3 * (F.col("vec_id") % 7)), golden, ["vec_id", "bin"])


@query(f"WITH {CMP} SELECT count(*) AS n, round(max(e), 9) AS max_abs_err, round(avg(e), 9) AS mean_abs_err, round(log10(max(e / (abs(g) + 1e-10))), 6) AS log_max_rel_err, round(corr(c, g), 6) AS correlation, bool_and(close) AS all_close, round(avg(CASE WHEN close THEN 1.0 ELSE 0.0 END), 9) AS within FROM er")
def compare_golden(spark, d):
    return compared(spark, d).select("n", r("max_abs_err", 9).alias("max_abs_err"), r("mean_abs_err", 9).alias("mean_abs_err"), r(F.log10("max_rel_err")).alias("log_max_rel_err"), r("correlation").alias("correlation"), "all_close", r("within", 9).alias("within"))


ALL = (
    f"""{DEM}, g AS (SELECT vec_id, bin, dem FROM dm), cell AS (
    SELECT 'dem' AS name, dem AS g, dem + 1e-3 * (vec_id % 7) AS c FROM g UNION ALL SELECT 'edem', dem * 0.1, dem * 0.1 FROM g
    UNION ALL SELECT 'chisq', max(dem), max(dem) + 1e-9 FROM g GROUP BY vec_id UNION ALL SELECT 'dn_reg', dem * 2, dem * 2 * (1 + 1e-5 * (vec_id % 30)) FROM g),
    er AS (SELECT *, abs(c - g) AS e, abs(c - g) <= 1e-6 + 1e-4 * abs(g) AS close FROM cell)"""
)


@query(f"WITH {ALL} SELECT name, count(*) AS n, round(max(e), 9) AS max_abs_err, round(avg(CASE WHEN close THEN 1.0 ELSE 0.0 END), 9) AS within, bool_and(close) AS passed FROM er GROUP BY 1")
def compare_arrays(spark, d):
    """All arrays of a solution against a golden one, with a verdict for each."""
    rows, k = W.dem_rows(spark, d), F.col("vec_id")
    golden = rows.select("vec_id", "dem", F.transform("dem", lambda v: v * 0.1).alias("edem"), F.array_max("dem").alias("chisq"), F.transform("dem", lambda v: v * 2).alias("dn_reg"))
    computed = golden.withColumns({"dem": F.transform("dem", lambda v: v + 1e-3 * (k % 7)), "chisq": F.col("chisq") + 1e-9, "dn_reg": F.transform("dn_reg", lambda v: v * (1 + 1e-5 * (k % 30)))})
    return Q.compare_solutions(computed, golden, ("vec_id",)).select(F.col("array").alias("name"), "n", r("max_abs_err", 9).alias("max_abs_err"), r("within", 9).alias("within"), "passed")


RAISED = "SELECT vec_id AS id, dn, list_transform(dn, lambda v: sqrt(v + 1)) AS edn FROM (SELECT vec_id, list_transform(embedding[1:6], lambda v: 1000.0 * greatest(CAST(v AS DOUBLE), 0.0) + 1.0) AS dn FROM embeddings)"


@query(
    f"""WITH RECURSIVE mn AS (SELECT [{", ".join(f"avg(1000.0 * greatest(CAST(embedding[{i}] AS DOUBLE), 0.0) + 1.0)" for i in range(1, 7))}] AS m FROM embeddings),
    {X.solution(RAISED, *solver_options({}), scales="mn")}
    SELECT id AS vec_id, valid, round(chisq, 6) AS chisq, CASE WHEN list_sum(list_transform(dem, lambda v: greatest(v, 0.0))) > 0 THEN round(log10(list_sum(list_transform(dem, lambda v: greatest(v, 0.0)))), 5) END AS log_em,
    round(log10(list_sum(edem)), 5) AS log_edem, round(list_sum(elogt), 6) AS elogt_sum, round(list_sum(dn_reg), 4) AS dn_reg_sum FROM sol"""
)
def golden_solve(spark, d):
    """A golden solution: counts raised, responses scaled by the bands' means, solved."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    solution, _ = G.make_golden(W.px(spark, d, signed=True), C.default())
    return solution.select((F.col("y") * 32 + F.col("x")).cast("long").alias("vec_id"), "valid", r("chisq").alias("chisq"), log_of(P.total_em(F.col("dem"))).alias("log_em"), log_sum("edem").alias("log_edem"), r(total("elogt")).alias("elogt_sum"), r(total("dn_reg"), 4).alias("dn_reg_sum"))


@query(f"WITH {DEM}, er AS (SELECT vec_id, bin, 1.0 * (vec_id % 7) + bin AS e FROM dm) SELECT vec_id AS worst_vec_id, bin AS worst_bin FROM er ORDER BY e DESC, vec_id, bin LIMIT 1")
def worst_pixel(spark, d):
    cell = W.dem_rows(spark, d).select("vec_id", F.posexplode("dem").alias("bin", "v"))
    computed = cell.select("vec_id", "bin", (F.col("vec_id") % 7 + F.col("bin")).cast("double").alias("value"))
    return Q.compare(computed, computed.withColumn("value", F.lit(0.0)), ["vec_id", "bin"]).select("worst_vec_id", "worst_bin")


@query("SELECT o_orderpriority, count(*) AS count, round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 4) AS mean, (list(o_totalprice ORDER BY o_totalprice))[CAST(round_even(0.5 * (count(*) - 1), 0) AS BIGINT) + 1] AS p50, (list(o_totalprice ORDER BY o_totalprice))[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1] AS p95, max(o_totalprice) AS max FROM orders GROUP BY 1")
def nearest_rank_percentiles(spark, d):
    out = Q.nearest_rank(W.table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")
    return out.select("o_orderpriority", "count", r("sum", 2).alias("sum"), r("mean", 4).alias("mean"), "p50", "p95", "max")


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_s, round(stddev_pop(o_totalprice), 4) AS std_s, round(median(o_totalprice), 4) AS median_s, round(1000000.0 / avg(o_totalprice), 6) AS px_per_s FROM orders GROUP BY 1")
def wallclock_stats(spark, d):
    out = Q.wallclock(W.table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", 1_000_000)
    return out.select("o_orderpriority", "n", *(r(c, k).alias(c) for c, k in (("mean_s", 4), ("std_s", 4), ("median_s", 4), ("px_per_s", 6))))


#: The upper tail of Student's distribution, by Simpson's rule over the angle whose tangent is t over the root of df.
TAIL = """sm AS (SELECT range AS i, CASE WHEN range IN (0, 20000) THEN 1 WHEN range % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(20001)),
    pv AS (SELECT {key}, exp(lgamma((any_value(df) + 1) / 2) - lgamma(any_value(df) / 2)) / sqrt(pi()) * sum(w * pow(cos(least(th + (pi() / 2 - th) * i / 20000, pi() / 2)), df - 1)) * (pi() / 2 - any_value(th)) / 60000 AS tail
      FROM (SELECT *, atan(abs(t) / sqrt(df)) AS th FROM {source}), sm GROUP BY {key})"""


@query(
    f"""WITH st AS (SELECT event_type AS g, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1),
    te AS (SELECT a.g AS a, b.g AS b, a.n AS n_a, b.n AS n_b, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t, pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) AS df FROM st a JOIN st b ON a.g < b.g),
    {TAIL.format(key="a, b", source="te")}
    SELECT a, b, n_a, n_b, round(t, 6) AS t, round(df, 4) AS df, round(2 * tail, 6) AS p_two, round(CASE WHEN t < 0 THEN tail ELSE 1 - tail END, 6) AS p_less FROM te JOIN pv USING (a, b)"""
)
def welch_pairs(spark, d):
    """Welch's test of each pair of event types."""
    return Q.welch_pairs(W.table(spark, d, "events"), "event_type", "value").select("a", "b", "n_a", "n_b", r("t").alias("t"), r("df", 4).alias("df"), r("p_two").alias("p_two"), r("p_less").alias("p_less"))


@query(
    f"""WITH us AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS x, avg(value) FILTER (event_type = 'view') AS y FROM events GROUP BY 1),
    te AS (SELECT count(*) AS n, avg(x - y) AS m, stddev_samp(x - y) AS s, avg(x - y) / (stddev_samp(x - y) / sqrt(count(*))) AS t, CAST(count(*) - 1 AS DOUBLE) AS df, corr(x, y) AS c FROM us WHERE x IS NOT NULL AND y IS NOT NULL),
    {TAIL.format(key="n", source="te")}
    SELECT te.n, round(m, 6) AS mean, round(s, 6) AS std, round(t, 6) AS t, round(2 * tail, 6) AS p_two, round(CASE WHEN t < 0 THEN tail ELSE 1 - tail END, 6) AS p_less, round(c, 6) AS correlation FROM te JOIN pv USING (n)"""
)
def paired_users(spark, d):
    """Each user's clicks against the same user's views."""
    made = Q.paired(W.table(spark, d, "events"), ["user_id"], "event_type", "value", "click", "view")
    return made.select("n", *(r(c).alias(c) for c in ("mean", "std", "t", "p_two", "p_less", "correlation")))


@query(
    """WITH s AS (SELECT count(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS n_a, count(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS n_b,
    avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS m_a, avg(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS m_b,
    var_samp(o_totalprice) FILTER (o_orderpriority = '1-URGENT') / count(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS va,
    var_samp(o_totalprice) FILTER (o_orderpriority = '5-LOW') / count(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS vb FROM orders)
    SELECT n_a, n_b, round(m_a, 4) AS mean_a, round(m_b, 4) AS mean_b, round((m_a - m_b) / sqrt(va + vb), 6) AS t, round(pow(va + vb, 2) / (va * va / (n_a - 1) + vb * vb / (n_b - 1)), 3) AS df FROM s"""
)
def welch_stats(spark, d):
    out = Q.welch(W.table(spark, d, "orders"), "o_orderpriority", "o_totalprice", "1-URGENT", "5-LOW")
    return out.select("n_a", "n_b", r("mean_a", 4).alias("mean_a"), r("mean_b", 4).alias("mean_b"), r("t").alias("t"), r("df", 3).alias("df"))


@query("SELECT event_type, count(value) AS n, round(min(value), 6) AS least, round(max(value), 6) AS largest, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY ROLLUP (event_type)")
def section_stats(spark, d):
    out = Q.section_stats(W.table(spark, d, "events"), "event_type", "value")
    return out.select("event_type", "n", *(r(c).alias(c) for c in ("least", "largest", "mean", "std")))


def snapshots(spark, d) -> DataFrame:
    return W.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("device"), F.col("o_orderstatus").alias("label")).agg(F.max("o_totalprice").alias("used"))


SNAP = "sn AS (SELECT o_custkey AS device, o_orderstatus AS label, max(o_totalprice) AS used FROM orders GROUP BY 1, 2)"


@query(f"WITH {SNAP} SELECT a.device, round(b.used - a.used, 4) AS delta FROM sn a JOIN sn b ON a.device = b.device WHERE a.label = 'O' AND b.label = 'F'")
def snapshot_delta(spark, d):
    return Q.snapshot_delta(snapshots(spark, d), "O", "F").select("device", r("delta", 4).alias("delta"))


@query(f"WITH {SNAP} SELECT c_custkey AS device, coalesce(max(used), 0) AS peak FROM customer LEFT JOIN sn ON device = c_custkey GROUP BY 1")
def peak_usage(spark, d):
    return Q.peak_usage(W.table(spark, d, "customer").select(F.col("c_custkey").alias("device")), snapshots(spark, d))


@query("SELECT count(*) AS n, count(DISTINCT event_type) AS n_kinds, (SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT DISTINCT event_type AS e FROM events)) AS kinds, CAST(sum(CASE WHEN user_id % 5 > 0 THEN user_id END) AS BIGINT) AS bytes FROM events")
def array_inventory(spark, d):
    rows = W.table(spark, d, "events").select(F.col("event_type").alias("backend"), F.when(F.col("user_id") % 5 > 0, F.col("user_id")).alias("nbytes"))
    return Q.inventory(rows)


@query("SELECT event_type AS task, count(*) AS count, round(sum(d), 4) AS sum, (list(d ORDER BY d))[CAST(round_even(0.5 * (count(*) - 1), 0) AS BIGINT) + 1] AS p50, (list(d ORDER BY d))[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1] AS p95, round(max(d), 6) AS max FROM (SELECT event_type, CASE WHEN event_id % 2 = 0 THEN value ELSE value + 1 END AS d FROM events) WHERE d IS NOT NULL GROUP BY 1")
def task_aggregate(spark, d):
    rows = W.table(spark, d, "events")
    even = F.col("event_id") % 2 == 0
    mixed = rows.select(F.when(even, F.col("event_type")).alias("key"), F.when(~even, F.col("event_type")).alias("task"), F.when(even, F.col("value")).alias("duration"), F.when(~even, F.lit(0.0)).alias("start"), F.when(~even, F.col("value") + 1).alias("stop"))
    return Q.nearest_rank(Q.task_durations(mixed), ["task"], "duration").select("task", "count", r("sum", 4).alias("sum"), "p50", "p95", r("max").alias("max"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: counts to a temperature distribution to its maps."""
    logt = grid()
    solution = solved(spark, d, outputs=("dem", "chisq"))
    return solution.select("frame_id", "y", "x", "valid", "chisq", P.total_em(F.col("dem")).alias("em"), P.peak_logt(F.col("dem"), logt).alias("peak_logt"), P.mean_logt(F.col("dem"), logt).alias("mean_logt"), P.median_logt(F.col("dem"), logt).alias("median_logt"), P.std_logt(F.col("dem"), logt).alias("std_logt"))


MAPPED = f"""WITH RECURSIVE {X.solution(PIXELS, *solver_options({}))}, ps AS (SELECT id, list_transform(dem, lambda v: greatest(v, 0.0)) AS d, {X.doubles(C.default().logt)} AS lt FROM sol),
    ms AS (SELECT *, list_sum(d) AS em, list_inner_product(d, lt) / list_sum(d) AS mean FROM ps)
    SELECT frame_id, y, x, valid, round(chisq, 6) AS chisq, CASE WHEN em > 0 THEN round(log10(em), 5) END AS log_em, CASE WHEN em > 0 THEN round(lt[list_position(d, list_max(d))], 6) END AS peak_logt,
    CASE WHEN em > 0 THEN round(log10(list_inner_product(d, list_transform(lt, lambda v: pow(10, v))) / em), 6) END AS mean_logt,
    CASE WHEN em > 0 THEN round(lt[list_min(list_filter(range(1, len(d) + 1), lambda i: list_sum(d[1:i]) >= 0.5 * em))], 6) END AS median_logt,
    CASE WHEN em > 0 THEN round(sqrt(list_inner_product(d, list_transform(lt, lambda v: pow(v - mean, 2))) / em), 6) END AS std_logt FROM ms JOIN sol USING (id) JOIN px0 USING (id)"""


@query(MAPPED)
def temperature_maps(spark, d):
    maps = entry(spark, d)
    return maps.select("frame_id", "y", "x", "valid", r("chisq").alias("chisq"), log_of(F.col("em")).alias("log_em"), *(r(c).alias(c) for c in ("peak_logt", "mean_logt", "median_logt", "std_logt")))


from . import files  # noqa: E402, F401  (queries that go through files, which use this module's views)
