"""Solvers as functions in SQL text: a struct for each pixel, or a row for each of its bins.

All take Arrow batches. A solver of the user's own is named ``module:function``; workers import it once, so its module has
to be on their path (``--py-files``). It gets counts and uncertainties of many pixels, as :func:`inversion.solve_with` says.
"""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import inversion as V
from .calibration import Calibration

Solver = Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]
SOLUTION = "dem array<double>, edem array<double>, elogt array<double>, chisq double, dn_reg array<double>, valid boolean"
BINS = "frame_id string, y int, x int, bin int, logt double, dem double, edem double, elogt double, valid boolean"


@functools.lru_cache(maxsize=None)
def named(where: str) -> Solver:
    """The function of a module, imported once."""
    module, _, name = where.partition(":")
    if not module or not name:
        raise ValueError(f"{where!r} is no module:function")
    found = getattr(importlib.import_module(module), name, None)
    if not callable(found):
        raise ValueError(f"{module} has no function {name}")
    return found


def counts(column: pa.Array, nf: int) -> np.ndarray:
    """Pixels by bands; NaN throughout where a pixel has another number of bands, NaN for a null."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.full((len(column), nf), np.nan)
    good = sizes == nf
    out[good] = values[np.repeat(good, sizes)].reshape(-1, nf)
    return out


def packed(got: dict[str, np.ndarray], fields: list[tuple[str, str]]) -> list[pa.Array]:
    kinds = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    return [V._lists(np.asarray(got[n], float)) if k.startswith("array") else pa.array(np.asarray(got[n]), kinds[k]) for n, k in fields]


def fields_of(schema: str) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in schema.split(", ")]


def register_solver(spark: SparkSession, name: str, cal: Calibration, options: V.Options = V.Options()) -> None:
    """``name(dn, edn)`` in SQL: a struct of all outputs and ``valid``. A pixel without all its bands is invalid."""
    nf, fields = cal.rmatrix.shape[1], fields_of(SOLUTION)

    def solve(dn: pa.Array, edn: pa.Array) -> pa.Array:
        got = V.finish(V.solve_batch(counts(dn, nf), counts(edn, nf), cal, options), cal, options)
        return pa.StructArray.from_arrays(packed(got, fields), names=[n for n, _ in fields])

    spark.udf.register(name, F.arrow_udf(solve, returnType=T._parse_datatype_string(SOLUTION)))


def register_user_solver(spark: SparkSession, name: str, where: str, outputs: str, nf: int = 6) -> None:
    """``name(dn, edn)`` in SQL: a struct of ``outputs`` (doubles and arrays of doubles) by the solver ``where``, which gets NaN for what a pixel lacks."""
    fields = fields_of(outputs)

    def solve(dn: pa.Array, edn: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(packed(named(where)(counts(dn, nf), counts(edn, nf)), fields), names=[n for n, _ in fields])

    named(where)  # an error here rather than in a task
    spark.udf.register(name, F.arrow_udf(solve, returnType=T._parse_datatype_string(outputs)))


def register_bins(spark: SparkSession, name: str, cal: Calibration, options: V.Options = V.Options()) -> None:
    """``name(TABLE(px))``: a row for each bin of each pixel (frame_id, y, x, dn, edn), batch by batch where the table's rows lie.

    With ``PARTITION BY`` a key's batches meet in one task, still one at a time. Arrow table functions can't stand behind
    LATERAL in Spark 4.1; a table argument takes its place.
    """
    (nt, nf), logt = cal.rmatrix.shape, cal.logt

    class Bins:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            for at in range(0, batch.num_rows, options.batch):
                b = batch.slice(at, options.batch)
                got = V.finish(V.solve_batch(counts(b.column("dn"), nf), counts(b.column("edn"), nf), cal, options), cal, options)
                each = pa.array(np.repeat(np.arange(b.num_rows, dtype=np.int32), nt))
                keys = [b.column(c).take(each) for c in ("frame_id", "y", "x")]
                flat = [pa.array(np.ascontiguousarray(got[c]).ravel()) for c in ("dem", "edem", "elogt")]
                bins = [pa.array(np.tile(np.arange(nt, dtype=np.int32), b.num_rows)), pa.array(np.tile(logt, b.num_rows))]
                yield pa.Table.from_arrays([*keys, *bins, *flat, pa.array(np.repeat(got["valid"], nt))], names=[n for n, _ in fields_of(BINS)])

    spark.udtf.register(name, F.arrow_udtf(Bins, returnType=BINS))
