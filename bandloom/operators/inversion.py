"""The regularised inversion of counts into a temperature distribution.

A pixel's problem is tiny (bands by bins), so Arrow batches of pixels go to
stacked NumPy decompositions: one Python call for thousands of pixels and no
shuffle. Pixels that can't be solved are told apart by a JVM expression before
they reach Python and get their fixed outputs there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels
from .calibration import Calibration

TINY = np.finfo(float).tiny
#: Standard deviation to full width at half maximum.
FWHM = 2 * np.sqrt(2 * np.log(2))
OUTPUTS = ("dem", "edem", "elogt", "chisq", "dn_reg")


@dataclass(frozen=True)
class Options:
    """reg_tweak: target of the discrepancy over the number of bands; max_iter, rgt_fact: rounds towards a positive
    distribution, and by how much each loosens the target; gloci: weights from the bands in ``loci`` (all if empty);
    nmu: regularisation steps (42 up to 40); non_pos: one round; l_emd: weights as they are; rscl: rescale to the counts;
    emd_int, emd_ret: solve for and return the measure by bin; batch: pixels in one Arrow batch; outputs: what to compute."""

    reg_tweak: float = 1.0
    max_iter: int = 10
    rgt_fact: float = 1.5
    gloci: bool = False
    loci: tuple[int, ...] = ()
    nmu: int = 42
    non_pos: bool = False
    l_emd: bool = False
    rscl: bool = False
    emd_int: bool = False
    emd_ret: bool = False
    batch: int = 256
    outputs: tuple[str, ...] = OUTPUTS

    @property
    def steps(self) -> int:
        return 42 if self.nmu <= 40 else self.nmu

    @property
    def rounds(self) -> int:
        return 1 if self.non_pos else self.max_iter


#: Of a system's squared singular values, least over largest: from WELL on, its rows' products give all of them to ten
#: digits; down to ILL, vectors of those products, turned until the rows they make are orthogonal, do; below, the system itself.
WELL, ILL = 1e-5, 1e-14


def turned(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations (m, n, n) that make the nearly orthogonal rows of ``w`` (m, n, k) orthogonal, and where they were found.

    Pairs of rows are turned by their products, which are right to the last digits of both lengths; a pair that is orthogonal
    in all of a batch is left out, which is most of them.
    """
    m, n, _ = w.shape
    g = np.matmul(w, w.transpose(0, 2, 1)).transpose(1, 2, 0).copy()
    turns = np.zeros((n, n, m))
    turns[np.arange(n), np.arange(n)] = 1.0
    for _ in range(6):
        still = np.zeros(m, bool)
        for p in range(n):
            for q in range(p + 1, n):
                off = np.abs(g[p, q]) > 1e-13 * np.sqrt(np.abs(g[p, p] * g[q, q]))
                if not off.any():
                    continue
                still |= off
                z = (g[q, q] - g[p, p]) / np.where(off, 2 * g[p, q], 1.0)
                t = np.where(off, np.where(z < 0, -1.0, 1.0) / (np.abs(z) + np.sqrt(1 + z * z)), 0.0)
                c = 1 / np.sqrt(1 + t * t)
                s = c * t
                for x in (g, g.transpose(1, 0, 2), turns):
                    x[p], x[q] = c * x[p] - s * x[q], s * x[p] + c * x[q]
        if not still.any():
            break
    return turns.transpose(2, 0, 1), ~still


def decomposed(systems: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Singular vectors and values, in any order, of wide systems, stacked, as ``svd`` gives them: from the small matrix of their rows' products, at half the cost."""
    m, nf, nt = systems.shape
    if nf > nt:
        return np.linalg.svd(systems, full_matrices=False)
    s2, u = np.linalg.eigh(np.matmul(systems, systems.transpose(0, 2, 1)))
    vt = np.matmul(u.transpose(0, 2, 1), systems)
    good = s2[:, 0] > WELL * s2[:, -1]
    if not good.all():
        at = np.flatnonzero(~good)
        with np.errstate(all="ignore"):
            turns, good[at] = turned(vt[at])
        vt[at], u[at] = np.matmul(turns, vt[at]), np.matmul(u[at], turns.transpose(0, 2, 1))
    s = np.sqrt(np.einsum("mkt,mkt->mk", vt, vt))
    good &= s.min(axis=1) ** 2 > ILL * s.max(axis=1) ** 2
    vt /= np.maximum(s, TINY)[:, :, None]
    bad = np.flatnonzero(~good)
    if len(bad):
        u[bad], s[bad], vt[bad] = np.linalg.svd(systems[bad], full_matrices=False)
    return u, s, vt


class Spectrum:
    """Decomposed systems of many pixels, with the discrepancy of every regularisation step."""

    def __init__(self, systems: np.ndarray, data: np.ndarray, steps: int):
        self.u, self.s, self.vt = decomposed(systems)
        self.coef = np.matmul(data[:, None, :], self.u)[:, 0]
        safe = np.maximum(self.s, TINY)
        lo = np.maximum(safe.min(axis=1) ** 2 * 1e-4, 1e-300)
        hi = safe.max(axis=1)
        hi = np.where(hi > lo, hi, lo * 10)
        self.mu = np.exp(np.log(lo)[:, None] + np.log(hi / lo)[:, None] * np.linspace(0, 1, max(steps, 2)))
        left = (safe**2)[:, :, None] + self.mu[:, None, :]
        np.divide(self.mu[:, None, :], left, out=left)
        np.square(left, out=left)
        self.misfit = np.matmul(np.square(self.coef)[:, None, :], left)[:, 0]
        self.top = safe.max(axis=1) ** 2

    def choose(self, target: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The first step whose misfit is nearest to the target."""
        at = np.argmin(np.abs(self.misfit[rows] - target[:, None]), axis=1)
        return self.mu[np.arange(len(self.mu))[rows], at]

    def filters(self, lam: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        s = self.s[rows]
        return s / (s**2 + lam[:, None])

    def solve(self, filters: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.matmul((filters * self.coef[rows])[:, None, :], self.vt[rows])[:, 0]


def smooth(w: np.ndarray) -> np.ndarray:
    inner = w.copy()
    inner[:, [0, -1]] = 0
    wide = np.pad(inner, ((0, 0), (2, 2)))
    mean = sum(wide[:, k : k + w.shape[1]] for k in range(5)) / 5
    return np.maximum(mean / np.maximum(w.max(axis=1, keepdims=True), 1e-12), 1e-8)


def resolution(left: np.ndarray, right: np.ndarray, logt: np.ndarray, dlogt: np.ndarray) -> np.ndarray:
    """Half the distance between the outermost of 51 points at which a row is at least half of its column's largest value.

    Of the kernels ``left`` (m, nt, nf) times ``right`` (nf, nt). Row i is held against column i's largest value. Where no
    point is, the bin's width.
    """
    points = logt.min() + 1e-8 + (logt.max() - logt.min()) * np.arange(51) / 51
    at = np.clip(np.searchsorted(logt, points, side="right") - 1, 0, max(len(logt) - 2, 0))
    nxt = np.minimum(at + 1, len(logt) - 1)
    share = (points - logt[at]) / (logt[nxt] - logt[at] + 1e-300) if len(logt) > 1 else np.zeros(51)
    weights = np.zeros((len(logt), 51))  # a point's value is a weighted sum of two bins, so products of matrices of few columns give all
    np.add.at(weights, (at, np.arange(51)), 1 - share)
    np.add.at(weights, (nxt, np.arange(51)), share)
    m, nt, nf = left.shape
    flat = left.reshape(m * nt, nf)
    half = (flat @ right).reshape(m, nt, nt).max(axis=1).ravel() / 2
    over = flat @ (right @ weights) >= half[:, None]
    first, last = over.argmax(axis=1), 50 - over[:, ::-1].argmax(axis=1)
    some = over[np.arange(m * nt), first]
    return np.where(some, (points[last] - points[first]) / 2, np.tile(dlogt, m)).reshape(m, nt)


def solve_batch(dn: np.ndarray, edn: np.ndarray, cal: Calibration, o: Options) -> dict[str, np.ndarray]:
    """All outputs for pixels by bands of counts and uncertainties. Pixels that can't be solved are zeros, and ``elogt`` the bins' widths."""
    r, logt, dlogt = cal.rmatrix, cal.logt, cal.dlogt
    (m, nf), nt = dn.shape, len(logt)
    out = {"dem": np.zeros((m, nt)), "edem": np.zeros((m, nt)), "elogt": np.tile(dlogt, (m, 1)), "chisq": np.zeros(m), "dn_reg": np.zeros((m, nf)), "valid": np.zeros(m, bool)}
    with np.errstate(all="ignore"):
        floored = np.maximum(edn, np.maximum(1e-12, 1e-6 * np.median(edn, axis=1, keepdims=True)))
        data = dn / floored
        ok = np.isfinite(data).all(axis=1) & (data > 0).all(axis=1)
    out["valid"] = ok
    if not ok.any():
        return out
    dn, edn, floored, data = dn[ok], edn[ok], floored[ok], data[ok]
    system = r.T[None] / floored[:, :, None]
    target = np.full(len(dn), float(nf) * o.reg_tweak)
    if o.gloci:
        bands = list(o.loci) or list(range(nf))
        w = np.min(dn[:, None, bands] / np.maximum(r[:, bands], 1e-300)[None], axis=2)
    else:
        first = Spectrum(system * np.sqrt(dlogt), data, o.steps)
        start = np.sqrt(dlogt) * first.solve(first.filters(first.choose(target)))
        w = np.where((start > 0) & (start > 1e-4 * start.max(axis=1, keepdims=True)), start, 1.0)
    w = smooth(w)
    weigh = np.abs(w) if o.l_emd else np.sqrt(np.abs(w)) / np.sqrt(dlogt)
    main = Spectrum(system * weigh[:, None, :], data, o.steps)
    filters, dem = np.empty_like(main.s), np.empty((len(dn), nt))
    rows = np.arange(len(dn))
    for _ in range(max(o.rounds, 1)):  # only pixels that are still negative somewhere go on
        lam = np.maximum(main.choose(target[rows], rows), 1e-12 * main.top[rows])
        filters[rows] = main.filters(lam, rows)
        dem[rows] = weigh[rows] * main.solve(filters[rows], rows)
        rows = rows[(dem[rows] < 0).any(axis=1)]
        if not len(rows):
            break
        target[rows] *= o.rgt_fact
    predicted = dem @ r
    edem = np.zeros_like(dem)
    if "edem" in o.outputs or "elogt" in o.outputs:
        edem = weigh * np.sqrt(np.matmul(np.square(filters)[:, None, :], np.square(main.vt))[:, 0])
    if "elogt" in o.outputs:
        gain = np.matmul(main.vt.transpose(0, 2, 1), filters[:, :, None] * main.u.transpose(0, 2, 1) / floored[:, None, :])
        gain *= weigh[:, :, None]
        out["elogt"][ok] = resolution(gain, r.T, logt, dlogt)
    if o.rscl:
        ratio = np.mean(dn / np.maximum(predicted, 1e-300), axis=1)[:, None]
        dem, edem, predicted = dem * ratio, edem * ratio, dem * ratio @ r
    out["chisq"][ok] = np.sum(((dn - predicted) / edn) ** 2, axis=1) / nf
    out["dem"][ok], out["edem"][ok], out["dn_reg"][ok] = dem, edem, predicted
    return out


def finish(out: dict[str, np.ndarray], cal: Calibration, o: Options) -> dict[str, np.ndarray]:
    """Physical units: the scale, widths as standard deviations, and the measure by bin or by temperature."""
    factor = np.ones(len(cal.logt))
    if o.emd_int and not o.emd_ret:
        factor = 1 / cal.factor
    elif o.emd_ret and not o.emd_int:
        factor = cal.factor
    return out | {"dem": out["dem"] * cal.scale * factor, "edem": out["edem"] * cal.scale * factor, "elogt": out["elogt"] / FWHM}


def spread(px: DataFrame, partitions: int | None = None, target_bytes: int = 32 << 20) -> DataFrame:
    """Pixels dealt evenly to tasks of about ``target_bytes`` by the plan's own estimate, and to every core at least.

    A pixel's work is large against its bytes, and adaptive plans, which go by bytes, would join what is dealt by key
    into a few tasks. Pixels read from files need no such step: scans are cut by ``spark.sql.files.maxPartitionBytes``.
    """
    if partitions is None:
        size = int(str(px._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        partitions = min(max(px.sparkSession.sparkContext.defaultParallelism, -(-size // target_bytes)), 1_000_000)
    return px.repartition(partitions)


def solve_with(px: DataFrame, solver: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], outputs: str, nf: int = 6, dn_col: str = "dn", edn_col: str = "edn") -> DataFrame:
    """``px`` without its counts, and what a solver of the user's makes of them.

    The solver takes counts and uncertainties of many pixels, and returns a column of ``outputs`` (a schema of doubles
    and arrays of doubles) under each name. All arrays of a pixel have ``nf`` values.
    """
    keep = [f for f in px.schema if f.name not in (dn_col, edn_col)]
    source = px.select(*(px[f.name] for f in keep), px[dn_col].cast("array<double>"), px[edn_col].cast("array<double>"))
    names = [x.split()[0] for x in outputs.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dn, edn = (np.asarray(b.column(len(keep) + i).flatten()).reshape(-1, nf) for i in range(2))
            got = {k: np.asarray(v, float) for k, v in solver(dn, edn).items()}
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(got[x]) if got[x].ndim == 1 else _lists(got[x]) for x in names)], names=[*(f.name for f in keep), *names])

    return source.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), outputs]))


def _lists(values: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).ravel()))


def solve_dem(px: DataFrame, cal: Calibration, options: Options = Options(), dn_col: str = "dn", edn_col: str = "edn") -> DataFrame:
    """``px`` without its counts' uncertainties, and the options' outputs and ``valid``.

    A band missing, null or not finite makes a pixel invalid. Batches don't influence each other, so any partitioning
    gives the same rows.
    """
    nf = cal.rmatrix.shape[1]
    taken = {*OUTPUTS, "valid"}
    keep = [f for f in px.schema if f.name not in {dn_col, edn_col} | taken]
    ready = F.coalesce(F.size(dn_col) == nf, F.lit(False)) & F.coalesce(F.size(edn_col) == nf, F.lit(False))
    zeros = F.array(*[F.lit(0.0)] * nf)
    as_double = lambda c: F.when(ready, F.transform(c, lambda v: F.coalesce(v.cast("double"), F.lit(float("nan"))))).otherwise(zeros)
    source = px.select(*(px[f.name] for f in keep), as_double(F.col(dn_col)).alias("__dn"), as_double(F.col(edn_col)).alias("__edn"))
    o, at = options, len(keep)
    kinds = {"chisq": "double"}
    names = [x for x in OUTPUTS if x in o.outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, o.batch):
                b = whole.slice(k, o.batch)
                dn, edn = (np.asarray(b.column(at + i).flatten()).reshape(-1, nf) for i in range(2))
                got = finish(solve_batch(dn, edn, cal, o), cal, o)
                yield pa.RecordBatch.from_arrays([*b.columns[:at], *(pa.array(got[x]) if x == "chisq" else _lists(got[x]) for x in names), pa.array(got["valid"])], names=[*(f.name for f in keep), *names, "valid"])

    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *(f"{x} {kinds.get(x, 'array<double>')}" for x in names), "valid boolean"]
    return source.mapInArrow(run, ", ".join(fields))


# -- single systems -----------------------------------------------------------


def safe_svd(a: np.ndarray, full: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a matrix made finite: NaN counts 0, and everything stays within 1e12. Failure is a RuntimeError."""
    a = np.clip(np.nan_to_num(np.asarray(a, float), nan=0.0, posinf=1e30, neginf=-1e30), -1e12, 1e12)
    try:
        return np.linalg.svd(a, full_matrices=full)
    except (np.linalg.LinAlgError, ValueError) as e:
        raise RuntimeError(f"no decomposition: {e}") from e


def safe_pinv(a: np.ndarray, rcond: float = 1e-12) -> np.ndarray:
    """Inverse on the singular vectors whose values exceed ``rcond`` of the largest."""
    u, s, vt = safe_svd(a)
    keep = s > rcond * (s[0] if len(s) else 0)
    return (vt[keep].T / s[keep]) @ u[:, keep].T


def gsvd(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """alpha, beta, U, V, W of a pair of matrices, from the decomposition of a times the inverse of b, padded to a square."""
    ab = a @ safe_pinv(b)
    n = max(ab.shape)
    u, s, vt = safe_svd(np.pad(ab, [(0, n - k) for k in ab.shape]), full=True)
    beta = 1 / np.hypot(1, s)
    w = safe_pinv(safe_pinv(np.diag(beta)) @ vt @ b)
    return s * beta, beta, u.T[:, : ab.shape[0]], vt.T, w


def gsvd_values(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha and beta of many matrices ``a`` (stacked) with one ``b``, as :func:`gsvd` gives them."""
    ab = np.nan_to_num(np.asarray(a, float) @ safe_pinv(b), nan=0.0, posinf=1e12, neginf=-1e12)
    s = np.linalg.svd(ab, compute_uv=False)
    s = np.pad(s, ((0, 0), (0, max(ab.shape[1:]) - s.shape[1])))
    beta = 1 / np.hypot(1, s)
    return s * beta, beta


def gsvd_many(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Factors of many pairs of matrices, stacked: a (m, p, n) and b (m, q, n).

    ``alpha`` and ``beta`` (m, k) by falling alpha, k the larger of p and q; the rows of ``u`` (m, k, p) and ``v`` (m, k, q) and
    ``x`` (m, k, n) with a = u' alpha x, where b has full column rank, and b = v' beta x; ``w`` (m, n, k) is x's inverse.
    """
    a, b = (np.nan_to_num(np.asarray(x, float), nan=0.0, posinf=1e12, neginf=-1e12) for x in (a, b))
    (m, p, _), q = a.shape, b.shape[1]
    ab = a @ np.linalg.pinv(b, rcond=1e-12)
    k = max(p, q)
    u, s, vt = np.linalg.svd(np.pad(ab, [(0, 0), (0, k - p), (0, k - q)]))
    beta = 1 / np.hypot(1, s)
    x = vt[:, :, :q] @ b / beta[:, :, None]
    return {"alpha": s * beta, "beta": beta, "u": u.transpose(0, 2, 1)[:, :, :p], "v": vt[:, :, :q], "x": x, "w": np.linalg.pinv(x, rcond=1e-12)}


def gsvd_frame(rows: DataFrame, keys: list[str], a: str = "a", b: str = "b", batch: int = 1024) -> DataFrame:
    """``keys`` and the factors of each row's pair of matrices (arrays of rows), as :func:`gsvd_many` gives them. Rows may differ in shape; a row without a whole pair has null factors."""
    names = ("alpha", "beta", "u", "v", "x", "w")
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(*keys).schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{n} array<{'double' if n in ('alpha', 'beta') else 'array<double>'}>" for n in names)])
    whole = lambda c: (F.size(c) > 0) & (F.size(F.array_distinct(F.transform(c, lambda r: F.coalesce(F.size(r), F.lit(-1))))) == 1) & (F.size(F.get(c, F.lit(0))) > 0) & F.forall(F.flatten(c), lambda v: v.isNotNull())
    fits = F.coalesce(whole(a) & whole(b) & (F.size(F.get(a, F.lit(0))) == F.size(F.get(b, F.lit(0)))), F.lit(False))
    shape = F.when(fits, F.array(F.size(a), F.size(b), F.size(F.get(a, F.lit(0)))))
    values = lambda c: F.when(fits, F.transform(F.flatten(c), lambda v: v.cast("double")))
    source = rows.select(*keys, shape.alias("__shape"), values(a).alias("__a"), values(b).alias("__b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for lo in range(0, given.num_rows, batch):
                one = given.slice(lo, batch)
                shapes = one.column(len(keys)).to_pylist()
                for kind in dict.fromkeys(map(lambda x: tuple(x) if x else None, shapes)):
                    at = pa.array([i for i, x in enumerate(shapes) if (tuple(x) if x else None) == kind], pa.int32())
                    part = one.take(at)
                    if kind is None:
                        made = [pa.nulls(len(at), pa.list_(pa.float64()) if n in ("alpha", "beta") else pa.list_(pa.list_(pa.float64()))) for n in names]
                    else:
                        p, q, n = kind
                        x, y = (np.asarray(part.column(len(keys) + 1 + i).flatten()).reshape(-1, r, n) for i, r in enumerate((p, q)))
                        got = gsvd_many(x, y)
                        made = [_lists(got[c]) if got[c].ndim == 2 else _matrices(got[c]) for c in names]
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *made], names=[*keys, *names])

    return source.mapInArrow(run, schema)


def _matrices(values: np.ndarray) -> pa.Array:
    m, rows, columns = values.shape
    inner = _lists(np.ascontiguousarray(values).reshape(m * rows, columns))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m * rows + 1, rows, dtype=np.int32)), inner)


#: Rows whose misfits (rows by steps by bands) are held at once.
REG_ROWS = 64


def reg_maps_stacked(alpha: np.ndarray, beta: np.ndarray, u: np.ndarray, data: np.ndarray, err: np.ndarray, reg_tweak: float = 1.0, nmu: int = 500) -> np.ndarray:
    """:func:`reg_maps` where each row of ``data`` has its own decomposition: alpha and beta (m, k), u (m, k, nf)."""
    if len(data) > REG_ROWS:
        parts = [slice(i, i + REG_ROWS) for i in range(0, len(data), REG_ROWS)]
        return np.concatenate([reg_maps_stacked(alpha[p], beta[p], u[p], data[p], err, reg_tweak, nmu) for p in parts])
    nf = data.shape[1]
    a, b = alpha[:, :nf], beta[:, :nf]
    values = a / np.maximum(b, TINY)
    good = np.isfinite(values) & (values > 0)
    some = good.any(axis=1)
    lo = np.where(some, np.maximum(np.where(good, values, np.inf).min(axis=1) ** 2 * 1e-4, 1e-300), 1e-8)
    hi = np.where(some, np.where(good, values, -np.inf).max(axis=1), 1e2)
    hi = np.where(hi > lo, hi, lo * 10)
    mu = np.exp(np.log(lo)[:, None] + np.log(hi / lo)[:, None] * np.linspace(0, 1, max(nmu, 2)))
    weight = mu[:, :, None] * (b**2)[:, None, :]
    coef = np.einsum("mkf,mf->mk", u[:, :nf], data)
    misfit = np.square(weight / ((a**2)[:, None, :] + weight) * coef[:, None, :]).sum(axis=2)
    goal = np.square(np.broadcast_to(err, data.shape)).sum(axis=1) * reg_tweak
    return mu[np.arange(len(mu)), np.abs(misfit - goal[:, None]).argmin(axis=1)]


def reg_maps(sigma_a: np.ndarray, sigma_b: np.ndarray, u: np.ndarray, data: np.ndarray, err: np.ndarray, reg_tweak: float = 1.0, nmu: int = 500) -> np.ndarray:
    """For each row of ``data`` the regularisation whose misfit is nearest to the errors' squares, over a geometric range of the generalised values."""
    nf = data.shape[1]
    a, b, u = (np.asarray(x, float) for x in (sigma_a, sigma_b, u))
    if u.ndim != 2 or max(u.shape) < nf:
        raise ValueError("need a row of vectors for each band")
    u = u if u.shape[0] >= nf else u.T
    values = a[:nf] / np.maximum(b[:nf], TINY)
    values = values[np.isfinite(values) & (values > 0)]
    lo, hi = (max(values.min() ** 2 * 1e-4, 1e-300), values.max()) if len(values) else (1e-8, 1e2)
    mu = np.geomspace(lo, hi if hi > lo else lo * 10, max(nmu, 2))
    weight = mu[:, None] * b[:nf] ** 2
    share = weight / (a[:nf] ** 2 + weight)
    goal = np.sum(np.square(np.broadcast_to(err, data.shape)), axis=1) * reg_tweak
    at = np.empty(len(data), int)
    for i in range(0, len(data), REG_ROWS):
        misfit = np.square(share)[None] * np.square(data[i : i + REG_ROWS] @ u[:nf].T)[:, None, :]
        at[i : i + REG_ROWS] = np.argmin(np.abs(misfit.sum(axis=2) - goal[i : i + REG_ROWS, None]), axis=1)
    return mu[at]


def reg_map(sigma_a: np.ndarray, sigma_b: np.ndarray, u: np.ndarray, data: np.ndarray, err: np.ndarray, reg_tweak: float = 1.0, nmu: int = 500) -> float:
    """:func:`reg_maps` of one pixel."""
    return float(reg_maps(sigma_a, sigma_b, u, np.asarray(data, float)[None], err, reg_tweak, nmu)[0])


def lstsq_clip(dn: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least squares without regularisation, clipped at 0: the distribution, predicted counts, and the summed squared residual."""
    dem = np.clip(dn @ np.linalg.pinv(r), 0, None)
    predicted = dem @ r
    return dem, predicted, np.sum((dn - predicted) ** 2, axis=-1)
