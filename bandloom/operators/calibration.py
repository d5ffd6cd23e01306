"""Temperature grids and responses.

One calibration has tens of rows, so it is made with NumPy on the driver and
travels as literals; :mod:`bandloom.operators.instruments` makes those of many
instruments as tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

SCALE = 1e15


def grid(nt: int = 50, lo: float = 5.5, hi: float = 7.5) -> np.ndarray:
    return np.linspace(lo, hi, nt)


def bins_for(nmu: int | None) -> int:
    """How many bins go with a number of regularisation steps: six tenths, from 8 to 64; 24 without one."""
    return max(8, min(64, round(0.6 * nmu))) if nmu else 24


def edges(logt: np.ndarray) -> np.ndarray:
    """Bin edges half a mean step around evenly spaced centres; a step of 0.1 where there is one centre."""
    step = float(np.mean(np.diff(logt))) if len(logt) > 1 else 0.1
    return logt[0] - step / 2 + step * np.arange(len(logt) + 1)


def jacobian(logt: np.ndarray, dlogt: np.ndarray) -> np.ndarray:
    """Width of each bin in linear temperature."""
    return 10.0**logt * np.log(10.0**dlogt)


def gaussians(logt: np.ndarray, centres: np.ndarray, width: float) -> np.ndarray:
    return np.exp(-0.5 * ((logt[:, None] - centres[None, :]) / width) ** 2)


def synthetic(logt: np.ndarray, nf: int = 6, width: float = 0.2, normalize: str = "l1", include_jacobian: bool = True) -> np.ndarray:
    """Responses of bins by bands: Gaussians at 10 to 90 % of the range.

    include_jacobian multiplies by each bin's width; normalize: ``l1`` or ``colmax`` divides each band, ``none`` doesn't.
    """
    lo, hi = logt[0], logt[-1]
    out = gaussians(logt, lo + (hi - lo) * np.linspace(0.1, 0.9, nf), width)
    if include_jacobian:
        out = out * np.diff(edges(logt))[:, None]
    if normalize == "l1":
        return out / (out.sum(axis=0) + 1e-12)
    if normalize == "colmax":
        return out / (out.max(axis=0) + 1e-12)
    if normalize != "none":
        raise ValueError(f"unknown normalisation {normalize!r}")
    return out


def legacy(logt: np.ndarray, nf: int = 6) -> np.ndarray:
    """Gaussians of width 0.2 at fixed centres from 5.7 to 7.3."""
    return gaussians(logt, np.linspace(5.7, 7.3, nf), 0.2)


def sampled(nf: int = 6, lo: float = 5.5, hi: float = 7.5, n_tresp: int = 200, nt: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Finely sampled responses, their log T, and bin edges in Kelvin."""
    if hi <= lo or n_tresp < 10 or nt < 1 or nf < 1:
        raise ValueError("need hi > lo, n_tresp >= 10, nt >= 1 and nf >= 1")
    t = np.linspace(lo, hi, n_tresp)
    centres = np.array([(lo + hi) / 2]) if nf == 1 else np.linspace(lo + 0.2, hi - 0.2, nf)
    return gaussians(t, centres, 0.15) + 1e-30, t, np.logspace(lo, hi, nt + 1)


@dataclass(frozen=True)
class Calibration:
    """What the solver needs: the response of bins by bands (scaled), centres, widths, and the scale."""

    rmatrix: np.ndarray
    logt: np.ndarray
    dlogt: np.ndarray
    scale: float = SCALE

    @property
    def factor(self) -> np.ndarray:
        return jacobian(self.logt, self.dlogt)


def prepare(tresp: np.ndarray, tresp_logt: np.ndarray, temps: np.ndarray, emd_int: bool = False) -> Calibration:
    """Responses interpolated to the bins of ``temps`` (edges in Kelvin), in the logarithm of the response.

    Values that aren't positive count as their band's least positive one. Without ``emd_int`` a bin's width
    in temperature multiplies its row.
    """
    log_edges = np.log10(np.asarray(temps, float))
    dlogt = np.diff(log_edges)
    logt = log_edges[0] + dlogt * (np.arange(len(dlogt)) + 0.5)
    tresp = np.asarray(tresp, float)
    floor = np.min(np.where(tresp > 0, tresp, np.inf), axis=0)
    filled = np.where(tresp > 0, tresp, np.where(np.isfinite(floor), floor, 0.0))
    logs = np.log10(np.maximum(filled, 1e-300))
    out = np.stack([10.0 ** np.interp(logt, tresp_logt, logs[:, f]) for f in range(tresp.shape[1])], axis=1)
    return Calibration((out if emd_int else out * jacobian(logt, dlogt)[:, None]) * SCALE, logt, dlogt)


def binned(nt: int = 24, nf: int = 6, n_tresp: int = 200, lo: float = 5.5, hi: float = 7.5, include_jacobian: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled responses averaged over bins, the last of which includes its upper edge; an empty bin is interpolated."""
    tresp, t, temps = sampled(nf, lo, hi, n_tresp, nt)
    e = np.log10(temps)
    logt, dlogt = (e[1:] + e[:-1]) / 2, np.diff(e)
    at = np.searchsorted(e, t, side="right") - 1
    at[t == e[-1]] = nt - 1
    at, tresp_in = at[(at >= 0) & (at < nt)], tresp[(at >= 0) & (at < nt)]
    n = np.bincount(at, minlength=nt)[:, None]
    sums = np.stack([np.bincount(at, column, nt) for column in tresp_in.T], axis=1)
    between = np.stack([np.interp(logt, t, column) for column in tresp.T], axis=1)
    out = np.where(n > 0, sums / np.maximum(n, 1), between)
    if include_jacobian:
        out = out * jacobian(logt, dlogt)[:, None]
    return np.maximum(out, 1e-30), logt, dlogt


def check_response(rmatrix: np.ndarray, logt: np.ndarray, dlogt: np.ndarray, nf: int = 6) -> None:
    """A response of the right shape, positive, over a rising grid with positive widths; else a ValueError."""
    if rmatrix.ndim != 2 or rmatrix.shape != (len(logt), nf):
        raise ValueError(f"response is {rmatrix.shape}, not {(len(logt), nf)}")
    if len(dlogt) != len(logt) or not (np.asarray(dlogt) > 0).all():
        raise ValueError("widths must be positive, one for each bin")
    if not np.isfinite(rmatrix).all() or not (rmatrix > 0).all():
        raise ValueError("responses must be finite and positive")
    if not (np.diff(logt) > 0).all():
        raise ValueError("the grid must rise")


def complete(tresp: np.ndarray | None, tresp_logt: np.ndarray | None, temps: np.ndarray | None, nf: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Responses, their log T and bin edges in Kelvin, where what is missing is made: the grid of 50 bins unless both centres and
    edges are given, and the synthetic responses. Edges that aren't above 100 are logarithms. Parts that don't fit are a ValueError."""
    if tresp_logt is None or temps is None:
        tresp_logt = grid()
        temps = 10.0 ** edges(tresp_logt)
    tresp_logt, temps = np.asarray(tresp_logt, float), np.asarray(temps, float)
    tresp = synthetic(tresp_logt, nf) if tresp is None else np.asarray(tresp, float)
    if tresp.ndim != 2 or tresp.shape[1] != nf or tresp_logt.shape != tresp.shape[:1] or temps.ndim != 1 or len(temps) < 2:
        raise ValueError(f"responses {tresp.shape}, log T {tresp_logt.shape} and edges {temps.shape} don't fit {nf} bands")
    if not all(np.isfinite(x).all() for x in (tresp, tresp_logt, temps)) or (tresp < 0).any():
        raise ValueError("responses, log T and edges must be finite, and responses not negative")
    temps = temps if temps.max() > 100 else 10.0**temps
    if not (np.diff(temps) > 0).all() or not (np.diff(tresp_logt) > 0).all():
        raise ValueError("log T and edges must rise")
    return tresp, tresp_logt, temps


@lru_cache(maxsize=32)
def default(nt: int = 24, nf: int = 6) -> Calibration:
    """The synthetic calibration for ``nt`` bins and ``nf`` bands, made once."""
    return prepare(*sampled(nf=nf, nt=nt))


def double_jacobian(nt: int = 24, nf: int = 6) -> Calibration:
    """As the default, with the bins' widths in temperature multiplied in twice, as some published runs had it."""
    one = default(nt, nf)
    return Calibration(one.rmatrix * one.factor[:, None], one.logt, one.dlogt)
