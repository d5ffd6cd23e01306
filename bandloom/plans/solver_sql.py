"""The inversion in SQL, for comparison with the solver: one-sided Jacobi rotations in place of a library's decomposition.

A pixel's system is a list of rows, one for each band, with the data as a last element. Rotating pairs of rows until all
are orthogonal gives singular values (their lengths), right vectors (their directions) and the data in that basis, so
misfits, filters, uncertainties and the resolution kernel follow without left vectors.
"""

from __future__ import annotations

import itertools

import numpy as np

from ..operators.calibration import Calibration
from ..operators.inversion import FWHM, Options


def doubles(values: object) -> str:
    """A list literal of any depth."""
    if isinstance(values, (list, tuple, np.ndarray)):
        return "[" + ", ".join(map(doubles, values)) + "]"
    return f"CAST({float(values)!r} AS DOUBLE)"


def rotated(name: str, source: str, n_rows: int, n: int, sweeps: int = 9) -> str:
    """CTEs that end in ``name``: id, y with its rows (n values and the data) orthogonal, from ``source`` (id, y)."""
    pairs = list(itertools.combinations(range(1, n_rows + 1), 2))
    p, q = (f"[{', '.join(str(x[k]) for x in pairs)}][n % {len(pairs)} + 1]" for k in (0, 1))
    dot = lambda a, b: f"list_inner_product(y[{a}][1:{n}], y[{b}][1:{n}])"
    turn = lambda a, b, sign: f"list_transform(range(1, {n + 2}), lambda i: {a} * y[p][i] {sign} {b} * y[q][i])"
    return f"""{name}_j AS (SELECT id, 0 AS n, y FROM {source} UNION ALL
  SELECT id, n + 1, list_transform(range(1, {n_rows + 1}), lambda k: CASE WHEN k = p THEN {turn("cs", "sn", "-")} WHEN k = q THEN {turn("sn", "cs", "+")} ELSE y[k] END)
  FROM (SELECT id, n, y, p, q, 1 / sqrt(1 + t * t) AS cs, t / sqrt(1 + t * t) AS sn FROM (
    SELECT *, CASE WHEN abs(g) <= 1e-17 * sqrt(al * be) THEN 0.0 WHEN z >= 0 THEN 1 / (z + sqrt(1 + z * z)) ELSE -1 / (sqrt(1 + z * z) - z) END AS t FROM (
      SELECT *, (be - al) / (2 * CASE WHEN g = 0 THEN 1e-300 ELSE g END) AS z FROM (
        SELECT *, {dot("p", "p")} AS al, {dot("q", "q")} AS be, {dot("p", "q")} AS g FROM (SELECT *, {p} AS p, {q} AS q FROM {name}_j WHERE n < {sweeps * len(pairs)})))))),
{name} AS (SELECT id, y FROM {name}_j WHERE n = {sweeps * len(pairs)})"""


def spectrum(name: str, source: str, nf: int, n: int, steps: int) -> str:
    """id, y, s2, c, top, mus, misfit."""
    return f"""{name}_s AS (SELECT id, y, list_transform(y, lambda v: list_inner_product(v[1:{n}], v[1:{n}])) AS s2, list_transform(y, lambda v: v[{n + 1}]) AS c FROM {source}),
{name}_m AS (SELECT * EXCLUDE (top), list_max(s2) AS top, list_transform(range(0, {steps}), lambda j: exp(ln(lo) + ln(hi / lo) * j / {steps - 1}.0)) AS mus FROM (SELECT *, CASE WHEN top > lo THEN top ELSE lo * 10 END AS hi FROM (SELECT *, greatest(list_min(s2) * 1e-4, 1e-300) AS lo, sqrt(list_max(s2)) AS top FROM {name}_s))),
{name} AS (SELECT *, list_transform(mus, lambda m: list_sum(list_transform(range(1, {nf + 1}), lambda k: pow(m / (s2[k] + m) * c[k], 2)))) AS misfit FROM {name}_m)"""


def chosen(target: str) -> str:
    offs = f"list_transform(misfit, lambda v: abs(v - {target}))"
    return f"mus[list_position({offs}, list_min({offs}))]"


def solution(pixels: str, cal: Calibration, o: Options, scales: str = "") -> str:
    """CTEs that end in ``sol``: id, valid, dem, edem, elogt, chisq, dn_reg. ``pixels``: a query of id, dn, edn, lists; ``scales``: a table of a list ``m`` to multiply the bands' responses by."""
    nt, nf = cal.rmatrix.shape
    logt, dl, steps = cal.logt, cal.dlogt, o.steps
    points = logt.min() + 1e-8 + (logt.max() - logt.min()) * np.arange(51) / 51
    at = np.clip(np.searchsorted(logt, points, side="right") - 1, 0, nt - 2)
    share = (points - logt[at]) / (logt[at + 1] - logt[at])
    each = lambda n, e, v="t": f"list_transform(range(1, {n + 1}), lambda {v}: {e})"
    total = lambda n, e, v="k": f"list_sum({each(n, e, v)})"
    row = lambda w: each(nf, f"list_append({each(nt, f'r[f][t] / e[f] * {w}')}, d[f])", "f")
    if o.gloci:
        bands = list(o.loci) or list(range(nf))
        weights = f"w1 AS (SELECT id, {each(nt, 'least(' + ', '.join(f'dn[{f + 1}] / greatest(r[{f + 1}][t], 1e-300)' for f in bands) + ')')} AS w FROM ok, cal)"
    else:
        weights = f"""i1 AS (SELECT id, {row("sqrt(dl[t])")} AS y FROM ok, cal),
{rotated("q1", "i1", nf, nt)},
{spectrum("p1", "q1", nf, nt, steps)},
x1 AS (SELECT id, {each(nt, "sqrt(dl[t]) * " + total(nf, "y[k][t] * c[k] / (s2[k] + lam)"))} AS x FROM (SELECT *, {chosen(repr(float(nf) * o.reg_tweak))} AS lam FROM p1), cal),
w1 AS (SELECT id, list_transform(x, lambda v: CASE WHEN v > 0 AND v > 1e-4 * list_max(x) THEN v ELSE 1.0 END) AS w FROM x1)"""
    window = f"list_sum(list_transform(range(-2, 3), lambda o: CASE WHEN t + o BETWEEN 2 AND {nt - 1} THEN w[t + o] ELSE 0.0 END))"
    factor = np.ones(nt)
    if o.emd_int and not o.emd_ret:
        factor = 1 / cal.factor
    elif o.emd_ret and not o.emd_int:
        factor = cal.factor
    lam = f"greatest({chosen(f'{float(nf) * o.reg_tweak!r} * pow({o.rgt_fact!r}, rd)')}, 1e-12 * top)"
    response = doubles(cal.rmatrix.T)
    if scales:
        response = f"list_transform({response}, lambda v, i: list_transform(v, lambda w: w * m[i]))"
    return f"""cal AS (SELECT {response} AS r, {doubles(dl)} AS dl, {doubles(factor * cal.scale)} AS fac, {doubles(points)} AS pts, {doubles(share)} AS sh, {[int(k) + 1 for k in at]} AS pos{' FROM ' + scales if scales else ''}),
px0 AS ({pixels}),
px1 AS (SELECT id, dn, edn, list_transform(edn, lambda v: greatest(v, greatest(1e-12, 1e-6 * list_aggregate(edn, 'median')))) AS e FROM px0),
px2 AS (SELECT *, {each(nf, "dn[f] / e[f]", "f")} AS d FROM px1),
ok AS (SELECT * FROM px2 WHERE list_min(d) > 0 AND isfinite(list_max(d))),
{weights},
sm AS (SELECT id, {each(nt, f"greatest({window} / 5 / greatest(list_max(w), 1e-12), 1e-8)")} AS w FROM w1),
wg AS (SELECT ok.*, {each(nt, "abs(w[t])" if o.l_emd else "sqrt(abs(w[t])) / sqrt(dl[t])")} AS g FROM sm JOIN ok USING (id), cal),
i2 AS (SELECT id, {row("g[t]")} AS y FROM wg, cal),
{rotated("q2", "i2", nf, nt)},
{spectrum("p2", "q2", nf, nt, steps)},
rd AS (SELECT p2.id, rd, lam, {each(nt, "g[t] * " + total(nf, "y[k][t] * c[k] / (s2[k] + lam)"))} AS dem FROM (SELECT id, y, s2, c, rd, {lam} AS lam FROM p2, (SELECT range AS rd FROM range({max(o.rounds, 1)}))) p2 JOIN wg USING (id)),
ch AS (SELECT id, arg_min(lam, k) AS lam, arg_min(dem, k) AS dem FROM (SELECT *, CASE WHEN list_min(dem) >= 0 THEN rd ELSE 1000 - rd END AS k FROM rd) GROUP BY id),
so1 AS (SELECT ch.id, dem, dn, edn, {each(nf, total(nt, "dem[t] * r[f][t]", "t"), "f")} AS p,
  {each(nt, "sqrt(" + total(nf, "pow(g[t] * y[k][t] / (s2[k] + lam), 2)") + ")")} AS edem,
  {each(nt, each(nt, "g[i] / g[t] * " + total(nf, "y[k][i] * y[k][t] / (s2[k] + lam)")), "i")} AS kn FROM ch JOIN p2 USING (id) JOIN wg USING (id), cal),
so2 AS (SELECT *, {each(nt, "list_max(" + each(nt, "kn[i][t]", "i") + ") / 2")} AS half, {"list_avg(" + each(nf, "dn[f] / greatest(p[f], 1e-300)", "f") + ")" if o.rscl else "1.0"} AS m FROM so1),
so3 AS (SELECT *, {each(nt, "list_filter(range(1, 52), lambda n: kn[i][pos[n]] + (kn[i][pos[n] + 1] - kn[i][pos[n]]) * sh[n] >= half[i])", "i")} AS wide FROM so2, cal),
sol AS (SELECT px0.id, so3.id IS NOT NULL AS valid, CASE WHEN so3.id IS NULL THEN {each(nt, "0.0")} ELSE {each(nt, "so3.dem[t] * m * fac[t]")} END AS dem,
  CASE WHEN so3.id IS NULL THEN {each(nt, "0.0")} ELSE {each(nt, "so3.edem[t] * m * fac[t]")} END AS edem,
  CASE WHEN so3.id IS NULL THEN list_transform((SELECT dl FROM cal), lambda v: v / {float(FWHM)!r}) ELSE {each(nt, f"CASE WHEN len(wide[t]) > 0 THEN (pts[wide[t][len(wide[t])]] - pts[wide[t][1]]) / 2 ELSE dl[t] END / {float(FWHM)!r}")} END AS elogt,
  CASE WHEN so3.id IS NULL THEN 0.0 ELSE {total(nf, "pow((so3.dn[f] - p[f] * m) / so3.edn[f], 2)", "f")} / {nf} END AS chisq,
  CASE WHEN so3.id IS NULL THEN {each(nf, "0.0")} ELSE {each(nf, "p[f] * m", "f")} END AS dn_reg FROM px0 LEFT JOIN so3 ON so3.id = px0.id)"""


def gsvd_largest(response: list[list[float]], pixels: str) -> str:
    """id and s2, the squared singular values of the response with each pixel's counts on it, largest first."""
    nf, nt = len(response[0]), len(response)
    return f"""rm AS (SELECT {doubles(response)} AS r),
px0 AS ({pixels}),
i1 AS (SELECT id, list_transform(range(1, {nt + 1}), lambda t: list_append(list_transform(range(1, {nf + 1}), lambda f: r[t][f] * (1 + dn[f] / 1000)), 0.0)) AS y FROM px0, rm),
{rotated("q1", "i1", nt, nf)},
sv AS (SELECT id, list_reverse_sort(list_transform(y, lambda v: list_inner_product(v[1:{nf}], v[1:{nf}]))) AS s2 FROM q1)"""
