"""The batched solver against one pixel at a time, written from the rules alone."""

import numpy as np
import pytest

from bandloom.functions import pixels as P
from bandloom.operators import calibration as C
from bandloom.operators import inversion as V

CAL = C.default(12)


def one(dn, ed, cal, o):
    """A pixel's outputs in raw units, with loops."""
    r, logt, dl = cal.rmatrix, cal.logt, cal.dlogt
    nt, nf = r.shape
    e = np.maximum(ed, max(1e-12, 1e-6 * np.median(ed)))
    with np.errstate(all="ignore"):
        d = dn / e
    if not (np.isfinite(d).all() and (d > 0).all()):
        return np.zeros(nt), np.zeros(nt), dl.copy(), 0.0, np.zeros(nf)
    a = np.array([[r[t, f] / e[f] for t in range(nt)] for f in range(nf)])

    def steps(s):
        lo, hi = max(min(s) ** 2 * 1e-4, 1e-300), max(s)
        hi = hi if hi > lo else lo * 10
        return [np.exp(np.log(lo) + (np.log(hi) - np.log(lo)) * k / (o.steps - 1)) for k in range(o.steps)]

    def best(s, c, goal):
        off = [abs(sum((m / (s[k] ** 2 + m) * c[k]) ** 2 for k in range(len(s))) - goal) for m in steps(s)]
        return steps(s)[int(np.argmin(off))]

    if o.gloci:
        w = np.array([min(dn[f] / max(r[t, f], 1e-300) for f in (o.loci or range(nf))) for t in range(nt)])
    else:
        u, s, vt = np.linalg.svd(a * np.sqrt(dl), full_matrices=False)
        c = u.T @ d
        lam = best(s, c, nf * o.reg_tweak)
        x = np.sqrt(dl) * (vt.T @ (s / (s**2 + lam) * c))
        w = np.array([v if v > 0 and v > 1e-4 * x.max() else 1.0 for v in x])
    sm = [max(sum(w[k] for k in range(t - 2, t + 3) if 1 <= k <= nt - 2) / 5 / max(w.max(), 1e-12), 1e-8) for t in range(nt)]
    b = np.abs(sm) if o.l_emd else np.sqrt(sm) / np.sqrt(dl)
    u, s, vt = np.linalg.svd(a * b, full_matrices=False)
    c, reg = u.T @ d, o.reg_tweak
    for _ in range(o.rounds):
        lam = max(best(s, c, nf * reg), 1e-12 * max(s) ** 2)
        filt = s / (s**2 + lam)
        dem = b * (vt.T @ (filt * c))
        if (dem >= 0).all():
            break
        reg *= o.rgt_fact
    p = dem @ r
    kdag = b[:, None] * (vt.T * filt) @ u.T
    edem = np.sqrt((kdag**2).sum(axis=1))
    kk = kdag @ a
    pts = logt.min() + 1e-8 + (logt.max() - logt.min()) * np.arange(51) / 51
    width = np.array(dl)
    for i in range(nt):
        over = np.flatnonzero(np.interp(pts, logt, kk[i]) >= kk[:, i].max() / 2)
        if len(over):
            width[i] = (pts[over[-1]] - pts[over[0]]) / 2
    if o.rscl:
        m = np.mean(dn / np.maximum(p, 1e-300))
        dem, edem, p = dem * m, edem * m, dem * m @ r
    return dem, edem, width, np.sum(((dn - p) / ed) ** 2) / nf, p


def counts(n=40, seed=1):
    rng = np.random.default_rng(seed)
    dn = rng.uniform(1, 1000, (n, 6))
    dn[0, 0], dn[1, 1], dn[2, 2], dn[3, 3] = 0, -1, np.nan, np.inf
    return dn, np.sqrt(np.nan_to_num(dn, nan=0, posinf=0, neginf=0).clip(0) + 1)


@pytest.mark.parametrize("options", [{}, {"gloci": True}, {"gloci": True, "loci": (0, 3)}, {"l_emd": True}, {"non_pos": True}, {"rscl": True}, {"reg_tweak": 0.5, "max_iter": 3, "rgt_fact": 1.2, "nmu": 60}])
def test_same_as_one_at_a_time(options):
    o = V.Options(**options)
    dn, ed = counts()
    got = V.solve_batch(dn, ed, CAL, o)
    for i in range(len(dn)):
        for name, value in zip(V.OUTPUTS, one(dn[i], ed[i], CAL, o), strict=True):
            np.testing.assert_allclose(got[name][i], value, rtol=1e-6, atol=1e-9 * (1 + np.abs(value).max()), err_msg=f"{name} {i}")
    assert not got["valid"][:4].any() and got["valid"][4:].all()


def test_batches_do_not_matter():
    dn, ed = counts(64)
    whole = V.solve_batch(dn, ed, CAL, V.Options())
    parts = [V.solve_batch(dn[i : i + 7], ed[i : i + 7], CAL, V.Options()) for i in range(0, 64, 7)]
    for name in V.OUTPUTS:
        np.testing.assert_allclose(np.concatenate([p[name] for p in parts]), whole[name], rtol=1e-9, atol=1e-20)


def test_frames_of_any_partitioning_and_edge_rows(spark):
    dn, ed = counts(30)
    rows = [("f", i, 0, dn[i].tolist(), ed[i].tolist()) for i in range(30)]
    rows += [("f", 90, 0, None, None), ("f", 91, 0, [1.0, 2.0], [1.0, 1.0]), ("f", 92, 0, [1.0, None, 1.0, 1.0, 1.0, 1.0], [1.0] * 6)]
    px = spark.createDataFrame(rows, "frame_id string, y int, x int, dn array<double>, edn array<double>")
    made = [{r["y"]: r for r in V.solve_dem(px.repartition(n), CAL, V.Options(batch=b)).collect()} for n, b in ((1, 4096), (5, 3))]
    assert made[0].keys() == made[1].keys() and len(made[0]) == 33
    for y, r in made[0].items():
        np.testing.assert_allclose(r["dem"], made[1][y]["dem"], rtol=1e-9)
    assert [made[0][y]["valid"] for y in (0, 1, 2, 3, 90, 91, 92)] == [False] * 7
    assert V.solve_dem(px.limit(0), CAL).count() == 0
    assert V.solve_dem(px, CAL, V.Options(outputs=("dem",))).columns == ["frame_id", "y", "x", "dem", "valid"]


def test_units():
    dn, ed = counts(8)
    raw = V.solve_batch(dn, ed, CAL, V.Options())
    plain = V.finish(raw, CAL, V.Options())
    np.testing.assert_allclose(plain["dem"], raw["dem"] * 1e15)
    np.testing.assert_allclose(V.finish(raw, CAL, V.Options(emd_ret=True))["dem"], plain["dem"] * CAL.factor)
    np.testing.assert_allclose(V.finish(raw, CAL, V.Options(emd_int=True))["dem"], plain["dem"] / CAL.factor)
    np.testing.assert_allclose(V.finish(raw, CAL, V.Options(emd_int=True, emd_ret=True))["dem"], plain["dem"])


def test_linear_algebra():
    assert V.reg_map(np.array([2, 1.0]), np.array([1, 0.5]), np.eye(2), np.array([1, 0.5]), np.array([0.1, 0.1]), nmu=10) > 0
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal((3, 5)), np.eye(5)
    alpha, beta, u, v, w = V.gsvd(a, b)
    np.testing.assert_allclose(alpha**2 + beta**2, 1)
    np.testing.assert_allclose(V.safe_pinv(a), np.linalg.pinv(a), atol=1e-10)
    with pytest.raises(RuntimeError):
        V.safe_svd(np.array(3.0))
    dem, p, fit = V.lstsq_clip(np.ones((2, 6)), CAL.rmatrix)
    assert (dem >= 0).all() and fit.shape == (2,)


def test_calibration():
    assert C.bins_for(42) == 25 and C.bins_for(None) == 24 and C.bins_for(1000) == 64
    tresp, t, temps = C.sampled(nt=24)
    assert (tresp > 0).all() and len(temps) == 25
    C.check_response(*C.binned())
    with pytest.raises(ValueError):
        C.check_response(np.zeros((24, 6)), np.arange(24.0), np.ones(24))
    with pytest.raises(ValueError):
        C.sampled(n_tresp=3)
    ratio = C.double_jacobian().rmatrix / C.default().rmatrix
    np.testing.assert_allclose(ratio, np.tile(C.default().factor[:, None], 6))
    assert C.edges(np.array([6.0])).tolist() == [5.95, 6.05]


def test_smooth_matches_the_expression(spark):
    w = np.abs(np.random.default_rng(3).standard_normal((20, 9)))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(w)], "i int, w array<double>")
    got = np.array([r["s"] for r in rows.select("i", P.smooth5(rows["w"]).alias("s")).orderBy("i").collect()])
    np.testing.assert_allclose(got, V.smooth(w), rtol=1e-12)


def test_a_solver_of_ones_own(spark):
    dn, ed = counts(12)
    px = spark.createDataFrame([(i, dn[i].tolist(), ed[i].tolist()) for i in range(4, 12)], "y int, dn array<double>, edn array<double>")

    def mine(dn, edn):
        dem, _, fit = V.lstsq_clip(dn, CAL.rmatrix)
        return {"dem": dem, "fit": fit}

    got = {r["y"]: r for r in V.solve_with(px, mine, "dem array<double>, fit double").collect()}
    dem, _, fit = V.lstsq_clip(dn[4:], CAL.rmatrix)
    assert sorted(got) == list(range(4, 12)) and V.solve_with(px.limit(0), mine, "dem array<double>, fit double").count() == 0
    for i in range(4, 12):
        np.testing.assert_allclose(got[i]["dem"], dem[i - 4])
        np.testing.assert_allclose(got[i]["fit"], fit[i - 4])


def test_decompositions_by_products_of_rows():
    rng = np.random.default_rng(5)
    kinds = [rng.normal(size=(40, 6, 24)), rng.normal(size=(40, 6, 24)) * 10.0 ** rng.uniform(-4, 0, (40, 1, 24)) ** 3]
    for most in (2, 5, 6, 9, 14):  # lengths of the rows over so many powers of ten, in a basis of their own
        u = np.linalg.qr(rng.normal(size=(40, 6, 6)))[0]
        v = np.linalg.qr(rng.normal(size=(40, 24, 6)))[0]
        kinds.append(u * np.geomspace(1, 10.0**-most, 6) @ v.transpose(0, 2, 1))
    kinds += [np.repeat(rng.normal(size=(40, 1, 24)), 6, axis=1), np.zeros((3, 6, 24)), rng.normal(size=(5, 6, 4)), np.concatenate(kinds)]
    for a in kinds:
        u, s, vt = V.decomposed(a)
        top = np.linalg.svd(a, compute_uv=False)
        assert np.allclose(np.sort(s, axis=1)[:, ::-1], top, rtol=1e-8, atol=1e-14 * max(top.max(), 1e-300))
        assert np.allclose(u * s[:, None, :] @ vt, a, atol=1e-12 * max(np.abs(a).max(), 1e-300))
        k = np.eye(s.shape[1])
        assert np.allclose(u.transpose(0, 2, 1) @ u, k, atol=1e-9)
        whole = s.min(axis=1) > 1e-7 * s.max(axis=1)
        assert np.allclose((vt @ vt.transpose(0, 2, 1))[whole], k, atol=1e-9)


def test_well_and_ill_conditioned_systems_need_few_full_decompositions(monkeypatch):
    met, plain = [], np.linalg.svd
    monkeypatch.setattr(np.linalg, "svd", lambda a, **how: met.append(len(a)) or plain(a, **how))
    dn, ed = counts(400, 9)
    V.solve_batch(dn, ed, C.default(), V.Options())
    assert sum(met) < 40
