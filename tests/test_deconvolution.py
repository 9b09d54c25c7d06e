import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import deconvolution as D
from lumenframe.operators import background, components
from lumenframe.params import Params
from lumenframe.plans import session
from tests.test_programs import frames_of, synthetic


def planted(g, k=20, n=800, noise=0.2, rate=0.02, seed=0):
    r = np.random.default_rng(seed)
    s = (r.random((k, n)) < rate) * r.uniform(0.5, 2, (k, n))
    c = np.zeros((k, n))
    for t in range(n):
        c[:, t] = s[:, t] + sum(v * c[:, t - j] for j, v in enumerate(g, 1) if t >= j)
    return s, c, c + r.normal(0, noise, c.shape)


@pytest.mark.parametrize("g", [(0.92,), (1.6, -0.63)])
def test_planted_traces_are_recovered_and_meet_the_noise(g):
    s, c, y = planted(g)
    got, penalty, rounds = D.nearest(y, np.tile(g, (len(y), 1)), np.full(len(y), y.shape[1] * 0.04))
    assert (rounds > 0).all() and (D.innovations(got, np.tile(g, (len(y), 1))) > -1e-6).all()
    gap = ((y - got) ** 2).sum(1) / (y.shape[1] * 0.04)
    assert np.allclose(gap[penalty > 0], 1, atol=1e-5) and (penalty > 0).mean() > 0.8
    assert np.mean([np.corrcoef(a, b)[0, 1] for a, b in zip(got, c)]) > 0.97


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 64, 65])
@pytest.mark.parametrize("order", [1, 2])
def test_conditions_of_the_nearest_course(n, order):
    r = np.random.default_rng(n)
    g = D.stable(np.stack([r.uniform(0.2, 1.8, 12), r.uniform(-0.8, 0.0, 12)], 1)[:, :order])
    y, penalty = r.normal(0, 1, (12, n)), 0.0
    c, penalty, rounds = D.nearest(y, g)
    for i in range(12):
        lag = sum(v * np.eye(n, k=-j) for j, v in enumerate(g[i], 1))
        response = np.linalg.inv(np.eye(n) - lag)
        s, slope = c[i] - lag @ c[i], response.T @ (c[i] - y[i])
        assert rounds[i] > 0 and s.min() > -1e-8 and slope.min() > -1e-7 and abs(s @ slope) < 1e-7


def test_second_order_coefficients_of_planted_traces():
    _, c, y = planted((1.6, -0.63), n=12000, noise=0.3)
    roots = []
    for trace in y:
        g, sn = D.second_order(trace)
        roots.append(np.sort(np.roots([1, -g[0], -g[1]]).real))
        assert sn == pytest.approx(0.3, rel=0.25)
    assert np.allclose(np.median(roots, 0), np.sort(np.roots([1, -1.6, 0.63])), atol=0.06)
    assert D.second_order(np.ones(50))[0].tolist() == [0, 0]


def test_coefficients_are_made_stable():
    g = D.stable(np.array([[0.5, 0.9], [1.0, -0.5], [3.0, -2.0], [-1.0, 0.2]]))
    for a, b in g:
        roots = np.roots([1, -a, -b])
        assert np.abs(roots.imag).max() < 1e-6 and roots.real.min() > -1e-9 and roots.real.max() < 1
    assert D.stable([[0.7], [1.2]]).tolist() == [[0.7], [D.LARGEST_ROOT]]


def test_traces_that_fail_alone(spark):
    y = np.array([[1.0, 2, 0, 1, 0, 0, 3], [np.nan, -1, 2, 0, 0, 0, 0], [np.inf, 1, 1, 1, 1, 1, 1], [2.0] * 7])
    out = D.deconvolve_all(y, np.full((4, 1), 0.7), np.array([0.1, 0.1, 0.1, np.nan]))
    assert [e is None for e in out["error"]] == [True, False, False, False] and out["c"][1].tolist() == [0, 0, 2, 0, 0, 0, 0] and not out["s"][1:].any()
    rows = spark.createDataFrame([(k, t, float(v)) for k, row in enumerate(y[:3]) for t, v in enumerate(row)] + [(9, 0, 1.0)], "k int, t int, v double")
    solved = components.deconvolved(rows, g=0.7).cache()
    got = {r.k: r for r in solved.collect()}
    assert got[0].error is None and np.allclose(got[0].c, D.deconvolve(y[0], 0.7, got[0].sn)[0]) and got[1].error and got[2].error and len(got[9].c) == 1
    assert components.failures_within(solved, 0.8) is solved
    with pytest.raises(ValueError, match="of 4 traces failed"):
        components.failures_within(solved, 0.25)
    assert components.deconvolved(rows.limit(0), order=2).count() == 0
    with pytest.raises(ValueError):
        components.deconvolved(rows, order=3)
    c, _ = components.temporal_update(y[:1], np.eye(1), np.zeros((1, 7)), np.array([0.7]), np.array([0.1]), report=(seen := {}))
    assert c.shape == (1, 7) and seen["rounds"] > 0 and seen["failed"] == {}


def test_fit_of_second_order_keeps_figures_and_background(spark, tmp_path):
    movie, _, c, _ = synthetic(t=150)
    drift = np.sin(np.arange(150) / 150 * np.pi)
    movie = movie + np.random.default_rng(1).normal(0, 0.6, (32, 32)) * drift[:, None, None]
    params = Params(sigma=2.5, min_corr=0.5, min_pnr=4.0, border_px=0, seed_method="threshold", ar_order=2, global_bg_rank=1, n_iter_main=1, ring_lambda=100.0)  # rings too stiff to tell the drift
    model = session.fit(frames_of(spark, movie), (32, 32), params)
    assert model.count >= 2 and model.g.shape == (model.count, 2) and model.raw.shape[1] == 150
    assert abs(np.corrcoef(model.courses[0], drift)[0, 1]) > 0.9
    seen = model.solver
    assert seen["spatial0"]["pixels"] > 0 and seen["spatial0"]["unsettled"] >= 0 and seen["spatial0"]["residual"] > 0 and seen["temporal"]["rounds"] > 0
    for energies in [seen["background_energy"], *seen["global_energy"]]:
        assert all(b <= a * (1 + 1e-6) for a, b in zip(energies, energies[1:]))
    model.save(spark, str(tmp_path / "m"))
    again = session.Model.load(spark, str(tmp_path / "m"))
    assert np.allclose(again.g, model.g) and np.allclose(again.raw, model.raw) and np.allclose(again.courses, model.courses) and again.loads.count() == 1024
    assert again.solver["spatial0"]["pixels"] == seen["spatial0"]["pixels"]


def test_refitted_courses_of_planted_ranks(spark):
    r = np.random.default_rng(4)
    for rank in (1, 2, 3):
        b, f = r.normal(size=(60, rank)) * (3, 2, 1)[:rank], r.normal(size=(rank, 50))
        x = b @ f + r.normal(0, 0.05, (60, 50))
        rows = spark.createDataFrame([(p, v.tolist()) for p, v in enumerate(x)], "p int, tr array<double>").repartition(3)
        got, energies = background.refitted(rows, r.normal(size=(rank, 50)), rounds=60)
        best = (np.linalg.svd(x, compute_uv=False)[rank:] ** 2).sum()
        assert all(b <= a * (1 + 1e-9) for a, b in zip(energies, energies[1:])) and energies[-1] == pytest.approx(best, rel=1e-2)
        products = got @ got.T
        assert np.allclose(products, np.diag(np.diag(products)), atol=1e-8 * products.max())
        loads = background.global_loads(rows, got).groupBy("r").agg(F.count("*").alias("n")).collect()
        assert {x.n for x in loads} == {60} and len(loads) == rank


def test_variance_shares_of_planted_components(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(300, 6)) * (9, 6, 4, 3, 2, 1.5) @ np.linalg.qr(r.normal(size=(400, 6)))[0].T * 20 + r.normal(0, 1, (300, 400)) + 50
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "tr array<double>").repartition(5)
    z = x - x.mean(1, keepdims=True)
    var = np.linalg.svd(z, compute_uv=False) ** 2
    assert np.allclose(background.variance_shares(rows), var[:5] / var.sum(), rtol=0.01)
    assert background.variance_shares(spark.createDataFrame([([1.0, 1.0],)], "tr array<double>")) == [0.0] * 5
    assert background.variance_shares(rows.limit(0)) == [0.0] * 5


def test_preview_box(spark):
    from lumenframe.operators import movies

    r = np.random.default_rng(7)
    movie, image = r.random((50, 6, 7)), r.random((6, 7))
    movie[44] += 1
    long = spark.createDataFrame([(t, y, x, float(v)) for (t, y, x), v in np.ndenumerate(movie)], "t int, y int, x int, v double")
    cn = spark.createDataFrame([(y, x, float(v)) for (y, x), v in np.ndenumerate(image)], "y int, x int, cn double")
    sums = {(y, x): image[y : y + 3, x : x + 4].sum() for y in range(4) for x in range(4)}
    y, x = max(sums, key=sums.get)
    assert movies.preview_box(cn, long, (6, 7), (3, 4), 20) == {"box": (y, y + 3, x, x + 4), "t_range": (30, 50)}
    assert movies.preview_box(cn, long, (6, 7), (30, 40), 200) == {"box": (0, 6, 0, 7), "t_range": (0, 50)}
