"""Every kernel query on the smallest tables against a plain NumPy or Python version of it."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import arrays, solvers
from lumenframe.operators import cells, seeding
from lumenframe.params import Params
from lumenframe.plans import kernel_queries, motion, registry
from lumenframe.sources import views


@pytest.fixture(scope="module")
def got(spark, sf):
    """Results by query, each run once."""
    made = {}

    def run(name, *order):
        if name not in made:
            made[name] = kernel_queries.QUERIES[name](spark, sf).toPandas()
        return made[name].sort_values(list(order)).reset_index(drop=True) if order else made[name]

    return run


@pytest.fixture(scope="module")
def evt(spark, sf):
    return kernel_queries._stack(views.evt_movie(spark, sf))


@pytest.fixture(scope="module")
def emb(spark, sf):
    return kernel_queries._stack(views.emb_movie(spark, sf))


@pytest.fixture(scope="module")
def feet(spark, sf):
    """Footprints: k -> image."""
    out = {}
    for k, p, a in views.li_footprints(spark, sf).toPandas().itertuples(index=False):
        out.setdefault(k, np.zeros(1024))[p] = float(a)
    return {k: v.reshape(32, 32) for k, v in out.items()}


@pytest.fixture(scope="module")
def traces(spark, sf):
    rows = views.evt_traces(spark, sf).toPandas().sort_values(["k", "t"])
    return {k: g["v"].to_numpy(float) for k, g in rows.groupby("k")}


def correlate(image, kernel):
    """Plain correlation with a symmetric border."""
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    ys = [y if 0 <= y < image.shape[0] else (-1 - y if y < 0 else 2 * image.shape[0] - 1 - y) for y in range(-ry, image.shape[0] + ry)]
    xs = [x if 0 <= x < image.shape[1] else (-1 - x if x < 0 else 2 * image.shape[1] - 1 - x) for x in range(-rx, image.shape[1] + rx)]
    wide = image[np.ix_(ys, xs)]
    return sum(kernel[i, j] * wide[i : i + image.shape[0], j : j + image.shape[1]] for i in range(kernel.shape[0]) for j in range(kernel.shape[1]))


def noise(x):
    """Deviation by the mean log power of the upper half of the spectrum."""
    power = np.abs(np.fft.rfft(x)) ** 2 * 2 / len(x)
    high = power[np.fft.rfftfreq(len(x)) >= 0.25]
    return math.sqrt(math.exp(np.log(high + 1e-10).mean()))


def summary(movie, sigma):
    """(cn, pnr, sn) with plain loops."""
    f = np.stack([correlate(m, arrays.surround_kernel(sigma)) for m in movie])
    f -= f.mean(0)
    sn = np.array([[arrays.noise_level(f[None, :, y, x])[0] for x in range(f.shape[2])] for y in range(f.shape[1])])
    pnr = np.maximum(f.max(0), 0) / sn
    z = np.where(f >= 3 * sn, f, 0)
    z = z - z.mean(0)
    norm = np.sqrt((z * z).mean(0))
    cn = np.zeros(sn.shape)
    for y, x in np.ndindex(sn.shape):
        around = [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and 0 <= y + a < sn.shape[0] and 0 <= x + b < sn.shape[1]]
        r = [(z[:, y, x] * z[:, i, j]).mean() / (norm[y, x] * norm[i, j]) if norm[y, x] and norm[i, j] else 0.0 for i, j in around]
        cn[y, x] = sum(r) / len(around)
    return cn, pnr, sn


def test_n5_corr_pnr(got, evt):
    rows = got("n5_corr_pnr", "y", "x")
    cn, pnr, sn = summary(evt, 1.0)
    assert len(rows) == 144
    assert np.allclose(rows["sn"], sn.ravel(), rtol=1e-6) and np.allclose(rows["pnr"], pnr.ravel(), rtol=1e-6)
    assert np.allclose(rows["cn"], cn.ravel(), atol=1e-6)


def test_corr_pnr_by_tiles_is_that_of_the_whole(spark):
    from lumenframe.operators import kernels

    movie = np.random.default_rng(0).random((60, 23, 17))
    df = spark.createDataFrame([(t, y, x, float(v)) for (t, y, x), v in np.ndenumerate(movie)], "t int, y int, x int, v double")
    rows = kernels.corr_pnr(df, 1.3, tile=6).toPandas().sort_values(["y", "x"])
    cn, pnr, sn, _ = arrays.corr_pnr(movie, 1.3)
    assert np.allclose(rows["cn"], cn.ravel()) and np.allclose(rows["pnr"], pnr.ravel()) and np.allclose(rows["sn"], sn.ravel())


def test_m2_high_pass(got, evt):
    rows = got("m2_high_pass", "t")
    assert len(rows) == len(evt)
    for t in range(0, len(evt), 37):
        assert np.allclose(np.asarray(rows["px"][t]).reshape(12, 12), correlate(evt[t], arrays.highpass_kernel(1.0)), atol=1e-8)


def plain_shift(goal, frame, limit):
    """Phase correlation at every tenth of a pixel around the best whole shift within the limit."""
    cross = np.fft.fft2(goal) * np.conj(np.fft.fft2(frame))
    cross /= np.maximum(np.abs(cross), 100 * np.finfo(float).eps)
    h, w = frame.shape
    at = lambda dy, dx: abs((cross * np.exp(2j * np.pi * (np.add.outer(np.fft.fftfreq(h) * dy, np.fft.fftfreq(w) * dx)))).sum())
    whole = max(itertools.product(range(-limit, limit), repeat=2), key=lambda s: at(*s))
    steps = np.arange(-7, 8) / 10
    return at, max(((whole[0] + a, whole[1] + b) for a in steps for b in steps), key=lambda s: at(*s))


def test_m9_register_frames(got, evt):
    rows = got("m9_register_frames", "t")
    kernel = arrays.highpass_kernel(1.0)
    goal = correlate(evt.mean(0), kernel)
    for t in range(0, len(evt), 61):
        at, (dy, dx) = plain_shift(goal, correlate(evt[t], kernel), 3)
        mine = rows["dy"][t], rows["dx"][t]
        assert abs(mine[0]) <= 3.8 and abs(mine[1]) <= 3.8
        assert at(*mine) == pytest.approx(at(dy, dx), rel=1e-3), (t, mine, (dy, dx))


def plain_template(stack, params):
    """Median over ten interleaved means of filtered frames; the frames are aligned to it as long as that makes it sharper."""
    kernel = arrays.highpass_kernel(1.0)
    high = lambda x: np.stack([arrays.convolve(f, kernel) for f in x])

    def median(x):
        groups = len(x) // min(10, len(x))
        return np.median([high(x)[g : groups * min(10, len(x)) : groups].mean(0) for g in range(groups)], axis=0)

    best, moved = median(stack), stack
    level = high(best[None]).var()
    for _ in range(10):
        goal = high(best[None])[0]
        moved = np.stack([arrays.translate(f, arrays.phase_shift(goal, h, 10, params.max_shift)) for f, h in zip(moved, high(moved))])
        new = median(moved)
        gained = high(new[None]).var()
        stop = (gained - level) / level < 0.01
        if gained > level:
            best, level = new, gained
        if stop:
            break
    return best


def test_m16_motion_correction(got, evt):
    params = Params(max_shift=(3, 3), mc_n_iter=2, mc_gSig_filt=1.0, sigma=1.0)
    kernel = arrays.highpass_kernel(1.0)
    sample = lambda m: m[np.unique(np.linspace(0, len(m) - 1, min(len(m), params.mc_template_max_frames)).astype(int))]
    template = plain_template(sample(evt), params)
    sharp = lambda x: arrays.convolve(x, kernel).var()
    movie, total, level = evt.copy(), np.zeros((len(evt), 2)), sharp(template)
    for _ in range(2):
        goal = arrays.convolve(template, kernel)
        step = np.array([arrays.phase_shift(goal, arrays.convolve(f, kernel), 10, (3, 3)) for f in movie])
        total += step
        movie = np.stack([arrays.translate(f, s) for f, s in zip(movie, step)])
        new = arrays.bin_median(np.stack([arrays.convolve(f, kernel) for f in sample(movie)]))
        gain = (sharp(new) - level) / level
        if sharp(new) > level:
            template, level = new, sharp(new)
        if gain < params.mc_converge_tol:
            break
    rows = got("m16_motion_correction", "t")
    assert np.allclose(rows[["dy", "dx"]].to_numpy(), total, atol=1e-6)


def test_m25_and_h2_from_shifts(got):
    s = got("m9_register_frames", "t")[["dy", "dx"]].to_numpy()
    size = np.hypot(*s.T)
    row = got("m25_shift_quality").iloc[0]
    assert row["mean_step"] == pytest.approx(np.hypot(*np.diff(s, axis=0).T).mean()) and row["top"] == pytest.approx(size.max())
    assert row["p99"] == pytest.approx(np.percentile(size, 99))
    row = got("h2_max_shift").iloc[0]
    assert (row["dy"], row["dx"]) == tuple(int(np.ceil(np.percentile(np.abs(s[:, i]), 99))) + 2 for i in (0, 1))


def test_m26_registration_quality(got, emb):
    z = emb - emb.mean(0)
    z /= np.maximum(np.sqrt((z * z).mean(0)), 1e-300)
    cn = sum((z * np.roll(z, (a, b), (1, 2))).mean(0) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b) / 8
    row = got("m26_registration_quality").iloc[0]
    crisp = lambda im: np.sqrt(sum((g * g).sum() for g in np.gradient(im)))
    assert row["corr_mean"] == pytest.approx(cn.mean(), abs=1e-9) and row["corr_p99"] == pytest.approx(np.percentile(cn, 99), abs=1e-9)
    assert row["mean_crispness"] == pytest.approx(crisp(emb.mean(0))) and row["std_crispness"] == pytest.approx(crisp(emb.std(0)))


def test_h6_cells_and_background(got, evt):
    cn, pnr, _ = summary(evt, 1.0)
    rows = got("h6_cells_and_background", "y", "x")
    on, off = rows[rows.is_cell], rows[~rows.is_cell]
    assert len(on) and len(off)
    assert np.allclose(rows["cn"], cn[rows["y"], rows["x"]], atol=1e-6) and np.allclose(rows["pnr"], pnr[rows["y"], rows["x"]], atol=1e-5)
    far = {(y, x) for y, x in np.ndindex(12, 12) if all((y - a) ** 2 + (x - b) ** 2 > 4 for a, b in zip(on["y"], on["x"]))}
    assert {(y, x) for y, x in zip(off["y"], off["x"])} == far


@pytest.fixture(scope="module")
def recording(spark, sf):
    rows = views.cell_frames(spark, sf).toPandas().sort_values("t")
    return np.stack(rows["px"].to_list()).reshape(-1, views.CELL_FIELD, views.CELL_FIELD), views.cell_signals(spark, sf).toPandas().pivot(index="k", columns="t", values="c").to_numpy()


def found_cells(images, traces, signals):
    """Planted cells that some component has the place and the trace of."""
    y, x = np.mgrid[: views.CELL_FIELD, : views.CELL_FIELD]
    out = set()
    for image, trace in zip(images, traces):
        cy, cx = (image * y).sum() / image.sum(), (image * x).sum() / image.sum()
        for k, (a, b) in enumerate(views.CELL_CENTRES):
            if math.hypot(cy - a, cx - b) < 1.5 and (trace is None or pearson(np.asarray(trace), signals[k]) > 0.8):
                out.add(k)
    return out


def test_i8_greedy_tiles(got, recording):
    movie, signals = recording
    rows, n, seen = got("i8_greedy_tiles", "tile", "k"), 0, []
    for r0, r1 in seeding.tile_spans(36, 24, 8):
        for c0, c1 in seeding.tile_spans(36, 24, 8):
            a, c, at = seeding.greedy(movie[:, r0:r1, c0:c1], 2.0, min_corr=0.5, min_pnr=5.0, seed_mode="threshold")
            own = rows[rows.tile == f"{r0}_{c0}"]
            assert len(own) == len(a)
            for i, (f, trace, (y, x)) in zip(own.index, zip(a, c, at)):
                image = np.zeros(36 * 36)
                image[own["ps"][i]] = own["as"][i]
                seen.append(image.reshape(36, 36))
                assert (own["cy"][i], own["cx"][i]) == (y + r0, x + c0) and np.allclose(seen[-1][r0:r1, c0:c1], f) and np.allclose(own["c"][i], trace)
            n += len(a)
    assert n == len(rows) and found_cells(seen, rows["c"], signals) == set(range(9))


def test_tiles_of_the_grid_hold_what_they_cover(spark):
    movie = np.random.default_rng(1).random((40, 20, 26))
    y, x = np.mgrid[:20, :26]
    for cy, cx in ((5, 6), (14, 19), (6, 20)):
        movie += 4 * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 4)[None] * (np.random.default_rng(cy).random(40) < 0.15)[:, None, None]
    pixels = spark.createDataFrame([(i, j, movie[:, i, j].tolist()) for i in range(20) for j in range(26)], "y int, x int, tr array<double>")
    settings = {"min_corr": 0.3, "min_pnr": 3.0, "seed_mode": "threshold"}
    rows = seeding.greedy_tiles(pixels, 20, 26, 1.5, size=14, overlap=6, **settings).toPandas()
    for r0, r1 in seeding.tile_spans(20, 14, 6):
        for c0, c1 in seeding.tile_spans(26, 14, 6):
            a, c, at = seeding.greedy(movie[:, r0:r1, c0:c1], 1.5, **settings)
            own = rows[rows.tile == f"{r0}_{c0}"].sort_values("k")
            assert [(p - r0, q - c0) for p, q in zip(own.cy, own.cx)] == [tuple(map(int, s)) for s in at]
            assert all(np.allclose(u, v) for u, v in zip(own["c"], c))


def test_b2_ring_regression(got, emb):
    z = (emb - emb.mean(0)).reshape(len(emb), 64)
    rows = got("b2_ring_regression")
    for p in range(64):
        own = rows[rows.p == p].sort_values("q")
        ring = sorted(q for q in range(64) if math.floor(2.5) <= math.hypot(q // 8 - p // 8, q % 8 - p % 8) + 1e-9 and round(math.hypot(q // 8 - p // 8, q % 8 - p % 8) ** 2) in RING)
        assert own["q"].tolist() == ring
        n = z[:, ring]
        gram = n.T @ n
        want = np.linalg.solve(gram + 1e-5 * np.trace(gram) * np.eye(len(ring)), n.T @ z[:, p])
        assert np.allclose(own["w"], want, atol=1e-8)


#: Squared distances of the pixels that a ring of radius 2.5 passes.
RING = sorted({dy * dy + dx * dx for dy, dx in __import__("lumenframe.operators.background", fromlist=["x"]).ring_offsets(2.5)})


def test_b16_global_background(got, emb):
    z = (emb - emb.mean(0)).reshape(len(emb), 64).T
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    rows = got("b16_global_background")
    load = rows.pivot(index="p", columns="r", values="v").to_numpy()
    # directions of nearly equal size turn into one another, the energy that the two hold does not
    assert (load**2).sum() == pytest.approx((s[:2] ** 2).sum(), rel=0.01) and abs(load[:, 0] @ load[:, 1]) < 0.05 * s[1] ** 2


def test_subspace_iteration_finds_the_largest_directions(spark):
    from lumenframe.operators import background

    r = np.random.default_rng(3)
    z = sum(w * np.outer(r.normal(size=80), r.normal(size=120)) for w in (5, 3, 2)) + 0.1 * r.normal(size=(80, 120))
    df = spark.createDataFrame([(p, row.tolist()) for p, row in enumerate(z)], "p int, tr array<double>").repartition(7)
    spatial, temporal = (x.toPandas() for x in background.global_background(df, 3))
    b, f = spatial.pivot(index="p", columns="r", values="v").to_numpy(), temporal.pivot(index="r", columns="t", values="v").to_numpy()
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(b @ f, (u[:, :3] * s[:3]) @ vt[:3], atol=1e-6) and np.allclose(f @ f.T, np.eye(3)) and (f.sum(1) >= 0).all()


def test_a2_spatial_update(got, evt):
    z = evt.reshape(len(evt), 144)
    c = np.stack([np.maximum(np.sin(np.arange(len(z)) / (5.0 + k)), 0) for k in range(4)])
    gram, top = c @ c.T, (c * c).sum(1).max()
    rows, a = got("a2_spatial_update"), np.zeros((4, 144))
    a[rows["k"], rows["p"]] = rows["a"]
    for p in range(144):
        alpha = 0.5 * arrays.noise_level(z[None, :, p])[0] * math.sqrt(top)
        slope = gram @ a[:, p] + 0.01 * top * a[:, p] + alpha - c @ z[:, p]  # of the penalised squares: 0 where positive, else not under 0
        scale = np.abs(c @ z[:, p]).max() + alpha
        assert (a[:, p] >= 0).all() and (slope >= -1e-3 * scale).all() and (np.abs(slope[a[:, p] > 0]) <= 1e-3 * scale).all()


def test_a7_trim_footprints(got, feet):
    rows = got("a7_trim_footprints")
    for k, image in feet.items():
        want = arrays.trim_footprint(image, method="nrg", energy=0.5).ravel()
        mine = np.zeros(1024)
        own = rows[rows.k == k]
        mine[own["p"]] = own["a"]
        assert np.allclose(mine, want)
        if want.any():  # one region of the median-filtered image, and no pixel of it changed
            assert np.allclose(want[want > 0], np.maximum(arrays.median3(image), 0).ravel()[want > 0])


def nearest_decay(y, g):
    """The course nearest to y that decays no faster than g, by the max-min formula of isotonic regression with weights."""
    n = len(y)
    w = g ** (2.0 * np.arange(n))
    z = y / g ** np.arange(n)
    mean = lambda i, j: (w[i : j + 1] @ z[i : j + 1]) / w[i : j + 1].sum()
    x = [max(min(mean(i, j) for j in range(t, n)) for i in range(t + 1)) for t in range(n)]
    return np.maximum(x, 0) * g ** np.arange(n)


def nonnegative(k, y, penalty):
    """s >= 0 of least |y - k s|^2 / 2 + penalty sum(s), by accelerated projected gradients."""
    step = 1 / np.linalg.norm(k, 2) ** 2
    s = v = np.zeros(k.shape[1])
    turn = 1.0
    for _ in range(20_000):
        new = np.maximum(v - step * (k.T @ (k @ v - y) + penalty), 0)
        more = (1 + math.sqrt(1 + 4 * turn * turn)) / 2
        v, s, turn = new + (turn - 1) / more * (new - s), new, more
    return s


def response(n, *g):
    return np.linalg.inv(np.eye(n) - sum(v * np.eye(n, k=-j) for j, v in enumerate(g, 1)))


@pytest.mark.parametrize("name", ["t3_deconvolve", "t3_deconvolve_udf"])
def test_t3_deconvolve(got, traces, name):
    rows = got(name)
    for k, y in list(traces.items())[::5]:
        sn = 10.0 if name.endswith("udf") else noise(y)
        base, n = np.median(y), len(y)
        own, goal = rows[rows.k == k], n * sn * sn
        near = nearest_decay(y - base, 0.8)
        free = ((y - base - near) ** 2).sum() >= goal
        if name.endswith("udf"):
            assert own["bl"].iloc[0] == pytest.approx(base)
            if free:
                assert own["total"].iloc[0] == pytest.approx(near.sum(), rel=1e-6)
            continue
        own = own.sort_values("t")
        c = own["c"].to_numpy()
        assert own["sn"].iloc[0] == pytest.approx(sn, rel=1e-6) and own["bl"].iloc[0] == pytest.approx(base)
        s = np.diff(c, prepend=0) + 0.2 * np.concatenate([[0], c[:-1]])
        assert np.allclose(own["s"], np.maximum(s, 0), atol=1e-9) and (c >= -1e-9).all() and (s >= -1e-6).all()
        if free:
            assert np.allclose(c, near, atol=1e-6)
        elif ((y - base) ** 2).sum() <= goal:  # nothing but noise
            assert np.allclose(c, 0, atol=1e-6)
        else:
            assert ((y - base - c) ** 2).sum() == pytest.approx(goal, rel=1e-5)


def test_t3_deconvolve_order2(got, traces):
    rows = got("t3_deconvolve_order2")
    for k, y in list(traces.items())[::12]:
        own = rows[rows.k == k].sort_values("t")
        base, n = np.median(y), len(y)
        kernel = response(n, 1.1, -0.24)
        c, penalty = own["c"].to_numpy(), own["penalty"].iloc[0]
        want = kernel @ nonnegative(kernel, y - base, penalty)
        assert np.allclose(c, want, atol=1e-4 * max(1, np.abs(y).max())) and own["g2"].iloc[0] == pytest.approx(-0.24)
        gap, goal = ((y - base - c) ** 2).sum(), n * noise(y) ** 2
        if ((y - base) ** 2).sum() <= goal:
            assert np.allclose(c, 0, atol=1e-6)
        else:
            assert gap == pytest.approx(goal, rel=1e-5) if penalty > 0 else gap >= goal * (1 - 1e-6)


def test_t7_deconvolve_failures(got, traces):
    rows, whole = got("t7_deconvolve_failures"), got("t3_deconvolve")
    sums = whole.groupby("k")[["c", "s"]].sum()
    for r in rows.itertuples():
        if r.k % 7 == 0:
            y = traces[r.k].copy()
            y[3] = 0
            assert r.error == "a value is not finite" and r.total == pytest.approx(np.maximum(y, 0).sum()) and r.spikes == 0
        else:
            assert r.error is None and r.total == pytest.approx(sums.loc[r.k, "c"], rel=1e-6, abs=1e-6) and r.spikes == pytest.approx(sums.loc[r.k, "s"], rel=1e-6, abs=1e-6)
    assert rows["error"].notna().sum() == sum(k % 7 == 0 for k in traces) > 0


def test_e17_recording_stats(got, evt):
    row = got("e17_recording_stats").iloc[0]
    z = (evt - evt.mean(0)).reshape(len(evt), -1)
    var = np.linalg.svd(z, compute_uv=False) ** 2
    assert row["pc1"] == pytest.approx(var[0] / var.sum(), rel=0.01) and row["top5"] == pytest.approx(var[:5].sum() / var.sum(), rel=0.01)
    image = got("n5_corr_pnr")
    for c in ("cn", "pnr"):
        assert [row[f"{c}_{n}"] for n in ("med", "p90", "p99")] == pytest.approx(np.percentile(image[c], [50, 90, 99]).tolist(), rel=1e-6)
    tenth = len(evt) // 10
    assert row["bleach"] == pytest.approx(1 - evt[-tenth:].mean() / evt[:tenth].mean()) and row["top"] == evt.max()
    assert 0 <= row["seed_density"] <= 10_000


def test_b15_joint_background(got, emb):
    z = (emb - emb.mean(0)).reshape(len(emb), 64).T
    rows = got("b15_joint_background")
    f = rows.pivot(index="r", columns="t", values="v").to_numpy()
    energies = rows["energies"].iloc[0]
    assert all(b <= a * (1 + 1e-6) for a, b in zip(energies, energies[1:])) and abs(f[0] @ f[1]) < 1e-6 * (f[0] @ f[0])
    # the same turns on whole arrays
    rings = [[q for q in range(64) if (q // 8 - p // 8) ** 2 + (q % 8 - p % 8) ** 2 in RING] for p in range(64)]
    goal, want = z, []
    for _ in range(3):
        w = np.zeros((64, 64))
        for p, ring in enumerate(rings):
            gram = z[ring] @ z[ring].T
            w[p, ring] = np.linalg.solve(gram + 1e-5 * np.trace(gram) * np.eye(len(ring)), z[ring] @ goal[p])
        left = z - w @ z
        u, s, vt = np.linalg.svd(left, full_matrices=False)
        want.append((s[2:] ** 2).sum())
        goal = z - (u[:, :2] * s[:2]) @ vt[:2]
    assert np.allclose(energies, want, rtol=0.02)


def pearson(a, b):
    a, b = a - a.mean(), b - b.mean()
    n = math.sqrt((a * a).sum() * (b * b).sum())
    return (a * b).sum() / n if n > 0 else 0.0


def test_e2_r_values(got, evt, feet):
    z = evt.reshape(len(evt), 144)
    folded = {}
    for k, image in feet.items():
        target = folded.setdefault(k % 10, np.zeros(144))
        np.add.at(target, np.arange(1024) % 144, image.ravel())
    rows = got("e2_r_values").set_index("k")["r_value"]
    assert set(rows.index) == set(folded)
    for k, f in folded.items():
        c = z[:, np.arange(144) % 10 == k].sum(1)
        hit = np.flatnonzero(c >= np.percentile(c, 95))
        if len(hit) < 10:
            hit = np.lexsort((np.arange(len(c)), -c))[:10]
        y, x = np.nonzero(f.reshape(12, 12))
        ys, xs = slice(max(0, y.min() - 2), y.max() + 3), slice(max(0, x.min() - 2), x.max() + 3)
        box = np.zeros((12, 12), bool)
        box[ys, xs] = True
        change = (z[hit].mean(0) - z.mean(0))[box.ravel()]
        assert rows[k] == pytest.approx(pearson(f[box.ravel()], change), abs=1e-9)


def test_e6_morphology(got, feet):
    rows = got("e6_morphology").set_index("k")
    for k, image in feet.items():
        on = (image > 0) & (image >= 0.3 * image.max())
        regions = []
        left = {tuple(p) for p in np.argwhere(on)}
        while left:
            todo, region = [left.pop()], []
            while todo:
                y, x = todo.pop()
                region.append((y, x))
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= near
                todo += near
            regions.append(region)
        most = max(map(len, regions))
        assert any(np.allclose([rows.loc[k, c] for c in ("eccentricity", "solidity", "compactness", "aspect_ratio")], [arrays.shape_of(mask_of(r))[c] for c in ("eccentricity", "solidity", "compactness", "aspect_ratio")], equal_nan=True) for r in regions if len(r) == most)


def mask_of(region):
    y, x = np.array(region).T
    mask = np.zeros((np.ptp(y) + 1, np.ptp(x) + 1), bool)
    mask[y - y.min(), x - x.min()] = True
    return mask


def peaks_of(image, distance, rel):
    """Pixels that no pixel of their square beats (ties: the first)."""
    out, on = 0, [(y, x) for y, x in np.argwhere(image > 0)]
    for y, x in on:
        if image[y, x] <= rel * image.max():
            continue
        rival = [(a, b) for a in range(max(0, y - distance), min(32, y + distance + 1)) for b in range(max(0, x - distance), min(32, x + distance + 1)) if (a, b) != (y, x)]
        out += all(image[a, b] < image[y, x] or (image[a, b] == image[y, x] and (a, b) > (y, x)) for a, b in rival)
    return out


def test_e9_multipeak_share(got, feet):
    assert got("e9_multipeak_share")["share"].iloc[0] == pytest.approx(np.mean([peaks_of(f, 3, 0.3) >= 2 for f in feet.values()]))


def test_u1_upsample_footprints(got, feet):
    rows = got("u1_upsample_footprints")
    for k, image in feet.items():
        want = np.zeros((64, 64))
        for y, x in np.ndindex(64, 64):  # bilinear, half-pixel centres, edge values beyond
            sy, sx = min(max((y + 0.5) / 2 - 0.5, 0), 31), min(max((x + 0.5) / 2 - 0.5, 0), 31)
            y0, x0 = int(sy), int(sx)
            y1, x1, fy, fx = min(y0 + 1, 31), min(x0 + 1, 31), sy - y0, sx - x0
            want[y, x] = (1 - fy) * ((1 - fx) * image[y0, x0] + fx * image[y0, x1]) + fy * ((1 - fx) * image[y1, x0] + fx * image[y1, x1])
        own = rows[rows.k == k]
        mine = np.zeros(4096)
        mine[own["p"]] = own["a"]
        assert np.allclose(mine, want.ravel(), atol=1e-9)


def test_p13_smoothed_peaks(got, feet):
    rows = got("p13_smoothed_peaks").set_index("k")
    for k, image in feet.items():
        taps = np.exp(-0.5 * np.arange(-4, 5) ** 2)
        smooth = correlate(image, np.outer(taps, taps) / taps.sum() ** 2)
        assert smooth[rows.loc[k, "y"], rows.loc[k, "x"]] >= smooth.max() * (1 - 1e-9)


def test_g18_hungarian_match(spark, sf, got):
    p = views.part_cells(spark, sf).toPandas()
    rows, total = got("g18_hungarian_match"), 0.0
    for sa, sb in itertools.combinations(sorted(p.session.unique()), 2):
        a, b = p[p.session == sa], p[p.session == sb]
        d = np.hypot(a.cy.to_numpy()[:, None] - b.cy.to_numpy(), a.cx.to_numpy()[:, None] - b.cx.to_numpy())
        corr = np.exp(-d / 8)
        ok = (d <= 4) & (corr >= 0.5)
        score = np.where(ok, 0.5 * corr + 0.5 * (1 - d / 4), -1e6)
        best = sum(score[i, j] for i, j in solvers.assign(-score) if ok[i, j])
        own = rows[(rows.sa == sa) & (rows.sb == sb)]
        at = {k: i for i, k in enumerate(a.k)}, {k: i for i, k in enumerate(b.k)}
        assert own["i"].is_unique and own["j"].is_unique
        assert all(ok[at[0][i], at[1][j]] and s == pytest.approx(score[at[0][i], at[1][j]]) for i, j, s in zip(own["i"], own["j"], own["score"]))
        assert len(own) == sum(ok[i, j] for i, j in solvers.assign(-score)) and own["score"].sum() == pytest.approx(best, rel=1e-9)


def test_g12_spatial_model(got, traces):
    smooth = lambda v: np.array([v[max(0, i - 1) : i + 2].mean() for i in range(len(v))])
    r = [pearson(v, smooth(v)) for v in traces.values()] + [pearson(a, b) for a, b in itertools.combinations(traces.values(), 2)]
    model = cells.fit_spatial_model(np.array(r))
    rows = got("g12_spatial_model", "x")
    assert model is not None and len(rows) == 1000
    assert np.allclose(rows["x"], model.grid) and np.allclose(rows["p"], model.p_same, atol=1e-3)
    assert rows["p"].iloc[np.searchsorted(rows["x"], 0.95)] > rows["p"].iloc[np.searchsorted(rows["x"], 0.5)] and rows["p"].between(0, 1).all()


def near_pairs(spark, sf, reach):
    p = views.part_cells(spark, sf).toPandas().sort_values(["session", "k"])
    out = {}
    for (sa, i, ya, xa), (sb, j, yb, xb) in itertools.combinations(p[["session", "k", "cy", "cx"]].itertuples(index=False, name=None), 2):
        if sa != sb and math.hypot(ya - yb, xa - xb) <= reach:
            out[sa, i, sb, j] = math.hypot(ya - yb, xa - xb)
    return out


def test_g13_centroid_model(spark, sf, got):
    pairs = near_pairs(spark, sf, 12.0)
    rows, model = got("g13_centroid_model", "x"), cells.fit_centroid_model(np.array(sorted(pairs.values())), 12.0)
    assert (model is None) == (not len(rows))
    if model is not None:
        assert np.allclose(rows["x"], model.grid) and np.allclose(rows["p"], model.p_same, atol=1e-3) and rows["p"].between(0, 1).all()


def test_g17_mixture_posterior(spark, sf, got):
    pairs, rows = near_pairs(spark, sf, 12.0), got("g17_mixture_posterior")
    assert {(r.sa, r.i, r.sb, r.j): pytest.approx(r.dist) for r in rows.itertuples()} == pairs
    # the posterior of two normals that are a fixed point of the updates
    x, p = -rows["dist"].to_numpy(), rows["p"].to_numpy()
    logs = []
    for r in (1 - p, p):
        mu = (r * x).sum() / r.sum()
        var = (r * (x - mu) ** 2).sum() / r.sum() + 1e-6
        logs.append(np.log(r.sum() / len(x)) - 0.5 * ((x - mu) ** 2 / var + np.log(var)))
    assert np.allclose(1 / (1 + np.exp(logs[0] - logs[1])), p, atol=0.02)
    assert (p * x).sum() / p.sum() > ((1 - p) * x).sum() / (1 - p).sum()


def test_g2_register_sessions(got, feet):
    rows = got("g2_register_sessions")
    assert set(zip(rows.session, rows.k)) == {(s, k) for s in range(3) for k in feet}  # every cell once
    assert not rows.duplicated(["session", "k"]).any() and not rows.duplicated(["g", "session"]).any()
    # sessions are moved copies: clusters of several sessions are mostly copies of one footprint
    many = [g for _, g in rows.groupby("g") if len(g) > 1]
    assert len(many) >= 0.3 * len(feet) and np.mean([g["k"].nunique() == 1 for g in many]) > 0.8


def test_t13_fit_extract(got, recording):
    rows, images = got("t13_fit_extract"), []
    assert (rows["a"] > 0).all() and rows["p"].between(0, 36 * 36 - 1).all() and not rows.duplicated(["k", "p"]).any()
    for _, own in rows.groupby("k"):
        assert (own["a"] ** 2).sum() == pytest.approx(1.0)
        image = np.zeros(36 * 36)
        image[own["p"]] = own["a"]
        images.append(image.reshape(36, 36))
        assert arrays.label(images[-1] > 0, diagonal=True).max() == 1
    assert found_cells(images, [None] * len(images), recording[1]) == set(range(9)) and len(images) <= 12


def test_w1_sweep(got, recording):
    rows, movie = got("w1_sweep"), recording[0]
    assert len(rows) == 4 and rows["error"].isna().all()
    for r in rows.itertuples():
        p = Params.from_json(r.params)
        a, c, _ = seeding.greedy(movie, p.sigma, min_corr=p.min_corr, min_pnr=5.0, seed_mode="threshold")
        rest = movie - (np.einsum("kyx,kt->tyx", a, c) if len(a) else 0)
        assert r.score == pytest.approx(1 - (rest**2).sum() / (movie**2).sum())
    assert rows.sort_values("rank")["score"].is_monotonic_decreasing and rows["score"].max() > 0.5


def test_w8_motion_search(got):
    rows = got("w8_motion_search")
    assert len(rows) == 3 and (rows["error"] == "").all() and rows["best"].sum() == 1
    loosest = rows[rows["max_shift"] == "(3, 3)"]
    assert set(loosest["gsig"]) == {1.0, 2.0}
    order = rows.assign(ok=~rows.saturated & rows.beats_raw).sort_values(["ok", "score"])
    last = rows[rows.gsig == rows[rows.best]["gsig"].iloc[0]].assign(ok=lambda d: ~d.saturated & d.beats_raw).sort_values(["ok", "score"]).iloc[-1]
    assert bool(last["best"]) and len(order) == 3


def test_e12_model_quality(got, feet, traces):
    row = got("e12_model_quality").iloc[0]
    on = {k: (f > 0).sum() for k, f in feet.items()}
    q = np.percentile(list(on.values()), [25, 50, 75])
    assert row["K"] == len(feet) and (row["npix_p25"], row["npix_median"], row["npix_iqr"]) == (pytest.approx(q[0]), pytest.approx(q[1]), pytest.approx(q[2] - q[0]))
    proj = [pearson(v, v + 0.1 * v - np.arange(len(v))) for v in traces.values()]
    assert row["cprojcorr_mean"] == pytest.approx(np.mean(proj), abs=1e-9) and row["cprojcorr_median"] == pytest.approx(np.median(proj), abs=1e-9)
    image = np.sin(np.arange(1024)).reshape(32, 32)
    space = []
    for f in feet.values():
        y, x = np.nonzero(f)
        box = slice(max(0, y.min() - 4), y.max() + 5), slice(max(0, x.min() - 4), x.max() + 5)
        space.append(pearson(f[box].ravel(), image[box].ravel()))
    assert row["spatialcorr_median"] == pytest.approx(np.median(space), abs=1e-9)
    assert row["npix_oversize"] == pytest.approx(q[1] / (np.pi * 9.0))


def test_every_query_without_a_twin_has_a_test_here():
    text = open(__file__).read()
    bare = set(registry.QUERIES) - set(registry.ORACLES)
    named = {n for n in bare if f'"{n}"' in text}
    assert bare - named == set(), sorted(bare - named)
