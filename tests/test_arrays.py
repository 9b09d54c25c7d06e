import numpy as np
import pytest
from itertools import permutations

from lumenframe.functions import arrays as A
from lumenframe.functions import deconvolution as D
from lumenframe.functions import solvers as S

rng = np.random.default_rng(0)


def test_kernel_is_zero_sum_and_constant_images_vanish():
    k = A.surround_kernel(3.0)
    assert k.shape == (19, 19) and abs(k.sum()) < 1e-9
    assert np.abs(A.convolve(np.full((30, 40), 5.0), k)).max() < 1e-9


def test_convolution_equals_direct_sum():
    k = A.surround_kernel(1.0)
    image = rng.random((12, 15))
    wide = np.pad(image, 3, mode="symmetric")
    direct = np.array([[(wide[y : y + 7, x : x + 7] * k).sum() for x in range(15)] for y in range(12)])
    assert np.allclose(A.convolve(image, k), direct)


def test_gaussian_keeps_the_sum_of_a_constant_and_reaches_beyond_small_images():
    assert np.allclose(A.gaussian(np.full((3, 4), 2.0), 5.0), 2.0)


def test_label_matches_flood_fill():
    for diagonal in (False, True):
        m = rng.random((20, 25)) > 0.55
        got, seen, n = A.label(m, diagonal), np.zeros(m.shape, int), 0
        steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
        for y, x in zip(*np.nonzero(m)):
            if seen[y, x]:
                continue
            n += 1
            todo = [(y, x)]
            seen[y, x] = n
            while todo:
                a, b = todo.pop()
                for dy, dx in steps:
                    c, d = a + dy, b + dx
                    if 0 <= c < 20 and 0 <= d < 25 and m[c, d] and not seen[c, d]:
                        seen[c, d] = n
                        todo.append((c, d))
        assert (got == seen).all()


def test_trim_keeps_one_region_and_drops_a_far_speck():
    image = np.zeros((30, 30))
    image[10:16, 10:16] = 1
    image[25:28, 25:28] = 0.5
    for method in ("max", "nrg"):
        a = A.trim_footprint(image, method=method)
        assert a[12, 12] > 0 and a[26, 26] == 0 and A.label(a > 0).max() == 1
    assert not A.trim_footprint(np.zeros((5, 5))).any()
    with pytest.raises(ValueError):
        A.trim_footprint(image, method="other")


def test_local_maxima_leave_the_border_and_keep_distance():
    image = np.zeros((20, 20))
    image[5, 5], image[5, 7], image[15, 15], image[0, 10] = 3, 2, 1, 9
    assert A.local_maxima(image, 3).tolist() == [[5, 5], [15, 15]]


def test_blobs_find_scale():
    y, x = np.mgrid[:60, :60]
    image = np.exp(-((y - 30) ** 2 + (x - 25) ** 2) / (2 * 4.0**2))
    found = A.blobs(image, 2, 8, 13)
    assert len(found) == 1 and found[0][:2].tolist() == [30, 25] and abs(found[0][2] - 4) <= 0.5


def test_noise_level_is_close_for_white_noise():
    x = rng.normal(0, 2.0, (50, 1000))
    assert abs(np.median(A.noise_level(x)) / 2.0 - 1) < 0.25
    # the one-sided spectrum counts power twice, the mean of its logarithm takes most of that back
    assert abs(np.median(A.noise_level(x, method="mean")) - 2.0 * np.sqrt(2)) < 0.1
    with pytest.raises(ValueError):
        A.noise_level(x, method="other")


def test_phase_shift_recovers_whole_and_part_pixels():
    frame = rng.random((64, 64))
    assert A.phase_shift(np.roll(frame, (3, -2), (0, 1)), frame, 10, (10, 10)) == (3.0, -2.0)
    f = np.fft.fft2(frame)
    fy, fx = np.meshgrid(np.fft.fftfreq(64), np.fft.fftfreq(64), indexing="ij")
    moved = np.fft.ifft2(f * np.exp(-2j * np.pi * (1.3 * fy - 0.7 * fx))).real
    dy, dx = A.phase_shift(moved, frame, 10, (10, 10))
    assert abs(dy - 1.3) < 0.11 and abs(dx + 0.7) < 0.11
    assert max(map(abs, A.phase_shift(np.roll(frame, 20, 0), frame, 1, (5, 5)))) <= 5


def test_translate_moves_by_whole_pixels_and_clips():
    frame = rng.random((10, 12))
    assert np.allclose(A.translate(frame, (2, -3))[2:, :-3], frame[:-2, 3:])
    assert (A.translate(frame - 0.5, (0.5, 0.5)) >= 0).all()


def test_baseline_equals_dense_percentile_at_anchors():
    trace = rng.random(100)
    low = A.rolling_baseline(trace, 20, 10, 1)
    dense = [np.percentile(trace[max(0, t - 10) : t + 11], 10) for t in range(100)]
    assert np.allclose(low, dense)
    assert np.allclose(A.rolling_baseline(np.full(50, 3.0), 10, 10), 3.0)


def test_shape_of_disk_and_line():
    y, x = np.mgrid[:21, :21]
    disk = A.shape_of((y - 10) ** 2 + (x - 10) ** 2 <= 64)
    line = A.shape_of((y == 10) & (x > 2) & (x < 18))
    assert disk["eccentricity"] < 0.2 < 0.9 < line["eccentricity"] and disk["solidity"] > 0.85
    assert np.isnan(A.shape_of(np.zeros((4, 4), bool))["solidity"])


def test_resize_by_two_keeps_the_mean():
    image = rng.random((6, 7))
    assert abs(A.upsample_image(image, (12, 14)).mean() - image.mean()) < 0.05
    assert (A.upsample_image(image, (12, 14), 0)[::2, ::2] == image).all()


def test_rigid_round_trip():
    m = A.rigid_matrix((20, 20), 2, -1, 0)
    assert np.allclose(A.warp_points(np.array([[5.0, 6.0]]), m), [[7, 5]])
    image = np.zeros((20, 20))
    image[5, 6] = 1
    assert A.warp_image(image, m)[7, 5] == 1


def test_assignment_is_optimal():
    for _ in range(40):
        n, m = map(int, rng.integers(1, 6, 2))
        c = rng.random((n, m))
        pairs = S.assign(c)
        small = c if n <= m else c.T
        best = min(sum(small[i, q[i]] for i in range(len(small))) for q in permutations(range(small.shape[1]), len(small)))
        assert len(pairs) == min(n, m) and abs(sum(c[p] for p in pairs) - best) < 1e-9
    assert S.assign(np.zeros((0, 3))) == []


def test_deconvolution_recovers_decay():
    y = np.zeros(600)
    for t in range(1, 600):
        y[t] = 0.9 * y[t - 1] + (rng.random() < 0.05)
    noisy = y + rng.normal(0, 0.1, 600)
    g, sn = S.ar_coefficients(noisy)
    assert 0 < g[0] < 1 and abs(sn - 0.1) < 0.1
    c, s, _ = D.deconvolve(noisy, 0.9, 0.1)
    assert np.corrcoef(c, y)[0, 1] > 0.95 and (c >= 0).all() and (s >= 0).all()
    assert (np.diff(c) >= -0.1 * c[:-1] - 1e-6).all()
    c, s, b = D.deconvolve(np.array([np.nan, 1, -1]), 0.9, 0.1)
    assert c.tolist() == [0, 1, 0] and not s.any()


def test_isotonic_decay_beats_other_feasible_points():
    y = rng.normal(0, 1, 40)
    c = D.nearest(y, np.array([[0.8]]))[0][0]
    assert (c[1:] - 0.8 * c[:-1] >= -1e-8).all() and (c >= 0).all()
    best = ((y - c) ** 2).sum()
    for _ in range(200):
        z = np.maximum(c + rng.normal(0, 0.05, 40), 0)
        for t in range(1, 40):
            z[t] = max(z[t], 0.8 * z[t - 1])
        assert ((y - z) ** 2).sum() >= best - 1e-9


def test_prior_shrinks_the_coefficient():
    x = rng.normal(0, 1, 500)
    plain, _ = S.ar_coefficients(x, shrink=False)
    pulled, _ = S.ar_coefficients(x, prior=0.9, prior_weight=0.5)
    assert abs(pulled[0] - np.clip((plain[0] + 0.9) / 2, 1e-6, 0.9999)) < 0.05 or plain[0] <= 1e-6


def test_elastic_net_meets_its_conditions():
    c = np.abs(rng.normal(0, 1, (3, 50)))
    y = np.array([1.0, 0.0, 2.0]) @ c
    gram, q = c @ c.T, (c @ y)[:, None]
    w = S.elastic_nonnegative(gram, q, np.array([1e-6]), 1e-9, tol=1e-10)[:, 0]
    assert np.allclose(w, [1, 0, 2], atol=1e-2)


def test_ring_weights_sum_to_one_when_asked():
    n = rng.normal(0, 1, (6, 80))
    gram, goals, rings = n @ n.T, np.stack([n.mean(0), n[2]]), np.array([[0, 1, 2, 3, 4, 5], [5, 4, 3, 2, 1, 0]])
    assert np.allclose(S.ring_weights(gram, goals @ n.T, rings, sum_to_one=True).sum(1), 1)
    assert np.allclose(S.ring_weights(gram, goals @ n.T, rings, 1e-9)[1], np.eye(6)[3], atol=1e-4)


def test_mixtures_split_clear_classes():
    x = np.concatenate([rng.normal(0, 0.5, 200), rng.normal(5, 0.5, 100)])
    _, mu, _ = S.two_gaussians(x)
    assert np.allclose(sorted(mu), [0, 5], atol=0.3)
    p = S.mixture_posterior(x)
    assert p[:200].max() < 0.5 < p[200:].min()


def test_decay_times_round_trip():
    assert abs(S.g_to_decay(S.decay_to_g(180.0, 20.0), 20.0) - 180) < 1e-9
