"""Deconvolution of traces that follow an autoregression of first or second order, many traces at once.

A trace y is a baseline, noise and a calcium course c whose innovations s[t] = c[t] - g1 c[t-1] - g2 c[t-2] are not
negative. Of all such courses the one that minimises |y - c|^2 / 2 + penalty * sum(s) is sought, with the penalty at
which the distance to y is what the noise explains. With G the matrix that takes c to s, the multipliers nu of s >= 0 and s itself
are a linear complementarity problem, s = G (y - penalty G'1) + G G' nu, whose matrix has two bands on each side of
its diagonal. It is solved by block principal pivoting: guess where s is zero, solve for nu there, swap all places
of wrong sign. For a given guess c is linear in the penalty, so the penalty that meets the noise is the root of a
quadratic. The banded systems are reduced by halves (even-odd elimination of blocks of two), so that each step works
on whole arrays, traces by time, and nothing goes sample by sample.
"""

from __future__ import annotations

import numpy as np

from lumenframe.functions.arrays import noise_level

#: Largest decay of a frame that is taken for stable.
LARGEST_ROOT = 0.9999
#: Relative slack of the distance to the trace, and of signs.
CLOSE = 1e-7
SIGN = 1e-10
ROUNDS = 1000
#: Rounds without progress after which places change sides one by one, which ends for certain.
SPARE = 20


def stable(g: np.ndarray) -> np.ndarray:
    """Coefficients (traces, order) whose response never falls below zero nor grows: roots are real, from 0 to LARGEST_ROOT.

    Complex roots are replaced by their real part; a first-order coefficient is its own root.
    """
    g = np.atleast_2d(np.asarray(g, float))
    if g.shape[1] == 1:
        return np.clip(g, 0.0, LARGEST_ROOT)
    half, inside = g[:, 0] / 2, g[:, 0] ** 2 / 4 + g[:, 1]
    spread = np.sqrt(np.maximum(inside, 0))
    slow, fast = np.clip(half + spread, 0, LARGEST_ROOT), np.clip(half - spread, 0, LARGEST_ROOT)
    return np.stack([slow + fast, -slow * fast], 1)


def second_order(trace: np.ndarray, lags: int = 12) -> tuple[np.ndarray, float]:
    """(two coefficients, noise) of a trace, by least squares over its covariances at lags that white noise does not reach.

    The equation of lag k holds those of k - 1 and k - 2, so from lag 3 on that of lag 0, where the noise is, has no
    part. A trace that is shorter than six or without variance has coefficients 0.
    """
    x = np.asarray(trace, float)
    sn = float(noise_level(x[None])[0])
    x, n = x - x.mean(), len(x)
    k = np.arange(3, min(lags, n - 3) + 3)
    if n < 6 or not x.any():
        return np.zeros(2), sn
    cov = np.array([x[: n - j] @ x[j:] / n for j in range(k[-1] + 1)])
    system = np.stack([cov[k - 1], cov[k - 2]], 1)
    return stable(np.linalg.lstsq(system, cov[k], rcond=None)[0])[0], sn


def _ahead(x: np.ndarray, n: int) -> np.ndarray:
    """x[t + n], 0 beyond the end."""
    out = np.zeros_like(x)
    out[..., : x.shape[-1] - n] = x[..., n:]
    return out


def _behind(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[..., n:] = x[..., : x.shape[-1] - n]
    return out


def innovations(c: np.ndarray, g: np.ndarray) -> np.ndarray:
    """G c of courses (traces, time)."""
    return c - sum(g[:, j, None] * _behind(c, j + 1) for j in range(g.shape[1]))


def _transposed(s: np.ndarray, g: np.ndarray) -> np.ndarray:
    """G' s."""
    return s - sum(g[:, j, None] * _ahead(s, j + 1) for j in range(g.shape[1]))


def _times(a, b):
    """Products of 2 x 2 blocks, each a tuple of its entries by rows."""
    return a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]


def _turned(a):
    return a[0], a[2], a[1], a[3]


def _on(a, v):
    """Blocks times pairs of values."""
    return a[0] * v[0] + a[1] * v[1], a[2] * v[0] + a[3] * v[1]


def _inverse(a):
    det = a[0] * a[3] - a[1] * a[2]
    return a[3] / det, -a[1] / det, -a[2] / det, a[0] / det


def _blocks(diagonal, upper, right):
    """Solves symmetric block-tridiagonal systems along the last axis.

    diagonal, upper: entries of blocks, upper[i] couples block i to i + 1; right: pairs of values with one more axis in
    front, for several right sides.
    """
    n = diagonal[0].shape[-1]
    if n == 1:
        return _on(_inverse(diagonal), right)
    even, odd = slice(0, None, 2), slice(1, None, 2)
    m = n // 2  # odd blocks, which go; block 2j is left of them, block 2j + 2 right
    inv = _inverse(tuple(x[..., odd] for x in diagonal))
    left = tuple(x[..., even][..., :m] for x in upper)
    more = tuple(x[..., odd] for x in upper)  # one less where no even block follows
    k = more[0].shape[-1]
    cut = lambda x, j: tuple(v[..., :j] for v in x)
    by_left, by_right = _times(left, inv), _times(_turned(more), cut(inv, k))
    d, r, mine = [x[..., even].copy() for x in diagonal], [x[..., even].copy() for x in right], tuple(x[..., odd] for x in right)
    for x, v in zip(d, _times(by_left, _turned(left))):
        x[..., :m] -= v
    for x, v in zip(d, _times(by_right, more)):
        x[..., 1 : k + 1] -= v
    for x, v in zip(r, _on(by_left, mine)):
        x[..., :m] -= v
    for x, v in zip(r, _on(by_right, cut(mine, k))):
        x[..., 1 : k + 1] -= v
    found = _blocks(tuple(d), tuple(-x for x in _times(cut(by_left, k), more)), tuple(r))
    rest = [a - b for a, b in zip(mine, _on(_turned(left), cut(found, m)))]
    for x, v in zip(rest, _on(more, tuple(v[..., 1 : k + 1] for v in found))):
        x[..., :k] -= v
    out = tuple(np.empty(v.shape[:-1] + (n,)) for v in found)
    for x, a, b in zip(out, found, _on(inv, rest)):
        x[..., even], x[..., odd] = a, b
    return out


def _solve(bands, zero: np.ndarray, right: np.ndarray) -> np.ndarray:
    """nu of G G' nu = right on the places where s is zero, 0 elsewhere; right has several sides in front."""
    size = zero.shape[1]
    wide = size + size % 2
    pad = lambda x: np.pad(x, [(0, 0)] * (x.ndim - 1) + [(0, wide - size)])
    z = pad(zero)
    own, one, two = (pad(np.broadcast_to(b, zero.shape)) for b in bands)
    own = np.where(z, own, 1.0)
    one, two = one * (z & _ahead(z, 1)), two * (z & _ahead(z, 2))
    a, b = slice(0, None, 2), slice(1, None, 2)
    diagonal = own[:, a], one[:, a], one[:, a], own[:, b]
    upper = two[:, a][:, :-1], np.zeros_like(two[:, a][:, :-1]), one[:, b][:, :-1], two[:, b][:, :-1]
    side = pad(np.where(zero, right, 0.0))
    found = _blocks(diagonal, upper, (side[..., a], side[..., b]))
    out = np.empty(side.shape)
    out[..., a], out[..., b] = found
    return out[..., :size]


def _bands(g: np.ndarray, size: int):
    """The diagonal of G G' and the two bands beside it."""
    g1 = g[:, :1]
    g2 = g[:, 1:2] if g.shape[1] > 1 else np.zeros_like(g1)
    t = np.arange(size)
    return 1 + g1**2 * (t >= 1) + g2**2 * (t >= 2), -g1 + g1 * g2 * (t >= 1), np.broadcast_to(-g2, (len(g), size))


def nearest(y: np.ndarray, g: np.ndarray, goal: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, penalty, rounds) of traces (K, T) with coefficients (K, order), which are used as they are.

    Without goals the penalty is 0. With them it is such that |y - c|^2 meets the goal, or 0 where the nearest course is
    already farther. A trace that is not settled after ROUNDS rounds has rounds = -1 and its last course.
    """
    y, g = np.atleast_2d(np.asarray(y, float)), np.asarray(g, float)
    k, size = y.shape
    bands, ones = _bands(g, size), _transposed(np.ones_like(y), g)
    q = np.stack([-innovations(y, g), innovations(ones, g)])  # right sides for the trace and for the penalty
    scale = np.maximum(np.abs(y).max(1, initial=0.0), 1e-300)
    aim = np.zeros(k) if goal is None else np.asarray(goal, float)
    out, penalty, rounds = np.zeros_like(y), np.zeros(k), np.full(k, -1)
    low, high = np.zeros(k), np.full(k, np.inf)
    zero = q[0] > 0
    best, spare = np.full(k, size + 1), np.full(k, SPARE)
    at = np.arange(k)
    for turn in range(1, ROUNDS + 1):
        if not len(at):
            break
        gs, z = g[at], zero[at]
        nu = _solve([b[at] for b in bands], z, q[:, at])
        back = np.stack([_transposed(v, gs) for v in nu])
        lam = penalty[at, None]
        c = y[at] + back[0] + lam * (back[1] - ones[at])
        s, m = innovations(c, gs), nu[0] + lam * nu[1]
        out[at] = c
        limit = SIGN * (scale[at] + penalty[at])[:, None]
        wrong = np.where(z, m < -np.maximum(limit, SIGN * np.abs(m).max(1, keepdims=True)), s < -limit)
        many = wrong.sum(1)
        # settled at this penalty: does the distance meet the goal?
        r0, r1 = -back[0], ones[at] - back[1]
        gap = ((r0 + lam * r1) ** 2).sum(1)
        right = many == 0
        done = right & ((aim[at] <= 0) | (np.abs(gap - aim[at]) <= CLOSE * aim[at]) | ((gap >= aim[at]) & (penalty[at] == 0)))
        a2, a1, a0 = (r1 * r1).sum(1), (r0 * r1).sum(1), (r0 * r0).sum(1) - aim[at]
        flat = a2 <= 1e-14 * np.maximum((ones[at] ** 2).sum(1), 1e-300)  # no innovation is left to take
        done |= right & flat
        ask = right & ~done
        if ask.any():
            i = at[ask]
            over = gap[ask] >= aim[i]
            high[i], low[i] = np.where(over, penalty[i], high[i]), np.where(over, low[i], penalty[i])
            root = (-a1[ask] + np.sqrt(np.maximum(a1[ask] ** 2 - a2[ask] * a0[ask], 0))) / np.maximum(a2[ask], 1e-300)
            middle = np.where(np.isfinite(high[i]), (low[i] + np.where(np.isfinite(high[i]), high[i], 0)) / 2, np.maximum(2 * low[i], 1e-6 * scale[i]))
            penalty[i] = np.where((root > low[i]) & (root < high[i]), root, middle)
            best[i], spare[i] = size + 1, SPARE
            closed = np.isfinite(high[i]) & (high[i] - low[i] <= 1e-13 * high[i])
            done[np.flatnonzero(ask)[closed]] = True
        # all places of wrong sign change sides, as long as that leaves fewer of them; else the last one only
        move = np.flatnonzero(~right)
        i = at[move]
        fewer = many[move] < best[i]
        best[i] = np.where(fewer, many[move], best[i])
        spare[i] = np.where(fewer, SPARE, spare[i] - 1)
        single = spare[i] < 0
        flip = wrong[move]
        if single.any():
            last = size - 1 - np.argmax(flip[single][:, ::-1], 1)
            flip[single] = False
            flip[np.flatnonzero(single), last] = True
        zero[i] ^= flip
        rounds[at[done]] = turn
        at = at[~done]
    return out, penalty, rounds


def deconvolve_all(y: np.ndarray, g: np.ndarray, sn: np.ndarray) -> dict[str, np.ndarray]:
    """c, s (K, T), bl, g (K, order), penalty, rounds and error of traces (K, T).

    The baseline is the median. Coefficients are made stable first. A trace with a value that is not finite, or whose
    coefficients or noise are not, gives its clipped self without spikes, and the reason; all others are None there.
    """
    y = np.atleast_2d(np.asarray(y, float))
    g, sn = np.asarray(g, float).reshape(len(y), -1), np.asarray(sn, float)
    used, error = stable(np.nan_to_num(g)) if len(y) else g, np.full(len(y), None, object)
    for bad, why in ((~np.isfinite(y).all(1), "a value is not finite"), (~np.isfinite(g).all(1), "a coefficient is not finite"), (~np.isfinite(sn) | (sn < 0), "the noise is no number")):
        error[bad & (error == None)] = why  # noqa: E711
    fine = error == None  # noqa: E711
    base = np.zeros(len(y))
    if y.shape[1]:
        base[fine] = np.median(y[fine], 1)
    c, s = np.maximum(np.nan_to_num(y, posinf=0.0, neginf=0.0), 0), np.zeros_like(y)
    penalty, rounds = np.zeros(len(y)), np.zeros(len(y), int)
    if fine.any() and y.shape[1]:
        found, penalty[fine], rounds[fine] = nearest(y[fine] - base[fine, None], used[fine], y.shape[1] * sn[fine] ** 2)
        c[fine] = np.maximum(found, 0)
        s[fine] = np.maximum(innovations(c[fine], used[fine]), 0)
    lost = rounds < 0
    error[lost], c[lost], s[lost], base[lost] = f"not settled after {ROUNDS} rounds", np.maximum(y[lost], 0), 0.0, 0.0
    return {"c": c, "s": s, "bl": base, "g": used, "penalty": penalty, "rounds": rounds, "error": error}


def deconvolve(trace: np.ndarray, g, sn: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(calcium, spikes, baseline) of one trace; g is one coefficient or two."""
    out = deconvolve_all(np.asarray(trace, float)[None], np.atleast_1d(np.asarray(g, float))[None], np.array([sn]))
    return out["c"][0], out["s"][0], float(out["bl"][0])
