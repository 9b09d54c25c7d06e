"""Word shingles of whole texts as sorted 64-bit hashes, and SetSketch registers of such sets."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
REGISTERS = 144
#: The base of the exponential spacing of register values, the rate of the minima, and the largest value.
BASE, RATE, TOP = 1.001, 20.0, 65_535

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_B = 0x9E3779B97F4A7C15 | 1
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, by doubling."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts (A-Z lower-cased), and the number of words of each text."""
    data = b" ".join([*texts, b""]).translate(_LOWER)
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[raw]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(len(raw), _B), out=sums[1:])
    own = (sums[ends] - sums[starts]) * _powers(len(raw) + 1, pow(_B, -1, 1 << 64))[starts]
    limits = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], limits])))
    return mix(own + (ends - starts).astype(np.uint64)), counts


def shingle_sets(texts: list[bytes], size: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than size make one shingle, no words none."""
    words, counts = word_hashes(texts)
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for i in range(size):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + words[i : i + len(rolled)]
    rolled = mix(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(rolled[at : at + n - size + 1]))
        elif n:
            h = np.full(1, n, np.uint64)
            for i in range(at, at + n):
                h = mix(h * np.uint64(31) + words[i : i + 1])
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def digest(found: np.ndarray) -> bytes:
    """16 bytes that tell sets apart."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def sketches(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers, one row of m 16-bit values for each set (all 0 for empty sets).

    Every element is a Poisson process of rate m with points on uniform registers, which gives each register an
    exponential value; a register keeps the minimum over the set, as the exponent of BASE below it. Only points
    under the largest minimum so far are drawn. Registers of a union are the maxima of the sets' registers.
    """
    docs = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    lowest = np.full(len(sets) * m, np.inf)
    if len(docs):
        h, t, j = np.concatenate(sets), np.zeros(len(docs)), 0
        while len(h):
            j += 1
            with np.errstate(over="ignore"):
                r = mix(h + np.uint64(j) * _GOLDEN if j < 1 << 20 else h)
            t = t - np.log(((r >> np.uint64(32)).astype(np.float64) + 0.5) / 4294967296.0) / m
            at = docs * m + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(lowest, at, t)
            limit = lowest.reshape(len(sets), m).max(1)
            on = t < limit[docs]
            h, t, docs = h[on], t[on], docs[on]
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(lowest / RATE) / np.log(BASE))
    return np.clip(np.where(np.isfinite(k), k, 0), 0, TOP).astype(np.uint16).reshape(len(sets), m)


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sets (rows of registers, and set sizes) by maximum likelihood.

    The likelihood is that of the numbers of registers that are greater, smaller and equal.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def value(j):
        up, down = p(u - v * j), p(v - u * j)
        log = lambda n, q: np.where(n > 0, n * np.log(np.maximum(q, 1e-300)), 0.0)
        return log(more, up) + log(less, down) + log(same, 1 - up - down)

    for _ in range(40):
        third = (hi - lo) / 3
        left = value(lo + third) < value(hi - third)
        lo, hi = np.where(left, lo + third, lo), np.where(left, hi, hi - third)
    return (lo + hi) / 2
