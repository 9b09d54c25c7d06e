"""Seeding components: tiles, local maxima and the greedy extraction, whole inside one task for each tile."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import arrays, deconvolution, solvers


def tile_starts(n: int, size: int, overlap: int) -> list[int]:
    """First positions of overlapping tiles that cover n; the last one is moved back to end at n."""
    if size >= n:
        return [0]
    step = max(1, size - overlap)
    return sorted({min(s, n - size) for s in range(0, n - overlap, step)})


def tile_spans(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """First and past positions of the tiles."""
    return [(a, min(n, a + size)) for a in tile_starts(n, size, overlap)]


def tile_grid(spark: SparkSession, height: int, width: int, size: int, overlap: int) -> DataFrame:
    """(r0, r1, c0, c1) of the tiles, ends excluded."""
    rows = [(r, min(height, r + size), c, min(width, c + size)) for r in tile_starts(height, size, overlap) for c in tile_starts(width, size, overlap)]
    return spark.createDataFrame(rows, "r0 int, r1 int, c0 int, c1 int")


def mixture_seeds(cn: np.ndarray, pnr: np.ndarray, sigma: float, smooth: float = 0.7) -> np.ndarray:
    """(row, column) of peaks of the smoothed product that belong to the brighter of two classes of log height."""
    product = arrays.gaussian(np.nan_to_num(np.maximum(cn, 0)) * np.nan_to_num(pnr), smooth * sigma)
    peaks = arrays.local_maxima(product, max(1, round(sigma)))
    if len(peaks) < 8:
        return peaks
    height = product[peaks[:, 0], peaks[:, 1]]
    peaks, height = peaks[height > 0], height[height > 0]
    if len(height) < 8:
        return peaks
    x = np.log(height)
    pi, mu, sd = solvers.two_gaussians(x)
    d = pi * np.exp(-0.5 * ((x[:, None] - mu) / sd) ** 2) / sd
    kept = d[:, int(np.argmax(mu))] >= d[:, int(np.argmin(mu))]
    if kept.sum() < max(3, 0.01 * len(peaks)):
        return peaks[: max(3, int(np.ceil(0.1 * len(peaks))))]  # peaks are brightest first
    return peaks[kept]


def threshold_seeds(cn: np.ndarray, pnr: np.ndarray, min_corr: float, min_pnr: float, distance: int) -> np.ndarray:
    """Peaks of cn * pnr where both are high enough, brightest first."""
    product = np.where((cn >= min_corr) & (pnr >= min_pnr), np.nan_to_num(cn * pnr), 0)
    return arrays.local_maxima(product, distance, above=0.0)


def extract_component(filtered: np.ndarray, raw: np.ndarray, at: tuple[int, int], *, neuron: float = 0.8, back: float = 0.4, circle: float = 2.5) -> tuple[np.ndarray, np.ndarray] | None:
    """(footprint, trace) around a seed in boxes (t, y, x), by correlation with the seed and three regressors."""
    t, h, w = filtered.shape
    z = filtered - filtered.mean(0)
    norm = np.sqrt((z * z).sum(0))
    seed = z[:, at[0], at[1]]
    if norm[at] <= 0:
        return None
    r = np.tensordot(seed, z, (0, 0)) / np.maximum(norm * norm[at], 1e-12)
    own = r > neuron
    if not own.any():
        return None
    unit = z[:, own] / norm[own]
    c0 = unit.mean(1)
    far = r < back
    bg = np.median(raw[:, far], axis=1) if far.any() else np.ones(t)
    design = np.stack([c0, bg, np.ones(t)], 1)
    coef = np.linalg.lstsq(design, raw.reshape(t, -1), rcond=None)[0]
    a = np.maximum(coef[0], 0).reshape(h, w)
    a = arrays.clip_to_circle(a, circle)
    a = np.where(arrays.largest_region(a > 0), a, 0)
    if not a.any():
        return None
    rise = np.diff(c0, prepend=c0[0])
    rms = float(np.sqrt(np.mean(rise**2)))
    flat = (rise >= 0) & (rise < 0.1 * rms)
    return a, c0 - (np.median(c0[flat]) if flat.any() else np.median(c0))


def greedy(movie: np.ndarray, sigma: float, *, min_corr: float = 0.8, min_pnr: float = 10.0, most: int | None = None, min_pixel: int = 3, border: int = 0, seed_mode: str = "mixture", neuron: float = 0.8, back: float = 0.4, circle: float = 2.5, stride: int = 1, suppress: float = 0.5, surround: bool = True) -> tuple[list[np.ndarray], list[np.ndarray], list[tuple[int, int]]]:
    """(footprints, traces, centres) of a movie (t, y, x), one seed after the other, each subtracted from the rest.

    Every accepted component changes the residual that the next one is read from, so this loop is serial; it
    is meant for one tile. Seeds are taken by cn * pnr; passes repeat until one brings nothing.
    """
    raw = np.asarray(movie, float).copy()
    t, h, w = raw.shape
    cn, pnr, sn, filtered = arrays.corr_pnr(raw, sigma, stride, surround)
    kernel = arrays.surround_kernel(sigma)
    tried = np.zeros((h, w), bool)
    inner = np.zeros((h, w), bool)
    inner[border : h - border if border else h, border : w - border if border else w] = True
    reach = max(int(3 * sigma), 5)
    out_a, out_c, centres = [], [], []
    while True:
        before = len(out_a)
        clean = np.nan_to_num(np.maximum(cn, 0))
        seeds = mixture_seeds(clean, pnr, sigma) if seed_mode == "mixture" else threshold_seeds(clean, pnr, min_corr, min_pnr, max(1, round(sigma)))
        score = clean * pnr
        for y, x in sorted(map(tuple, seeds.tolist()), key=lambda p: -score[p]):
            if tried[y, x] or not inner[y, x]:
                continue
            tried[y, x] = True
            if most is not None and len(out_a) >= most:
                return out_a, out_c, centres
            change = np.diff(filtered[:, y, x])
            if not len(change) or change.max() < 3 * change.std():
                continue
            ys, xs = slice(max(0, y - reach), min(h, y + reach + 1)), slice(max(0, x - reach), min(w, x + reach + 1))
            found = extract_component(filtered[:, ys, xs], raw[:, ys, xs], (y - ys.start, x - xs.start), neuron=neuron, back=back, circle=circle)
            if found is None or np.count_nonzero(found[0]) < min_pixel:
                continue
            a, c = found
            g, noise = solvers.ar_coefficients(c)
            clean_c, _, _ = deconvolution.deconvolve(c, float(g[0]), noise)
            if not clean_c.any():
                continue
            raw[:, ys, xs] -= clean_c[:, None, None] * a
            wide = slice(max(0, y - 2 * reach), min(h, y + 2 * reach + 1)), slice(max(0, x - 2 * reach), min(w, x + 2 * reach + 1))
            full = np.zeros((h, w))
            full[ys, xs] = a
            spread = arrays.convolve(full, kernel)[wide]
            filtered[:, wide[0], wide[1]] -= (clean_c - clean_c.mean())[:, None, None] * spread
            tried |= full > suppress * a.max()
            box = filtered[:, wide[0], wide[1]]
            level = sn[wide]
            pnr[wide] = np.where(level > 0, np.maximum(box.max(0), 0) / np.where(level > 0, level, 1), 0)
            cn[wide] = arrays.neighbour_correlation(np.where(box[::stride] >= 3 * level, box[::stride], 0))
            out_a.append(full)
            out_c.append(clean_c)
            centres.append((y, x))
        if len(out_a) == before:
            return out_a, out_c, centres


def greedy_tiles(pixels: DataFrame, height: int, width: int, sigma: float, *, size: int | None = None, overlap: int | None = None, **settings) -> DataFrame:
    """(tile, k, cy, cx, ps array, as array, c array): the greedy loop on every overlapping tile at once.

    pixels: (y, x, tr). A pixel is copied to the tiles that cover it, row by row and column by column of the grid.
    """
    size = size or max(32, int(12 * sigma))
    overlap = overlap if overlap is not None else max(4, int(4 * sigma))
    spans = lambda n: F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in tile_spans(n, size, overlap)])
    over = lambda c, n: F.explode(F.filter(spans(n), lambda s: (F.col(c) >= s["lo"]) & (F.col(c) < s["hi"])))
    rows = pixels.select("y", "x", "tr", over("y", height).alias("r")).withColumn("c", over("x", width))
    rows = rows.select("y", "x", "tr", F.col("r.lo").alias("r0"), F.col("r.hi").alias("r1"), F.col("c.lo").alias("c0"), F.col("c.hi").alias("c1"))
    rows = rows.withColumn("tile", F.concat_ws("_", "r0", "c0"))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        r0, r1, c0, c1 = (int(part[c].iloc[0]) for c in ("r0", "r1", "c0", "c1"))
        movie = np.zeros((len(part["tr"].iloc[0]), r1 - r0, c1 - c0))
        movie[:, part["y"].to_numpy() - r0, part["x"].to_numpy() - c0] = np.stack(part["tr"].to_list()).T
        a, c, at = greedy(movie, sigma, **settings)
        rows_ = []
        for k, (f, trace, (y, x)) in enumerate(zip(a, c, at)):
            yy, xx = np.nonzero(f)
            rows_.append((part["tile"].iloc[0], k, y + r0, x + c0, ((yy + r0) * width + xx + c0).tolist(), f[yy, xx].tolist(), trace.tolist()))
        return pd.DataFrame(rows_, columns=["tile", "k", "cy", "cx", "ps", "as", "c"])

    return rows.groupBy("tile").applyInPandas(solve, "tile string, k int, cy int, cx int, ps array<int>, `as` array<double>, c array<double>")


def product_blobs(cn: np.ndarray, pnr: np.ndarray, sigma: float, threshold: float = 0.05, min_corr: float | None = None, min_pnr: float | None = None) -> np.ndarray:
    """(row, column) of blobs of the normalised product of two images; those over both thresholds if they are given."""
    product = np.asarray(cn, float) * np.asarray(pnr, float)
    span = product.max() - product.min()
    if span <= 0:
        return np.zeros((0, 2), int)
    low = max(1.0, 0.5 * sigma)
    at = arrays.blobs((product - product.min()) / span, low, max(low + 1, 3 * sigma), 10, threshold)[:, :2].astype(int)
    on = np.ones(len(at), bool)
    for image, least in ((cn, min_corr), (pnr, min_pnr)):
        if least is not None and len(at):
            on &= np.asarray(image)[at[:, 0], at[:, 1]] >= least
    return at[on]
