"""Per-pixel and per-frame NumPy kernels over array columns: noise, summaries, registration and resampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import arrays
from lumenframe.operators.movies import pixels_of


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(float)


def noise_of(pixels: DataFrame, method: str = "logmexp", low: float = 0.25, high: float = 0.5) -> DataFrame:
    """pixels (..., tr) with sn: all pixels of a batch in one transform."""

    @F.pandas_udf("double")
    def sn(traces: pd.Series) -> pd.Series:
        return pd.Series(arrays.noise_level(_stack(traces), low, high, method)) if len(traces) else pd.Series([], dtype="float64")

    return pixels.withColumn("sn", sn("tr"))


def noise(movie: DataFrame, method: str = "logmexp", by: Sequence[str] = ()) -> DataFrame:
    """(by, y, x, sn)."""
    return noise_of(pixels_of(movie, by), method).select(*by, "y", "x", "sn")


def band_power(movie: DataFrame, low: float = 0.25, high: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """(by, y, x, f, psd): power of each Fourier bin between two frequencies in cycles a frame."""

    @F.pandas_udf("array<struct<f int, psd double>>")
    def bins(traces: pd.Series) -> pd.Series:
        out = []
        for t in traces:
            n, x = len(t), np.asarray(t, float)
            f = np.fft.rfftfreq(n)
            on = np.flatnonzero((f >= low) & (f <= high))
            power = np.abs(np.fft.rfft(x)[on]) ** 2 * (2 / n)
            out.append([{"f": int(i), "psd": float(v)} for i, v in zip(on, power)])
        return pd.Series(out)

    return pixels_of(movie, by).select(*by, "y", "x", F.explode(bins("tr")).alias("b")).select(*by, "y", "x", "b.f", "b.psd")


def corr_pnr_reach(sigma: float | None) -> int:
    """How far `corr_pnr` looks around a pixel."""
    return (max(arrays.surround_kernel(sigma).shape[0] // 2, int(4 * sigma + 0.5)) if sigma else 0) + 1


def corr_pnr(movie: DataFrame, sigma: float | None, stride: int = 1, by: Sequence[str] = (), tile: int = 64, surround: bool = True) -> DataFrame:
    """(by, y, x, sn, cn, pnr) of each recording, (t, y, x, v) or pixels (y, x, tr): filter, centre, noise, peak-to-noise, correlation.

    Pixels are dealt to tiles with a halo as wide as the filter and one neighbour, so that a pixel goes to a bounded
    number of tiles and no task holds a movie; tiles at the edge end where the recording ends. With columns i and j
    pixels are dealt already, to tiles of that size with at least that halo (see `corr_pnr_reach`).
    """
    reach = corr_pnr_reach(sigma)
    around = lambda c: F.sequence(F.floor(F.greatest(c - reach, F.lit(0)) / tile), F.floor((c + reach) / tile))
    if {"i", "j", "tr"} <= set(movie.columns):  # dealt already, as stored tiles are
        pixels = movie.select(*by, "y", "x", "tr", "i", "j")
    else:
        pixels = movie.select(*by, "y", "x", "tr") if "tr" in movie.columns else pixels_of(movie, by)
        pixels = pixels.withColumn("i", F.explode(around(F.col("y")))).withColumn("j", F.explode(around(F.col("x"))))
    types = dict(movie.dtypes)
    head = "".join(f"{c} {types[c]}, " for c in by)

    def solve(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        i, j = key[-2:]
        y, x = part["y"].to_numpy(), part["x"].to_numpy()
        own = (y // tile == i) & (x // tile == j)
        out = {"y": y[own], "x": x[own], "sn": np.zeros(own.sum()), "cn": np.zeros(own.sum()), "pnr": np.zeros(own.sum())}
        if own.any():
            m = np.zeros((len(part["tr"].iloc[0]), np.ptp(y) + 1, np.ptp(x) + 1))
            at = y - y.min(), x - x.min()
            m[:, at[0], at[1]] = _stack(part["tr"]).T
            cn, pnr, sn, _ = arrays.corr_pnr(m, sigma, stride, surround)
            out |= {"sn": sn[at][own], "cn": cn[at][own], "pnr": pnr[at][own]}
        return pd.DataFrame({**{c: part[c].to_numpy()[own] for c in by}, **out})

    return pixels.groupBy(*by, "i", "j").applyInPandas(solve, f"{head}y int, x int, sn double, cn double, pnr double")


def filter_frames(frames: DataFrame, width: int, kernel: np.ndarray) -> DataFrame:
    """frames (..., px) with px correlated with the kernel, a batch of frames in one transform."""
    shared = frames.sparkSession.sparkContext.broadcast(kernel)

    @F.pandas_udf("array<double>")
    def run(px: pd.Series) -> pd.Series:
        if not len(px):
            return pd.Series([], dtype=object)
        x = _stack(px)
        out = arrays.convolve(x.reshape(len(x), -1, width), shared.value)
        return pd.Series(list(out.reshape(len(x), -1)))

    return frames.withColumn("px", run("px"))


def register(frames: DataFrame, template: np.ndarray, *, gsig: float | None = 7, upsample: int = 10, max_shift: tuple[int, int] = (20, 20)) -> DataFrame:
    """frames (..., t, px) with px moved onto the template, and dy, dx.

    One narrow stage: high-pass, estimate, translate. The template is one frame, and is sent once.
    """
    kernel = arrays.highpass_kernel(gsig) if gsig else None
    sharp = arrays.convolve(template, kernel) if gsig else template
    shared = frames.sparkSession.sparkContext.broadcast((sharp, kernel))
    shape = template.shape

    @F.pandas_udf("px array<double>, dy double, dx double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        goal, k = shared.value
        for batch in batches:
            rows = []
            for px in batch:
                frame = np.asarray(px, float).reshape(shape)
                dy, dx = arrays.phase_shift(goal, arrays.convolve(frame, k) if k is not None else frame, upsample, max_shift)
                rows.append((arrays.translate(frame, (dy, dx)).ravel(), dy, dx))
            yield pd.DataFrame(rows, columns=["px", "dy", "dx"])

    kept = [c for c in frames.columns if c != "px"]
    return frames.select(*kept, run("px").alias("r")).select(*kept, "r.px", "r.dy", "r.dx")


def shift_quality(shifts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, mean_step, p99, top) of shifts (t, dy, dx): mean step between frames, 99th percentile and maximum size."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*by).orderBy("t") if by else Window.orderBy("t")
    step = F.hypot(F.col("dy") - F.lag("dy").over(w), F.col("dx") - F.lag("dx").over(w))
    sized = shifts.select(*by, F.hypot("dy", "dx").alias("size"), step.alias("step"))
    return sized.groupBy(*by).agg(F.avg("step").alias("mean_step"), F.percentile("size", F.lit(0.99)).alias("p99"), F.max("size").alias("top"))


def upsample_footprints(footprints: DataFrame, shape: tuple[int, int], native: tuple[int, int], order: int = 1) -> DataFrame:
    """(k, p, a): every footprint resized from shape to native with half-pixel centres."""

    from lumenframe.operators.components import each_footprint

    def run(own: np.ndarray, values: np.ndarray) -> dict:
        image = np.zeros(shape[0] * shape[1])
        image[own] = values
        a = arrays.upsample_image(image.reshape(shape), native, order).ravel()
        p = np.flatnonzero(a)
        return {"p": p, "a": a[p]}

    return each_footprint(footprints, run, "p int, a double")


def blobs(image: pd.DataFrame, shape: tuple[int, int], value: str, low: float, high: float, steps: int = 10, threshold: float = 0.05) -> np.ndarray:
    """(row, column, sigma) of blobs of an image (y, x, value), normalised to 0 .. 1."""
    a = np.zeros(shape)
    a[image["y"], image["x"]] = image[value]
    a = (a - a.min()) / max(a.max() - a.min(), 1e-12)
    return arrays.blobs(a, low, high, steps, threshold)


def registration_quality(movie: DataFrame, height: int, width: int) -> DataFrame:
    """(corr_mean, corr_p99, mean_crispness, std_crispness) of a movie (t, y, x, v)."""
    from lumenframe.operators import images

    cn = images.wrapped_correlation_image(movie, height, width).agg(F.avg("cn").alias("corr_mean"), F.percentile("cn", F.lit(0.99)).alias("corr_p99"))
    flat = movie.groupBy("y", "x").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    mean = images.crispness(flat, "m").withColumnRenamed("crispness", "mean_crispness")
    std = images.crispness(flat, "s").withColumnRenamed("crispness", "std_crispness")
    return cn.crossJoin(mean).crossJoin(std)  # one row each
