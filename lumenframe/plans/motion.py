"""Motion correction as passes over frames (t, px): template from a sample, one narrow job for each pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import arrays
from lumenframe.operators import kernels
from lumenframe.operators.components import _ensure_checkpoints
from lumenframe.operators.movies import spaced
from lumenframe.params import Params
from lumenframe.sources.ingest import evenly

SAMPLE_TOL = 0.01
#: Values of a tile's frames that one task holds.
TILE_VALUES = 1 << 21


def sampled(frames: DataFrame, n_t: int, most: int) -> tuple[DataFrame, int]:
    """((i, px) checkpointed, n): at most that many evenly spaced frames, numbered in order. They stay on the executors."""
    at = spaced(n_t, most)
    number = frames.sparkSession.createDataFrame([(int(t), i) for i, t in enumerate(at)], "of int, i int")
    some = frames.where(F.col("t").isin([int(t) for t in at]))
    rows = some.join(F.broadcast(number), F.col("t") == F.col("of")).select("i", F.col("px").cast("array<double>").alias("px")).checkpoint()  # a number for each sampled frame, at most `most`
    return rows, len(at)


def by_tile(sample: DataFrame, n: int, shape: tuple[int, int], reduce: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """One image (y, x): reduce, over the frames (n, pixels) of each tile of pixels in their order. Only the image meets the driver."""
    size = shape[0] * shape[1]
    tile = max(64, TILE_VALUES // max(1, n))
    cut = F.transform(F.sequence(F.lit(0), F.lit((size - 1) // tile)), lambda j: F.slice("px", j * tile + 1, F.lit(tile)))
    parts = sample.select("i", F.posexplode(cut).alias("tile", "v"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        return pd.DataFrame({"tile": part["tile"].iloc[:1], "v": [reduce(np.stack(part["v"].to_list()).astype(float))]})

    rows = parts.groupBy("tile").applyInPandas(run, "tile int, v array<double>").toPandas().sort_values("tile")
    return np.concatenate(rows["v"].to_list()).reshape(shape)


def sharpness(template: np.ndarray, gsig: float | None) -> float:
    """Variance of the high-passed template."""
    return float((arrays.convolve(template, arrays.highpass_kernel(gsig)) if gsig else template).var())


def settled(before: float, after: float, tol: float | None) -> bool:
    return tol is not None and (after - before) / max(abs(before), 1e-12) < tol


def _each_frame(sample: DataFrame, shape: tuple[int, int], run: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(i, px): every frame through a function of (y, x)."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"i": part["i"], "px": [run(np.asarray(v, float).reshape(shape)).ravel() for v in part["px"]]})

    return sample.mapInPandas(batches, "i int, px array<double>")


def filtered(sample: DataFrame, shape: tuple[int, int], gsig: float | None) -> DataFrame:
    """Every frame high-passed."""
    kernel = arrays.highpass_kernel(gsig) if gsig else None
    return sample if kernel is None else _each_frame(sample, shape, lambda f: arrays.convolve(f, kernel))


def median_template(sample: DataFrame, n: int, shape: tuple[int, int], gsig: float | None) -> np.ndarray:
    """Bin-median of the high-passed frames, exact, tile by tile."""
    median = lambda x: arrays.bin_median(x[:, None, :])[0]
    return by_tile(filtered(sample, shape, gsig), n, shape, median)


def template_of(sample: DataFrame, n: int, shape: tuple[int, int], params: Params, gsig: float | None) -> np.ndarray:
    """Bin-median of the high-passed sample (i, px); with sharpening the sample is aligned to it until that gains little.

    A median does not commute with the filter, so frames are filtered before it. Registration filters a template
    once more, whichever it is given, and so does its sharpness. Frames are aligned and reduced on the executors.
    """
    template = median_template(sample, n, shape, gsig)
    if not params.mc_sharpen_template:
        return template
    kernel = arrays.highpass_kernel(gsig) if gsig else None
    level, moved = sharpness(template, gsig), sample
    for _ in range(10):
        goal = arrays.convolve(template, kernel) if gsig else template

        def align(f: np.ndarray, goal=goal) -> np.ndarray:
            return arrays.translate(f, arrays.phase_shift(goal, arrays.convolve(f, kernel) if gsig else f, params.upsample_factor, params.max_shift))

        moved = _each_frame(moved, shape, align).checkpoint()
        new = median_template(moved, n, shape, gsig)
        gained = sharpness(new, gsig)
        stop = settled(level, gained, SAMPLE_TOL)
        if gained > level:
            template, level = new, gained
        if stop:
            break
    return template


def correct(frames: DataFrame, shape: tuple[int, int], params: Params, template: np.ndarray | None = None, template_window: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(frames moved, shifts (t, dy, dx) summed over the passes, template).

    Each pass registers all frames to a template and is cut off by a checkpoint; passes end early when the
    template gains little sharpness, unless mc_converge_tol is None. A template that is given holds raw frames'
    values (registration filters it); with template_window (t0, t1) it is the mean of those frames.
    """
    _ensure_checkpoints(frames.sparkSession)
    n_t = frames.agg(F.max("t") + 1).collect()[0][0]
    gsig = params.mc_gSig_filt or 2 * params.sigma
    if template_window is not None:
        t0, t1 = template_window
        if template is not None:
            raise ValueError("at most one of template and template_window")
        if not 0 <= t0 < t1 <= n_t:
            raise ValueError(f"template_window {template_window} is not within 0 .. {n_t}")
        mean = frames.where(f"t >= {t0} and t < {t1}").select(F.posexplode("px").alias("p", "v")).groupBy("p").agg(F.avg("v").alias("v")).toPandas()  # one frame
        template = mean.sort_values("p")["v"].to_numpy().reshape(shape)
    if template is None:
        template = template_of(*sampled(frames, n_t, params.mc_template_max_frames), shape, params, gsig)
    elif template.shape != tuple(shape):
        raise ValueError("the template has another shape than the frames")
    moved, total, level = frames.select("t", "px"), None, sharpness(template, gsig)
    for _ in range(max(1, params.mc_n_iter)):
        done = kernels.register(moved, template, gsig=gsig, upsample=params.upsample_factor, max_shift=params.max_shift).checkpoint()
        step = done.select("t", "dy", "dx")
        total = step if total is None else total.unionByName(step).groupBy("t").agg(F.sum("dy").alias("dy"), F.sum("dx").alias("dx"))
        moved = done.select("t", "px")
        new = median_template(*sampled(moved, n_t, params.mc_template_max_frames), shape, gsig)
        gained = sharpness(new, gsig)
        stop = settled(level, gained, params.mc_converge_tol)
        template, level = (new, gained) if gained > level else (template, level)
        if stop:
            break
    return moved, total, template


def correct_folder(spark, folder: str, params: Params, *, template_files: int = 10, ssub: int = 1, tsub: int = 1, crop: tuple[int, int, int, int] | None = None, pattern: str = "*.avi", decoder: str | None = None, spark_only: bool = False) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Files of a folder decoded, cropped, binned and registered in one narrow stage, without a table in between.

    Counts and sizes come from the files' indexes, and the template from evenly spaced frames of at most template_files
    files, of which no other is decoded; a pass decodes each frame once. Passes after the first run on what the one
    before has left, and all mc_n_iter of them run, whatever mc_converge_tol says. With spark_only the files are read by
    Spark alone (`avi.read_folder`), for stores that Python does not open.
    """
    from lumenframe.sources import avi, movie

    small = params.downscaled(ssub, tsub)
    gsig = small.mc_gSig_filt or 2 * small.sigma
    most = min(params.mc_template_max_frames, template_files * 200)
    if spark_only:
        frames = avi.read_folder(spark, folder, pattern, ssub=ssub, tsub=tsub, crop=crop)
        height, width = frames.select("height", "width").limit(1).collect()[0]
        some = sampled(frames, frames.agg(F.max("t") + 1).collect()[0][0], most)
    else:
        path = f"{folder.rstrip('/')}/{pattern}"
        known = movie.facts(path, tsub)
        y0, y1, x0, x1 = crop or (0, known["height"], 0, known["width"])
        height, width = (y1 - y0) // ssub, (x1 - x0) // ssub
        settings = {"box": crop, "ssub": ssub, "tsub": tsub, "decoder": decoder}
        frames = movie.read(spark, path, **settings)
        picked = template_frames(known["by_file"], template_files, most)
        some = movie.read(spark, path, frames=picked, **settings)
        number = spark.createDataFrame([(t, i) for i, t in enumerate(picked)], "of int, i int")
        some = some.join(F.broadcast(number), F.col("t") == F.col("of")).select("i", "px").checkpoint(), len(picked)  # a number for each sampled frame
    template = template_of(*some, (height, width), small, gsig)
    return correct(frames.select("t", "px"), (height, width), replace(small, mc_converge_tol=None), template)


def template_frames(by_file: list[int], files: int, most: int) -> list[int]:
    """Frame numbers, evenly spaced over evenly spaced files: at most so many of each."""
    starts = np.concatenate([[0], np.cumsum(by_file)])
    which = [i for i in evenly(len(by_file), files) if by_file[i]]
    frames = np.concatenate([starts[i] + np.arange(by_file[i]) for i in which]) if which else np.empty(0, int)
    return [int(frames[j]) for j in evenly(len(frames), most)]
