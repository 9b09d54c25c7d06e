"""Tuning of a session's settings: suggestions from samples, a sweep of candidates, suggestions from the best fit."""

from __future__ import annotations

import traceback
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import arrays
from lumenframe.operators import cells, components, evaluate, kernels, movies, seeding, tune
from lumenframe.params import Params
from lumenframe.plans import motion, report, session
from lumenframe.sources import store


@dataclass
class TuningResult:
    """Recommended settings, the value and the evidence of each step, and the sweep's rows, best first."""

    params: Params
    evidence: dict = field(default_factory=dict)
    sweep: pd.DataFrame | None = None
    quality: dict = field(default_factory=dict)


def motion_seeds(frames: DataFrame, shape: tuple[int, int], sample_frames: int = 400) -> tuple[float, tuple[int, int], dict]:
    """(cell radius, max shift, evidence) from a sample: blobs of its deviation, and the shifts that it shows."""
    n_t = frames.agg(F.max("t") + 1).collect()[0][0]
    some, n = motion.sampled(frames, n_t, sample_frames)
    sd = motion.by_tile(some, n, shape, lambda x: x.std(0))
    sharp = sd - arrays.gaussian(sd, 8.0)
    radius = tune.neuron_radius(sharp)
    kernel = arrays.highpass_kernel(radius)
    goal = arrays.convolve(motion.by_tile(some, n, shape, lambda x: np.median(x, axis=0)), kernel)

    def shift(batches):
        for batch in batches:
            found = [arrays.phase_shift(goal, arrays.convolve(np.asarray(v, float).reshape(shape), kernel), 10, (50, 50)) for v in batch["px"]]
            yield pd.DataFrame({"dy": [f[0] for f in found], "dx": [f[1] for f in found]})

    shifts = some.where("i < 200").mapInPandas(shift, "dy double, dx double").toPandas().to_numpy()
    limit = tuple(int(np.ceil(np.percentile(np.abs(shifts[:, i]), 99))) + 2 for i in (0, 1))
    return radius, limit, {"radius": radius, "shifts": shifts}


def tune_motion(frames: DataFrame, shape: tuple[int, int], base: Params = Params(), n_iter: tuple[int, ...] = (1, 2)) -> tuple[Params, list[dict]]:
    """Settings of motion correction whose result has the highest local correlation, coarse to fine."""
    radius, limit, _ = motion_seeds(frames, shape)
    height, width = shape

    def quality(f: DataFrame) -> float:
        long = f.select("t", F.posexplode("px").alias("p", "v")).select("t", F.expr(f"p div {width}").alias("y"), F.expr(f"p % {width}").alias("x"), "v")
        return kernels.registration_quality(long, height, width).collect()[0]["corr_mean"]

    def score(g, s, n):
        moved, shifts, _ = motion.correct(frames, shape, replace(base, mc_gSig_filt=g, max_shift=s, mc_n_iter=n))
        return quality(moved), kernels.shift_quality(shifts).collect()[0]["p99"]

    wide = tuple(2 * x for x in limit)
    best, rows = tune.search_motion(score, quality(frames), sorted({max(1.0, radius - 1), radius, radius + 1}), [limit, wide], list(n_iter))
    return replace(base, mc_gSig_filt=best["gsig"], max_shift=best["max_shift"], mc_n_iter=best["n_iter"]), rows


def score_of(model: session.Model, image: DataFrame | None) -> tuple[float, dict]:
    """Composite score of a fitted model, and its quality row."""
    if not model.count:
        return float("-inf"), {"K": 0}
    from pyspark.sql import SparkSession

    t = model.tables(SparkSession.active())
    q = evaluate.model_quality(t["footprints"], t["traces"], model.metrics, image, *model.shape, model.params.sigma)
    q = q.withColumns({"n": F.col("K"), "corr": F.col("cprojcorr_median"), "spatial": F.col("spatialcorr_median"), "accepted": F.col("accepted_frac"), "iqr_share": F.col("npix_iqr") / F.col("npix_median"), "multipeak": F.col("multipeak_frac")})
    row = evaluate.composite_score(q).collect()[0].asDict()
    return row["score"], row


def run_tuning(frames: DataFrame, shape: tuple[int, int], base: Params, *, spec: tune.SweepSpec | None = None, budget: int = 24, at_once: int = 2) -> TuningResult:
    """The whole search on a registered movie of frames (t, px); candidates that fail become rows.

    Each candidate is a distributed fit; at_once of them run side by side, each in its scheduler pool.
    """
    spark, evidence = frames.sparkSession, {}
    radius, _, seen = motion_seeds(frames, shape)
    evidence["motion"] = seen
    long = frames.select("t", F.posexplode("px").alias("p", "v")).select("t", F.expr(f"cast(p div {shape[1]} as int)").alias("y"), F.expr(f"cast(p % {shape[1]} as int)").alias("x"), "v")
    summary = kernels.corr_pnr(long, radius).toPandas()
    cn, pnr = np.zeros(shape), np.zeros(shape)
    cn[summary["y"], summary["x"]], pnr[summary["y"], summary["x"]] = summary["cn"], summary["pnr"]
    product = np.maximum(cn, 0) * pnr
    sigma = tune.neuron_radius(product, max(1.0, radius / 2), radius * 2)
    low_corr, edge_corr = tune.celllike_threshold(cn, sigma, 0.4, tune.SAFE_CORR)
    low_pnr, edge_pnr = tune.celllike_threshold(pnr, sigma, 2.0, tune.SAFE_PNR)
    split = spark.createDataFrame(tune.cells_and_background(summary, sigma, shape))
    values = lambda c: split.select(F.col(c).alias("v"), "is_cell")
    grid = lambda a, lo: [float(x) for x in np.linspace(lo, max(a.max(), lo + 1e-6), 60)]
    best = lambda c, a, lo: tune.youden(values(c), grid(a, lo)).collect()[0]["thr"]
    at = lambda c, lo, safe: tune.threshold_at_percentile(values(c).where("is_cell"), 25.0, lo, safe).collect()[0]["thr"]
    seeds = [
        {"min_corr": low_corr, "min_pnr": low_pnr, "thr_method": "celllike"},
        {"min_corr": best("cn", cn, 0.4), "min_pnr": best("pnr", pnr, 2.0), "thr_method": "separation"},
        {"min_corr": at("cn", 0.4, tune.SAFE_CORR), "min_pnr": at("pnr", 2.0, tune.SAFE_PNR), "thr_method": "percentile"},
    ]
    evidence["seeds"] = {"sigma": sigma, "edge": (edge_corr, edge_pnr), "thresholds": seeds, "blobs": seeding.product_blobs(cn, pnr, sigma)}
    some, _ = motion.sampled(frames, frames.agg(F.max("t") + 1).collect()[0][0], base.sample_frames)
    tiles = movies.with_coordinates(movies.transposed(some.withColumnRenamed("i", "t")), shape[1])
    size = max(32, int(12 * sigma))
    cells_ = seeding.greedy_tiles(tiles, *shape, sigma, size=size, overlap=base.init_patch_overlap, min_corr=low_corr, min_pnr=low_pnr, most=200, seed_mode="threshold").select("ps", "as").toPandas()
    pixels, evidence["min_pixel"] = tune.min_pixel([np.asarray(a, float) for a in cells_["as"]])
    base = replace(base, sigma=sigma)
    spec = spec or tune.SweepSpec(sigma=tune.offset_grid(None, sigma, 2.0, (-1, 0, 1), whole=True))
    tries = tune.candidates(base, spec, budget, None if base.seed_method == "mixture" else seeds)
    image = spark.createDataFrame(pd.DataFrame({"p": np.arange(cn.size), "cn": cn.ravel()}), "p int, cn double")

    def attempt(i: int) -> tuple[dict, session.Model | None]:
        p, name = tries[i]
        row = {"idx": i, "score": float("-inf"), "error": None, "thr_method": name, "sigma": p.sigma, "min_corr": p.min_corr, "min_pnr": p.min_pnr, "K": 0}
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"candidate-{i}")
        try:
            model = session.fit(frames, shape, p)
            score, quality = score_of(model, image)
            return row | {"score": score, "K": quality["K"]}, model
        except Exception as e:
            return row | {"error": "".join(traceback.format_exception_only(e)).strip()}, None
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, at_once)) as pool:  # each candidate in a pool of its own, so that none waits for another's stages
        done = list(pool.map(attempt, range(len(tries))))
    rows, fits = [r for r, _ in done], {i: m for i, (_, m) in enumerate(done) if m is not None}
    table = pd.DataFrame(rows).sort_values(["score", "idx"], ascending=[False, True]).reset_index(drop=True)
    top = int(table["idx"].iloc[0])
    chosen, quality = tries[top][0], {}
    if top in fits and fits[top].count:
        model = fits[top]
        t = model.tables(spark)
        score, quality = score_of(model, image)
        merge = tune.merge_threshold(t["traces"], "c").collect()[0]["thr"]
        snr = tune.snr_gap(model.metrics, current=base.auto_eval_snr_amp_thr).collect()[0]["thr"]
        chosen = replace(chosen, merge_thr_corr=merge, auto_eval_snr_amp_thr=float(snr), min_pixel=pixels)
        if base.frame_rate_hz:
            g = components.yule_walker(t["traces"], "c")
            tau = tune.decay_time(g, base.frame_rate_hz).collect()[0]["tau"]
            weight = tune.prior_weight(g, base.frame_rate_hz, base.decay_time_ms or tau).collect()[0]["weight"]
            chosen = replace(chosen, decay_time_ms=base.decay_time_ms or tau, g_prior_weight=weight)
    return TuningResult(chosen, evidence, table, quality)


def lower_thresholds(params: Params) -> list[tuple[str, float, float]]:
    """(label, min_corr, min_pnr): the parameters' own thresholds, and a set that finds more cells."""
    return [("recommended", params.min_corr, params.min_pnr), ("lowthr", max(0.6, round(params.min_corr - 0.1, 2)), max(3.0, params.min_pnr - 4))]


def coverage(model: session.Model, cn: np.ndarray, pnr: np.ndarray, radius_factor: float = 1.5) -> tuple[dict, pd.DataFrame, pd.DataFrame]:
    """(recall and precision with their counts, blobs and peaks with whether each has a partner).

    Blobs are those of the two images over the model's thresholds, peaks those of the accepted footprints; partners
    lie within radius_factor * sigma.
    """
    from pyspark.sql import SparkSession

    spark, p = SparkSession.active(), model.params
    radius = radius_factor * p.sigma
    at = seeding.product_blobs(cn, pnr, p.sigma, min_corr=p.min_corr, min_pnr=p.min_pnr)
    blobs = pd.DataFrame({"k": np.arange(len(at)), "cy": at[:, 0].astype(float), "cx": at[:, 1].astype(float)})
    kept = np.flatnonzero(model.accepted) if model.accepted is not None else np.arange(model.count)
    own = model.footprints[model.footprints["k"].isin(kept)]
    peaks = evaluate.smoothed_peaks(spark.createDataFrame(own, "k int, p int, a double"), *model.shape).toPandas() if len(own) else pd.DataFrame({"k": [], "y": [], "x": []})
    peaks = pd.DataFrame({"k": peaks["k"].astype(int), "cy": peaks["y"].astype(float), "cx": peaks["x"].astype(float)})
    pairs = pd.DataFrame({"i": [], "j": []})
    if len(blobs) and len(peaks):
        frame = lambda d: spark.createDataFrame(d, "k int, cy double, cx double")
        pairs = cells.radius_join(frame(blobs), frame(peaks), radius).select("i", "j").toPandas()
    blobs["matched"], peaks["matched"] = blobs["k"].isin(pairs["i"]), peaks["k"].isin(pairs["j"])
    share = lambda d: float(d["matched"].mean()) if len(d) else float("nan")
    found = {"n_blobs": len(blobs), "n_blobs_covered": int(blobs["matched"].sum()), "blob_recall": share(blobs), "n_footprints": len(peaks), "n_footprints_on_blob": int(peaks["matched"].sum()), "footprint_precision": share(peaks), "coverage_radius": radius}
    return found, blobs, peaks


def validate(frames: DataFrame, shape: tuple[int, int], params: Params, thresholds: list[tuple[str, float, float]] | None = None, out: str | None = None) -> pd.DataFrame:
    """A fit for each (label, min_corr, min_pnr) over one shared movie, with its coverage, score and verdict.

    out: a folder in which each model is saved as run_<label>, beside the shared images and the summary.
    """
    spark = frames.sparkSession
    frames = frames.select("t", "px").persist()
    grid = movies.with_coordinates(movies.transposed(frames), shape[1])
    summary = kernels.corr_pnr(grid, params.sigma, surround=params.center_psf).toPandas()  # two images
    cn, pnr = np.zeros(shape), np.zeros(shape)
    cn[summary["y"], summary["x"]], pnr[summary["y"], summary["x"]] = summary["cn"], summary["pnr"]
    image = spark.createDataFrame(pd.DataFrame({"p": np.arange(cn.size), "cn": cn.ravel()}), "p int, cn double")
    rows = []
    for label, low, least in thresholds or lower_thresholds(params):
        model = session.fit(frames, shape, replace(params, min_corr=float(low), min_pnr=float(least)))
        score, q = score_of(model, image)
        met, blobs, peaks = coverage(model, cn, pnr)
        value = lambda x: float(x) if x is not None else float("nan")
        checks = spark.createDataFrame([(met["blob_recall"], met["footprint_precision"], value(q.get("cprojcorr_median")), value(q.get("trace_corr_median")))], "recall double, precision double, cproj double, trace_corr double")
        told = evaluate.verdict(checks).collect()[0]
        rows.append({"label": label, "min_corr": low, "min_pnr": least, "K": model.count, "score": score, **met, "verdict": told["verdict"], "missed": told["missed"]})
        if out is not None:
            model.save(spark, f"{out}/run_{label}")
            marked = {n: spark.createDataFrame(d, "k int, cy double, cx double, matched boolean") for n, d in (("blobs", blobs), ("peaks", peaks))}
            store.save_tables(spark, f"{out}/run_{label}/coverage", marked)
    frames.unpersist()
    table = pd.DataFrame(rows)
    if out is not None:
        store.save_tables(spark, f"{out}/summary", {"runs": spark.createDataFrame(table), "images": spark.createDataFrame(summary)}, params)
    return table


def tune_then_validate(frames: DataFrame, shape: tuple[int, int], base: Params, out: str | None = None, *, spec: tune.SweepSpec | None = None, budget: int = 24, lowthr: bool = True) -> tuple[TuningResult, pd.DataFrame]:
    """The search, then fits of the whole recording with what it recommends (and with lower thresholds); a report in out."""
    result = run_tuning(frames, shape, base, spec=spec, budget=budget)
    rows = validate(frames, shape, result.params, lower_thresholds(result.params)[: 2 if lowthr else 1], out)
    if out is not None:
        report.write(out, "tuning", {"sweep": result.sweep, "validation": rows}, result.params, spark=frames.sparkSession)
    return result, rows


def quick_motion(frames: DataFrame, shape: tuple[int, int], params: Params, n_frames: int = 400) -> tuple[DataFrame, DataFrame]:
    """(moved frames, shifts) of evenly spaced frames only, in one pass: a preview of a long recording."""
    n_t = frames.agg(F.max("t") + 1).collect()[0][0]
    some = frames.where(F.col("t").isin(movies.spaced(n_t, n_frames)))
    numbered = some.join(F.broadcast(frames.sparkSession.createDataFrame([(int(t), i) for i, t in enumerate(movies.spaced(n_t, n_frames))], "t int, nth int")), "t").select(F.col("nth").alias("t"), "px")
    moved, shifts, _ = motion.correct(numbered, shape, replace(params, mc_n_iter=1))
    return moved, shifts


def run_batch(names: list[str], one: Callable[[str], object], at_once: int = 2) -> pd.DataFrame:
    """(name, ok, result or error) of sessions run side by side; a session that fails stops no other."""

    def attempt(name: str) -> dict:
        try:
            return {"name": name, "ok": True, "result": one(name)}
        except Exception as e:
            return {"name": name, "ok": False, "result": f"{type(e).__name__}: {e}"}

    with ThreadPoolExecutor(at_once) as pool:
        return pd.DataFrame(list(pool.map(attempt, names)))
