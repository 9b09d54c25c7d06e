"""Queries of operators that SQL does not express: NumPy kernels inside Arrow functions, and whole programs."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.functions import sql
from lumenframe.operators import background, cells, components, evaluate, images, kernels, movies, seeding, tune
from lumenframe.params import Params
from lumenframe.plans import motion, session, sessions
from lumenframe.sources.views import CELL_FIELD, cell_frames, emb_movie, evt_movie, evt_traces, li_footprints, part_cells

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _pixels(movie: DataFrame, width: int) -> DataFrame:
    return movies.pixels_of(movie).select(F.expr(f"cast(y * {width} + x as int)").alias("p"), "y", "x", "tr")


def _frames(movie: DataFrame) -> DataFrame:
    return movies.frames_of(movie)


def _stack(movie: DataFrame) -> np.ndarray:
    """A small movie as an array (t, y, x)."""
    rows = movie.toPandas()
    out = np.zeros(tuple(int(rows[c].max()) + 1 for c in ("t", "y", "x")))
    out[rows["t"], rows["y"], rows["x"]] = rows["v"]
    return out


def _template(frames: DataFrame, shape) -> np.ndarray:
    row = frames.select(F.posexplode("px").alias("p", "v")).groupBy("p").agg(F.avg("v").alias("v")).toPandas().sort_values("p")
    return row["v"].to_numpy().reshape(shape)


@query
def n5_corr_pnr(spark, sf):
    return kernels.corr_pnr(evt_movie(spark, sf), 1.0)


@query
def m2_high_pass(spark, sf):
    from lumenframe.functions import arrays

    return kernels.filter_frames(_frames(evt_movie(spark, sf)), 12, arrays.highpass_kernel(1.0))


@query
def m9_register_frames(spark, sf):
    frames = _frames(evt_movie(spark, sf))
    return kernels.register(frames, _template(frames, (12, 12)), gsig=1.0, max_shift=(3, 3)).select("t", "dy", "dx")


@query
def m16_motion_correction(spark, sf):
    params = Params(max_shift=(3, 3), mc_n_iter=2, mc_gSig_filt=1.0, sigma=1.0)
    return motion.correct(_frames(evt_movie(spark, sf)), (12, 12), params)[1]


@query
def m25_shift_quality(spark, sf):
    frames = _frames(evt_movie(spark, sf))
    return kernels.shift_quality(kernels.register(frames, _template(frames, (12, 12)), gsig=1.0, max_shift=(3, 3)))


@query
def h2_max_shift(spark, sf):
    frames = _frames(evt_movie(spark, sf))
    return tune.max_shift(kernels.register(frames, _template(frames, (12, 12)), gsig=1.0, max_shift=(3, 3)))


@query
def i8_greedy_tiles(spark, sf):
    pixels = movies.with_coordinates(movies.transposed(cell_frames(spark, sf)), CELL_FIELD)
    return seeding.greedy_tiles(pixels, CELL_FIELD, CELL_FIELD, 2.0, size=24, overlap=8, min_corr=0.5, min_pnr=5.0, seed_mode="threshold")


@query
def b2_ring_regression(spark, sf):
    movie = emb_movie(spark, sf)
    mean = F.avg("v").over(Window.partitionBy("y", "x"))
    return background.ring_regression(_pixels(movie.withColumn("v", F.col("v") - mean), 8).select("p", "tr"), 8, 8, 2.5, tile=4)


@query
def b16_global_background(spark, sf):
    movie = emb_movie(spark, sf)
    mean = F.avg("v").over(Window.partitionBy("y", "x"))
    return background.global_background(_pixels(movie.withColumn("v", F.col("v") - mean), 8).select("p", "tr"), 2)[0]


@query
def b15_joint_background(spark, sf):
    """Ring weights and a global background of rank 2, fitted by turns; the courses come with what is left after each turn."""
    movie = emb_movie(spark, sf)
    mean = F.avg("v").over(Window.partitionBy("y", "x"))
    residual = _pixels(movie.withColumn("v", F.col("v") - mean), 8).select("p", "tr").checkpoint()
    _, courses, energies = background.joint_background(residual, 8, 8, 2.5, 2, tile=4)
    rows = pd.DataFrame({"r": range(len(courses)), "f": courses.tolist()})  # rank x T, what the model holds
    return spark.createDataFrame(rows, "r int, f array<double>").select("r", F.array(*[F.lit(e) for e in energies]).alias("energies"), F.posexplode("f").alias("t", "v"))


@query
def e17_recording_stats(spark, sf):
    return images.recording_stats(evt_movie(spark, sf), 1.0, min_corr=0.1, min_pnr=1.0, distance=2)


@query
def a2_spatial_update(spark, sf):
    pixels = _pixels(evt_movie(spark, sf), 12)
    n_t = pixels.agg(F.max(F.size("tr"))).collect()[0][0]
    c = np.stack([np.maximum(np.sin(np.arange(n_t) / (5.0 + k)), 0) for k in range(4)])
    support = pixels.select("p", F.array(*[F.lit(i).cast("long") for i in range(4)]).alias("ks"))
    return components.spatial_update(pixels, c, list(range(4)), support, kernels.noise_of(pixels).select("p", "sn"))


@query
def a7_trim_footprints(spark, sf):
    return components.trimmed(li_footprints(spark, sf), 32, 32, method="nrg", energy=0.5)


@query
def t3_deconvolve(spark, sf):
    d = components.deconvolved(evt_traces(spark, sf), g=0.8)
    return d.select("k", "g", "sn", "bl", F.posexplode("c").alias("t", "c"), "s").select("k", "t", "g", "sn", "bl", "c", F.expr("s[t]").alias("s"))


@query
def t3_deconvolve_order2(spark, sf):
    """Traces that rise and decay: roots 0.8 and 0.3."""
    d = components.deconvolved(evt_traces(spark, sf), g=(1.1, -0.24))
    return d.select("k", "g", "g2", "sn", "bl", "penalty", F.posexplode("c").alias("t", "c"), "s").select("k", "t", "g", "g2", "sn", "bl", "penalty", "c", F.expr("s[t]").alias("s"))


@query
def t7_deconvolve_failures(spark, sf):
    """Every seventh trace holds a value that is not finite: it comes out as its clipped self, with the reason."""
    broken = evt_traces(spark, sf).withColumn("v", F.when((F.col("k") % 7 == 0) & (F.col("t") == 3), float("nan")).otherwise(F.col("v")))
    d = components.failures_within(components.deconvolved(broken, g=0.8), 0.25)
    return d.select("k", "error", "bl", F.aggregate("c", F.lit(0.0), lambda a, b: a + b).alias("total"), F.aggregate("s", F.lit(0.0), lambda a, b: a + b).alias("spikes"))


@query
def t3_deconvolve_udf(spark, sf):
    traces = evt_traces(spark, sf).groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda s: s["v"]).alias("tr"))
    return traces.select("k", sql.deconvolve("tr", F.lit(0.8), F.lit(10.0)).alias("d")).select("k", "d.bl", F.aggregate("d.c", F.lit(0.0), lambda a, b: a + b).alias("total"))


@query
def e2_r_values(spark, sf):
    f = li_footprints(spark, sf).groupBy((F.col("k") % 10).alias("k"), (F.col("p") % 144).cast("int").alias("p")).agg(F.sum("a").alias("a"))
    movie = evt_movie(spark, sf).select("t", F.expr("cast(y * 12 + x as int)").alias("p"), "v")
    traces = movie.groupBy((F.col("p") % 10).cast("long").alias("k"), "t").agg(F.sum("v").alias("c"))
    return evaluate.r_values(f, traces, movie, 12, 12, pad=2)


@query
def e6_morphology(spark, sf):
    return evaluate.morphology(components.peak_threshold(li_footprints(spark, sf), 0.3), 32)


@query
def e9_multipeak_share(spark, sf):
    return evaluate.multipeak_share(li_footprints(spark, sf), 32, 3)


@query
def u1_upsample_footprints(spark, sf):
    return kernels.upsample_footprints(li_footprints(spark, sf), (32, 32), (64, 64))


@query
def g18_hungarian_match(spark, sf):
    return cells.match_places(part_cells(spark, sf), 4.0, F.exp(-F.col("dist") / 8), 4.0, dist_thr=4.0, corr_thr=0.5)


@query
def g12_spatial_model(spark, sf):
    """Pairs of one user's trace and its three-day mean, and pairs of different users' traces."""
    t = evt_traces(spark, sf)
    mean = F.avg("v").over(Window.partitionBy("k").orderBy("t").rowsBetween(-1, 1))
    same = evaluate.correlation_by(t.withColumn("w", mean), "v", "w").select("r")
    one = same.select(F.least(F.floor((F.least(F.greatest("r", F.lit(-1.0)), F.lit(1.0)) + 1) * (components.INTERVALS / 2)), F.lit(components.INTERVALS - 1)).alias("bin"), F.col("r").alias("v"), F.lit(1).cast("long").alias("n"))
    # the driver gets the mean and number of each interval, never pairs
    part = one.unionByName(components.correlation_counts(t)).groupBy("bin").agg((F.sum("v") / F.sum("n")).alias("v"), F.sum("n").alias("n")).toPandas().sort_values("bin")
    model = cells.fit_spatial_model(part["v"].to_numpy(float), weights=part["n"].to_numpy(float))
    if model is None:
        return spark.createDataFrame([], "x double, p double")
    return model.lookup(spark)


@query
def g13_centroid_model(spark, sf):
    d = cells.distance_counts(part_cells(spark, sf), 12.0)
    model = cells.fit_centroid_model(d["dist"].to_numpy(float), 12.0, weights=d["n"].to_numpy(float))
    return model.lookup(spark) if model else spark.createDataFrame([], "x double, p double")


@query
def g17_mixture_posterior(spark, sf):
    from lumenframe.functions import solvers

    c = part_cells(spark, sf)
    d = cells.distance_counts(c, 12.0)  # what the mixture is fitted to; its posterior is a line between them
    at = d["dist"].to_numpy(float)
    shared = spark.sparkContext.broadcast((at, solvers.mixture_posterior(-at[:, None], weights=d["n"].to_numpy(float)) if len(at) else at))

    @F.pandas_udf("double")
    def p(dist: pd.Series) -> pd.Series:
        return pd.Series(np.interp(dist, *shared.value))

    return cells.session_pairs(c, 12.0, lambda met: met.withColumn("p", p("dist")))


@query
def g2_register_sessions(spark, sf):
    """Three sessions whose cells are the suppliers' compact footprints, moved by a pixel or two."""
    f = components.peak_threshold(li_footprints(spark, sf), 0.9)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(d).alias("d")) for s, d in ((0, 0), (1, 33), (2, 66))])).alias("m")
    moved = f.select("k", "p", "a", each).select(F.col("m.s").alias("session"), "k", (F.col("p") + F.col("m.d")).cast("int").alias("p"), "a").where("p < 1024")
    found = sessions.register(moved, (32, 32), max_distance=4.0)
    return spark.createDataFrame(found.cell_map.astype({"g": "int64"}))


@query
def t13_fit_extract(spark, sf):
    """The whole factorisation of a small recording."""
    params = Params(sigma=2.0, min_corr=0.5, min_pnr=5.0, border_px=1, seed_method="threshold", n_iter_main=1)
    model = session.fit(cell_frames(spark, sf), (CELL_FIELD, CELL_FIELD), params)
    return model.tables(spark)["footprints"]


@query
def w1_sweep(spark, sf):
    """Candidates fitted in parallel to a small recording, each in a task; the score is the share of the signal explained."""
    frames = cell_frames(spark, sf).toPandas().sort_values("t")
    movie = spark.sparkContext.broadcast(np.stack(frames["px"].to_list()).reshape(-1, CELL_FIELD, CELL_FIELD))
    tries = [p for p, _ in tune.candidates(Params(), tune.SweepSpec(sigma=[2.0, 3.0], min_corr=[0.5, 0.8]))]

    def score(p: Params) -> float:
        m = movie.value
        a, c, _ = seeding.greedy(m, p.sigma, min_corr=p.min_corr, min_pnr=5.0, seed_mode="threshold")
        rest = m - np.einsum("kyx,kt->tyx", a, c) if len(a) else m
        return 1 - float((rest**2).sum() / (m**2).sum())

    return tune.run_sweep(spark, tries, score)


@query
def w8_motion_search(spark, sf):
    """Filter widths, limits and passes of registration tried on the hourly movie, scored by local correlation."""
    frames, base = _frames(evt_movie(spark, sf)).persist(), Params(mc_sharpen_template=False, sigma=1.0)

    def quality(f: DataFrame) -> float:
        long = f.select("t", F.posexplode("px").alias("p", "v")).select("t", F.expr("p div 12").alias("y"), F.expr("p % 12").alias("x"), "v")
        return kernels.registration_quality(long, 12, 12).collect()[0]["corr_mean"]

    def score(gsig, limit, n_iter):
        moved, shifts, _ = motion.correct(frames, (12, 12), replace(base, mc_gSig_filt=gsig, max_shift=limit, mc_n_iter=n_iter))
        return quality(moved), kernels.shift_quality(shifts).collect()[0]["p99"]

    best, rows = tune.search_motion(score, quality(frames), [1.0, 2.0], [(2, 2), (3, 3)], [1])
    return spark.createDataFrame(pd.DataFrame([{**r, "max_shift": str(r["max_shift"]), "error": r["error"] or "", "best": r is best} for r in rows]))


@query
def h6_cells_and_background(spark, sf):
    image = kernels.corr_pnr(evt_movie(spark, sf), 1.0).toPandas()
    return spark.createDataFrame(tune.cells_and_background(image, 1.0, (12, 12)))


@query
def p13_smoothed_peaks(spark, sf):
    return evaluate.smoothed_peaks(li_footprints(spark, sf), 32, 32)


@query
def e12_model_quality(spark, sf):
    f = li_footprints(spark, sf)
    traces = evt_traces(spark, sf).select("k", "t", F.col("v").alias("c"), (F.col("v") * 0.1 - F.col("t")).alias("yra"))
    noise = spark.range(1024).select(F.col("id").cast("int").alias("p"), F.lit(2.0).alias("sn"))
    image = spark.range(1024).select(F.col("id").cast("int").alias("p"), F.sin("id").alias("cn"))
    return evaluate.model_quality(f, traces, evaluate.component_snr(f, noise, 100, 100.0), image, 32, 32, 2.0)


@query
def m26_registration_quality(spark, sf):
    return kernels.registration_quality(emb_movie(spark, sf), 8, 8)
