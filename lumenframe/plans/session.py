"""A session from movie to evaluated components.

Pixels stay distributed as rows (p, tr); what the driver holds is what the factorisation itself keeps: the
traces (K x T), their products, and coordinate lists of footprints. Lineage is cut by checkpoints.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lumenframe.functions import arrays, solvers
from lumenframe.operators import background, components, evaluate, kernels, movies, seeding
from lumenframe.params import Params, mask_box, mask_of, resolve_crop
from lumenframe.plans import motion
from lumenframe.sources import store


@dataclass
class Model:
    """Results: footprints (k, p, a) of unit norm, traces K x T, ring weights, baseline, metrics."""

    params: Params
    shape: tuple[int, int]
    footprints: pd.DataFrame
    traces: np.ndarray
    spikes: np.ndarray
    rest: np.ndarray
    g: np.ndarray
    noise: np.ndarray
    norms: np.ndarray
    ring: DataFrame | None = None
    baseline: DataFrame | None = None
    metrics: DataFrame | None = None
    seconds: dict = field(default_factory=dict)
    #: noise of each pixel; whether evaluation keeps each component; shifts (t, dy, dx) of motion correction
    pixel_noise: np.ndarray | None = None
    accepted: np.ndarray | None = None
    shifts: DataFrame | None = None
    #: where the crop lies: orig_dims, orig_T, bbox, t_range, masked; None without one
    crop: dict | None = None
    #: traces of the seeds as they were found; time courses (rank, T) and loads (r, p, v) of the global background
    raw: np.ndarray | None = None
    courses: np.ndarray | None = None
    loads: DataFrame | None = None
    #: what the solvers did: sweeps and unsettled pixels of spatial updates, rounds, penalties and failures of temporal ones
    solver: dict = field(default_factory=dict)

    @property
    def count(self) -> int:
        return len(self.traces)

    def tables(self, spark) -> dict[str, DataFrame | None]:
        k, t = self.traces.shape
        slow = None if self.spikes.shape == self.traces.shape else self.spikes  # spikes of an upsampled model keep their rate
        rows = pd.DataFrame({"k": np.repeat(np.arange(k), t), "t": np.tile(np.arange(t), k), "c": self.traces.ravel(), "s": self.spikes.ravel() if slow is None else 0.0, "yra": self.rest.ravel()})
        g = np.asarray(self.g, float).reshape(k, -1) if k else np.zeros((0, 1))
        parts = pd.DataFrame({"k": np.arange(k), "g": g[:, 0], "g2": g[:, 1] if g.shape[1] > 1 else [None] * k, "sn_k": self.noise, "a_norm": self.norms, "accepted": [None] * k if self.accepted is None else self.accepted.tolist()})
        noise = None if self.pixel_noise is None else spark.createDataFrame(pd.DataFrame({"p": np.arange(self.pixel_noise.size), "sn": self.pixel_noise.ravel()}), "p int, sn double")
        return {
            "footprints": spark.createDataFrame(self.footprints, "k int, p int, a double"),
            "traces": spark.createDataFrame(rows, "k int, t int, c double, s double, yra double"),
            "components": spark.createDataFrame(parts, "k int, g double, g2 double, sn_k double, a_norm double, accepted boolean"),
            "ring": self.ring,
            "baseline": self.baseline,
            "metrics": self.metrics,
            "noise": noise,
            "shifts": self.shifts,
            "spikes": _table_of(spark, slow, "k"),
            "raw": _table_of(spark, self.raw, "k"),
            "courses": _table_of(spark, self.courses, "r"),
            "loads": self.loads,
        }

    def save(self, spark, path: str) -> None:
        """All tables that the model has, with its parameters, shape, length and crop; `load` gives it back."""
        store.save_tables(spark, path, self.tables(spark), self.params, dims=list(self.shape), K=self.count, T=int(self.traces.shape[1]), crop=self.crop, solver=self.solver)

    @classmethod
    def load(cls, spark, path: str) -> Model:
        """A model that `save` has written; what it did not have stays None."""
        tables, params, facts = store.load_tables(spark, path)
        k, n_t = facts["K"], facts["T"]
        rows = tables["traces"].toPandas()  # what the model holds in memory anyway
        grids = {c: np.zeros((k, n_t)) for c in ("c", "s", "yra")}
        for c, grid in grids.items():
            grid[rows["k"], rows["t"]] = rows[c]
        if "spikes" in tables:
            grids["s"] = _array_of(tables["spikes"], "k")
        parts = tables["components"].toPandas().sort_values("k")
        noise = None
        if "noise" in tables:
            noise = np.zeros(facts["dims"][0] * facts["dims"][1])
            own = tables["noise"].toPandas()
            noise[own["p"]] = own["sn"]
            noise = noise.reshape(facts["dims"])
        accepted = parts["accepted"].to_numpy(bool) if len(parts) and parts["accepted"].notna().all() else None
        crop = facts.get("crop")
        crop = crop and {n: tuple(v) if isinstance(v, list) else v for n, v in crop.items()}
        if len(parts) and "g2" in parts and parts["g2"].notna().any():
            parts["g"] = list(parts[["g", "g2"]].to_numpy(float))
        g = np.stack(parts["g"].to_list()).astype(float) if len(parts) else np.zeros(0)
        return cls(params, tuple(facts["dims"]), tables["footprints"].toPandas().sort_values(["k", "p"]).reset_index(drop=True), grids["c"], grids["s"], grids["yra"], g, *(parts[c].to_numpy(float) for c in ("sn_k", "a_norm")),
                   tables.get("ring"), tables.get("baseline"), tables.get("metrics"), pixel_noise=noise, accepted=accepted, shifts=tables.get("shifts"), crop=crop,
                   raw=_array_of(tables.get("raw"), "k"), courses=_array_of(tables.get("courses"), "r"), loads=tables.get("loads"), solver=facts.get("solver") or {})


def _table_of(spark, rows: np.ndarray | None, name: str) -> DataFrame | None:
    """(name, values array) of a matrix that the model holds, or None."""
    if rows is None or not len(rows):
        return None
    return spark.createDataFrame(pd.DataFrame({name: np.arange(len(rows)), "v": np.asarray(rows, float).tolist()}), f"{name} int, v array<double>")


def _array_of(rows: DataFrame | None, name: str) -> np.ndarray | None:
    return None if rows is None else np.stack(rows.toPandas().sort_values(name)["v"].to_list())


def _coo(footprints: pd.DataFrame, k: int, n_pixels: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """pixel -> (components, values)."""
    return {int(p): (g["k"].to_numpy(), g["a"].to_numpy()) for p, g in footprints.groupby("p")}


def _residual(pixels: DataFrame, footprints: pd.DataFrame, traces: np.ndarray, b0: bool = True) -> DataFrame:
    """(p, tr, b0): pixels less components and less their mean."""
    shared = pixels.sparkSession.sparkContext.broadcast((_coo(footprints, len(traces), 0), traces))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, c = shared.value
        for batch in batches:
            rows, means = [], []
            for p, tr in zip(batch["p"], batch["tr"]):
                x = np.asarray(tr, float)
                if p in parts:
                    ks, a = parts[p]
                    x = x - a @ c[ks]
                means.append(x.mean())
                rows.append(x - means[-1])
            yield pd.DataFrame({"p": batch["p"], "tr": rows, "b0": means})

    return pixels.select("p", "tr").mapInPandas(run, "p int, tr array<double>, b0 double")


def _project(pixels: DataFrame, footprints: pd.DataFrame, k: int) -> np.ndarray:
    """A'Y, K x T: partial sums by partition."""
    shared = pixels.sparkSession.sparkContext.broadcast(_coo(footprints, k, 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, sums = shared.value, {}
        for batch in batches:
            for p, tr in zip(batch["p"], batch["tr"]):
                if p in parts:
                    x = np.asarray(tr, float)
                    for c, a in zip(*parts[p]):
                        sums[c] = sums.get(c, 0) + a * x
        if sums:
            yield pd.DataFrame({"k": list(sums), "v": list(sums.values())})

    rows = background.summed(pixels.select("p", "tr").mapInPandas(run, "k int, v array<double>"), "k", "v").toPandas()
    t = len(rows["v"].iloc[0]) if len(rows) else 0
    out = np.zeros((k, t))
    for c, v in zip(rows["k"], rows["v"]):
        out[c] += v
    return out


def _gram(footprints: pd.DataFrame, k: int) -> np.ndarray:
    both = footprints.merge(footprints, on="p")
    out = np.zeros((k, k))
    np.add.at(out, (both["k_x"].to_numpy(), both["k_y"].to_numpy()), (both["a_x"] * both["a_y"]).to_numpy())
    return out


def _less_components(pixels: DataFrame, footprints: pd.DataFrame, traces: np.ndarray) -> DataFrame:
    """(p, tr): pixels less components."""
    shared = pixels.sparkSession.sparkContext.broadcast((_coo(footprints, len(traces), 0), traces))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, c = shared.value
        for batch in batches:
            rows = [np.asarray(tr, float) - parts[p][1] @ c[parts[p][0]] if p in parts else np.asarray(tr, float) for p, tr in zip(batch["p"], batch["tr"])]
            yield pd.DataFrame({"p": batch["p"], "tr": rows})

    return pixels.select("p", "tr").mapInPandas(run, "p int, tr array<double>")


def placed(model: Model, box: tuple[int, int, int, int] | None = None, native: tuple[int, int] | None = None, t0: int = 0, n_t: int | None = None) -> Model:
    """The model of a crop (y0, y1, x0, x1) from frame t0 on, on the full field and timeline; zeros elsewhere.

    Without a box it is the crop that the model was fitted on, if any.
    """
    if box is None:
        if model.crop is None:
            return model
        box, native, t0, n_t = model.crop["bbox"], model.crop["orig_dims"], model.crop["t_range"][0], model.crop["orig_T"]
    y0, _, x0, x1 = box
    p = model.footprints["p"].to_numpy()
    moved = model.footprints.assign(p=(p // (x1 - x0) + y0) * native[1] + p % (x1 - x0) + x0)

    def whole(m: np.ndarray) -> np.ndarray:
        out = np.zeros((len(m), n_t or m.shape[1]))
        out[:, t0 : t0 + m.shape[1]] = m
        return out

    return replace(model, shape=native, footprints=moved, traces=whole(model.traces), spikes=whole(model.spikes), rest=whole(model.rest), ring=None, baseline=None, crop=None)


def _numbered(footprints: pd.DataFrame, kept: list[int]) -> pd.DataFrame:
    number = {k: n for n, k in enumerate(kept)}
    f = footprints[footprints["k"].isin(number)].copy()
    f["k"] = f["k"].map(number).astype(int)
    return f


def _merged(footprints: pd.DataFrame, traces: np.ndarray, shape: tuple[int, int], params: Params) -> tuple[pd.DataFrame, list[list[int]]]:
    """Footprints after merging, and the members of each new component.

    The rule of `components.merge_pairs`, on what the driver holds anyway: pairs with |r| over the threshold,
    and weighted Jaccard or nearness of centroids; connected pairs are one component. Merged footprints are
    trimmed at a tenth of their peak.
    """
    k, width = len(traces), shape[1]
    if k < 2:
        return footprints, [[i] for i in range(k)]
    gram = _gram(footprints, k)
    energy = np.diag(gram)
    jaccard = gram / np.maximum(energy[:, None] + energy[None, :] - gram, 1e-12)
    sums = footprints.assign(y=footprints["p"] // width * footprints["a"], x=footprints["p"] % width * footprints["a"]).groupby("k")[["a", "y", "x"]].sum().reindex(range(k), fill_value=np.nan)
    at = sums[["y", "x"]].to_numpy() / sums[["a"]].to_numpy()
    apart = np.hypot(at[:, None, 0] - at[None, :, 0], at[:, None, 1] - at[None, :, 1])
    z = traces - traces.mean(1, keepdims=True)
    z /= np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-12)
    near = (jaccard > params.merge_thr_overlap) | (apart < params.merge_centre_dist_factor * params.sigma)
    link = (np.abs(z @ z.T) > params.merge_thr_corr) & near
    label = np.arange(k)
    while True:  # smallest label around, then the label of that label
        new = np.minimum(label, np.where(link, label[None, :], k).min(1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    groups = [np.flatnonzero(label == m).tolist() for m in np.unique(label)]
    number = {m: n for n, g in enumerate(groups) for m in g}
    merged = footprints.assign(k=footprints["k"].map(number)).groupby(["k", "p"], as_index=False)["a"].sum()
    parts = []
    for n, part in merged.groupby("k"):
        if len(groups[n]) > 1:
            image = np.zeros(shape)
            image.ravel()[part["p"].to_numpy()] = part["a"]
            flat = arrays.trim_footprint(image, method="max", max_share=0.1).ravel()
            part = pd.DataFrame({"k": n, "p": np.flatnonzero(flat), "a": flat[flat != 0]})
        parts.append(part)
    return pd.concat(parts, ignore_index=True), groups


def fit(movie: DataFrame, shape: tuple[int, int], params: Params = Params(), *, correct_motion: bool = False, evaluate_: bool = True) -> Model:
    """All steps on a movie of frames (t, px) or pixels (p, tr).

    Crops and mask of the parameters come first; the model is one of the crop, `placed` puts it on the whole field.
    """
    movie, shape, crop = cropped(movie, shape, params)
    model = _fit(movie, shape, params, correct_motion=correct_motion, evaluate_=evaluate_)
    return replace(model, crop=crop)


def cropped(movie: DataFrame, shape: tuple[int, int], params: Params) -> tuple[DataFrame, tuple[int, int], dict | None]:
    """(movie, shape, where the crop lies) after the crops and the mask of the parameters, if there are any."""
    if params.temporal_crop is None and params.spatial_crop is None and params.spatial_mask_path is None:
        return movie, tuple(shape), None
    height, width = shape
    n_t = movie.agg(F.max("t") + 1 if "px" in movie.columns else F.max(F.size("tr"))).collect()[0][0]
    mask = mask_of(params, height, width)
    t0, t1, y0, y1, x0, x1 = resolve_crop(params, n_t, height, width, None if mask is None else mask_box(mask))
    movie = movies.crop_arrays(movie, shape, (t0, t1), (y0, y1, x0, x1), None if mask is None else mask[y0:y1, x0:x1])
    where = {"orig_dims": (height, width), "orig_T": n_t, "bbox": (y0, y1, x0, x1), "t_range": (t0, t1), "masked": mask is not None}
    return movie, (y1 - y0, x1 - x0), where


def _fit(movie: DataFrame, shape: tuple[int, int], params: Params, *, correct_motion: bool, evaluate_: bool) -> Model:
    if params.ar_order not in (1, 2):
        raise ValueError(f"traces follow one coefficient or two: ar_order is 1 or 2, not {params.ar_order}")
    spark, (height, width) = movie.sparkSession, shape
    components._ensure_checkpoints(spark)
    clock, marks = time.time(), {}

    def mark(name):
        nonlocal clock
        marks[name], clock = time.time() - clock, time.time()

    shifts = None
    if "px" in movie.columns:
        if correct_motion:
            movie, shifts, _ = motion.correct(movie, shape, params)
            mark("motion")
        movie = movies.transposed(movie)
    pixels = movie.select(F.col("p").cast("int").alias("p"), "tr").checkpoint()
    noise = kernels.noise_of(pixels).select("p", "sn").checkpoint()
    sn = np.zeros(height * width)
    known = noise.toPandas()
    sn[known["p"]] = known["sn"]
    mark("noise")

    grid = movies.with_coordinates(pixels, width)
    size = params.init_patch_size or (max(32, int(12 * params.sigma)) if params.init_patches and max(shape) >= params.init_patch_min_fov else max(shape))
    found = seeding.greedy_tiles(grid, height, width, params.sigma, size=size, overlap=params.init_patch_overlap, min_corr=params.min_corr, min_pnr=params.min_pnr, most=params.max_neurons, min_pixel=params.min_pixel, seed_mode=params.seed_method,
                                 neuron=params.init_min_corr_neuron, back=params.init_max_corr_bg, circle=params.circular_max_dist_factor, stride=params.init_corrpnr_stride or 1, surround=params.center_psf).toPandas()
    b = params.border_px
    found = found[(found.cy >= b) & (found.cy < height - b) & (found.cx >= b) & (found.cx < width - b)].sort_values(["tile", "k"]).reset_index(drop=True)
    mark("seeds")
    n_t = pixels.select(F.size("tr")).limit(1).collect()[0][0]
    if found.empty:
        none = np.zeros((0, n_t))
        return Model(params, shape, pd.DataFrame({"k": [], "p": [], "a": []}).astype({"k": int, "p": int, "a": float}), none, none, none, np.zeros(0), np.zeros(0), np.zeros(0), seconds=marks, pixel_noise=sn.reshape(shape), shifts=shifts)
    f = pd.DataFrame({"k": np.repeat(found.index, found["ps"].map(len)), "p": np.concatenate(found["ps"].to_list()), "a": np.concatenate(found["as"].to_list())})
    c = np.stack(found["c"].to_list()).astype(float)
    if size < max(shape):  # tiles overlap: components that two of them found become one
        f, groups = _merged(f, c, shape, params)
        c = np.stack([np.maximum(c[g].mean(0), 0) for g in groups])
    if params.max_neurons and len(c) > params.max_neurons:
        energy = (c**2).sum(1) * f.groupby("k")["a"].apply(lambda a: (a**2).sum()).reindex(range(len(c)), fill_value=0).to_numpy()
        kept = sorted(np.argsort(-energy, kind="stable")[: params.max_neurons].tolist())
        f, c = _numbered(f, kept), c[kept]
    mark("tiles")

    prior = solvers.decay_to_g(params.decay_time_ms, params.frame_rate_hz) if params.decay_time_ms and params.frame_rate_hz else None
    settings = {} if params.ar_order == 2 else {"fudge": params.fudge_factor, "detrend": params.ar_detrend_order, "prior": prior, "prior_weight": params.g_prior_weight}
    ar = lambda x: components.own_coefficients(x, params.ar_order, **settings)[0]
    g = np.tile(ar(c.ravel()), (len(c), 1)) if params.global_ar else np.stack([ar(x) for x in c])
    raw, solver = c.copy(), {}

    rest = _residual(pixels, f, c).checkpoint()
    b0 = rest.select("p", "b0")
    stride = max(1, min(params.bg_tsub, n_t // 200))
    courses, ring_settings = None, {"ridge": params.ring_lambda, "sum_to_one": params.ring_constrain_sum}
    if params.global_bg_rank:
        ring, courses, solver["background_energy"] = background.joint_background(rest.select("p", "tr"), height, width, params.ring_radius, params.global_bg_rank, step=stride, **ring_settings)
    else:
        thin = rest.select("p", F.expr(f"filter(tr, (v, i) -> i % {stride} = 0)").alias("tr"))
        ring = background.ring_regression(thin, height, width, params.ring_radius, **ring_settings).checkpoint()
    mark("ring")

    def without_background() -> tuple[DataFrame, np.ndarray | None]:
        """The movie less baseline, ring and global background, the last fitted again to what components leave."""
        centred = pixels.join(b0, "p").select("p", F.expr("transform(tr, v -> v - b0)").alias("tr"))
        out = background.ring_applied(centred, ring, height, width, params.ring_radius).checkpoint()
        if courses is None or not len(courses):
            return out, courses
        again, energy = background.refitted(_less_components(out, f, c), courses)
        solver.setdefault("global_energy", []).append(energy)
        return background.less_global(out, again, _coo(f, len(c), 0), c).checkpoint(), again

    clean, courses = without_background()
    spikes = np.zeros_like(c)
    for i in range(params.n_iter_main):
        k = len(c)
        near = components.support(spark.createDataFrame(f, "k int, p int, a double"), height, width, params.dilation_radius)
        n = max(1, params.spatial_tsub)
        thin = clean if n == 1 else clean.select("p", F.expr(f"filter(tr, (v, i) -> i % {n} = 0)").alias("tr"))
        a = components.spatial_update(thin, c[:, ::n], list(range(k)), near, noise, ridge=params.spatial_ridge, scale=params.spatial_lambda_scale, sweeps=params.spatial_max_iter, tol=params.spatial_tol, observation=(seen := Observation(f"spatial{i}")))
        cap = params.spatial_max_radius_factor * params.sigma or None
        a = components.trimmed(a, height, width, method=params.spatial_thr_method, max_share=params.spatial_max_thr, energy=params.spatial_nrg_thr, closing=params.spatial_close_radius, circle=params.spatial_circular_max_dist_factor, cap=cap).toPandas()
        solver[f"spatial{i}"] = seen.get
        kept = sorted(int(x) for x in a["k"].unique())
        if not kept:
            break
        f, c, g = _numbered(a, kept), c[kept], g[kept]
        mark(f"spatial{i}")
        noise_k = _footprint_noise(f, sn, len(c))
        c, spikes = components.temporal_update(_project(clean, f, len(c)), _gram(f, len(c)), c, g, noise_k, rounds=params.n_iter_temporal, deconvolve=not (i == 0 and params.skip_first_deconv), detrend=params.temporal_detrend_order, spark=spark, report=solver.setdefault(f"temporal{i}", {}))
        mark(f"temporal{i}")
        f, groups = _merged(f, c, shape, params)
        if len(groups) < len(c):
            c, g = np.stack([np.maximum(c[m].mean(0), 0) for m in groups]), np.array([g[m[0]] for m in groups])
        b0 = _residual(pixels, f, c).select("p", "b0").checkpoint()
        clean, courses = without_background()
        mark(f"merge{i}")
    noise_k, gram, projection = _footprint_noise(f, sn, len(c)), _gram(f, len(c)), _project(clean, f, len(c))
    c, spikes = components.temporal_update(projection, gram, c, g, noise_k, rounds=params.n_iter_temporal, detrend=params.temporal_detrend_order, spark=spark, report=solver.setdefault("temporal", {}))
    left = components.residual_traces(projection, gram, c)
    norms = np.sqrt(np.maximum(np.diag(gram), 0))
    scale = np.where(norms > 0, norms, 1)
    f = f.assign(a=f["a"] / scale[f["k"]])
    g = g[:, 0] if params.ar_order == 1 else g
    loads = None
    if courses is not None and len(courses):
        centred = pixels.join(b0, "p").select("p", F.expr("transform(tr, v -> v - b0)").alias("tr"))
        outer = _less_components(background.ring_applied(centred, ring, height, width, params.ring_radius), f.assign(a=f["a"] * norms[f["k"]]), c)
        loads = background.global_loads(outer, courses).checkpoint()
    model = Model(params, shape, f.reset_index(drop=True), c * norms[:, None], spikes * norms[:, None], left * norms[:, None], g, noise_k * norms, norms, ring, b0, seconds=marks, pixel_noise=sn.reshape(shape), shifts=shifts, raw=raw, courses=courses, loads=loads, solver=solver)
    if evaluate_:
        t = model.tables(spark)
        m = evaluate.component_snr(t["footprints"].join(t["components"], "k").select("k", "p", (F.col("a") * F.col("a_norm")).alias("a")), noise, 1, params.auto_eval_snr_amp_thr)
        shape_ = evaluate.morphology(t["footprints"], width)
        values = t["traces"].withColumn("v", F.col("c") + F.col("yra"))
        model.metrics = m.join(shape_, "k", "left").join(evaluate.peak_snr(t["traces"], "c", "yra"), "k", "left").join(evaluate.trace_moments(values), "k", "left").join(evaluate.autocorrelation(values), "k", "left")
        image = kernels.corr_pnr(grid, params.sigma, surround=params.center_psf).select(F.expr(f"cast(y * {width} + x as int)").alias("p"), "cn").checkpoint()
        model.metrics = model.metrics.join(evaluate.spatial_correlation(t["footprints"], image, height, width), "k", "left").join(evaluate.r_values_of_pixels(model.footprints, model.traces, pixels, height, width), "k", "left").checkpoint()
        kept = model.metrics.select("k", "keep").toPandas().set_index("k")["keep"]  # a row for each component
        model.accepted = np.array([bool(kept.get(k, False)) for k in range(model.count)])
    mark("final")
    return model


def _footprint_noise(f: pd.DataFrame, sn: np.ndarray, k: int) -> np.ndarray:
    top, low = np.zeros(k), np.zeros(k)
    np.add.at(top, f["k"].to_numpy(), (f["a"].to_numpy() * sn[f["p"].to_numpy()]) ** 2)
    np.add.at(low, f["k"].to_numpy(), f["a"].to_numpy() ** 2)
    return np.sqrt(top) / np.maximum(low, 1e-12)


def upsampled(model: Model, native: tuple[int, int], n_t: int, ssub: int = 1) -> Model:
    """The model on the native grid: footprints resized, traces interpolated; spikes stay at the low rate."""
    rows = []
    for k, part in model.footprints.groupby("k"):
        image = np.zeros(model.shape[0] * model.shape[1])
        image[part["p"].to_numpy()] = part["a"]
        a = arrays.upsample_image(image.reshape(model.shape), native).ravel()
        p = np.flatnonzero(a)
        rows.append(pd.DataFrame({"k": k, "p": p, "a": a[p]}))
    at, own = np.linspace(0, 1, n_t), np.linspace(0, 1, model.traces.shape[1])
    line = lambda m: np.stack([np.interp(at, own, x) for x in m]) if len(m) else np.zeros((0, n_t))
    return Model(model.params, native, pd.concat(rows, ignore_index=True) if rows else model.footprints, line(model.traces), model.spikes, line(model.rest), model.g, model.noise, model.norms, metrics=model.metrics)
