import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import arrays, sql
from lumenframe.operators import cells, components, movies, tune
from lumenframe.params import Params, good_defaults, resolve_crop
from lumenframe.plans import motion, session, sessions
from lumenframe.sources import avi, ingest, store


def synthetic(k=3, h=32, w=32, t=200, noise=0.3, seed=0):
    """Gaussian cells with decaying spikes on a smooth background."""
    r = np.random.default_rng(seed)
    at = [(8, 8), (22, 10), (14, 23), (24, 24)][:k]
    y, x = np.mgrid[:h, :w]
    a = np.stack([np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * 2.5**2)) for cy, cx in at])
    c = np.zeros((k, t))
    for i in range(1, t):
        c[:, i] = 0.9 * c[:, i - 1] + 3 * (r.random(k) < 0.05)
    bg = np.exp(-((y - 16) ** 2 + (x - 16) ** 2) / 400) * (1 + 0.3 * np.sin(np.arange(t) / 20))[:, None, None]
    return np.einsum("kt,kyx->tyx", c, a) + bg + r.normal(0, noise, (t, h, w)), a, c, at


def frames_of(spark, movie):
    return spark.createDataFrame(pd.DataFrame({"t": np.arange(len(movie)), "px": movie.reshape(len(movie), -1).tolist()}), "t int, px array<double>")


def test_fit_recovers_cells(spark):
    movie, a, c, _ = synthetic()
    model = session.fit(frames_of(spark, movie), (32, 32), Params(sigma=2.5, min_corr=0.5, min_pnr=4.0, border_px=0, seed_method="threshold"))
    assert model.count >= 3
    images = np.zeros((model.count, 1024))
    images[model.footprints["k"], model.footprints["p"]] = model.footprints["a"]
    true = a.reshape(3, -1) / np.linalg.norm(a.reshape(3, -1), axis=1, keepdims=True)
    cosine = true @ images.T
    best = cosine.argmax(1)
    assert (cosine.max(1) > 0.8).all() and len(set(best)) == 3
    r = [np.corrcoef(c[i], model.traces[b] + model.rest[b])[0, 1] for i, b in enumerate(best)]
    assert min(r) > 0.8
    m = model.metrics.toPandas()
    assert len(m) == model.count and (m.set_index("k").loc[list(best), "npix"] > 5).all()


def test_fit_without_cells_is_empty(spark):
    flat = np.random.default_rng(1).normal(0, 1, (60, 16, 16))
    model = session.fit(frames_of(spark, flat), (16, 16), Params(sigma=2.0, min_corr=0.99, min_pnr=50.0, seed_method="threshold", border_px=0))
    assert model.count == 0


def test_motion_correction_undoes_shifts(spark):
    r = np.random.default_rng(2)
    base = arrays.gaussian(r.random((48, 48)), 0.5) * 100
    moves = [(0, 0), (2, -1), (-3, 2), (1, 1)] * 5
    stack = np.stack([np.roll(base, m, (0, 1)) for m in moves])
    params = Params(max_shift=(6, 6), mc_n_iter=1, mc_gSig_filt=3.0, mc_sharpen_template=False)
    _, shifts, _ = motion.correct(frames_of(spark, stack), (48, 48), params, template=base)
    got = shifts.toPandas().sort_values("t")
    assert np.allclose(got[["dy", "dx"]].to_numpy(), -np.array(moves, float), atol=0.3)
    with pytest.raises(ValueError):
        motion.correct(frames_of(spark, stack), (48, 48), params, template=base[:10])


def test_sessions_register_moved_cells(spark):
    r = np.random.default_rng(3)
    at = r.integers(8, 56, (14, 2))
    rows = []
    for s, (dy, dx) in enumerate([(0, 0), (2, -1)]):
        for k, (cy, cx) in enumerate(at):
            y, x = np.mgrid[:64, :64]
            a = np.exp(-((y - cy - dy) ** 2 + (x - cx - dx) ** 2) / 8.0)
            p = np.flatnonzero(a > 0.1)
            rows.append(pd.DataFrame({"session": s, "k": k, "p": p, "a": a.ravel()[p]}))
    f = spark.createDataFrame(pd.concat(rows), "session int, k int, p int, a double")
    found = sessions.register(f, (64, 64), max_distance=6.0, probabilistic=False)
    wide = found.cell_map.pivot(index="g", columns="session", values="k").dropna()
    assert (wide[0] == wide[1]).mean() > 0.9 and found.n_registered() >= 12
    assert found.cell_map.groupby("g")["session"].nunique().eq(found.cell_map.groupby("g").size()).all()


def test_models_of_same_cells():
    r = np.random.default_rng(4)
    corr = np.concatenate([np.clip(r.normal(0.85, 0.05, 300), -1, 1), r.uniform(-0.6, 0.5, 500)])
    dist = np.concatenate([np.abs(r.normal(0.8, 0.4, 300)), r.uniform(3, 12, 500)])
    spatial = cells.fit_spatial_model(corr)
    assert spatial is not None and spatial.probability(corr=[0.9])[0] > 0.5 > spatial.probability(corr=[0.0])[0]
    centroid = cells.fit_centroid_model(dist, 12.0)
    assert centroid.probability(dist=[0.5])[0] > 0.5 > centroid.probability(dist=[10.0])[0]
    assert cells.fit_spatial_model(corr[:10]) is None


def test_avi_round_trip_and_folder(spark, tmp_path):
    r = np.random.default_rng(5)
    parts = [r.integers(0, 255, (n, 9, 14)).astype(np.uint8) for n in (4, 7, 5)]
    for i, p in enumerate(parts):
        (tmp_path / f"{i + 9}.avi").write_bytes(avi.encode(p))
    assert (np.stack(list(avi.decode(avi.encode(parts[0])))) == parts[0]).all()
    got = avi.read_folder(spark, str(tmp_path)).toPandas().sort_values("t")
    whole = np.concatenate(parts)
    assert got["t"].tolist() == list(range(16)) and (np.stack(got["px"]).reshape(whole.shape) == whole).all()
    small = avi.read_folder(spark, str(tmp_path), tsub=3, ssub=2).toPandas().sort_values("t")
    assert len(small) == 1 + 2 + 1 and small["height"].iloc[0] == 4 and small["width"].iloc[0] == 7
    assert np.isclose(small["px"].iloc[0][0], whole[:3, :2, :2].mean())


def test_store_round_trip(spark, tmp_path):
    movie, *_ = synthetic(t=10)
    store.save_frames(frames_of(spark, movie), str(tmp_path / "m"))
    assert store.load_frames(spark, str(tmp_path / "m")).count() == 10
    store.save_tables(spark, str(tmp_path / "r"), {"a": spark.range(3).toDF("k"), "b": None}, Params(sigma=4.0), components=3)
    tables, params, manifest = store.load_tables(spark, str(tmp_path / "r"))
    assert list(tables) == ["a"] and params.sigma == 4.0 and manifest["components"] == 3


def test_session_meta(spark, tmp_path):
    (tmp_path / "metaData.json").write_text('{"frameRate": "20FPS"}')
    (tmp_path / "timeStamps.csv").write_text("Frame,Time Stamp (ms)\n" + "\n".join(f"{i},{i * 50}" for i in range(11)))
    meta = store.session_meta(spark, str(tmp_path))
    assert meta["fps"] == 20.0 and meta["frames"] == 11 and abs(meta["measured_fps"] - 20) < 1e-9


def test_params_json_and_scaling():
    p = Params(sigma=6.0, min_pixel=16, frame_rate_hz=20.0, spatial_crop=(0, 1, 0, 1))
    assert Params.from_json(p.to_json()) == p
    assert Params.from_json('{"sigma": 2.0, "unknown": 1}').sigma == 2.0
    d = p.downscaled(2, 4)
    assert (d.sigma, d.min_pixel, d.frame_rate_hz, d.max_shift, d.spatial_crop) == (3.0, 4, 5.0, (10, 10), None)
    assert resolve_crop(Params(temporal_crop=(-5, 1000), spatial_crop=(2, 99, 0, 4)), 100, 10, 10) == (0, 100, 2, 10, 0, 4)
    with pytest.raises(ValueError):
        resolve_crop(Params(temporal_crop=(50, 50)), 100, 10, 10)
    with pytest.raises(ValueError):
        Params(seed_method="other")
    assert good_defaults(20.0).max_shift == (5, 3)


def test_candidates_fit_the_budget():
    spec = tune.SweepSpec(sigma=[2.0, 3.0, 4.0], min_corr=[0.7, 0.8, 0.9], min_pnr=[5.0, 10.0])
    assert len(tune.candidates(Params(), spec, 24)) == 18
    assert len(tune.candidates(Params(), spec, 10)) == 1 + 2 + 2 + 1
    seeds = [{"min_corr": 0.6, "min_pnr": 4.0, "thr_method": "a"}, {"min_corr": 0.5, "min_pnr": 3.0, "thr_method": "b"}]
    found = tune.candidates(Params(), tune.SweepSpec(sigma=[2.0, 3.0]), 8, seeds)
    assert [(p.sigma, p.min_corr, n) for p, n in found] == [(2.0, 0.6, "a"), (3.0, 0.6, "a"), (2.0, 0.5, "b"), (3.0, 0.5, "b")]
    assert tune.offset_grid({"around": [-1, 0, 1], "extra": [9]}, 2.4, 2.0, whole=True) == [2.0, 3.0, 9.0]


def test_sweep_turns_errors_into_rows(spark):
    def fit(p):
        if p.sigma > 3:
            raise RuntimeError("too wide")
        return p.sigma

    rows = tune.run_sweep(spark, [Params(sigma=s) for s in (2.0, 3.0, 4.0)], fit).toPandas().sort_values("rank")
    assert rows["idx"].tolist() == [1, 0, 2] and "too wide" in rows["error"].iloc[2]


def test_motion_search_is_coarse_to_fine():
    calls = []

    def score(g, s, n):
        calls.append((g, s, n))
        return 10 - abs(g - 3) - abs(s[0] - 6) + n, 2.0

    best, rows = tune.search_motion(score, 0.0, [2, 3, 4], [(3, 3), (6, 6), (9, 9)], [1, 2])
    assert (best["gsig"], best["max_shift"], best["n_iter"]) == (3, (6, 6), 2) and len(calls) == len(set(calls)) == len(rows)


def test_label_groups_follow_long_chains(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 20)] + [(30, 31)], "i long, j long")
    got = {r.k: r.label for r in components.label_groups(pairs, spark.range(40).toDF("k")).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[31] == 30 and got[35] == 35


def test_overlaps_in_blocks_equal_whole(spark):
    r = np.random.default_rng(6)
    rows = [(int(k), int(p), float(r.random())) for k in range(20) for p in r.choice(50, 12, replace=False)]
    f = spark.createDataFrame(rows, "k long, p int, a double")
    one = {(x.i, x.j): x.dot for x in components.overlaps(f).collect()}
    two = {(x.i, x.j): x.dot for x in components.overlaps(f, block=7).collect()}
    a = np.zeros((20, 50))
    for k, p, v in rows:
        a[k, p] = v
    g = a @ a.T
    assert one.keys() == two.keys() and all(abs(one[q] - g[q]) < 1e-9 and abs(two[q] - g[q]) < 1e-9 for q in one)


def test_transpose_equals_numpy(spark):
    x = np.random.default_rng(8).random((37, 30))
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(37), "px": x.tolist()}), "t int, px array<double>").repartition(4)
    got = movies.transposed(df, block=7).toPandas().sort_values("p")
    assert got["p"].tolist() == list(range(30)) and np.allclose(np.stack(got["tr"]), x.T)


def test_driver_merge_equals_relational_merge(spark):
    r = np.random.default_rng(10)
    base = r.random((4, 60))
    rows, traces = [], []
    for k in range(9):
        cy, cx = [(8, 8), (8, 9), (20, 20), (21, 20), (30, 5)][k % 5]
        y, x = np.mgrid[:40, :40]
        a = np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 8.0).ravel()
        p = np.flatnonzero(a > 0.1)
        rows.append(pd.DataFrame({"k": k, "p": p, "a": a[p]}))
        traces.append(base[k % 4] + 0.1 * r.random(60))
    f, c = pd.concat(rows, ignore_index=True), np.stack(traces)
    params = Params(sigma=1.0, merge_thr_corr=0.7)
    _, groups = session._merged(f, c, (40, 40), params)
    t = spark.createDataFrame(pd.DataFrame({"k": np.repeat(np.arange(9), 60), "t": np.tile(np.arange(60), 9), "v": c.ravel()}), "k int, t int, v double")
    df = spark.createDataFrame(f, "k int, p int, a double")
    pairs = components.merge_pairs(df, t, corr=0.7, overlap=params.merge_thr_overlap, near=2.0, width=40)
    labels = components.label_groups(pairs, df.select("k")).toPandas()
    assert sorted(groups) == sorted(sorted(g["k"].tolist()) for _, g in labels.groupby("label")) and len(groups) < 9


def test_empty_tables_give_empty_results(spark):
    movie = spark.createDataFrame([], "t int, y int, x int, v double")
    assert movies.reject_outliers(movie).count() == 0
    f = spark.createDataFrame([], "k long, p int, a double")
    assert components.tanimoto(f).count() == 0 and components.energy_threshold(f).count() == 0


def test_partitions_do_not_change_results(spark):
    movie, *_ = synthetic(t=40)
    long = movies.long_of_frames(frames_of(spark, movie), 32)
    want = movies.reject_outliers(long, 1.0).groupBy("t").agg(F.round(F.sum("v"), 6).alias("s")).orderBy("t").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert movies.reject_outliers(long.repartition(5), 1.0).groupBy("t").agg(F.round(F.sum("v"), 6).alias("s")).orderBy("t").collect() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_sql_functions(spark):
    sql.register(spark)
    assert spark.sql("select sum(w) as s, count(*) as n from lf_kernel(2.0D)").collect()[0]["n"] == 169
    rows = spark.sql("select * from lf_spikes(array(0D, 0D, 1D, 0.9D, 0.81D, 0D, 0D, 0D, 0D), 0.9D, 0D)").collect()
    assert [r.t for r in rows] == list(range(9)) and rows[2].s > 0.5


def test_discovery_of_files(spark):
    df = lambda *names: spark.createDataFrame([(n,) for n in names], "file string")
    order = lambda d: [r.file for r in ingest.discover_any(d).orderBy("file_no").collect()]
    assert order(df("10.avi", "9.avi", "x.avi")) == ["9.avi", "10.avi"]
    assert order(df("a_2024-01-02T00_00_00.avi", "b_2024-01-01T00_00_00.avi"))[0].startswith("b")
    assert order(df("only.avi")) == ["only.avi"]
    with pytest.raises(ValueError):
        order(df("a.avi", "b.avi"))


def test_streamed_frames_are_registered_once(spark, tmp_path):
    from lumenframe.streaming import landing

    base = np.random.default_rng(7).random((24, 24)) * 100
    frames_of(spark, np.stack([base, np.roll(base, 2, 0)])).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        landing.register_landed(landing.landed(spark, str(tmp_path / "in")), base, str(tmp_path / "out"), str(tmp_path / "log"), gsig=None, max_shift=(5, 5)).awaitTermination()
    got = {r.t: (r.dy, r.dx) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (0.0, 0.0), 1: (-2.0, 0.0)} and spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_global_background_and_placing(spark):
    movie, *_ = synthetic(t=120)
    params = Params(sigma=2.5, min_corr=0.5, min_pnr=4.0, border_px=0, seed_method="threshold", global_bg_rank=1, n_iter_main=1)
    model = session.fit(frames_of(spark, movie), (32, 32), params)
    assert model.count >= 2
    full = session.placed(model, (4, 36, 6, 38), (50, 60), 10, 200)
    p, q = model.footprints["p"].to_numpy(), full.footprints["p"].to_numpy()
    assert ((q // 60 == p // 32 + 4) & (q % 60 == p % 32 + 6)).all() and full.traces.shape == (model.count, 200) and not full.traces[:, :10].any()
    big = session.upsampled(model, (64, 64), 240)
    assert big.traces.shape == (model.count, 240) and big.footprints["p"].max() < 64 * 64


def test_tuning_finds_settings_and_reports(spark, tmp_path):
    from lumenframe.plans import report, tuning

    movie, *_ = synthetic(t=120)
    frames = frames_of(spark, movie).cache()
    found = tuning.run_tuning(frames, (32, 32), Params(seed_method="threshold", border_px=0, n_iter_main=1, frame_rate_hz=20.0), spec=tune.SweepSpec(sigma=[2.5]), budget=2)
    assert found.sweep["score"].is_monotonic_decreasing and found.sweep["K"].max() >= 2 and 0.7 <= found.params.merge_thr_corr <= 0.85
    report.write(str(tmp_path), "session", {"sweep": found.sweep}, found.params)
    assert "<table>" in (tmp_path / "report.html").read_text() and "| idx |" in (tmp_path / "report.md").read_text()


def test_template_is_the_median_of_filtered_frames(spark, monkeypatch):
    monkeypatch.setattr(motion, "TILE_VALUES", 40 * 64)  # several tiles
    stack = np.random.default_rng(2).random((45, 12, 12))
    kernel = arrays.highpass_kernel(2.0)
    want = arrays.bin_median(np.stack([arrays.convolve(f, kernel) for f in stack[:40]]))
    some, n = motion.sampled(frames_of(spark, np.concatenate([stack, stack])).where("t < 40"), 40, 1000)
    got = motion.template_of(some, n, (12, 12), Params(mc_sharpen_template=False), 2.0)
    assert n == 40 and np.allclose(got, want) and not np.allclose(got, arrays.convolve(arrays.bin_median(stack[:40]), kernel), atol=1e-3)
    some, n = motion.sampled(frames_of(spark, stack), 45, 7)
    at = np.unique(np.linspace(0, 44, 7).astype(int))
    assert n == 7 and np.allclose(motion.by_tile(some, n, (12, 12), lambda x: x.std(0)), stack[at].std(0))


def test_template_frames_come_from_few_files():
    found = motion.template_frames([100, 0, 50, 100, 80], 3, 20)
    assert len(found) == 20 and found == sorted(set(found)) and {0 if t < 100 else 2 if t < 150 else 4 for t in found} <= {0, 2, 4} and max(found) == 329
    assert motion.template_frames([3], 10, 200) == [0, 1, 2] and motion.template_frames([], 10, 200) == []


def test_template_window(spark):
    stack = np.random.default_rng(3).random((12, 8, 8))
    frames = spark.createDataFrame([(t, f.ravel().tolist()) for t, f in enumerate(stack)], "t int, px array<double>")
    params = Params(max_shift=(2, 2), mc_n_iter=1, mc_gSig_filt=1.5)
    by_window = motion.correct(frames, (8, 8), params, template_window=(2, 6))[1].toPandas().sort_values("t")
    by_template = motion.correct(frames, (8, 8), params, template=stack[2:6].mean(0))[1].toPandas().sort_values("t")
    assert np.allclose(by_window[["dy", "dx"]], by_template[["dy", "dx"]])
    for bad in ({"template_window": (6, 6)}, {"template_window": (0, 13)}, {"template_window": (0, 2), "template": stack[0]}, {"template": stack[0][:4]}):
        with pytest.raises(ValueError):
            motion.correct(frames, (8, 8), params, **bad)


def test_crops_come_before_the_fit(spark, tmp_path):
    r = np.random.default_rng(4)
    movie = r.random((30, 10, 12))
    frames = spark.createDataFrame([(t, f.ravel().tolist()) for t, f in enumerate(movie)], "t int, px array<double>")
    pixels = spark.createDataFrame([(p, movie[:, p // 12, p % 12].tolist()) for p in range(120)], "p int, tr array<double>")
    mask = np.zeros((10, 12), bool)
    mask[2:9, 3:11] = True
    mask[4, 5] = False
    np.save(tmp_path / "m.npy", mask)
    want = movie[5:25, 3:9, 3:10] * mask[3:9, 3:10]
    params = Params(temporal_crop=(5, 25), spatial_crop=(3, 99, -4, 10), spatial_mask_path=str(tmp_path / "m.npy"))
    got, shape, where = session.cropped(frames, (10, 12), params)
    assert shape == (6, 7) and where == {"orig_dims": (10, 12), "orig_T": 30, "bbox": (3, 9, 3, 10), "t_range": (5, 25), "masked": True}
    rows = got.toPandas().sort_values("t")
    assert rows["t"].tolist() == list(range(20)) and np.allclose(np.stack(rows["px"]).reshape(want.shape), want)
    rows = session.cropped(pixels, (10, 12), params)[0].toPandas().sort_values("p")
    assert rows["p"].tolist() == list(range(42)) and np.allclose(np.stack(rows["tr"]), want.reshape(20, 42).T)
    assert session.cropped(frames, (10, 12), Params())[0] is frames
    for name, bad, message in (("empty", np.zeros((10, 12)), "all-False"), ("bad", np.ones((5, 5)), "match native dims")):
        np.save(tmp_path / f"{name}.npy", bad)
        with pytest.raises(ValueError, match=message):
            session.cropped(frames, (10, 12), Params(spatial_mask_path=str(tmp_path / f"{name}.npy")))
    with pytest.raises(ValueError, match="empty"):
        session.cropped(frames, (10, 12), Params(temporal_crop=(8, 8)))


def test_fit_of_a_crop_is_placed_on_the_whole_field(spark):
    r = np.random.default_rng(5)
    movie = r.normal(0, 0.05, (150, 20, 24))
    y, x = np.mgrid[:20, :24]
    trace = np.convolve((r.random(150) < 0.06).astype(float), 0.8 ** np.arange(30))[:150]
    movie += np.exp(-((y - 11) ** 2 + (x - 14) ** 2) / 8)[None] * trace[:, None, None] * 3
    frames = spark.createDataFrame([(t, f.ravel().tolist()) for t, f in enumerate(movie)], "t int, px array<double>")
    params = Params(sigma=2.0, min_corr=0.5, min_pnr=3.0, border_px=1, seed_method="threshold", n_iter_main=1, spatial_crop=(4, 19, 6, 23), temporal_crop=(20, 140))
    model = session.fit(frames, (20, 24), params, evaluate_=False)
    assert model.shape == (15, 17) and model.traces.shape[1] == 120 and model.count >= 1
    whole = session.placed(model)
    assert whole.shape == (20, 24) and whole.traces.shape[1] == 150 and not whole.traces[:, :20].any() and not whole.traces[:, 140:].any()
    f = whole.footprints
    at = [(float((g.a * (g.p // 24)).sum() / g.a.sum()), float((g.a * (g.p % 24)).sum() / g.a.sum())) for _, g in f.groupby("k")]
    assert min(np.hypot(a - 11, b - 14) for a, b in at) < 1.0


def test_labels_reach_the_end_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(300)], "i long, j long")
    labels = components.label_groups(pairs, spark.range(303).toDF("k")).toPandas()
    assert set(labels.loc[labels.k <= 300, "label"]) == {0} and set(labels.loc[labels.k > 300, "label"]) == {301, 302}


def test_merged_footprints_are_trimmed(spark):
    r = np.random.default_rng(6)
    y, x = np.mgrid[:20, :20]
    images = [np.exp(-((y - a) ** 2 + (x - b) ** 2) / 6) * (1 + 0.2 * r.random((20, 20))) for a, b in ((9, 9), (10, 10), (3, 15))]
    f = pd.DataFrame([(k, p, v) for k, im in enumerate(images) for p, v in enumerate(im.ravel()) if v > 1e-4], columns=["k", "p", "a"])
    groups = spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "k long, label long")
    traces = spark.createDataFrame([(k, t, float(t)) for k in range(3) for t in range(4)], "k long, t int, v double")
    merged, _ = components.merge(spark.createDataFrame(f, "k long, p int, a double"), traces, groups, shape=(20, 20))
    got = {k: g.set_index("p")["a"] for k, g in merged.toPandas().groupby("k")}
    want = arrays.trim_footprint(images[0] * (images[0] > 1e-4) + images[1] * (images[1] > 1e-4), method="max", max_share=0.1).ravel()
    image = np.zeros(400)
    image[got[0].index] = got[0]
    assert np.allclose(image, want) and len(got[0]) < (images[0] + images[1] > 1e-4).sum()
    assert len(got[2]) == (images[2] > 1e-4).sum()  # alone: as it was


def test_decay_of_constant_traces_and_clips():
    from lumenframe.functions import solvers

    assert solvers.g_to_decay(2.0, 20.0) == pytest.approx(-50 / np.log(0.999999))
    assert solvers.ar_coefficients(np.ones(50))[0][0] == pytest.approx(0.96 * 0.96)
    assert solvers.ar_coefficients(np.ones(50), prior=0.7, prior_weight=5.0)[0][0] == pytest.approx(0.7)


def test_batch_keeps_going():
    from lumenframe.plans import tuning

    rows = tuning.run_batch(["a", "b"], lambda n: 1 / (n == "a"))
    assert rows["ok"].tolist() == [True, False] and "ZeroDivisionError" in rows["result"].iloc[1]


def test_folder_is_registered_in_one_go(spark, tmp_path):
    base = np.random.default_rng(9).random((24, 24))
    base = (arrays.gaussian(base, 0.5) * 255).astype(np.uint8)
    for i in range(2):
        (tmp_path / f"{i}.avi").write_bytes(avi.encode(np.stack([np.roll(base, m, 0) for m in (0, 1, -1, 0)])))
    moved, shifts, _ = motion.correct_folder(spark, str(tmp_path), Params(max_shift=(4, 4), mc_n_iter=1, mc_gSig_filt=1.5, mc_sharpen_template=False))
    dy = shifts.toPandas().sort_values("t")["dy"].to_numpy()
    assert moved.count() == 8 and np.allclose(dy[1] - dy[0], -1, atol=0.3) and np.allclose(dy[2] - dy[0], 1, atol=0.3)
    again = motion.correct_folder(spark, str(tmp_path), Params(max_shift=(4, 4), mc_n_iter=1, mc_gSig_filt=1.5, mc_sharpen_template=False), spark_only=True)[1].toPandas().sort_values("t")
    assert np.allclose(again["dy"], dy)


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_made_whole_in_the_task_where_their_blocks_meet(spark):
    """Nothing is joined to pairs or grouped by them; blocks of seven components give what plain Python gives."""
    rng = np.random.default_rng(3)
    feet = {int(k): {int(p): float(a) for p, a in zip(rng.choice(40, n, replace=False), rng.integers(0, 5, n))} for k, n in zip(rng.permutation(60), rng.integers(1, 12, 60))}
    f = spark.createDataFrame([(k, p, a) for k, own in feet.items() for p, a in own.items()], "k long, p int, a double")
    full, want = {}, {}
    for i, j in itertools.combinations(sorted(feet), 2):
        a, b = feet[i], feet[j]
        if any(a[p] * b[p] for p in a.keys() & b.keys()):
            dot = sum(a[p] * b[p] for p in a.keys() & b.keys())
            want[i, j] = dot / (sum(v * v for v in a.values()) + sum(v * v for v in b.values()) - dot)
            u, w = np.array([[x.get(p, 0.0) for p in sorted(a.keys() | b.keys())] for x in (a, b)])
            full[i, j] = np.corrcoef(u, w)[0, 1] if u.std() > 0 and w.std() > 0 else 0.0
    got = components.tanimoto(f, 7)
    assert {(r.i, r.j): pytest.approx(r.jaccard) for r in got.collect()} == want
    assert {(r.i, r.j): pytest.approx(r.corr, abs=1e-9) for r in components.overlap_correlations(f, 7).collect()} == full
    for df in (got, components.binary_jaccard(f, 7), components.overlaps(f, 7)):
        above = plan_of(df).split("FlatMapGroupsInPandas")[0]
        assert "Join" not in above and "Aggregate" not in above
    labels = {k: k for k in feet}
    for _ in feet:
        for (i, j), v in want.items():
            if v > 0.3:
                labels[i] = labels[j] = min(labels[i], labels[j])
    few = components.similar_pairs(f, 0.3, 7)
    assert {r.k: r.label for r in components.label_groups(few, f.select("k")).collect()} == labels
    assert few.count() <= 13 * sum(1 for _ in itertools.combinations_with_replacement(range(9), 2))


def test_blocks_meet_without_a_shuffle_and_round_as_sql_does(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(30, 9)), 1)
    t = spark.createDataFrame([(int(k), int(i), float(v)) for k, row in enumerate(x) for i, v in enumerate(row)], "k long, t int, v double")
    f = spark.createDataFrame([(int(k), int(p), float(a)) for k in range(30) for p, a in zip(rng.choice(20, 8, replace=False), rng.integers(1, 5, 8))], "k long, p int, a double")
    for df in (components.trace_correlations(t), components.tanimoto(f, 7), components.binary_jaccard(f, 7), components.overlap_correlations(f, 7), components.similar_pairs(f, 0.3, 7)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    r = {(i, j): np.corrcoef(x[i], x[j])[0, 1] for i, j in itertools.combinations(range(30), 2)}
    got = {(row.i, row.j): row.r for row in components.trace_correlations(t, digits=3).collect()}
    assert got.keys() == r.keys() and all(abs(got[q] - r[q]) <= 0.0005 + 1e-12 and got[q] == round(got[q], 3) for q in r)
    assert components.rounded_off(np.array([1 / 128, -1 / 128, -1e-9, 0.3]), 6).tolist() == [0.007813, -0.007813, 0.0, 0.3]
    assert not np.signbit(components.rounded_off(np.array([-1e-9]), 6)).any()


def test_groups_of_footprints_are_joined_without_all_pairs(monkeypatch):
    rng = np.random.default_rng(14)
    for wide, pairs in ((30, 1 << 20), (6_000, 64)):
        x = np.where(rng.random((90, 30)) < 0.3, rng.integers(1, 5, (90, 30)), 0)
        x[60:] = x[:30] * 2  # copies join early
        p = np.sort(rng.choice(wide, 30, replace=False))
        part = pd.DataFrame({"k": np.arange(90), "p": [p[r > 0] for r in x], "a": [r[r > 0].astype(float) for r in x]})
        part = part[part["p"].map(len) > 0].reset_index(drop=True)
        y = x[part["k"]].astype(float)
        dot, e = y @ y.T, (y * y).sum(1)
        link = dot / (e[:, None] + e[None, :] - dot) > 0.4
        want = np.arange(len(part))
        for _ in range(len(part)):
            want = np.array([want[r].min() for r in link])
        monkeypatch.setattr(components, "PAIRS", pairs)
        label = np.arange(len(part))
        i, j = components._join(part, part, label, label, 0.4)
        assert (label == want).all() and link[i, j].all() and len(i) == len(part) - len(set(want)) > 0
        left, right = part[:50], part[50:].reset_index(drop=True)
        label = np.arange(len(part))
        i, j = components._join(left, right, label[:50], label[50:], 0.4)
        cross, want = link.copy(), np.arange(len(part))
        cross[:50, :50], cross[50:, 50:] = np.eye(50, dtype=bool), np.eye(len(right), dtype=bool)
        for _ in range(len(part)):
            want = np.array([want[r].min() for r in cross])
        assert (label == want).all() and cross[i, j + 50].all() and len(i) == len(part) - len(set(want))


def test_quantiles_of_correlations_are_exact_and_only_counts_are_shuffled(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(40, 9)), 1)
    x = np.concatenate([x, x[:12], np.zeros((3, 9))])  # equal traces and constant ones
    t = spark.createDataFrame([(int(k), int(i), float(v)) for k, row in enumerate(x) for i, v in enumerate(row)], "k long, t int, v double")
    r = np.array([row.r for row in components.trace_correlations(t).collect()])
    assert len(r) == 55 * 54 // 2
    got = components.correlation_quantiles(t, [0.0, 0.5, 0.99, 1.0])
    assert got == pytest.approx(np.percentile(r, [0, 50, 99, 100]), abs=1e-12)
    assert components.correlation_quantiles(t, [0.5], absolute=True) == pytest.approx([np.median(np.abs(r))], abs=1e-12)
    assert components.correlation_quantiles(t.where("k = 1"), [0.5]) == [None]
    assert tune.merge_threshold(t).collect()[0]["p99"] == pytest.approx(np.percentile(r, 99), abs=1e-12)
    assert "FlatMapGroups" not in plan_of(tune.merge_threshold(t))
    counts = components.correlation_counts(t).toPandas()
    assert counts["n"].sum() == len(r) and counts["v"].sum() == pytest.approx(r.sum()) and "Join" not in plan_of(components.correlation_counts(t)).split("FlatMapGroupsInPandas")[0]


def test_peaks_of_footprints_are_found_without_a_join(spark):
    from lumenframe.operators import evaluate

    rng = np.random.default_rng(6)
    feet = {k: {int(p): float(a) for p, a in zip(rng.choice(400, 30, replace=False), rng.integers(0, 4, 30))} for k in range(30)}
    feet[30], feet[31] = {0: 2.0, 39_999_999: 2.0}, {5: 0.0}  # far apart; nothing over 0
    for width, d in ((20, 1), (20, 3), (4_000, 2)):
        n = []
        for own in feet.values():
            own = {(p // width, p % width): a for p, a in own.items() if a > 0}
            top = max(own.values(), default=0)
            n.append(sum(a > 0.3 * top and not any((y, x) != (i, j) and abs(y - i) <= d and abs(x - j) <= d and (b > a or (b == a and (i, j) < (y, x))) for (i, j), b in own.items()) for (y, x), a in own.items()))
        f = spark.createDataFrame([(k, p, a) for k, own in feet.items() for p, a in own.items()], "k long, p int, a double")
        share = evaluate.multipeak_share(f, width, d)
        assert share.collect()[0]["share"] == pytest.approx(np.mean([v >= 2 for v in n]))
        assert "Join" not in plan_of(share)


def test_repairs_look_over_spans_and_never_to_the_end_of_a_window(spark):
    rng = np.random.default_rng(9)
    for share in (0.3, 0.9, 1.0):
        bad = rng.random(60) < share
        plan = movies.repair_plan(spark.createDataFrame([(int(t), bool(x)) for t, x in enumerate(bad)], "t int, outlier boolean"), span=8)
        good = np.flatnonzero(~bad)
        want = {}
        for t in np.flatnonzero(bad):
            low, high = good[good < t], good[good > t]
            l, r = (low[-1] if len(low) else None), (high[0] if len(high) else None)
            want[int(t)] = (r if l is None else l, l if r is None else r, 0.0 if l is None or r is None else (t - l) / (r - l))
        assert {x.t: (x.left, x.right, x.alpha) for x in plan.collect()} == want
        assert "unboundedfollowing" not in plan_of(plan).lower()


def test_products_of_movies_and_components_are_made_in_blocks(spark):
    from lumenframe.operators import background

    rng = np.random.default_rng(10)
    y, w = rng.normal(size=(30, 20)), rng.normal(size=(9, 20)) * (rng.random((9, 20)) < 0.4)
    w[:, 0] = 1
    movie = spark.createDataFrame([(int(t), int(p), float(y[t, p])) for t in range(30) for p in range(20)], "t int, p int, v double")
    b = spark.createDataFrame([(int(k), int(p), float(w[k, p])) for k in range(9) for p in range(20) if w[k, p]], "k long, p int, b double")
    for frames, pixels, ks in ((7, 6, 4), (7, 64, 4), (1_024, 4_096, 2_048)):
        rows = background.times_sparse(movie, b, frames, pixels, ks)
        got = {(r.k, r.t): r.v for r in rows.collect()}
        assert got == pytest.approx({(k, t): w[k] @ y[t] for k in range(9) for t in range(30)}) and rows.count() == 270


def test_blocks_of_products_are_shuffled_once(spark):
    from lumenframe.operators import background

    rng = np.random.default_rng(12)
    y, w = rng.normal(size=(40, 20)), rng.normal(size=(9, 20))
    movie = spark.createDataFrame([(int(t), int(p), float(y[t, p])) for t in range(40) for p in range(20)], "t int, p int, v double")
    b = spark.createDataFrame([(int(k), int(p), float(w[k, p])) for k in range(9) for p in range(20)], "k long, p int, b double")
    for pixels in (6, 64):
        rows = background.times_sparse(movie, b, 7, pixels, 4, digits=4)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "CoGroups" not in plan and "Join" not in plan and ("Exchange" in plan) == (pixels == 6)  # sums over blocks of pixels only
        got = {(r.k, r.t): r.v for r in rows.collect()}
        assert got == pytest.approx({(k, t): w[k] @ y[t] for k in range(9) for t in range(40)}, abs=5.1e-5) and all(v == round(v, 4) for v in got.values())
