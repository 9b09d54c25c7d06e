"""Models and registrations that are saved and loaded, and the validation of a session, on a small recording."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import arrays
from lumenframe.operators import cells, evaluate, tune
from lumenframe.params import Params
from lumenframe.plans import session, sessions, tuning
from lumenframe.sources import store, views

FIELD = views.CELL_FIELD
PARAMS = Params(sigma=2.0, min_corr=0.5, min_pnr=5.0, border_px=1, seed_method="threshold", n_iter_main=1, init_patches=False)


@pytest.fixture(scope="module")
def frames(spark, sf):
    return views.cell_frames(spark, sf).where("t < 300").persist()


@pytest.fixture(scope="module")
def model(frames):
    return session.fit(frames, (FIELD, FIELD), PARAMS)


def test_model_comes_back_as_it_was_saved(spark, model, tmp_path):
    model.save(spark, str(tmp_path / "m"))
    again = session.Model.load(spark, str(tmp_path / "m"))
    assert again.params == model.params and again.shape == model.shape and again.count == model.count > 0 and again.crop is None
    for name in ("traces", "spikes", "rest", "g", "noise", "norms", "pixel_noise"):
        assert np.allclose(getattr(again, name), getattr(model, name)), name
    assert (again.accepted == model.accepted).all() and again.shifts is None
    pd.testing.assert_frame_equal(again.footprints, model.footprints.sort_values(["k", "p"]).reset_index(drop=True), check_dtype=False)
    for name in ("ring", "baseline", "metrics"):
        assert sorted(getattr(again, name).columns) == sorted(getattr(model, name).columns) and getattr(again, name).count() == getattr(model, name).count()


def test_metrics_hold_fidelity_in_space(model, frames):
    movie = np.stack(frames.toPandas().sort_values("t")["px"]).reshape(-1, FIELD, FIELD)
    m = model.metrics.toPandas().set_index("k")
    assert {"snr_amp", "eccentricity", "peak_snr", "skew", "autocorr_lag1", "cn_corr", "r_value"} <= set(m.columns) and len(m) == model.count
    assert (model.accepted == m["keep"].sort_index().to_numpy(bool)).all()
    for k in range(model.count):
        c, f = model.traces[k], model.footprints[model.footprints.k == k]
        hit = np.flatnonzero(c >= np.percentile(c, 95))
        hit = hit if len(hit) >= 10 else np.lexsort((np.arange(len(c)), -c))[:10]
        y, x = f["p"] // FIELD, f["p"] % FIELD
        box = np.zeros((FIELD, FIELD), bool)
        box[max(0, y.min() - 4) : y.max() + 5, max(0, x.min() - 4) : x.max() + 5] = True
        image = np.zeros(FIELD * FIELD)
        image[f["p"]] = f["a"]
        a, b = image[box.ravel()], (movie[hit].mean(0) - movie.mean(0))[box]
        want = np.corrcoef(a, b)[0, 1] if a.std() > 0 and np.abs(b).max() > 1e-12 else 0.0  # a trace that is 0 throughout peaks everywhere
        assert m.loc[k, "r_value"] == pytest.approx(want, abs=1e-9)
    assert m["r_value"].median() > 0.8


def test_settings_that_are_not_known_are_errors(frames):
    with pytest.raises(ValueError, match="ar_order"):
        session.fit(frames, (FIELD, FIELD), Params(ar_order=3))


def test_registration_comes_back_as_it_was_saved(spark, model, tmp_path):
    own = spark.createDataFrame(model.footprints, "k int, p int, a double")
    both = own.selectExpr("0 as session", "k", "p", "a").unionByName(own.selectExpr("1 as session", "k", f"cast(p + {FIELD} as int) as p", "a").where(f"p < {FIELD * FIELD}"))
    made = sessions.register(both, (FIELD, FIELD), max_distance=6.0)
    made.save(spark, str(tmp_path / "r"))
    again = sessions.Registration.load(spark, str(tmp_path / "r"))
    assert again.shape == (FIELD, FIELD) and again.n_registered() == made.n_registered() > 0
    for name, keys in (("cell_map", ["g", "session"]), ("transforms", ["session"]), ("matches", ["i", "j"]), ("centres", ["session", "k"])):
        a, b = (getattr(x, name).sort_values(keys).reset_index(drop=True) for x in (again, made))
        pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(b)], check_dtype=False)
    assert (again.model is None) == (made.model is None)
    if made.model is not None:
        assert np.allclose(again.model.p_same, made.model.p_same) and again.model.threshold == made.model.threshold


def test_validation_counts_blobs_and_footprints(spark, frames, tmp_path):
    rows = tuning.validate(frames, (FIELD, FIELD), PARAMS, [("own", 0.5, 5.0), ("strict", 0.99, 1e6)], str(tmp_path / "v")).set_index("label")
    assert rows.loc["own", "K"] >= 9 and rows.loc["own", "blob_recall"] == pytest.approx(rows.loc["own", "n_blobs_covered"] / rows.loc["own", "n_blobs"])
    assert rows.loc["own", "n_blobs_covered"] >= 9  # all planted cells; what else the noise of a field makes look like a blob is none
    assert rows.loc["own", "footprint_precision"] == pytest.approx(rows.loc["own", "n_footprints_on_blob"] / rows.loc["own", "n_footprints"])
    assert rows.loc["strict", "K"] == 0 and math.isnan(rows.loc["strict", "blob_recall"])
    found = session.Model.load(spark, str(tmp_path / "v" / "run_own"))
    tables, _, _ = store.load_tables(spark, str(tmp_path / "v" / "run_own" / "coverage"))
    blobs, peaks = (tables[n].toPandas() for n in ("blobs", "peaks"))
    near = np.hypot(blobs["cy"].to_numpy()[:, None] - peaks["cy"].to_numpy(), blobs["cx"].to_numpy()[:, None] - peaks["cx"].to_numpy()) <= 3.0
    assert (near.any(1) == blobs["matched"]).all() and (near.any(0) == peaks["matched"]).all() and len(peaks) == found.accepted.sum()
    row = spark.createDataFrame([(float(rows.loc["own", "blob_recall"]), float(rows.loc["own", "footprint_precision"]), 0.9, 0.1)], "recall double, precision double, cproj double, trace_corr double")
    assert evaluate.verdict(row).collect()[0]["verdict"] == ("PASS" if min(rows.loc["own", ["blob_recall", "footprint_precision"]]) >= 0.8 else "WARN")


def test_lower_thresholds_and_fewest_pixels():
    assert tuning.lower_thresholds(Params(min_corr=0.8, min_pnr=10.0)) == [("recommended", 0.8, 10.0), ("lowthr", 0.7, 6.0)]
    assert tuning.lower_thresholds(Params(min_corr=0.62, min_pnr=5.0))[1][1:] == (0.6, 3.0)
    images = [np.pad(np.full((n, n), 2.0), 1, constant_values=0.05) for n in (2, 3, 4, 5)]
    low, seen = tune.min_pixel(images)
    assert seen["pixel_counts"].tolist() == [4, 9, 16, 25] and low == int(np.percentile([4, 9, 16, 25], 25)) and tune.min_pixel([])[0] == 3


def test_preview_registers_some_frames(frames):
    moved, shifts = tuning.quick_motion(frames, (FIELD, FIELD), Params(max_shift=(3, 3), mc_gSig_filt=2.0, mc_sharpen_template=False), n_frames=20)
    assert moved.count() == 20 == shifts.count()


def test_column_functions_equal_their_kernels(spark):
    from lumenframe.functions import arrays, solvers, sql

    rows = [(i, [float((7 * i + j * j) % 13) for j in range(20 + 5 * (i % 2))], 0.05 + 0.09 * i, 1.0 + i % 3, 2.0 + i % 2) for i in range(10)]
    df = spark.createDataFrame(rows, "i int, tr array<double>, x double, p double, q double")
    for r in df.select("*", sql.noise_level("tr").alias("sn"), sql.beta_pdf("x", "p", "q").alias("b")).collect():
        assert r.sn == pytest.approx(arrays.noise_level(np.array(r.tr)[None])[0]) and r.b == pytest.approx(solvers.beta_pdf(np.array([r.x]), r.p, r.q)[0])
    assert df.limit(0).select(sql.noise_level("tr"), sql.beta_pdf("x", "p", "q")).count() == 0


def test_rows_of_the_subtracted_movie(spark):
    from lumenframe.operators import background

    r = np.random.default_rng(1)
    movie, b0 = r.random((36, 40)), r.random(36)
    edges = [(p, q, float(r.normal())) for p in range(36) for q in range(36) if 1 < abs(p // 6 - q // 6) ** 2 + abs(p % 6 - q % 6) ** 2 <= 4 and p != 7]
    pixels = spark.createDataFrame([(p, row.tolist()) for p, row in enumerate(movie)], "p int, tr array<double>")
    ring, level = spark.createDataFrame(edges, "p int, q int, w double"), spark.createDataFrame([(p, float(b)) for p, b in enumerate(b0)], "p int, b0 double")
    w = np.zeros((36, 36))
    for p, q, v in edges:
        w[p, q] += v
    z = movie - b0[:, None]
    want = z - w @ z
    got = {x.p: x.tr for x in background.subtracted_rows(pixels, ring, level, (6, 6), 1.0).collect()}
    assert all(np.allclose(got[p], want[p]) for p in range(36))
    rows = spark.createDataFrame([(3,), (7,), (20,)], "p int")
    got = {x.p: x.tr for x in background.subtracted_rows(pixels, ring, level, (6, 6), 1.0, rows, (5, 33), 4).collect()}
    assert set(got) == {3, 7, 20} and all(np.allclose(got[p], want[p, 5:33:4]) for p in got)
    tiles = {x.p: x.tr for x in background.ring_applied(spark.createDataFrame([(p, row.tolist()) for p, row in enumerate(z)], "p int, tr array<double>"), ring, 6, 6, 1.0, tile=2).collect()}
    assert all(np.allclose(tiles[p], want[p]) for p in range(36))
    f = r.normal(size=(2, 40))
    got = {x.p: x.tr for x in background.subtracted_rows(pixels, ring, level, (6, 6), 1.0, rows, (5, 33), courses=f).collect()}
    assert all(np.allclose(got[p], (want[p] - want[p] @ np.linalg.pinv(f) @ f)[5:33]) for p in (3, 7, 20))


def plain_refinement(cells_, at, owner, p, reach, p_thr=0.5):
    """The card's rules, cell by cell, without a grid."""
    groups = {}
    for c, g in enumerate(owner):
        groups.setdefault(g, set()).add(c)
    owner, fresh = list(owner), 10_000
    for _ in range(10):
        centre = {g: at[sorted(m)].mean(0) for g, m in groups.items() if m}
        changes = 0
        for c in range(len(cells_)):
            def like(g):
                found = [p[c][m] for m in groups[g] if cells_[m][0] != cells_[c][0]]
                return np.mean(found) if found else -1.0

            best, score = owner[c], like(owner[c])
            for g in sorted(centre):
                if g != owner[c] and np.hypot(*(at[c] - centre[g])) <= reach and all(cells_[m][0] != cells_[c][0] for m in groups[g]) and like(g) > score + 1e-9:
                    best, score = g, like(g)
            if score < p_thr:
                if len(groups[owner[c]]) == 1:
                    continue
                best, fresh = fresh, fresh + 1
            if best != owner[c]:
                groups[owner[c]].discard(c)
                groups.setdefault(best, set()).add(c)
                owner[c] = best
                changes += 1
        if changes < 10:
            break
    return owner


def parts_of(owner):
    found = {}
    for c, g in enumerate(owner):
        found.setdefault(g, []).append(c)
    return sorted(found.values())


def test_refined_clusters_equal_plain_rules():
    r = np.random.default_rng(7)
    moved_ = 0
    for turn in range(8):
        at = np.concatenate([r.uniform(0, 60, (25, 2)) + r.normal(0, 1.5, (25, 2)) for _ in range(4)]) if turn % 2 else np.tile(r.uniform(0, 60, (25, 2)), (4, 1)) + r.normal(0, 2, (100, 2))
        names = [(s, k) for s in range(4) for k in range(25)]
        owner = [25 * s + k if r.random() < 0.3 else k for s, k in names] if turn else list(range(100))
        dist = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1))
        p = np.exp(-dist / 4) * r.uniform(0.7, 1, (100, 100))
        p = (p + p.T) / 2
        got = cells.refine_clusters(names, at, owner, lambda a, b: p[a][b], 9.0)
        assert parts_of(got) == parts_of(plain_refinement(names, at, owner, p, 9.0))
        assert all(len({names[c][0] for c in m}) == len(m) for m in parts_of(got))
        moved_ += parts_of(got) != parts_of(owner)
    assert moved_ >= 6


def test_moved_footprints_equal_whole_images(spark):
    r = np.random.default_rng(8)
    rows = []
    for k, (y, x) in enumerate([(0, 0), (5, 20), (17, 29), (10, 11)]):
        for dy in range(4):
            for dx in range(3):
                if y + dy < 20 and x + dx < 30 and r.random() < 0.8:
                    rows += [(s, k, (y + dy) * 30 + x + dx, float(r.random())) for s in (0, 1, 2)]
    f = spark.createDataFrame(rows, "session int, k int, p int, a double")
    moves = {0: (0.0, 0.0, 0.0), 1: (2.3, -1.6, 0.0), 2: (-0.5, 1.25, 7.0)}
    got = {}
    for x in sessions.moved(f, moves, (20, 30)).collect():
        got.setdefault((x.session, x.k), np.zeros(600))[x.p] = x.a
    for s, move in moves.items():
        for k in range(4):
            image = np.zeros(600)
            for s_, k_, p, a in rows:
                if (s_, k_) == (s, k):
                    image[p] = a
            want = arrays.warp_image(image.reshape(20, 30), arrays.rigid_matrix((20, 30), *move)).ravel()
            assert np.allclose(got.get((s, k), np.zeros(600)), want, atol=1e-8)


def test_models_of_counted_pairs_equal_those_of_all(spark):
    r = np.random.default_rng(9)
    corr = np.concatenate([np.clip(r.normal(0.8, 0.08, 400), -1, 1), np.clip(r.normal(0.1, 0.2, 400), -1, 1)])
    dist = np.concatenate([r.lognormal(0, 0.4, 400), 12 * np.sqrt(r.random(400))]).clip(0, 12)
    pairs = spark.createDataFrame(pd.DataFrame({"corr": corr, "dist": dist})).repartition(3)
    for feature, whole in (("spatial", cells.fit_spatial_model(corr)), ("centroid", cells.fit_centroid_model(dist, 12.0))):
        model = cells.fit_model(pairs, 12.0, feature)
        assert model.feature == feature and np.abs(model.p_same - whole.p_same).max() < 0.02
        got = cells.with_probability(pairs, model).toPandas()
        assert np.allclose(got["p"], model.probability(got["dist"], got["corr"]))
    assert cells.fit_model(pairs.limit(0), 12.0) is None


def test_what_follows_from_a_distance_is_made_for_places_only(spark):
    assert cells.TOGETHER <= 128  # a task holds the pairs of two rows of cells
    c = spark.createDataFrame([(k % 3, k, float(k % 4), 0.0) for k in range(1_200)], "session int, k int, cy double, cx double")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(dist):
        seen.add(1)
        return round(dist / 3, 3)

    got = cells.session_pairs(c, 1.0, lambda met: met.withColumn("p", counted("dist")).drop("dist"))
    rows = got.collect()
    assert got.columns == ["sa", "i", "sb", "j", "p"] and len(rows) == 3 * 400 * 100 + 3 * 6 * 100 * 100
    assert seen.value < 100 and all(r.p == (0.0 if r.i % 4 == r.j % 4 else 0.333) for r in rows)
    # a crowded cell of the grid is dealt to several tasks
    one = spark.createDataFrame([(k % 2, k, float(k % 50) / 60, 0.0) for k in range(400)], "session int, k int, cy double, cx double")
    pairs = cells.session_pairs(one, 1.0)
    assert pairs.select(F.spark_partition_id().alias("x")).distinct().count() > 1 and pairs.count() == 200 * 200
    near = cells.nearest_within(c, 1.0, shown=1)
    assert near.columns == ["sa", "i", "sb", "j", "dist", "rank", "is_nn"] and near.count() == len(rows)


def test_a_group_is_matched_from_batches_of_its_pairs(spark):
    from pyspark.util import PythonEvalType

    from lumenframe.functions import solvers

    rng = np.random.default_rng(15)
    score = np.where(rng.random((20, 25)) < 0.6, rng.random((20, 25)), -1e6)
    rows = [(0, int(i), 1, 100 + int(j), 1.0, float(score[i, j])) for i, j in zip(*np.nonzero(score > 0))]
    pairs = spark.createDataFrame(rows, "sa int, i int, sb int, j int, dist double, p double")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    keep = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        made = cells.match_sessions(pairs, 4.0, dist_thr=4.0, probability="p", p_thr=0.0)
        plan = made._jdf.queryExecution().optimizedPlan()
        while "FlatMapGroupsInPandas" not in plan.nodeName():
            plan = plan.children().apply(0)
        assert plan.functionExpr().evalType() == PythonEvalType.SQL_GROUPED_MAP_PANDAS_ITER_UDF
        got = made.collect()
    finally:
        spark.conf.set(name, keep)
    best = solvers.assign(-score)
    assert len(got) == 20 == len({r.i for r in got}) == len({r.j for r in got})
    assert sum(r.score for r in got) == pytest.approx(sum(score[i, j] for i, j in best)) and all(r.score == score[r.i, r.j - 100] for r in got)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_tiles_are_read_without_a_shuffle(spark, tmp_path):
    from lumenframe.operators import background, kernels, movies

    r = np.random.default_rng(3)
    movie = r.random((40, 24, 30))
    pixels = spark.createDataFrame([(p, row.tolist()) for p, row in enumerate(movie.reshape(40, -1).T)], "p int, tr array<double>")
    path = str(tmp_path / "tiles")
    store.save_tiles(pixels, path, (24, 30), tile=8, halo=7, ssub=2, orig_dims=[48, 60])
    tiles = store.load_tiles(spark, path)
    assert tiles.facts["T"] == 40 and tiles.facts["ssub"] == 2 and tiles.facts["orig_dims"] == [48, 60]
    own = {x.p: x.tr for x in tiles.own().collect()}
    assert len(own) == 720 and all(np.allclose(own[p], movie.reshape(40, -1)[:, p]) for p in own)
    reach = kernels.corr_pnr_reach(1.0)
    got, want = kernels.corr_pnr(tiles.reaching(reach), 1.0, tile=8), kernels.corr_pnr(movies.with_coordinates(pixels, 30), 1.0, tile=8)
    assert "Exchange" not in plan_of(got) and "Exchange" in plan_of(want)
    got, want = (d.toPandas().sort_values(["y", "x"]).to_numpy() for d in (got, want))
    assert got.shape == want.shape and np.allclose(got, want, equal_nan=True)
    ring = background.ring_regression(tiles.reaching(4), 24, 30, 3.0, tile=8)
    assert "Exchange" not in plan_of(ring)
    whole = background.ring_regression(pixels, 24, 30, 3.0, tile=8)
    a, b = (d.toPandas().sort_values(["p", "q"]).to_numpy() for d in (ring, whole))
    assert np.allclose(a, b)
    # a crop reads the bands that it meets
    files = lambda t: t.pixels.select("_metadata.file_path").distinct().count()
    part = store.load_tiles(spark, path, (9, 15, 0, 30))
    assert 0 < files(part) < files(tiles) and {x.i for x in part.pixels.select("i").distinct().collect()} == {1}
    with pytest.raises(ValueError, match="reaches 9 pixels"):
        tiles.reaching(9)
    store.save_pixels(pixels, str(tmp_path / "p"))
    with pytest.raises(ValueError, match="by tile"):
        store.load_tiles(spark, str(tmp_path / "p"))
    with pytest.raises(ValueError, match="by pixel"):
        store.load_pixels(spark, path)


def test_places_meet_in_place_of_cells(spark):
    """Cells of one place are dealt together: pairs, ranks and hits are those of plain Python, and no side is broadcast."""
    import itertools
    import math

    from lumenframe.operators import cells, evaluate

    rng = np.random.default_rng(8)
    rows = [(int(s), k, float(y), float(x)) for k, (s, y, x) in enumerate(zip(rng.integers(0, 3, 90), rng.integers(-6, 6, 90), rng.integers(0, 6, 90)))]
    c = spark.createDataFrame(rows, "session int, k long, cy double, cx double")
    want = {(a[0], a[1], b[0], b[1]): math.hypot(a[2] - b[2], a[3] - b[3]) for a, b in itertools.permutations(rows, 2) if a[0] < b[0] and math.hypot(a[2] - b[2], a[3] - b[3]) <= 3}
    got = cells.session_pairs(c, 3.0)
    assert {(r.sa, r.i, r.sb, r.j): r.dist for r in got.collect()} == pytest.approx(want) and got.count() == len(want)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    ranked = {}
    for (sa, i, sb, j), d in sorted(want.items(), key=lambda e: (e[0][:3], round(e[1], 9), e[0][3])):
        ranked[sa, i, sb, j] = 1 + sum(k[:3] == (sa, i, sb) for k in ranked)
    near = cells.nearest_within(c, 3.0).collect()
    assert {(r.sa, r.i, r.sb, r.j): r["rank"] for r in near} == ranked and len(near) == len(want) and all(r.is_nn == (r["rank"] == 1) for r in near)
    counts = cells.distance_counts(c, 3.0)
    values, n = np.unique(np.array(list(want.values())), return_counts=True)
    assert counts["dist"].to_numpy() == pytest.approx(values) and (counts["n"] == n).all()
    two = evaluate.two_way_matches(c.where("session = 0"), c.where("session = 1"), 1.0)
    hit = [k for k, d in want.items() if k[0] == 0 and k[2] == 1 and d <= 1]
    assert tuple(two.collect()[0]) == (sum(r[0] == 0 for r in rows), sum(r[0] == 1 for r in rows), len({k[1] for k in hit}), len({k[3] for k in hit}))


def test_flows_equal_matchings_of_single_items():
    from lumenframe.functions import solvers

    r = np.random.default_rng(1)
    for turn in range(60):
        n, m = r.integers(1, 9, 2)
        supply, demand = r.integers(0, 5, n), r.integers(0, 5, m)
        ok = r.random((n, m)) < r.choice([0.2, 0.5, 1.0])
        score = r.random((n, m)) if turn % 2 else r.integers(0, 3, (n, m)) / 2
        order = r.permutation(int(ok.sum()))
        rows, cols = (x[order] for x in np.nonzero(ok))
        flow = solvers.transport(rows, cols, -score[rows, cols], supply, demand)
        assert (flow >= 0).all() and (np.bincount(rows, flow, n) <= supply).all() and (np.bincount(cols, flow, m) <= demand).all()
        cost = np.where(ok, -score, 1e6).repeat(supply, 0).repeat(demand, 1)
        want = [cost[a, b] for a, b in solvers.assign(cost) if cost[a, b] < 1e6]
        assert flow.sum() == len(want) and (flow * score[rows, cols]).sum() == pytest.approx(-sum(want))


def test_crowded_places_are_matched_as_one(spark):
    """A task gets pairs of places, not of cells: 3,000 cells of each session on three places, and a chain of 3,000 cells."""
    rows = [(s, 10_000 * s + k, 10.0 * (k % 3 == 2) + 1.0 * (k % 3), float(s)) for s in (0, 1) for k in range(3_000 + 500 * s)]
    c = spark.createDataFrame(rows, "session int, k long, cy double, cx double")
    at = {k: (y, x) for _, k, y, x in rows}
    seen = []
    keep, cells._dealt = cells._dealt, lambda scored: seen.append(scored.count()) or keep(scored)
    try:
        got = cells.match_places(c, 4.0, F.exp(-F.col("dist") / 8), 4.0, dist_thr=4.0, corr_thr=0.5).collect()
    finally:
        cells._dealt = keep
    assert seen == [5]
    assert len(got) == 3_000 == len({r.i for r in got}) == len({r.j for r in got})
    assert all(r.score == pytest.approx(0.5 * math.exp(-1 / 8) + 0.5 * 0.75) and at[r.i][0] == at[r.j][0] for r in got)
    chain = spark.createDataFrame([(0, k, 1, k + d, 1.0, 0.9 if d else 0.8) for k in range(3_000) for d in (0, 1)], "sa int, i long, sb int, j long, dist double, corr double")
    got = cells.match_sessions(chain, 4.0, dist_thr=4.0, corr_thr=0.5).collect()
    assert {(r.i, r.j) for r in got} == {(k, k + 1) for k in range(3_000)}


def test_pairs_made_in_squares_equal_joined_ones(spark):
    """Metrics made where squares meet are those of joins by pixel, in several shares and parts; groups of squares hold all that pairs connect."""
    r = np.random.default_rng(4)
    rows = []
    for s in range(3):
        for k in range(40):
            y, x, n = int(r.integers(0, 28)), int(r.choice([0, 1, 2, 3, 4, 20, 21, 22])), int(r.integers(1, 4))
            rows += [(s, k, 32 * (y + i // 2) + x + i % 2, float(r.choice([0.5, 0.9, 1.0]))) for i in range(n)]
    f = spark.createDataFrame(rows, "session int, k long, p int, a double")
    y, x = F.expr("p div 32"), F.expr("p % 32")
    centres = f.groupBy("session", "k").agg((F.sum(F.col("a") * y) / F.sum("a")).alias("cy"), (F.sum(F.col("a") * x) / F.sum("a")).alias("cx"))
    keyed = cells.session_pairs(centres, 4.0).select("sa", "sb", "dist", F.struct(F.col("sa").alias("s"), F.col("i").alias("k")).alias("i"), F.struct(F.col("sb").alias("s"), F.col("j").alias("k")).alias("j"))
    prints = f.select(F.struct(F.col("session").alias("s"), "k").alias("k"), "p", "a")
    want = {(r.sa, r.i.k, r.sb, r.j.k): (r.dist, r.corr) for r in cells.footprint_correlation(keyed, prints, prints).collect()}
    keep = cells.SHARE, cells.AT_ONCE
    cells.SHARE, cells.AT_ONCE = 50, 7
    try:
        got = cells.footprint_pairs(cells.cell_rows(f, centres), 4.0).collect()
    finally:
        cells.SHARE, cells.AT_ONCE = keep
    assert len(got) == len(want) > 100
    assert all((g.dist, g.corr) == pytest.approx(want[g.sa, g.i, g.sb, g.j], abs=1e-9) for g in got)
    label = {(r.session, r.k): r.label for r in cells.square_groups(centres, 4.0).collect()}
    assert len(label) == 120 and len(set(label.values())) == 2 and all(label[a, i] == label[b, j] for a, i, b, j in want)


def test_cells_that_stayed_look_at_what_has_changed():
    for seed in range(4):
        r = np.random.default_rng(seed)
        at = np.tile(r.uniform(0, 25, (60, 2)), (3, 1)) + r.normal(0, 2, (180, 2))
        names = [(s, k) for s in range(3) for k in range(60)]
        p = np.minimum(np.exp(-np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1)) / 8) * r.uniform(0.7, 2, (180, 180)), 1)
        p = np.round((p + p.T) / 2, 1 if seed % 2 else 9)
        asked = []
        got = cells.refine_clusters(names, at, list(range(180)), None, 9.0, p_row=lambda c, m: asked.append(len(m)) or p[c][m], p_most=float(p.max()))
        assert parts_of(got) == parts_of(plain_refinement(names, at, list(range(180)), p, 9.0)) and sum(asked) > 0
