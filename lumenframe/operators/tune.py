"""Suggestions for parameters from data, grids of candidates, and the search over them."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.functions import arrays
from lumenframe.operators.components import correlation_quantiles
from lumenframe.params import Params

#: Thresholds used where the data decide nothing.
SAFE_CORR, SAFE_PNR = 0.8, 10.0


def max_shift(shifts: DataFrame, margin: int = 2) -> DataFrame:
    """(dy, dx): 99th percentile of the absolute shifts of each axis, rounded up, and a margin."""
    one = lambda c: (F.ceil(F.percentile(F.abs(c), F.lit(0.99))) + margin).cast("int").alias(c)
    return shifts.agg(one("dy"), one("dx"))


def downsampling(spark: SparkSession, sigma: float, rate_hz: float, decay_ms: float, min_fwhm: float = 4.0, max_ssub: int = 4, max_tsub: int = 5) -> DataFrame:
    """(ssub, tsub): largest bins that leave min_fwhm pixels across a cell and two frames in a decay time."""
    s = spark.range(1, max_ssub + 1).agg(F.max(F.when(2.355 * sigma / F.col("id") >= min_fwhm, F.col("id"))).alias("s"))
    t = spark.range(1, max_tsub + 1).agg(F.max(F.when(1000.0 / rate_hz * F.col("id") <= decay_ms / 2, F.col("id"))).alias("t"))
    return s.crossJoin(t).select(F.coalesce("s", F.lit(1)).cast("int").alias("ssub"), F.coalesce("t", F.lit(1)).cast("int").alias("tsub"))  # one row each


def downsampling_of(cells: DataFrame, rate_hz: float, min_fwhm: float = 4.0, max_ssub: int = 4, max_tsub: int = 5) -> DataFrame:
    """cells (sigma, decay_ms, ...) with ssub and tsub by the rule of `downsampling`, each row by itself."""
    bins = lambda most, c: F.greatest(F.lit(1), F.least(F.lit(most), F.floor(c))).cast("int")
    return cells.withColumns({"ssub": bins(max_ssub, 2.355 * F.col("sigma") / min_fwhm), "tsub": bins(max_tsub, F.col("decay_ms") * rate_hz / 2000.0)})


def youden(values: DataFrame, grid: list[float]) -> DataFrame:
    """(thr, j): the threshold of the grid with the largest share of cells kept less share of background kept.

    values: (v, is_cell). Ties go to the smallest threshold. The grid is an array on each row's way into one
    aggregation, no join.
    """
    hits = [F.avg(F.when(F.col("is_cell"), (F.col("v") >= t).cast("double"))) - F.avg(F.when(~F.col("is_cell"), (F.col("v") >= t).cast("double"))) for t in grid]
    rows = values.agg(F.array(*[F.struct(F.lit(float(t)).alias("thr"), h.alias("j")) for t, h in zip(grid, hits)]).alias("g"))
    return rows.select(F.explode("g").alias("g")).select("g.thr", "g.j").orderBy(F.desc(F.round("j", 9)), "thr").limit(1)


def threshold_at_percentile(values: DataFrame, percent: float = 25.0, floor: float = 0.4, safe: float = SAFE_CORR, least: int = 5) -> DataFrame:
    """(thr, edge): percentile of the cells' values; the safe value with too few cells or at the floor."""
    q = values.agg(F.count("*").alias("n"), F.percentile("v", F.lit(percent / 100)).alias("q"))
    edge = F.coalesce(F.col("q") <= floor, F.lit(False))
    return q.select(F.when((F.col("n") < least) | edge, safe).otherwise(F.col("q")).alias("thr"), edge.alias("edge"))


def prior_weight(g: DataFrame, rate_hz: float, decay_ms: float) -> DataFrame:
    """(spread, weight): 0.3, 0.5 or 0.7 by the median relative deviation from the physical coefficient."""
    goal = math.exp(-1000.0 / (rate_hz * decay_ms))
    s = g.agg(F.median(F.abs((F.col("g") - goal) / goal)).alias("spread"))
    return s.withColumn("weight", F.when(F.col("spread") < 0.05, 0.3).when(F.col("spread") < 0.15, 0.5).otherwise(0.7))


def decay_time(g: DataFrame, rate_hz: float) -> DataFrame:
    """(tau): median decay time in ms."""
    from lumenframe.functions.sql import g_to_decay

    return g.agg(F.median(g_to_decay(F.col("g"), rate_hz)).alias("tau"))


def merge_threshold(traces: DataFrame, value: str = "v") -> DataFrame:
    """(p99, thr): the 99th percentile of pair correlations, kept within 0.7 and 0.85."""
    p99 = correlation_quantiles(traces, [0.99], value)
    r = traces.sparkSession.createDataFrame([tuple(p99)], "p99 double")
    return r.withColumn("thr", F.coalesce(F.least(F.lit(0.85), F.greatest("p99", F.lit(0.7))), F.lit(0.85)))


def snr_gap(metrics: DataFrame, snr: str = "snr_amp", top: float = 10.0, current: float = 0.0) -> DataFrame:
    """(thr): centre of the largest gap among the values under top, to one decimal; the current one without a gap."""
    low = metrics.where(F.col(snr) < top)
    gaps = low.select(F.col(snr).alias("a"), F.lead(snr).over(Window.orderBy(snr)).alias("b")).where("b is not null")
    best = gaps.agg(F.max(F.struct((F.col("b") - F.col("a")).alias("gap"), (-F.col("a")).alias("low"), "b")).alias("g"))
    return best.select(F.coalesce(F.bround((F.col("g.b") - F.col("g.low")) / 2, 1), F.lit(float(current))).alias("thr"))


def min_pixel(footprints: list[np.ndarray], peak: float = 0.05, percent: float = 25.0) -> tuple[int, dict]:
    """(fewest pixels, evidence): a low percentile of the pixels over a share of each footprint's peak; 3 without any."""
    if not len(footprints):
        return 3, {"pixel_counts": np.empty(0), "K": 0, "p25": 3, "p50": 3}
    counts = np.array([int((f > peak * f.max()).sum()) for f in footprints])
    low, mid = int(np.percentile(counts, percent)), int(np.percentile(counts, 50))
    return max(1, low), {"pixel_counts": counts, "K": len(counts), "p25": low, "p50": mid}


def at_edge(position: int, n: int, share: float = 0.05) -> bool:
    """Whether a maximum lies in the first part of its axis, where the data decide nothing."""
    return position <= int(share * (n - 1))


def celllike_counts(image: np.ndarray, grid: np.ndarray, least: float, most: float, min_solidity: float = 0.85) -> np.ndarray:
    """Regions of a cell's size and shape at each threshold."""
    out = []
    for t in grid:
        regions = arrays.label(image >= t, diagonal=True)
        n = 0
        for r in range(1, int(regions.max(initial=0)) + 1):
            y, x = np.nonzero(regions == r)
            n += least <= len(y) <= most and len(y) / arrays.hull_area(y, x) >= min_solidity
        out.append(n)
    return np.array(out)


def celllike_threshold(image: np.ndarray, sigma: float, floor: float, safe: float, steps: int = 30, min_solidity: float = 0.85) -> tuple[float, bool]:
    """(threshold with most cell-like regions, whether it lies at the edge and gave way to the safe value)."""
    grid = np.linspace(floor, max(float(np.nanmax(image)), floor + 1e-6), steps)
    area = math.pi * sigma * sigma
    counts = celllike_counts(image, grid, max(3, int(0.5 * area)), 9 * area, min_solidity)
    best = int(np.argmax(counts))
    edge = at_edge(best, steps) or counts[best] == 0
    return (safe if edge else float(grid[best])), bool(edge)


def neuron_radius(image: np.ndarray, low: float = 2, high: float = 15, steps: int = 10, threshold: float = 0.05, top: int = 30) -> float:
    """Median scale of the strongest blobs of an image; half way up the range without any."""
    a = (image - image.min()) / max(image.max() - image.min(), 1e-12)
    found = arrays.blobs(a, low, high, steps, threshold)
    return float(np.median(found[:top, 2])) if len(found) else (low + high) / 2


def cells_and_background(image: pd.DataFrame, sigma: float, shape: tuple[int, int], factor: float = 2.0) -> pd.DataFrame:
    """(y, x, cn, pnr, is_cell): blob centres of cn * pnr, and pixels far from all of them."""
    cn, pnr = np.zeros(shape), np.zeros(shape)
    cn[image["y"], image["x"]], pnr[image["y"], image["x"]] = image["cn"], image["pnr"]
    product = np.maximum(np.nan_to_num(cn), 0) * np.nan_to_num(pnr)
    product = (product - product.min()) / max(product.max() - product.min(), 1e-12)
    at = arrays.blobs(product, max(1.0, 0.7 * sigma), 1.5 * sigma, 5)[:, :2].astype(int)
    centre = np.zeros(shape, bool)
    centre[at[:, 0], at[:, 1]] = True
    reach = max(1, round(factor * sigma))
    y, x = np.mgrid[-reach : reach + 1, -reach : reach + 1]
    near = arrays.dilate(centre, y * y + x * x <= reach * reach)
    yy, xx = np.nonzero(centre | ~near)
    return pd.DataFrame({"y": yy, "x": xx, "cn": cn[yy, xx], "pnr": pnr[yy, xx], "is_cell": centre[yy, xx]})


# ---------------------------------------------------------------- grids


def offset_grid(spec, anchor: float, floor: float, around=(0,), whole: bool = False, top: float | None = None) -> list[float]:
    """Sorted values about an anchor: None, {"around": offsets, "extra": values}, a list of values, or one value.

    The anchor is always among them; all values are kept within floor and top.
    """
    base = max(floor, float(round(anchor)) if whole else float(anchor))
    if spec is None:
        offsets, extra = around, ()
    elif isinstance(spec, dict):
        offsets, extra = spec.get("around", (0,)), spec.get("extra", ())
    else:
        offsets, extra = (0,), spec if isinstance(spec, (list, tuple)) else (spec,)
    limit = math.inf if top is None else top
    return sorted({min(limit, max(floor, float(v))) for v in [*(base + o for o in offsets), *extra]})


def offset_grids(anchors: DataFrame, offsets: list[float], floor: float, top: float) -> DataFrame:
    """anchors (..., anchor) with grid: the same for a column of anchors."""
    values = F.transform(F.array(*[F.lit(float(o)) for o in offsets]), lambda o: F.least(F.greatest(F.greatest(F.col("anchor"), F.lit(floor)) + o, F.lit(floor)), F.lit(top)))
    return anchors.withColumn("grid", F.array_sort(F.array_distinct(values)))


@dataclass(frozen=True)
class SweepSpec:
    """Values to try of each setting; None leaves it."""

    sigma: list[float] | None = None
    min_corr: list[float] | None = None
    min_pnr: list[float] | None = None
    merge_thr_corr: list[float] | None = None
    global_bg_rank: list[int] | None = None
    init_stride: list[int] | None = None

    def active(self) -> dict[str, list]:
        return {k: list(v) for k, v in vars(self).items() if v}


def candidates(base: Params, spec: SweepSpec, budget: int = 24, seeds: list[dict] | None = None) -> list[tuple[Params, str | None]]:
    """(params, name of the seed): the full grid if it fits the budget, else one setting at a time about the base.

    Seeds set min_corr and min_pnr (and sigma) together, and share the budget.
    """
    active, starts = spec.active(), seeds or [{}]
    share = max(1, budget // len(starts))
    if math.prod(len(v) for v in active.values()) <= share:
        combos = [dict(zip(active, v)) for v in itertools.product(*active.values())]
    else:
        combos = [{}, *({k: v} for k, values in active.items() for v in values if v != getattr(base, k))]
    coupled = lambda s: {k: float(s[k]) for k in ("min_corr", "min_pnr", "sigma") if s.get(k) is not None}
    return [(replace(base, **{**c, **coupled(s)}), s.get("thr_method")) for s in starts for c in combos]


def candidate_grid(spark: SparkSession, active: dict[str, list]) -> DataFrame:
    """(idx, one column for each setting): the full grid as a table, indexed in row-major order."""
    sizes = [len(v) for v in active.values()]
    total = math.prod(sizes)
    grid, below = spark.range(total).select(F.col("id").cast("int").alias("idx")), total
    for name, values in active.items():
        below //= len(values)
        grid = grid.withColumn(name, F.array(*map(F.lit, values))[F.expr(f"cast(idx div {below} % {len(values)} as int)")])
    return grid


def ranked(rows: DataFrame) -> DataFrame:
    """Rows (idx, score, error) by score, failed ones last."""
    clean = F.when(F.col("error").isNull() & ~F.isnan("score"), F.col("score")).otherwise(float("-inf"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(clean), "idx")))


def pick(rows: DataFrame) -> DataFrame:
    """The best trial (score, error, saturated, beats_raw): of the clean ones, else of those that ended, else of all."""
    tier = F.when(F.col("error").isNull() & ~F.col("saturated") & F.col("beats_raw"), 0).when(F.col("error").isNull() & ~F.isnan("score"), 1).otherwise(2)
    return rows.withColumn("tier", tier).orderBy("tier", F.desc(F.nanvl("score", F.lit(float("-inf")))), "idx").limit(1).drop("tier")


def run_sweep(spark: SparkSession, tries: list[Params], fit: Callable[[Params], float]) -> DataFrame:
    """(idx, params, score, error) by score: one task for each candidate, whose errors become rows."""
    rows = spark.createDataFrame([(i, p.to_json()) for i, p in enumerate(tries)], "idx int, params string").repartition(max(1, len(tries)), "idx")

    def attempt(part: pd.DataFrame) -> pd.DataFrame:
        try:
            score, error = float(fit(Params.from_json(part["params"].iloc[0]))), None
        except Exception as e:
            score, error = float("-inf"), f"{type(e).__name__}: {e}"
        return part.assign(score=score, error=error)

    return ranked(rows.groupBy("idx").applyInPandas(attempt, "idx int, params string, score double, error string"))


def search_motion(score: Callable[[float, tuple[int, int], int], tuple[float, float]], raw_score: float, gsigs: list[float], shifts: list[tuple[int, int]], iterations: list[int], saturation: float = 0.95) -> tuple[dict, list[dict]]:
    """(best row, all rows) of a coarse-to-fine search: filter width at the loosest shift, then shift, then passes.

    score(gsig, max_shift, n_iter) gives (score, 99th percentile of the shifts); equal trials run once.
    """
    done: dict[tuple, dict] = {}

    def trial(g, s, n):
        if (g, s, n) not in done:
            try:
                value, p99 = score(g, s, n)
                error = None
            except Exception as e:
                value, p99, error = float("-inf"), float("nan"), str(e)
            done[g, s, n] = {"gsig": g, "max_shift": s, "n_iter": n, "score": value, "error": error, "saturated": p99 >= saturation * min(s), "beats_raw": value >= raw_score * (1 - 1e-3)}
        return done[g, s, n]

    def best(rows):
        order = lambda r: (r["error"] is None and not r["saturated"] and r["beats_raw"], r["error"] is None, r["score"])
        return max(rows, key=order)

    loose, first = max(shifts, key=min), iterations[0]
    g = best([trial(g, loose, first) for g in gsigs])["gsig"]
    s = best([trial(g, s, first) for s in shifts])["max_shift"]
    found = best([trial(g, s, n) for n in iterations])
    return found, list(done.values())
