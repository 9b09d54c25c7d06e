"""Reshaping, cropping, resampling and repairing movies in long form: (t, y, x, v), one row for each value.

Every function takes `by`, the columns that tell recordings apart (none: one recording).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.functions import arrays


def with_pixel(movie: DataFrame, width: int) -> DataFrame:
    """Adds p = y * width + x."""
    return movie.withColumn("p", F.col("y") * width + F.col("x"))


def with_coordinates(pixels: DataFrame, width: int) -> DataFrame:
    """Adds y and x of p."""
    return pixels.withColumn("y", F.expr(f"cast(p div {width} as int)")).withColumn("x", F.expr(f"cast(p % {width} as int)"))


def frames_of(movie: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row for each frame: (by, t, px array in row-major order)."""
    return movie.groupBy(*by, "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"]).alias("px"))


def pixels_of(movie: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row for each pixel: (by, y, x, tr array over time): the transpose of frames."""
    return movie.groupBy(*by, "y", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda s: s["v"]).alias("tr"))


def transposed(frames: DataFrame, block: int = 256, kind: str = "float64") -> DataFrame:
    """(p, tr) of frames (t, px): the physical transpose, moved as packed blocks and never as single values.

    A batch of frames is cut into blocks of pixels; a block's parts meet in one task and are ordered by time.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, t = np.stack(batch["px"].to_list()).astype(kind), batch["t"].to_numpy(np.int64).tobytes()
                starts = range(0, x.shape[1], block)
                yield pd.DataFrame({"b": list(starts), "t": [t] * len(starts), "v": [np.ascontiguousarray(x[:, s : s + block]).tobytes() for s in starts]})

    def join(part: pd.DataFrame) -> pd.DataFrame:
        times = [np.frombuffer(t, np.int64) for t in part["t"]]
        x = np.concatenate([np.frombuffer(v, kind).reshape(len(t), -1) for v, t in zip(part["v"], times)])
        x = x[np.argsort(np.concatenate(times), kind="stable")].T.astype(float)
        return pd.DataFrame({"p": part["b"].iloc[0] + np.arange(len(x)), "tr": list(x)})

    return frames.select("t", "px").mapInPandas(cut, "b int, t binary, v binary").groupBy("b").applyInPandas(join, "p int, tr array<double>")


def long_of_frames(frames: DataFrame, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Back from frames to (by, t, y, x, v)."""
    return with_coordinates(frames.select(*by, "t", F.posexplode("px").alias("p", "v")), width).select(*by, "t", "y", "x", F.col("v").cast("double").alias("v"))


def long_of_pixels(pixels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return pixels.select(*by, F.posexplode("tr").alias("t", "v"), "y", "x").select(*by, "t", "y", "x", F.col("v").cast("double").alias("v"))


def crop(movie: DataFrame, t0: int, t1: int, y0: int, y1: int, x0: int, x1: int, mask: DataFrame | None = None) -> DataFrame:
    """The half-open box, with coordinates from its corner; values outside of the mask (y, x) become 0."""
    box = movie.where(f"t >= {t0} and t < {t1} and y >= {y0} and y < {y1} and x >= {x0} and x < {x1}")
    if mask is not None:
        inside = mask.select("y", "x", F.lit(True).alias("inside")).distinct()
        box = box.join(inside, ["y", "x"], "left").withColumn("v", F.when(F.col("inside"), F.col("v")).otherwise(0.0)).drop("inside")
    return box.withColumns({"t": F.col("t") - t0, "y": F.col("y") - y0, "x": F.col("x") - x0})


def crop_arrays(movie: DataFrame, shape: tuple[int, int], t_range: tuple[int, int], box: tuple[int, int, int, int], mask: np.ndarray | None = None) -> DataFrame:
    """The box (y0, y1, x0, x1) and time range of frames (t, px) or pixels (p, tr), numbered from its corner.

    Values outside of the mask, an array of the box's shape, become 0. The mask is one frame, and is sent once.
    """
    (t0, t1), (y0, y1, x0, x1), width = t_range, box, shape[1]
    h, w = y1 - y0, x1 - x0
    if "px" in movie.columns:
        inside = movie.sparkSession.sparkContext.broadcast(np.ones((h, w)) if mask is None else np.asarray(mask, float).reshape(h, w))

        @F.pandas_udf("array<double>")
        def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series([(np.asarray(px, float).reshape(shape)[y0:y1, x0:x1] * inside.value).ravel() for px in batch], dtype=object)

        return movie.where(f"t >= {t0} and t < {t1}").select((F.col("t") - t0).alias("t"), cut("px").alias("px"))
    y, x = F.expr(f"p div {width}"), F.expr(f"p % {width}")
    own = movie.where((y >= y0) & (y < y1) & (x >= x0) & (x < x1)).select(((y - y0) * w + x - x0).cast("int").alias("p"), F.slice("tr", t0 + 1, t1 - t0).alias("tr"))
    if mask is None:
        return own
    kept = movie.sparkSession.createDataFrame(pd.DataFrame({"q": np.flatnonzero(mask)}), "q int")
    joined = own.join(kept, own["p"] == kept["q"], "left")
    return joined.select("p", F.when(F.col("q").isNotNull(), F.col("tr")).otherwise(F.transform("tr", lambda v: v * 0.0)).alias("tr"))


def place_footprints(footprints: DataFrame, box: tuple[int, int, int, int], width: int) -> DataFrame:
    """Footprints (k, p, a) of a crop (y0, y1, x0, x1) on the full field of that width."""
    y0, _, x0, x1 = box
    own = x1 - x0
    return footprints.withColumn("p", F.expr(f"(p div {own} + {y0}) * {width} + p % {own} + {x0}"))


def place_traces(traces: DataFrame, t0: int, n_t: int, value: str = "c") -> DataFrame:
    """Traces (k, t, value) of a window on the full timeline, zero elsewhere."""
    grid = traces.select("k").distinct().select("k", F.explode(F.sequence(F.lit(0), F.lit(n_t - 1))).alias("t"))
    moved = traces.select("k", (F.col("t") + t0).alias("t"), value)
    return grid.join(moved, ["k", "t"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def spaced(n: int, most: int) -> list[int]:
    """At most that many evenly spaced numbers of 0 .. n - 1, both ends included, rounded down."""
    return list(range(n)) if n <= most else [i * (n - 1) // (most - 1) if most > 1 else 0 for i in range(most)]


def sample_frames(movie: DataFrame, n_t: int, most: int) -> DataFrame:
    """Frames at evenly spaced times; the list is folded into the scan's filter."""
    return movie.where(F.col("t").isin(spaced(n_t, most)))


def block_mean(movie: DataFrame, ssub: int, tsub: int, n_t: int, height: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean over blocks of tsub frames and ssub x ssub pixels; incomplete blocks are left out."""
    whole = movie.where((F.col("t") < n_t // tsub * tsub) & (F.col("y") < height // ssub * ssub) & (F.col("x") < width // ssub * ssub))
    cell = lambda c, n: F.expr(f"cast({c} div {n} as int)").alias(c)
    return whole.groupBy(*by, cell("t", tsub), cell("y", ssub), cell("x", ssub)).agg(F.avg("v").alias("v"))


def file_bins(frames: DataFrame, tsub: int, by: Sequence[str] = ("file_no",)) -> DataFrame:
    """Means of each file's consecutive tsub frames (local_t); a file's last incomplete bin is left out."""
    binned = frames.groupBy(*by, F.expr(f"cast(local_t div {tsub} as int)").alias("bin"), "y", "x").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    return binned.where(F.col("n") == tsub).drop("n")


def upsample_traces(traces: DataFrame, n_from: int, n_to: int, value: str = "v") -> DataFrame:
    """Linear interpolation of (k, t, value) from n_from samples to n_to with both ends kept."""
    pos = F.col("u") * float(n_from - 1) / float(max(1, n_to - 1))
    ahead = F.coalesce(F.lead(value).over(Window.partitionBy("k").orderBy("t")), F.col(value))
    pairs = traces.select("k", "t", value, ahead.alias("ahead"))
    grid = traces.select("k").distinct().select("k", F.explode(F.sequence(F.lit(0), F.lit(n_to - 1))).alias("u"))
    at = grid.withColumn("pos", pos).withColumn("t", F.floor("pos").cast("int"))
    return at.join(pairs, ["k", "t"]).select("k", F.col("u").alias("t"), (F.col(value) + (F.col("pos") - F.col("t")) * (F.col("ahead") - F.col(value))).alias(value))


def frame_means(movie: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return movie.groupBy(*by, "t").agg(F.avg("v").alias("m"))


def outlier_frames(means: DataFrame, k_mad: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """(by, t, m, outlier): frames whose mean is over k * 1.4826 * MAD from the median; none if the MAD is 0."""
    keys = list(by)
    middle = means.groupBy(*keys).agg(F.median("m").alias("med"))
    near = means.join(F.broadcast(middle), keys) if keys else means.crossJoin(F.broadcast(middle))
    mads = near.groupBy(*keys).agg(F.median(F.abs(F.col("m") - F.col("med"))).alias("mad"))
    both = near.join(F.broadcast(mads), keys) if keys else near.crossJoin(F.broadcast(mads))
    off = (F.col("mad") > 0) & (F.abs(F.col("m") - F.col("med")) > k_mad * 1.4826 * F.col("mad"))
    return both.select(*keys, "t", "m", off.alias("outlier"))


def outlier_runs(flags: DataFrame, longest: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(by, t, run_id, run_length, interp_ok) of the flagged frames: consecutive ones are a run."""
    w = Window.partitionBy(*by).orderBy("t") if by else Window.orderBy("t")
    only = flags.where("outlier").withColumn("island", F.col("t") - F.row_number().over(w))
    lengths = only.groupBy(*by, "island").agg(F.count("*").alias("run_length"))
    runs = lengths.withColumn("run_id", F.row_number().over((Window.partitionBy(*by) if by else Window).orderBy("island")) - 1)
    return only.join(runs, [*by, "island"]).select(*by, "t", "run_id", "run_length", (F.col("run_length") <= longest).alias("interp_ok"))


#: Frames of a span that a window runs over.
SPAN = 1 << 16


def repair_plan(flags: DataFrame, by: Sequence[str] = (), span: int = SPAN) -> DataFrame:
    """(by, t, left, right, alpha) of each flagged frame: nearest good frames and the weight of the right one.

    One side alone stands for both; without any good frame both are null. Windows run over spans of frames, in which a flagged
    frame looks back and, in descending order, ahead. What lies beyond a
    span comes from a row for each span.
    """
    good = F.when(~F.col("outlier"), F.col("t"))
    dealt = flags.select(*by, "t", "outlier", F.floor(F.col("t") / span).alias("span"))
    inner, outer = Window.partitionBy(*by, "span"), Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    # running values only: a frame that reaches to the end of its window is made anew for every row
    back, ahead = outer.orderBy("span").rowsBetween(Window.unboundedPreceding, -1), outer.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy(*by, "span").agg(F.min(good).alias("first"), F.max(good).alias("last"))
    ends = ends.select(*by, "span", F.max("last").over(back).alias("before"), F.min("first").over(ahead).alias("after"))
    left = F.max(good).over(inner.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    right = F.min(good).over(inner.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0))
    found = dealt.select(*by, "span", "t", "outlier", left.alias("l"), right.alias("r")).where("outlier").join(ends, [*by, "span"])
    found = found.withColumns({"l": F.coalesce("l", "before"), "r": F.coalesce("r", "after")})
    alpha = F.when(F.col("l").isNull() | F.col("r").isNull(), 0.0).otherwise((F.col("t") - F.col("l")) / (F.col("r") - F.col("l")))
    return found.select(*by, "t", F.coalesce("l", "r").alias("left"), F.coalesce("r", "l").alias("right"), alpha.cast("double").alias("alpha"))


def reject_outliers(movie: DataFrame, k_mad: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """The movie with outlier frames replaced by interpolation between the nearest good ones.

    The plan has a row for each outlier only; good frames pass without a shuffle when the planner broadcasts it.
    """
    plan = repair_plan(outlier_frames(frame_means(movie, by), k_mad, by), by).where("left is not null")
    kept = movie.join(plan.select(*by, "t"), [*by, "t"], "left_anti").select(*by, "t", "y", "x", "v")
    sides = plan.select(*by, F.col("t").alias("to"), F.explode(F.array(F.struct(F.col("left").alias("t"), (1 - F.col("alpha")).alias("w")), F.struct(F.col("right").alias("t"), F.col("alpha").alias("w")))).alias("s"))
    parts = sides.select(*by, "to", "s.t", "s.w").join(movie, [*by, "t"])
    return kept.unionByName(parts.groupBy(*by, F.col("to").alias("t"), "y", "x").agg(F.sum(F.col("w") * F.col("v")).alias("v")))


def rolling_detrend(movie: DataFrame, window: int, percentile: float = 10.0, stride: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, t, y, x, v, base): each pixel less its rolling percentile, interpolated between anchors.

    A pixel is one row of arrays; percentiles are taken at the anchors only, for a batch of pixels at once.
    """
    if window < 2:
        raise ValueError("the window is at least 2 frames")

    @F.pandas_udf("array<double>")
    def baseline(traces: pd.Series) -> pd.Series:
        out: list = [None] * len(traces)
        lengths = traces.map(len).to_numpy()
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            found = arrays.rolling_baseline(np.stack(traces.iloc[at].to_list()).astype(float), window, percentile, stride)
            for i, row in zip(at, found):
                out[i] = row
        return pd.Series(out, dtype=object)

    pixels = movie.groupBy(*by, "y", "x").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s")).select(*by, "y", "x", F.col("s.t").alias("ts"), F.col("s.v").alias("vs"))
    rows = pixels.withColumn("bs", baseline("vs"))
    each = F.explode(F.arrays_zip("ts", "vs", "bs")).alias("e")
    return rows.select(*by, "y", "x", each).select(*by, F.col("e.ts").alias("t"), "y", "x", (F.col("e.vs") - F.col("e.bs")).alias("v"), F.col("e.bs").alias("base"))


def linear_detrend(traces: DataFrame, value: str = "v", by: Sequence[str] = ("k",)) -> DataFrame:
    """(by, t, value) less its least-squares line over time."""
    line = traces.groupBy(*by).agg(F.regr_slope(value, "t").alias("slope"), F.regr_intercept(value, "t").alias("intercept"))
    return traces.join(line, list(by)).select(*by, "t", (F.col(value) - F.col("intercept") - F.col("slope") * F.col("t")).alias(value))


def mean_projection(movie: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, y, x, mean, sd, top): projections over time."""
    return movie.groupBy(*by, "y", "x").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.max("v").alias("top"))


def to_bytes(movie: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Values as integers 0 to 255: from the minimum to the 99.5th percentile, clipped above."""
    keys = list(by)
    range_ = movie.groupBy(*keys).agg(F.min("v").alias("lo"), F.percentile("v", F.lit(0.995)).alias("hi"))
    m = movie.join(F.broadcast(range_), keys) if keys else movie.crossJoin(F.broadcast(range_))
    scaled: Column = (F.col("v") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9)) * 255
    return m.select(*keys, "t", "y", "x", F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0))).cast("int").alias("v"))


def densest_box(image: DataFrame, height: int, width: int, value: str = "cn") -> DataFrame:
    """(y, x, total): the corner of the height x width box with the largest sum, the first of equals.

    Sums of boxes come from prefix sums along rows and then columns: an integral image by two windows.
    """
    row = Window.partitionBy("y").orderBy("x").rowsBetween(0, width - 1)
    col = Window.partitionBy("x").orderBy("y").rowsBetween(0, height - 1)
    rows = image.select("y", "x", F.sum(value).over(row).alias("s"), F.count(value).over(row).alias("n")).where(F.col("n") == width)
    boxes = rows.select("y", "x", F.sum("s").over(col).alias("total"), F.count("s").over(col).alias("n")).where(F.col("n") == height)
    return boxes.orderBy(F.desc(F.round("total", 9)), "y", "x").limit(1).select("y", "x", "total")


def busiest_window(movie: DataFrame, n_frames: int, by: Sequence[str] = ("y", "x")) -> DataFrame:
    """(t0, t1, centre, activity): the window of n_frames around the most active frame of a movie, inside it.

    A frame's activity is the mean squared distance of its values from their pixels' medians; of equals the first
    counts. A movie of fewer frames is the window itself. An empty one gives nulls.
    """
    level = movie.groupBy(*by).agg(F.median("v").alias("level"))
    frames = movie.join(level, list(by)).groupBy("t").agg(F.avg((F.col("v") - F.col("level")) ** 2).alias("activity"))
    best = frames.agg(F.max(F.struct(F.round("activity", 9).alias("activity"), (-F.col("t")).alias("before"))).alias("best"), (F.max("t") + 1).alias("n_t"))
    start = F.greatest(F.lit(0), F.least(-F.col("best.before") - n_frames // 2, F.col("n_t") - n_frames)).cast("int")
    return best.select(start.alias("t0"), F.least(start + n_frames, F.col("n_t")).cast("int").alias("t1"), (-F.col("best.before")).cast("int").alias("centre"), F.col("best.activity").alias("activity"))


def preview_box(image: DataFrame, movie: DataFrame, shape: tuple[int, int], size: tuple[int, int], n_frames: int, value: str = "cn") -> dict:
    """{"box": (y0, y1, x0, x1), "t_range": (t0, t1)} to try settings on: the densest box of an image, and the busiest window.

    Both are cut to what the field and the movie have.
    """
    height, width = min(size[0], shape[0]), min(size[1], shape[1])
    row, span = densest_box(image, height, width, value).collect(), busiest_window(movie, n_frames).collect()[0]
    y, x = (row[0]["y"], row[0]["x"]) if row else (0, 0)
    return {"box": (y, y + height, x, x + width), "t_range": (span["t0"] or 0, span["t1"] or 0)}
