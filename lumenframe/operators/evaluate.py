"""Component metrics and quality of runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.functions import arrays


def component_snr(footprints: DataFrame, noise: DataFrame, min_pixel: int = 1, snr_thr: float = 3.0) -> DataFrame:
    """(k, npix, snr_amp, keep): mean energy of a footprint over the mean noise variance on its support."""
    both = footprints.where("a > 0").join(noise, "p", "left").groupBy("k").agg(F.count("*").alias("npix"), F.sum(F.col("a") ** 2).alias("e"), F.avg(F.col("sn") ** 2).alias("s2"))
    snr = F.col("e") / F.col("npix") / F.greatest(F.coalesce("s2", F.lit(0.0)), F.lit(1e-12))
    return both.select("k", "npix", snr.alias("snr_amp")).withColumn("keep", (F.col("npix") >= min_pixel) & (F.col("snr_amp") >= snr_thr))


def peak_snr(traces: DataFrame, signal: str = "v", rest: str = "yra") -> DataFrame:
    """(k, peak_snr): maximum of the three-frame mean of signal + rest (zeros at the ends) over 1.4826 MAD of the rest."""
    w = Window.partitionBy("k")
    x = traces.withColumn("y", F.col(signal) + F.col(rest))
    x = x.withColumn("smooth", F.sum("y").over(w.orderBy("t").rowsBetween(-1, 1)) / 3)
    med = x.groupBy("k").agg(F.median(rest).alias("med"), F.max("smooth").alias("peak"))
    mad = x.join(med, "k").groupBy("k").agg(F.median(F.abs(F.col(rest) - F.col("med"))).alias("mad"), F.first("peak").alias("peak"))
    return mad.select("k", F.when(F.col("mad") > 0, F.col("peak") / (1.4826 * F.col("mad"))).otherwise(0.0).alias("peak_snr"))


def trace_moments(traces: DataFrame, value: str = "v") -> DataFrame:
    """(k, skew, kurtosis) with the corrections for bias; NaN under 3 and 4 samples."""
    m = traces.groupBy("k").agg(F.count("*").cast("double").alias("n"), F.skewness(value).alias("g1"), F.kurtosis(value).alias("g2"))
    n = F.col("n")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(float("nan"))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).otherwise(float("nan"))
    return m.select("k", skew.alias("skew"), kurt.alias("kurtosis"))


def autocorrelation(traces: DataFrame, value: str = "v") -> DataFrame:
    """(k, autocorr_lag1): centred lag-one product over the centred square; 0 for constant traces."""
    w = Window.partitionBy("k")
    x = traces.select("k", "t", (F.col(value) - F.avg(value).over(w)).alias("x"))
    x = x.withColumn("before", F.lag("x").over(w.orderBy("t")))
    s = x.groupBy("k").agg(F.sum(F.col("x") * F.col("before")).alias("s1"), F.sum(F.col("x") ** 2).alias("s0"))
    return s.select("k", F.when(F.col("s0") > 0, F.col("s1") / F.col("s0")).otherwise(0.0).alias("autocorr_lag1"))


def correlation_by(df: DataFrame, a: str, b: str, key: str = "k", name: str = "r") -> DataFrame:
    """(key, name): Pearson of two columns, 0 where one is constant."""
    # not `corr`, which divides by 0 for a constant column
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    sums = df.groupBy(key).agg(F.covar_pop(a, b).alias("ab"), F.stddev_pop(F.when(both, F.col(a))).alias("sa"), F.stddev_pop(F.when(both, F.col(b))).alias("sb"))
    r = F.when((F.col("sa") > 0) & (F.col("sb") > 0), F.col("ab") / (F.col("sa") * F.col("sb")))
    return sums.select(key, F.when(r.isNull() | F.isnan(r), 0.0).otherwise(r).alias(name))


def boxes(footprints: DataFrame, width: int, pad: int = 4) -> DataFrame:
    """(k, y0, y1, x0, x1): padded bounding boxes, ends included."""
    y, x = F.expr(f"cast(p div {width} as int)"), F.expr(f"cast(p % {width} as int)")
    return footprints.where("a > 0").groupBy("k").agg((F.min(y) - pad).alias("y0"), (F.max(y) + pad).alias("y1"), (F.min(x) - pad).alias("x0"), (F.max(x) + pad).alias("x1"))


def laid_out(footprints: DataFrame, height: int, width: int, pad: int = 4) -> DataFrame:
    """(k, p, a): every pixel of each padded box inside the field, 0 off the footprint."""
    b = boxes(footprints, width, pad)
    clip = lambda c, n: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(n - 1))
    cells = b.select("k", F.explode(F.sequence(clip("y0", height), clip("y1", height))).alias("y"), clip("x0", width).alias("x0"), clip("x1", width).alias("x1"))
    cells = cells.select("k", (F.col("y") * width).alias("row"), F.explode(F.sequence("x0", "x1")).alias("x")).select("k", (F.col("row") + F.col("x")).cast("int").alias("p"))
    return cells.join(footprints.select("k", "p", "a"), ["k", "p"], "left").fillna(0.0, ["a"])


def spatial_correlation(footprints: DataFrame, image: DataFrame, height: int, width: int, pad: int = 4) -> DataFrame:
    """(k, cn_corr): footprint against an image (p, cn) over its padded box."""
    return correlation_by(laid_out(footprints, height, width, pad).join(image, "p"), "a", "cn", name="cn_corr")


def r_values(footprints: DataFrame, traces: DataFrame, movie: DataFrame, height: int, width: int, *, peak: float = 0.95, least: int = 10, pad: int = 4, value: str = "c") -> DataFrame:
    """(k, r_value): footprint against the movie's mean change at the frames of the trace's peaks."""
    cut = traces.groupBy("k").agg(F.percentile(value, F.lit(peak)).alias("cut"))
    order = Window.partitionBy("k").orderBy(F.desc(value), "t")
    marked = traces.join(cut, "k").withColumn("hit", F.col(value) >= F.col("cut")).withColumn("rank", F.row_number().over(order))
    marked = marked.withColumn("hits", F.sum(F.col("hit").cast("int")).over(Window.partitionBy("k")))
    peaks = marked.where(F.when(F.col("hits") < least, F.col("rank") <= least).otherwise(F.col("hit"))).select("k", "t")
    cells = laid_out(footprints, height, width, pad)
    means = movie.groupBy("p").agg(F.avg("v").alias("m"))
    # the movie meets each component only at its peak frames and in its box
    high = cells.select("k", "p").join(peaks, "k").join(movie.select("t", "p", "v"), ["t", "p"]).groupBy("k", "p").agg(F.avg("v").alias("h"))
    both = cells.join(high, ["k", "p"]).join(means, "p").withColumn("d", F.col("h") - F.col("m"))
    return correlation_by(both, "a", "d", name="r_value")


def r_values_of_pixels(footprints: pd.DataFrame, traces: np.ndarray, pixels: DataFrame, height: int, width: int, *, peak: float = 0.95, least: int = 10, pad: int = 4) -> DataFrame:
    """(k, r_value) as `r_values` gives it, from pixels (p, tr): no value of the movie becomes a row.

    footprints (k, p, a) and traces K x T are what a fit holds in memory; their peak frames and boxes go to all pixels.
    """
    high, box = [], []
    for k, c in enumerate(traces):
        hit = np.flatnonzero(c >= np.percentile(c, 100 * peak))
        high.append(hit if len(hit) >= least else np.lexsort((np.arange(len(c)), -c))[:least])
        p = footprints.loc[(footprints["k"] == k) & (footprints["a"] > 0), "p"].to_numpy()
        box.append((p // width).min() - pad if len(p) else 0)
        box[-1] = (box[-1], (p // width).max() + pad, (p % width).min() - pad, (p % width).max() + pad) if len(p) else (1, 0, 1, 0)
    shared = pixels.sparkSession.sparkContext.broadcast((high, np.array(box).reshape(-1, 4)))

    def change(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        peaks, sides = shared.value
        for batch in batches:
            rows = []
            for p, tr in zip(batch["p"], batch["tr"]):
                y, x, tr = p // width, p % width, np.asarray(tr, float)
                for k in np.flatnonzero((sides[:, 0] <= y) & (y <= sides[:, 1]) & (sides[:, 2] <= x) & (x <= sides[:, 3])):
                    rows.append((int(k), int(p), float(tr[peaks[k]].mean() - tr.mean())))
            yield pd.DataFrame(rows, columns=["k", "p", "d"])

    moved = pixels.select("p", "tr").mapInPandas(change, "k int, p int, d double")
    known = pixels.sparkSession.createDataFrame(footprints[["k", "p", "a"]], "k int, p int, a double")
    return correlation_by(moved.join(known, ["k", "p"], "left").fillna(0.0, ["a"]), "a", "d", name="r_value")


def morphology(footprints: DataFrame, width: int) -> DataFrame:
    """(k, eccentricity, solidity, compactness, aspect_ratio) of the largest 8-connected region."""

    from lumenframe.operators.components import each_footprint

    def measure(p: np.ndarray, a: np.ndarray) -> dict:
        y, x = p[a > 0] // width, p[a > 0] % width
        mask = np.zeros((int(y.max() - y.min()) + 1, int(x.max() - x.min()) + 1) if len(y) else (1, 1), bool)
        if len(y):
            mask[y - y.min(), x - x.min()] = True
        found = arrays.shape_of(mask)
        return {c: [found[c]] for c in ("eccentricity", "solidity", "compactness", "aspect_ratio")}

    return each_footprint(footprints, measure, "eccentricity double, solidity double, compactness double, aspect_ratio double")


def ellipse_eccentricity(footprints: DataFrame, width: int) -> DataFrame:
    """(k, eccentricity): from the sample covariance of the support's pixels; 0 under two pixels."""
    y, x = F.expr(f"p div {width}"), F.expr(f"p % {width}")
    m = footprints.where("a > 0").groupBy("k").agg(F.count("*").alias("n"), F.var_samp(y).alias("vy"), F.var_samp(x).alias("vx"), F.covar_samp(y, x).alias("c"))
    mid, gap = (F.col("vy") + F.col("vx")) / 2, F.sqrt(((F.col("vy") - F.col("vx")) / 2) ** 2 + F.col("c") ** 2)
    return m.select("k", F.when((F.col("n") < 2) | (mid + gap <= 0), 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 1 - (mid - gap) / (mid + gap)))).alias("eccentricity"))


def centre_drift(footprints: DataFrame, width: int) -> DataFrame:
    """(k, drift): distance between the brightest pixel and the centre of the support."""
    y, x = F.expr(f"p div {width}"), F.expr(f"p % {width}")
    s = footprints.where("a > 0").groupBy("k").agg(F.avg(y).alias("my"), F.avg(x).alias("mx"), F.max(F.struct("a", (-F.col("p")).alias("q"))).alias("top"))
    top = -F.col("top.q")
    return s.select("k", F.hypot(F.floor(top / width) - F.col("my"), top % width - F.col("mx")).alias("drift"))


def multipeak_share(footprints: DataFrame, width: int, distance: int, rel: float = 0.3) -> DataFrame:
    """(share): part of the components with two or more separated peaks over rel of the highest."""
    from lumenframe.operators.components import each_footprint

    def peaks(p: np.ndarray, a: np.ndarray) -> dict:
        p, a = p[a > 0], a[a > 0]
        if not len(p):
            return {"several": [False]}
        y, x, high = p // width, p % width, np.flatnonzero(a > rel * a.max())
        # ranks by value, then against the order of pixels: a pixel is a peak where no rank around is higher
        rank = np.empty(len(p), np.int64)
        rank[np.lexsort((-p, a))] = np.arange(1, len(p) + 1)
        d = distance
        if (y.max() - y.min() + 1) * (x.max() - x.min() + 1) <= 64 * len(p) + 4_096:
            box = np.zeros((y.max() - y.min() + 1 + 2 * d, x.max() - x.min() + 1 + 2 * d), np.int64)
            box[y - y.min() + d, x - x.min() + d] = rank
            top = np.lib.stride_tricks.sliding_window_view(box, 2 * d + 1, 0).max(-1)
            top = np.lib.stride_tricks.sliding_window_view(top, 2 * d + 1, 1).max(-1)
            n = int((top[y[high] - y.min(), x[high] - x.min()] == rank[high]).sum())
        else:  # far apart: no image of the whole box
            at = dict(zip(zip(y.tolist(), x.tolist()), rank.tolist()))
            n = sum(all(at.get((i + dy, j + dx), 0) <= r for dy in range(-d, d + 1) for dx in range(-d, d + 1)) for i, j, r in zip(y[high].tolist(), x[high].tolist(), rank[high].tolist()))
        return {"several": [n >= 2]}

    return each_footprint(footprints, peaks, "several boolean").agg(F.avg(F.col("several").cast("double")).alias("share"))


def two_way_matches(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """(n_a, n_b, a_hit, b_hit): points (k, cy, cx) with one of the other set within the radius."""
    from lumenframe.operators.cells import with_near

    hits = [with_near(x, y, radius).agg(F.countDistinct("k").alias(n)) for x, y, n in ((a, b, "a_hit"), (b, a, "b_hit"))]
    return a.agg(F.count("*").alias("n_a")).crossJoin(b.agg(F.count("*").alias("n_b"))).crossJoin(hits[0]).crossJoin(hits[1])  # one row each


def quality(metrics: DataFrame, values: list[str]) -> DataFrame:
    """One row: median, 25th percentile and interquartile range of each column, NaN left out."""
    out = []
    for v in values:
        x = F.when(~F.isnan(v), F.col(v))
        q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        out += [q[1].alias(f"{v}_median"), q[0].alias(f"{v}_p25"), (q[2] - q[0]).alias(f"{v}_iqr")]
    return metrics.agg(F.count("*").alias("n"), *out)


def composite_score(q: DataFrame) -> DataFrame:
    """corr + spatial + accepted / 2 - iqr_share / 4 - multipeak / 2; NaN and null count as 0, no component is -inf."""
    z = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    score = z("corr") + z("spatial") + 0.5 * z("accepted") - 0.25 * z("iqr_share") - 0.5 * z("multipeak")
    return q.withColumn("score", F.when(F.col("n") > 0, score).otherwise(float("-inf")))


def verdict(q: DataFrame, recall: float = 0.8, precision: float = 0.8, cproj: float = 0.5, trace: float = 0.4) -> DataFrame:
    """PASS, or WARN with the names of the thresholds missed; null and NaN are skipped."""
    bad = lambda c, low: F.col(c).isNotNull() & ~F.isnan(c) & low
    missed = F.concat_ws(",", F.when(bad("recall", F.col("recall") < recall), "recall"), F.when(bad("precision", F.col("precision") < precision), "precision"),
                         F.when(bad("cproj", F.col("cproj") < cproj), "cproj"), F.when(bad("trace_corr", F.col("trace_corr") > trace), "trace_corr"))
    return q.withColumn("missed", missed).withColumn("verdict", F.when(F.col("missed") == "", "PASS").otherwise("WARN"))


def smoothed_peaks(footprints: DataFrame, height: int, width: int, sigma: float = 1.0) -> DataFrame:
    """(k, y, x): brightest pixel of each footprint after a Gaussian, the first of equals."""

    from lumenframe.operators.components import each_footprint

    def peak(p: np.ndarray, a: np.ndarray) -> dict:
        y, x = p // width, p % width
        m = int(4 * sigma + 1)
        y0, x0 = max(0, y.min() - m), max(0, x.min() - m)
        image = np.zeros((min(height, y.max() + m + 1) - y0, min(width, x.max() + m + 1) - x0))
        image[y - y0, x - x0] = a
        i, j = np.unravel_index(np.argmax(np.round(arrays.gaussian(image, sigma), 12)), image.shape)
        return {"y": [i + y0], "x": [j + x0]}

    return each_footprint(footprints, peak, "y int, x int")


def blob_coverage(peaks: DataFrame, blobs: DataFrame, radius: float) -> DataFrame:
    """(recall, precision) of blobs and footprint peaks (k, cy, cx) within the radius; NaN without any."""
    m = two_way_matches(blobs, peaks, radius)
    share = lambda a, n: F.when(F.col(n) > 0, F.col(a) / F.col(n)).otherwise(float("nan"))
    return m.select(share("a_hit", "n_a").alias("recall"), share("b_hit", "n_b").alias("precision"))


def model_quality(footprints: DataFrame, traces: DataFrame, metrics: DataFrame, image: DataFrame | None, height: int, width: int, sigma: float, circle: float = 1.5) -> DataFrame:
    """One row of proxies of a fitted model: counts, trace fidelity, footprint sizes, merging, noise, fidelity in space.

    traces: (k, t, c, yra); metrics: (k, snr_amp, keep); image: (p, cn) or None.
    """
    from lumenframe.operators.components import correlation_quantiles

    three = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    nan = F.lit(float("nan"))
    k = metrics.agg(F.count("*").alias("K"), F.sum(F.col("keep").cast("int")).alias("K_accepted"), F.avg("snr_amp").alias("snr_mean"), F.median("snr_amp").alias("snr_median"))
    proj = correlation_by(traces.withColumn("cy", F.col("c") + F.col("yra")), "c", "cy").agg(F.avg("r").alias("cprojcorr_mean"), F.median("r").alias("cprojcorr_median"))
    kept = traces.join(metrics.where("keep").select("k"), "k", "left_semi")
    pair = traces.sparkSession.createDataFrame([tuple(correlation_quantiles(kept, [0.5], "c", absolute=True))], "trace_corr_median double")
    size = footprints.where("a > 0").groupBy("k").agg(F.count("*").alias("npix")).agg(three("npix").alias("q"))
    size = size.select(F.col("q")[1].alias("npix_median"), (F.col("q")[2] - F.col("q")[0]).alias("npix_iqr"), F.col("q")[0].alias("npix_p25"))
    own = footprints.join(metrics.where("keep").select("k"), "k", "left_semi")
    peaks = multipeak_share(own, width, max(1, round(sigma))).withColumnRenamed("share", "multipeak_frac")
    space = spatial_correlation(footprints, image, height, width).agg(F.median("cn_corr").alias("spatialcorr_median")) if image is not None else k.select(nan.alias("spatialcorr_median"))
    row = k
    for part in (proj, pair, size, peaks, space):  # one row each
        row = row.crossJoin(part)
    area = np.pi * (circle * sigma) ** 2
    return row.withColumn("accepted_frac", F.when(F.col("K") > 0, F.col("K_accepted") / F.col("K")).otherwise(0.0)).withColumn("npix_oversize", F.col("npix_median") / area)
