"""Summary images and stencils: neighbours by shifted equi-joins, never by theta joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
HALF = [(0, 1), (1, -1), (1, 0), (1, 1)]


def stencil(df: DataFrame, offsets: Sequence[tuple[int, int]], names: tuple[str, str] = ("qy", "qx")) -> DataFrame:
    """Each row once for each offset, with the coordinates that the offset leads to."""
    each = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])).alias("o")
    return df.select("*", each).select(*df.columns, (F.col("y") + F.col("o.dy")).alias(names[0]), (F.col("x") + F.col("o.dx")).alias(names[1]))


def unit_pixels(movie: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, y, x, tr): each pixel's values over time, centred and of unit variance; zeros where it is constant."""
    rows = movie.groupBy(*by, "y", "x").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda s: s["v"]).alias("tr"), F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    return rows.select(*by, "y", "x", F.when(F.col("sd") > 0, F.transform("tr", lambda v: (v - F.col("m")) / F.col("sd"))).otherwise(F.transform("tr", lambda v: v * 0.0)).alias("tr"))


def _product(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def correlation_image(movie: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, y, x, cn): mean correlation with the existing ones of the 8 neighbours; constant pixels count as 0.

    Pixels are gathered once as unit-variance arrays; each pair of neighbours is joined once, on equal keys,
    and its correlation is an array product: the number of frames never multiplies the joined rows.
    """
    pixels = unit_pixels(movie, by)
    other = pixels.select(*by, F.col("y").alias("qy"), F.col("x").alias("qx"), F.col("tr").alias("other"))
    pairs = stencil(pixels, HALF).join(other, [*by, "qy", "qx"])
    both = pairs.select(*by, F.explode(F.array(F.struct("y", "x"), F.struct(F.col("qy").alias("y"), F.col("qx").alias("x")))).alias("s"), _product("tr", "other").alias("r"))
    cn = both.groupBy(*by, F.col("s.y").alias("y"), F.col("s.x").alias("x")).agg(F.avg("r").alias("cn"))
    return pixels.select(*by, "y", "x").join(cn, [*by, "y", "x"], "left").select(*by, "y", "x", F.coalesce("cn", F.lit(0.0)).alias("cn"))


def wrapped_correlation_image(movie: DataFrame, height: int, width: int, neighbours: int = 8) -> DataFrame:
    """(y, x, cn) with borders that wrap around, always divided by 4 or 8."""
    offsets = AROUND if neighbours == 8 else [(0, 1), (0, -1), (1, 0), (-1, 0)]
    pixels = unit_pixels(movie)
    pairs = stencil(pixels, offsets).withColumns({"qy": F.pmod("qy", F.lit(height)), "qx": F.pmod("qx", F.lit(width))})
    other = pixels.select(F.col("y").alias("qy"), F.col("x").alias("qx"), F.col("tr").alias("other"))
    return pairs.join(other, ["qy", "qx"]).groupBy("y", "x").agg((F.sum(_product("tr", "other")) / neighbours).alias("cn"))


def crispness(image: DataFrame, value: str = "v", by: Sequence[str] = ()) -> DataFrame:
    """(by, crispness): Frobenius norm of the gradient, central differences inside and one-sided at the edges."""

    def slope(along: str, across: str) -> Column:
        w = Window.partitionBy(*by, across).orderBy(along)
        ahead, behind = F.lead(value).over(w), F.lag(value).over(w)
        return F.when(ahead.isNull() & behind.isNull(), 0.0).when(ahead.isNull(), F.col(value) - behind).when(behind.isNull(), ahead - F.col(value)).otherwise((ahead - behind) / 2)

    g = image.select(*by, slope("y", "x").alias("gy"), slope("x", "y").alias("gx"))
    return g.groupBy(*by).agg(F.sqrt(F.sum(F.col("gy") ** 2 + F.col("gx") ** 2)).alias("crispness"))


def bin_median(movie: DataFrame, n_t: int, window: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(by, y, x, v): template as the median over the means of frames with equal t modulo the number of groups."""
    w = min(window, n_t)
    groups = n_t // w
    means = movie.where(F.col("t") < groups * w).groupBy(*by, "y", "x", (F.col("t") % groups).alias("g")).agg(F.avg("v").alias("m"))
    return means.groupBy(*by, "y", "x").agg(F.median("m").alias("v"))


def mean_window(movie: DataFrame, t0: int, t1: int) -> DataFrame:
    """Template as the mean of frames t0 .. t1 - 1."""
    return movie.where(f"t >= {t0} and t < {t1}").groupBy("y", "x").agg(F.avg("v").alias("v"))


def local_maxima(image: DataFrame, distance: int = 1, value: str = "cn") -> DataFrame:
    """(y, x, value) of pixels that no pixel within the square neighbourhood beats; ties go to the smaller (y, x)."""
    d = distance
    offsets = [(dy, dx) for dy in range(-d, d + 1) for dx in range(-d, d + 1) if (dy, dx) != (0, 0)]
    other = image.select(F.col("y").alias("qy"), F.col("x").alias("qx"), F.col(value).alias("q"))
    near = stencil(image.select("y", "x", value), offsets).join(other, ["qy", "qx"])
    beaten = near.where((F.col("q") > F.col(value)) | ((F.col("q") == F.col(value)) & (F.struct("qy", "qx") < F.struct("y", "x")))).select("y", "x").distinct()
    return image.join(beaten, ["y", "x"], "left_anti").select("y", "x", value)


def seeds(image: DataFrame, most: int, distance: int = 1, value: str = "cn", least: float | None = None) -> DataFrame:
    """The brightest local maxima."""
    found = local_maxima(image if least is None else image.where(F.col(value) >= least), distance, value)
    return found.orderBy(F.desc(value), "y", "x").limit(most)


def spectrum(movie: DataFrame, n: int, bins: Sequence[int], by: Sequence[str] = ("y", "x")) -> DataFrame:
    """(by, f, psd): power of given Fourier bins of the first n frames, by sums of sines and cosines."""
    waves = F.explode(F.array(*[F.lit(int(f)) for f in bins])).alias("f")
    turn = 2 * 3.141592653589793 * F.col("f") * F.col("t") / n
    part = movie.where(F.col("t") < n).select(*by, "t", "v", waves)
    sums = part.groupBy(*by, "f").agg(F.sum(F.col("v") * F.cos(turn)).alias("re"), F.sum(F.col("v") * F.sin(turn)).alias("im"))
    return sums.select(*by, "f", ((F.col("re") ** 2 + F.col("im") ** 2) * 2 / n).alias("psd"))


def noise(movie: DataFrame, n: int, low: float = 0.25, high: float = 0.5, by: Sequence[str] = ("y", "x")) -> DataFrame:
    """(by, sn): noise deviation as the root of the exponential mean log power between two frequencies."""
    bins = [f for f in range(n // 2 + 1) if low <= f / n <= high]
    return spectrum(movie, n, bins, by).groupBy(*by).agg(F.sqrt(F.exp(F.avg(F.log(F.col("psd") + 1e-10)))).alias("sn"))


def movie_stats(movie: DataFrame, n_t: int) -> DataFrame:
    """One row on intensities, clipping and bleaching of a recording."""
    tenth = max(1, n_t // 10)
    v = movie.agg(F.percentile("v", F.array(F.lit(0.01), F.lit(0.99))).alias("q"), F.max("v").alias("top"), F.avg((F.col("v") <= 0).cast("double")).alias("at_zero"), F.avg((F.col("v") >= 255).cast("double")).alias("at_top"),
                  F.avg(F.when(F.col("t") < tenth, F.col("v"))).alias("first"), F.avg(F.when(F.col("t") >= n_t - tenth, F.col("v"))).alias("last"))
    return v.select(F.col("q")[0].alias("p1"), F.col("q")[1].alias("p99"), "top", "at_zero", "at_top", ((F.col("first") - F.col("last")) / F.col("first")).alias("bleach"))


def recording_stats(movie: DataFrame, sigma: float, *, min_corr: float = 0.8, min_pnr: float = 10.0, distance: int = 5) -> DataFrame:
    """One row on how well a recording's cells can be found: `movie_stats`, quantiles of local correlation and peak-to-noise
    ratio, shares of the variance that one and five components explain, and seeds in 10,000 pixels.

    movie: (t, y, x, v), whose length is its last frame's.
    """
    from lumenframe.operators import background, kernels, movies

    spark = movie.sparkSession
    n_t = movie.agg(F.max("t") + 1).collect()[0][0] or 0
    image = kernels.corr_pnr(movie, sigma).persist()
    q = lambda c: F.percentile(c, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    found = image.agg(q("cn").alias("cn"), q("pnr").alias("pnr"), F.count("*").alias("pixels"))
    found = found.select(*[F.col(c)[i].alias(f"{c}_{n}") for c in ("cn", "pnr") for i, n in enumerate(("med", "p90", "p99"))], "pixels")
    peaks = local_maxima(image.where((F.col("cn") >= min_corr) & (F.col("pnr") >= min_pnr)), distance).agg(F.count("*").alias("seeds"))
    shares = background.variance_shares(movies.pixels_of(movie).select("tr"))
    spectrum_ = spark.createDataFrame([(shares[0], float(sum(shares)))], "pc1 double, top5 double")
    rows = movie_stats(movie, n_t).join(found).join(peaks).join(spectrum_)  # four tables of one row
    return rows.withColumn("seed_density", F.col("seeds") / F.col("pixels") * 10_000).drop("seeds", "pixels")
