"""Queries that the oracle engine can express: each operator over the views, with its SQL twin beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.operators import background, cells, components, evaluate, images, kernels, movies
from lumenframe.sources import ingest
from lumenframe.sources.views import emb_movie, evt_movie, evt_traces, li_footprints, part_cells, read, with_views

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _n_t(movie: DataFrame) -> int:
    """Number of frames."""
    return movie.agg(F.coalesce(F.max("t") + 1, F.lit(0))).collect()[0][0]


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) + F.lit(0.0) for n in names})


# ---------------------------------------------------------------- seeds and images

_CN = """pix AS (SELECT y, x, t, v FROM emb_movie),
pair AS (
  SELECT a.y, a.x, b.y AS qy, b.x AS qx, coalesce(corr(a.v, b.v), 0) AS r
  FROM pix AS a JOIN (SELECT unnest([-1, 0, 1]) AS dy) AS dy ON true JOIN (SELECT unnest([-1, 0, 1]) AS dx) AS dx ON NOT (dy.dy = 0 AND dx.dx = 0)
  JOIN pix AS b ON b.t = a.t AND b.y = a.y + dy.dy AND b.x = a.x + dx.dx GROUP BY ALL),
cn AS (SELECT y, x, avg(r) AS cn FROM pair GROUP BY y, x)"""


@query(with_views("emb_movie") + f",\n{_CN}\nSELECT y, x, round(cn, 6) + 0.0 AS cn FROM cn")
def n4_correlation_image(spark, sf):
    return rounded(images.correlation_image(emb_movie(spark, sf)), "cn")


@query(with_views("emb_movie") + """,
pair AS (
  SELECT a.y, a.x, b.y AS qy, b.x AS qx, coalesce(corr(a.v, b.v), 0) AS r
  FROM emb_movie AS a JOIN (SELECT unnest([-1, 0, 1]) AS dy) AS dy ON true JOIN (SELECT unnest([-1, 0, 1]) AS dx) AS dx ON NOT (dy.dy = 0 AND dx.dx = 0)
  JOIN emb_movie AS b ON b.t = a.t AND b.y = (a.y + dy.dy + 8) % 8 AND b.x = (a.x + dx.dx + 8) % 8 GROUP BY ALL)
SELECT y, x, round(sum(r) / 8, 6) + 0.0 AS cn FROM pair GROUP BY y, x""")
def n7_correlation_image_wrap(spark, sf):
    return rounded(images.wrapped_correlation_image(emb_movie(spark, sf), 8, 8), "cn")


_MAXIMA = """peak AS (
  SELECT a.y, a.x, a.cn FROM rcn AS a WHERE NOT EXISTS (
    SELECT 1 FROM rcn AS b WHERE abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND NOT (a.y = b.y AND a.x = b.x)
      AND (b.cn > a.cn OR (b.cn = a.cn AND (b.y < a.y OR (b.y = a.y AND b.x < a.x))))))"""


@query(with_views("emb_movie") + f",\n{_CN},\nrcn AS (SELECT y, x, round(cn, 6) + 0.0 AS cn FROM cn),\n{_MAXIMA}\nSELECT y, x, cn FROM peak ORDER BY cn DESC, y, x LIMIT 10")
def seed_topk(spark, sf):
    """I3: the ten best seeds of the correlation image."""
    return images.seeds(rounded(images.correlation_image(emb_movie(spark, sf)), "cn"), 10)


@query(with_views("emb_movie") + f",\n{_CN},\nrcn AS (SELECT y, x, round(cn, 6) + 0.0 AS cn FROM cn),\n{_MAXIMA}\nSELECT y, x, cn FROM peak")
def i3_local_maxima(spark, sf):
    return images.local_maxima(rounded(images.correlation_image(emb_movie(spark, sf)), "cn"))


@query(with_views("emb_movie") + """,
m AS (SELECT y, x, avg(v) AS v FROM emb_movie GROUP BY y, x),
g AS (SELECT v, lag(v) OVER wy AS y0, lead(v) OVER wy AS y1, lag(v) OVER wx AS x0, lead(v) OVER wx AS x1 FROM m
  WINDOW wy AS (PARTITION BY x ORDER BY y), wx AS (PARTITION BY y ORDER BY x))
SELECT round(sqrt(sum(power(CASE WHEN y0 IS NULL THEN y1 - v WHEN y1 IS NULL THEN v - y0 ELSE (y1 - y0) / 2 END, 2)
  + power(CASE WHEN x0 IS NULL THEN x1 - v WHEN x1 IS NULL THEN v - x0 ELSE (x1 - x0) / 2 END, 2))), 6) AS crispness FROM g""")
def n8_crispness(spark, sf):
    image = emb_movie(spark, sf).groupBy("y", "x").agg(F.avg("v").alias("v"))
    return rounded(images.crispness(image), "crispness")


@query(with_views("emb_movie") + """
SELECT y, x, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS sd, round(max(v), 6) + 0.0 AS top FROM emb_movie GROUP BY y, x""")
def n9_projections(spark, sf):
    return rounded(movies.mean_projection(emb_movie(spark, sf)), "mean", "sd", "top")


@query(with_views("evt_movie") + "\nSELECT t, round(avg(v), 6) AS m FROM evt_movie GROUP BY t")
def n9_activity(spark, sf):
    return rounded(movies.frame_means(evt_movie(spark, sf)), "m")


_DFT = """n AS (SELECT max(t) + 1 AS n FROM emb_movie),
f AS (SELECT unnest(range(0, CAST((SELECT n FROM n) // 2 + 1 AS BIGINT))) AS f),
w AS (SELECT y, x, f, n, sum(v * cos(2 * pi() * f * t / n)) AS re, sum(v * sin(2 * pi() * f * t / n)) AS im FROM emb_movie, f, n WHERE f >= 0.25 * n GROUP BY y, x, f, n)"""


@query(with_views("emb_movie") + f",\n{_DFT}\nSELECT y, x, CAST(f AS INTEGER) AS f, round((re * re + im * im) * 2 / n, 5) AS psd FROM w")
def n2_noise_band(spark, sf):
    return rounded(kernels.band_power(emb_movie(spark, sf)), "psd", digits=5)


@query(with_views("emb_movie") + f",\n{_DFT}\nSELECT y, x, round(sqrt(exp(avg(ln((re * re + im * im) * 2 / n + 1e-10)))), 6) AS sn FROM w GROUP BY y, x")
def n1_noise(spark, sf):
    return rounded(kernels.noise(emb_movie(spark, sf)), "sn")


@query(with_views("emb_movie") + """,
g AS (SELECT y, x, t % n AS g, avg(v) AS m FROM emb_movie, (SELECT (max(t) + 1) // 10 AS n FROM emb_movie) WHERE t < n * 10 GROUP BY y, x, t % n)
SELECT y, x, round(median(m), 6) + 0.0 AS v FROM g GROUP BY y, x""")
def m3_bin_median_template(spark, sf):
    return rounded(images.bin_median(emb_movie(spark, sf), _n_t(emb_movie(spark, sf)), 10), "v")


@query(with_views("emb_movie") + "\nSELECT y, x, round(avg(v), 6) + 0.0 AS v FROM emb_movie WHERE t >= 100 AND t < 200 GROUP BY y, x")
def m22_window_template(spark, sf):
    return rounded(images.mean_window(emb_movie(spark, sf), 100, 200), "v")


@query(with_views("emb_movie") + "\nSELECT round(var_pop(v), 8) AS sharpness FROM (SELECT y, x, avg(v) AS v FROM emb_movie GROUP BY y, x)")
def m13_sharpness(spark, sf):
    image = emb_movie(spark, sf).groupBy("y", "x").agg(F.avg("v").alias("v"))
    return rounded(image.agg(F.var_pop("v").alias("sharpness")), "sharpness", digits=8)


@query(with_views("evt_movie") + """,
s AS (SELECT quantile_cont(v, [0.01, 0.99]) AS q, max(v) AS top, avg(CASE WHEN v <= 0 THEN 1.0 ELSE 0 END) AS at_zero, avg(CASE WHEN v >= 255 THEN 1.0 ELSE 0 END) AS at_top,
  avg(CASE WHEN t < greatest(1, n_t // 10) THEN v END) AS a, avg(CASE WHEN t >= n_t - greatest(1, n_t // 10) THEN v END) AS b FROM evt_movie, (SELECT max(t) + 1 AS n_t FROM evt_movie))
SELECT round(q[1], 6) AS p1, round(q[2], 6) AS p99, round(top, 6) AS top, round(at_zero, 6) AS at_zero, round(at_top, 6) AS at_top, round((a - b) / a, 6) AS bleach FROM s""")
def e17_movie_stats(spark, sf):
    return rounded(images.movie_stats(evt_movie(spark, sf), _n_t(evt_movie(spark, sf))), "p1", "p99", "top", "at_zero", "at_top", "bleach")


@query(with_views("evt_movie") + """,
s AS (SELECT min(v) AS lo, quantile_cont(v, 0.995) AS hi FROM evt_movie)
SELECT t, y, x, CAST(floor(least(greatest((v - lo) / greatest(hi - lo, 1e-9) * 255, 0), 255)) AS INTEGER) AS v FROM evt_movie, s""")
def k14_to_uint8(spark, sf):
    return movies.to_bytes(evt_movie(spark, sf))


@query(with_views("emb_movie") + """,
m AS (SELECT y, x, avg(v) AS cn FROM emb_movie GROUP BY y, x)
SELECT a.y, a.x, round(sum(b.cn), 6) AS total FROM m AS a JOIN m AS b ON b.y BETWEEN a.y AND a.y + 3 AND b.x BETWEEN a.x AND a.x + 2
WHERE a.y <= 4 AND a.x <= 5 GROUP BY a.y, a.x ORDER BY round(sum(b.cn), 9) DESC, a.y, a.x LIMIT 1""")
def p12_densest_box(spark, sf):
    image = emb_movie(spark, sf).groupBy("y", "x").agg(F.avg("v").alias("cn"))
    return rounded(movies.densest_box(image, 4, 3), "total")


@query(with_views("evt_movie") + """,
lv AS (SELECT y, x, median(v) AS level FROM evt_movie GROUP BY y, x),
f AS (SELECT m.t, round(avg((m.v - lv.level) * (m.v - lv.level)), 9) AS activity FROM evt_movie AS m JOIN lv USING (y, x) GROUP BY m.t),
b AS (SELECT t AS centre, activity, (SELECT max(t) + 1 FROM f) AS n_t FROM f ORDER BY activity DESC, t LIMIT 1)
SELECT CAST(greatest(0, least(centre - 30, n_t - 60)) AS INTEGER) AS t0, CAST(least(greatest(0, least(centre - 30, n_t - 60)) + 60, n_t) AS INTEGER) AS t1, centre, round(activity, 6) AS activity FROM b""")
def p12_busiest_window(spark, sf):
    return rounded(movies.busiest_window(evt_movie(spark, sf), 60), "activity")


# ---------------------------------------------------------------- movies


@query(with_views("emb_movie") + """
SELECT CAST(t // 4 AS INTEGER) AS t, CAST(y // 3 AS INTEGER) AS y, CAST(x // 3 AS INTEGER) AS x, round(avg(v), 6) + 0.0 AS v
FROM emb_movie WHERE t < (SELECT (max(t) + 1) // 4 * 4 FROM emb_movie) AND y < 6 AND x < 6 GROUP BY 1, 2, 3""")
def r1_block_mean(spark, sf):
    return rounded(movies.block_mean(emb_movie(spark, sf), 3, 4, _n_t(emb_movie(spark, sf)), 8, 8), "v")


@query(with_views("emb_movie") + "\nSELECT t, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, round(avg(v), 6) + 0.0 AS v FROM emb_movie GROUP BY 1, 2, 3")
def r2_spatial_bin(spark, sf):
    return rounded(movies.block_mean(emb_movie(spark, sf), 2, 1, _n_t(emb_movie(spark, sf)), 8, 8), "v")


@query(with_views("emb_movie") + """,
f AS (SELECT t // 103 AS file_no, t % 103 AS local_t, y, x, v FROM emb_movie)
SELECT file_no, CAST(local_t // 10 AS INTEGER) AS bin, y, x, round(avg(v), 6) + 0.0 AS v FROM f GROUP BY 1, 2, 3, 4 HAVING count(*) = 10""")
def r3_file_bins(spark, sf):
    files = emb_movie(spark, sf).select(F.expr("cast(t div 103 as bigint)").alias("file_no"), (F.col("t") % 103).alias("local_t"), "y", "x", "v")
    return rounded(movies.file_bins(files.withColumn("file_no", F.col("file_no").cast("int")), 10), "v")


_FLAGS = """m AS (SELECT t, avg(v) AS m FROM emb_movie GROUP BY t),
med AS (SELECT median(m) AS med FROM m),
mad AS (SELECT median(abs(m - med)) AS mad FROM m, med),
flag AS (SELECT t, m, (mad > 0 AND abs(m - med) > 2.0 * 1.4826 * mad) AS outlier FROM m, med, mad)"""


def _flags(spark, sf):
    return movies.outlier_frames(movies.frame_means(emb_movie(spark, sf)), 2.0)


@query(with_views("emb_movie") + f",\n{_FLAGS}\nSELECT t, round(m, 6) + 0.0 AS m, outlier FROM flag")
def j2_outlier_frames(spark, sf):
    return rounded(_flags(spark, sf), "m")


@query(with_views("emb_movie") + f""",
{_FLAGS},
i AS (SELECT t, t - row_number() OVER (ORDER BY t) AS island FROM flag WHERE outlier),
r AS (SELECT island, count(*) AS run_length, row_number() OVER (ORDER BY island) - 1 AS run_id FROM i GROUP BY island)
SELECT i.t, CAST(r.run_id AS INTEGER) AS run_id, CAST(r.run_length AS BIGINT) AS run_length, r.run_length <= 10 AS interp_ok FROM i JOIN r USING (island)""")
def j3_outlier_runs(spark, sf):
    return movies.outlier_runs(_flags(spark, sf), 10)


_PLAN = """lr AS (SELECT t, outlier, last_value(CASE WHEN NOT outlier THEN t END IGNORE NULLS) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS l,
  first_value(CASE WHEN NOT outlier THEN t END IGNORE NULLS) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM flag),
plan AS (SELECT t, coalesce(l, r) AS "left", coalesce(r, l) AS "right", CASE WHEN l IS NULL OR r IS NULL THEN 0.0 ELSE CAST(t - l AS DOUBLE) / (r - l) END AS alpha FROM lr WHERE outlier)"""


@query(with_views("emb_movie") + f',\n{_FLAGS},\n{_PLAN}\nSELECT t, "left", "right", round(alpha, 6) AS alpha FROM plan')
def j4_repair_plan(spark, sf):
    return rounded(movies.repair_plan(_flags(spark, sf)), "alpha")


@query(with_views("emb_movie") + f""",
{_FLAGS},
{_PLAN}
SELECT t, y, x, round(v, 6) + 0.0 AS v FROM (
  SELECT e.t, e.y, e.x, e.v FROM emb_movie AS e JOIN flag AS f ON f.t = e.t AND NOT f.outlier
  UNION ALL SELECT p.t, a.y, a.x, (1 - p.alpha) * a.v + p.alpha * b.v FROM plan AS p JOIN emb_movie AS a ON a.t = p."left" JOIN emb_movie AS b ON b.t = p."right" AND b.y = a.y AND b.x = a.x)""")
def j1_reject_outlier_frames(spark, sf):
    return rounded(movies.reject_outliers(emb_movie(spark, sf), 2.0), "v")


@query(with_views("emb_movie") + """,
low AS (SELECT t, y, x, v, quantile_cont(v, 0.1) OVER (PARTITION BY y, x ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS low,
  max(t) OVER (PARTITION BY y, x) AS last FROM emb_movie),
a AS (SELECT t, y, x, v, CASE WHEN t % 4 = 0 OR t = last THEN t END AS mark, CASE WHEN t % 4 = 0 OR t = last THEN low END AS low FROM low),
b AS (SELECT t, y, x, v, last_value(mark IGNORE NULLS) OVER back AS t0, last_value(low IGNORE NULLS) OVER back AS l0, first_value(mark IGNORE NULLS) OVER ahead AS t1, first_value(low IGNORE NULLS) OVER ahead AS l1 FROM a
  WINDOW back AS (PARTITION BY y, x ORDER BY t ROWS UNBOUNDED PRECEDING), ahead AS (PARTITION BY y, x ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c AS (SELECT t, y, x, v, l0 + CASE WHEN t1 = t0 THEN 0 ELSE CAST(t - t0 AS DOUBLE) / (t1 - t0) END * (l1 - l0) AS base FROM b)
SELECT t, y, x, round(v - base, 6) + 0.0 AS v, round(base, 6) + 0.0 AS base FROM c""")
def d1_rolling_detrend(spark, sf):
    return rounded(movies.rolling_detrend(emb_movie(spark, sf), 20, 10.0, stride=4), "v", "base")


@query(with_views("evt_traces") + """,
l AS (SELECT k, regr_slope(v, t) AS s, regr_intercept(v, t) AS i FROM evt_traces GROUP BY k)
SELECT k, t, round(v - i - s * t, 5) + 0.0 AS v FROM evt_traces JOIN l USING (k)""")
def d4_linear_detrend(spark, sf):
    return rounded(movies.linear_detrend(evt_traces(spark, sf)), "v", digits=5)


@query(with_views("emb_movie") + """
SELECT t - 50 AS t, y - 1 AS y, x - 2 AS x, round(CASE WHEN (y + x) % 2 = 0 THEN v ELSE 0 END, 6) + 0.0 AS v
FROM emb_movie WHERE t >= 50 AND t < 80 AND y >= 1 AND y < 6 AND x >= 2 AND x < 7""")
def p2_apply_cutout(spark, sf):
    mask = spark.range(64).select(F.expr("cast(id div 8 as int)").alias("y"), F.expr("cast(id % 8 as int)").alias("x")).where("(y + x) % 2 = 0")
    return rounded(movies.crop(emb_movie(spark, sf), 50, 80, 1, 6, 2, 7, mask), "v")


@query(with_views("li_footprints") + "\nSELECT k, CAST((p // 32 + 5) * 50 + p % 32 + 7 AS INTEGER) AS p, round(a, 6) AS a FROM li_footprints")
def p4_place_footprints(spark, sf):
    placed = movies.place_footprints(li_footprints(spark, sf), (5, 37, 7, 39), 50)
    return rounded(placed.withColumn("p", F.col("p").cast("int")), "a")


@query(with_views("evt_traces") + """
SELECT d.k, CAST(g.t AS INTEGER) AS t, round(coalesce(e.v, 0.0), 6) AS c FROM (SELECT DISTINCT k FROM evt_traces) AS d JOIN (SELECT unnest(range((SELECT max(t) + 21 FROM evt_traces))) AS t) AS g ON true LEFT JOIN evt_traces AS e ON e.k = d.k AND e.t = g.t - 10""")
def p5_place_traces(spark, sf):
    return rounded(movies.place_traces(evt_traces(spark, sf).withColumnRenamed("v", "c"), 10, _n_t(evt_traces(spark, sf)) + 20), "c")


@query("SELECT CAST(vec_id AS INTEGER) AS t, round(CAST(list_sum(embedding) AS DOUBLE), 4) + 0.0 AS total, len(embedding) AS n FROM embeddings")
def p6_frames_round_trip(spark, sf):
    """Long to frames and back to sums of frames."""
    f = movies.frames_of(emb_movie(spark, sf))
    long = movies.long_of_frames(f, 8)
    return rounded(long.groupBy("t").agg(F.sum("v").alias("total"), F.count("*").alias("n")), "total", digits=4)


@query(with_views("emb_movie") + "\nSELECT y, x, count(*) AS n, round(sum(v * t), 4) + 0.0 AS moment FROM emb_movie GROUP BY y, x")
def k3_pixel_major(spark, sf):
    """The transpose to pixels, read back."""
    long = movies.long_of_pixels(movies.pixels_of(emb_movie(spark, sf)))
    return rounded(long.groupBy("y", "x").agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("t")).alias("moment")), "moment", digits=4)


@query(with_views("emb_movie") + """
SELECT t, round(avg(v), 6) + 0.0 AS m FROM emb_movie WHERE t IN (SELECT CAST(floor(i * (SELECT max(t) FROM emb_movie) / 19) AS INTEGER) FROM (SELECT unnest(range(20)) AS i)) GROUP BY t""")
def p9_sample_frames(spark, sf):
    return rounded(movies.frame_means(movies.sample_frames(emb_movie(spark, sf), _n_t(emb_movie(spark, sf)), 20)), "m")


@query(with_views("li_footprints") + """,
s AS (SELECT unnest([0, 8, 16, 20]) AS r0), c AS (SELECT unnest([0, 8, 16, 20]) AS c0)
SELECT r0, r0 + 12 AS r1, c0, c0 + 12 AS c1, count(*) AS n, round(sum(a), 4) AS total FROM s, c, li_footprints
WHERE p // 32 >= r0 AND p // 32 < r0 + 12 AND p % 32 >= c0 AND p % 32 < c0 + 12 GROUP BY 1, 2, 3, 4""")
def p11_tile_grid(spark, sf):
    """Tiles of 12 pixels that overlap by four, with the footprints' pixels in each."""
    from lumenframe.operators.seeding import tile_grid

    grid = tile_grid(spark, 32, 32, 12, 4)
    # a pixel's tiles by its row and column, as equi-joins
    rows = grid.select("r0", "r1", F.explode(F.sequence("r0", F.col("r1") - 1)).alias("y")).distinct()
    columns = grid.select("c0", "c1", F.explode(F.sequence("c0", F.col("c1") - 1)).alias("x")).distinct()
    f = li_footprints(spark, sf).select(F.expr("cast(p div 32 as int)").alias("y"), F.expr("cast(p % 32 as int)").alias("x"), "a")
    return rounded(f.join(F.broadcast(rows), "y").join(F.broadcast(columns), "x").groupBy("r0", "r1", "c0", "c1").agg(F.count("*").alias("n"), F.sum("a").alias("total")), "total", digits=4)


@query(with_views("evt_traces") + """,
n AS (SELECT max(t) + 1 AS n FROM evt_traces),
u AS (SELECT k, u.u, u.u * (n - 1) * 1.0 / (3 * n - 1) AS pos FROM n, (SELECT DISTINCT k FROM evt_traces) AS d JOIN (SELECT unnest(range((SELECT 3 * n FROM n))) AS u) AS u ON true)
SELECT u.k, CAST(u.u AS INTEGER) AS t, round(a.v + (u.pos - floor(u.pos)) * (coalesce(b.v, a.v) - a.v), 5) AS v FROM u
JOIN evt_traces AS a ON a.k = u.k AND a.t = floor(u.pos) LEFT JOIN evt_traces AS b ON b.k = u.k AND b.t = floor(u.pos) + 1""")
def u2_upsample_traces(spark, sf):
    n = _n_t(evt_traces(spark, sf))
    return rounded(movies.upsample_traces(evt_traces(spark, sf), n, 3 * n), "v", digits=5)


# ---------------------------------------------------------------- sources


_FILES = "SELECT o_orderkey % 13 AS file_no, row_number() OVER (PARTITION BY o_orderkey % 13 ORDER BY o_orderkey) - 1 AS local_t, o_totalprice AS v FROM orders"


def _files(spark, sf):
    o = read(spark, sf, "orders").select((F.col("o_orderkey") % 13).alias("file_no"), "o_orderkey", F.col("o_totalprice").alias("v"))
    return o.select("file_no", (F.row_number().over(Window.partitionBy("file_no").orderBy("o_orderkey")) - 1).alias("local_t"), "v")


@query(f"WITH f AS ({_FILES}), c AS (SELECT file_no, count(*) AS n FROM f GROUP BY 1), o AS (SELECT file_no, n, sum(n) OVER (ORDER BY file_no) - n AS start FROM c) SELECT f.file_no, CAST(f.local_t AS INTEGER) AS local_t, CAST(o.start + f.local_t AS BIGINT) AS t, round(f.v, 2) AS v FROM f JOIN o USING (file_no)")
def s5_concat_files(spark, sf):
    return rounded(ingest.concat_offsets(_files(spark, sf)).select("file_no", "local_t", "t", "v"), "v", digits=2)


@query("SELECT o_orderkey % 13 AS file_no, count(*) AS n, min(o_custkey) AS h, max(o_custkey) AS w FROM orders GROUP BY 1")
def s7_count_and_shape(spark, sf):
    o = read(spark, sf, "orders").select((F.col("o_orderkey") % 13).alias("file_no"), "o_custkey")
    return ingest.count_and_shape(o, F.min("o_custkey"), F.max("o_custkey"))


_NAMES = "SELECT CASE WHEN p_partkey % 3 = 0 THEN concat('2024-01-', lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0'), 'T10_00_', lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0'), '.avi') WHEN p_partkey % 3 = 1 THEN concat(CAST(p_partkey AS VARCHAR), '.avi') ELSE concat(p_brand, '.avi') END AS file, p_partkey FROM part"


def _names(spark, sf):
    p = read(spark, sf, "part")
    stamp = F.concat(F.lit("2024-01-"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0"), F.lit("T10_00_"), F.lpad((F.col("p_partkey") % 60).cast("string"), 2, "0"), F.lit(".avi"))
    return p.select(F.when(F.col("p_partkey") % 3 == 0, stamp).when(F.col("p_partkey") % 3 == 1, F.concat(F.col("p_partkey").cast("string"), F.lit(".avi"))).otherwise(F.concat("p_brand", F.lit(".avi"))).alias("file"), "p_partkey")


@query(f"WITH n AS ({_NAMES}) SELECT file, p_partkey, coalesce(TRY_CAST(nullif(regexp_extract(file, '^(\\d+)\\.avi$', 1), '') AS BIGINT), -1) AS number FROM n")
def s8_numeric_key(spark, sf):
    return _names(spark, sf).select("file", "p_partkey", ingest.numeric_key("file").alias("number"))


@query(f"WITH n AS ({_NAMES}) SELECT file, p_partkey, nullif(regexp_extract(file, '(\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}_\\d{{2}}_\\d{{2}})', 1), '') AS stamp FROM n")
def s9_timestamp_key(spark, sf):
    return _names(spark, sf).select("file", "p_partkey", ingest.timestamp_key("file").alias("stamp"))


@query(f"WITH n AS ({_NAMES}), k AS (SELECT file, p_partkey, CAST(regexp_extract(file, '^(\\d+)\\.avi$', 1) AS BIGINT) AS number FROM n WHERE regexp_matches(file, '^\\d+\\.avi$')) SELECT file, number, CAST(row_number() OVER (ORDER BY number, file) - 1 AS INTEGER) AS file_no FROM k")
def s6_discover_files(spark, sf):
    return ingest.discover(_names(spark, sf).select("file").where(ingest.numeric_key("file") >= 0))


@query(f"WITH f AS ({_FILES}) SELECT file_no, CAST(local_t AS INTEGER) AS local_t, round(v, 2) AS v FROM f WHERE file_no IN (0, 4, 8, 12) AND local_t % 7 = 0")
def s15_strided_sample(spark, sf):
    return rounded(ingest.strided_sample(_files(spark, sf), 13, 4, 7), "v", digits=2)


@query(f"WITH f AS ({_FILES}) SELECT file_no, CAST(local_t AS INTEGER) AS local_t, round(v, 2) AS v FROM f WHERE file_no >= 5 ORDER BY file_no, local_t LIMIT 300")
def s16_contiguous_clip(spark, sf):
    return rounded(ingest.contiguous_clip(_files(spark, sf), 13, 300, 0.4), "v", digits=2)


@query(with_views("emb_movie") + "\nSELECT t, round(sum(v), 5) + 0.0 AS s FROM emb_movie WHERE t // 25 IN (SELECT i * ((max(t) + 1) // 25 - 1) // 3 FROM emb_movie, (SELECT unnest(range(4)) AS i) GROUP BY i) GROUP BY t")
def s17_block_sample(spark, sf):
    picked = ingest.block_sample(emb_movie(spark, sf), _n_t(emb_movie(spark, sf)), 100, 25)
    return rounded(picked.groupBy("t").agg(F.sum("v").alias("s")), "s", digits=5)


@query("SELECT event_type, CAST(nullif(regexp_extract(concat(CAST(event_id % 60 AS VARCHAR), 'FPS'), '(\\d+)FPS', 1), '') AS DOUBLE) AS fps, count(*) AS n FROM events GROUP BY 1, 2")
def s18_session_fps(spark, sf):
    e = read(spark, sf, "events").select("event_type", F.concat((F.col("event_id") % 60).cast("string"), F.lit("FPS")).alias("rate"))
    return e.groupBy("event_type", ingest.fps_of("rate").alias("fps")).agg(F.count("*").alias("n"))


@query("SELECT p_brand AS path, CAST(row_number() OVER (ORDER BY min(p_partkey)) - 1 AS INTEGER) AS nth FROM part GROUP BY p_brand")
def s19_session_paths(spark, sf):
    return ingest.distinct_paths(read(spark, sf, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("pos")))


# ---------------------------------------------------------------- background

_RING = """off AS (SELECT dy, dx FROM (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx) WHERE dy * dy + dx * dx > 4 AND dy * dy + dx * dx <= 9),
ring AS (SELECT CAST(g.y * 8 + g.x AS INTEGER) AS p, CAST((g.y + dy) * 8 + g.x + dx AS INTEGER) AS q
  FROM (SELECT i // 8 AS y, i % 8 AS x FROM (SELECT unnest(range(64)) AS i)) AS g, off WHERE g.y + dy BETWEEN 0 AND 7 AND g.x + dx BETWEEN 0 AND 7),
w AS (SELECT p, q, 1.0 / count(*) OVER (PARTITION BY p) AS w FROM ring),
m AS (SELECT t, y * 8 + x AS p, v FROM emb_movie),
b0 AS (SELECT p, avg(v) AS b0 FROM m GROUP BY p)"""


def _ring_parts(spark, sf):
    movie = movies.with_pixel(emb_movie(spark, sf), 8).select("t", "p", "v")
    ring = background.ring_edges(spark, 8, 8, 2.5)
    ring = ring.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("p")))
    return movie, ring, background.baseline(movie)


@query(with_views("li_footprints") + """,
d AS (SELECT dy, dx FROM (SELECT unnest(range(-3, 4)) AS dy) AS a, (SELECT unnest(range(-3, 4)) AS dx) AS b WHERE dy * dy + dx * dx > 4 AND dy * dy + dx * dx <= 9)
SELECT f.k, count(*) AS n, round(sum(f.a * g.a), 4) AS total FROM li_footprints AS f, d JOIN li_footprints AS g
  ON g.k = f.k AND f.p // 32 + d.dy BETWEEN 0 AND 31 AND f.p % 32 + d.dx BETWEEN 0 AND 31 AND g.p = f.p + 32 * d.dy + d.dx GROUP BY f.k""")
def b1_ring_edges(spark, sf):
    """Of each footprint the pairs of its pixels of which one lies on the other's ring."""
    f = li_footprints(spark, sf)
    edges = background.ring_edges(spark, 32, 32, 2.5)
    both = f.join(edges, "p").join(f.select("k", F.col("p").alias("q"), F.col("a").alias("b")), ["k", "q"])
    return rounded(both.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("a") * F.col("b")).alias("total")), "total", digits=4)


@query(with_views("emb_movie") + f",\n{_RING}\nSELECT p, round(b0, 6) + 0.0 AS b0 FROM b0")
def b2_baseline(spark, sf):
    return rounded(_ring_parts(spark, sf)[2], "b0")


@query(with_views("emb_movie") + f""",
{_RING}
SELECT m.t, m.p, round(m.v - b0.b0 - coalesce(s.bg, 0), 6) + 0.0 AS v FROM m JOIN b0 USING (p)
LEFT JOIN (SELECT n.t, w.p, sum(w.w * (n.v - c.b0)) AS bg FROM w JOIN m AS n ON n.p = w.q JOIN b0 AS c ON c.p = w.q GROUP BY 1, 2) AS s ON s.t = m.t AND s.p = m.p""")
def b7_ring_subtract(spark, sf):
    return rounded(background.subtract(*_ring_parts(spark, sf), (8, 8), 2.5), "v")


@query(with_views("emb_movie") + f""",
{_RING},
bg AS (SELECT m.t, m.p, m.v - b0.b0 - coalesce(s.bg, 0) AS v FROM m JOIN b0 USING (p)
  LEFT JOIN (SELECT n.t, w.p, sum(w.w * (n.v - c.b0)) AS bg FROM w JOIN m AS n ON n.p = w.q JOIN b0 AS c ON c.p = w.q GROUP BY 1, 2) AS s ON s.t = m.t AND s.p = m.p),
a AS (SELECT l_suppkey AS k, CAST(l_partkey % 64 AS INTEGER) AS p, sum(l_quantity) AS a FROM lineitem GROUP BY 1, 2)
SELECT a.k, bg.t, round(sum(bg.v * a.a), 4) + 0.0 AS v FROM bg JOIN a USING (p) GROUP BY 1, 2""")
def b11_project_onto(spark, sf):
    movie, ring, b0 = _ring_parts(spark, sf)
    a = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.expr("cast(l_partkey % 64 as int)").alias("p")).agg(F.sum("l_quantity").alias("a"))
    return background.project(movie, ring, b0, a, digits=4)


@query(with_views("emb_movie") + "\nSELECT t, round(sum(v * (y * 8 + x)), 5) + 0.0 AS v FROM emb_movie GROUP BY t")
def b13_times_vector(spark, sf):
    movie = movies.with_pixel(emb_movie(spark, sf), 8).select("t", "p", "v")
    vector = spark.range(64).select(F.col("id").cast("int").alias("p"), F.col("id").cast("double").alias("w"))
    return rounded(background.times_vector(movie, vector, "p"), "v", digits=5)


# ---------------------------------------------------------------- components


@query(with_views("li_footprints") + """,
f AS (SELECT k, p // 32 AS y, p % 32 AS x FROM li_footprints),
o AS (SELECT dy, dx FROM (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) WHERE abs(dy) + abs(dx) <= 2),
n AS (SELECT DISTINCT CAST((y + dy) * 32 + x + dx AS INTEGER) AS p, k FROM f, o WHERE y + dy BETWEEN 0 AND 31 AND x + dx BETWEEN 0 AND 31)
SELECT p, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM n GROUP BY p""")
def a1_support(spark, sf):
    s = components.support(li_footprints(spark, sf), 32, 32, 2)
    return s.select("p", F.size("ks").cast("long").alias("n"), F.aggregate("ks", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query(with_views("li_footprints") + """,
e AS (SELECT k, p, a, sum(a * a) OVER (PARTITION BY k ORDER BY a DESC, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run, sum(a * a) OVER (PARTITION BY k) AS total FROM li_footprints)
SELECT k, p, round(a, 6) AS a FROM e WHERE coalesce(run, 0) < 0.95 * total""")
def a7_energy_threshold(spark, sf):
    return rounded(components.energy_threshold(li_footprints(spark, sf)), "a")


@query(with_views("li_footprints") + "\nSELECT k, p, round(a, 6) AS a FROM (SELECT *, max(a) OVER (PARTITION BY k) AS top FROM li_footprints) WHERE a >= 0.2 * top")
def s21_peak_threshold(spark, sf):
    return rounded(components.peak_threshold(li_footprints(spark, sf), 0.2), "a")


@query(with_views("li_footprints") + "\nSELECT k, p, round(a / sqrt(sum(a * a) OVER (PARTITION BY k)), 6) AS a FROM li_footprints")
def p15_gauge_footprints(spark, sf):
    return rounded(components.gauge(li_footprints(spark, sf), evt_traces(spark, sf), ("v",))[0], "a")


@query(with_views("li_footprints", "evt_traces") + ",\nn AS (SELECT k, sqrt(sum(a * a)) AS n FROM li_footprints GROUP BY k)\nSELECT e.k, e.t, round(e.v * n.n, 3) AS v FROM evt_traces AS e JOIN n USING (k)")
def p15_gauge_traces(spark, sf):
    return rounded(components.gauge(li_footprints(spark, sf), evt_traces(spark, sf), ("v",))[1], "v", digits=3)


_JAC = """n AS (SELECT k, sum(a * a) AS e, count(*) AS n FROM li_footprints GROUP BY k),
d AS (SELECT a.k AS i, b.k AS j, sum(a.a * b.a) AS dot, count(*) AS shared FROM li_footprints AS a JOIN li_footprints AS b ON b.p = a.p AND a.k < b.k GROUP BY 1, 2),
jac AS (SELECT i, j, dot / (x.e + y.e - dot) AS jaccard, CAST(shared AS DOUBLE) / (x.n + y.n - shared) AS plain FROM d JOIN n AS x ON x.k = i JOIN n AS y ON y.k = j)"""


@query(with_views("li_footprints") + f",\n{_JAC}\nSELECT i, j, round(jaccard, 6) AS jaccard FROM jac")
def g1_overlap_tanimoto(spark, sf):
    return components.tanimoto(li_footprints(spark, sf), digits=6)


@query(with_views("li_footprints") + f",\n{_JAC}\nSELECT i, j, round(plain, 6) AS jaccard FROM jac")
def e19_binary_jaccard(spark, sf):
    return components.binary_jaccard(li_footprints(spark, sf), digits=6)


@query(with_views("evt_traces") + "\nSELECT a.k AS i, b.k AS j, round(coalesce(corr(a.v, b.v), 0), 6) + 0.0 AS r FROM evt_traces AS a JOIN evt_traces AS b ON b.t = a.t AND a.k < b.k GROUP BY 1, 2")
def g1_trace_correlations(spark, sf):
    return components.trace_correlations(evt_traces(spark, sf), digits=6)


@query(with_views("li_footprints", recursive=True) + f""",
{_JAC},
edge AS (SELECT i, j FROM jac WHERE jaccard > 0.24 UNION SELECT j, i FROM jac WHERE jaccard > 0.24),
reach(k, label) AS (SELECT DISTINCT k, k FROM li_footprints UNION SELECT e.j, r.label FROM reach AS r JOIN edge AS e ON e.i = r.k)
SELECT k, min(label) AS label FROM reach GROUP BY k""")
def g1_merge_groups(spark, sf):
    f = li_footprints(spark, sf)
    return components.label_groups(components.similar_pairs(f, 0.24), f.select("k"))


@query(with_views("li_footprints") + "\nSELECT k // 10 AS k, p, round(sum(a), 6) AS a FROM li_footprints GROUP BY 1, 2")
def g1_merged_footprints(spark, sf):
    f, t = li_footprints(spark, sf), evt_traces(spark, sf)
    groups = f.select("k").distinct().withColumn("label", F.expr("k div 10"))
    return rounded(components.merge(f, t, groups)[0], "a")


@query(with_views("evt_traces") + "\nSELECT k // 10 AS k, t, round(greatest(0, avg(v)), 6) AS v FROM evt_traces GROUP BY 1, 2")
def g1_merged_traces(spark, sf):
    f, t = li_footprints(spark, sf), evt_traces(spark, sf)
    groups = t.select("k").distinct().withColumn("label", F.expr("k div 10"))
    return rounded(components.merge(f, t, groups)[1], "v")


@query(with_views("li_footprints") + "\nSELECT k, round(sum(a * (p // 32)) / sum(a), 6) AS cy, round(sum(a * (p % 32)) / sum(a), 6) AS cx FROM li_footprints GROUP BY k")
def g1_centroids(spark, sf):
    return rounded(components.centroids(li_footprints(spark, sf), 32), "cy", "cx")


_G = """x AS (SELECT k, t, v - avg(v) OVER (PARTITION BY k) AS x FROM evt_traces),
l AS (SELECT k, x, lead(x) OVER (PARTITION BY k ORDER BY t) AS n FROM x),
g AS (SELECT k, CASE WHEN sum(x * x) > 0 THEN least(greatest((sum(x * n) / (count(*) - 1)) / (sum(x * x) / count(*)), 1e-6), 0.9999) ELSE 0.9999 END AS g FROM l GROUP BY k)"""


@query(with_views("evt_traces") + f",\n{_G}\nSELECT k, round(g, 6) AS g FROM g")
def t2_yule_walker(spark, sf):
    return rounded(components.yule_walker(evt_traces(spark, sf)), "g")


@query(with_views("evt_traces") + f",\n{_G}\nSELECT k, round(0.5 * g + 0.5 * exp(-1000.0 / (20 * 180)), 6) AS g FROM g")
def t2_prior_shrinkage(spark, sf):
    g = components.yule_walker(evt_traces(spark, sf))
    return rounded(g.withColumn("g", 0.5 * F.col("g") + 0.5 * F.exp(F.lit(-1000.0 / (20 * 180)))), "g")


@query("SELECT p_partkey AS k, round(exp(-1000.0 / (20 * (p_size + 50))), 8) AS g, round(-1000.0 / (20 * ln(least(greatest(exp(-1000.0 / (20 * (p_size + 50))), 1e-6), 0.999999))), 6) AS tau FROM part")
def t9_decay_time(spark, sf):
    """T9 and T10: coefficient of a decay time, and back."""
    from lumenframe.functions.sql import decay_to_g, g_to_decay

    p = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), decay_to_g(F.col("p_size") + 50, 20.0).alias("g"))
    return rounded(rounded(p.withColumn("tau", g_to_decay(F.col("g"), 20.0)), "tau"), "g", digits=8)


@query(with_views("li_footprints") + "\nSELECT k, round(sqrt(sum(power(a * (1 + p % 5), 2))) / sum(a * a), 8) AS sn_k FROM li_footprints GROUP BY k")
def t12_footprint_noise(spark, sf):
    f = li_footprints(spark, sf)
    noise = spark.range(1024).select(F.col("id").cast("int").alias("p"), (1 + F.col("id") % 5).cast("double").alias("sn"))
    return rounded(components.footprint_noise(f, noise), "sn_k", digits=8)


# ---------------------------------------------------------------- quality


@query(with_views("li_footprints") + "\nSELECT k, count(*) AS npix, round(sum(a * a) / count(*) / greatest(avg(power(1 + p % 5, 2)), 1e-12), 5) AS snr_amp, count(*) >= 100 AND sum(a * a) / count(*) / greatest(avg(power(1 + p % 5, 2)), 1e-12) >= 100 AS keep FROM li_footprints GROUP BY k")
def e1_component_snr(spark, sf):
    noise = spark.range(1024).select(F.col("id").cast("int").alias("p"), (1 + F.col("id") % 5).cast("double").alias("sn"))
    return rounded(evaluate.component_snr(li_footprints(spark, sf), noise, 100, 100.0), "snr_amp", digits=5)


@query(with_views("evt_traces") + """,
y AS (SELECT k, t, v, v / 2 AS yra, v + v / 2 AS y FROM evt_traces),
s AS (SELECT k, yra, sum(y) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS smooth, t FROM y),
m AS (SELECT k, median(yra) AS med, max(smooth) AS peak FROM s GROUP BY k),
d AS (SELECT s.k, median(abs(s.yra - m.med)) AS mad, max(m.peak) AS peak FROM s JOIN m USING (k) GROUP BY s.k)
SELECT k, round(CASE WHEN mad > 0 THEN peak / (1.4826 * mad) ELSE 0 END, 5) AS peak_snr FROM d""")
def e3_peak_snr(spark, sf):
    return rounded(evaluate.peak_snr(evt_traces(spark, sf).withColumn("yra", F.col("v") / 2)), "peak_snr", digits=5)


@query(with_views("evt_traces") + "\nSELECT k, round(skewness(v), 5) + 0.0 AS skew, round(kurtosis(v), 5) + 0.0 AS kurtosis FROM evt_traces GROUP BY k")
def e4_trace_moments(spark, sf):
    return rounded(evaluate.trace_moments(evt_traces(spark, sf)), "skew", "kurtosis", digits=5)


@query(with_views("evt_traces") + """,
x AS (SELECT k, t, v - avg(v) OVER (PARTITION BY k) AS x FROM evt_traces), l AS (SELECT k, x, lag(x) OVER (PARTITION BY k ORDER BY t) AS b FROM x)
SELECT k, round(sum(x * b) / sum(x * x), 6) + 0.0 AS autocorr_lag1 FROM l GROUP BY k""")
def e5_autocorrelation(spark, sf):
    return rounded(evaluate.autocorrelation(evt_traces(spark, sf)), "autocorr_lag1")


@query(with_views("evt_traces") + "\nSELECT k, round(coalesce(corr(v, v * v + t), 0), 6) AS r FROM evt_traces GROUP BY k")
def e10_per_cell_correlation(spark, sf):
    return rounded(evaluate.correlation_by(evt_traces(spark, sf).withColumn("w", F.col("v") * F.col("v") + F.col("t")), "v", "w"), "r")


@query(with_views("li_footprints") + """,
f AS (SELECT * FROM li_footprints),
b AS (SELECT k, greatest(min(p // 32) - 2, 0) AS y0, least(max(p // 32) + 2, 31) AS y1, greatest(min(p % 32) - 2, 0) AS x0, least(max(p % 32) + 2, 31) AS x1 FROM f GROUP BY k),
g AS (SELECT b.k, i AS p FROM b JOIN (SELECT unnest(range(1024)) AS i) ON i // 32 BETWEEN y0 AND y1 AND i % 32 BETWEEN x0 AND x1)
SELECT g.k, round(coalesce(corr(coalesce(f.a, 0), sin(g.p)), 0), 6) + 0.0 AS cn_corr FROM g LEFT JOIN f ON f.k = g.k AND f.p = g.p GROUP BY g.k""")
def e11_spatial_correlation(spark, sf):
    image = spark.range(1024).select(F.col("id").cast("int").alias("p"), F.sin("id").alias("cn"))
    f = li_footprints(spark, sf)
    return rounded(evaluate.spatial_correlation(f, image, 32, 32, 2), "cn_corr")


@query(with_views("evt_traces") + """,
m AS (SELECT k, skewness(v) AS skew, max(v) AS top FROM evt_traces GROUP BY k)
SELECT count(*) AS n, round(quantile_cont(skew, 0.5), 5) AS skew_median, round(quantile_cont(skew, 0.25), 5) AS skew_p25, round(quantile_cont(skew, 0.75) - quantile_cont(skew, 0.25), 5) AS skew_iqr,
  round(quantile_cont(top, 0.5), 5) AS top_median, round(quantile_cont(top, 0.25), 5) AS top_p25, round(quantile_cont(top, 0.75) - quantile_cont(top, 0.25), 5) AS top_iqr FROM m""")
def e12_quality(spark, sf):
    t = evt_traces(spark, sf)
    m = evaluate.trace_moments(t).join(t.groupBy("k").agg(F.max("v").alias("top")), "k")
    names = [f"{a}_{b}" for a in ("skew", "top") for b in ("median", "p25", "iqr")]
    return rounded(evaluate.quality(m, ["skew", "top"]), *names, digits=5)


@query("""SELECT p_partkey AS k, CASE WHEN m = '' THEN 'PASS' ELSE 'WARN' END AS verdict, m AS missed FROM (
  SELECT p_partkey, concat_ws(',', CASE WHEN p_size / 50.0 < 0.8 THEN 'recall' END, CASE WHEN p_partkey % 10 / 10.0 < 0.8 THEN 'precision' END,
    CASE WHEN p_partkey % 7 > 0 AND p_partkey % 7 / 7.0 < 0.5 THEN 'cproj' END, CASE WHEN p_partkey % 3 / 3.0 > 0.4 THEN 'trace_corr' END) AS m FROM part)""")
def e14_verdict(spark, sf):
    k = F.col("p_partkey")
    q = read(spark, sf, "part").select(k.alias("k"), (F.col("p_size") / 50.0).alias("recall"), (k % 10 / 10.0).alias("precision"), F.when(k % 7 > 0, k % 7 / 7.0).alias("cproj"), (k % 3 / 3.0).alias("trace_corr"))
    return evaluate.verdict(q).select("k", "verdict", "missed")


@query("SELECT p_partkey AS k, round(p_size / 50.0 + p_partkey % 10 / 10.0 + 0.5 * (p_partkey % 3) / 2.0 - 0.25 * coalesce(CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 / 4.0 END, 0) - 0.5 * (p_partkey % 5) / 5.0, 6) AS score FROM part")
def e15_composite_score(spark, sf):
    k = F.col("p_partkey")
    q = read(spark, sf, "part").select(k.alias("k"), F.lit(1).alias("n"), (F.col("p_size") / 50.0).alias("corr"), (k % 10 / 10.0).alias("spatial"), (k % 3 / 2.0).alias("accepted"), F.when(k % 4 > 0, k % 4 / 4.0).alias("iqr_share"), (k % 5 / 5.0).alias("multipeak"))
    return rounded(evaluate.composite_score(q).select("k", "score"), "score")


@query(with_views("li_footprints") + """,
m AS (SELECT k, var_samp(p // 32) AS vy, var_samp(p % 32) AS vx, covar_samp(p // 32, p % 32) AS c FROM li_footprints GROUP BY k),
e AS (SELECT k, (vy + vx) / 2 AS mid, sqrt(power((vy - vx) / 2, 2) + c * c) AS gap FROM m)
SELECT k, round(sqrt(greatest(0, 1 - (mid - gap) / (mid + gap))), 6) AS eccentricity FROM e""")
def e18_ellipse_eccentricity(spark, sf):
    return rounded(evaluate.ellipse_eccentricity(li_footprints(spark, sf), 32), "eccentricity")


@query(with_views("li_footprints") + """,
r AS (SELECT k, p, row_number() OVER (PARTITION BY k ORDER BY a DESC, p) AS n FROM li_footprints), m AS (SELECT k, avg(p // 32) AS my, avg(p % 32) AS mx FROM li_footprints GROUP BY k)
SELECT m.k, round(sqrt(power(r.p // 32 - my, 2) + power(r.p % 32 - mx, 2)), 6) AS drift FROM m JOIN r ON r.k = m.k AND r.n = 1""")
def e20_centre_drift(spark, sf):
    return rounded(evaluate.centre_drift(li_footprints(spark, sf), 32), "drift")


# ---------------------------------------------------------------- sessions

_PAIRS = "pair AS (SELECT a.session AS sa, a.k AS i, b.session AS sb, b.k AS j, sqrt(power(a.cy - b.cy, 2) + power(a.cx - b.cx, 2)) AS dist FROM part_cells AS a JOIN part_cells AS b ON a.session < b.session AND abs(a.cy - b.cy) <= 5 AND abs(a.cx - b.cx) <= 5 WHERE sqrt(power(a.cy - b.cy, 2) + power(a.cx - b.cx, 2)) <= 5)"


@query(with_views("part_cells") + f",\n{_PAIRS}\nSELECT sa, i, sb, j, round(dist, 6) AS dist FROM pair")
def g9_radius_join(spark, sf):
    return cells.session_pairs(part_cells(spark, sf), 5.0, lambda met: rounded(met, "dist"))


@query(with_views("part_cells") + f",\n{_PAIRS}\nSELECT sa, i, sb, j, round(dist, 6) AS dist, CAST(row_number() OVER (PARTITION BY sa, i, sb ORDER BY round(dist, 9), j) AS INTEGER) AS rank, row_number() OVER (PARTITION BY sa, i, sb ORDER BY round(dist, 9), j) = 1 AS is_nn FROM pair")
def g11_nearest_split(spark, sf):
    return cells.nearest_within(part_cells(spark, sf), 5.0, shown=6)


@query(with_views("li_footprints") + """,
f AS (SELECT * FROM li_footprints), u AS (SELECT DISTINCT a.k AS i, b.k AS j FROM f AS a JOIN f AS b ON a.p = b.p AND a.k < b.k),
s AS (SELECT u.i, u.j, f.p FROM u JOIN f ON f.k = u.i UNION SELECT u.i, u.j, f.p FROM u JOIN f ON f.k = u.j)
SELECT s.i, s.j, round(coalesce(corr(coalesce(a.a, 0), coalesce(b.a, 0)), 0), 6) + 0.0 AS corr FROM s LEFT JOIN f AS a ON a.k = s.i AND a.p = s.p LEFT JOIN f AS b ON b.k = s.j AND b.p = s.p GROUP BY s.i, s.j""")
def g10_union_correlation(spark, sf):
    return components.overlap_correlations(li_footprints(spark, sf), digits=6)


def _map(spark, sf):
    return read(spark, sf, "part").select((F.col("p_partkey") % 500).alias("g"), F.expr("p_size % 3").alias("session"), F.col("p_partkey").alias("k")).groupBy("g", "session").agg(F.min("k").alias("k"))


_MAP = "map AS (SELECT p_partkey % 500 AS g, p_size % 3 AS session, min(p_partkey) AS k FROM part GROUP BY 1, 2)"


@query(f"WITH {_MAP} SELECT n, count(*) AS clusters FROM (SELECT g, count(*) AS n FROM map GROUP BY g) GROUP BY n")
def g26_registered_counts(spark, sf):
    return _map(spark, sf).groupBy("g").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("clusters"))


@query(f"WITH {_MAP} SELECT g, min(CASE WHEN session = 0 THEN k END) AS \"0\", min(CASE WHEN session = 1 THEN k END) AS \"1\", min(CASE WHEN session = 2 THEN k END) AS \"2\" FROM map GROUP BY g HAVING count(*) >= 2")
def g27_registered_map(spark, sf):
    return cells.registered(_map(spark, sf), [0, 1, 2], 2)


@query(with_views("part_cells") + f""",
{_PAIRS}, {_MAP},
p AS (SELECT *, exp(-dist / 2) AS p FROM pair)
SELECT round(avg(p), 6) AS mean_p, round(avg(CASE WHEN p > 0.05 AND p < 0.95 THEN 1.0 ELSE 0 END), 6) AS uncertain, count(*) AS n
FROM p JOIN map AS a ON a.session = sa AND a.k = i JOIN map AS b ON b.session = sb AND b.k = j WHERE a.g % 50 = b.g % 50""")
def g21_registration_scores(spark, sf):
    cell_map = _map(spark, sf).withColumn("g", F.col("g") % 50).select("g", "session", "k")
    # pairs of cells off the map are not scored, and so not made
    pairs = cells.session_pairs(part_cells(spark, sf).join(cell_map, ["session", "k"], "left_semi"), 5.0).withColumn("p", F.exp(-F.col("dist") / 2))
    return rounded(cells.registration_scores(cell_map, pairs), "mean_p", "uncertain")


@query(with_views("part_cells") + """,
a AS (SELECT k, cy, cx FROM part_cells WHERE session = 0), b AS (SELECT k, cy, cx FROM part_cells WHERE session = 1),
h AS (SELECT a.k AS i, b.k AS j FROM a JOIN b ON sqrt(power(a.cy - b.cy, 2) + power(a.cx - b.cx, 2)) <= 3)
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, count(DISTINCT i) AS a_hit, count(DISTINCT j) AS b_hit FROM h""")
def g28_two_way_matches(spark, sf):
    c = part_cells(spark, sf)
    return evaluate.two_way_matches(c.where("session = 0"), c.where("session = 1"), 3.0)


@query(with_views("part_cells") + f""",
{_PAIRS}, spot AS (SELECT *, dist / 5 * 10 AS pos, least(floor(dist / 5 * 10), 9) AS bin FROM pair)
SELECT sa, i, sb, j, round(exp(-bin / 3) + (pos - bin) * (exp(-(bin + 1) / 3) - exp(-bin / 3)), 6) AS p FROM spot""")
def g30_p_same_lookup(spark, sf):
    t = spark.range(10).select(F.col("id").cast("int").alias("bin"), F.exp(-F.col("id") / 3.0).alias("p"), F.exp(-(F.col("id") + 1) / 3.0).alias("p_next"))
    return cells.session_pairs(part_cells(spark, sf), 5.0, lambda met: rounded(cells.p_lookup(met, t, 11, 0.0, 5.0, "dist"), "p").drop("dist"))


@query("SELECT p_partkey AS k, round(exp(-0.5 * power((ln(p_size) - 2.0) / 0.7, 2)) / (p_size * 0.7 * sqrt(2 * pi())), 8) AS density FROM part")
def g23_lognormal_density(spark, sf):
    from lumenframe.functions.sql import lognormal_pdf

    return rounded(read(spark, sf, "part").select(F.col("p_partkey").alias("k"), lognormal_pdf(F.col("p_size"), 2.0, 0.7).alias("density")), "density", digits=8)


# ---------------------------------------------------------------- suggestions and grids


@query("""SELECT k, CAST(greatest(1, least(4, floor(2.355 * size / 8 / 4.0))) AS INTEGER) AS ssub, CAST(greatest(1, least(5, floor(price / 10 * 20.0 / 2000.0))) AS INTEGER) AS tsub
FROM (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS size, CAST(p_retailprice AS DOUBLE) AS price FROM part)""")
def h3_downsample(spark, sf):
    """Parts as cells: their size is an eighth of a deviation in pixels, their price a tenth of a decay in ms."""
    from lumenframe.operators import tune

    cells_ = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size").cast("double") / 8).alias("sigma"), (F.col("p_retailprice").cast("double") / 10).alias("decay_ms"))
    return tune.downsampling_of(cells_, 20.0).select("k", "ssub", "tsub")


@query("""WITH g AS (SELECT unnest(range(0, 21)) * 100.0 AS thr), v AS (SELECT p_retailprice AS v, p_size > 25 AS is_cell FROM part),
j AS (SELECT thr, avg(CASE WHEN is_cell THEN CASE WHEN v >= thr THEN 1.0 ELSE 0 END END) - avg(CASE WHEN NOT is_cell THEN CASE WHEN v >= thr THEN 1.0 ELSE 0 END END) AS j FROM g, v GROUP BY thr)
SELECT thr, round(j, 6) + 0.0 AS j FROM j ORDER BY round(j, 9) DESC, thr LIMIT 1""")
def h6_youden_threshold(spark, sf):
    from lumenframe.operators import tune

    values = read(spark, sf, "part").select(F.col("p_retailprice").alias("v"), (F.col("p_size") > 25).alias("is_cell"))
    return rounded(tune.youden(values, [i * 100.0 for i in range(21)]), "thr", "j")


@query("SELECT CASE WHEN count(*) < 5 OR quantile_cont(p_retailprice, 0.25) <= 0.4 THEN 0.8 ELSE round(quantile_cont(p_retailprice, 0.25), 6) END AS thr, quantile_cont(p_retailprice, 0.25) <= 0.4 AS edge FROM part")
def h7_percentile_threshold(spark, sf):
    from lumenframe.operators import tune

    return rounded(tune.threshold_at_percentile(read(spark, sf, "part").select(F.col("p_retailprice").alias("v"))), "thr")


@query(with_views("evt_traces") + f",\n{_G}\nSELECT round(median(-1000.0 / (20 * ln(least(greatest(g, 1e-6), 0.999999)))), 4) AS tau FROM g")
def h9_decay_time(spark, sf):
    from lumenframe.operators import tune

    return rounded(tune.decay_time(components.yule_walker(evt_traces(spark, sf)), 20.0), "tau", digits=4)


@query(with_views("evt_traces") + f",\n{_G},\ns AS (SELECT median(abs((g - exp(-1000.0 / 3600)) / exp(-1000.0 / 3600))) AS s FROM g)\nSELECT round(s, 6) AS spread, CASE WHEN s < 0.05 THEN 0.3 WHEN s < 0.15 THEN 0.5 ELSE 0.7 END AS weight FROM s")
def h10_prior_weight(spark, sf):
    from lumenframe.operators import tune

    return rounded(tune.prior_weight(components.yule_walker(evt_traces(spark, sf)), 20.0, 180.0), "spread", "weight")


@query(with_views("evt_traces") + ",\nr AS (SELECT coalesce(corr(a.v, b.v), 0) AS r FROM evt_traces AS a JOIN evt_traces AS b ON b.t = a.t AND a.k < b.k GROUP BY a.k, b.k)\nSELECT round(quantile_cont(r, 0.99), 6) AS p99, round(least(0.85, greatest(quantile_cont(r, 0.99), 0.7)), 6) AS thr FROM r")
def h11_merge_threshold(spark, sf):
    from lumenframe.operators import tune

    return rounded(tune.merge_threshold(evt_traces(spark, sf)), "p99", "thr")


@query("""WITH v AS (SELECT s_acctbal / 1000.0 AS snr FROM supplier), g AS (SELECT snr AS a, lead(snr) OVER (ORDER BY snr) AS b FROM v WHERE snr < 10)
SELECT round_even((a + b) / 2, 1) AS thr FROM g WHERE b IS NOT NULL ORDER BY b - a DESC, a LIMIT 1""")
def h12_snr_gap(spark, sf):
    from lumenframe.operators import tune

    return tune.snr_gap(read(spark, sf, "supplier").select((F.col("s_acctbal") / 1000.0).alias("snr_amp")))


@query("""WITH s AS (SELECT list_sort([min(p_size), median(p_size), max(p_size)]) AS sizes FROM part)
SELECT CAST(i AS INTEGER) AS idx, CAST(sizes[i // 4 % 3 + 1] AS DOUBLE) AS sigma, CAST([0.7, 0.85][i // 2 % 2 + 1] AS DOUBLE) AS merge_thr_corr, CAST([0, 1][i % 2 + 1] AS INTEGER) AS global_bg_rank FROM s, (SELECT unnest(range(12)) AS i)""")
def w2_candidate_grid(spark, sf):
    """A grid around the sizes of parts: the smallest, the median and the largest."""
    from lumenframe.operators import tune

    low, mid, high = (float(x) for x in read(spark, sf, "part").agg(F.min("p_size"), F.median("p_size"), F.max("p_size")).collect()[0])
    return tune.candidate_grid(spark, {"sigma": [low, mid, high], "merge_thr_corr": [0.7, 0.85], "global_bg_rank": [0, 1]})


@query("SELECT k, CAST(string_agg(CAST(CAST(v AS INTEGER) AS VARCHAR), ',' ORDER BY v) AS VARCHAR) AS grid FROM (SELECT DISTINCT p_partkey AS k, least(greatest(greatest(p_size, 5) + o, 5), 45) AS v FROM part, (SELECT unnest([-3, 0, 3, 10]) AS o)) GROUP BY k")
def w3_offset_grid(spark, sf):
    from lumenframe.operators import tune

    anchors = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("anchor"))
    return tune.offset_grids(anchors, [-3, 0, 3, 10], 5.0, 45.0).select("k", F.array_join(F.transform("grid", lambda v: v.cast("int").cast("string")), ",").alias("grid"))


@query("""WITH t AS (SELECT p_partkey AS idx, p_retailprice AS score, p_partkey % 5 = 0 AS failed, p_partkey % 3 = 0 AS saturated, p_size > 10 AS beats FROM part)
SELECT idx, round(score, 2) AS score FROM t ORDER BY CASE WHEN NOT failed AND NOT saturated AND beats THEN 0 WHEN NOT failed THEN 1 ELSE 2 END, score DESC, idx LIMIT 1""")
def w10_pick(spark, sf):
    from lumenframe.operators import tune

    k = F.col("p_partkey")
    rows = read(spark, sf, "part").select(k.alias("idx"), F.col("p_retailprice").alias("score"), F.when(k % 5 == 0, "failed").alias("error"), (k % 3 == 0).alias("saturated"), (F.col("p_size") > 10).alias("beats_raw"))
    return rounded(tune.pick(rows).select("idx", "score"), "score", digits=2)


@query("""WITH t AS (SELECT p_partkey AS idx, p_retailprice AS score, p_partkey % 5 = 0 AS failed FROM part)
SELECT idx, CAST(row_number() OVER (ORDER BY CASE WHEN failed THEN 1 ELSE 0 END, score DESC, idx) AS INTEGER) AS rank FROM t WHERE NOT failed""")
def w1_ranked(spark, sf):
    from lumenframe.operators import tune

    k = F.col("p_partkey")
    rows = read(spark, sf, "part").select(k.alias("idx"), F.col("p_retailprice").alias("score"), F.when(k % 5 == 0, "failed").alias("error"))
    return tune.ranked(rows).where("error is null").select("idx", "rank")
