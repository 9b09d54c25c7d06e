"""The fixed tables seen as movies, traces, footprints and cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _spans(events: DataFrame, seconds: int) -> int:
    """Time spans of so many seconds from the first event's day on to the last event."""
    day, last = events.agg(F.unix_timestamp(F.date_trunc("day", F.min("ts"))), F.unix_timestamp(F.max("ts"))).collect()[0]
    return 0 if day is None else (last - day) // seconds + 1


def emb_movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding is a frame of 8 x 8 pixels: (t, y, x, v)."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("t"), F.posexplode("embedding").alias("i", "e"))
    return e.select("t", F.expr("cast(i div 8 as int)").alias("y"), F.expr("cast(i % 8 as int)").alias("x"), F.col("e").cast("double").alias("v"))


def evt_movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly event values on 12 x 12 pixels of users, zero-filled: (t, y, x, v)."""
    e = read(spark, sf_dir, "events")
    first, n_hours = e.agg(F.date_trunc("day", F.min("ts")).alias("t0")), _spans(e, 3600)
    hours = e.join(F.broadcast(first)).select(F.expr("cast((unix_timestamp(ts) - unix_timestamp(t0)) div 3600 as int)").alias("t"), F.expr("cast(user_id % 144 as int)").alias("p"), "value")
    # partial sums first; then a grid of all hours x 144 cells
    summed = hours.groupBy("t", "p").agg(F.sum("value").alias("s"))
    grid = spark.range(n_hours * 144).select(F.expr("cast(id div 144 as int)").alias("t"), F.expr("cast(id % 144 as int)").alias("p"))
    full = grid.join(summed, ["t", "p"], "left")
    return full.select("t", F.expr("cast(p div 12 as int)").alias("y"), F.expr("cast(p % 12 as int)").alias("x"), F.coalesce("s", F.lit(0.0)).alias("v"))


def evt_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily event values of each user, zero-filled: (k, t, v)."""
    e = read(spark, sf_dir, "events")
    first, n_days = e.agg(F.date_trunc("day", F.min("ts")).alias("t0")), _spans(e, 86400)
    days = e.join(F.broadcast(first)).select(F.col("user_id").alias("k"), F.expr("cast((unix_timestamp(ts) - unix_timestamp(t0)) div 86400 as int)").alias("t"), "value")
    summed = days.groupBy("k", "t").agg(F.sum("value").alias("s"))
    grid = e.select(F.col("user_id").alias("k")).distinct().select("k", F.explode(F.sequence(F.lit(0), F.lit(n_days - 1))).alias("t"))
    return grid.join(summed, ["k", "t"], "left").select("k", "t", F.coalesce("s", F.lit(0.0)).alias("v"))


def li_footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of each supplier on 32 x 32 pixels of parts: (k, p, a)."""
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("k"), F.expr("cast(l_partkey % 1024 as int)").alias("p")).agg(F.sum("l_quantity").alias("a"))


def part_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cells of three sessions: (session, k, cy, cx, w)."""
    p = read(spark, sf_dir, "part")
    return p.select(F.expr("p_size % 3").alias("session"), F.col("p_partkey").alias("k"), F.expr("cast(p_partkey % 100 as double)").alias("cy"), F.expr("cast(cast(p_retailprice as int) % 100 as double)").alias("cx"), F.col("p_retailprice").alias("w"))


#: Side of the field of `cell_frames`, and the centres of its cells.
CELL_FIELD = 36
CELL_CENTRES = [(y, x) for y in (6, 18, 30) for x in (6, 18, 30)]


def cell_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, t, c): hourly event values of the nine users with the smallest ids, in hundreds, each decaying by a tenth an hour."""
    e = read(spark, sf_dir, "events")
    n_hours = _spans(e, 3600)
    users = e.select("user_id").distinct().orderBy("user_id").limit(len(CELL_CENTRES))
    users = users.select("user_id", (F.row_number().over(Window.orderBy("user_id")) - 1).alias("k"))  # nine rows
    first = e.agg(F.date_trunc("day", F.min("ts")).alias("t0"))
    own = e.join(F.broadcast(users), "user_id").join(F.broadcast(first))
    own = own.groupBy("k", F.expr("cast((unix_timestamp(ts) - unix_timestamp(t0)) div 3600 as int)").alias("t")).agg(F.sum("value").alias("v"))

    def decaying(part: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros(n_hours)
        c[part["t"].to_numpy()] = part["v"] / 100
        for t in range(1, n_hours):
            c[t] += 0.9 * c[t - 1]
        return pd.DataFrame({"k": part["k"].iloc[0], "t": np.arange(n_hours), "c": c})

    return own.groupBy("k").applyInPandas(decaying, "k int, t int, c double")


def cell_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames (t, px) of nine blurred cells that carry `cell_signals`, with noise that each frame draws by its number."""
    signals = cell_signals(spark, sf_dir).groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda s: s["c"]).alias("c"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x = np.mgrid[:CELL_FIELD, :CELL_FIELD]
        cells = np.stack([np.exp(-((y - a) ** 2 + (x - b) ** 2) / 8).ravel() for a, b in CELL_CENTRES])
        for batch in batches:
            px = [np.asarray(c, float) @ cells[: len(c)] + np.random.default_rng(int(t)).normal(0, 0.1, cells.shape[1]) for t, c in zip(batch["t"], batch["c"])]
            yield pd.DataFrame({"t": batch["t"], "px": px})

    return signals.mapInPandas(draw, "t int, px array<double>")


#: The same views for the oracle engine, as common table expressions.
SQL = {
    "emb_movie": """emb_movie AS (
  SELECT CAST(vec_id AS INTEGER) AS t, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))""",
    "evt_movie": """evt_movie AS (
  SELECT g.t, CAST(g.p // 12 AS INTEGER) AS y, CAST(g.p % 12 AS INTEGER) AS x, coalesce(s.s, 0.0) AS v
  FROM (SELECT CAST(i // 144 AS INTEGER) AS t, CAST(i % 144 AS INTEGER) AS p FROM (SELECT unnest(range((SELECT 144 * (CAST(floor((epoch(max(ts)) - epoch(date_trunc('day', min(ts)))) / 3600) AS BIGINT) + 1) FROM events))) AS i)) AS g
  LEFT JOIN (SELECT CAST(floor((epoch(ts) - (SELECT epoch(date_trunc('day', min(ts))) FROM events)) / 3600) AS INTEGER) AS t,
      CAST(user_id % 144 AS INTEGER) AS p, sum(value) AS s FROM events GROUP BY 1, 2) AS s ON s.t = g.t AND s.p = g.p)""",
    "evt_traces": """evt_traces AS (
  SELECT g.k, g.t, coalesce(s.s, 0.0) AS v
  FROM (SELECT k, CAST(unnest(range((SELECT CAST(floor((epoch(max(ts)) - epoch(date_trunc('day', min(ts)))) / 86400) AS BIGINT) + 1 FROM events))) AS INTEGER) AS t FROM (SELECT DISTINCT user_id AS k FROM events)) AS g
  LEFT JOIN (SELECT user_id AS k, CAST(floor((epoch(ts) - (SELECT epoch(date_trunc('day', min(ts))) FROM events)) / 86400) AS INTEGER) AS t,
      sum(value) AS s FROM events GROUP BY 1, 2) AS s ON s.k = g.k AND s.t = g.t)""",
    "li_footprints": """li_footprints AS (
  SELECT l_suppkey AS k, CAST(l_partkey % 1024 AS INTEGER) AS p, sum(l_quantity) AS a FROM lineitem GROUP BY 1, 2)""",
    "part_cells": """part_cells AS (
  SELECT p_size % 3 AS session, p_partkey AS k, CAST(p_partkey % 100 AS DOUBLE) AS cy,
    CAST(CAST(trunc(p_retailprice) AS INTEGER) % 100 AS DOUBLE) AS cx, p_retailprice AS w FROM part)""",
}


def with_views(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names)
