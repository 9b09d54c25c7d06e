"""Listing and ordering recordings' files, and placing their frames on one timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stem(path: str | Column) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(p, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def numeric_key(path: str | Column) -> Column:
    """The file's stem as a number, -1 if it is none."""
    return F.coalesce(F.when(stem(path).rlike(r"^\d+$"), stem(path).cast("long")), F.lit(-1).cast("long"))


def timestamp_key(path: str | Column) -> Column:
    """The ISO-like time in the file's name, null if there is none."""
    found = F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"(\d{4}-\d{2}-\d{2}T\d{2}[_:-]\d{2}[_:-]\d{2})", 1)
    return F.when(found != "", found)


def discover(files: DataFrame, path: str = "file") -> DataFrame:
    """(file, number, file_no): files with numbers for names, in their order. A row for each file only."""
    named = files.select(F.col(path).alias("file"), numeric_key(path).alias("number")).where("number >= 0")
    return named.withColumn("file_no", F.row_number().over(Window.orderBy("number", "file")) - 1)


def discover_any(files: DataFrame, path: str = "file") -> DataFrame:
    """(file, file_no) by numbers if any name is one, else by times, else the only file; several without either are an error."""
    keyed = files.select(F.col(path).alias("file"), numeric_key(path).alias("number"), timestamp_key(path).alias("stamp")).cache()
    if keyed.where("number >= 0").limit(1).count():
        return discover(keyed.select("file")).select("file", "file_no")
    stamped = keyed.where("stamp is not null")
    if stamped.limit(1).count():
        return stamped.select("file", (F.row_number().over(Window.orderBy("stamp", "file")) - 1).alias("file_no"))
    if keyed.count() != 1:
        raise ValueError("files have neither numbers nor times in their names")
    return keyed.select("file", F.lit(0).alias("file_no"))


def count_and_shape(frames: DataFrame, height: Column, width: Column, by: str = "file_no") -> DataFrame:
    """(file_no, n, h, w) of each file."""
    return frames.groupBy(by).agg(F.count("*").alias("n"), height.alias("h"), width.alias("w"))


def concat_offsets(frames: DataFrame, by: str = "file_no", local: str = "local_t") -> DataFrame:
    """frames with t: each file's frames after all of the files before it.

    Only the counts, a row for each file, are ordered; frames take their file's offset by a join and may come
    in any order.
    """
    counts = frames.groupBy(by).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return frames.join(counts.select(by, before.alias("start")), by).withColumn("t", F.col("start") + F.col(local)).drop("start")


def evenly(n: int, most: int) -> list[int]:
    """At most that many numbers of 0 .. n - 1, evenly spaced, both ends included."""
    most = min(n, most)
    return sorted({i * (n - 1) // max(1, most - 1) for i in range(most)})


def strided_sample(frames: DataFrame, n_files: int, files: int, stride: int) -> DataFrame:
    """Every stride-th frame of evenly spaced files; both conditions reach the scan."""
    return frames.where(F.col("file_no").isin(evenly(n_files, files)) & (F.col("local_t") % stride == 0))


def contiguous_clip(frames: DataFrame, n_files: int, n: int, start: float = 0.4) -> DataFrame:
    """The first n frames from a share of the list of files on."""
    return frames.where(F.col("file_no") >= int(start * n_files)).orderBy("file_no", "local_t").limit(n)


def block_sample(movie: DataFrame, n_t: int, n: int, block: int) -> DataFrame:
    """Evenly spaced whole blocks of frames, n frames in all; the list of blocks reaches the scan."""
    picked = evenly(max(1, n_t // block), max(1, n // block))
    return movie.where(F.expr(f"t div {block}").isin(picked))


def fps_of(text: str | Column) -> Column:
    """Frame rate of a string such as 20FPS."""
    found = F.regexp_extract(F.col(text) if isinstance(text, str) else text, r"(\d+)\s*FPS", 1)
    return F.when(found != "", found.cast("double"))


def measured_fps(stamps: DataFrame, time_ms: str = "time_ms") -> DataFrame:
    """(fps): frames less one over the time between first and last."""
    return stamps.agg(((F.count("*") - 1) / ((F.max(time_ms) - F.min(time_ms)) / 1000)).alias("fps"))


def distinct_paths(items: DataFrame, path: str = "path", pos: str = "pos") -> DataFrame:
    """(path, nth): paths once each, in the order of their first mention."""
    first = items.groupBy(path).agg(F.min(pos).alias("first"))
    return first.select(F.col(path).alias("path"), (F.row_number().over(Window.orderBy("first")) - 1).alias("nth"))
