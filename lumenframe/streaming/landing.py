"""Files of a running recording, registered as they land; and windowed statistics of an event stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from lumenframe.operators import kernels

FRAMES = StructType([StructField("t", IntegerType()), StructField("px", ArrayType(DoubleType()))])


def landed(spark: SparkSession, folder: str, files_at_once: int = 16) -> DataFrame:
    """Frames (t, px) of Parquet files that appear in a folder, a bounded number of files at a time."""
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def register_landed(frames: DataFrame, template: np.ndarray, out: str, checkpoint: str, **settings) -> StreamingQuery:
    """Registers landed frames to a frozen template and appends (t, px, dy, dx) to out.

    A frame's number is its place, so frames may land in any order, and the sink's log makes each batch count once.
    """
    moved = kernels.register(frames, template, **settings)
    return moved.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def activity(events: DataFrame, every: str = "1 hour", late: str = "1 day", *, slide: str | None = None, gap: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, start, stop, n, total) of events (by, ts, value) in windows; events later than the watermark are dropped.

    Windows tumble, overlap where slide is shorter than every, or with gap are sessions: runs of events of one key
    (by) whose neighbours lie less than gap apart.
    """
    w = F.session_window("ts", gap) if gap else F.window("ts", every, slide or every)
    found = events.withWatermark("ts", late).groupBy(*by, w.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total")


def running_peaks(events: DataFrame, decay: float = 0.9) -> DataFrame:
    """(k, n, last, peak) of a stream (k, value): every key's decaying sum after its newest value, and its highest so far.

    The sum of a key is state that carries over batches, value by value in the order of arrival; a row for each key
    of a batch tells where it stands.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, peak = state.get if state.exists else (0, 0.0, 0.0)
        for part in parts:
            for v in part["value"]:
                n, last = n + 1, decay * last + float(v)
                peak = max(peak, last)
        state.update((n, last, peak))
        yield pd.DataFrame({"k": [key[0]], "n": [n], "last": [last], "peak": [peak]})

    kind = dict(events.dtypes)["k"]
    return events.select("k", "value").groupBy("k").applyInPandasWithState(step, f"k {kind}, n long, last double, peak double", "n long, last double, peak double", "update", GroupStateTimeout.NoTimeout)
