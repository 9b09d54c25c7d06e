"""Windows with late data, and state that carries over batches, on files that land one after the other."""

import datetime as dt

import pytest

from lumenframe.streaming import landing

DAY = dt.datetime(2024, 5, 1)


def land(spark, folder, rows):
    spark.createDataFrame([(k, DAY + dt.timedelta(minutes=m), float(v)) for k, m, v in rows], "k long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(folder)


def read(spark, folder):
    return spark.readStream.schema("k long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(folder)


def drained(df, path, mode="append"):
    df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").outputMode(mode).trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("settings,want", [
    ({"every": "1 hour"}, {(0, 60): (2, 3.0), (60, 120): (1, 4.0)}),
    ({"every": "2 hours", "slide": "1 hour"}, {(-60, 60): (2, 3.0), (0, 120): (3, 7.0)}),
])
def test_windows_drop_what_is_later_than_the_watermark(spark, tmp_path, settings, want):
    folder = f"{tmp_path}/in"
    land(spark, folder, [(1, 5, 1), (1, 70, 4), (1, 200, 9)])
    df = landing.activity(read(spark, folder), late="3 hours", **settings)
    drained(df, tmp_path)
    land(spark, folder, [(2, 30, 2)])  # late, within the watermark of 20 minutes past the first hour's begin
    drained(df, tmp_path)
    land(spark, folder, [(2, 900, 1)])  # moves the watermark over the first windows
    drained(df, tmp_path)
    land(spark, folder, [(2, 40, 100), (2, 2000, 1)])  # too late, and what closes the rest
    drained(df, tmp_path)
    rows = {((r.start - DAY).total_seconds() / 60, (r.stop - DAY).total_seconds() / 60): (r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {w: rows[w] for w in want} == want and all(total < 100 for _, total in rows.values())


def test_sessions_end_at_gaps(spark, tmp_path):
    folder = f"{tmp_path}/in"
    land(spark, folder, [(1, 0, 1), (1, 8, 2), (1, 30, 4), (2, 5, 8)])
    land(spark, folder, [(1, 900, 1), (2, 900, 1)])
    df = landing.activity(read(spark, folder), late="1 minute", gap="10 minutes", by=("k",))
    drained(df, tmp_path)
    rows = {(r.k, (r.start - DAY).total_seconds() / 60, (r.stop - DAY).total_seconds() / 60): r.total for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert rows == {(1, 0, 18): 3.0, (1, 30, 40): 4.0, (2, 5, 15): 8.0}


def test_state_carries_over_batches(spark, tmp_path):
    folder, seen = f"{tmp_path}/in", []
    query = lambda: landing.running_peaks(read(spark, folder), 0.5).writeStream.foreachBatch(lambda d, i: seen.extend(map(tuple, d.collect()))).option("checkpointLocation", f"{tmp_path}/log").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    land(spark, folder, [(1, 0, 8), (2, 0, 1)])
    query()
    land(spark, folder, [(1, 1, 2)])
    query()
    assert sorted(seen) == [(1, 1, 8.0, 8.0), (1, 2, 6.0, 8.0), (2, 1, 1.0, 1.0)]
