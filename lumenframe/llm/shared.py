"""Tables that driver and executors share, and small expressions used by several operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a Python worker gets at a time.
BATCH = 2_000
BATCH_BYTES = 4_000_000

#: Words of a text: runs of anything but ASCII white space.
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def tidy(f):
    """A function over batches that hands its worker's free memory back when its partition ends.

    Workers are used again and would otherwise keep the most that any stage has needed.
    """

    @functools.wraps(f)
    def run(batches):
        yield from f(batches)
        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Where no folder is named, a local session (tests) gets a temporary one, set as its checkpoint folder, so that
    later calls find the same; on a cluster that is an error, since executors could not read one another's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        found = context._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='lumenframe-')}"
        context.setCheckpointDir(named)
    return named


def bounded(spark: SparkSession) -> None:
    """Python workers get at most BATCH rows and BATCH_BYTES at a time: texts can be long.

    A setting of the session, since plans that an operator returns run after it; smaller values stay.
    """
    for key, most in (("maxRecordsPerBatch", str(BATCH)), ("maxBytesPerBatch", str(BATCH_BYTES))):
        key = f"spark.sql.execution.arrow.{key}"
        before = spark.conf.get(key, None)
        if not (before and before.isdigit() and 0 < int(before) <= int(most)):
            spark.conf.set(key, most)


def written(df: DataFrame, name: str, codec: str = "zstd", spread: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut and its size is known to the planner.

    Partitions that a shuffle leaves are put together up to the session's advisory size, so that small tables are
    few files, unless the last stage is to be spread over all cores.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    bounded(spark)
    key = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true" if spread else "false")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that `written` has made and that no plan reads any more; other frames stay as they are.

    The session's garbage is collected, upon which Spark removes the shuffle files of steps that have ended.
    """
    for spark in {df.sparkSession for df in tables}:
        sweep(spark)
    for df in tables:
        if path := getattr(df, "_written", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps that have ended: it does so when their plans are collected."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(column: str | Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null stays null."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % n


def unit_hash(*columns: str) -> Column:
    """A reproducible number in [0, 1) from the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not use: each name, with underscores in front as needed."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
