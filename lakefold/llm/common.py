"""Shared folders and stored intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefold.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's checkpoint folder, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


BATCH_BYTES = "8m"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python in batches of ``BATCH_BYTES``: long texts otherwise fill 64 MB on both sides of the pipe."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(frame: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``frame`` written once to the shared folder and read back: its lineage is cut, its rows are fixed."""
    return stored_at(frame, name, compression)[0]


def stored_at(frame: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """As ``stored``, and the folder, for tables that can be discarded before the job ends."""
    spark = frame.sparkSession
    path = shared_folder(spark, name)
    with small_batches(spark):
        frame.write.option("compression", compression).parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


MARK_PAGES = 4096  # bitmaps of 32,768 bits each


def may_match(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` can be among ``keys`` (one column); nulls are not.

    The hashes of the keys are marked in bitmaps of 16 MB together, whatever the input, which are broadcast.  A hash that
    others share lets rows through that have no match, so an exact join follows; it then moves few rows without a match.
    """
    hashed = lambda name: F.xxhash64(name)
    page = lambda h: F.pmod(h, F.lit(MARK_PAGES)).cast("int")
    bit = lambda h: F.pmod(F.shiftright(h, 24), F.lit(32768))
    kind, name = rows.schema[key].dataType, keys.columns[0]
    same = keys.schema[name].dataType.simpleString() == kind.simpleString()
    marks = keys.select((F.col(name) if same else F.col(name).try_cast(kind)).alias("k")).where("k IS NOT NULL").select(hashed("k").alias("h"))
    marks = marks.select(page(F.col("h")).alias("__page"), bit(F.col("h")).alias("bit")).repartition("__page")  # a page is built in one task
    marks = marks.groupBy("__page").agg(F.bitmap_construct_agg("bit").alias("__bits"))

    def marked(h: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("__bits"), (bit(h) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, F.pmod(bit(h), F.lit(8)).cast("int")) == 1

    own = rows.where(F.col(key).isNotNull()).withColumn("__page", page(hashed(key)))
    return own.join(F.broadcast(marks), "__page").where(marked(hashed(key))).select(*rows.columns)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored table that no later job reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def open_fs(uri: str):
    """The Arrow file system of ``uri`` and the path inside it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)
