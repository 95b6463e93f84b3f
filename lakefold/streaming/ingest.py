"""Arriving files: detect by name and leading bytes, or parse into one table per family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import parsing
from ..registry import SIZE_LIMIT, FormatRegistry
from ..sources.ranged import file_headers


def detect_stream(files: DataFrame, registry: FormatRegistry | None = None) -> DataFrame:
    """``(path, modificationTime, length, type, family, error)`` of a batch or stream of files.

    Sixteen bytes of each file are read; contents are never loaded, so files of any size pass.
    """
    heads = file_headers(files.select("path", "modificationTime", "length"), 16)
    routed = parsing.route(heads, registry or parsing.default_registry(), F.col("header"))
    return routed.select("path", "modificationTime", "length", "type", "family", "error")


def ingest(files: DataFrame, table_folder: str, checkpoint: str, registry: FormatRegistry | None = None) -> StreamingQuery:
    """Append detected files below ``table_folder``, partitioned by family; re-run triggers overwrite themselves."""

    def write(batch: DataFrame, number: int) -> None:
        detect_stream(batch, registry).write.mode("overwrite").partitionBy("family").parquet(f"{table_folder}/batch={number}")

    return (
        files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def ingest_tables(
    files: DataFrame, table_folder: str, checkpoint: str, registry: FormatRegistry | None = None, max_size: int = SIZE_LIMIT
) -> StreamingQuery:
    """Parse arriving ``(path, length, content)`` into ``family=F/batch=N/type=T`` and errors into ``family=errors``.

    A batch is staged by type next to the checkpoint and its stage is removed at its end; a repeated trigger replaces
    the files of its batch number and nothing else.
    """
    known = registry or parsing.default_registry()

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stage = f"{checkpoint.rstrip('/')}-stage/batch={number}"
        staged = parsing.stage_files(batch, stage, known, max_size)
        parsing.write_batch(spark, staged, table_folder, number, known)
        path = spark._jvm.org.apache.hadoop.fs.Path(stage)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
