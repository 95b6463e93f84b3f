"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lakefold", cores: str | int = "*", **conf: str) -> SparkSession:
    """Local session for tests and the bench; on a cluster pass your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", "8"))
        .config("spark.driver.memory", conf.pop("driver_memory", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the cluster's setting, or a fresh one where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or os.environ.get("LAKEFOLD_CHECKPOINT_DIR")
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="lakefold-checkpoint-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written once below the checkpoint folder and read back: row placements and lineage are fixed."""
    path = f"{ensure_checkpoint_dir(frame.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
