"""Benchmark tables and the query registry."""

from __future__ import annotations

import textwrap
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


# Files a trigger of a table at rest takes: a table in several parts arrives whole, as one in a single file does.
ALL_FILES = 2147483647

# Tables whose rows feed parsers.
_PARSED = {"documents", "pages", "orders", "part", "customer"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table.

    A small table is one row group and would be parsed by one task, so tables that feed parsers
    are spread over the cores when the scan has fewer splits than that.  A lake-sized table has
    more splits than cores and is read as it lies, without a shuffle.  The rows are spread round-robin,
    so no later grouping or join is spared its own shuffle.
    """
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in _PARSED and frame.rdd.getNumPartitions() < cores:
        return frame.repartition(cores)
    return frame


def of_tables(files: DataFrame, *columns: Column) -> DataFrame:
    """What ``columns`` say of the tables of a folder, by ``name``: a table is one file or a folder of parts, and parts that agree are one row."""
    return files.select(F.regexp_extract("path", "([^/]+[.]parquet)(?:/.*)?$", 1).alias("name"), *columns).distinct()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` together with the DuckDB SQL that gives the same rows."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = textwrap.dedent(sql).strip()
        return fn

    return register
