"""Aggregates over points and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import page_index


def centroid(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Mean point per group (partial sums before the shuffle)."""
    return points.groupBy(*keys).agg(F.avg(x).alias("x"), F.avg(y).alias("y"))


def page_slice(pages: DataFrame, key: list[str], page_no: str, requested: Column) -> DataFrame:
    """Rows of the requested page of each file, the request clamped to the pages the file has.

    ``requested`` is an expression over the key columns.  The page count is one aggregated row per
    file; the pages themselves meet it in an equi-join on (file, page).
    """
    wanted = pages.groupBy(*key).agg((F.max(page_no) + 1).alias("_pages")).select(
        *key, page_index(requested, F.col("_pages")).alias(page_no)
    )
    return pages.join(wanted, [*key, page_no])
