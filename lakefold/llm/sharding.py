"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0 .. N-1 in the order of (id, size, checksum).  A keyed Feistel network over
``bits(N)`` bits, walked along its cycle until the value is below N, permutes the numbers; the shard is
the permuted number modulo the shard count and the slot its quotient.  So shard and slot of any row can
be computed from its number and the seed alone, shards differ by at most one row, and slots have no gaps.

To place rows only ids, sizes and checksums are sorted; writing the shards sorts the texts once by the same order.  Numbers come from a range partitioning that is
written once (its partition sizes are summed by a window over one row per partition).

Defined results: rows with equal keys (repeated rows) get distinct numbers among themselves; a null id
sorts first; a null text has size 16 and the checksum of no bytes; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .words import mix

ROUNDS = 6


def permute(numbers: np.ndarray, n: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """The place of each row number under the keyed permutation of ``range(n)``."""
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = _feistel(out[todo], n, seed, rounds)
        todo = todo[out[todo] >= n]  # a cycle that starts below n comes back below n
    return out.astype(np.int64)


def _feistel(x: np.ndarray, n: int, seed: int, rounds: int) -> np.ndarray:
    """One pass through an unbalanced network over the smallest power of two that holds ``n`` values."""
    bits = max(2, (n - 1).bit_length())
    right = bits // 2
    left = bits - right
    a, b = x >> np.uint64(right), x & np.uint64((1 << right) - 1)
    for r in range(rounds):
        # the halves keep their widths: even rounds change the left one, odd rounds the right one
        key = np.uint64((seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % (1 << 64))
        if r % 2 == 0:
            a = a ^ (mix(b + key) & np.uint64((1 << left) - 1))
        else:
            b = b ^ (mix(a + key) & np.uint64((1 << right) - 1))
    return (a << np.uint64(right)) | b


def number_rows(rows: DataFrame, order: list[str], into: str = "row_number") -> DataFrame:
    """``rows`` with gapless global numbers from 0 in the order of ``order``, without a single-task sort."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()),
        "numbered",
    )
    placed = placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    # one row per partition of the range exchange: at most `parts` rows
    return placed.join(F.broadcast(bases), "__part").withColumn(into, F.col("__base") + F.col("__at")).drop("__part", "__at", "__n", "__base")


def shard_rows(rows: DataFrame, shards: int, *, order: list[str], seed: int = 0) -> DataFrame:
    """``rows`` with ``row_number``, ``shard`` and ``slot`` (columns of these names are replaced)."""
    numbered = number_rows(rows.drop("row_number", "shard", "slot"), order)
    n = numbered.count()

    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for numbers in batches:
            yield pd.Series(permute(numbers.to_numpy(), n, seed))

    place = F.pandas_udf(place, T.LongType())
    return (
        numbered.withColumn("__to", place("row_number"))
        .withColumn("shard", F.pmod("__to", F.lit(shards)).cast("int"))
        .withColumn("slot", F.expr(f"__to div {shards}"))
        .drop("__to")
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, *, key: str, match: dict[str, Column] | None = None) -> None:
    """Give each row of ``docs`` one place of ``placed`` and write one folder per shard, rows in slot order.

    Both sides are numbered in the order of ``key`` and the columns of ``match`` (names in ``placed``, expressions over
    ``docs``) and joined on the number, so null keys keep their rows and rows of equal keys get a place each.
    """
    match = match or {}
    named = docs.drop("shard", "slot").select("*", *(c.alias(f"__{name}") for name, c in match.items()), F.monotonically_increasing_id().alias("__tie"))
    texts = number_rows(named, [key, *(f"__{name}" for name in match), "__tie"], "__row").drop("__tie")
    places = placed.select(F.col(key).alias("__key"), *(F.col(name).alias(f"__to_{name}") for name in match), "shard", "slot")
    places = number_rows(places, ["__key", *(f"__to_{name}" for name in match), "slot", "shard"], "__row")
    same = F.col(key).eqNullSafe(F.col("__key"))
    for name in match:
        same &= F.col(f"__{name}").eqNullSafe(F.col(f"__to_{name}"))
    # places of other rows are an error, found before anything is written
    own = texts.select("__row", key, *(f"__{name}" for name in match)).join(places, "__row", "full")
    if own.where(~same | F.col("shard").isNull()).limit(1).count() or texts.count() != places.count():
        raise ValueError("the places belong to other rows")
    (
        texts.join(places, "__row")
        .drop("__row", "__key", *(f"__{name}" for name in match), *(f"__to_{name}" for name in match))
        .repartition("shard")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
