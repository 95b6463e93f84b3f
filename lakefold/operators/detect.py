"""Detection operators that join against the format registry."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import registry as R
from ..functions.formats import detect_magic
from ..functions.scalars import file_ext
from ..sources.files import utf8_text

# The registry frames hold a few dozen rows of this package's own literals, so broadcasting them is
# bounded by construction and independent of the data.


def category_of(files: DataFrame, name: str, registry: DataFrame) -> DataFrame:
    """Add ``ext`` and ``category`` (null for unregistered extensions)."""
    return files.withColumn("ext", file_ext(F.col(name))).join(F.broadcast(registry), "ext", "left")


def supported_files(files: DataFrame, name: str, registry: DataFrame) -> DataFrame:
    return files.withColumn("ext", file_ext(F.col(name))).join(F.broadcast(registry), "ext", "left_semi")


def unsupported_files(files: DataFrame, name: str, registry: DataFrame) -> DataFrame:
    return files.withColumn("ext", file_ext(F.col(name))).join(F.broadcast(registry), "ext", "left_anti")


def supported_types(files: DataFrame, name: str, registry: DataFrame) -> DataFrame:
    """Registered extensions that occur among the files (distinct is pre-aggregated before its shuffle)."""
    return supported_files(files, name, registry).select("ext").distinct()


def adapter_route(files: DataFrame, name: str, routes: DataFrame) -> DataFrame:
    """Add the family that opens each file, null when no family does."""
    return files.withColumn("ext", file_ext(F.col(name))).join(F.broadcast(routes), "ext", "left")


def coverage_gap(files: DataFrame, name: str, registry: DataFrame, handled: DataFrame) -> DataFrame:
    """Extensions in use that are registered without a handler, or handled without registration."""
    seen = files.select(file_ext(F.col(name)).alias("ext")).filter("ext IS NOT NULL").distinct()
    known, able = F.broadcast(registry.select("ext")), F.broadcast(handled.select("ext"))
    no_handler = seen.join(known, "ext", "left_semi").join(able, "ext", "left_anti")
    not_registered = seen.join(able, "ext", "left_semi").join(known, "ext", "left_anti")
    return no_handler.withColumn("gap", F.lit("no handler")).unionByName(
        not_registered.withColumn("gap", F.lit("not registered"))
    )


def type_mismatch_audit(files: DataFrame, name: str, content: str) -> DataFrame:
    """Add ext, magic and ``agrees``; null when either side says nothing about the other."""
    ext = file_ext(F.col(name))
    magic = detect_magic(F.col(content))
    expected = F.coalesce(R.lookup(ext, R.CONTAINER_OF), F.when(ext.isin(*[n for n, _ in R.MAGIC]), ext))
    return files.withColumn("ext", ext).withColumn("magic", magic).withColumn(
        "agrees", F.when(expected.isNotNull(), expected == magic)
    )


@F.pandas_udf(StringType())
def _first_decoding_charset(content: pd.Series) -> pd.Series:
    """First of the non-UTF-8 candidates that decodes the bytes without error."""
    candidates = R.ENCODINGS[1:]

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        for name in candidates:
            try:
                bytes(b).decode("gb18030" if name == "gb2312" else name)
                return name
            except UnicodeDecodeError:
                continue
        return "utf-8"

    return content.map(one)


@F.pandas_udf(StringType())
def _decode_with(content: pd.Series, charset: pd.Series) -> pd.Series:
    def one(b: bytes | None, name: str | None) -> str | None:
        if b is None or name is None:
            return None
        return bytes(b).decode(name, "replace").removeprefix("﻿")

    return pd.Series([one(b, c) for b, c in zip(content, charset, strict=True)])


def detect_encoding(content: Column) -> Column:
    """Charset by byte-order mark, else UTF-8 if the whole content is valid, else the first that decodes.

    The JVM decides marks and UTF-8; only the remaining contents travel to the Arrow worker.
    """
    bom = (
        F.when(F.startswith(content, F.unhex(F.lit("EFBBBF"))), "utf-8")
        .when((F.octet_length(content) >= 3) & F.startswith(content, F.unhex(F.lit("FFFE"))), "utf-16le")
        .when((F.octet_length(content) >= 3) & F.startswith(content, F.unhex(F.lit("FEFF"))), "utf-16be")
    )
    native = F.coalesce(bom, F.when(F.is_valid_utf8(content.cast("string")), F.lit("utf-8")))
    return F.coalesce(native, _first_decoding_charset(F.when(native.isNull(), content)))


def decode_text(content: Column, charset: Column) -> Column:
    """Text in the given charset; never fails, malformed bytes become the replacement character."""
    other = F.coalesce(charset != "utf-8", F.lit(False))
    return F.when(other, _decode_with(F.when(other, content), charset)).otherwise(utf8_text(content))
