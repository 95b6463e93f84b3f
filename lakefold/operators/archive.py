"""Operators over archive entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import mime_of, type_label
from ..functions.scalars import format_bytes, format_date


def archive_stats(entries: DataFrame) -> DataFrame:
    """files, folders and total uncompressed size per archive."""
    return entries.filter("error IS NULL").groupBy("path").agg(
        F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("folders"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
    )


def archive_listing(entries: DataFrame) -> DataFrame:
    """Listing rows in directory order: name, shown size, type label, shown date."""
    return entries.filter("error IS NULL").select(
        "path", "entry_no", "name",
        F.when(F.col("is_dir"), F.lit("-")).otherwise(format_bytes(F.col("size"))).alias("size"),
        type_label(F.col("name"), F.col("is_dir")).alias("type"), format_date(F.col("modified")).alias("date"),
    )


def entry_lookup(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """Join ``requests(path, name)`` to the entries by exact name; misses carry an error."""
    found = entries.filter("error IS NULL").select("path", "name", "entry_no", "size")
    return requests.join(found, ["path", "name"], "left").withColumn(
        "error", F.when(F.col("entry_no").isNull(), F.concat(F.lit("no such entry: "), F.col("name")))
    )


def archive_profile(entries: DataFrame) -> DataFrame:
    """file_count, format and methods per archive."""
    return entries.filter("error IS NULL").groupBy("path").agg(
        F.count(F.lit(1)).alias("file_count"), F.lit("ZIP").alias("format"),
        F.array_join(F.sort_array(F.collect_set("method")), ",").alias("methods"),
    )


def is_valid_container(entries: DataFrame) -> DataFrame:
    """valid = the container opens."""
    return entries.groupBy("path").agg((~F.bool_or(F.col("error").isNotNull())).alias("valid"))


def part_locate(entries: DataFrame, exact: str = "word/document.xml", suffix: str = "document.xml") -> DataFrame:
    """Main part per archive: the exact name, else the first name with the suffix."""
    rank: Column = F.struct((F.col("name") != exact).alias("other"), "entry_no")
    return entries.filter((F.col("name") == exact) | F.col("name").endswith(suffix)).groupBy("path").agg(
        F.min_by("name", rank).alias("name")
    )


def package_media(parts: DataFrame, prefix: str = "media/") -> DataFrame:
    """Parts below the media folder with MIME type and size."""
    return parts.filter(F.col("name").startswith(prefix) & F.col("error").isNull()).select(
        "path", "name", mime_of(F.col("name"), "slide").alias("type"), F.octet_length("data").cast("bigint").alias("size"), "data"
    )


def package_images(parts: DataFrame) -> DataFrame:
    """Every part with an image extension, with its MIME type."""
    return parts.filter(F.lower("name").rlike("\\.(png|jpg|jpeg|gif|bmp|tiff|webp)$") & F.col("error").isNull()).select(
        "path", "name", mime_of(F.col("name"), "package").alias("mime_type"),
        F.octet_length("data").cast("bigint").alias("size"), "data",
    )
