"""File scans: whole files, headers only, text documents, streams of arriving files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.csvtext import CsvOptions, csv_data, csv_header, csv_rows
from ..functions.formats import size_verdict
from ..functions.jsontext import is_valid_json
from ..functions.scalars import basename, file_ext
from ..functions.xmltext import is_valid_xml
from ..registry import SIZE_LIMIT
from .ranged import file_headers, file_pieces  # noqa: F401 - file_headers is part of this module's interface

#: Bytes of a file that one row of a scan in pieces holds.
PIECE_BYTES = 4 << 20

FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def scan_files(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = True,
               max_size: int | None = None, piece_bytes: int | None = None) -> DataFrame:
    """``files(path, modificationTime, length, content)``.

    The size limit is a filter on ``length``, which the source applies before it opens a file;
    selecting only path and length never reads contents.  With ``piece_bytes`` a file is read as rows of at most so many
    bytes, each with its ``offset``, so neither its size nor that of a row bounds it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    files = files if max_size is None else files.filter(F.col("length") <= max_size)
    return files if piece_bytes is None else file_pieces(files, piece_bytes)


def stream_files(spark: SparkSession, path: str, files_per_trigger: int = 1000, glob: str | None = None) -> DataFrame:
    """Arriving files as a stream with the same schema as :func:`scan_files`."""
    reader = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true")
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def stream_paths(spark: SparkSession, path: str, files_per_trigger: int = 1000, glob: str | None = None) -> DataFrame:
    """Arriving files as ``(path, modificationTime, length)``: no content is opened, so files of any size pass."""
    return stream_files(spark, path, files_per_trigger, glob).drop("content")


def file_name(path: Column) -> Column:
    return basename(path)


def admission(name: Column, size: Column, accept: list[str] | None = None, max_size: int = SIZE_LIMIT) -> Column:
    """Reject reason, null for admitted files; the type is checked before the size."""
    accepted = [e.lower().lstrip(".") for e in accept or []]
    too_large = F.when(~size_verdict(size, max_size)["valid"], F.lit("file too large"))
    if not accepted:
        return too_large
    ext = F.coalesce(file_ext(name), F.lit(""))
    return F.when(~ext.isin(*accepted), F.concat(F.lit("unsupported type: "), ext)).otherwise(too_large)


def admit_files(files: DataFrame, name: Column, size: Column, accept: list[str] | None = None,
                max_size: int = SIZE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """``(admitted, rejected)``; rejected rows carry ``reason``."""
    judged = files.withColumn("reason", admission(name, size, accept, max_size))
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def accumulate_selection(current: DataFrame, chosen: DataFrame, multiple: bool = True) -> DataFrame:
    """Append newly chosen files to the selection, or replace it."""
    return current.unionByName(chosen) if multiple else chosen


# ------------------------------------------------------------------ documents from file bytes


def utf8_text(content: Column) -> Column:
    """Bytes as UTF-8 text: a leading mark is dropped, malformed bytes become the replacement character."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\\uFEFF", "")


def text_files(files: DataFrame) -> DataFrame:
    """``(path, text)``."""
    return files.select("path", utf8_text(F.col("content")).alias("text"))


def csv_files(files: DataFrame, opt: CsvOptions = CsvOptions()) -> DataFrame:
    """``(path, header, row_num, columns, raw_line)``, one row per data record."""
    parsed = text_files(files).select("path", csv_rows(F.col("text"), opt).alias("rows"))
    return parsed.select("path", csv_header(F.col("rows"), opt).alias("header"), F.inline(csv_data(F.col("rows"), opt)))


def json_files(files: DataFrame) -> DataFrame:
    """``(path, valid, doc VARIANT)``, one document per file."""
    valid = is_valid_json(F.col("text"))
    return text_files(files).select("path", valid.alias("valid"), F.when(valid, F.try_parse_json("text")).alias("doc"))


def xml_files(files: DataFrame) -> DataFrame:
    """``(path, valid, text)``, one document per file."""
    return text_files(files).select("path", is_valid_xml(F.col("text")).alias("valid"), "text")


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole-file text: ``(path, text)``."""
    return text_files(scan_files(spark, path))


def read_csv_files(spark: SparkSession, path: str | list[str], opt: CsvOptions = CsvOptions()) -> DataFrame:
    return csv_files(scan_files(spark, path), opt)


def read_csv_table(spark: SparkSession, path: str | list[str], schema: str, opt: CsvOptions = CsvOptions()) -> DataFrame:
    """Files of one known schema, through Spark's own reader (records may span lines)."""
    return (
        spark.read.schema(schema)
        .options(header=opt.has_header, sep=opt.delimiter, quote=opt.quote, escape=opt.escape, multiLine=True,
                 ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)
        .csv(path)
    )


def read_json_docs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return json_files(scan_files(spark, path))


def read_xml_docs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return xml_files(scan_files(spark, path))


def read_xml_rows(spark: SparkSession, path: str | list[str], row_tag: str, schema: str) -> DataFrame:
    """One row per ``row_tag`` element, for files that are lists of records."""
    return spark.read.format("xml").schema(schema).option("rowTag", row_tag).load(path)


