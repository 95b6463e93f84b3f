"""ZIP-family containers as rows.

The codec work is the standard library's, one file at a time inside an Arrow stage; Spark decides
which files a task sees.  Name patterns are applied before anything is inflated.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame

_FLUSH_BYTES = 4 * 1024 * 1024
_TAKEN_BYTES = 4 * 1024 * 1024
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_FAILURES = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError, ValueError, OverflowError)

ENTRY_SCHEMA = (
    "path STRING, entry_no INT, name STRING, size BIGINT, compressed_size BIGINT, method STRING, crc32 BIGINT, "
    "offset BIGINT, modified TIMESTAMP, attributes BIGINT, is_dir BOOLEAN, error STRING"
)
_ENTRY_ARROW = pa.schema([
    ("path", pa.string()), ("entry_no", pa.int32()), ("name", pa.string()), ("size", pa.int64()),
    ("compressed_size", pa.int64()), ("method", pa.string()), ("crc32", pa.int64()), ("offset", pa.int64()),
    ("modified", pa.timestamp("us", "UTC")), ("attributes", pa.int64()), ("is_dir", pa.bool_()), ("error", pa.string()),
])
PART_SCHEMA = "path STRING, entry_no INT, name STRING, data BINARY, error STRING"
_PART_ARROW = pa.schema([
    ("path", pa.string()), ("entry_no", pa.int32()), ("name", pa.string()), ("data", pa.binary()), ("error", pa.string()),
])
PACKAGE_SCHEMA = "path STRING, parts MAP<STRING, BINARY>, error STRING"
_PACKAGE_ARROW = pa.schema([
    ("path", pa.string()), ("parts", pa.map_(pa.string(), pa.binary())), ("error", pa.string()),
])


def entry_name(info: zipfile.ZipInfo) -> str:
    """Entry name as UTF-8, else GBK, else Latin-1, unless the archive declares UTF-8."""
    if info.flag_bits & 0x800:
        return info.filename
    try:  # the name as stored; the library may already have replaced it by a Unicode path field
        raw = info.orig_filename.encode("cp437")
    except UnicodeEncodeError:
        return info.filename
    if info.filename != info.orig_filename and "\0" not in info.orig_filename:
        return info.filename
    for charset in ("utf-8", "gbk"):
        try:
            return raw.decode(charset)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def _modified(info: zipfile.ZipInfo) -> datetime | None:
    try:
        return datetime(*info.date_time, tzinfo=UTC)
    except ValueError:
        return None


def _bytes(size: str) -> int:
    """Spark's size strings: ``4194304``, ``67108864b``, ``8m``."""
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << (10 * " kmgtp".index(unit or " "))


def arrow_stage(rows: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` over batches of at most ``_TAKEN_BYTES`` (or one row), set for the session unless it asks for less.

    By rows alone a batch grows with the task's share of the table, and the worker's memory with it.
    """
    spark = getattr(rows, "sparkSession", None)  # a thread of its own has no active session
    if spark is not None and not 0 < _bytes(spark.conf.get(_BATCH_BYTES)) <= _TAKEN_BYTES:
        spark.conf.set(_BATCH_BYTES, str(_TAKEN_BYTES))
    return rows.mapInArrow(run, schema)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes | None]]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            yield path.as_py(), content.as_py()


def _batches(rows: Iterator[tuple], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    """Group output rows into batches of bounded bytes."""
    pending, weight = [], 0
    for row in rows:
        pending.append(row)
        weight += 256 + weigh(row)
        if weight >= _FLUSH_BYTES:
            yield _batch(pending, schema)
            pending, weight = [], 0
    if pending:
        yield _batch(pending, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


def archive_entries(files: DataFrame) -> DataFrame:
    """Central directory of every archive: one row per entry, or one error row per unreadable file."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for path, content in _files(batches):
            try:
                with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
                    for number, info in enumerate(archive.infolist()):
                        yield (path, number, entry_name(info), info.file_size, info.compress_size,
                               zipfile.compressor_names.get(info.compress_type, str(info.compress_type)), info.CRC,
                               info.header_offset, _modified(info), info.external_attr, info.is_dir(), None)
            except _FAILURES as err:
                yield (path, None, None, None, None, None, None, None, None, None, None, f"{type(err).__name__}: {err}")

    return arrow_stage(
        files.select("path", "content"), lambda batches: _batches(entries(batches), _ENTRY_ARROW, lambda row: 0), ENTRY_SCHEMA
    )


def _parts(path: str, content: bytes | None, wanted: re.Pattern | None) -> Iterator[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
            for number, info in enumerate(archive.infolist()):
                name = entry_name(info)
                if info.is_dir() or (wanted is not None and not wanted.search(name)):
                    continue
                try:
                    yield (path, number, name, archive.read(info), None)
                except _FAILURES as err:
                    yield (path, number, name, None, f"{type(err).__name__}: {err}")
    except _FAILURES as err:
        yield (path, None, None, None, f"{type(err).__name__}: {err}")


def archive_parts(files: DataFrame, pattern: str | None = None) -> DataFrame:
    """Bytes of the members whose name matches ``pattern``: ``(path, entry_no, name, data, error)``.

    A member that cannot be read gives an error row; the others are still read.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        wanted = re.compile(pattern) if pattern else None
        for path, content in _files(batches):
            yield from _parts(path, content, wanted)

    return arrow_stage(
        files.select("path", "content"), lambda batches: _batches(parts(batches), _PART_ARROW, lambda row: len(row[3] or b"")), PART_SCHEMA
    )


def open_packages(files: DataFrame, pattern: str | None = None) -> DataFrame:
    """One row per file with its matching members in a map: ``(path, parts, error)``.

    The document operators work on this shape: the parts of a package stay in one row, so
    resolving one part against another needs no shuffle.
    """

    def packages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        wanted = re.compile(pattern) if pattern else None
        for path, content in _files(batches):
            found, errors = {}, []
            for _, _, name, data, error in _parts(path, content, wanted):
                if error is None:
                    found[name] = data
                else:
                    errors.append(error if name is None else f"{name}: {error}")
            yield (path, list(found.items()), "; ".join(errors) or None)

    return arrow_stage(
        files.select("path", "content"), lambda batches: _batches(packages(batches), _PACKAGE_ARROW, lambda row: sum(len(d) for _, d in row[1])), PACKAGE_SCHEMA
    )
