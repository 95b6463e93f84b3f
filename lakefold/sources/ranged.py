"""Ranged reads: headers, archive directories, WAV chunks and JPEG segments without loading whole files.

``binaryFile`` hands over whole contents (and refuses files beyond two gigabytes), so jobs that need a few
bytes of large files take ``(path, length)`` from it, which opens nothing, and read ranges in an Arrow stage.
A scheme that no file system here serves ends the job; a file that is gone or unreadable gives an error row.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Schemes of the JVM's connectors and the names that Arrow gives the same stores.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfss", "abfs": "abfs", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "file": "file", "": "file"}

#: Bytes that one request fetches; neighbouring small reads share it.
BLOCK = 64 << 10


def locate(uri: str):
    """The file system of ``uri`` and the path inside it; raises ValueError for schemes that none serves."""
    from pyarrow import fs

    scheme = urlsplit(uri).scheme if ":" in uri.split("/", 1)[0] else ""
    if scheme not in _SCHEMES:
        raise ValueError(f"no file system for {scheme!r}: {uri}")
    if _SCHEMES[scheme] == "file":
        rest = uri[len(scheme) + 1:] if scheme else uri
        return fs.LocalFileSystem(), rest if not rest.startswith("//") else "/" + rest.lstrip("/")
    known = _SCHEMES[scheme] + uri[len(scheme):]
    return fs.FileSystem.from_uri(quote(known, safe=":/@?=&"))


class RangedFile(io.RawIOBase):
    """A seekable file that fetches blocks on demand and counts the bytes it has fetched."""

    def __init__(self, uri: str):
        store, inner = locate(uri)
        self._file = store.open_input_file(inner)
        self._size, self._at, self.fetched = self._file.size(), 0, 0
        self._begin, self._block = 0, b""

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self._at = max(0, offset + (0, self._at, self._size)[whence])
        return self._at

    def read(self, n: int = -1) -> bytes:
        stop = self._size if n is None or n < 0 else min(self._size, self._at + n)
        if stop <= self._at:
            return b""
        if not (self._begin <= self._at and stop <= self._begin + len(self._block)):
            size = min(self._size - self._at, max(stop - self._at, BLOCK))
            self._begin, self._block = self._at, self._file.read_at(size, self._at)
            self.fetched += len(self._block)
        out = self._block[self._at - self._begin: stop - self._begin]
        self._at += len(out)
        return out

    def head(self, n: int) -> bytes:
        """The first ``n`` bytes, fetching no more than these."""
        out = self._file.read_at(min(n, self._size), 0)
        self.fetched += len(out)
        return out

    def close(self) -> None:
        if not self.closed:
            self._file.close()
        super().close()


def _per_file(files: DataFrame, result: list[tuple[str, str]], read: Callable[[RangedFile], tuple]) -> DataFrame:
    """``files`` without contents, with the columns of ``result`` and ``error``; one ranged pass over the paths."""
    names = [n for n, _ in result]
    keep = [f for f in files.schema.fields if f.name not in {*names, "error", "content"}]
    schema = T.StructType([*keep, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in result), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for uri in batch.column("path").to_pylist():
                try:
                    with RangedFile(uri) as file:
                        rows.append((*read(file), None))
                except (OSError, zipfile.BadZipFile, struct.error, pa.ArrowInvalid, NotImplementedError) as err:
                    rows.append((*[None] * len(names), f"{type(err).__name__}: {err}"))
            found = [pa.array(c, arrow.field(n).type) for n, c in zip([*names, "error"], zip(*rows, strict=True), strict=True)] if rows else [
                pa.array([], arrow.field(n).type) for n in (*names, "error")]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *found], schema=arrow)

    return files.select(*[f"`{f.name}`" for f in keep]).mapInArrow(run, schema)


def file_headers(files: DataFrame, n: int = 16) -> DataFrame:
    """Add ``header``, the first ``n`` bytes, and ``error``; nothing else of a file is read, whatever its size."""
    return _per_file(files, [("header", "binary")], lambda file: (file.head(n),))


#: Bytes of a file that one task reads in pieces before the next range may go to another.
RANGE = 64 << 20


def file_pieces(files: DataFrame, piece_bytes: int) -> DataFrame:
    """``files`` with ``offset`` and ``content``: every byte of every file, in rows of at most ``piece_bytes``.

    The ranges of a large file are spread over the tasks.  As with whole contents, an unreadable file ends the job.
    """
    keep = [f for f in files.schema.fields if f.name not in ("offset", "content")]
    schema = T.StructType([*keep, T.StructField("offset", T.LongType()), T.StructField("content", T.BinaryType())])
    span = -(-RANGE // piece_bytes) * piece_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(f.name) for f in keep]
            for row, (uri, length, begin) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "length", "__begin")), strict=True)):
                with RangedFile(uri) as file:
                    file.seek(begin)
                    stop = min(length, begin + span)
                    while True:
                        at = file.tell()
                        data = file.read(min(piece_bytes, stop - at))
                        if not data and at < stop:
                            raise OSError(f"{uri} ends at {at} of {length} bytes")
                        yield pa.RecordBatch.from_arrays([*(c[row : row + 1] for c in columns), pa.array([at]), pa.array([data], pa.binary())], names=schema.names)
                        if file.tell() >= stop:
                            break

    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)).cast("long"), F.lit(span).cast("long")))
    ranges = files.select(*[f"`{f.name}`" for f in keep], begins.alias("__begin"))
    return ranges.repartition(files.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)


_ENTRY = "array<struct<name:string,size:bigint,compressed_size:bigint,method:string,crc32:bigint,offset:bigint,is_dir:boolean>>"


def _directory(file: RangedFile) -> tuple:
    from .archive import entry_name

    with zipfile.ZipFile(file) as archive:
        entries = [
            {"name": entry_name(i), "size": i.file_size, "compressed_size": i.compress_size,
             "method": zipfile.compressor_names.get(i.compress_type, str(i.compress_type)), "crc32": i.CRC, "offset": i.header_offset, "is_dir": i.is_dir()}
            for i in archive.infolist()
        ]
    return entries, file.fetched


def archive_directories(files: DataFrame) -> DataFrame:
    """Add ``entries``, the directory at the archive's end, ``bytes_read`` and ``error``; no member is read."""
    return _per_file(files, [("entries", _ENTRY), ("bytes_read", "bigint")], _directory)


def _wav(file: RangedFile) -> tuple:
    head = file.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise OSError("not a WAV file")
    fmt, data = None, None
    while len(chunk := file.read(8)) == 8 and data is None:
        name, length = struct.unpack("<4sI", chunk)
        if name == b"data":
            data = length
            break
        if name == b"fmt " and fmt is None:
            fmt = file.read(16)
            file.seek(length - len(fmt) + length % 2, io.SEEK_CUR)
        else:
            file.seek(length + length % 2, io.SEEK_CUR)
    if fmt is None or len(fmt) < 16:
        raise OSError("no format chunk")
    tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", fmt)
    width = rate * channels * bits / 8
    seconds = data / width if data is not None and width else None
    return {1: "PCM", 3: "IEEE Float"}.get(tag, "Compressed"), channels, rate, bits, seconds, file.fetched


def wav_headers(files: DataFrame) -> DataFrame:
    """Add format, channels, sample_rate, bits_per_sample, duration, ``bytes_read`` and ``error``; chunks are stepped over, not read."""
    kinds = [("format", "string"), ("channels", "bigint"), ("sample_rate", "bigint"), ("bits_per_sample", "bigint"), ("duration", "double"), ("bytes_read", "bigint")]
    return _per_file(files, kinds, _wav)


def _jpeg(file: RangedFile) -> tuple:
    if file.read(2) != b"\xff\xd8":
        raise OSError("not a JPEG file")
    while len(mark := file.read(2)) == 2 and mark[0] == 0xFF:
        kind = mark[1]
        if kind == 0xFF:
            file.seek(-1, io.SEEK_CUR)
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", file.read(7)[3:])
            return width, height, file.fetched
        elif kind != 0x01 and not 0xD0 <= kind <= 0xD7:
            file.seek(struct.unpack(">H", file.read(2))[0] - 2, io.SEEK_CUR)
    raise OSError("no frame header")


def jpeg_sizes(files: DataFrame) -> DataFrame:
    """Add width, height, ``bytes_read`` and ``error``; segments before the frame header are stepped over."""
    return _per_file(files, [("width", "bigint"), ("height", "bigint"), ("bytes_read", "bigint")], _jpeg)
