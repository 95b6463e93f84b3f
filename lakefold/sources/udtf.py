"""The container readers as SQL table functions: ``SELECT * FROM files, LATERAL archive_entries(content)``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import archive, mp4, pdf


class _ArchiveEntries:
    def eval(self, content: bytes):
        import io
        import zipfile

        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as opened:
                for number, info in enumerate(opened.infolist()):
                    yield number, archive.entry_name(info), info.file_size, info.compress_size, info.CRC, info.is_dir(), None
        except archive._FAILURES as err:
            yield None, None, None, None, None, None, f"{type(err).__name__}: {err}"


class _ArchiveParts:
    def eval(self, content: bytes, pattern: str):
        import re

        for _, number, name, data, error in archive._parts("", content, re.compile(pattern) if pattern else None):
            yield number, name, data, error


class _PdfStreams:
    def eval(self, content: bytes):
        for _, number, _, stream, _, error in pdf._objects("", content):
            if stream is not None or error is not None:
                yield number, stream, error


class _Mp4Boxes:
    def eval(self, content: bytes):
        for _, number, depth, track, kind, offset, size, payload, error in mp4._boxes("", content):
            yield number, depth, track, kind, offset, size, payload, error


def register_udtfs(spark: SparkSession) -> None:
    """Register the four readers in the session."""
    for name, cls, schema in (
        ("archive_entries", _ArchiveEntries, "entry_no INT, name STRING, size BIGINT, compressed_size BIGINT, crc32 BIGINT, is_dir BOOLEAN, error STRING"),
        ("archive_parts", _ArchiveParts, "entry_no INT, name STRING, data BINARY, error STRING"),
        ("pdf_streams", _PdfStreams, "obj_no INT, text STRING, error STRING"),
        ("mp4_boxes", _Mp4Boxes, "box_no INT, depth INT, track INT, box_type STRING, offset BIGINT, size BIGINT, payload BINARY, error STRING"),
    ):
        spark.udtf.register(name, udtf(cls, returnType=schema))
