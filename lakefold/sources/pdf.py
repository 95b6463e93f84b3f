"""PDF files as object rows: dictionaries as text, streams inflated.

One Arrow stage scans ``n g obj ... endobj`` spans; everything above it is SQL on the rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .archive import _batches, _files, arrow_stage

OBJECT_SCHEMA = "path STRING, obj_no INT, body STRING, stream STRING, page_no INT, error STRING"
_ARROW = pa.schema([("path", pa.string()), ("obj_no", pa.int32()), ("body", pa.string()), ("stream", pa.string()),
                    ("page_no", pa.int32()), ("error", pa.string())])
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
_STREAM = re.compile(rb"stream\r?\n")
_LENGTH = re.compile(rb"/Length\s+(\d+)(?!\s+\d+\s+R)")
_REF = re.compile(r"(\d+)\s+\d+\s+R")


def _span(data: bytes, start: int) -> tuple[bytes, bytes | None, int]:
    """Body and raw stream of the object that starts at ``start``, and where it ends."""
    close = data.find(b"endobj", start)
    close = len(data) if close < 0 else close
    mark = _STREAM.search(data, start, close + 16)
    if mark is None or mark.start() > close:
        return data[start:close], None, close
    body, begin = data[start:mark.start()], mark.end()
    length = _LENGTH.search(body)
    end = begin + int(length.group(1)) if length else -1
    if end < 0 or not data[end:end + 12].lstrip().startswith(b"endstream"):
        end = data.find(b"endstream", begin)
        end = len(data) if end < 0 else end
    tail = data.find(b"endobj", end)
    return body, data[begin:end], len(data) if tail < 0 else tail


def _decode(body: str, raw: bytes) -> tuple[str | None, str | None]:
    """Text of a stream and why it is not whole: a deflated stream that ends early keeps its first part."""
    if "/FlateDecode" not in body:
        return raw.decode("latin-1"), None
    inflate = zlib.decompressobj()
    try:
        text = inflate.decompress(raw).decode("latin-1")
    except zlib.error as err:
        return None, f"zlib: {err}"
    return text, None if inflate.eof else f"zlib: stream ends early, {len(text)} bytes inflated"


def _unpacked(stream: str, body: str) -> Iterator[tuple[int, str]]:
    """Objects held in an object stream: a table of numbers and offsets, then the bodies."""
    count, first = re.search(r"/N\s+(\d+)", body), re.search(r"/First\s+(\d+)", body)
    if not count or not first:
        return
    numbers = [int(n) for n in stream[: int(first.group(1))].split()[: 2 * int(count.group(1))]]
    places = list(zip(numbers[::2], numbers[1::2], strict=False))
    for i, (number, offset) in enumerate(places):
        stop = places[i + 1][1] if i + 1 < len(places) else None
        begin = int(first.group(1))
        yield number, stream[begin + offset: None if stop is None else begin + stop]


_TYPE = re.compile(r"/Type\s*/(\w+)")
_KIDS = re.compile(r"/Kids\s*\[([^\]]*)\]")
_BOX = re.compile(r"/MediaBox\s*(?:\[([^\]]*)\]|(\d+)\s+\d+\s+R)")
_ROTATE = re.compile(r"/Rotate\s+(-?\d+)")
_RESOURCES = re.compile(r"/Resources\s*(?:(\d+)\s+\d+\s+R|<<)")
_CONTENTS = re.compile(r"/Contents\s*(?:(\d+)\s+\d+\s+R|\[([^\]]*)\])")
_NUMBERS = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)")
_OBJECT_STREAM = re.compile(r"/Type\s*/ObjStm\b")
_CROSS_REFERENCE = re.compile(r"/Type\s*/XRef\b")


class PdfFile:
    """Objects of one file by number, the newest definition of each; streams are inflated when they are asked for."""

    def __init__(self, data: bytes):
        self.bodies: dict[int, str] = {}
        self.raw: dict[int, bytes] = {}
        at = 0
        while mark := _OBJECT.search(data, at):
            body, raw, at = _span(data, mark.end())
            text = body.decode("latin-1").strip()
            self._define(int(mark.group(1)), text, raw)
            if raw is not None and _OBJECT_STREAM.search(text):
                stream, _ = _decode(text, raw)
                for inner, inner_body in _unpacked(stream or "", text):
                    self._define(inner, inner_body.strip(), None)

    def _define(self, number: int, body: str, raw: bytes | None) -> None:
        self.bodies[number] = body
        if raw is None:
            self.raw.pop(number, None)
        else:
            self.raw[number] = raw

    def stream(self, number: int) -> tuple[str | None, str | None]:
        if number not in self.raw:
            return None, None
        return _decode(self.bodies[number], self.raw[number])

    def kind(self, number: int) -> str | None:
        found = _TYPE.search(self.bodies.get(number, ""))
        return found.group(1) if found else None

    def _own(self, body: str) -> dict[str, str]:
        """Page attributes that a node states itself; references are followed."""
        out = {}
        if box := _BOX.search(body):
            out["box"] = box.group(1) if box.group(1) is not None else self.bodies.get(int(box.group(2)), "")
        if turn := _ROTATE.search(body):
            out["rotate"] = turn.group(1)
        if named := _RESOURCES.search(body):
            out["resources"] = self.bodies.get(int(named.group(1)), "") if named.group(1) else _dictionary(body, named.end() - 2)
        return out

    def pages(self) -> list[tuple[int, dict[str, str]]]:
        """Pages in reading order with what they state or inherit; pages outside the tree follow in object order."""
        nodes = {n: [int(k) for k in _REF.findall((_KIDS.search(b) or [None, ""])[1])] for n, b in self.bodies.items() if self.kind(n) == "Pages"}
        children = {k for kids in nodes.values() for k in kids}
        out, seen = [], set()
        stack: list[tuple[int, dict[str, str]]] = [(n, {}) for n in sorted(nodes, reverse=True) if n not in children]
        while stack:
            number, above = stack.pop()
            if number in seen or number not in self.bodies:
                continue
            seen.add(number)
            here = {**above, **self._own(self.bodies[number])}
            if number in nodes:
                stack.extend((k, here) for k in reversed(nodes[number]))
            elif self.kind(number) == "Page":
                out.append((number, here))
        return out + [(n, self._own(b)) for n, b in self.bodies.items() if n not in seen and self.kind(n) == "Page"]

    def contents(self, number: int) -> tuple[str, str | None]:
        """A page's content streams in order, each of a list followed by a line feed, and what is wrong with them."""
        found = _CONTENTS.search(self.bodies[number])
        if not found:
            return "", None
        if found.group(1):
            text, error = self.stream(int(found.group(1)))
            return text or "", error
        parts = [self.stream(int(n)) for n in _REF.findall(found.group(2))]
        return "".join((text or "") + "\n" for text, _ in parts), "; ".join(e for _, e in parts if e) or None


def _dictionary(body: str, start: int) -> str:
    """The dictionary that opens at ``start``, with the ones inside it."""
    depth, at = 0, start
    for mark in re.compile(r"<<|>>").finditer(body, start):
        depth, at = depth + (1 if mark.group() == "<<" else -1), mark.end()
        if depth == 0:
            return body[start:at]
    return body[start:]


def open_pdf(data: bytes | None) -> tuple[PdfFile | None, str | None]:
    """The file's objects, or why there are none."""
    if not data or not data.startswith(b"%PDF"):
        return None, "not a PDF file"
    file = PdfFile(data)
    return (file, None) if file.bodies else (None, "no objects found")


def pdf_objects(files: DataFrame, kinds: str | None = None, streams: bool = True) -> DataFrame:
    """``(path, obj_no, body, stream, page_no, error)``; the last definition of an object number wins.

    ``kinds`` is a pattern on the bodies: other objects stay in the stage.  Without ``streams`` none is inflated.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        wanted = re.compile(kinds) if kinds else None
        for path, content in _files(batches):
            file, fault = open_pdf(content)
            if file is None:
                yield (path, None, None, None, None, fault)
                continue
            numbers = {n: i + 1 for i, (n, _) in enumerate(file.pages())}
            for n, body in file.bodies.items():
                if wanted is None or wanted.search(body):
                    stream, error = file.stream(n) if streams else (None, None)
                    yield (path, n, body, stream, numbers.get(n), error)

    return arrow_stage(
        files.select("path", "content"), lambda batches: _batches(rows(batches), _ARROW, lambda r: len(r[2] or "") + len(r[3] or "")), OBJECT_SCHEMA
    )


def pdf_streams(files: DataFrame) -> DataFrame:
    """``(path, obj_no, text, error)`` of stream objects, inflated, as Latin-1 text; a stream that ends early has both."""
    objects = pdf_objects(files)
    return objects.filter("obj_no IS NOT NULL AND (stream IS NOT NULL OR error IS NOT NULL)").selectExpr("path", "obj_no", "stream AS text", "error")


PAGE_SCHEMA = "path STRING, page_no INT, obj_no INT, box ARRAY<DOUBLE>, rotate INT, resources STRING, contents STRING, error STRING"
_PAGE_ARROW = pa.schema([("path", pa.string()), ("page_no", pa.int32()), ("obj_no", pa.int32()), ("box", pa.list_(pa.float64())), ("rotate", pa.int32()),
                         ("resources", pa.string()), ("contents", pa.string()), ("error", pa.string())])


def pdf_page_rows(files: DataFrame) -> DataFrame:
    """``(path, page_no, obj_no, box, rotate, resources, contents, error)``: one pass, one row a page.

    Box, rotation and resources come from the page or the nearest node above it.  Only content streams are inflated;
    a page whose content is damaged has an error beside the readable part, a file that is no PDF one row without a page.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for path, content in _files(batches):
            file, fault = open_pdf(content)
            if file is None:
                yield (path, *[None] * 6, fault)
                continue
            for i, (number, have) in enumerate(file.pages()):
                box = [float(x) for x in _NUMBERS.findall(have.get("box", ""))]
                text, error = file.contents(number)
                yield (path, i + 1, number, box if len(box) == 4 else None, int(have.get("rotate", 0)), have.get("resources"), text, error)

    return arrow_stage(
        files.select("path", "content"), lambda batches: _batches(rows(batches), _PAGE_ARROW, lambda r: len(r[5] or "") + len(r[6] or "")), PAGE_SCHEMA
    )


_TRAILER = re.compile(rb"\btrailer\s*<<(.*?)(?:startxref|\Z)", re.DOTALL)
_INFO = re.compile(r"/Info\s+(\d+)\s+\d+\s+R")
DOCUMENT_SCHEMA = "path STRING, page_count INT, trailer STRING, info STRING, error STRING"
_DOCUMENT_ARROW = pa.schema([("path", pa.string()), ("page_count", pa.int32()), ("trailer", pa.string()), ("info", pa.string()), ("error", pa.string())])


def pdf_document_rows(files: DataFrame) -> DataFrame:
    """``(path, page_count, trailer, info, error)``: trailer dictionaries, newest last, and the information object they name."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for path, content in _files(batches):
            file, fault = open_pdf(content)
            if file is None:
                yield path, None, None, None, fault
                continue
            streams = [b for b in file.bodies.values() if _CROSS_REFERENCE.search(b)]
            trailer = "\n".join([*streams, *(t.decode("latin-1") for t in _TRAILER.findall(content))])
            named = _INFO.findall(trailer)
            yield path, len(file.pages()), trailer, file.bodies.get(int(named[-1])) if named else None, None

    return arrow_stage(
        files.select("path", "content"), lambda batches: _batches(rows(batches), _DOCUMENT_ARROW, lambda r: len(r[2] or "") + len(r[3] or "")), DOCUMENT_SCHEMA
    )
