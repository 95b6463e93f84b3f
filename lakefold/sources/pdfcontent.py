"""Operators of PDF page contents, wherever they stand on a line.

A content stream is a postfix program: operands pile up until an operator takes them.  One Arrow stage reads pages
and their programs, so contents never leave it; the rows it returns are selected and joined in SQL.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .archive import _batches, _files, arrow_stage
from .pdf import open_pdf

# comment, inline image, dictionary marks, hex string, name, array marks, word; a literal string is cut by its nesting
_TOKEN = re.compile(
    r"%[^\r\n]*|(?P<image>\bBI(?=[\s/]).*?\sID\s.*?\sEI(?=\s|\Z))|<<|>>|<(?P<hex>[0-9A-Fa-f\s]*)>"
    r"|/(?P<name>[^\s()<>\[\]{}/%]*)|(?P<open>\()|(?P<mark>[\[\]])|(?P<word>[^\s()<>\[\]{}/%]+)|[{}<>)]", re.DOTALL)
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)\Z")
_PAREN = re.compile(r"[()\\]")
_ESCAPE = re.compile(r"\\([0-7]{1,3}|\r\n|.)", re.DOTALL)
_PLAIN = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "\n": "", "\r": "", "\r\n": ""}


def _literal(text: str, start: int) -> tuple[str, int]:
    """The literal string that opens before ``start``, escapes resolved, and where it ends; parentheses in it are balanced."""
    depth, at = 1, start
    while depth and (mark := _PAREN.search(text, at)):
        at = mark.end()
        if mark.group() == "\\":
            at += 1
        else:
            depth += 1 if mark.group() == "(" else -1
    end = at if not depth else len(text)
    raw = text[start : end - 1 if not depth else end]
    return _ESCAPE.sub(lambda m: chr(int(m.group(1), 8) & 255) if m.group(1)[0] in "01234567" else _PLAIN.get(m.group(1), m.group(1)), raw), end


def _hex(digits: str) -> str:
    digits = re.sub(r"\s", "", digits)
    return bytes.fromhex(digits + "0" * (len(digits) % 2)).decode("latin-1")


class Name(str):
    """A name operand, without its slash."""


def operations(text: str) -> Iterator[tuple[str, list]]:
    """(operator, operands) of a content stream; arrays are lists, dictionaries are left out, an inline image is one ``BI``."""
    operands: list = []
    arrays: list[list] = []
    at, inside = 0, 0
    while match := _TOKEN.search(text, at):
        at, kind = match.end(), match.lastgroup
        if kind is None:
            inside = max(0, inside + {"<<": 1, ">>": -1}.get(match.group(), 0))
            continue
        if kind == "image":
            yield "BI", []
            operands, arrays = [], []
            continue
        if kind == "mark" and match.group() == "[":
            arrays.append([])
            continue
        if kind == "open":
            value, at = _literal(text, at)
        elif kind == "hex":
            value = _hex(match.group("hex"))
        elif kind == "name":
            value = Name(match.group("name"))
        elif kind == "mark":
            if not arrays:
                continue
            value = arrays.pop()
        else:
            word = match.group()
            if _NUMBER.match(word):
                value = float(word)
            elif word in ("true", "false", "null") or arrays or inside:
                continue
            else:
                yield word, operands
                operands = []
                continue
        if not inside:
            (arrays[-1] if arrays else operands).append(value)


def _numbers(operands: list, n: int) -> list[float] | None:
    last = operands[-n:]
    return last if len(last) == n and all(isinstance(v, float) for v in last) else None


def shown(text: str) -> Iterator[tuple]:
    """(number, operator, text, name, font, size, x, y) of the operators that show text or draw an object.

    The place is the start of the text line in the text's own space; widths of glyphs are not known here.
    """
    font, size, leading = None, None, 0.0
    line = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    saved: list[tuple] = []

    def move(tx: float, ty: float) -> None:
        a, b, c, d, e, f = line
        line[4:] = [tx * a + ty * c + e, tx * b + ty * d + f]

    for number, (op, operands) in enumerate(operations(text)):
        if op == "BT":
            line[:] = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
        elif op == "q":
            saved.append((font, size, leading))
        elif op == "Q" and saved:
            font, size, leading = saved.pop()
        elif op == "Tf" and len(operands) >= 2 and isinstance(operands[-2], Name) and isinstance(operands[-1], float):
            font, size = str(operands[-2]), operands[-1]
        elif op == "TL" and (one := _numbers(operands, 1)):
            leading = one[0]
        elif op in ("Td", "TD") and (two := _numbers(operands, 2)):
            leading = -two[1] if op == "TD" else leading
            move(*two)
        elif op == "Tm" and (six := _numbers(operands, 6)):
            line[:] = six
        elif op == "T*":
            move(0.0, -leading)
        elif op in ("Tj", "TJ", "'", '"'):
            if op in ("'", '"'):
                move(0.0, -leading)
            last = operands[-1] if operands else None
            pieces = last if isinstance(last, list) else [last]
            words = [p for p in pieces if isinstance(p, str) and not isinstance(p, Name)]
            if words or isinstance(last, list):
                yield number, op, "".join(words), None, font, size, line[4], line[5]
        elif op == "Do" and operands and isinstance(operands[-1], Name):
            yield number, op, None, str(operands[-1]), font, size, None, None
        elif op == "BI":
            yield number, op, None, None, font, size, None, None


OP_SCHEMA = "path STRING, page_no INT, op_no INT, op STRING, text STRING, name STRING, font STRING, font_size DOUBLE, x DOUBLE, y DOUBLE, error STRING"
_ARROW = pa.schema([("path", pa.string()), ("page_no", pa.int32()), ("op_no", pa.int32()), ("op", pa.string()), ("text", pa.string()), ("name", pa.string()),
                    ("font", pa.string()), ("font_size", pa.float64()), ("x", pa.float64()), ("y", pa.float64()), ("error", pa.string())])


def pdf_operations(files: DataFrame) -> DataFrame:
    """``(path, page_no, op_no, op, text, name, font, font_size, x, y, error)``: text shown and objects drawn, page by page.

    ``op_no`` is the operator's place in the page's program.  What cannot be read is a row with an error and no operator.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for path, content in _files(batches):
            file, fault = open_pdf(content)
            if file is None:
                yield (path, *[None] * 9, fault)
                continue
            for i, (number, _) in enumerate(file.pages()):
                text, error = file.contents(number)
                if error:
                    yield (path, i + 1, *[None] * 8, error)
                for row in shown(text):
                    yield (path, i + 1, *row, None)

    return arrow_stage(files.select("path", "content"), lambda batches: _batches(rows(batches), _ARROW, lambda r: len(r[4] or "")), OP_SCHEMA)
