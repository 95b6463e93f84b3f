"""PDF content programs, page trees and damaged streams."""

import zlib

import pytest

from lakefold.operators import pdf as OF
from lakefold.sources.pdf import PdfFile, pdf_document_rows, pdf_objects, pdf_page_rows, pdf_streams
from lakefold.sources.pdfcontent import operations, pdf_operations, shown


def texts(program):
    return [(op, text) for _, op, text, *_ in shown(program) if text is not None]


@pytest.mark.parametrize("program,want", [
    ("BT (a) Tj (b) ' [(c) -20 (d)] TJ ET", [("Tj", "a"), ("'", "b"), ("TJ", "cd")]),
    ("(a\\(b(c(d)))Tj", [("Tj", "a(b(c(d))")]),
    ("(x)Tj(y)Tj", [("Tj", "x"), ("Tj", "y")]),
    ("<48656C6c 6F>Tj<4>Tj", [("Tj", "Hello"), ("Tj", "@")]),
    ("% (no) Tj\n(yes) Tj", [("Tj", "yes")]),
    ("/P <</MCID 0 /T (in)>> BDC (t) Tj EMC", [("Tj", "t")]),
    ("BI /W 1 ID (no) Tj EI (yes) Tj", [("Tj", "yes")]),
    ("(\\101\\60\\\\\\n\\\nz) Tj", [("Tj", "A0\\\nz")]),
    ("[(a)[(b)]] TJ () Tj Tj (open", [("TJ", "a"), ("Tj", "")]),
    ("/Name Tj 5 Tj (v) 3 (w) Tj", [("Tj", "w")]),
])
def test_text_operators(program, want):
    assert texts(program) == want


def test_state_and_objects():
    rows = list(shown("q /F2 9 Tf BT 2 0 0 2 5 6 Tm 10 20 Td (a) Tj 1 -3 TD (b) Tj T* (c) Tj ET Q BT (d) Tj ET /X Do"))
    assert [(r[2], r[4], r[5], r[6], r[7]) for r in rows[:4]] == [("a", "F2", 9.0, 25.0, 46.0), ("b", "F2", 9.0, 27.0, 40.0), ("c", "F2", 9.0, 27.0, 34.0), ("d", None, None, 0.0, 0.0)]
    assert rows[4][3] == "X"
    assert [op for op, _ in operations("1 0 0 rg 0 0 m S f* ")] == ["rg", "m", "S", "f*"]


def book(pages: int) -> bytes:
    kids = b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(pages))
    out = b"%%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /MediaBox [0 0 200 100] /Kids [%s] >> endobj\n" % kids
    for k in range(pages):
        data = zlib.compress(b"BT (page %d) Tj (more) ' ET" % k)
        out += b"%d 0 obj << /Type /Page /Contents [%d 0 R] >> endobj\n%d 0 obj << /Length %d /Filter /FlateDecode >> stream\n%s\nendstream endobj\n" % (10 + 2 * k, 11 + 2 * k, 11 + 2 * k, len(data), data)
    return out + b"trailer << /Info 3 0 R >>"


def test_hundred_pages(spark):
    files = spark.createDataFrame([("a.pdf", book(100))], "path STRING, content BINARY")
    rows = OF.pdf_shown_text(pdf_operations(files)).orderBy("page_no", "op_no").collect()
    assert [r.text for r in rows if r.op == "Tj"] == [f"page {k}" for k in range(100)] and len(rows) == 200
    sizes = OF.pdf_pages(pdf_page_rows(files)).select("width", "height").distinct().collect()
    assert [tuple(r) for r in sizes] == [(200, 100)]
    assert OF.pdf_info(pdf_document_rows(files)).collect()[0].page_count == 100
    assert pdf_objects(files, "/Type\\s*/Page\\b", streams=False).where("stream IS NULL").count() == 100


def test_truncated_streams_have_an_error(spark):
    data = zlib.compress(b"0123456789" * 10_000, 0)[:50_000]
    file = b"%%PDF-1.4\n1 0 obj << /Length %d /Filter /FlateDecode >> stream\n%s\nendstream endobj\n2 0 obj << /Length 2 >> stream\nok\nendstream endobj" % (len(data), data)
    rows = {r.obj_no: r for r in pdf_streams(spark.createDataFrame([("a.pdf", file)], "path STRING, content BINARY")).collect()}
    assert "ends early" in rows[1].error and 0 < len(rows[1].text) < 100_000
    assert (rows[2].text, rows[2].error) == ("ok", None)


def test_newest_definition_wins_in_both_orders():
    body = b"5 0 << /New 1 >>"
    packed = zlib.compress(body)
    stream = b"8 0 obj << /Type /ObjStm /N 1 /First 4 /Length %d /Filter /FlateDecode >> stream\n%s\nendstream endobj\n" % (len(packed), packed)
    plain = b"5 0 obj << /Plain 1 >> endobj\n"
    assert "/New" in PdfFile(b"%PDF\n" + plain + stream).bodies[5]
    assert "/Plain" in PdfFile(b"%PDF\n" + stream + plain).bodies[5]
    again = PdfFile(b"%PDF\n1 0 obj << /Length 2 >> stream\nab\nendstream endobj\n1 0 obj << /A 1 >> endobj\n")
    assert again.stream(1) == (None, None)
