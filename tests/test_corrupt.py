"""Empty, truncated and foreign bytes give error rows or nulls, never a failed job."""

import pytest
from pyspark.sql import functions as F

from lakefold.functions import formats, image, media
from lakefold.operators import docs, epub, media as OM, ofd, pdf, sheets, slides
from lakefold.operators.detect import decode_text, detect_encoding
from lakefold.plans import fixtures as X
from lakefold.sources.archive import archive_entries, archive_parts
from lakefold.sources.mp4 import mp4_boxes
from lakefold.sources.pdf import pdf_document_rows, pdf_objects, pdf_page_rows
from lakefold.sources.pdfcontent import pdf_operations

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bad(spark):
    """Every packed kind cut at several lengths, plus empty, missing and foreign contents."""
    one = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id = 2")
    part = spark.read.parquet(f"{SF}/part.parquet").filter("p_partkey = 2")
    files = [X.zip_documents(one), X.xlsx_documents(one), X.docx_documents(one), X.epub_documents(one), X.ofd_documents(one), X.pdf_documents(one), X.pptx_parts(part)]
    whole = files[0]
    for f in files[1:]:
        whole = whole.unionByName(f)
    cuts = whole.select("path", "content", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.1, 0.5, 0.9)])).alias("cut")).select(
        F.concat("path", F.lit("#"), F.col("cut").cast("string")).alias("path"),
        F.substring(F.col("content"), F.lit(1), (F.octet_length("content") * F.col("cut")).cast("int")).alias("content"))
    rows = [("null", None), ("magic", b"PK\x03\x04"), ("riff", b"RIFF\0\0\0\0WAVEfmt "), ("id3", b"ID3\x04"), ("bm", b"BM"), ("ftyp", b"\0\0\0\x18ftypisom"), ("text", b"plain"),
            ("box", b"\xff\xff\xff\xffmoov"), ("jpg", b"\xff\xd8\xff\xe0\xff"), ("psd", b"8BPS")]
    return cuts.unionByName(spark.createDataFrame(rows, "path STRING, content BINARY")).cache()


def test_containers(bad):
    n = bad.count()
    assert archive_entries(bad).select("path").distinct().count() == n
    assert archive_parts(bad).filter("error IS NOT NULL").count() > 0
    for opened in (sheets.open_workbooks(bad), sheets.open_et(bad), docs.open_documents(bad, media=True), docs.open_wps(bad), slides.open_presentations(bad, media=True),
                   slides.open_dps(bad), epub.open_books(bad), ofd.open_ofd(bad)):
        assert opened.count() == n


@pytest.mark.parametrize("run", [
    lambda f: sheets.cells(sheets.open_workbooks(f)), lambda f: sheets.cells(sheets.open_et(f), et=True), lambda f: docs.docx_html(docs.open_documents(f)),
    lambda f: docs.wps_content(docs.open_wps(f)), lambda f: slides.slide_text_runs(slides.open_presentations(f)), lambda f: slides.dps_texts(slides.open_dps(f)),
    lambda f: epub.epub_chapters(epub.open_books(f)), lambda f: epub.epub_toc(epub.open_books(f)), lambda f: ofd.ofd_elements(ofd.open_ofd(f)),
    lambda f: pdf.pdf_text_ops(pdf.pdf_page_contents(pdf_page_rows(f))), lambda f: pdf.pdf_info(pdf_document_rows(f)), pdf_objects, pdf_operations, lambda f: OM.media_profile(f), lambda f: OM.image_info(f), mp4_boxes,
    lambda f: f.select(formats.detect_type(F.col("path"), F.col("content")), formats.detect_image(F.col("content")), media.wav_header(F.col("content")), media.id3v2(F.col("content")),
                       media.mp3_frame(F.col("content")), image.bmp_header(F.col("content")), image.bmp_palette(F.col("content")), image.psd_header(F.col("content"))),
    lambda f: f.select(decode_text(F.col("content"), detect_encoding(F.col("content")))), lambda f: f.select(pdf.pdf_profile(F.col("content"))),
])
def test_parsers(bad, run):
    run(bad).write.format("noop").mode("overwrite").save()
